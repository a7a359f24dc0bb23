"""A bookings feed derived from the driver's tables, in Spark and in DuckDB SQL.

Every column is stated twice: as a Spark SQL expression, and as DuckDB SQL where
the dialects differ. ``bookings`` only joins the tables its columns need.
"""

import functools
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from farelake.functions.keys import row_key
from farelake.schema import KEY_COLUMNS

_DEPARTURE = "CASE WHEN l_partkey % 101 = 0 THEN '' ELSE {text} END"
_HOURS = "CASE WHEN l_partkey % 89 = 0 THEN NULL ELSE CAST(l_quantity / 4 AS DECIMAL(10,4)) END"
# Decimals kept within 18 digits, which Spark computes as longs.
_GROSS = (
    "CAST(CAST(l_extendedprice AS DECIMAL(11,2)) * (CAST(1 AS DECIMAL(1,0)) - CAST(l_discount AS DECIMAL(4,2))) "
    "AS DECIMAL(13,4))"
)
_BASE = (
    f"CAST(CASE WHEN c_acctbal < 0 AND l_linenumber = 1 THEN -{_GROSS} ELSE {_GROSS} END AS DECIMAL(15,6))"
)
_TAX = f"CAST({_GROSS} * CAST(l_tax AS DECIMAL(4,2)) AS DECIMAL(15,6))"
_MINUTES = "CAST(FLOOR(COALESCE(l_quantity, 0) / 4 * 60) AS INT)"

# column -> (expression, tables it needs beside lineitem)
_COLUMNS = {
    "id": ("l_orderkey * 10 + l_linenumber", ()),
    "airline": ("CASE WHEN l_partkey % 97 = 0 THEN '' ELSE concat('  ', p_brand, ' ') END", ("part",)),
    "source": ("concat('N', lpad(CAST(s_nationkey AS {str}), 2, '0'))", ("supplier",)),
    "source_name": ("sn.n_name", ("supplier", "source_nation")),
    "destination": ("concat('N', lpad(CAST(c_nationkey AS {str}), 2, '0'))", ("orders", "customer")),
    "destination_name": ("cn.n_name", ("orders", "customer", "destination_nation")),
    "departure_datetime": (_DEPARTURE, ()),
    "arrival_datetime": ("CASE WHEN l_partkey % 101 = 0 THEN NULL ELSE {arrival} END", ()),
    "duration_hrs": (_HOURS, ()),
    "stopovers": ("CASE l_returnflag WHEN 'A' THEN 'Direct' WHEN 'N' THEN '1 Stop' ELSE '2 Stops' END", ()),
    "aircraft_type": ("p_type", ("part",)),
    "class": (
        "CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'First Class' WHEN '2' THEN 'Business' ELSE 'Economy' END",
        ("orders",),
    ),
    "booking_source": ("c_mktsegment", ("orders", "customer")),
    "base_fare_bdt": (_BASE, ("orders", "customer")),
    "tax_surcharge_bdt": (_TAX, ()),
    "total_fare_bdt": (f"CAST({_BASE} + {_TAX} AS DECIMAL(15,6))", ("orders", "customer")),
    "seasonality": (
        "CASE WHEN month(l_shipdate) IN (12, 1) THEN 'Winter Holidays' WHEN month(l_shipdate) = 4 THEN 'Eid' "
        "WHEN month(l_shipdate) = 6 THEN 'Hajj' ELSE 'Regular' END",
        (),
    ),
    "days_before_departure": (
        "CASE WHEN l_partkey % 83 = 0 THEN NULL ELSE CAST(abs({days}) % 61 AS INT) END",
        ("orders",),
    ),
    "created_at": ("CAST(o_orderdate AS TIMESTAMP)", ("orders",)),
    "updated_at": ("CAST(o_orderdate AS TIMESTAMP)", ("orders",)),
}

_SPARK = {
    "str": "STRING",
    "text": "date_format(l_shipdate + make_dt_interval(0, CAST(l_suppkey % 24 AS INT)), 'yyyy-MM-dd HH:mm:ss')",
    "arrival": (
        "date_format(l_shipdate + make_dt_interval(0, CAST(l_suppkey % 24 AS INT), "
        f"IF(l_partkey % 89 = 0, 0, {_MINUTES})), 'yyyy-MM-dd HH:mm:ss')"
    ),
    "days": "datediff(l_shipdate, o_orderdate)",
}
_DUCKDB = {
    "str": "VARCHAR",
    "text": "strftime(l_shipdate + to_hours(CAST(l_suppkey % 24 AS INT)), '%Y-%m-%d %H:%M:%S')",
    "arrival": (
        "strftime(l_shipdate + to_hours(CAST(l_suppkey % 24 AS INT)) + "
        f"to_minutes(CASE WHEN l_partkey % 89 = 0 THEN 0 ELSE {_MINUTES} END), '%Y-%m-%d %H:%M:%S')"
    ),
    "days": "date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))",
}

_JOINS = {
    "orders": ("orders", "l_orderkey = o_orderkey"),
    "customer": ("customer", "o_custkey = c_custkey"),
    "supplier": ("supplier", "l_suppkey = s_suppkey"),
    "part": ("part", "l_partkey = p_partkey"),
    "source_nation": ("nation sn", "s_nationkey = sn.n_nationkey"),
    "destination_nation": ("nation cn", "c_nationkey = cn.n_nationkey"),
}

FEED_COLUMNS = tuple(_COLUMNS)
ALL_COLUMNS = ("id", "booking_hash", *FEED_COLUMNS[1:])


@functools.cache
def _schema(path: str) -> T.StructType:
    return SparkSession.active().read.parquet(path).schema


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A driver table; its footer is read for the schema once per process."""
    path = f"{sf_dir}/{table}.parquet"
    return spark.read.schema(_schema(path)).parquet(path)


# Rows of the feed that a task is dealt, so that what it holds does not grow with the table.
ROWS_PER_TASK = 250_000


def _spread(lines: DataFrame, *keys: str, rows: DataFrame | None = None) -> DataFrame:
    """The test tables are single files of one row group, which one task would read: deal their rows out to all cores.

    Large tables are dealt out to more tasks than cores; the rows are counted from the file's footer. Those have at least as
    many as shuffle partitions, so that a join by ``keys`` takes the rows as they are dealt. ``rows``, where given, are dealt
    out in place of ``lines``, with a row or none for each of them.
    """
    spark, rows = lines.sparkSession, lines if rows is None else rows
    cores = spark.sparkContext.defaultParallelism
    if len(lines.inputFiles()) >= cores:
        return rows
    tasks = -(-lines.count() // ROWS_PER_TASK)
    tasks = max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions"))) if keys and tasks > cores else max(tasks, cores)
    return rows.repartition(tasks, *(keys or ("l_orderkey", "l_linenumber")))


def _joined(rows: DataFrame, sf_dir: str, tables: Iterable[str]) -> DataFrame:
    for name in tables:
        table, condition = _JOINS[name]
        base, _, alias = table.partition(" ")
        rows = rows.join(load(rows.sparkSession, sf_dir, base).alias(alias or base), F.expr(condition))
    return rows


def bookings(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The feed, or the named columns of it. Joins are plain: sizes decide the strategy at run time."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    wanted = columns or ALL_COLUMNS
    sources = [c for c in FEED_COLUMNS if c in wanted or ("booking_hash" in wanted and c in KEY_COLUMNS)]
    needed = {table for c in sources for table in _COLUMNS[c][1]}
    lines = load(spark, sf_dir, "lineitem")
    if "orders" in needed:
        # Lines are as wide as they get after orders, whose own tables are joined to them before: what is shuffled for a join
        # by part is lines alone, and dealing out by order is the shuffle for the next one.
        orders = _joined(load(spark, sf_dir, "orders"), sf_dir, [n for n in ("customer", "destination_nation") if n in needed])
        rows = _spread(lines, "l_orderkey", rows=_joined(lines, sf_dir, needed & {"part"}))
        rows = rows.join(orders, F.expr(_JOINS["orders"][1]))
    else:
        rows = _joined(_spread(lines), sf_dir, needed & {"part"})
    rows = _joined(rows, sf_dir, [n for n in ("supplier", "source_nation") if n in needed])
    rows = rows.select(*(F.expr(_COLUMNS[c][0].format(**_SPARK)).alias(c) for c in sources))
    return rows.select(*(row_key().alias(c) if c == "booking_hash" else F.col(c) for c in wanted))


def _bookings_sql() -> str:
    select = ",\n    ".join(f"{expr.format(**_DUCKDB)} AS {name}" for name, (expr, _) in _COLUMNS.items())
    joins = " ".join(f"JOIN {table} ON {condition}" for table, condition in _JOINS.values())
    key = " || '|' || ".join(f"COALESCE({c}, 'nan')" for c in KEY_COLUMNS)
    return (
        f"feed AS (SELECT {select} FROM lineitem {joins}),\n"
        f"bookings AS (SELECT *, substring(sha256({key}), 1, 32) AS booking_hash FROM feed)"
    )


BOOKINGS_SQL = _bookings_sql()
