"""Run registered queries in Spark and DuckDB and compare the rows.

    python -m checks.compare [sf_dir] [query ...]
"""

import math
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from checks.oracle import ORACLE
from checks.queries import QUERIES

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def session(cpus: int | str = 8, memory: str = "8g") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    local_shared_folder(spark)
    return spark


def local_shared_folder(spark: SparkSession) -> None:
    """Give a session on one machine, where nothing says where stages go, a folder of its own for them."""
    context = spark.sparkContext
    unset = not (context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir())
    if unset and context.master.startswith("local["):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="farelake-"))


def duckdb_connection(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return value


def _sorted(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(([_plain(r[i]) for i in order] for r in rows), key=repr)


def compare(spark, con, sf_dir: str, name: str) -> str:
    """'' if both engines agree, else what differs."""
    df = QUERIES[name](spark, sf_dir)
    mine = _sorted(df.columns, df.collect())
    cur = con.execute(ORACLE[name])
    columns = [d[0] for d in cur.description]
    theirs = _sorted(columns, cur.fetchall())
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    if len(mine) != len(theirs):
        return f"rows {len(mine)} != {len(theirs)}"
    bad = [(a, b) for a, b in zip(mine, theirs) if a != b]
    return f"{len(bad)} rows differ, e.g. {bad[0]}" if bad else ""


def main(sf_dir: str, *names: str) -> int:
    spark, con = session(), duckdb_connection(sf_dir)
    failed = 0
    for name in names or QUERIES:
        start = time.time()
        try:
            if name in ORACLE:
                verdict = compare(spark, con, sf_dir, name)
            else:
                verdict, rows = "", QUERIES[name](spark, sf_dir).collect()
                if not rows:
                    verdict = "no rows"
        except Exception as error:  # report and go on with the next query
            verdict = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += bool(verdict)
        kind = "oracle" if name in ORACLE else "rows"
        print(f"{'FAIL' if verdict else 'ok  '} {name} [{kind}] {time.time() - start:.1f}s {verdict}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main(*(sys.argv[1:] or ["/root/testdata/sf0.01"])))
