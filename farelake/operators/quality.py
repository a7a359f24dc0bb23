"""Column tests and layer gates, as reports of one row per check."""

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from farelake.functions.dates import parse_datetime
from farelake.functions.numeric import to_numeric_type
from farelake.functions.text import null_or_blank
from farelake.schema import (
    BRONZE_TABLE, CLASSES, DURATION_LABELS, FARE_COLUMNS, FEATURE_TABLE, KEY, KPI_TABLES, LEAD_LABELS, NUMERIC_TYPES,
    SEASONS, SILVER_TABLE, STOPOVERS, TARGET,
)
from farelake.sources.tables import layer_counts


TIME_COLUMNS = ("departure_datetime", "arrival_datetime")
# Columns whose blanks the gate of Bronze counts.
NOT_BLANK = ("airline", "source", "destination", KEY)


class QualityError(ValueError):
    """A check of severity ``error`` failed."""


@dataclass(frozen=True)
class Check:
    table: str
    column: str
    test: str  # unique | not_null | accepted_values
    values: tuple[str, ...] = ()


def _suite() -> tuple[Check, ...]:
    # Which column of which table is tested for what.
    unique = {
        BRONZE_TABLE: [KEY],
        SILVER_TABLE: [KEY],
        "gold.avg_fare_by_airline": ["airline"],
        "gold.booking_count_by_airline": ["airline"],
        "gold.seasonal_fare_variation": ["seasonality"],
        "gold.avg_fare_by_class": ["class"],
        "gold.avg_fare_by_route": ["route"],
    }
    not_null = {
        BRONZE_TABLE: [KEY, "airline", "source", "destination"],
        SILVER_TABLE: [
            KEY, "airline", "source", "destination", "departure_datetime", "base_fare_bdt", "tax_surcharge_bdt",
            "duration_bucket", "booking_lead_bucket",
        ],
        "gold.avg_fare_by_airline": ["airline"],
        "gold.booking_count_by_airline": ["airline"],
        "gold.top_routes": ["source", "destination"],
        "gold.seasonal_fare_variation": ["seasonality"],
        "gold.avg_fare_by_class": ["class"],
        "gold.avg_fare_by_route": ["route"],
        FEATURE_TABLE: ["airline", TARGET],
    }
    accepted = {
        "stopovers": STOPOVERS,
        "class": CLASSES,
        "seasonality": SEASONS,
        "duration_bucket": DURATION_LABELS,
        "booking_lead_bucket": LEAD_LABELS,
    }
    return (
        *(Check(t, c, "unique") for t, cols in unique.items() for c in cols),
        *(Check(t, c, "not_null") for t, cols in not_null.items() for c in cols),
        *(Check(SILVER_TABLE, c, "accepted_values", v) for c, v in accepted.items()),
    )


SUITE = _suite()


def duplicate_values(df: DataFrame, column: str) -> DataFrame:
    """(value, copies) of the non-null values that occur more than once."""
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("value"))
        .agg(F.count("*").alias("copies"))
        .filter("copies > 1")
    )


def unexpected_values(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """(value, rows) of the values outside ``values``; NULL passes."""
    return df.filter(~F.col(column).isin(*values)).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("rows"))


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, nulls) of the columns, in one pass without a shuffle of rows."""
    return _tall(df, {c: F.count_if(F.col(c).isNull()) for c in columns}, "column_name", "nulls")


def _tall(df: DataFrame, aggregates: Mapping[str, Column], name: str, value: str) -> DataFrame:
    """One aggregate row turned into (name, value) rows."""
    entries = [F.struct(F.lit(k).alias(name), v.alias(value)) for k, v in aggregates.items()]
    return df.agg(F.array(*entries).alias("_rows")).select(F.inline("_rows"))


def failing(check: Check) -> Column:
    """The rows that fail a row check; NULL passes ``accepted_values``."""
    column = F.col(check.column)
    return column.isNull() if check.test == "not_null" else ~column.isin(*check.values)


def run_checks(tables: Mapping[str, DataFrame], suite: Sequence[Check] = SUITE) -> DataFrame:
    """(table_name, column_name, test, failures, passed) of each check.

    ``failures`` counts rows for not_null and accepted_values, repeated values for unique.
    All row checks of a table share one scan; a unique test reads its own column only.
    """
    parts = []
    for table, df in tables.items():
        checks = [c for c in suite if c.table == table]
        entries = []
        for c in checks:
            if c.test == "unique":
                parts.append(
                    duplicate_values(df, c.column).agg(
                        F.lit(table).alias("table_name"),
                        F.lit(c.column).alias("column_name"),
                        F.lit("unique").alias("test"),
                        F.count("*").alias("failures"),
                    )
                )
                continue
            bad = failing(c)
            entries.append(
                F.struct(
                    F.lit(table).alias("table_name"),
                    F.lit(c.column).alias("column_name"),
                    F.lit(c.test).alias("test"),
                    F.count_if(bad).alias("failures"),
                )
            )
        if entries:
            parts.append(df.agg(F.array(*entries).alias("_rows")).select(F.inline("_rows")))
    return reduce(DataFrame.unionByName, parts).withColumn("passed", F.col("failures") == 0)


def _gate(rows: DataFrame) -> DataFrame:
    return rows.withColumn("passed", F.col("failures") == 0).select("check", "severity", "failures", "passed")


def bronze_gate(bronze: DataFrame) -> DataFrame:
    """Error if there are no rows; warnings for blanks, negative fares and repeated keys."""
    negative = reduce(Column.__or__, (F.col(c) < 0 for c in FARE_COLUMNS))
    row_checks = {"rows": F.when(F.count("*") == 0, 1).otherwise(0).cast("bigint")}
    row_checks |= {f"null_or_blank:{c}": F.count_if(null_or_blank(c)) for c in NOT_BLANK}
    row_checks["negative_fare"] = F.count_if(negative)
    rows = _tall(bronze, row_checks, "check", "failures")
    repeated = duplicate_values(bronze, KEY).agg(
        F.lit("repeated_key").alias("check"), F.count("*").alias("failures")
    )
    severity = F.when(F.col("check") == "rows", "error").otherwise("warn")
    return _gate(rows.unionByName(repeated).withColumn("severity", severity))


def month_counts(rows: DataFrame, table: str, month: str, suite: Sequence[Check] = SUITE) -> DataFrame:
    """(``month``, measure, value): the counts that the checks and gates of a layer add up from, by month.

    Measures are ``rows``, ``test:column`` for each check, and those of the gate of Bronze. Keys repeat within their month
    only, as equal keys have equal departures, so repeated values add up as well.
    """
    checks = [c for c in suite if c.table == table]
    measures = {"rows": F.count("*")} | {f"{c.test}:{c.column}": F.count_if(failing(c)) for c in checks if c.test != "unique"}
    if table == BRONZE_TABLE:
        measures |= {f"null_or_blank:{c}": F.count_if(null_or_blank(c)) for c in NOT_BLANK}
        measures["negative_fare"] = F.count_if(reduce(Column.__or__, (F.col(c) < 0 for c in FARE_COLUMNS)))
    entries = [F.struct(F.lit(name).alias("measure"), value.alias("value")) for name, value in measures.items()]
    parts = [rows.groupBy(month).agg(F.array(*entries).alias("_rows")).select(month, F.inline("_rows"))]
    for c in checks:
        if c.test == "unique":
            repeated = rows.filter(F.col(c.column).isNotNull()).groupBy(month, c.column).agg(F.count("*").alias("copies")).filter("copies > 1")
            parts.append(repeated.groupBy(month).agg(F.lit(f"unique:{c.column}").alias("measure"), F.count("*").alias("value")))
    return reduce(DataFrame.unionByName, parts)


def _sums(counts: DataFrame) -> DataFrame:
    return counts.groupBy("measure").agg(F.sum("value").alias("value"))


def checks_from_counts(spark: SparkSession, counts: Mapping[str, DataFrame], suite: Sequence[Check] = SUITE) -> DataFrame:
    """``run_checks`` of the tables whose ``month_counts`` are given."""
    known = [(c.table, c.column, c.test) for c in suite if c.table in counts]
    found = reduce(DataFrame.unionByName, (_sums(c).withColumn("table_name", F.lit(t)) for t, c in counts.items()))
    listed = spark.createDataFrame(known, "table_name string, column_name string, test string")
    report = listed.withColumn("measure", F.concat("test", F.lit(":"), "column_name")).join(found, ["table_name", "measure"], "left")
    report = report.select("table_name", "column_name", "test", F.coalesce("value", F.lit(0)).alias("failures"))
    return report.withColumn("passed", F.col("failures") == 0)


def bronze_gate_from_counts(counts: DataFrame) -> DataFrame:
    """``bronze_gate`` of the table whose ``month_counts`` are given."""
    spark = counts.sparkSession
    names = ["rows", *(f"null_or_blank:{c}" for c in NOT_BLANK), "negative_fare", f"unique:{KEY}"]
    listed = spark.createDataFrame([(n,) for n in names], "measure string").join(_sums(counts), "measure", "left")
    value = F.coalesce("value", F.lit(0))
    failures = F.when(F.col("measure") == "rows", F.when(value == 0, 1).otherwise(0).cast("bigint")).otherwise(value)
    check = F.when(F.col("measure") == f"unique:{KEY}", "repeated_key").otherwise(F.col("measure"))
    severity = F.when(F.col("check") == "rows", "error").otherwise("warn")
    return _gate(listed.select(check.alias("check"), failures.alias("failures")).withColumn("severity", severity))


def rows_from_counts(counts: DataFrame) -> DataFrame:
    """One row: the rows of the table whose ``month_counts`` are given."""
    return counts.filter("measure = 'rows'").agg(F.coalesce(F.sum("value"), F.lit(0)).alias("rows"))


def lost_cells(scan: DataFrame) -> DataFrame:
    """Cells of a text scan that say something, but become NULL: no number of the column's type, or no time.

    A warning for each numeric and time column, all from one pass. Blank cells are missing, not lost.
    """
    said = {c: F.trim(F.col(c).cast("string")) != "" for c in (*NUMERIC_TYPES, *TIME_COLUMNS)}
    kept = {c: to_numeric_type(F.col(c), kind) for c, kind in NUMERIC_TYPES.items()}
    kept |= {c: parse_datetime(F.col(c)) for c in TIME_COLUMNS}
    counts = {f"lost:{c}": F.count_if(said[c] & kept[c].isNull()) for c in kept}
    return _gate(_tall(scan, counts, "check", "failures").withColumn("severity", F.lit("warn")))


def silver_gate(bronze: DataFrame, silver: DataFrame) -> DataFrame:
    """Row counts, ``drop_pct`` (NULL for an empty Bronze) and the verdict: failed, warning or passed."""
    return silver_verdict(bronze.agg(F.count("*").alias("rows")), silver.agg(F.count("*").alias("rows")))


def silver_verdict(bronze_rows: DataFrame, silver_rows: DataFrame) -> DataFrame:
    """The gate of Silver from the row counts (``rows``) of both layers."""
    none = F.lit(0).cast("bigint")
    counts = (
        bronze_rows.select(F.col("rows").alias("bronze_rows"), none.alias("silver_rows"))
        .unionByName(silver_rows.select(none.alias("bronze_rows"), F.col("rows").alias("silver_rows")))
        .agg(F.sum("bronze_rows").alias("bronze_rows"), F.sum("silver_rows").alias("silver_rows"))
    )
    kept = F.col("silver_rows").cast("decimal(20,0)") / F.nullif("bronze_rows", F.lit(0)).cast("decimal(20,0)")
    return counts.select(
        "bronze_rows", "silver_rows", F.round((1 - kept) * 100, 1).cast("decimal(10,1)").alias("drop_pct")
    ).withColumn(
        "verdict",
        F.when(F.col("silver_rows") == 0, "failed").when(F.col("drop_pct") > 50, "warning").otherwise("passed"),
    )


def gold_gate(spark: SparkSession, tables: Mapping[str, DataFrame | None]) -> DataFrame:
    """Row counts of the Gold tables; only a missing or empty feature table fails."""
    return gold_verdict(layer_counts({t: tables.get(t) for t in (FEATURE_TABLE, *KPI_TABLES)}, spark))


def gold_verdict(counts: DataFrame) -> DataFrame:
    """The gate of Gold from the row counts (table_name, row_count) of its tables."""
    needed = F.col("table_name") == FEATURE_TABLE
    return counts.select(
        "table_name",
        "row_count",
        F.when(needed, "error").otherwise("info").alias("severity"),
        (~needed | (F.col("row_count") > 0)).alias("passed"),
    )


def enforce(report: DataFrame) -> DataFrame:
    """Raise if any check failed; in a gate report only those of severity ``error`` count."""
    if "verdict" in report.columns:
        failed = report.filter("verdict = 'failed'")
    else:
        failed = report.filter("NOT passed")
    if "severity" in report.columns:
        failed = failed.filter("severity = 'error'")
    # Reports have one row per check, so the list is short.
    names = [" ".join(str(v) for v in row) for row in failed.collect()]
    if names:
        raise QualityError("; ".join(names))
    return report
