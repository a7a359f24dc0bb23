"""The reductions behind profiling tables and charts, each a small DataFrame."""

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame, functions as F, types as T

from farelake.operators.quantiles import approx_group_quantiles, group_quantiles
from farelake.session import materialise

_PARTS = 16  # that the rows of a group are dealt out into


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def mean_by(df: DataFrame, by: str | Sequence[str], column: str, spread: bool = False) -> DataFrame:
    """(by..., mean[, std], rows) per non-null group, highest mean first."""
    keys = [by] if isinstance(by, str) else list(by)
    aggregates = [F.avg(F.col(column).cast("double")).alias("mean")]
    if spread:
        aggregates.append(F.stddev_samp(column).alias("std"))
    return (
        df.dropna(subset=keys)
        .groupBy(*keys)
        .agg(*aggregates, F.count(column).alias("rows"))
        .orderBy(F.desc_nulls_last("mean"), *keys)
    )


def largest_groups(df: DataFrame, by: Sequence[str], n: int = 10) -> DataFrame:
    """The ``n`` groups with most rows; equal sizes are ranked by key."""
    return (
        df.dropna(subset=list(by)).groupBy(*by).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), *by).limit(n)
    )


def highest_means(df: DataFrame, by: Sequence[str], column: str, n: int = 5) -> DataFrame:
    """The ``n`` groups with the highest mean."""
    return mean_by(df, by, column).select(*by, "mean").orderBy(F.desc_nulls_last("mean"), *by).limit(n)


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """(bin, lower, upper, rows) for equal bins over [min, max]; the last bin holds its upper end.

    A constant column gets a range of one around its value. Empty bins are kept.
    """
    values = df.select(F.col(column).cast("double").alias("x")).filter("x IS NOT NULL")
    # Both ends are read first and become literals of the counting pass.
    lo, hi = values.agg(F.min("x"), F.max("x")).first()
    if lo is None:
        lo, hi, bins = 0.0, 1.0, 0
    elif lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    place = F.floor((F.col("x") - lo) / F.lit(hi - lo) * bins)
    counts = values.groupBy(F.least(place, F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("rows"))
    step = (hi - lo) / max(bins, 1)
    frame = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return frame.join(counts, "bin", "left").select(
        "bin",
        (F.lit(lo) + F.col("bin") * step).alias("lower"),
        (F.lit(lo) + (F.col("bin") + 1) * step).alias("upper"),
        F.coalesce("rows", F.lit(0)).alias("rows"),
    )


def centre(df: DataFrame, column: str) -> DataFrame:
    """One row: mean and exact median of a column."""
    nothing = F.lit(None).cast("double")
    mean = df.select(F.avg(F.col(column).cast("double")).alias("mean"), nothing.alias("median"))
    median = group_quantiles(df, [], column, [0.5]).select(nothing.alias("mean"), F.col("value").alias("median"))
    return mean.unionByName(median).agg(F.max("mean").alias("mean"), F.max("median").alias("median"))


def box_stats(df: DataFrame, by: str, column: str, exact: bool = True, stored: bool = False) -> DataFrame:
    """Quartiles and whiskers per group, highest median first.

    Whiskers end at the outermost value within 1.5 interquartile ranges of the box.
    """
    rows = df.select(by, column).dropna(subset=[by])
    if not stored:
        rows = materialise(rows)
    quantiles = (group_quantiles if exact else approx_group_quantiles)(
        rows, [by], column, [0.25, 0.5, 0.75], stored=True
    )
    # Stored, so that its size is known: a row for each group. Where it is too large to be
    # sent to all tasks, rows are dealt out by group and a part of the value's hash, so that
    # no group meets in one task before it is reduced.
    box = materialise(quantiles.groupBy(by, "n").agg(
        *(F.max(F.when(F.col("prob") == p, F.col("value"))).alias(name) for p, name in
          ((0.25, "q1"), (0.5, "median"), (0.75, "q3")))
    ))
    parts = F.explode(F.sequence(F.lit(0), F.lit(_PARTS - 1))).alias("_part")
    x = F.col(column).cast("double")
    reach = (F.col("q3") - F.col("q1")) * 1.5
    fenced = (
        rows.withColumn("_part", F.pmod(F.xxhash64(column), F.lit(_PARTS)).cast("int"))
        .join(box.select("*", parts), [by, "_part"])
        .groupBy(by, "n", "q1", "median", "q3")
        .agg(
            F.min(F.when(x >= F.col("q1") - reach, x)).alias("_low"),
            F.max(F.when(x <= F.col("q3") + reach, x)).alias("_high"),
        )
    )
    return fenced.select(
        by,
        "n",
        "q1",
        "median",
        "q3",
        F.least("_low", "q1").alias("whisker_low"),
        F.greatest("_high", "q3").alias("whisker_high"),
    ).orderBy(F.desc("median"), by)


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column_a, column_b, correlation) below the diagonal, over pairwise complete rows, in one pass."""
    names = list(columns or numeric_columns(df))
    if len(names) < 2:
        raise ValueError("a correlation needs two numeric columns")
    entries = []
    for b, a in combinations(names, 2):
        # The sums that make up ``corr``, which itself divides by zero on a constant column.
        pair = (F.col(a).cast("double"), F.col(b).cast("double"))
        spread = F.sqrt(F.regr_sxx(*pair)) * F.sqrt(F.regr_syy(*pair))
        value = F.try_divide(F.regr_sxy(*pair), spread)
        entries.append(
            F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), value.alias("correlation"))
        )
    return df.agg(F.array(*entries).alias("_rows")).select(F.inline("_rows"))


def _long(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    pairs = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("x")) for c in columns))
    return df.select(F.inline(pairs)).filter("x IS NOT NULL")


def describe(df: DataFrame, columns: Sequence[str] | None = None, stored: bool = False) -> DataFrame:
    """(column_name, rows, mean, std, min, q25, q50, q75, max) with exact quartiles."""
    names = list(columns or numeric_columns(df))
    tall = _long(df.select(*names) if stored else materialise(df.select(*names)), names)
    moments = tall.groupBy("column_name").agg(
        F.count("*").alias("rows"),
        F.avg("x").alias("mean"),
        F.stddev_samp("x").alias("std"),
        F.min("x").alias("min"),
        F.max("x").alias("max"),
    )
    marks = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
    quartiles = (
        group_quantiles(tall, ["column_name"], "x", list(marks.values()), stored=True)
        .groupBy("column_name")
        .agg(*(F.max(F.when(F.col("prob") == p, F.col("value"))).alias(name) for name, p in marks.items()))
    )
    return moments.join(quartiles, "column_name").select(
        "column_name", "rows", "mean", "std", "min", *marks, "max"
    )


def missing_values(df: DataFrame) -> DataFrame:
    """(column_name, missing) of the columns that have missing values, in one pass."""
    entries = [
        F.struct(F.lit(c).alias("column_name"), F.count_if(F.col(f"`{c}`").isNull()).alias("missing")) for c in df.columns
    ]
    return df.agg(F.array(*entries).alias("_rows")).select(F.inline("_rows")).filter("missing > 0")


def shape(df: DataFrame) -> DataFrame:
    """One row: (rows, columns). No column is read for it."""
    return df.agg(F.count("*").alias("rows")).withColumn("columns", F.lit(len(df.columns)))


def column_types(df: DataFrame) -> DataFrame:
    """(position, column_name, data_type) of the frame."""
    rows = [(i, name, dtype) for i, (name, dtype) in enumerate(df.dtypes)]
    return df.sparkSession.createDataFrame(rows, "position int, column_name string, data_type string")
