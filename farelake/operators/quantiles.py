"""Exact group quantiles that hold no group in one place."""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from farelake.session import materialise

_SLACK = 2  # sketch errors granted on either side of a wanted rank


def _slot(x: Column, edges: Column, count: int) -> Column:
    """Which stretch between the edges ``x`` lies in; each edge value is a stretch of its own."""
    steps = [(x > edges[i]).cast("int") + (x >= edges[i]).cast("int") for i in range(count)]
    return reduce(Column.__add__, steps)


def group_quantiles(
    df: DataFrame,
    by: Sequence[str],
    column: str,
    probs: Sequence[float],
    accuracy: int = 10_000,
    stored: bool = False,
) -> DataFrame:
    """(by..., n, prob, value): linearly interpolated quantiles of ``column`` per group, NULLs left out.

    The rows are read three times. ``stored`` says that ``df`` is a stored table; otherwise
    the columns in use are written out first, so that the work behind them is done once.
    An ungrouped column is always written, with a constant as its group.

    Spark's ``percentile`` keeps all distinct values of a group in one buffer. Here a
    bounded sketch proposes two edges around each wanted rank. The edges only cut the
    group into stretches; counting the stretches shows exactly which one holds each
    rank, and only those, about one row in ``accuracy``, are sorted. An edge that is
    off costs time, never the result.
    """
    if not by:
        grouped = df.select(F.lit(0).alias("_all"), column)
        return group_quantiles(grouped, ["_all"], column, probs, accuracy).drop("_all")
    by = list(by)
    rows = df.select(*by, F.col(column).cast("double").alias("_x")).filter("_x IS NOT NULL")
    rows = rows if stored else materialise(rows)
    match = reduce(Column.__and__, (F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in by))

    margin = _SLACK / accuracy
    marks = sorted({min(max(p + d, 0.0), 1.0) for p in probs for d in (-margin, margin)})
    groups = materialise(
        rows.groupBy(*by).agg(
            F.count("*").alias("n"),
            F.percentile_approx("_x", [float(m) for m in marks], accuracy).alias("_edges"),
        )
    )
    slotted = (
        rows.alias("r")
        .join(groups.alias("s"), match)
        .select(*(F.col(f"r.{c}").alias(c) for c in by), "_x", _slot(F.col("_x"), F.col("_edges"), len(marks)).alias("_slot"))
    )

    # At most 2 * len(marks) + 1 stretches per group.
    before = Window.partitionBy(*by).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    stretches = (
        slotted.groupBy(*by, "_slot")
        .agg(F.count("*").alias("_size"))
        .withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0)))
    )

    # Wanted ranks: the two rows around prob * (n - 1).
    spot = F.col("prob") * (F.col("n") - 1)
    low = F.floor(spot).cast("bigint")
    ranks = groups.select(*by, "n", F.explode(F.array(*(F.lit(float(p)) for p in probs))).alias("prob")).select(
        *by,
        "n",
        "prob",
        (spot - low).alias("_part"),
        F.explode(F.array(low, F.least(low + 1, F.col("n") - 1))).alias("_rank"),
    )
    targets = materialise(
        ranks.distinct()
        .alias("r")
        .join(stretches.alias("s"), match & (F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_size")))
        .select(*(F.col(f"r.{c}").alias(c) for c in by), "n", "prob", "_part", "_rank", "_slot", (F.col("_rank") - F.col("_before")).alias("_offset"))
    )

    same_slot = match & (F.col("r._slot") == F.col("s._slot"))
    wanted = targets.select(*by, "_slot").distinct()
    along = Window.partitionBy(*by, "_slot").orderBy("_x")
    sized = (
        slotted.alias("r")
        .join(wanted.alias("s"), same_slot, "left_semi")
        .groupBy(*by, "_slot", "_x")
        .agg(F.count("*").alias("_copies"))
        .withColumn("_upto", F.sum("_copies").over(along))
    )
    picked = (
        targets.alias("r")
        .join(
            sized.alias("s"),
            same_slot & (F.col("_offset") < F.col("_upto")) & (F.col("_offset") >= F.col("_upto") - F.col("_copies")),
        )
        .select(*(F.col(f"r.{c}").alias(c) for c in by), "n", "prob", "_part", "_x")
    )
    lo, hi = F.min("_x"), F.max("_x")
    return picked.groupBy(*by, "n", "prob", "_part").agg(lo.alias("_lo"), hi.alias("_hi")).select(
        *by, "n", "prob", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_part")).alias("value")
    )


def approx_group_quantiles(
    df: DataFrame,
    by: Sequence[str],
    column: str,
    probs: Sequence[float],
    accuracy: int = 10_000,
    stored: bool = False,
) -> DataFrame:
    """As :func:`group_quantiles` in a single pass, each value within ``1/accuracy`` of its rank.

    ``stored`` makes no difference to a single pass.
    """
    listed = F.array(*(F.lit(float(p)) for p in probs))
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(*by)
        .agg(
            F.count("*").alias("n"),
            F.arrays_zip(
                listed.alias("prob"),
                F.percentile_approx(F.col(column).cast("double"), [float(p) for p in probs], accuracy).alias("value"),
            ).alias("_q"),
        )
        .select(*by, "n", F.inline("_q"))
    )
