"""Gold: KPI tables and the feature table, each a function of Silver."""

from collections.abc import Mapping, Sequence
from datetime import datetime
from functools import partial

from pyspark.sql import Column, DataFrame, Window, functions as F

from farelake.functions.dates import departure_parts
from farelake.functions.numeric import round2
from farelake.functions.text import present
from farelake.schema import CATEGORICAL_FEATURES, PEAK_SEASONS, TARGET

ROUTE = ("source", "source_name", "destination", "destination_name")


def _stat(fn, column: str, name: str) -> Column:
    return round2(fn(column)).alias(name)


def _beside_groups(groups: DataFrame, total: Column, name: str) -> DataFrame:
    """``groups`` with a figure over all of them in a column ``name``, from one pass.

    A grouping set for the rows themselves and one for all of them: tasks combine their part of the figure, and one row
    holds it. That row is then sent once to each of the slots that the groups are dealt out to. So neither the rows
    behind the groups are read twice, nor do all groups meet in one task, as in a window over all of them.
    """
    slots = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = groups.groupingSets([groups.columns, []], *groups.columns).agg(total.alias(name), F.grouping_id().alias("_all"))
    own = F.array(F.pmod(F.xxhash64(*groups.columns), F.lit(slots)).cast("int"))
    dealt = both.withColumn("_slot", F.explode(F.when(F.col("_all") > 0, F.sequence(F.lit(0), F.lit(slots - 1))).otherwise(own)))
    figure = F.max(F.when(F.col("_all") > 0, F.col(name))).over(Window.partitionBy("_slot"))
    return dealt.withColumn(name, figure).filter("_all = 0").drop("_all", "_slot")


def _share(part: Column, whole: Column) -> Column:
    return round2(part.cast("decimal(20,0)") * 100 / whole.cast("decimal(20,0)"))


FARES = ("base_fare_bdt", "tax_surcharge_bdt", TARGET)


def avg_fare_by_airline(silver: DataFrame) -> DataFrame:
    return _airlines(
        silver.filter(present("airline"))
        .groupBy("airline")
        .agg(
            F.count("*").alias("booking_count"),
            _stat(F.avg, "base_fare_bdt", "avg_base_fare_bdt"),
            _stat(F.avg, "tax_surcharge_bdt", "avg_tax_surcharge_bdt"),
            _stat(F.avg, TARGET, "avg_total_fare_bdt"),
            _stat(F.min, TARGET, "min_total_fare_bdt"),
            _stat(F.max, TARGET, "max_total_fare_bdt"),
        )
    )


def _airlines(stats: DataFrame) -> DataFrame:
    return stats.orderBy(F.desc("avg_total_fare_bdt"), "airline")


def avg_fare_by_class(silver: DataFrame) -> DataFrame:
    return _classes(
        silver.filter(present("class"))
        .groupBy("class")
        .agg(
            F.count("*").alias("booking_count"),
            _stat(F.avg, "base_fare_bdt", "avg_base_fare_bdt"),
            _stat(F.avg, "tax_surcharge_bdt", "avg_tax_surcharge_bdt"),
            _stat(F.avg, TARGET, "avg_total_fare_bdt"),
            _stat(F.min, TARGET, "min_fare_bdt"),
            _stat(F.max, TARGET, "max_fare_bdt"),
            _stat(F.stddev_samp, TARGET, "fare_stddev"),
        )
    )


def _classes(stats: DataFrame) -> DataFrame:
    columns = [F.col(c) for c in stats.columns]
    columns.insert(2, _share(F.col("booking_count"), F.col("_whole")).alias("class_share_pct"))
    return _beside_groups(stats, F.sum("booking_count"), "_whole").select(*columns).orderBy(F.desc("avg_total_fare_bdt"), "class")


def booking_count_by_airline(silver: DataFrame) -> DataFrame:
    return _counts(silver.filter(present("airline")).groupBy("airline").agg(F.count("*").alias("total_bookings")))


def _counts(stats: DataFrame) -> DataFrame:
    return _beside_groups(stats, F.sum("total_bookings"), "_whole").select(
        "airline", "total_bookings", _share(F.col("total_bookings"), F.col("_whole")).alias("market_share_pct")
    ).orderBy(F.desc("total_bookings"), "airline")


def avg_fare_by_route(silver: DataFrame) -> DataFrame:
    """Fares per route against the unweighted mean of the rounded route averages."""
    # Silver holds no NULL fare or duration, so AVG/AVG is SUM/SUM, with no rounding in between.
    hours = F.sum("duration_hrs")
    return _routes(
        silver.filter(present("source", "destination"))
        .groupBy(*ROUTE)
        .agg(
            F.count("*").alias("booking_count"),
            _stat(F.avg, TARGET, "avg_fare_bdt"),
            _stat(F.min, TARGET, "min_fare_bdt"),
            _stat(F.max, TARGET, "max_fare_bdt"),
            _stat(F.avg, "duration_hrs", "avg_duration_hrs"),
            F.when(hours > 0, round2(F.sum(TARGET) / F.nullif(hours, F.lit(0)))).alias("avg_fare_per_hour"),
        )
    )


def _routes(stats: DataFrame) -> DataFrame:
    arrow, overall = F.lit(" → "), F.col("_overall")
    mean = F.sum("avg_fare_bdt") / F.nullif(F.count("avg_fare_bdt"), F.lit(0))
    return _beside_groups(stats, mean.cast("decimal(24,10)"), "_overall").select(
        F.concat("source", arrow, "destination").alias("route"),
        F.concat("source_name", arrow, "destination_name").alias("route_full"),
        *stats.columns,
        round2((F.col("avg_fare_bdt") - overall) * 100 / overall).alias("fare_vs_avg_pct"),
    ).orderBy(F.desc("booking_count"), *ROUTE)


def seasonal_fare_variation(silver: DataFrame, peak_seasons: Sequence[str] = PEAK_SEASONS) -> DataFrame:
    stats = silver.groupBy("seasonality").agg(
        F.count("*").alias("booking_count"),
        _stat(F.avg, "base_fare_bdt", "avg_base_fare_bdt"),
        _stat(F.avg, "tax_surcharge_bdt", "avg_tax_surcharge_bdt"),
        _stat(F.avg, TARGET, "avg_total_fare_bdt"),
        _stat(F.min, TARGET, "min_total_fare_bdt"),
        _stat(F.max, TARGET, "max_total_fare_bdt"),
        _stat(F.stddev_samp, TARGET, "stddev_total_fare_bdt"),
        F.sum(TARGET).alias("_sum"),
        F.count(TARGET).alias("_fares"),
    )
    return _seasons(stats, peak_seasons)


def _seasons(stats: DataFrame, peak_seasons: Sequence[str]) -> DataFrame:
    # Over every Silver row, blank seasons included, and rounded before it is compared with.
    overall = F.sum("_sum").cast(stats.schema["_sum"].dataType) / F.sum("_fares")
    diff = F.col("avg_total_fare_bdt") - F.col("overall_avg_fare")
    return (
        _beside_groups(stats, round2(overall), "overall_avg_fare")
        .filter(present("seasonality"))
        .select(
            *(c for c in stats.columns if not c.startswith("_")),
            "overall_avg_fare",
            round2(diff).alias("fare_diff_from_avg"),
            round2(diff * 100 / F.col("overall_avg_fare")).alias("fare_pct_diff_from_avg"),
            F.when(F.col("seasonality").isin(*peak_seasons), "Peak").otherwise("Non-Peak").alias("season_type"),
        )
        .orderBy(F.desc("avg_total_fare_bdt"), "seasonality")
    )


def top_routes(silver: DataFrame, n: int = 50) -> DataFrame:
    """The ``n`` busiest routes; equal counts are ranked by route, so the cut is repeatable."""
    return _busiest(
        silver.filter(present("source", "destination"))
        .groupBy(*ROUTE)
        .agg(
            F.count("*").alias("booking_count"),
            _stat(F.avg, TARGET, "avg_fare_bdt"),
            _stat(F.min, TARGET, "min_fare_bdt"),
            _stat(F.max, TARGET, "max_fare_bdt"),
        ),
        n,
    )


def _busiest(stats: DataFrame, n: int) -> DataFrame:
    return stats.orderBy(F.desc("booking_count"), *ROUTE).limit(n)


# -- the same from stored sums ------------------------------------------------------------

# Groups that KPI tables are put together from, and what is summed in them.
SUMS = {
    "gold.sums_by_airline": (("airline",), FARES),
    "gold.sums_by_class": (("class",), FARES),
    "gold.sums_by_route": (ROUTE, (TARGET, "duration_hrs")),
    "gold.sums_by_season": (("seasonality",), FARES),
}
_SQUARE = "decimal(38,12)"


def partial_sums(silver: DataFrame, name: str, *by: str) -> DataFrame:
    """Counts, sums, squares and extremes of a group of ``SUMS``, also by the columns ``by``; they can be added up."""
    groups, measures = SUMS[name]
    return silver.groupBy(*by, *groups).agg(
        F.count("*").alias("rows"),
        *(F.sum(m).alias(f"{m}_sum") for m in measures),
        *(F.count(m).alias(f"{m}_n") for m in measures),
        F.min(TARGET).alias("least"),
        F.max(TARGET).alias("most"),
        F.sum((F.col(TARGET) * F.col(TARGET)).cast(_SQUARE)).alias("squares"),
    )


def _added(sums: DataFrame, name: str) -> DataFrame:
    groups, measures = SUMS[name]
    kept = {f.name: f.dataType for f in sums.schema}
    return sums.groupBy(*groups).agg(
        F.sum("rows").alias("rows"),
        *(F.sum(f"{m}_sum").cast(kept[f"{m}_sum"]).alias(f"{m}_sum") for m in measures),
        *(F.sum(f"{m}_n").alias(f"{m}_n") for m in measures),
        F.min("least").alias("least"),
        F.max("most").alias("most"),
        F.sum("squares").cast(_SQUARE).alias("squares"),
    )


def _mean(measure: str, name: str) -> Column:
    mean = F.col(f"{measure}_sum") / F.nullif(f"{measure}_n", F.lit(0)).cast("decimal(20,0)")
    return round2(mean.cast("decimal(25,10)")).alias(name)


def _spread(name: str) -> Column:
    n, total = F.col(f"{TARGET}_n").cast("double"), F.col(f"{TARGET}_sum").cast("double")
    variance = F.greatest((F.col("squares").cast("double") - total * total / n) / (n - 1), F.lit(0.0))
    return F.when(n > 1, round2(F.sqrt(variance))).alias(name)


def kpis_from_sums(sums: Mapping[str, DataFrame], peak_seasons: Sequence[str] = PEAK_SEASONS) -> dict[str, DataFrame]:
    """All six KPI tables from ``partial_sums`` of any parts of Silver."""
    airline, travel_class, route, season = (_added(sums[name], name) for name in SUMS)
    fares = [_mean("base_fare_bdt", "avg_base_fare_bdt"), _mean("tax_surcharge_bdt", "avg_tax_surcharge_bdt"), _mean(TARGET, "avg_total_fare_bdt")]
    least, most = round2(F.col("least")), round2(F.col("most"))
    count, per_route = F.col("rows").alias("booking_count"), [F.col(c) for c in ROUTE]
    hours = F.col("duration_hrs_sum")
    per_hour = F.when(hours > 0, round2(F.col(f"{TARGET}_sum") / F.nullif(hours, F.lit(0)))).alias("avg_fare_per_hour")
    airline, travel_class = airline.filter(present("airline")), travel_class.filter(present("class"))
    route = route.filter(present("source", "destination")).select(
        *per_route, count, _mean(TARGET, "avg_fare_bdt"), least.alias("min_fare_bdt"), most.alias("max_fare_bdt"),
        _mean("duration_hrs", "avg_duration_hrs"), per_hour,
    )
    return {
        "gold.avg_fare_by_airline": _airlines(
            airline.select("airline", count, *fares, least.alias("min_total_fare_bdt"), most.alias("max_total_fare_bdt"))
        ),
        "gold.avg_fare_by_class": _classes(
            travel_class.select("class", count, *fares, least.alias("min_fare_bdt"), most.alias("max_fare_bdt"), _spread("fare_stddev"))
        ),
        "gold.avg_fare_by_route": _routes(route),
        "gold.booking_count_by_airline": _counts(airline.select("airline", F.col("rows").alias("total_bookings"))),
        "gold.seasonal_fare_variation": _seasons(
            season.select(
                "seasonality", count, *fares, least.alias("min_total_fare_bdt"), most.alias("max_total_fare_bdt"),
                _spread("stddev_total_fare_bdt"), F.col(f"{TARGET}_sum").alias("_sum"), F.col(f"{TARGET}_n").alias("_fares"),
            ),
            peak_seasons,
        ),
        "gold.top_routes": _busiest(route.drop("avg_duration_hrs", "avg_fare_per_hour"), 50),
    }


def ml_features(silver: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Leakage-free model input; ``carry`` keeps further columns (such as the key) alongside."""
    return silver.filter((F.col(TARGET) > 0) & present("airline", "source", "destination")).select(
        *carry,
        *CATEGORICAL_FEATURES,
        "duration_hrs",
        "days_before_departure",
        *departure_parts(F.col("departure_datetime")),
        TARGET,
    )


KPI_MODELS = {
    "gold.avg_fare_by_airline": avg_fare_by_airline,
    "gold.avg_fare_by_class": avg_fare_by_class,
    "gold.avg_fare_by_route": avg_fare_by_route,
    "gold.booking_count_by_airline": booking_count_by_airline,
    "gold.seasonal_fare_variation": seasonal_fare_variation,
    "gold.top_routes": top_routes,
}


def build_kpis(silver: DataFrame, now: datetime, peak_seasons: Sequence[str] = PEAK_SEASONS) -> dict[str, DataFrame]:
    """All six KPI tables, stamped with the batch time."""
    stamp = F.lit(now).cast("timestamp")
    models = KPI_MODELS | {"gold.seasonal_fare_variation": partial(seasonal_fare_variation, peak_seasons=peak_seasons)}
    return {name: model(silver).withColumn("calculated_at", stamp) for name, model in models.items()}
