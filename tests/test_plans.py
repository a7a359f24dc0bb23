"""Physical plans: what is read, pushed down, shuffled and broadcast."""

import re

import pytest
from pyspark.sql import functions as F

from checks.bookings import bookings
from farelake.operators import profile, quality
from farelake.operators.merge import first_and_last, merge_by_key, put
from farelake.plans import gold
from farelake.plans.silver import to_silver
from farelake.schema import FARE_COLUMNS, KEY
from farelake.session import materialise


def plan(df) -> str:
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    df.sparkSession.conf.set("spark.sql.debug.maxToStringFields", 1000)
    return df._jdf.queryExecution().executedPlan().toString()


def read_columns(df) -> list[list[str]]:
    """Columns of each scan."""
    return [re.findall(r"(\w+):", schema) for schema in re.findall(r"ReadSchema: struct<([^>]*)>", plan(df))]


@pytest.fixture(scope="module")
def silver(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("silver") / "t")
    to_silver(bookings(spark, sf_dir)).write.parquet(path)
    return spark.read.parquet(path)


WITH_TOTALS = (gold.avg_fare_by_class, gold.booking_count_by_airline, gold.seasonal_fare_variation, gold.avg_fare_by_route)


@pytest.mark.parametrize("model", gold.KPI_MODELS.values())
def test_kpis_scan_silver_once_and_aggregate_before_the_shuffle(silver, model):
    df = model(silver)
    text = plan(df)
    assert len(read_columns(df)) == 1  # a figure over all groups comes from the groups
    assert "partial_count" in text and "BatchEvalPython" not in text and "Broadcast" not in text
    assert all(len(columns) <= 6 for columns in read_columns(df))


@pytest.mark.parametrize("model", WITH_TOTALS)
def test_groups_are_not_brought_to_one_task(silver, model):
    text = plan(model(silver))
    # Groups are dealt out to slots, to each of which the figure over all of them is sent.
    assert "SinglePartition" not in text
    assert re.findall(r"Exchange hashpartitioning\(_slot#\d+", text) and text.count("FileScan") == 1
    assert all("_slot#" in spec for spec in re.findall(r"Window \[.*windowspecdefinition\(([^,]*)", text))


def test_box_rows_are_not_joined_by_group_alone(spark, silver):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(profile.box_stats(silver, "airline", "total_fare_bdt"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert re.search(r"Exchange hashpartitioning\(airline#\d+, _part#\d+", text)


def test_filters_reach_the_scan(silver):
    text = plan(gold.ml_features(silver))
    pushed = re.search(r"PushedFilters: \[([^\]]*)\]", text).group(1)
    assert "GreaterThan(total_fare_bdt" in pushed and "IsNotNull(airline)" in pushed
    assert "Exchange" not in text


def test_incremental_filter_reaches_the_scan(silver):
    from farelake.operators.merge import newer_than

    text = plan(newer_than(silver, silver.filter("updated_at < '1998-01-01'"), "updated_at"))
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThan\(updated_at,1997", text)


def test_upsert_combines_keys_before_the_shuffle(silver):
    text = plan(first_and_last(silver, KEY, FARE_COLUMNS, ["id"]))
    assert "partial_min" in text and "Window" not in text
    assert text.count("Exchange") == 1


def test_null_counts_and_correlations_take_one_pass(silver):
    for df in (quality.null_counts(silver, silver.columns), profile.correlation_matrix(silver), profile.missing_values(silver)):
        assert plan(df).count("FileScan") == 1


def test_bookings_join_only_what_their_columns_need(spark, sf_dir):
    assert plan(bookings(spark, sf_dir, "duration_hrs")).count("FileScan") == 1
    assert plan(bookings(spark, sf_dir, "airline")).count("FileScan") == 2
    assert plan(bookings(spark, sf_dir)).count("FileScan") == 7


def test_results_do_not_depend_on_partitioning(silver):
    for model in gold.KPI_MODELS.values():
        want = model(silver).collect()
        assert model(silver.repartition(13)).collect() == want, model


def test_hot_group_is_counted_before_the_shuffle(spark):
    hot = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("v"))
    assert [tuple(r) for r in quality.duplicate_values(hot, "v").collect()] == [("hot", 10_000)]
    assert "partial_count" in plan(quality.duplicate_values(hot, "v"))


def test_stages_by_key_are_joined_without_a_shuffle(spark, sf_dir):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        feed = bookings(spark, sf_dir)
        old = materialise(first_and_last(feed, KEY, FARE_COLUMNS, ["id"]), KEY)
        new = materialise(put(old, old.filter("stopovers = 'Direct'"), KEY, FARE_COLUMNS), KEY)
        merged = merge_by_key(old, new, KEY)
        text = plan(merged)
        assert "SortMergeJoin" in text and "Exchange" not in text
        assert sorted(merged.collect(), key=repr) == sorted(old.collect(), key=repr)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
