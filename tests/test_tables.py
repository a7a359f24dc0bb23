import csv
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from farelake.operators.quality import QualityError
from farelake.plans import training
from farelake.plans.refresh import refresh
from farelake.plans.silver import refresh_silver
from farelake.schema import BRONZE_TABLE, CSV_COLUMNS, FEATURE_TABLE, KEY, KPI_TABLES, SILVER_TABLE
from farelake.operators.merge import merge_by_key
from farelake.session import materialise, shared_root
from farelake.sources.tables import bucket_count, catalog_frames, drop_superseded, layer_counts, publish, read_layer
from tests.frames import rows


@pytest.fixture
def clean_catalog(spark):
    def drop():
        for t in (BRONZE_TABLE, SILVER_TABLE, FEATURE_TABLE, *KPI_TABLES, "bronze.t", "bronze.u"):
            if spark.catalog.databaseExists(t.split(".")[0]):
                spark.sql(f"DROP TABLE IF EXISTS {t}")

    drop()
    yield
    drop()


def write_bookings(path, n, fare=100, airline="Air"):
    with open(path, "w", newline="") as f:
        out = csv.writer(f)
        out.writerow(CSV_COLUMNS)
        for i in range(n):
            out.writerow([
                airline, "AAA", "Alpha", "BBB", "Beta", f"2024-03-{1 + i % 28:02d} {i % 24:02d}:{i // 28:02d}:00",
                "2024-03-03 12:00:00", 1 + i % 9, "Direct", "Jet", ["Economy", "Business"][i % 2], "Web",
                fare, 10, fare + 10 + i, "Eid", i % 50,
            ])


def test_publish_may_read_the_table_it_replaces(spark, tmp_path, clean_catalog):
    publish(spark.range(3), "bronze.t", str(tmp_path))
    publish(spark.table("bronze.t").selectExpr("id + 1 AS id"), "bronze.t", str(tmp_path))
    assert rows(spark.table("bronze.t"), "id") == [(1,), (2,), (3,)]
    assert read_layer(spark, "bronze.t").count() == 3
    publish(spark.range(0), "bronze.t", str(tmp_path))
    assert read_layer(spark, "bronze.t") is None and read_layer(spark, "bronze.none") is None
    counts = layer_counts(catalog_frames(spark, ["bronze.t", "bronze.none"]), spark)
    assert rows(counts, "table_name", "row_count") == [("bronze.none", -1), ("bronze.t", 0)]


@pytest.mark.parametrize("before, after", [(4, 8), (8, 0), (0, 4), (4, None)])
def test_changed_buckets_and_columns_keep_all_rows(spark, tmp_path, clean_catalog, before, after):
    keys = spark.range(1000).select(F.col("id").cast("string").alias("k"))
    publish(keys, "bronze.t", str(tmp_path), "k", before)
    assert bucket_count(spark, "bronze.t") == before
    stored = publish(spark.table("bronze.t").withColumn("more", F.lit(1)), "bronze.t", str(tmp_path), "k", after)
    assert bucket_count(spark, "bronze.t") == (before if after is None else after)
    assert stored.columns == ["k", "more"] and stored.groupBy("k").count().count() == 1000
    delta = stored.filter("k < '5'").withColumn("more", F.lit(2))
    merged = publish(merge_by_key(stored, delta, "k"), "bronze.t", str(tmp_path), "k", after, clustered=True)
    assert merged.groupBy("k").count().filter("count = 1").count() == 1000
    assert merged.filter("more = 2").count() == keys.filter("k < '5'").count()
    assert drop_superseded(spark, "bronze.t", str(tmp_path)) == 2 and spark.table("bronze.t").count() == 1000
    assert drop_superseded(spark, "bronze.t", str(tmp_path)) == 0


def test_one_file_per_bucket_from_a_scan_of_larger_files(spark, tmp_path, clean_catalog):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        rows = spark.range(20_000).select(F.sha2(F.col("id").cast("string"), 256).alias("k"))
        source = publish(rows, "bronze.t", str(tmp_path), "k", 4)
        copy = publish(source.withColumn("more", F.lit(0)), "bronze.u", str(tmp_path), "k", 4, clustered=False)
        assert len(copy.inputFiles()) == 4 and copy.count() == 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_large_buckets_are_written_and_read_by_several_tasks(spark, tmp_path, clean_catalog, monkeypatch):
    monkeypatch.setattr("farelake.sources.tables.ROWS_PER_BUCKET", 1000)
    own = {"spark.sql.shuffle.partitions": "16", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {name: spark.conf.get(name) for name in own}
    for name, value in own.items():
        spark.conf.set(name, value)
    try:
        keys = spark.range(20_000).select(F.expr("IF(id = 7, NULL, sha2(CAST(id AS STRING), 256))").alias("k"))
        first = publish(keys, "bronze.t", str(tmp_path), "k", 4)
        second = publish(spark.table("bronze.t").withColumn("more", F.lit(1)), "bronze.t", str(tmp_path), "k", 8)
        for stored, buckets in ((first, 4), (second, 8)):
            files = stored.groupBy(F.input_file_name().alias("f")).agg(F.count("*").alias("n"), F.count_distinct(F.expr(f"pmod(hash(k), {buckets})")).alias("b")).collect()
            assert len(files) == 16 and max(r.n for r in files) < 2000 and {r.b for r in files} == {1}
        delta = second.filter("k < '5'").withColumn("more", F.lit(2))
        merged = publish(merge_by_key(second, delta, "k"), "bronze.t", str(tmp_path), "k", 8, clustered=True)
        assert len(merged.inputFiles()) == 16 and bucket_count(spark, "bronze.t") == 8
        # By its buckets and without them: the same rows.
        for table in (merged, spark.table("bronze.t")):
            counts = table.groupBy("k").agg(F.count("*").alias("n"), F.max("more").alias("more")).groupBy("n", "more").count()
            assert sorted(tuple(r) for r in counts.collect()) == [(1, 1, 20_000 - delta.count()), (1, 2, delta.count())]
        assert drop_superseded(spark, "bronze.t", str(tmp_path)) == 2 and merged.count() == 20_000
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_stages_lie_in_the_shared_folder_and_can_be_cleared(spark):
    stage = materialise(spark.range(5))
    assert stage.inputFiles()[0].split(":", 1)[-1].lstrip("/").startswith(shared_root(spark).split(":", 1)[-1].lstrip("/"))
    assert spark.sparkContext.applicationId in stage.inputFiles()[0]


def test_refresh_twice(spark, tmp_path, clean_catalog):
    data, root = tmp_path / "in", str(tmp_path / "out")
    data.mkdir()
    write_bookings(data / "Flight_Price_1.csv", 60)
    reports = refresh(spark, str(data), root, datetime(2024, 6, 1), buckets=4)
    assert reports["checks"].filter("not passed").isEmpty() and reports["silver_gate"].first().drop_pct == 0
    first = {r[KEY]: r for r in spark.table(SILVER_TABLE).collect()}
    assert len(first) == 60

    write_bookings(data / "Flight_Price_1.csv", 60, fare=200)
    write_bookings(data / "Flight_Price_2.csv", 20, airline="New")
    refresh(spark, str(data), root, datetime(2024, 6, 2), buckets=4)
    bronze, silver = spark.table(BRONZE_TABLE), spark.table(SILVER_TABLE)
    assert (bronze.count(), silver.count()) == (80, 80)
    assert bronze.select("id").distinct().count() == 80
    second = {r[KEY]: r for r in silver.collect()}
    for k, r in first.items():
        assert second[k].base_fare_bdt == 200 and second[k].id == r.id and second[k].created_at == r.created_at
    shares = {r.airline: r.market_share_pct for r in spark.table("gold.booking_count_by_airline").collect()}
    assert shares == {"Air": 75, "New": 25}
    assert training.load_data(spark).count() == 80
    assert training.load_data(spark, "postgres").columns == spark.table(FEATURE_TABLE).columns
    spark.sql(f"DROP TABLE {FEATURE_TABLE}")
    with pytest.raises(LookupError):
        training.load_data(spark, "postgres")
    assert "departure_weekday" in training.load_data(spark).columns  # falls back to Silver

    # One file per bucket, also where nothing was shuffled for the write.
    for table in (BRONZE_TABLE, SILVER_TABLE):
        assert len(spark.table(table).inputFiles()) == 4, table

    # Both layers are bucketed by the key: the merge joins them without a shuffle of either.
    plan = refresh_silver(bronze, silver, datetime(2024, 6, 3))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan or "ShuffledHashJoin" in plan
    assert "Exchange" not in plan, plan


def test_failed_check_raises(spark, tmp_path, clean_catalog):
    data = tmp_path / "in"
    data.mkdir()
    write_bookings(data / "Flight_Price_1.csv", 5)
    text = (data / "Flight_Price_1.csv").read_text().replace("Business", "Cargo")
    (data / "Flight_Price_1.csv").write_text(text)
    with pytest.raises(QualityError, match="class accepted_values"):
        refresh(spark, str(data), str(tmp_path / "out"), datetime(2024, 6, 1))
    assert refresh(spark, str(data), str(tmp_path / "out"), datetime(2024, 6, 2), check=False)["checks"].count() == 34


def test_load_data_rejects_unknown_sources_and_empty_hands(spark, tmp_path, clean_catalog):
    with pytest.raises(ValueError):
        training.load_data(spark, "ftp")
    with pytest.raises(LookupError):
        training.load_data(spark, "auto", str(tmp_path))
