import pytest

from farelake.operators import quality
from farelake.plans import gold
from farelake.plans.silver import to_silver
from farelake.schema import BRONZE_TABLE, FEATURE_TABLE, KEY, SILVER_TABLE
from tests.frames import bronze, rows


def test_suite_holds_all_tests():
    kinds = [c.test for c in quality.SUITE]
    assert (kinds.count("unique"), kinds.count("not_null"), kinds.count("accepted_values")) == (7, 22, 5)
    layers = [c.table.split(".")[0] for c in quality.SUITE]
    assert (layers.count("bronze"), layers.count("silver"), layers.count("gold")) == (5, 15, 14)


def test_accepted_values_pass_null(spark):
    df = bronze(spark, {"class": "First"}, {"class": None}, {"class": "Economy"})
    assert rows(quality.unexpected_values(df, "class", ["Economy"]), "value", "rows") == [("First", 1)]


def test_unique_ignores_null(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,), (None,)], "v string")
    assert rows(quality.duplicate_values(df, "v"), "value", "copies") == [("a", 2)]


def test_run_checks(spark):
    feed = bronze(
        spark, {KEY: "a"}, {KEY: "a", "class": "First"}, {KEY: "b", "airline": None, "departure_datetime": ""}
    )
    clean = to_silver(feed)
    tables = {BRONZE_TABLE: feed, SILVER_TABLE: clean, FEATURE_TABLE: gold.ml_features(clean)}
    tables |= {n: m(clean) for n, m in gold.KPI_MODELS.items()}
    report = quality.run_checks(tables)
    assert report.count() == 34
    assert rows(report.filter("not passed"), "table_name", "column_name", "test", "failures") == [
        (BRONZE_TABLE, "airline", "not_null", 1),
        (BRONZE_TABLE, KEY, "unique", 1),
        (SILVER_TABLE, "airline", "not_null", 1),
        (SILVER_TABLE, KEY, "unique", 1),
        (SILVER_TABLE, "class", "accepted_values", 1),
        (SILVER_TABLE, "departure_datetime", "not_null", 1),
    ]
    with pytest.raises(quality.QualityError, match="accepted_values"):
        quality.enforce(report)


def test_bronze_gate(spark):
    feed = bronze(
        spark, {KEY: "a", "airline": ""}, {KEY: "a", "source": None, "base_fare_bdt": -1}, {"total_fare_bdt": None}
    )
    got = {r.check: (r.severity, r.failures, r.passed) for r in quality.bronze_gate(feed).collect()}
    assert got == {
        "rows": ("error", 0, True),
        "null_or_blank:airline": ("warn", 1, False),
        "null_or_blank:source": ("warn", 1, False),
        "null_or_blank:destination": ("warn", 0, True),
        f"null_or_blank:{KEY}": ("warn", 0, True),
        "negative_fare": ("warn", 1, False),
        "repeated_key": ("warn", 1, False),
    }
    quality.enforce(quality.bronze_gate(feed))
    with pytest.raises(quality.QualityError, match="rows"):
        quality.enforce(quality.bronze_gate(feed.filter("false")))


@pytest.mark.parametrize(
    ("bronze_rows", "silver_rows", "drop", "verdict"),
    [(3, 3, 0.0, "passed"), (3, 1, 66.7, "warning"), (2, 1, 50.0, "passed"), (3, 0, 100.0, "failed"), (0, 1, None, "passed")],
)
def test_silver_gate(spark, bronze_rows, silver_rows, drop, verdict):
    got = quality.silver_gate(spark.range(bronze_rows), spark.range(silver_rows)).first()
    assert (got.bronze_rows, got.silver_rows, got.verdict) == (bronze_rows, silver_rows, verdict)
    assert (None if got.drop_pct is None else float(got.drop_pct)) == drop


def test_gold_gate(spark):
    report = quality.gold_gate(spark, {"gold.top_routes": spark.range(2)})
    got = {r.table_name: (r.row_count, r.severity, r.passed) for r in report.collect()}
    assert got[FEATURE_TABLE] == (-1, "error", False)
    assert got["gold.top_routes"] == (2, "info", True)
    assert got["gold.avg_fare_by_class"] == (-1, "info", True)
    with pytest.raises(quality.QualityError):
        quality.enforce(report)
