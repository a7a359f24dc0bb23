from decimal import Decimal as D

from farelake.plans import gold
from farelake.plans.silver import to_silver
from tests.frames import T0, bronze, rows


def silver(spark, *data):
    return to_silver(bronze(spark, *data))


def test_silver_cleans_text_fares_and_nulls(spark):
    df = silver(
        spark,
        {"airline": "  Air ", "total_fare_bdt": -1, "duration_hrs": None, "days_before_departure": None,
         "departure_datetime": "", "arrival_datetime": "soon"},
        {"airline": "\tAir", "total_fare_bdt": None},
    )
    got = rows(df, "airline", "total_fare_bdt", "duration_hrs", "duration_bucket", "booking_lead_bucket",
               "departure_datetime", "arrival_datetime")
    assert got[0][:5] == ("Air", D("0.000000"), D("0.0000"), "Short (0-3h)", "Last Minute (0-3 days)")
    assert got[0][5:] == (None, None)
    assert got[1][0] == "\tAir"  # Silver trims spaces only
    assert df.schema["total_fare_bdt"].dataType.simpleString() == "decimal(15,6)"
    assert len(df.columns) == 23 and len(to_silver(bronze(spark, {}), T0).columns) == 24


def test_averages_round_half_up(spark):
    df = silver(spark, {"total_fare_bdt": "0.01"}, {"total_fare_bdt": "0.02"}, {"airline": ""}, {"airline": None})
    assert rows(gold.avg_fare_by_airline(df), "airline", "booking_count", "avg_total_fare_bdt") == [("Air", 2, D("0.02"))]


def test_single_booking_has_no_deviation(spark):
    df = silver(spark, {"class": "First Class"}, {"class": "Economy"}, {"class": "Economy"}, {"class": " "})
    assert rows(gold.avg_fare_by_class(df), "class", "class_share_pct", "fare_stddev") == [
        ("Economy", D("66.67"), D("0.00")), ("First Class", D("33.33"), None),
    ]


def test_routes_keep_names_apart_and_compare_with_mean_of_means(spark):
    df = silver(
        spark,
        {"total_fare_bdt": 100, "duration_hrs": 0},
        {"total_fare_bdt": 300, "source_name": "Alfa", "duration_hrs": 3},
        {"total_fare_bdt": 300, "source_name": "Alfa", "duration_hrs": 1},
        {"total_fare_bdt": 500, "source_name": None},
        {"source": ""},
    )
    got = rows(gold.avg_fare_by_route(df), "route", "route_full", "booking_count", "avg_fare_per_hour", "fare_vs_avg_pct")
    assert got == [
        ("AAA → BBB", "Alfa → Beta", 2, D("150.00"), D("0.00")),
        ("AAA → BBB", "Alpha → Beta", 1, None, D("-66.67")),
        ("AAA → BBB", None, 1, D("250.00"), D("66.67")),
    ]


def test_seasons_compare_with_all_rows(spark):
    df = silver(
        spark,
        {"seasonality": "Winter", "total_fare_bdt": 100},
        {"seasonality": "Winter Holidays", "total_fare_bdt": 200},
        {"seasonality": "", "total_fare_bdt": 600},
        {"seasonality": None, "total_fare_bdt": 300},
    )
    got = rows(gold.seasonal_fare_variation(df), "seasonality", "overall_avg_fare", "fare_diff_from_avg",
               "fare_pct_diff_from_avg", "season_type")
    assert got == [
        ("Winter Holidays", D("300.00"), D("-100.00"), D("-33.33"), "Non-Peak"),
        ("Winter", D("300.00"), D("-200.00"), D("-66.67"), "Peak"),
    ]
    own = gold.seasonal_fare_variation(df, ["Winter Holidays"])
    assert rows(own, "season_type") == [("Non-Peak",), ("Peak",)]


def test_market_share_sums_to_hundred(spark):
    df = silver(spark, *({"airline": f"A{i % 3}"} for i in range(8)), {"airline": ""})
    got = rows(gold.booking_count_by_airline(df), "airline", "total_bookings", "market_share_pct")
    assert got == [("A0", 3, D("37.50")), ("A1", 3, D("37.50")), ("A2", 2, D("25.00"))]


def test_top_routes_cut_is_repeatable(spark):
    df = silver(spark, *({"source": f"S{i:03d}"} for i in range(60)))
    want = [f"S{i:03d}" for i in range(50)]
    for partitions in (1, 5):
        assert [r.source for r in gold.top_routes(df.repartition(partitions)).collect()] == want


def test_features_drop_unpaid_and_unnamed(spark):
    df = silver(spark, {}, {"total_fare_bdt": 0}, {"airline": ""}, {"source": None}, {"departure_datetime": ""})
    got = rows(gold.ml_features(df), "departure_month", "departure_weekday", "departure_hour", "total_fare_bdt")
    assert got == [(3, 0, 10, D("110.000000")), (None, None, None, D("110.000000"))]
    assert len(gold.ml_features(df).columns) == 16


def test_kpis_carry_the_batch_time(spark):
    for name, df in gold.build_kpis(silver(spark, {}), T0).items():
        assert df.columns[-1] == "calculated_at" and df.first()[-1] == T0, name
