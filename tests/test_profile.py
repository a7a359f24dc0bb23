import random

import numpy as np
import pandas as pd
import pytest

from farelake.operators import profile
from farelake.operators.quantiles import approx_group_quantiles, group_quantiles


def groups(seed=1):
    rng = random.Random(seed)
    data = {
        "hot": [rng.lognormvariate(8, 2) for _ in range(3000)],
        "ties": [rng.choice([1.0, 1.0, 1.0, 2.0, 5.0]) for _ in range(500)],
        "constant": [7.0] * 40,
        "single": [3.5],
        "pair": [1.0, 2.0],
        "outlier": [1e12, *(float(i) for i in range(200))],
    }
    return [(k, v) for k, vs in data.items() for v in vs]


PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]


@pytest.mark.parametrize("accuracy", [10_000, 20])
def test_group_quantiles_are_exact(spark, accuracy):
    data = groups() + [("hot", None), ("empty", None)]
    df = spark.createDataFrame(data, "g string, x double").repartition(5)
    got = {(r.g, r.prob): r.value for r in group_quantiles(df, ["g"], "x", PROBS, accuracy).collect()}
    frame = pd.DataFrame(groups(), columns=["g", "x"])
    for g, part in frame.groupby("g"):
        for p in PROBS:
            assert got.pop((g, p)) == pytest.approx(np.quantile(part.x, p), rel=1e-12), (g, p)
    assert not got


def test_ungrouped_quantiles(spark):
    df = spark.range(1, 102).selectExpr("CAST(id AS DECIMAL(15,6)) x")
    got = {r.prob: r.value for r in group_quantiles(df, [], "x", [0.25, 0.5]).collect()}
    assert got == {0.25: 26.0, 0.5: 51.0}


def test_approximate_quantiles(spark):
    df = spark.range(1, 1002).selectExpr("'a' g", "id x")
    got = {r.prob: r.value for r in approx_group_quantiles(df, ["g"], "x", [0.25, 0.5], 1000).collect()}
    assert abs(got[0.5] - 501) <= 2 and abs(got[0.25] - 251) <= 2


def test_histogram_equals_numpy(spark):
    values = [random.Random(5).uniform(-3, 9) for _ in range(1000)] + [9.5, -3.5]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "x double")
    got = sorted(profile.histogram(df, "x").collect())
    counts, edges = np.histogram(values, bins=50)
    assert [r.rows for r in got] == list(counts)
    assert [r.lower for r in got] == pytest.approx(edges[:-1]) and got[-1].upper == pytest.approx(edges[-1])


def test_histogram_of_a_constant_and_of_nothing(spark):
    got = profile.histogram(spark.range(4).selectExpr("5.0D x"), "x", 10).collect()
    assert sum(r.rows for r in got) == 4 and min(r.lower for r in got) == 4.5
    assert profile.histogram(spark.range(0).selectExpr("5.0D x"), "x").count() == 0


def test_box_stats(spark):
    df = spark.createDataFrame([*groups(), (None, 1.0)], "g string, x double")
    frame = pd.DataFrame(groups(), columns=["g", "x"])
    got = profile.box_stats(df, "g", "x").collect()
    medians = frame.groupby("g").x.median()
    assert [r.median for r in got] == sorted(medians, reverse=True)
    for r in got:
        x = frame[frame.g == r.g].x
        q1, q3 = np.quantile(x, [0.25, 0.75])
        reach = 1.5 * (q3 - q1)
        assert (r.n, r.q1, r.q3) == (len(x), pytest.approx(q1), pytest.approx(q3))
        assert r.whisker_low == pytest.approx(min(x[x >= q1 - reach].min(), q1))
        assert r.whisker_high == pytest.approx(max(x[x <= q3 + reach].max(), q3))
    assert len(profile.box_stats(df, "g", "x", exact=False).collect()) == len(got)


def test_correlation_uses_complete_pairs(spark):
    rng = np.random.default_rng(2)
    frame = pd.DataFrame(rng.normal(size=(200, 2)), columns=["a", "b"])
    frame["c"] = frame.a * 2 + rng.normal(size=200)
    frame.loc[::7, "b"] = np.nan
    data = [tuple(None if pd.isna(v) else float(v) for v in r) + (1.0, "t") for r in frame.itertuples(index=False)]
    df = spark.createDataFrame(data, "a double, b double, c double, constant double, t string")
    got = {(r.column_a, r.column_b): r.correlation for r in profile.correlation_matrix(df).collect()}
    want = frame.corr()
    assert len(got) == 6
    for pair in (("b", "a"), ("c", "a"), ("c", "b")):
        assert got[pair] == pytest.approx(want.loc[pair], rel=1e-9)
    assert got["constant", "a"] is None
    with pytest.raises(ValueError):
        profile.correlation_matrix(df.select("a", "t"))


def test_describe(spark):
    frame = pd.DataFrame({"a": [1.0, 2.0, 4.0, None], "b": [3.0, 3.0, 3.0, 9.0]})
    df = spark.createDataFrame([(1.0, 3.0), (2.0, 3.0), (4.0, 3.0), (None, 9.0)], "a double, b double")
    want = frame.describe().T
    for r in profile.describe(df).collect():
        assert list(r)[1:] == pytest.approx(list(want.loc[r.column_name]))


def test_missing_means_and_tops(spark):
    df = spark.createDataFrame(
        [("a", "x", 1.0), ("a", "y", 3.0), ("b", "x", 9.0), (None, "x", 5.0), ("c", None, None)],
        "g string, h string, v double",
    )
    assert {tuple(r) for r in profile.missing_values(df).collect()} == {("g", 1), ("h", 1), ("v", 1)}
    assert [tuple(r) for r in profile.mean_by(df, "g", "v").collect()] == [("b", 9.0, 1), ("a", 2.0, 2), ("c", None, 0)]
    assert [tuple(r) for r in profile.largest_groups(df, ["h"], 1).collect()] == [("x", 3)]
    assert [tuple(r) for r in profile.highest_means(df, ["g", "h"], "v", 2).collect()] == [("b", "x", 9.0), ("a", "y", 3.0)]
    assert profile.mean_by(df, "g", "v", spread=True).first().std is None
    assert profile.column_types(df).collect()[2][1:] == ("v", "double")
    assert tuple(profile.centre(df, "v").first()) == (4.5, 4.0)


def test_shape(spark):
    assert profile.shape(spark.range(7).selectExpr("id", "id AS b")).first() == (7, 2)
    assert profile.shape(spark.range(0)).first() == (0, 1)
