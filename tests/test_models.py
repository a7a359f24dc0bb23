import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression
from pyspark.sql import functions as F

from farelake.operators import features, regression
from farelake.plans import gold, training
from farelake.plans.silver import to_silver
from farelake.schema import KEY
from tests.frames import bronze, rows


def matrix(n=300, p=4, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p)) * [1, 5, 0.3, 2][:p]
    return x, x @ np.array([3.0, -1.0, 10.0, 0.0])[:p] + 50 + rng.normal(size=n)


def frame(spark, x, y):
    data = [([float(v) for v in r], float(t), i % 3) for i, (r, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(data, "x array<double>, label double, fold int")
    return df.select(array_to_vector("x").alias("features"), "label", "fold")


@pytest.mark.parametrize("alpha", [0.1, 10.0, 100.0])
def test_ridge_has_the_closed_form(spark, alpha):
    x, y = matrix()
    xc, yc = x - x.mean(0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + alpha * np.eye(4), xc.T @ yc)
    model = regression.PenalisedRegression(penalty="ridge", alpha=alpha).fit(frame(spark, x, y))
    assert model.coefficients.toArray() == pytest.approx(want, rel=1e-8, abs=1e-7)  # the solver is iterative


@pytest.mark.parametrize("alpha", [0.1, 1.0])
def test_lasso_equals_coordinate_descent(spark, alpha):
    x, y = matrix()
    xc, yc, w = x - x.mean(0), y - y.mean(), np.zeros(4)
    for _ in range(2000):
        for j in range(4):
            rest = yc - xc @ w + xc[:, j] * w[j]
            rho = xc[:, j] @ rest / len(y)
            w[j] = np.sign(rho) * max(abs(rho) - alpha, 0) / (xc[:, j] @ xc[:, j] / len(y))
    model = regression.PenalisedRegression(penalty="lasso", alpha=alpha, maxIter=5000).fit(frame(spark, x, y))
    assert model.coefficients.toArray() == pytest.approx(w, abs=1e-5)


def test_metrics_equal_the_evaluator(spark):
    x, y = matrix()
    df = frame(spark, x, y)
    models = {"a": LinearRegression().fit(df), "b": LinearRegression(regParam=50.0).fit(df)}
    predictions = regression.predict_long(models, df)
    got = {r.model: r for r in regression.regression_metrics(predictions).collect()}
    for name in models:
        part = predictions.filter(F.col("model") == name)
        for metric, digits in (("r2", 6), ("mae", 2), ("rmse", 2)):
            want = RegressionEvaluator(metricName=metric).evaluate(part)
            assert got[name][metric] == pytest.approx(want, abs=10**-digits)
    assert regression.metrics_long(regression.regression_metrics(predictions)).count() == 6
    low, high = regression.axis_limits(predictions).first()[1:]
    assert low <= min(y) and high >= max(y)


def test_metrics_of_a_constant_target(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 1.0, 1.0), ("b", 1.0, 2.0)], "model string, label double, prediction double")
    assert rows(regression.regression_metrics(df), "model", "r2") == [("a", 1.0), ("b", 0.0)]


def test_candidates():
    grid = regression.model_grid()
    sizes = {n: len(regression.candidates(e, g, 20, 42)) for n, (e, g) in grid.items()}
    assert sizes == {"Linear Regression": 1, "Ridge": 5, "Lasso": 5, "Decision Tree": 15, "Random Forest": 20, "Gradient Boosting": 20}
    estimator, values = grid["Gradient Boosting"]
    drawn = regression.candidates(estimator, values, 20, 42)
    assert drawn == regression.candidates(estimator, values, 20, 42)
    assert len({tuple(sorted((p.name, v) for p, v in d.items())) for d in drawn}) == 20


def test_tuning_picks_the_weaker_penalty(spark):
    x, y = matrix()
    grid = {"Ridge": (regression.PenalisedRegression(penalty="ridge"), {"alpha": [0.01, 1e6]})}
    models, scores = regression.tune(frame(spark, x, y), grid, folds=3)
    name, mean, std = scores.first()
    assert name == "Ridge" and mean > 0.9 and 0 <= std < 0.1
    want = regression.PenalisedRegression(penalty="ridge", alpha=0.01).fit(frame(spark, x, y))
    assert models["Ridge"].coefficients.toArray() == pytest.approx(want.coefficients.toArray())


def test_comparison_is_ordered_and_ties_keep_model_order(spark):
    metrics = spark.createDataFrame([("x", 0.5, 1.0, 1.0), ("y", 0.9, 1.0, 1.0), ("z", 0.9, 1.0, 1.0)], "model string, r2 double, mae double, rmse double")
    cv = spark.createDataFrame([("y", 0.1, 0.0)], "model string, cv_mean_r2 double, cv_std_r2 double")
    got = regression.compare_models(metrics, cv, ["z", "y", "x"]).collect()
    assert [(r.model, r.cv_mean_r2) for r in got] == [("z", None), ("y", 0.1), ("x", None)]


def bookings(spark, n=120):
    return bronze(
        spark,
        *(
            {
                KEY: f"k{i}", "airline": f"A{i % 3}", "class": ["Economy", "Business"][i % 2], "duration_hrs": 1 + i % 8,
                "days_before_departure": i % 40, "total_fare_bdt": 100 + 50 * (i % 3) + 400 * (i % 2) + i % 8,
                "departure_datetime": f"2024-0{1 + i % 9}-0{1 + i % 7} {i % 24:02d}:00:00",
                "stopovers": None if i % 10 == 0 else "Direct", "seasonality": "" if i % 10 == 1 else "Eid",
            }
            for i in range(n)
        ),
    )


def test_encoding_unseen_and_missing_levels_give_zeros(spark):
    train = gold.ml_features(to_silver(bookings(spark)))
    fitted = features.feature_pipeline().fit(train)
    encoded = fitted.transform(train)
    names = features.feature_names(encoded)
    assert names[:5] == list(features.NUMERIC_FEATURES)
    assert {"airline_A0", "airline_A1", "airline_A2", "class_Business", "seasonality_(blank)"} <= set(names)
    assert sum(n.startswith("stopovers_") for n in names) == 1
    strange = train.limit(1).withColumns({"airline": F.lit("unseen"), "class": F.lit(None).cast("string")})
    vector = fitted.transform(strange).first().features
    off = {n for n, v in zip(names, vector.toArray()) if v == 0}
    assert {"airline_A0", "airline_A1", "airline_A2", "class_Business", "class_Economy"} <= off
    assert len(vector) == len(names)


def test_scaling(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (None, 5.0)], "a double, b double")
    got = rows(features.scale(df, features.scaling_stats(df, ["a", "b"])), "a", "b")
    assert got == [(-1.0, 0.0), (0.0, 0.0), (1.0, 0.0)]


def test_split_is_repeatable_and_complete(spark):
    df = spark.range(2000).selectExpr("CAST(id AS STRING) k")
    train, test = features.hash_split(df, ["k"])
    again, _ = features.hash_split(df.repartition(9), ["k"])
    assert rows(train, "k") == rows(again, "k")
    assert train.count() + test.count() == 2000 and 340 < test.count() < 460
    other, _ = features.hash_split(df, ["k"], seed=7)
    assert rows(train, "k") != rows(other, "k")


def test_engineered_features(spark):
    df = bronze(spark, {"duration_hrs": 0, "departure_datetime": "bad"}, {"total_fare_bdt": 0}, {"total_fare_bdt": None})
    got = features.engineer_features(df)
    assert rows(got, "duration_bucket", "departure_weekday", "total_fare_bdt") == [("Short (0-3h)", 6, 0.0), ("nan", None, 110.0)]
    assert not {"id", "base_fare_bdt", "departure_datetime"} & set(got.columns)


def test_missing_target_is_an_error(spark):
    with pytest.raises(ValueError, match="target"):
        features.prepare(spark.range(1))


def test_training_run_store_and_score(spark, tmp_path):
    silver = to_silver(bookings(spark))
    grid = {
        "Linear Regression": (regression.least_squares(), {}),
        "Decision Tree": (DecisionTreeRegressor(seed=42), {"maxDepth": [3, 5]}),
    }
    rows_in = gold.ml_features(silver, carry=[KEY])
    comparison, models, encoder, predictions = training.train_run(rows_in, grid, [KEY], folds=2)
    best = comparison.first()
    assert comparison.count() == 2 and best.r2 > 0.9 and best.cv_mean_r2 > 0.5
    regression.write_metrics(comparison, f"{tmp_path}/metrics")
    assert spark.read.csv(f"{tmp_path}/metrics", header=True).columns == ["model", "r2", "mae", "rmse", "cv_mean_r2", "cv_std_r2"]

    path = f"{tmp_path}/best"
    assert training.save_best(comparison, models, encoder, path) == best.model
    model, about = training.load_model(spark, path)
    assert about.model == best.model and about.r2 == best.r2 and "airline_A0" in about.feature_names
    before = models[best.model].transform(encoder.transform(features.prepare(gold.ml_features(silver))))
    scored = training.score(model, silver)
    assert scored.columns[-2:] == ["predicted_fare_bdt", "predicted_fare_usd"]
    want = sorted(r.prediction for r in before.collect())
    assert sorted(r.predicted_fare_bdt for r in scored.collect()) == pytest.approx(want)
    usd = scored.first()
    assert usd.predicted_fare_usd == pytest.approx(usd.predicted_fare_bdt / 120, abs=0.01)

    top = regression.feature_importance(models["Decision Tree"], about.feature_names, 3).collect()
    assert len(top) == 3 and top[0].feature in ("class_Business", "class_Economy")
    weights = regression.feature_importance(models["Linear Regression"], about.feature_names, 5).collect()
    assert [r.importance for r in weights] == sorted((r.importance for r in weights), reverse=True)
    assert regression.residual_histogram(predictions.filter("model = 'Decision Tree'")).count() == 50
    assert regression.prediction_pairs(predictions, 0.5).count() <= predictions.count()


@pytest.mark.parametrize("rule", ["ladder", "interval"])
def test_scores_are_equal_on_any_layer(spark, rule):
    """Silver, Bronze and CSV-like forms of a booking get the same fare, odd cells included."""
    odd = bronze(
        spark,
        {KEY: "a", "duration_hrs": None, "days_before_departure": None, "departure_datetime": ""},
        {KEY: "b", "airline": "  A1 ", "departure_datetime": "soon"},
        {KEY: "c", "airline": None, "class": "unheard of"},
    )
    raw = bookings(spark).unionByName(odd)
    silver = to_silver(raw)
    learn = gold.ml_features(silver, carry=[KEY]) if rule == "ladder" else features.engineer_features(silver.withColumn("k", F.col(KEY)), "sunday")
    assert features.bucket_rule(learn) == rule
    keys = [KEY] if rule == "ladder" else ["k"]
    _, models, encoder, _ = training.train_run(learn, {"Linear Regression": (regression.least_squares(), {})}, keys, folds=2)
    fitted = PipelineModel(stages=[*encoder.stages, models["Linear Regression"]])
    text = raw.select(*(F.col(c).cast("string") for c in raw.columns))
    want = rows(training.score(fitted, silver, rule=rule), KEY, "predicted_fare_usd")
    assert len(want) == raw.count() and None not in [fare for _, fare in want]
    for form in (raw, text):
        scored = training.score(fitted, form, rule=rule)
        assert scored.columns == [*form.columns, "predicted_fare_bdt", "predicted_fare_usd"]
        assert rows(scored, KEY, "predicted_fare_usd") == want
    assert rows(training.score(fitted, text, rule=rule), "airline") == rows(text, "airline")  # as given


def test_whole_training_run_from_the_source(spark, tmp_path):
    to_silver(bookings(spark)).createOrReplaceTempView("_run_silver")
    tables = {"gold": "_run_none", "silver": "_run_silver", "bronze": "_run_none"}
    grid = {"Linear Regression": (regression.least_squares(), {})}
    reports = training.train_and_store(spark, str(tmp_path), tables=tables, grid=grid, folds=2, top_n=3)
    model, about = training.load_model(spark, str(tmp_path))
    assert about.bucket_rule == "interval" and about.model == "Linear Regression"
    assert reports["importance"].count() == 3 and reports["metrics"].count() == 3 and reports["limits"].count() == 1
    assert spark.read.csv(f"{tmp_path}/metrics", header=True).count() == 1
    assert training.score(model, spark.table("_run_silver"), rule=about.bucket_rule).count() == bookings(spark).count()
