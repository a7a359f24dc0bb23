"""Searches: ensembles of several sizes by one fit, searches that go on, and models stored by versions."""

import numpy as np
import pytest
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from farelake.operators import regression
from farelake.plans import training
from farelake.session import file_names
from farelake.sources import versions
from tests.test_models import bookings, frame, matrix
from farelake.plans import gold
from farelake.plans.silver import to_silver
from farelake.schema import KEY


def r2_of(model, held):
    return RegressionEvaluator(metricName="r2").evaluate(model.transform(held))


def split(spark):
    rows = frame(spark, *matrix(240)).repartition(2).cache()
    return rows.filter("fold <> 0"), rows.filter("fold = 0")


def test_first_rounds_of_boosting_are_the_short_run(spark):
    rows, held = split(spark)
    boosting = GBTRegressor(seed=42)
    found = regression.nested_scores(boosting, {"maxDepth": 2, "subsamplingRate": 0.8}, [2, 4, 7], rows, held)
    for n in (2, 4, 7):
        alone = GBTRegressor(seed=42, maxDepth=2, subsamplingRate=0.8, maxIter=n).fit(rows)
        assert found[n] == pytest.approx(r2_of(alone, held), abs=1e-9)


def test_forests_grow_in_parts(spark):
    rows, held = split(spark)
    forest = RandomForestRegressor(seed=42, featureSubsetStrategy="all")
    found = regression.nested_scores(forest, {"maxDepth": 4}, [3, 5], rows, held)
    first = RandomForestRegressor(seed=42, featureSubsetStrategy="all", maxDepth=4, numTrees=3).fit(rows)
    second = RandomForestRegressor(seed=43, featureSubsetStrategy="all", maxDepth=4, numTrees=2).fit(rows)
    assert found[3] == pytest.approx(r2_of(first, held), abs=1e-9)
    both = second.setPredictionCol("more").transform(first.transform(held))
    both = both.withColumn("prediction", (3 * F.col("prediction") + 2 * F.col("more")) / 5)
    assert found[5] == pytest.approx(RegressionEvaluator(metricName="r2").evaluate(both), abs=1e-9)


def test_each_ensemble_is_fitted_once_for_all_sizes(spark, monkeypatch):
    rows = frame(spark, *matrix(120))
    fits = []
    fitted = regression._fitted
    monkeypatch.setattr(regression, "_fitted", lambda e, s, r: fits.append(dict(s)) or fitted(e, s, r))
    grid = {"Gradient Boosting": (GBTRegressor(seed=1), {"maxIter": [1, 2, 6], "maxDepth": [1, 2]})}
    models, scores = regression.tune(rows, grid, folds=3)
    assert len(fits) == 2 * 3 + 1 and all(s["maxIter"] == 6 for s in fits[:-1])
    assert models["Gradient Boosting"].getNumTrees == fits[-1]["maxIter"] and scores.first().cv_mean_r2 > 0


class Died(Exception):
    pass


def test_a_search_that_died_goes_on(spark, tmp_path, monkeypatch):
    rows = frame(spark, *matrix(150)).cache()
    grid = {
        "Decision Tree": (DecisionTreeRegressor(seed=1), {"maxDepth": [1, 2, 4]}),
        "Ridge": (regression.PenalisedRegression(penalty="ridge"), {"alpha": [0.1, 1e5]}),
    }
    _, whole = regression.tune(rows, grid, folds=3)
    count, fitted = [0], regression._fitted

    def dying(estimator, setting, frame_):
        count[0] += 1
        if count[0] == 8:
            raise Died
        return fitted(estimator, setting, frame_)

    with monkeypatch.context() as patch:
        patch.setattr(regression, "_fitted", dying)
        with pytest.raises(Died):
            regression.tune(rows, grid, folds=3, parallelism=1, scores=str(tmp_path))
    assert len(file_names(spark, str(tmp_path))) >= 7
    stored = len([n for n in file_names(spark, str(tmp_path)) if n.endswith(".json") and not n.startswith(".")])
    count[0] = 100
    with monkeypatch.context() as patch:
        patch.setattr(regression, "_fitted", dying)
        models, scores = regression.tune(rows, grid, folds=3, parallelism=1, scores=str(tmp_path))
    assert count[0] - 100 == (9 + 6 - stored) + 2  # what was left, and the two winners
    assert scores.collect() == whole.collect()
    # Other rows are another search.
    count[0] = 100
    with monkeypatch.context() as patch:
        patch.setattr(regression, "_fitted", dying)
        regression.tune(rows.filter("label > 0 and fold < 3").limit(140), {"Ridge": grid["Ridge"]}, folds=3, scores=str(tmp_path))
    assert count[0] - 100 == 6 + 1


def test_a_model_and_its_description_belong_together(spark, tmp_path, monkeypatch):
    rows = gold.ml_features(to_silver(bookings(spark)), carry=[KEY])
    grid = {"Linear Regression": (regression.least_squares(), {})}
    comparison, models, encoder, _ = training.train_run(rows, grid, [KEY], folds=2)
    path = str(tmp_path / "m")
    training.save_best(comparison, models, encoder, path)
    other = comparison.withColumn("r2", F.lit(0.123))
    for step in ("write_metrics", "feature_names"):
        with monkeypatch.context() as patch:
            patch.setattr(training, step, lambda *a: (_ for _ in ()).throw(Died()))
            with pytest.raises(Died):
                training.save_best(other, models, encoder, path)
        model, about = training.load_model(spark, path)
        assert about.r2 == comparison.first().r2 and len(model.stages[-1].coefficients) == len(about.feature_names)
    with monkeypatch.context() as patch:
        patch.setattr(versions, "write_new_file", lambda *a: False)
        with pytest.raises(versions.ConcurrentWrite):
            training.save_best(other, models, encoder, path)
    assert training.load_model(spark, path)[1].r2 == comparison.first().r2
    training.save_best(other, models, encoder, path)
    assert training.load_model(spark, path)[1].r2 == 0.123
    assert training.stored_metrics(spark, path).first().r2 == 0.123 and training.describe_model(spark, path).count() == 1


def test_scores_of_a_constant_label(spark):
    rows = frame(spark, np.ones((30, 2)), np.full(30, 4.0))
    found = regression.nested_scores(GBTRegressor(seed=1), {}, [1, 2], rows, rows)
    assert found == {1: 1.0, 2: 1.0}
    assert regression.nested_scores(DecisionTreeRegressor(), {}, [0], rows, rows) == {0: 1.0}


def test_a_deep_tree_holds_the_shallow_ones(spark, monkeypatch):
    rows, held = split(spark)
    tree = DecisionTreeRegressor(seed=42)
    found = regression.nested_scores(tree, {"minInstancesPerNode": 2}, [1, 3, 6, 30], rows, held)
    for depth in (1, 3, 6, 30):
        alone = DecisionTreeRegressor(seed=42, minInstancesPerNode=2, maxDepth=depth).fit(rows)
        assert found[depth] == pytest.approx(r2_of(alone, held), abs=1e-9)
    fits, fitted = [], regression._fitted
    monkeypatch.setattr(regression, "_fitted", lambda e, s, r: fits.append(dict(s)) or fitted(e, s, r))
    grid = {"Decision Tree": (tree, {"maxDepth": [2, 4, 10], "minInstancesPerNode": [1, 4]})}
    models, scores = regression.tune(frame(spark, *matrix(240)), grid, folds=3)
    assert len(fits) == 2 * 3 + 1 and all(s["maxDepth"] == 10 for s in fits[:-1])
    assert models["Decision Tree"].getOrDefault("maxDepth") == fits[-1]["maxDepth"] and scores.first().cv_mean_r2 > 0
    # A label that is constant leaves the root alone.
    flat = frame(spark, np.ones((30, 2)), np.full(30, 4.0))
    assert regression.nested_scores(tree, {}, [3, 8], flat, flat) == {3: 1.0, 8: 1.0}
