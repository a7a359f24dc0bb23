"""Linear models fitted on sums over the rows."""

import numpy as np
import pytest
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from farelake.operators import moments, regression
from tests.test_models import frame, matrix


def test_a_search_of_linear_models_sums_each_fold_once(spark, monkeypatch):
    rows = frame(spark, *matrix(240)).cache()
    passes, of = [], moments.of
    monkeypatch.setattr(moments, "of", lambda *a: passes.append(1) or of(*a))
    grid = {
        "Linear Regression": (regression.least_squares(), {}),
        "Ridge": (regression.PenalisedRegression(penalty="ridge"), {"alpha": [0.1, 50.0]}),
        "Lasso": (regression.PenalisedRegression(penalty="lasso"), {"alpha": [0.1, 2.0]}),
    }
    models, scores = regression.tune(rows, grid, folds=3)
    assert len(passes) == 3  # whatever the number of settings and kinds
    want = []
    for fold in range(3):
        model = LinearRegression(solver="l-bfgs", tol=1e-10).fit(rows.filter(F.col("fold") != fold))
        want.append(regression.held_r2(model, rows.filter(F.col("fold") == fold)))
    assert scores.first().cv_mean_r2 == pytest.approx(np.mean(want), abs=1e-4)
    assert models["Linear Regression"].coefficients.toArray() == pytest.approx(LinearRegression().fit(rows).coefficients.toArray())


def test_features_that_depend_on_each_other_share_the_weight(spark):
    x, y = matrix()
    x = np.column_stack([x, x[:, 0], np.ones(len(x))])
    model = regression.least_squares().fit(frame(spark, x, y))
    by_steps = LinearRegression(solver="l-bfgs", tol=1e-10).fit(frame(spark, x, y))
    assert model.coefficients.toArray() == pytest.approx(by_steps.coefficients.toArray(), abs=1e-4)
    assert model.intercept == pytest.approx(by_steps.intercept, abs=1e-3)


def test_rows_that_sums_would_round_are_fitted_themselves(spark, monkeypatch):
    x, y = matrix()
    far = x + 1e7
    assert moments.of(frame(spark, far, y)) is None
    monkeypatch.setattr(moments, "WIDEST", 3)
    assert moments.of(frame(spark, x, y)) is None
    assert moments.of(frame(spark, x, y).limit(0)) is None
    model = regression.least_squares().fit(frame(spark, x, y))
    assert model.coefficients.toArray() == pytest.approx([3, -1, 10, 0], abs=0.5)


def test_moments_of_parts_add_up(spark):
    rows = frame(spark, *matrix())
    parts = moments.by_group(rows, "fold", [0, 1, 2])
    added, whole = parts[0] + parts[1] + parts[2], moments.of(rows)
    assert added.rows == whole.rows and added.scatter == pytest.approx(whole.scatter) and added.mean == pytest.approx(whole.mean)
    model = regression.least_squares().fit(rows)
    assert whole.r2(model.coefficients.toArray(), model.intercept) == pytest.approx(regression.held_r2(model, rows))
