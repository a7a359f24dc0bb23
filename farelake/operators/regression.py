"""Estimators, tuning and evaluation of fare regressors."""

import hashlib
import json
import operator
import random
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool
from threading import Lock
from typing import Any

import numpy as np
from pyspark import inheritable_thread_target, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasMaxIter, HasPredictionCol
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from farelake.operators import cells, moments
from farelake.operators.profile import histogram
from farelake.session import delete_folder, file_names, file_text, shared_folder, shared_root, write_new_file

_DEEPEST = 30  # Spark's limit, standing for "no limit"
_SHALLOW = 5  # levels up to which trees are fitted one by one
SOLVER, TOLERANCE = "l-bfgs", 1e-8  # of all linear models


class PenalisedRegression(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol, HasMaxIter):
    """Ridge or lasso with the penalty stated as ``alpha``.

    Ridge minimises |y - Xw|^2 + alpha |w|^2, lasso |y - Xw|^2 / 2n + alpha |w|. Spark divides
    by n and works on a standardised label, so ridge translates ``alpha`` by both,
    on whatever rows it is fitted.
    """

    alpha = Param(Params._dummy(), "alpha", "penalty", TypeConverters.toFloat)
    penalty = Param(Params._dummy(), "penalty", "ridge or lasso", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, penalty="ridge", alpha=1.0, maxIter=1000, featuresCol="features", labelCol="label"):
        super().__init__()
        self._set(**self._input_kwargs)
        self._setDefault(alpha=1.0, penalty="ridge", maxIter=1000)

    def _fit(self, dataset: DataFrame) -> Model:
        found = moments.of(dataset, self.getFeaturesCol(), self.getLabelCol())
        if found is not None:
            return self.fit_moments(found, dataset.sparkSession)
        label = self.getLabelCol()
        alpha = self.getOrDefault(self.alpha)
        # Wide rows: the solver passes over them at each step, and holds vectors of the features'
        # number only, never a features-by-features matrix.
        if not self._lasso:
            n, spread = dataset.agg(F.count(label), F.stddev_samp(label)).first()
            alpha *= (spread or 1.0) / n
        return self._linear(SOLVER).setRegParam(alpha).fit(dataset)

    def fit_moments(self, found: moments.Moments, spark: SparkSession) -> Model:
        """The model of the rows that ``found`` was summed over."""
        alpha = self.getOrDefault(self.alpha)
        if not self._lasso:
            alpha *= (found.label_spread or 1.0) / found.rows
        # This solver sums up the few rows once more and takes the population deviation of the label.
        linear = self._linear("normal").setFeaturesCol("features").setLabelCol("label").setRegParam(alpha)
        return linear.fit(found.stand_in(spark)).setFeaturesCol(self.getFeaturesCol())

    @property
    def _lasso(self) -> bool:
        return self.getOrDefault(self.penalty) == "lasso"

    def _linear(self, solver: str) -> LinearRegression:
        return LinearRegression(
            featuresCol=self.getFeaturesCol(),
            labelCol=self.getLabelCol(),
            predictionCol=self.getPredictionCol(),
            maxIter=self.getMaxIter(),
            tol=TOLERANCE,
            standardization=False,
            elasticNetParam=1.0 if self._lasso else 0.0,
            solver=solver,
        )


class LeastSquares(LinearRegression):
    """Spark's linear regression without a penalty, fitted on the moments of the rows, or on the rows where they are wide."""

    def _fit(self, dataset: DataFrame) -> Model:
        found = moments.of(dataset, self.getFeaturesCol(), self.getLabelCol()) if self.plain else None
        return super()._fit(dataset) if found is None else self.fit_moments(found, dataset.sparkSession)

    @property
    def plain(self) -> bool:
        """Whether it is all least squares, as moments give it: no penalty, no weights, an intercept."""
        weighted = self.isSet(self.weightCol) and self.getWeightCol()
        return not (self.getRegParam() or weighted) and self.getFitIntercept() and self.getLoss() == "squaredError"

    def fit_moments(self, found: moments.Moments, spark: SparkSession) -> Model:
        """The model of the rows that ``found`` was summed over; where many fit them alike, the one that l-bfgs comes to."""
        few = self.copy({self.featuresCol: "features", self.labelCol: "label", self.solver: "normal"})
        return LinearRegression._fit(few, found.least_squares_line(spark)).setFeaturesCol(self.getFeaturesCol())


def least_squares() -> LinearRegression:
    return LeastSquares(solver=SOLVER, tol=TOLERANCE)


def model_grid(seed: int = 42) -> dict[str, tuple[Estimator, dict[str, list]]]:
    """The six regressors with the values each parameter is tuned over."""
    # Tuning grids.
    alphas = [0.01, 0.1, 1.0, 10.0, 100.0]
    return {
        "Linear Regression": (least_squares(), {}),
        "Ridge": (PenalisedRegression(penalty="ridge"), {"alpha": alphas}),
        "Lasso": (PenalisedRegression(penalty="lasso", maxIter=5000), {"alpha": alphas}),
        "Decision Tree": (
            DecisionTreeRegressor(seed=seed),
            {"maxDepth": [5, 10, 15, 20, _DEEPEST], "minInstancesPerNode": [1, 2, 4]},
        ),
        "Random Forest": (
            RandomForestRegressor(seed=seed, featureSubsetStrategy="all"),
            {"numTrees": [50, 100, 200], "maxDepth": [10, 15, 20, _DEEPEST], "minInstancesPerNode": [1, 2]},
        ),
        "Gradient Boosting": (
            GBTRegressor(seed=seed),
            {
                "maxIter": [100, 200],
                "maxDepth": [3, 5, 7],
                "stepSize": [0.01, 0.05, 0.1],
                "subsamplingRate": [0.8, 1.0],
            },
        ),
    }


def candidates(estimator: Estimator, grid: Mapping[str, Sequence], n_iter: int, seed: int) -> list[dict]:
    """At most ``n_iter`` distinct settings drawn from the grid."""
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(estimator.getParam(name), list(values))
    settings = builder.build()
    return settings if len(settings) <= n_iter else random.Random(seed).sample(settings, n_iter)


def _fitted(estimator: Estimator, setting: Mapping[str, Any], rows: DataFrame | moments.Moments, fit: Callable | None = None) -> Model:
    estimator = estimator.copy({estimator.getParam(n): v for n, v in setting.items()})
    if fit:
        return fit(estimator, rows)
    if isinstance(rows, moments.Moments):
        return estimator.fit_moments(rows, SparkSession.active())
    return estimator.fit(rows)


def _size_param(estimator: Estimator, grid: Mapping[str, Sequence]) -> str | None:
    """The parameter that counts an ensemble's members, or the levels of a deep tree."""
    if type(estimator) is DecisionTreeRegressor and max(grid.get("maxDepth", ()), default=0) > _SHALLOW:
        return "maxDepth"
    return {RandomForestRegressor: "numTrees", GBTRegressor: "maxIter"}.get(type(estimator))


def _takes_moments(estimator: Estimator, grid: Mapping[str, Sequence]) -> bool:
    """Whether the estimator fits moments, of the columns of ``tune``, with all settings of the grid."""
    known = isinstance(estimator, PenalisedRegression) or isinstance(estimator, LeastSquares) and estimator.plain and not grid
    return known and estimator.getFeaturesCol() == "features" and estimator.getLabelCol() == "label"


def _r2(prediction: Column) -> Column:
    squares = F.sum((F.col("label") - prediction) ** 2)
    total = F.var_pop("label") * F.count("label")
    return F.when(total == 0, F.when(squares == 0, 1.0).otherwise(0.0)).otherwise(1 - squares / F.nullif(total, F.lit(0.0)))


def nested_scores(estimator: Estimator, setting: Mapping[str, Any], sizes: Sequence[int], rows: DataFrame, held: DataFrame) -> dict[int, float]:
    """r2 on ``held`` of ensembles of several sizes that are fitted on ``rows``, for the price of the largest.

    Boosting adds rounds to what it has, so the first rounds of a long run are the short run, exactly. The trees of a
    forest are independent: it is grown in parts, and a size is the mean over its first ones. That is a forest of the
    size, though not that which one fit of this size and seed would draw. The upper levels of a deep tree are the shallow one.
    """
    sizes = sorted(set(sizes))
    if isinstance(estimator, DecisionTreeRegressor):
        if sizes == [0]:
            return {0: held_r2(_fitted(estimator, setting, rows), held)}
        return level_r2(_fitted(estimator, setting | {"maxDepth": sizes[-1]}, rows), sizes, held)
    name = _size_param(estimator, {})
    if name is None:
        return {0: held_r2(_fitted(estimator, setting, rows), held)}
    if isinstance(estimator, GBTRegressor):
        model = _fitted(estimator, setting | {name: sizes[-1]}, rows)
        errors = model.evaluateEachIteration(held, "squared")
        spread = held.agg(F.var_pop("label")).first()[0] or 0.0
        return {n: 1 - errors[n - 1] / spread if spread else float(errors[n - 1] == 0) for n in sizes}
    wide, total, means = held, F.lit(0.0), []
    for part, (before, size) in enumerate(zip([0, *sizes], sizes)):
        seed = estimator.getOrDefault("seed") + part
        model = _fitted(estimator, setting | {name: size - before, "seed": seed}, rows)
        wide = model.copy({model.predictionCol: f"_part_{part}"}).transform(wide)
        total = total + F.col(f"_part_{part}") * (size - before)
        means.append(total / size)
    found = wide.agg(*(_r2(m).alias(str(n)) for m, n in zip(means, sizes))).first()
    return {n: found[str(n)] for n in sizes}


def held_r2(model: Model, held: DataFrame) -> float:
    return model.transform(held).agg(_r2(F.col(model.getOrDefault("predictionCol")))).first()[0]


def level_r2(tree: DecisionTreeRegressionModel, depths: Sequence[int], held: DataFrame) -> dict[int, float]:
    """r2 on ``held`` of a tree that is cut at each of the depths; a node's prediction is the mean of its rows."""
    spark = held.sparkSession
    folder = shared_folder(spark)
    tree.write().save(folder)
    try:
        nodes = spark.read.parquet(f"{folder}/data").select("id", "prediction", "leftChild", "rightChild").toPandas().sort_values("id")
    finally:
        delete_folder(spark, folder)
    # Nodes are numbered before their children, left ones first, so leaves come in the order of their indices.
    own, left, right = (nodes[c].to_numpy() for c in ("prediction", "leftChild", "rightChild"))
    leaf, at = left < 0, np.zeros(1, dtype=int)
    cut = {d: own.copy() for d in depths}  # what a node predicts in the tree that ends at this depth
    for depth in range(tree.depth):
        at = at[~leaf[at]]
        for child in (left[at], right[at]):
            for d in depths:
                cut[d][child] = own[child] if depth < d else cut[d][at]
        at = np.concatenate([left[at], right[at]])
    scored = tree.copy({tree.leafCol: "_leaf"}).transform(held).groupBy(F.col("_leaf").cast("int").alias("leaf"))
    found = scored.agg(F.count("label").alias("rows"), F.avg("label").alias("label"), F.var_pop("label").alias("spread")).toPandas()
    rows, label, spread = (found[c].to_numpy() for c in ("rows", "label", "spread"))
    return {d: cells.r2_of(rows, label, rows * spread, p[leaf][found["leaf"]]) for d, p in cut.items()}


class _FoldMoments:
    """Moments of each fold's rows, taken when the first fit asks for them: all linear models of a search share them."""

    def __init__(self, train: DataFrame, folds: int, parallelism: int):
        self.train, self.folds, self.parallelism = train, folds, parallelism
        self.lock, self.taken, self.found = Lock(), False, None

    def get(self) -> dict[int | None, moments.Moments] | None:
        """None where fits had better see the rows."""
        with self.lock:
            if not self.taken:
                # What lies outside the folds is fitted on, and held out by none.
                known = [r[0] for r in self.train.select("fold").distinct().limit(self.folds + 2).collect()]
                if set(range(self.folds)) <= set(known) and len(known) <= self.folds + 1:
                    with ThreadPool(self.parallelism) as pool:
                        run = lambda work, groups: pool.map(inheritable_thread_target(self.train.sparkSession)(work), groups, chunksize=1)
                        self.found = moments.by_group(self.train, "fold", known, run)
                self.taken = True
        return self.found

    def fitted_on(self, fold: int | None = None) -> moments.Moments:
        """Of all rows, or of those that are not held out with ``fold``."""
        return reduce(operator.add, (m for f, m in self.get().items() if fold is None or f not in (fold, None)))


class _Cells:
    """Rows of equal features and fold summed up, when the first fit asks for them."""

    def __init__(self, train: DataFrame):
        self.train, self.lock, self.taken, self.found = train, Lock(), False, None

    def get(self) -> DataFrame | None:
        """None where fits had better see the rows."""
        with self.lock:
            if not self.taken:
                self.found, self.taken = cells.of(self.train), True
        return self.found


class _Scores:
    """Scores of a search by what they were taken from, in files of their own where a folder is given."""

    def __init__(self, spark: SparkSession, folder: str | None):
        self.spark, self.folder = spark, folder and folder.rstrip("/")
        self.known = {n.removesuffix(".json") for n in file_names(spark, self.folder)} if folder else set()

    def get(self, unit: Mapping[str, Any], work: Callable[[], dict[int, float]]) -> dict[int, float]:
        name = hashlib.sha256(json.dumps(unit, sort_keys=True, default=str).encode()).hexdigest()
        path = f"{self.folder}/{name}.json"
        if name in self.known:
            return {int(n): r2 for n, r2 in json.loads(file_text(self.spark, path))["r2"].items()}
        found = work()
        if self.folder:
            write_new_file(self.spark, path, json.dumps({**unit, "r2": found}, default=str))
        return found


def tune(
    train: DataFrame,
    grid: Mapping[str, tuple[Estimator, Mapping[str, Sequence]]],
    folds: int = 5,
    n_iter: int = 20,
    seed: int = 42,
    parallelism: int = 4,
    scores: str | None = None,
) -> tuple[dict[str, Model], DataFrame]:
    """Best model of each kind, refitted on all of ``train``, and (model, cv_mean_r2, cv_std_r2).

    ``train`` has ``features``, ``label`` and a ``fold`` number below ``folds``. The scores are
    those of the winning setting on the same folds, so nothing is fitted twice for them. Settings that
    differ in the size of an ensemble, or in the depth of a tree, alone are scored by one fit (``nested_scores``). Linear models are fitted
    and scored on the moments of the folds' rows, which are summed once for all settings and kinds; trees that draw no
    rows, on features of few values, on rows of equal features summed up (``cells``).

    With a folder ``scores`` each fit leaves its scores there, and a search over the same rows,
    folds and settings goes on from them.
    """
    spark = train.sparkSession
    shared_root(spark)  # boosting cuts its lineage by checkpoints there
    stored = _Scores(spark, scores)
    digest = train.agg(F.count("*"), F.sum(F.xxhash64("features", "label", "fold").cast("decimal(38,0)"))).first() if scores else None
    sums, equal = _FoldMoments(train, folds, parallelism), _Cells(train)
    models, rows = {}, []
    for name, (estimator, values) in grid.items():
        size, linear = _size_param(estimator, values), _takes_moments(estimator, values)
        settings = [{p.name: v for p, v in s.items()} for s in candidates(estimator, values, n_iter, seed)]
        fixed = {p.name: v for p, v in estimator.extractParamMap().items()}
        # Settings that are alike but for the size, in the order of the first of them.
        bases: dict[str, tuple[dict[str, Any], list[int]]] = {}
        for s in settings:
            base = {n: v for n, v in s.items() if n != size}
            bases.setdefault(json.dumps(base, sort_keys=True), (base, []))[1].append(s.get(size, fixed.get(size, 0)))
        units = [(key, base, sorted(set(sizes)), fold) for key, (base, sizes) in bases.items() for fold in range(folds)]
        summed = cells.fits(estimator, values) and all(len(sizes) == 1 for _, _, sizes, _ in units)

        def work(unit, name=name, estimator=estimator, fixed=fixed, linear=linear, size=size, summed=summed):
            key, base, sizes, fold = unit
            about = {"model": name, "fixed": fixed, "setting": base, "sizes": sizes, "fold": fold, "folds": folds, "rows": digest}

            def scored():
                if linear and sums.get():
                    model = _fitted(estimator, base, sums.fitted_on(fold))
                    return {0: sums.get()[fold].r2(model.coefficients.toArray(), model.intercept)}
                rows = equal.get() if summed else None
                fit, held = ((train if rows is None else rows).filter(f) for f in (F.col("fold") != fold, F.col("fold") == fold))
                if rows is not None:
                    model = _fitted(estimator, base | ({size: sizes[0]} if size else {}), fit, cells.fitted)
                    return {sizes[0]: cells.r2(model, held)}
                return nested_scores(estimator, base, sizes, fit, held)

            return stored.get(about, scored)

        with ThreadPool(parallelism) as pool:
            found = pool.map(inheritable_thread_target(spark)(work), units, chunksize=1)
        by_base: dict[str, list[dict[int, float]]] = {}
        for (key, *_), r2 in zip(units, found):
            by_base.setdefault(key, []).append(r2)
        tried = []
        for s in settings:
            own = by_base[json.dumps({n: v for n, v in s.items() if n != size}, sort_keys=True)]
            r2 = np.array([f[s.get(size, fixed.get(size, 0)) if size else 0] for f in own])
            tried.append((float(r2.mean()), float(r2.std())))
        best = max(range(len(tried)), key=lambda i: tried[i][0])
        if summed and equal.get() is not None:
            models[name] = _fitted(estimator, settings[best], equal.get(), cells.fitted)
        else:
            models[name] = _fitted(estimator, settings[best], sums.fitted_on() if linear and sums.get() else train)
        rows.append((name, *(round(x, 4) + 0.0 for x in tried[best])))
    return models, spark.createDataFrame(rows, "model string, cv_mean_r2 double, cv_std_r2 double")


def predict_long(models: Mapping[str, Model], test: DataFrame) -> DataFrame:
    """(model, label, prediction) of every model on every row, in one pass over ``test``."""
    wide, columns = test, []
    for i, (name, model) in enumerate(models.items()):
        column = f"_prediction_{i}"
        wide = model.copy({model.predictionCol: column}).transform(wide)
        columns.append(F.struct(F.lit(name).alias("model"), F.col(column).alias("prediction")))
    return wide.select("label", F.inline(F.array(*columns))).select("model", "label", "prediction")


def regression_metrics(predictions: DataFrame, by: str = "model") -> DataFrame:
    """(model, r2, mae, rmse) of each model, in one aggregation."""
    error = F.col("label") - F.col("prediction")
    squares = F.sum(error * error)
    total = F.var_pop("label") * F.count("label")
    constant = F.when(squares == 0, 1.0).otherwise(0.0)
    r2 = F.when(total == 0, constant).otherwise(1 - squares / F.nullif(total, F.lit(0.0)))
    return predictions.groupBy(by).agg(
        F.round(r2, 6).alias("r2"),
        F.round(F.avg(F.abs(error)), 2).alias("mae"),
        F.round(F.sqrt(F.avg(error * error)), 2).alias("rmse"),
    )


def compare_models(metrics: DataFrame, cv_scores: DataFrame, order: Sequence[str]) -> DataFrame:
    """Metrics with their cross-validation scores, best r2 first; ties keep the given order."""
    place = F.array_position(F.array(*(F.lit(n) for n in order)), F.col("model"))
    return metrics.join(cv_scores, "model", "left").orderBy(F.desc("r2"), place)


def metrics_long(metrics: DataFrame) -> DataFrame:
    """(model, metric, value) of r2, mae and rmse."""
    return metrics.unpivot("model", ["r2", "mae", "rmse"], "metric", "value")


def write_metrics(metrics: DataFrame, path: str) -> str:
    """Metrics as one CSV part with a header; six rows, so one part is all there is."""
    metrics.coalesce(1).write.mode("overwrite").csv(path, header=True)
    return path


def feature_importance(model: Model, names: Sequence[str], top_n: int = 20) -> DataFrame:
    """(feature, importance), largest first: tree importances, or absolute coefficients."""
    values = model.featureImportances if hasattr(model, "featureImportances") else model.coefficients
    rows = [(name, abs(float(v))) for name, v in zip(names, values.toArray(), strict=True)]
    frame = SparkSession.active().createDataFrame(rows, "feature string, importance double")
    return frame.orderBy(F.desc("importance"), "feature").limit(top_n)


def axis_limits(predictions: DataFrame) -> DataFrame:
    """(model, low, high): the range that holds all actual and predicted values."""
    return predictions.groupBy("model").agg(
        F.min(F.least("label", "prediction")).alias("low"), F.max(F.greatest("label", "prediction")).alias("high")
    )


def prediction_pairs(predictions: DataFrame, fraction: float = 1.0, seed: int = 42) -> DataFrame:
    """Points (model, label, prediction, residual) for a scatter chart, thinned by ``fraction``."""
    points = predictions if fraction >= 1 else predictions.sample(fraction, seed)
    return points.withColumn("residual", F.col("label") - F.col("prediction"))


def residual_histogram(predictions: DataFrame, bins: int = 50) -> DataFrame:
    """Histogram of label minus prediction, of one model's predictions."""
    return histogram(predictions.select((F.col("label") - F.col("prediction")).alias("residual")), "residual", bins)
