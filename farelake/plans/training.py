"""Training, model storage and batch scoring."""

import uuid
from collections.abc import Mapping, Sequence

from pyspark.ml import Model, PipelineModel
from pyspark.ml.feature import StringIndexerModel
from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from farelake.functions.dates import departure_parts
from farelake.functions.keys import key_slot
from farelake.operators.features import (
    PopulationScalerModel, bucket_rule, clean_inputs, derive_buckets, engineer_features, feature_names, feature_pipeline,
    prepare, test_row,
)
from farelake.operators.regression import (
    axis_limits, compare_models, feature_importance, metrics_long, model_grid, predict_long, regression_metrics, tune,
    write_metrics,
)
from farelake.schema import (
    BRONZE_TABLE, CATEGORICAL_FEATURES, FEATURE_TABLE, NUMERIC_FEATURES, SILVER_TABLE, USD_RATE,
)
from farelake.session import materialise
from farelake.sources import versions
from farelake.sources.csv_files import POSITION, read_bookings_csv
from farelake.sources.tables import read_layer


LAYERS = {"gold": FEATURE_TABLE, "silver": SILVER_TABLE, "bronze": BRONZE_TABLE}


def load_data(
    spark: SparkSession,
    source: str = "auto",
    csv_folder: str | None = None,
    tables: Mapping[str, str] = LAYERS,
    weekday_base: str = "sunday",
    max_files: int | None = None,
) -> DataFrame:
    """Model input from the best layer that has rows: Gold, Silver, Bronze, then CSV.

    ``source`` "postgres" stands for Gold only and "csv" for the files only. Weekdays
    count from Sunday on every path, as in the feature table and in scoring. All files
    are read, or the first ``max_files`` by path where that is given.
    """
    if source not in ("auto", "postgres", "csv"):
        raise ValueError(f"source must be 'auto', 'postgres' or 'csv', not {source!r}")
    layers = {"auto": ("gold", "silver", "bronze"), "postgres": ("gold",), "csv": ()}[source]
    for layer in layers:
        rows = read_layer(spark, tables[layer])
        if rows is not None:
            return rows if layer == "gold" else engineer_features(rows, weekday_base)
    if source != "postgres" and csv_folder is not None:
        try:
            rows = read_bookings_csv(spark, csv_folder, max_files).drop(*POSITION)
        except FileNotFoundError:
            rows = None
        if rows is not None and not rows.isEmpty():
            return engineer_features(rows, weekday_base)
    raise LookupError(f"no data for source {source!r}")


def vectorise(
    df: DataFrame, key_cols: Sequence[str] = (), folds: int = 5, seed: int = 42, fit_scope: str = "train"
) -> tuple[PipelineModel, DataFrame, DataFrame]:
    """(encoder, train, test): split by row key, encode, and write both sides once.

    The encoder learns from the training rows; ``fit_scope`` "all" lets it see every row.
    Key columns serve the split and the folds and are no features. Without any, the
    row itself is the key, so equal rows stay together.
    """
    keys = list(key_cols) or [c for c in df.columns if c in CATEGORICAL_FEATURES or c in NUMERIC_FEATURES]
    names = {c: f"_key_{i}" for i, c in enumerate(keys)}
    hidden = list(names.values())
    rows = prepare(df.select("*", *(F.col(c).alias(n) for c, n in names.items())))
    marks = {"fold": key_slot(hidden, seed + 1, folds), "in_test": test_row(hidden, seed=seed)}
    # Written once: the encoder passes over the rows several times.
    rows = materialise(rows.withColumns(marks).drop(*hidden))
    train, test = rows.filter("NOT in_test"), rows.filter("in_test")
    encoder = feature_pipeline(
        [c for c in CATEGORICAL_FEATURES if c in rows.columns], [c for c in NUMERIC_FEATURES if c in rows.columns]
    ).fit(rows if fit_scope == "all" else train)
    return (
        encoder,
        materialise(encoder.transform(train).select("features", "label", "fold")),
        materialise(encoder.transform(test).select("features", "label")),
    )


def train_run(
    df: DataFrame,
    grid: Mapping | None = None,
    key_cols: Sequence[str] = (),
    folds: int = 5,
    n_iter: int = 20,
    seed: int = 42,
    parallelism: int = 4,
    fit_scope: str = "train",
    scores: str | None = None,
) -> tuple[DataFrame, dict[str, Model], PipelineModel, DataFrame]:
    """(comparison, models, encoder, predictions) of all regressors on feature rows; ``scores`` as in ``tune``."""
    encoder, train, test = vectorise(df, key_cols, folds, seed, fit_scope)
    models, cv_scores = tune(train, grid or model_grid(seed), folds, n_iter, seed, parallelism, scores)
    predictions = predict_long(models, test)
    return compare_models(regression_metrics(predictions), cv_scores, list(models)), models, encoder, predictions


def save_best(
    comparison: DataFrame, models: Mapping[str, Model], encoder: PipelineModel, path: str, rule: str = "ladder"
) -> str:
    """Store the model with the best r2, encoder included, with its name, features, metrics and bucket rule, and all metrics.

    They lie in one new folder, which a record then makes the present one: whoever loads the model gets a model and a
    description that belong together, also while or after a run dies. Earlier folders stay.
    """
    spark = comparison.sparkSession
    before = versions.latest_record(spark, path)
    best, folder = comparison.first(), uuid.uuid4().hex
    fitted = PipelineModel(stages=[*encoder.stages, models[best["model"]]])
    fitted.save(f"{path}/{folder}/model")
    names = feature_names(encoder.transform(_empty_input(spark, encoder)))
    about = spark.createDataFrame([Row(**best.asDict(), feature_names=names, bucket_rule=rule)])
    about.coalesce(1).write.json(f"{path}/{folder}/metadata")
    write_metrics(comparison, f"{path}/{folder}/metrics")
    versions.add_record(spark, path, {"number": before["number"] + 1 if before else 1, "folder": folder})
    return best["model"]


def _stored_model(spark: SparkSession, path: str) -> str:
    record = versions.latest_record(spark, path)
    return f"{path}/{record['folder']}" if record else path  # without a record: stored before there were any


def describe_model(spark: SparkSession, path: str) -> DataFrame:
    """One row: name, metrics, feature names and bucket rule of the stored model."""
    return spark.read.json(f"{_stored_model(spark, path)}/metadata")


def stored_metrics(spark: SparkSession, path: str) -> DataFrame:
    """The metrics of all models of the run that stored the present one."""
    schema = "model string, r2 double, mae double, rmse double, cv_mean_r2 double, cv_std_r2 double"
    return spark.read.schema(schema).csv(f"{_stored_model(spark, path)}/metrics", header=True)


def _empty_input(spark: SparkSession, encoder: PipelineModel) -> DataFrame:
    """A frame without rows that has the encoder's input columns."""
    numeric = [c for s in encoder.stages if isinstance(s, PopulationScalerModel) for c in s.getInputCols()]
    indexed = [c for s in encoder.stages if isinstance(s, StringIndexerModel) for c in s.getInputCols()]
    levels = [c.removeprefix("_").removesuffix("_level") for c in indexed]
    fields = [f"`{c}` string" for c in levels] + [f"`{c}` double" for c in numeric]
    return spark.createDataFrame([], ", ".join(fields))


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, Row]:
    """The stored model and its description."""
    stored = _stored_model(spark, path)
    return PipelineModel.load(f"{stored}/model"), spark.read.json(f"{stored}/metadata").first()


def score(model: PipelineModel, bookings: DataFrame, usd_rate: float = USD_RATE, rule: str = "ladder") -> DataFrame:
    """Bookings with ``predicted_fare_bdt`` and its value in dollars.

    Bookings of any layer are cleaned as in Silver first, so a booking gets the same fare
    whether it comes as Silver, Bronze or CSV row. ``rule`` is the one the model learned
    its buckets by, ``bucket_rule`` in its description. Levels the model has not seen
    count for nothing; missing numbers count as average.
    """
    names = {c: f"_given_{i}" for i, c in enumerate(bookings.columns)}
    rows = clean_inputs(bookings.select("*", *(F.col(c).alias(n) for c, n in names.items())))
    if "departure_month" not in rows.columns and "departure_datetime" in rows.columns:
        rows = rows.select("*", *departure_parts(F.col("departure_datetime")))
    scored = model.transform(derive_buckets(rows, rule))
    return scored.select(
        *(F.col(n).alias(c) for c, n in names.items()),
        F.col("prediction").alias("predicted_fare_bdt"),
        F.round(F.col("prediction") / usd_rate, 2).alias("predicted_fare_usd"),
    )


def train_and_store(
    spark: SparkSession,
    path: str,
    source: str = "auto",
    csv_folder: str | None = None,
    tables: Mapping[str, str] = LAYERS,
    top_n: int = 20,
    **settings,
) -> dict[str, DataFrame]:
    """A whole training run, from the best source to the stored model; returns its reports by name.

    Under ``path`` lie the best model with its description, ``metrics`` as CSV, and the scores of
    the search, from which a run that was ended goes on. The reports are the comparison, the
    metrics in long form, the importances of the best model, and the axis limits of its
    predictions. ``settings`` go to ``train_run``.
    """
    data = load_data(spark, source, csv_folder, tables)
    comparison, models, encoder, predictions = train_run(data, **{"scores": f"{path}/scores"} | settings)
    comparison = materialise(comparison).orderBy(F.desc("r2"))
    best = save_best(comparison, models, encoder, path, bucket_rule(data))
    write_metrics(comparison, f"{path}/metrics")
    names = feature_names(encoder.transform(_empty_input(spark, encoder)))
    return {
        "comparison": comparison,
        "metrics": metrics_long(comparison),
        "importance": feature_importance(models[best], names, top_n),
        "limits": axis_limits(predictions),
    }
