"""Feature engineering, encoding, scaling and the train/test split."""

from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, functions as F, types as T

from farelake.functions.buckets import duration_bucket, duration_interval, lead_bucket, lead_interval
from farelake.functions.dates import coerce_datetime, departure_parts
from farelake.functions.keys import key_slot
from farelake.functions.numeric import to_number
from farelake.schema import (
    CATEGORICAL_FEATURES, LABEL_COLUMNS, LEAKAGE_COLUMNS, NON_FEATURE_COLUMNS, NUMERIC_FEATURES, TARGET,
)

# processed_at stays, as in the feature path from lower layers; encoding leaves it out.
_META = tuple(c for c in NON_FEATURE_COLUMNS if c != "processed_at")


def _number(df: DataFrame, name: str):
    col = F.col(name)
    return to_number(col) if isinstance(df.schema[name].dataType, T.StringType) else col.cast("double")


def drop_leakage(df: DataFrame) -> DataFrame:
    """Without the columns that give the target away or describe the record only."""
    return df.drop(*LEAKAGE_COLUMNS, *_META)


def drop_null_target(df: DataFrame, target: str = TARGET) -> DataFrame:
    """Without rows lacking the target; fares of zero and below stay."""
    return df.dropna(subset=[target]) if target in df.columns else df


def engineer_features(df: DataFrame, weekday_base: str = "monday") -> DataFrame:
    """Model input from Silver, Bronze or CSV rows: date parts, interval buckets, no leakage."""
    out = df
    if "departure_datetime" in df.columns:
        stamp = df.schema["departure_datetime"].dataType
        when = F.col("departure_datetime")
        if isinstance(stamp, T.StringType):
            when = coerce_datetime(when)
        out = out.select("*", *departure_parts(when, weekday_base))
    for source, bucket, label in (
        ("duration_hrs", duration_interval, "duration_bucket"),
        ("days_before_departure", lead_interval, "booking_lead_bucket"),
    ):
        if source in df.columns:
            # The rule stays with the column, so that a model trained on it can be scored by it.
            value = bucket(F.col(source)).alias(label, metadata={"rule": "interval"})
            out = out.withColumn(source, _number(df, source)).drop(label).select("*", value)
    if TARGET in df.columns:
        out = out.withColumn(TARGET, _number(df, TARGET))
    return drop_null_target(drop_leakage(out))


def bucket_rule(df: DataFrame) -> str:
    """How the buckets of feature rows were cut: ``interval`` on lower layers and files, else ``ladder``."""
    fields = {f.name: f for f in df.schema.fields}
    return fields["duration_bucket"].metadata.get("rule", "ladder") if "duration_bucket" in fields else "ladder"


def clean_inputs(df: DataFrame) -> DataFrame:
    """Bookings of any layer, typed and cleaned as in Silver, as far as they have the columns.

    Labels are trimmed, hours and lead days are numbers with 0 for what is missing or no
    number, departures are timestamps with NULL for what is no time.
    """
    have = {f.name: f.dataType for f in df.schema.fields}
    cleaned = {c: F.trim(F.col(c).cast("string")) for c in LABEL_COLUMNS if c in have}
    for c in ("duration_hrs", "days_before_departure"):
        if c in have:
            cleaned[c] = F.coalesce(_number(df, c), F.lit(0.0))
    if isinstance(have.get("departure_datetime"), T.StringType):
        cleaned["departure_datetime"] = coerce_datetime(F.col("departure_datetime"))
    return df.withColumns(cleaned)


def derive_buckets(df: DataFrame, rule: str = "ladder") -> DataFrame:
    """Both buckets from hours and lead days, by the rule that the model learned from."""
    cut = {"ladder": (duration_bucket, lead_bucket), "interval": (duration_interval, lead_interval)}[rule]
    sources = {"duration_bucket": "duration_hrs", "booking_lead_bucket": "days_before_departure"}
    return df.withColumns(
        {label: f(F.col(source)) for f, (label, source) in zip(cut, sources.items()) if source in df.columns}
    )


def scaling_stats(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column, NULLs left out; one row for all columns."""
    aggregates = []
    for c in columns:
        x = F.col(c).cast("double")
        aggregates += [F.avg(x).alias(f"{c}_mean"), F.stddev_pop(x).alias(f"{c}_std")]
    row = df.agg(*aggregates).first()
    return {c: (row[f"{c}_mean"] or 0.0, row[f"{c}_std"] or 1.0) for c in columns}


def scale(df: DataFrame, stats: dict[str, tuple[float, float]], suffix: str = "") -> DataFrame:
    """Standardise by given statistics; NULL becomes 0, which is the mean."""
    return df.withColumns(
        {f"{c}{suffix}": F.coalesce((F.col(c).cast("double") - m) / s, F.lit(0.0)) for c, (m, s) in stats.items()}
    )


class PopulationScaler(Estimator, HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Standard scaling by the population deviation (Spark's own scaler uses the sample one)."""

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> "PopulationScalerModel":
        stats = scaling_stats(dataset, self.getInputCols())
        model = PopulationScalerModel()
        model._set(
            inputCols=self.getInputCols(),
            outputCols=self.getOutputCols(),
            means=[stats[c][0] for c in self.getInputCols()],
            deviations=[stats[c][1] for c in self.getInputCols()],
        )
        return model


class PopulationScalerModel(Model, HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    means = Param(Params._dummy(), "means", "mean per column", TypeConverters.toListFloat)
    deviations = Param(Params._dummy(), "deviations", "population deviation per column", TypeConverters.toListFloat)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        stats = zip(self.getInputCols(), self.getOutputCols(), self.getOrDefault("means"), self.getOrDefault("deviations"))
        return dataset.withColumns(
            {out: F.coalesce((F.col(c).cast("double") - m) / s, F.lit(0.0)) for c, out, m, s in stats}
        )


def onehot_counts(df: DataFrame, categorical: Sequence[str] = CATEGORICAL_FEATURES) -> DataFrame:
    """(feature, level, rows): how often each one-hot column is 1."""
    pairs = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("level")) for c in categorical))
    return df.select(F.inline(pairs)).filter("level IS NOT NULL").groupBy("feature", "level").agg(F.count("*").alias("rows"))


def feature_pipeline(
    categorical: Sequence[str] = CATEGORICAL_FEATURES, numeric: Sequence[str] = NUMERIC_FEATURES
) -> Pipeline:
    """Stages from feature columns to one sparse ``features`` vector.

    Every level seen in training gets its slot, in alphabetical order. An unseen level
    or NULL is indexed past the last level, which ``dropLast`` turns into all zeros.
    Spark ML rejects an empty level name, so the blank level is called ``(blank)``.
    """
    named = ", ".join(f"CASE WHEN `{c}` = '' THEN '(blank)' ELSE `{c}` END AS `_{c}_level`" for c in categorical)
    indexed = [f"_{c}_index" for c in categorical]
    encoded = [f"_{c}_onehot" for c in categorical]
    scaled = [f"_{c}_scaled" for c in numeric]
    stages = []
    if categorical:
        stages += [
            SQLTransformer(statement=f"SELECT *, {named} FROM __THIS__"),
            StringIndexer(
                inputCols=[f"_{c}_level" for c in categorical],
                outputCols=indexed,
                handleInvalid="keep",
                stringOrderType="alphabetAsc",
            ),
            OneHotEncoder(inputCols=indexed, outputCols=encoded, dropLast=True, handleInvalid="error"),
        ]
    if numeric:
        stages.append(PopulationScaler(inputCols=list(numeric), outputCols=scaled))
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=[*scaled, *encoded], outputCol="features")])


def feature_names(assembled: DataFrame, column: str = "features") -> list[str]:
    """Readable names of the vector's slots, e.g. ``class_Economy``."""
    attrs = assembled.schema[column].metadata["ml_attr"]["attrs"]
    slots = sorted((a["idx"], a["name"]) for kind in attrs.values() for a in kind)
    return [n.removeprefix("_").replace("_onehot_", "_", 1).removesuffix("_scaled") for _, n in slots]


def test_row(key_cols: Sequence[str], test_percent: int = 20, seed: int = 42) -> Column:
    """True for the rows held out for testing, by a hash of the row key."""
    return key_slot(key_cols, seed, 100) < test_percent


def hash_split(
    df: DataFrame, key_cols: Sequence[str], test_percent: int = 20, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """(train, test): the same rows on any cluster and partitioning."""
    held_out = test_row(key_cols, test_percent, seed)
    return df.filter(~held_out), df.filter(held_out)


def prepare(df: DataFrame, target: str = TARGET) -> DataFrame:
    """Feature columns and the target as ``label``; an error if the target is missing."""
    if target not in df.columns:
        raise ValueError(f"target column {target!r} not found")
    return df.drop(*LEAKAGE_COLUMNS, *NON_FEATURE_COLUMNS).withColumnRenamed(target, "label").withColumn(
        "label", F.col("label").cast("double")
    )
