"""Registered queries: each operator run over the whole bookings feed."""

from datetime import datetime

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from checks.bookings import ROWS_PER_TASK, bookings
from farelake.functions.buckets import duration_bucket, duration_interval, lead_bucket, lead_interval
from farelake.functions.dates import coerce_datetime, departure_parts, parse_datetime
from farelake.functions.keys import key_slot
from farelake.functions.numeric import to_number
from farelake.operators import features, profile, quality, regression
from farelake.operators.merge import first_and_last, merge_by_key, newer_than, upsert
from farelake.plans import bronze as bronze_plan, gold, increment, training
from farelake.plans.refresh import refresh
from farelake.plans.silver import refresh_silver, to_silver
from farelake.schema import (
    BRONZE_TABLE, CATEGORICAL_FEATURES, CLASSES, FARE_COLUMNS, FEATURE_TABLE, INPUT_COLUMNS, KEY, KPI_TABLES,
    NUMERIC_FEATURES, SILVER_TABLE, TARGET,
)
from farelake.session import configure, free_shuffles, materialise, scratch, shared_folder
from farelake.sources import csv_files, versions
from farelake.sources.tables import bucket_count, catalog_frames, layer_counts, publish

# The feed arrives in two overlapping deliveries: what was booked before LOADED_UNTIL is
# in Bronze already; everything booked since REPRICED_FROM is sent (again) at new fares.
LOADED_UNTIL = datetime(2000, 1, 1)
REPRICED_FROM = datetime(1997, 1, 1)
REPRICED_AT = datetime(2002, 1, 1)
BATCH_TIME = datetime(2002, 1, 2)

# Order in which rows of one key count as sent.
SENT_ORDER = (
    "id", "total_fare_bdt", "base_fare_bdt", "tax_surcharge_bdt", "stopovers", "duration_hrs",
    "days_before_departure", "aircraft_type", "updated_at",
)
UPDATED = (*FARE_COLUMNS, "updated_at")


def portable(df: DataFrame, digits: int | None = None) -> DataFrame:
    """Types every engine returns alike: decimals as double, timestamps as text."""
    columns = []
    for field in df.schema.fields:
        col = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DecimalType):
            col = col.cast("double")
        elif isinstance(field.dataType, T.DoubleType) and digits is not None:
            col = F.round(col, digits)
        elif isinstance(field.dataType, T.TimestampType):
            col = F.date_format(col, "yyyy-MM-dd HH:mm:ss")
        columns.append(col.alias(field.name))
    return df.select(*columns)


def silver(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return to_silver(bookings(spark, sf_dir, *columns))


def _repriced(feed: DataFrame) -> DataFrame:
    """The second delivery: dearer by a tenth, and with stopovers that must not replace the first ones."""
    fares = {c: (F.col(c) * F.lit(1.1).cast("decimal(2,1)")).cast("decimal(15,6)") for c in FARE_COLUMNS}
    return feed.filter(F.col("updated_at") >= F.lit(REPRICED_FROM)).withColumns(
        fares | {"stopovers": F.lit("Direct"), "updated_at": F.lit(REPRICED_AT).cast("timestamp")}
    )


def _snapshot(feed: DataFrame) -> DataFrame:
    return first_and_last(feed.filter(F.col("updated_at") < F.lit(LOADED_UNTIL)), KEY, UPDATED, SENT_ORDER)


def _upserted(feed: DataFrame, snapshot: DataFrame | None = None) -> DataFrame:
    return upsert(_snapshot(feed) if snapshot is None else snapshot, _repriced(feed), KEY, UPDATED, SENT_ORDER)


# -- sources ----------------------------------------------------------------------------


def _write_csv(rows: DataFrame, folder: str) -> None:
    rows.write.csv(folder, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    free_shuffles(rows.sparkSession, folder)


def _by_id(rows: DataFrame) -> DataFrame:
    """Dealt out in the order of their ids, so that files and the rows in them lie in it; large feeds to more tasks."""
    parts = max(4, -(-rows.count() // ROWS_PER_TASK))
    return rows.repartitionByRange(parts, "id").sortWithinPartitions("id")


def _csv_folder(spark, sf_dir, by_id: bool = False) -> str:
    """The feed as CSV files of two kinds: columns in the usual order, and in reverse; files and rows by id if ``by_id``."""
    folder = shared_folder(spark)
    headers = {v: k for k, v in csv_files.CSV_COLUMNS.items()}
    with scratch(spark):
        rows = materialise(bookings(spark, sf_dir, "id", *INPUT_COLUMNS))
        for part, names in (("'A'", INPUT_COLUMNS), ("'B'", INPUT_COLUMNS[::-1])):
            kind = F.when(F.col("stopovers") == "Direct", "A").otherwise("B")
            own = rows.filter(kind == F.expr(part))
            _write_csv((_by_id(own) if by_id else own).select(*(F.col(c).alias(headers[c]) for c in names)), f"{folder}/{part[1]}")
    return folder


def file_manifest(spark, sf_dir):
    """Files of the feed, written as one of each kind."""
    folder = shared_folder(spark)
    rows = materialise(bookings(spark, sf_dir, "stopovers", "airline"))
    for part in ("stopovers = 'Direct'", "stopovers <> 'Direct'"):
        rows.filter(part).coalesce(1).write.mode("append").csv(folder, header=True)
    return csv_files.manifest_status(csv_files.file_manifest(spark, folder)).select("outcome", "files")


def publish_rebucketed(spark, sf_dir):
    """Keys of the feed, stored in 4 buckets, again in 8 with a column more, and merged with themselves."""
    root, table = shared_folder(spark), "bronze.rebucketed"
    keys = bookings(spark, sf_dir, KEY).distinct()
    publish(keys, table, root, KEY, 4)
    stored = publish(spark.table(table).withColumn("sent", F.lit(1)), table, root, KEY, 8)
    merged = publish(merge_by_key(stored, stored.filter("sent = 1"), KEY), table, root, KEY, 8, clustered=True)
    per_key = merged.groupBy(KEY).agg(F.count("*").alias("rows"))
    return per_key.agg(F.count("*").alias("keys"), F.sum("rows").alias("merged")).select(
        "keys", "merged", F.lit(len(merged.columns)).alias("stored_columns"),
        F.lit(bucket_count(spark, table)).alias("stored_buckets"),
    )


def csv_scan(spark, sf_dir):
    return csv_files.read_bookings_csv(spark, _csv_folder(spark, sf_dir)).select(*INPUT_COLUMNS)


def csv_scan_renamed(spark, sf_dir):
    rows = csv_files.read_bookings_csv(spark, _csv_folder(spark, sf_dir)).drop(*csv_files.POSITION)
    return portable(features.engineer_features(rows))


def raw_scan(spark, sf_dir):
    return portable(csv_files.read_profile_csv(spark, _csv_folder(spark, sf_dir)))


def csv_to_bronze(spark, sf_dir):
    """Bronze from files, all columns but the ids, which are numbered by task."""
    scan = csv_files.read_bookings_csv(spark, _csv_folder(spark, sf_dir, by_id=True))
    return portable(bronze_plan.load_bronze(None, scan, BATCH_TIME).drop("id"))


def load_cascade(spark, sf_dir):
    configure(spark)
    silver(spark, sf_dir).createOrReplaceTempView("_cascade_silver")
    tables = {"gold": "_cascade_gold", "silver": "_cascade_silver", "bronze": "_cascade_bronze"}
    return portable(training.load_data(spark, "auto", tables=tables))


def load_cascade_bronze(spark, sf_dir):
    """Model input where only Bronze has rows."""
    configure(spark)
    bookings(spark, sf_dir).createOrReplaceTempView("_cascade_only_bronze")
    tables = {"gold": "_cascade_none", "silver": "_cascade_none", "bronze": "_cascade_only_bronze"}
    return portable(training.load_data(spark, "auto", tables=tables))


def load_cascade_gold(spark, sf_dir):
    """Model input where the feature table has rows, which is taken as it is."""
    gold.ml_features(silver(spark, sf_dir), carry=["id"]).createOrReplaceTempView("_cascade_only_gold")
    return portable(training.load_data(spark, "postgres", tables={"gold": "_cascade_only_gold"}))


def load_cascade_csv(spark, sf_dir):
    """Model input from files, all of them."""
    configure(spark)
    tables = {layer: "_cascade_none" for layer in ("gold", "silver", "bronze")}
    return portable(training.load_data(spark, "auto", _csv_folder(spark, sf_dir), tables))


def _drop_layers(spark: SparkSession) -> None:
    """Drop the entries of layers, tables or views, that another run has left in the catalog; files stay."""
    for table in (BRONZE_TABLE, SILVER_TABLE, FEATURE_TABLE, *KPI_TABLES):
        if spark.catalog.databaseExists(table.split(".")[0]):
            versions._drop(spark, table)


def refresh_twice(spark, sf_dir):
    """Rows of Bronze and Silver after each of two deliveries of files, with all layers renewed between."""
    folder, root = shared_folder(spark), shared_folder(spark)
    _drop_layers(spark)
    rows = materialise(bookings(spark, sf_dir, *INPUT_COLUMNS, "updated_at"))
    headers = {v: k for k, v in csv_files.CSV_COLUMNS.items()}
    first, counts = F.col("updated_at") < F.lit(LOADED_UNTIL), []
    for delivery, (sent, now) in enumerate(((first, LOADED_UNTIL), (~first, BATCH_TIME)), 1):
        _write_csv(rows.filter(sent).select(*(F.col(c).alias(headers[c]) for c in INPUT_COLUMNS)), f"{folder}/{delivery}")
        refresh(spark, folder, root, now, buckets=8, check=False)
        tables = layer_counts(catalog_frames(spark, [BRONZE_TABLE, SILVER_TABLE]), spark).collect()
        counts += [(delivery, r["table_name"], r["row_count"]) for r in tables]
    return spark.createDataFrame(counts, "delivery int, table_name string, row_count long")


def _send(rows: DataFrame, folder: str) -> None:
    """Write a delivery as CSV files; rows lie in the order of their ids over all files."""
    headers = {v: k for k, v in csv_files.CSV_COLUMNS.items()}
    _write_csv(_by_id(rows).select(*(F.col(c).alias(headers[c]) for c in INPUT_COLUMNS)), folder)


def _deliveries(feed: DataFrame) -> list[tuple[datetime, DataFrame]]:
    """What was booked early, what was booked later, and a part of it again, dearer."""
    early = F.col("updated_at") < F.lit(REPRICED_FROM)
    return [(REPRICED_FROM, feed.filter(early)), (LOADED_UNTIL, feed.filter(~early)), (REPRICED_AT, _repriced(feed))]


def _load_by_month(spark, sf_dir, only_if_changed=False):
    """Bronze and Silver after three deliveries, each an increment; (Silver version, root)."""
    folder, root = shared_folder(spark), shared_folder(spark)
    with scratch(spark):
        feed = materialise(bookings(spark, sf_dir, "id", *INPUT_COLUMNS, "updated_at"))
        for i, (now, rows) in enumerate(_deliveries(feed)):
            _send(rows, f"{folder}/{i}")
            bronze, _ = increment.ingest(spark, folder, root, now, only_if_changed=only_if_changed)
            silver = increment.follow_silver(spark, root, bronze, now)
            for table in (BRONZE_TABLE, SILVER_TABLE):  # months that no version names any more
                versions.drop_unused(spark, root, table)
    _drop_layers(spark)  # versions are read by their records
    return silver, folder, root


def silver_increments(spark, sf_dir):
    """Silver after three deliveries, all columns but the ids, which are numbered by task."""
    silver, _, root = _load_by_month(spark, sf_dir)
    return portable(versions.read(spark, root, SILVER_TABLE, silver).drop("id", "processed_at", increment.PERIOD))


def season_increments(spark, sf_dir):
    """Fares by season after three deliveries, from sums that each delivery renewed for its months."""
    silver, _, root = _load_by_month(spark, sf_dir)
    increment.publish_kpis(spark, root, silver, BATCH_TIME)
    return portable(spark.table("gold.seasonal_fare_variation").drop("calculated_at"))


def unchanged_delivery(spark, sf_dir):
    """New Bronze rows, and rows that count as changed, when the last delivery is sent once more under other file names."""
    _, folder, root = _load_by_month(spark, sf_dir, only_if_changed=True)
    again = csv_files.read_bookings_csv(spark, f"{folder}/2")
    _send(again.withColumn("id", F.struct(*csv_files.POSITION)), f"{folder}/3")
    before = versions.latest(spark, root, BRONZE_TABLE)
    after, scan = increment.ingest(spark, folder, root, BATCH_TIME, only_if_changed=True)
    _drop_layers(spark)
    rows = versions.read(spark, root, BRONZE_TABLE, after)
    counts = rows.agg(F.count("*").alias("rows"), F.count_if(F.col("updated_at") == F.lit(BATCH_TIME)).alias("changed_rows"))
    months = sum(before.parts[p] != folder for p, folder in after.parts.items())
    return scan.agg(F.count("*").alias("sent_rows")).join(counts, F.lit(True)).withColumn("changed_months", F.lit(months))


def file_ledger(spark, sf_dir):
    """Files read by each of three runs over a folder: first all, then none, then the one that was sent again."""
    folder, root = shared_folder(spark), shared_folder(spark)
    feed = materialise(bookings(spark, sf_dir, "id", *INPUT_COLUMNS))
    counts = []
    for run, rows in enumerate((feed, None, feed.filter("stopovers = 'Direct'"))):
        if rows is not None:
            _send(rows, f"{folder}/{run}")
        _, scan = increment.ingest(spark, folder, root, BATCH_TIME)
        counts.append((run, 0 if scan is None else scan.count()))
    _drop_layers(spark)
    return spark.createDataFrame(counts, "run int, rows_read long")


def layers(spark, sf_dir):
    feed = materialise(bookings(spark, sf_dir))
    clean = to_silver(feed)
    frames = {BRONZE_TABLE: _upserted(feed), SILVER_TABLE: clean, FEATURE_TABLE: gold.ml_features(clean)}
    frames |= {name: model(clean) for name, model in gold.KPI_MODELS.items()}
    return layer_counts(frames | {"gold.not_built": None}, spark)


# -- Bronze and Silver ---------------------------------------------------------------------


def booking_hash(spark, sf_dir):
    return bookings(spark, sf_dir, "id", KEY)


def _as_text(spark, sf_dir, *columns):
    rows = bookings(spark, sf_dir, *INPUT_COLUMNS, *columns)
    return rows.select(*(F.col(c).cast("string") for c in INPUT_COLUMNS), *columns)


def bronze_clean_text(spark, sf_dir):
    padded = F.concat(F.lit("\t"), F.col("airline"), F.lit("\n "))
    scan = _as_text(spark, sf_dir, "id").withColumn("airline", padded)
    rows = bronze_plan.to_bronze_rows(scan, BATCH_TIME, nan_as_text=True)
    return rows.select("id", *(c for c in INPUT_COLUMNS if c not in bronze_plan.NUMERIC_TYPES))


def bronze_numeric_cast(spark, sf_dir):
    noisy = F.when(F.col("stopovers") == "Direct", F.concat("total_fare_bdt", F.lit("5"))).otherwise("n.a.")
    lead = F.concat(F.col("days_before_departure").cast("string"), F.lit(".9"))
    scan = _as_text(spark, sf_dir, "id").withColumns({"total_fare_bdt": noisy, "days_before_departure": lead})
    return portable(bronze_plan.to_bronze_rows(scan, BATCH_TIME).select("id", *bronze_plan.NUMERIC_TYPES))


def bronze_upsert(spark, sf_dir):
    feed = materialise(bookings(spark, sf_dir))
    return portable(_upserted(feed, materialise(_snapshot(feed), KEY)))


def bronze_view(spark, sf_dir):
    return portable(bronze_plan.bronze_view(bookings(spark, sf_dir)))


def silver_clean(spark, sf_dir):
    return portable(silver(spark, sf_dir))


def parse_timestamps(spark, sf_dir):
    rows = bookings(spark, sf_dir, "id", "departure_datetime", "arrival_datetime")
    both = {c: parse_datetime(F.col(c)) for c in ("departure_datetime", "arrival_datetime")}
    return portable(rows.withColumns(both))


def coerce_parse(spark, sf_dir):
    rows = _as_text(spark, sf_dir, "id")
    # Half of the texts are dates without a time, or no dates and numbers at all.
    text = F.when(F.col("stopovers") == "Direct", F.substring("departure_datetime", 1, 10)).otherwise(
        F.when(F.col("stopovers") == "1 Stop", F.col("departure_datetime")).otherwise("soon")
    )
    hours = F.when(F.col("stopovers") == "2 Stops", "long").otherwise(F.col("duration_hrs"))
    return portable(
        rows.select(
            "id",
            coerce_datetime(text).alias("departure_datetime"),
            to_number(hours).alias("duration_hrs"),
            to_number(F.col("days_before_departure")).alias("days_before_departure"),
        )
    )


def _bucket_counts(rows, **buckets):
    return rows.select(*rows.columns, *(col.alias(n) for n, col in buckets.items())).groupBy(
        *rows.columns, *buckets
    ).agg(F.count("*").alias("rows"))


def duration_buckets(spark, sf_dir):
    rows = silver(spark, sf_dir, "duration_hrs").select("duration_hrs")
    return portable(_bucket_counts(rows, bucket=duration_bucket(F.col("duration_hrs"))))


def lead_buckets(spark, sf_dir):
    rows = silver(spark, sf_dir, "days_before_departure").select("days_before_departure")
    return _bucket_counts(rows, bucket=lead_bucket(F.col("days_before_departure")))


def cut_buckets(spark, sf_dir):
    rows = bookings(spark, sf_dir, "duration_hrs", "days_before_departure")
    hours, lead = F.col("duration_hrs"), F.col("days_before_departure")
    return portable(
        _bucket_counts(rows, duration_bucket=duration_interval(hours), booking_lead_bucket=lead_interval(lead))
    )


def silver_incremental_delta(spark, sf_dir):
    feed = bookings(spark, sf_dir, "id", KEY, TARGET, "updated_at")
    loaded = feed.filter(F.col("updated_at") < F.lit(LOADED_UNTIL))
    return portable(newer_than(feed, loaded, "updated_at"))


def silver_merge(spark, sf_dir):
    feed = materialise(bookings(spark, sf_dir))
    snapshot = materialise(_snapshot(feed), KEY)  # which both layers start from
    before = to_silver(snapshot, BATCH_TIME)
    bronze = materialise(_upserted(feed, snapshot), KEY)
    return portable(refresh_silver(bronze, before, BATCH_TIME).drop("processed_at"))


# -- Gold ----------------------------------------------------------------------------------


def _kpi(model, *columns):
    return lambda spark, sf_dir: portable(model(silver(spark, sf_dir, *columns)))


def ml_features(spark, sf_dir):
    return portable(gold.ml_features(silver(spark, sf_dir), carry=["id"]))


def _parts(base):
    def run(spark, sf_dir):
        stamp = parse_datetime(F.col("departure_datetime"))
        rows = bookings(spark, sf_dir, "departure_datetime").select(stamp.alias("t"))
        return rows.groupBy(*departure_parts(F.col("t"), base)).agg(F.count("*").alias("rows"))

    return run


# -- quality -------------------------------------------------------------------------------


def duplicate_keys(spark, sf_dir):
    return quality.duplicate_values(bookings(spark, sf_dir, KEY), KEY).agg(F.count("*").alias("repeated_keys"))


def dq_unique(spark, sf_dir):
    return quality.duplicate_values(bookings(spark, sf_dir, "id"), "id")


def dq_not_null(spark, sf_dir):
    rows = silver(spark, sf_dir)
    return quality.null_counts(rows, [c for c in rows.columns if c not in ("created_at",)])


def dq_accepted_values(spark, sf_dir):
    domain = [c for c in CLASSES if c != "Business"]
    return quality.unexpected_values(bookings(spark, sf_dir, "class"), "class", domain)


def bronze_gate(spark, sf_dir):
    return quality.bronze_gate(bookings(spark, sf_dir, "airline", "source", "destination", KEY, *FARE_COLUMNS))


def lost_cells(spark, sf_dir):
    """Two kinds of stopovers are sent with a fare or a time that is none."""
    scan = _as_text(spark, sf_dir)
    fare = F.when(F.col("stopovers") == "Direct", F.lit("n.a.")).otherwise(F.col("total_fare_bdt"))
    soon = F.when(F.col("stopovers") == "1 Stop", F.lit("soon")).otherwise(F.col("departure_datetime"))
    return quality.lost_cells(scan.withColumns({"total_fare_bdt": fare, "departure_datetime": soon}))


def silver_gate(spark, sf_dir):
    feed = bookings(spark, sf_dir, KEY, "updated_at", "id")
    kept = feed.filter(F.col("updated_at") < F.lit(LOADED_UNTIL))
    return portable(quality.silver_gate(feed, kept))


def gold_gate(spark, sf_dir):
    clean = materialise(silver(spark, sf_dir))
    tables = {FEATURE_TABLE: gold.ml_features(clean)}
    tables |= {name: model(clean) for name, model in gold.KPI_MODELS.items() if name != KPI_TABLES[-1]}
    return quality.gold_gate(spark, tables)


def dq_suite(spark, sf_dir):
    feed = materialise(bookings(spark, sf_dir))
    clean = materialise(to_silver(feed))
    tables = {BRONZE_TABLE: feed, SILVER_TABLE: clean, FEATURE_TABLE: gold.ml_features(clean)}
    tables |= {name: model(clean) for name, model in gold.KPI_MODELS.items()}
    # Row checks and unique tests pass over a table each, so a model runs once for both.
    return quality.run_checks({name: df if name in (BRONZE_TABLE, SILVER_TABLE) else materialise(df) for name, df in tables.items()})


# -- profiling -----------------------------------------------------------------------------


def _raw(spark, sf_dir, *columns):
    """The feed as profiling sees it: blank cells are missing."""
    rows = bookings(spark, sf_dir, *columns)
    text = [f.name for f in rows.schema.fields if isinstance(f.dataType, T.StringType)]
    return rows.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in text})


def eda_fare_by_airline(spark, sf_dir):
    return portable(profile.mean_by(_raw(spark, sf_dir, "airline", TARGET), "airline", TARGET), 4)


def eda_popular_routes(spark, sf_dir):
    return profile.largest_groups(_raw(spark, sf_dir, "source", "destination"), ["source", "destination"], 10)


def eda_expensive_routes(spark, sf_dir):
    rows = _raw(spark, sf_dir, "source", "destination", TARGET)
    return portable(profile.highest_means(rows, ["source", "destination"], TARGET, 5), 4)


def eda_seasonal(spark, sf_dir):
    return portable(profile.mean_by(_raw(spark, sf_dir, "seasonality", TARGET), "seasonality", TARGET, spread=True), 4)


def fare_histogram(spark, sf_dir):
    return portable(profile.histogram(bookings(spark, sf_dir, TARGET), TARGET), 4)


def fare_centre(spark, sf_dir):
    return portable(profile.centre(bookings(spark, sf_dir, TARGET), TARGET), 4)


def fare_boxplot(spark, sf_dir):
    return portable(profile.box_stats(_raw(spark, sf_dir, "airline", TARGET), "airline", TARGET), 4)


def avg_fare_by_season(spark, sf_dir):
    rows = _raw(spark, sf_dir, "seasonality", TARGET)
    return portable(profile.mean_by(rows, "seasonality", TARGET).select("seasonality", "mean"), 4)


def avg_fare_by_month(spark, sf_dir):
    rows = bookings(spark, sf_dir, "departure_datetime", TARGET)
    month = F.month(parse_datetime(F.col("departure_datetime"))).alias("departure_month")
    by_month = profile.mean_by(rows.select(month, TARGET), "departure_month", TARGET)
    return portable(by_month.select("departure_month", "mean").orderBy("departure_month"), 4)


_NUMBERS = ("duration_hrs", *FARE_COLUMNS, "days_before_departure")


def correlation_matrix(spark, sf_dir):
    return portable(profile.correlation_matrix(bookings(spark, sf_dir, *_NUMBERS)), 6)


def describe_numeric(spark, sf_dir):
    return portable(profile.describe(bookings(spark, sf_dir, *_NUMBERS)), 4)


def missing_values(spark, sf_dir):
    return profile.missing_values(_raw(spark, sf_dir, *INPUT_COLUMNS))


def feed_shape(spark, sf_dir):
    return profile.shape(_raw(spark, sf_dir, *INPUT_COLUMNS))


# -- features ------------------------------------------------------------------------------


def drop_leakage(spark, sf_dir):
    return portable(features.drop_leakage(bookings(spark, sf_dir)))


def drop_null_target(spark, sf_dir):
    rows = bookings(spark, sf_dir, "id", "duration_hrs", TARGET)
    return portable(features.drop_null_target(rows, "duration_hrs"))


def engineer_features(spark, sf_dir):
    return portable(features.engineer_features(silver(spark, sf_dir)))


def _features(spark, sf_dir):
    return gold.ml_features(silver(spark, sf_dir), carry=[KEY])


def onehot_level_counts(spark, sf_dir):
    return features.onehot_counts(_features(spark, sf_dir))


def onehot_features(spark, sf_dir):
    rows = materialise(features.prepare(_features(spark, sf_dir)))
    encoded = features.feature_pipeline(CATEGORICAL_FEATURES, NUMERIC_FEATURES).fit(rows).transform(rows)
    # Column sums of the encoded vectors: for a one-hot slot, how many rows have that level.
    sums = encoded.select(Summarizer.sum(F.col("features")).alias("sums")).select(vector_to_array("sums").alias("sums"))
    names = F.array(*(F.lit(n) for n in features.feature_names(encoded)))
    slots = sums.select(F.inline(F.arrays_zip(names.alias("slot"), F.col("sums").alias("rows"))))
    return slots.filter(~F.col("slot").isin(*NUMERIC_FEATURES)).select("slot", F.col("rows").cast("bigint").alias("rows"))


def scaled_features(spark, sf_dir):
    rows = materialise(gold.ml_features(silver(spark, sf_dir), carry=["id"]).select("id", *NUMERIC_FEATURES))
    stats = features.scaling_stats(rows, NUMERIC_FEATURES)
    return portable(features.scale(rows, stats).select("id", *NUMERIC_FEATURES), 6)


def train_test_split(spark, sf_dir):
    train, test = features.hash_split(bookings(spark, sf_dir, "id", KEY), [KEY])
    fold = key_slot([KEY], 43, 5).alias("fold")
    parts = train.select(F.lit("train").alias("part"), fold).unionByName(test.select(F.lit("test").alias("part"), fold))
    return parts.groupBy("part", "fold").agg(F.count("*").alias("rows"))


# -- models --------------------------------------------------------------------------------


def _class_mean(spark, sf_dir):
    """A predictor in closed form: the mean fare of the travel class."""
    rows = bookings(spark, sf_dir, "class", TARGET).select("class", F.col(TARGET).cast("double").alias("label"))
    rows = materialise(rows)
    # Stored, so that its size is known: a row for each class.
    means = materialise(rows.groupBy("class").agg(F.avg("label").alias("prediction")))
    return rows.join(means, "class").select(F.lit("class mean").alias("model"), "label", "prediction")


def model_metrics(spark, sf_dir):
    return regression.regression_metrics(_class_mean(spark, sf_dir))


def residual_histogram(spark, sf_dir):
    return portable(regression.residual_histogram(_class_mean(spark, sf_dir)), 4)


def prediction_limits(spark, sf_dir):
    return portable(regression.axis_limits(_class_mean(spark, sf_dir)), 4)


def pred_vs_actual(spark, sf_dir):
    return portable(regression.prediction_pairs(_class_mean(spark, sf_dir)).groupBy("model", "prediction").agg(
        F.count("*").alias("points"), F.max("residual").alias("largest_residual")
    ), 4)


def metric_comparison(spark, sf_dir):
    return regression.metrics_long(regression.regression_metrics(_class_mean(spark, sf_dir)))


def score_batch(spark, sf_dir):
    """One-feature least squares, whose predictions have a closed form to check against."""
    columns = ("id", "departure_datetime", "duration_hrs", "days_before_departure", TARGET)
    inputs = materialise(silver(spark, sf_dir, *columns).select(*columns))
    encoder = features.feature_pipeline([], ["duration_hrs"])
    train = inputs.withColumn("label", F.col(TARGET).cast("double"))
    fitted = Pipeline(stages=[*encoder.getStages(), regression.least_squares()]).fit(train)
    scored = training.score(fitted, inputs.select("id", "departure_datetime", "duration_hrs", "days_before_departure"))
    return portable(scored.select("id", "predicted_fare_bdt", "predicted_fare_usd"), 2)


def _one_kind(name):
    """One regressor on all features, with the whole grid and five folds."""

    def run(spark, sf_dir):
        grid = {name: regression.model_grid()[name]}
        return training.train_run(_features(spark, sf_dir), grid, key_cols=[KEY])[0]

    return run


def tree_models(spark, sf_dir):
    """The three kinds of trees on the travel class alone, in settings whose predictions have a closed form."""
    trees = {
        "Decision Tree": DecisionTreeRegressor(maxDepth=2, seed=42),
        "Random Forest": RandomForestRegressor(numTrees=1, maxDepth=2, bootstrap=False, featureSubsetStrategy="all", seed=42),
        "Gradient Boosting": GBTRegressor(maxIter=1, maxDepth=2, stepSize=1.0, seed=42),
    }
    rows = _features(spark, sf_dir).select(KEY, "class", TARGET)
    return training.train_run(rows, {n: (t, {}) for n, t in trees.items()}, [KEY], folds=LINE_FOLDS)[0]


# Linear models of one feature have closed forms, which SQL can follow through the split,
# the scaling, the folds and the scores.
LINE_FOLDS = 5
RIDGE_ALPHAS = (0.01, 0.1, 1.0, 10.0, 100.0)


def _line_grid(**alphas):
    linear = {
        "Linear Regression": (regression.least_squares(), {}),
        "Ridge": (regression.PenalisedRegression(penalty="ridge"), {"alpha": alphas.get("ridge", [])}),
        "Lasso": (regression.PenalisedRegression(penalty="lasso", maxIter=5000), {"alpha": alphas.get("lasso", [])}),
    }
    return {name: entry for name, entry in linear.items() if name == "Linear Regression" or entry[1]["alpha"]}


def _line_run(spark, sf_dir, **alphas):
    rows = _features(spark, sf_dir).select(KEY, "duration_hrs", TARGET)
    return training.train_run(rows, _line_grid(**alphas), [KEY], folds=LINE_FOLDS)


def tune_models(spark, sf_dir):
    tuned = _line_run(spark, sf_dir, ridge=list(RIDGE_ALPHAS))[0]
    return tuned.select("model", "cv_mean_r2", "cv_std_r2")


def cv_scores(spark, sf_dir):
    return _line_run(spark, sf_dir)[0].select("model", "cv_mean_r2", "cv_std_r2")


def model_comparison(spark, sf_dir):
    return _line_run(spark, sf_dir, ridge=[10.0], lasso=[1.0])[0]


def training_run(spark, sf_dir):
    """A whole training run over the feature table, and the metrics that it left on file."""
    view = "_training_gold"
    _features(spark, sf_dir).select(KEY, "duration_hrs", TARGET).createOrReplaceTempView(view)
    path = shared_folder(spark)
    grid = _line_grid(ridge=[10.0], lasso=[1.0])
    training.train_and_store(spark, path, "postgres", tables={"gold": view}, grid=grid, key_cols=[KEY], folds=LINE_FOLDS)
    return training.stored_metrics(spark, path)


def resumed_search(spark, sf_dir):
    """Scores of a search that was run for a part of its settings before."""
    _, train, _ = training.vectorise(_features(spark, sf_dir).select(KEY, "duration_hrs", TARGET), [KEY], LINE_FOLDS)
    scores = shared_folder(spark)
    regression.tune(train, _line_grid(ridge=list(RIDGE_ALPHAS[:2])), LINE_FOLDS, scores=scores)
    return regression.tune(train, _line_grid(ridge=list(RIDGE_ALPHAS)), LINE_FOLDS, scores=scores)[1]


def tree_importance(spark, sf_dir):
    """Importances of the travel classes in a tree of one split: that which parts the fares best has all."""
    encoder, train, _ = training.vectorise(_features(spark, sf_dir).select(KEY, "class", TARGET), [KEY])
    model = DecisionTreeRegressor(maxDepth=1, seed=42).fit(train)
    return regression.feature_importance(model, features.feature_names(train))


def best_model(spark, sf_dir):
    """Name and metrics stored beside the best of three models."""
    comparison, models, encoder, _ = _line_run(spark, sf_dir, ridge=[100000.0], lasso=[50.0])
    path = shared_folder(spark)
    training.save_best(comparison, models, encoder, path)
    return training.describe_model(spark, path).select("model", "r2", "mae", "rmse", "cv_mean_r2", "cv_std_r2")


def model_roundtrip(spark, sf_dir):
    """Fares predicted by a model that was stored and loaded again."""
    comparison, models, encoder, _ = _line_run(spark, sf_dir)
    path = shared_folder(spark)
    training.save_best(comparison, models, encoder, path)
    model, _ = training.load_model(spark, path)
    columns = ("id", "duration_hrs", "days_before_departure")
    scored = training.score(model, silver(spark, sf_dir, *columns).select(*columns))
    return portable(scored.select("id", "predicted_fare_bdt", "predicted_fare_usd"), 2)


def feature_importance(spark, sf_dir):
    """Importances of least squares on all features."""
    _, train, _ = training.vectorise(_features(spark, sf_dir), [KEY])
    model = regression.least_squares().fit(train)
    return regression.feature_importance(model, features.feature_names(train))


QUERIES = {
    "file_manifest": file_manifest,
    "csv_scan": csv_scan,
    "csv_scan_renamed": csv_scan_renamed,
    "raw_scan": raw_scan,
    "csv_to_bronze": csv_to_bronze,
    "publish_rebucketed": publish_rebucketed,
    "refresh_twice": refresh_twice,
    "silver_increments": silver_increments,
    "season_increments": season_increments,
    "unchanged_delivery": unchanged_delivery,
    "file_ledger": file_ledger,
    "load_cascade": load_cascade,
    "load_cascade_bronze": load_cascade_bronze,
    "load_cascade_gold": load_cascade_gold,
    "load_cascade_csv": load_cascade_csv,
    "layer_counts": layers,
    "booking_hash": booking_hash,
    "bronze_clean_text": bronze_clean_text,
    "bronze_numeric_cast": bronze_numeric_cast,
    "bronze_upsert": bronze_upsert,
    "bronze_view": bronze_view,
    "silver_clean": silver_clean,
    "parse_timestamps": parse_timestamps,
    "coerce_parse": coerce_parse,
    "duration_bucket": duration_buckets,
    "lead_bucket": lead_buckets,
    "cut_buckets": cut_buckets,
    "silver_incremental_delta": silver_incremental_delta,
    "silver_merge": silver_merge,
    "avg_fare_by_airline": _kpi(gold.avg_fare_by_airline, "airline", *FARE_COLUMNS),
    "avg_fare_by_class": _kpi(gold.avg_fare_by_class, "class", *FARE_COLUMNS),
    "avg_fare_by_route": _kpi(gold.avg_fare_by_route, *gold.ROUTE, "duration_hrs", TARGET),
    "seasonal_fare_variation": _kpi(gold.seasonal_fare_variation, "seasonality", *FARE_COLUMNS),
    "booking_count_by_airline": _kpi(gold.booking_count_by_airline, "airline"),
    "top_routes": _kpi(gold.top_routes, *gold.ROUTE, TARGET),
    "ml_features": ml_features,
    "departure_parts": _parts("sunday"),
    "departure_parts_monday": _parts("monday"),
    "duplicate_keys": duplicate_keys,
    "dq_unique": dq_unique,
    "dq_not_null": dq_not_null,
    "dq_accepted_values": dq_accepted_values,
    "bronze_gate": bronze_gate,
    "lost_cells": lost_cells,
    "silver_gate": silver_gate,
    "gold_gate": gold_gate,
    "dq_suite": dq_suite,
    "eda_fare_by_airline": eda_fare_by_airline,
    "eda_popular_routes": eda_popular_routes,
    "eda_expensive_routes": eda_expensive_routes,
    "eda_seasonal": eda_seasonal,
    "fare_histogram": fare_histogram,
    "fare_centre": fare_centre,
    "fare_boxplot": fare_boxplot,
    "avg_fare_by_season": avg_fare_by_season,
    "avg_fare_by_month": avg_fare_by_month,
    "correlation_matrix": correlation_matrix,
    "describe_numeric": describe_numeric,
    "missing_values": missing_values,
    "feed_shape": feed_shape,
    "drop_leakage": drop_leakage,
    "drop_null_target": drop_null_target,
    "engineer_features": engineer_features,
    "onehot_level_counts": onehot_level_counts,
    "onehot_features": onehot_features,
    "scaled_features": scaled_features,
    "train_test_split": train_test_split,
    "model_metrics": model_metrics,
    "residual_histogram": residual_histogram,
    "prediction_limits": prediction_limits,
    "pred_vs_actual": pred_vs_actual,
    "metric_comparison": metric_comparison,
    "score_batch": score_batch,
    "tree_models": tree_models,
    "train_linear": _one_kind("Linear Regression"),
    "train_ridge": _one_kind("Ridge"),
    "train_lasso": _one_kind("Lasso"),
    "train_decision_tree": _one_kind("Decision Tree"),
    "tune_models": tune_models,
    "cv_scores": cv_scores,
    "model_comparison": model_comparison,
    "feature_importance": feature_importance,
    "tree_importance": tree_importance,
    "training_run": training_run,
    "resumed_search": resumed_search,
    "best_model": best_model,
    "model_roundtrip": model_roundtrip,
}
