"""Column names, types and value domains shared by every layer."""

from pyspark.sql import types as T

KEY = "booking_hash"
TARGET = "total_fare_bdt"

# Input header -> column name.
CSV_COLUMNS = {
    "Airline": "airline",
    "Source": "source",
    "Source Name": "source_name",
    "Destination": "destination",
    "Destination Name": "destination_name",
    "Departure Date & Time": "departure_datetime",
    "Arrival Date & Time": "arrival_datetime",
    "Duration (hrs)": "duration_hrs",
    "Stopovers": "stopovers",
    "Aircraft Type": "aircraft_type",
    "Class": "class",
    "Booking Source": "booking_source",
    "Base Fare (BDT)": "base_fare_bdt",
    "Tax & Surcharge (BDT)": "tax_surcharge_bdt",
    "Total Fare (BDT)": "total_fare_bdt",
    "Seasonality": "seasonality",
    "Days Before Departure": "days_before_departure",
}

# Input columns that the profiling scan leaves under their CSV name.
PROFILE_KEEPS_HEADER = ("Source Name", "Destination Name", "Arrival Date & Time")

# The six columns behind the booking key, in hashing order.
KEY_COLUMNS = ("airline", "source", "destination", "departure_datetime", "class", "booking_source")

# Cells that a CSV reader of the pandas kind takes as missing.
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

FARE = T.DecimalType(15, 6)
HOURS = T.DecimalType(10, 4)
KPI = T.DecimalType(18, 2)

NUMERIC_TYPES = {
    "duration_hrs": HOURS,
    "base_fare_bdt": FARE,
    "tax_surcharge_bdt": FARE,
    "total_fare_bdt": FARE,
    "days_before_departure": T.IntegerType(),
}
FARE_COLUMNS = ("base_fare_bdt", "tax_surcharge_bdt", "total_fare_bdt")
INPUT_COLUMNS = tuple(CSV_COLUMNS.values())
TEXT_COLUMNS = tuple(c for c in INPUT_COLUMNS if c not in NUMERIC_TYPES)
# Text columns that Silver trims; the two datetimes are parsed instead.
LABEL_COLUMNS = tuple(c for c in TEXT_COLUMNS if not c.endswith("_datetime"))

BRONZE = T.StructType(
    [T.StructField("id", T.LongType()), T.StructField(KEY, T.StringType(), False)]
    + [T.StructField(c, NUMERIC_TYPES.get(c, T.StringType())) for c in INPUT_COLUMNS]
    + [T.StructField("created_at", T.TimestampType()), T.StructField("updated_at", T.TimestampType())]
)

# Bucket limits (inclusive upper ends) and labels.
DURATION_LIMITS = (3, 6)
DURATION_LABELS = ("Short (0-3h)", "Medium (3-6h)", "Long (6+h)")
LEAD_LIMITS = (3, 14, 30)
LEAD_LABELS = (
    "Last Minute (0-3 days)", "Short Notice (4-14 days)", "Standard (15-30 days)", "Early Bird (30+ days)",
)

# Accepted domains and the seasons reported as peak.
STOPOVERS = ("Direct", "1 Stop", "2 Stops")
CLASSES = ("Economy", "Business", "First Class")
SEASONS = ("Regular", "Eid", "Hajj", "Winter Holidays")
PEAK_SEASONS = ("Eid", "Hajj", "Winter")

# Model inputs.
CATEGORICAL_FEATURES = (
    "airline", "source", "destination", "class", "stopovers", "booking_source", "seasonality",
    "duration_bucket", "booking_lead_bucket", "aircraft_type",
)
NUMERIC_FEATURES = (
    "duration_hrs", "days_before_departure", "departure_month", "departure_weekday", "departure_hour",
)

# Columns that would leak the target, and columns that are no features.
LEAKAGE_COLUMNS = ("base_fare_bdt", "tax_surcharge_bdt", "base_fare", "tax_surcharge")
NON_FEATURE_COLUMNS = (
    "id", "booking_hash", "departure_datetime", "arrival_datetime", "created_at", "updated_at",
    "processed_at", "source_name", "destination_name",
)

# Table names per layer.
BRONZE_TABLE = "bronze.raw_flight_prices"
SILVER_TABLE = "silver.stg_flight_prices"
FEATURE_TABLE = "gold.ml_features"
KPI_TABLES = (
    "gold.avg_fare_by_airline", "gold.avg_fare_by_class", "gold.avg_fare_by_route",
    "gold.booking_count_by_airline", "gold.seasonal_fare_variation", "gold.top_routes",
)

# Fixed value: fare units per US dollar.
USD_RATE = 120
