"""Silver: cleaned, typed and bucketed bookings."""

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from farelake.functions.buckets import duration_bucket, lead_bucket
from farelake.functions.dates import parse_datetime
from farelake.functions.numeric import non_negative
from farelake.operators.merge import merge_by_key, newer_than
from farelake.schema import FARE, FARE_COLUMNS, HOURS, KEY, LABEL_COLUMNS


def to_silver(bronze: DataFrame, now: datetime | None = None, strict_datetimes: bool = False) -> DataFrame:
    """Clean Bronze rows; row count never changes.

    ``now`` is the batch time written to ``processed_at``; without it the column is left out.
    """
    cleaned = {c: F.trim(c) for c in LABEL_COLUMNS}
    cleaned |= {c: non_negative(F.col(c), FARE) for c in FARE_COLUMNS}
    cleaned |= {
        c: parse_datetime(F.col(c), strict_datetimes) for c in ("departure_datetime", "arrival_datetime")
    }
    cleaned["duration_hrs"] = F.coalesce("duration_hrs", F.lit(0).cast(HOURS))
    cleaned["days_before_departure"] = F.coalesce("days_before_departure", F.lit(0))
    silver = bronze.select(*(cleaned[c].alias(c) if c in cleaned else F.col(c) for c in bronze.columns))

    columns = []
    for name in silver.columns:
        columns.append(F.col(name))
        if name == "duration_hrs":
            columns.append(duration_bucket(F.col(name)).alias("duration_bucket"))
        if name == "days_before_departure":
            columns.append(lead_bucket(F.col(name)).alias("booking_lead_bucket"))
    if now is not None:
        columns.append(F.lit(now).cast("timestamp").alias("processed_at"))
    return silver.select(*columns)


def refresh_silver(
    bronze: DataFrame, silver: DataFrame | None, now: datetime, strict_datetimes: bool = False
) -> DataFrame:
    """Next Silver snapshot: only Bronze rows newer than the present one are cleaned again."""
    if silver is None:
        return to_silver(bronze, now, strict_datetimes)
    changed = to_silver(newer_than(bronze, silver, "updated_at"), now, strict_datetimes)
    return merge_by_key(silver, changed, KEY)
