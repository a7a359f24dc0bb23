"""Timestamps and date parts as Column expressions."""

from pyspark.sql import Column, functions as F

DATETIME_FORMAT = "yyyy-MM-dd HH:mm:ss"


def parse_datetime(col: Column, strict: bool = False) -> Column:
    """Timestamp of a text; NULL and blank give NULL. Other bad text gives NULL, or raises if ``strict``."""
    parse = F.to_timestamp if strict else F.try_to_timestamp
    return F.when(col.isNotNull() & (col != ""), parse(col, F.lit(DATETIME_FORMAT) if not strict else DATETIME_FORMAT))


def coerce_datetime(col: Column) -> Column:
    """Timestamp of text in any ISO-like form, NULL where it cannot be read."""
    return F.try_to_timestamp(col.cast("string"))


def weekday(col: Column, base: str = "sunday") -> Column:
    """Day of week counted from 0, starting at ``base`` ("sunday" or "monday")."""
    if base == "sunday":
        return F.dayofweek(col) - 1
    if base == "monday":
        return F.weekday(col)
    raise ValueError(f"weekday base must be 'sunday' or 'monday', not {base!r}")


def departure_parts(col: Column, weekday_base: str = "sunday") -> list[Column]:
    return [
        F.month(col).cast("int").alias("departure_month"),
        weekday(col, weekday_base).cast("int").alias("departure_weekday"),
        F.hour(col).cast("int").alias("departure_hour"),
    ]
