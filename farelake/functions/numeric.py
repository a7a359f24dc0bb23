"""Numeric conversion and rounding as Column expressions."""

from pyspark.sql import Column, functions as F, types as T

from farelake.schema import KPI


def to_number(col: Column) -> Column:
    """Double from text; NULL for text that is no number and for NaN or infinities."""
    # Java accepts a type suffix ("12d"), which is no number in a data file.
    suffixed = F.lower(F.substring(F.trim(col), -1, 1)).isin("d", "f")
    value = F.when(~suffixed, col.try_cast("double"))
    finite = ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))
    return F.when(finite, value)


def to_numeric_type(col: Column, dtype: T.DataType) -> Column:
    """Text to the declared type: decimals round half up, integers truncate toward zero."""
    return to_number(col).try_cast(dtype)


def round2(col: Column) -> Column:
    """Two decimals, half away from zero, as the published KPI type."""
    return F.round(col.cast(T.DecimalType(38, 12)), 2).cast(KPI)


def non_negative(col: Column, dtype: T.DataType) -> Column:
    return F.greatest(F.coalesce(col, F.lit(0).cast(dtype)), F.lit(0).cast(dtype)).cast(dtype)
