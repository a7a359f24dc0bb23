"""Labelled ranges as Column expressions."""

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from farelake.schema import DURATION_LABELS, DURATION_LIMITS, LEAD_LABELS, LEAD_LIMITS


def _ladder(col: Column, limits: Sequence, labels: Sequence[str]) -> Column:
    out = F.when(col <= limits[0], labels[0])
    for limit, label in zip(limits[1:], labels[1:]):
        out = out.when(col <= limit, label)
    return out


def upper_bucket(col: Column, limits: Sequence, labels: Sequence[str]) -> Column:
    """Label of the first inclusive upper limit reached; the last label for all else, NULL included."""
    return _ladder(col, limits, labels).otherwise(labels[-1])


def interval_bucket(col: Column, limits: Sequence, labels: Sequence[str], outside: str = "nan") -> Column:
    """As :func:`upper_bucket` over (0, inf); values outside it and NULL get ``outside``."""
    inside = _ladder(col, limits, labels).otherwise(labels[-1])
    return F.when(col > 0, inside).otherwise(outside)


def duration_bucket(col: Column) -> Column:
    return upper_bucket(col, DURATION_LIMITS, DURATION_LABELS)


def lead_bucket(col: Column) -> Column:
    return upper_bucket(col, LEAD_LIMITS, LEAD_LABELS)


def duration_interval(col: Column) -> Column:
    return interval_bucket(col, DURATION_LIMITS, DURATION_LABELS)


def lead_interval(col: Column) -> Column:
    return interval_bucket(col, LEAD_LIMITS, LEAD_LABELS)
