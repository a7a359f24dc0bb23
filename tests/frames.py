"""Small frames with Bronze columns, filled with defaults."""

from datetime import datetime
from decimal import Decimal

from farelake.schema import BRONZE, NUMERIC_TYPES

T0 = datetime(2024, 1, 1)
T1 = datetime(2024, 1, 2)
T2 = datetime(2024, 1, 3)

_DEFAULTS = {
    "airline": "Air", "source": "AAA", "source_name": "Alpha", "destination": "BBB", "destination_name": "Beta",
    "departure_datetime": "2024-03-03 10:00:00", "arrival_datetime": "2024-03-03 12:00:00", "duration_hrs": 2,
    "stopovers": "Direct", "aircraft_type": "Jet", "class": "Economy", "booking_source": "Web", "base_fare_bdt": 100,
    "tax_surcharge_bdt": 10, "total_fare_bdt": 110, "seasonality": "Regular", "days_before_departure": 5,
    "created_at": T0, "updated_at": T0,
}


def bronze(spark, *rows):
    """A Bronze frame; each row is a dict of what differs from the defaults."""
    out = []
    for i, row in enumerate(rows):
        values = {"id": i + 1, "booking_hash": f"k{i}", **_DEFAULTS, **row}
        for c in NUMERIC_TYPES:
            if values[c] is not None and c != "days_before_departure":
                values[c] = Decimal(str(values[c]))
        out.append([values[c] for c in BRONZE.fieldNames()])
    return spark.createDataFrame(out, BRONZE)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
