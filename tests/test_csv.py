import hashlib
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from farelake.plans.bronze import load_bronze, to_bronze_rows
from farelake.plans.training import load_data
from farelake.schema import BRONZE, CSV_COLUMNS, KEY
from farelake.sources import csv_files
from farelake.sources.csv_files import (
    file_headers, file_manifest, manifest_status, read_bookings_csv, read_profile_csv,
)
from tests.frames import rows

NOW, LATER = datetime(2024, 5, 1), datetime(2024, 5, 2)
HEADERS = list(CSV_COLUMNS)
ROW = [
    "Air", "AAA", "Alpha", "BBB", "Beta", "2024-03-03 10:00:00", "2024-03-03 12:00:00", "2.0", "Direct", "Jet",
    "Economy", "Web", "100.5", "10", "110.5", "Regular", "5",
]


def write(path, header, *lines):
    path.write_text("\n".join([",".join(header), *(",".join(line) for line in lines)]) + "\n")


def row(**changes):
    names = list(CSV_COLUMNS.values())
    return [changes.get(n, v) for n, v in zip(names, ROW)]


@pytest.fixture
def folder(tmp_path):
    write(tmp_path / "Flight_Price_a.csv", HEADERS, row(), row(airline=" Pad ", stopovers=""))
    shuffled = HEADERS[::-1]
    write(
        tmp_path / "Flight_Price_b.csv",
        shuffled,
        row(airline='"Q ""x"", y"', total_fare_bdt="n/a")[::-1],
        row(total_fare_bdt="999.5", stopovers="2 Stops")[::-1],
    )
    keep = [i for i, h in enumerate(HEADERS) if h not in ("Class", "Days Before Departure")]
    short = row(airline="Short")
    write(tmp_path / "Flight_Price_c.csv", [HEADERS[i] for i in keep], [short[i] for i in keep])
    (tmp_path / "Flight_Price_d.csv").write_text("")
    write(tmp_path / "other.csv", HEADERS, row(airline="Other"))
    return tmp_path


def test_manifest_prefers_the_pattern_and_skips_empty_files(spark, folder):
    names = sorted(r.path.rsplit("/", 1)[1] for r in file_manifest(spark, str(folder)).collect())
    assert names == ["Flight_Price_a.csv", "Flight_Price_b.csv", "Flight_Price_c.csv"]
    assert manifest_status(file_manifest(spark, str(folder))).first().outcome == "found"


def test_manifest_falls_back_and_reports_missing(spark, tmp_path):
    assert manifest_status(file_manifest(spark, str(tmp_path))).first()[:2] == ("missing", 0)
    write(tmp_path / "x.csv", HEADERS, row())
    assert file_manifest(spark, str(tmp_path)).count() == 1
    (tmp_path / "Flight_Price_z.csv").write_text("")
    # Files match the first pattern, but all are empty.
    assert manifest_status(file_manifest(spark, str(tmp_path))).first().outcome == "missing"
    with pytest.raises(FileNotFoundError):
        read_bookings_csv(spark, str(tmp_path))


def test_columns_are_found_by_name(spark, folder):
    df = read_bookings_csv(spark, str(folder))
    assert rows(df, "airline", "source", "class", "stopovers", "total_fare_bdt", "days_before_departure") == sorted(
        [
            ("Air", "AAA", "Economy", "Direct", "110.5", "5"),
            (" Pad ", "AAA", "Economy", None, "110.5", "5"),
            ('Q "x", y', "AAA", "Economy", "Direct", None, "5"),
            ("Air", "AAA", "Economy", "2 Stops", "999.5", "5"),
            ("Short", "AAA", "", "Direct", "110.5", None),
        ],
        key=repr,
    )


def test_line_breaks_inside_cells(spark, tmp_path):
    write(tmp_path / "a.csv", HEADERS, row(airline='"two\nlines"'), row())
    assert rows(read_bookings_csv(spark, str(tmp_path), multi_line=True), "airline") == [("Air",), ("two\nlines",)]
    with pytest.raises(Exception, match="MALFORMED|FAILFAST"):  # read split, such a row is none
        read_bookings_csv(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("cells", [row() + ["surplus"], row()[:-1], row(airline="one, comma")])
def test_rows_of_another_length_raise(spark, tmp_path, cells):
    write(tmp_path / "a.csv", HEADERS, row(), cells)
    with pytest.raises(Exception, match="MALFORMED|FAILFAST"):
        read_bookings_csv(spark, str(tmp_path)).select("class").collect()
    assert read_bookings_csv(spark, str(tmp_path), mode="PERMISSIVE").count() == 2


def test_large_files_are_split(spark, tmp_path):
    write(tmp_path / "a.csv", HEADERS, *(row() for _ in range(2000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        scan = read_bookings_csv(spark, str(tmp_path))
        tasks = scan.select(F.spark_partition_id()).distinct().count()
        assert tasks > 1 and scan.count() == 2000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_headers_with_line_breaks_and_marks(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\ufeff" + ",".join(HEADERS[:-1]) + ',"Days Before\nDeparture"\n', encoding="utf-8")
    (tmp_path / "b.csv").write_text(",".join(HEADERS) + "\n")
    heads = {r.path.rsplit("/", 1)[1]: r.header for r in file_headers(file_manifest(spark, str(tmp_path))).collect()}
    assert heads["a.csv"] == [*HEADERS[:-1], "Days Before\nDeparture"] and heads["b.csv"] == HEADERS


def test_headers_in_a_store_that_only_spark_opens(spark, folder, monkeypatch):
    want = rows(file_headers(file_manifest(spark, str(folder))), "path", "header")
    monkeypatch.setattr(csv_files, "_opened_by_arrow", lambda path: False)
    assert rows(file_headers(file_manifest(spark, str(folder))), "path", "header") == want


def test_bronze_rows(spark, folder):
    scan = read_bookings_csv(spark, str(folder))
    got = {r.airline: r for r in to_bronze_rows(scan, NOW).collect()}
    pad = got["Pad"]
    text = "| ".join([" Pad "]) + "|AAA|BBB|2024-03-03 10:00:00|Economy|Web"
    assert pad[KEY] == hashlib.sha256(text.encode()).hexdigest()[:32]
    assert pad.stopovers is None and pad.total_fare_bdt == Decimal("110.500000") and pad.created_at == NOW
    short = "Short|AAA|BBB|2024-03-03 10:00:00||Web"
    assert got["Short"][KEY] == hashlib.sha256(short.encode()).hexdigest()[:32]
    assert got["Short"]["class"] == "" and got["Short"].days_before_departure is None
    as_text = {r.airline: r for r in to_bronze_rows(scan, NOW, nan_as_text=True).collect()}
    assert as_text["Pad"].stopovers == "nan" and as_text["Pad"][KEY] == pad[KEY]


def test_load_keeps_first_attributes_and_last_fares(spark, folder):
    first = load_bronze(None, read_bookings_csv(spark, str(folder)), NOW)
    assert first.columns == BRONZE.fieldNames() and first.count() == 4
    air = first.filter("airline = 'Air'").first()
    assert (air.stopovers, air.total_fare_bdt) == ("Direct", Decimal("999.500000"))
    ids = [r.id for r in first.collect()]
    assert len(set(ids)) == 4 and None not in ids

    stored = spark.createDataFrame(first.collect(), first.schema)
    write(folder / "Flight_Price_a.csv", HEADERS, row(total_fare_bdt="1"), row(airline="New"))
    for name in "bc":
        write(folder / f"Flight_Price_{name}.csv", HEADERS, row(airline="New", total_fare_bdt="2"))
    second = load_bronze(stored, read_bookings_csv(spark, str(folder)), LATER)
    got = {r.airline: r for r in second.collect()}
    assert (got["Air"].id, got["Air"].total_fare_bdt, got["Air"].updated_at) == (air.id, Decimal("1.000000"), LATER)
    assert got["Pad"].updated_at == NOW
    assert got["New"].total_fare_bdt == Decimal("2.000000") and got["New"].created_at == LATER
    assert got["New"].id > max(ids) and second.count() == 5


def test_profile_scan_and_training_scan_take_all_files_unless_told(spark, folder):
    assert read_profile_csv(spark, str(folder)).count() == 5 and load_data(spark, "csv", str(folder)).count() == 4
    profile = read_profile_csv(spark, str(folder), max_files=1)
    assert profile.count() == 2
    assert {"Source Name", "Arrival Date & Time", "base_fare_bdt", "departure_datetime"} <= set(profile.columns)
    assert dict(profile.dtypes)["total_fare_bdt"] == "double"
    train = load_data(spark, "csv", str(folder), max_files=1)
    assert train.count() == 2 and "base_fare_bdt" not in train.columns
    assert rows(train, "duration_bucket", "departure_weekday")[0] == ("Short (0-3h)", 0)
