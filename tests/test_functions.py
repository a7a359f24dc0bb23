import hashlib
from datetime import datetime
from decimal import Decimal

from pyspark.sql import functions as F, types as T

from farelake.functions.buckets import duration_bucket, duration_interval, lead_bucket, lead_interval
from farelake.functions.dates import coerce_datetime, departure_parts, parse_datetime
from farelake.functions.keys import row_key
from farelake.functions.numeric import non_negative, round2, to_numeric_type
from farelake.functions.text import missing_to_null, null_or_blank, present, strip
from farelake.schema import FARE, KEY_COLUMNS


def values(spark, data, dtype, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(data)], f"i int, v {dtype}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_strip_equals_python(spark):
    texts = [" a ", "\tb\n", "c ", "", "   ", None, "d e"]
    assert values(spark, texts, "string", strip) == [t if t is None else t.strip() for t in texts]


def test_missing_tokens(spark):
    assert values(spark, ["nan", "NULL", "", "x", None, " nan"], "string", missing_to_null) == [
        None, None, None, "x", None, " nan",
    ]


def test_present_and_blank(spark):
    df = spark.createDataFrame([("a",), ("",), (None,), ("nan",)], "v string")
    assert [r.v for r in df.filter(present("v")).collect()] == ["a", "nan"]
    assert df.filter(null_or_blank("v")).count() == 2


def test_row_key_hashes_untrimmed_text_and_names_missing_values(spark):
    row = [" Air ", "A", None, "2024-01-01 00:00:00", "", "Web"]
    df = spark.createDataFrame([row], ", ".join(f"`{c}` string" for c in KEY_COLUMNS))
    text = "|".join("nan" if v is None else v for v in row)
    assert df.select(row_key()).first()[0] == hashlib.sha256(text.encode()).hexdigest()[:32]


def test_numeric_casts(spark):
    texts = ["1.2345675", "-0.0000005", "abc", "nan", "inf", None, " 7 ", "1e3", "12d", "99999999999999999999"]
    got = values(spark, texts, "string", lambda c: to_numeric_type(c, FARE))
    want = ["1.234568", "-0.000001", None, None, None, None, "7", "1000", None, None]
    assert got == [None if w is None else Decimal(w) for w in want]
    ints = values(spark, ["5.9", "-5.9", "7", "x"], "string", lambda c: to_numeric_type(c, T.IntegerType()))
    assert ints == [5, -5, 7, None]


def test_round2_half_away_from_zero(spark):
    data = [Decimal("2.345"), Decimal("-2.345"), Decimal("0.005"), None]
    assert values(spark, data, "decimal(15,6)", round2) == [Decimal("2.35"), Decimal("-2.35"), Decimal("0.01"), None]


def test_non_negative(spark):
    got = values(spark, [Decimal("-1"), None, Decimal("2.5")], "decimal(15,6)", lambda c: non_negative(c, FARE))
    assert got == [0, 0, Decimal("2.5")]


def test_datetimes(spark):
    texts = ["2024-03-03 10:05:00", "", None, "soon", "2024-03-04"]
    stamp = datetime(2024, 3, 3, 10, 5)
    assert values(spark, texts, "string", parse_datetime) == [stamp, None, None, None, None]
    assert values(spark, texts, "string", coerce_datetime) == [stamp, None, None, None, datetime(2024, 3, 4)]
    good = texts[:3]
    assert values(spark, good, "string", lambda c: parse_datetime(c, strict=True)) == [stamp, None, None]


def test_strict_datetime_raises(spark):
    try:
        values(spark, ["soon"], "string", lambda c: parse_datetime(c, strict=True))
    except Exception as error:
        assert "soon" in str(error)
    else:
        raise AssertionError("bad text must raise")


def test_weekdays(spark):
    df = spark.createDataFrame([("2024-03-03 10:00:00",), ("2024-03-04 23:00:00",)], "v string")
    stamp = parse_datetime(F.col("v"))
    assert [tuple(r) for r in df.select(*departure_parts(stamp)).collect()] == [(3, 0, 10), (3, 1, 23)]
    assert [tuple(r) for r in df.select(*departure_parts(stamp, "monday")).collect()] == [(3, 6, 10), (3, 0, 23)]


def test_buckets(spark):
    hours = [Decimal(x) for x in ("-1", "0", "3", "3.0001", "6", "6.5")] + [None]
    s, m, long = "Short (0-3h)", "Medium (3-6h)", "Long (6+h)"
    assert values(spark, hours, "decimal(10,4)", duration_bucket) == [s, s, s, m, m, long, long]
    assert values(spark, hours, "decimal(10,4)", duration_interval) == ["nan", "nan", s, m, m, long, "nan"]
    days = [-1, 0, 3, 4, 14, 15, 30, 31, None]
    a, b, c, d = "Last Minute (0-3 days)", "Short Notice (4-14 days)", "Standard (15-30 days)", "Early Bird (30+ days)"
    assert values(spark, days, "int", lead_bucket) == [a, a, a, b, b, c, c, d, d]
    assert values(spark, days, "int", lead_interval) == ["nan", "nan", a, b, b, c, c, d, "nan"]
