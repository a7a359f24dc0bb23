"""WARC archives: format, ranges and revisits."""

import gzip

from pyspark.sql import functions as F

from checks.compare import compare, duckdb_connection
from farelake.llm import queries, warc
from farelake.llm.store import open_file

PAGES = "page_id long, url string, html string, offset long, digest string, first long"


def pages(spark):
    long = "<p>é" + "y" * 200
    rows = [(5, "http://a/ü b", long), (3, "http://b", long), (9, None, long), (None, "u", long), (1, "http://c", "tiny"), (2, "http://d", "tiny"),
            (4, "http://e", None), (6, "http://f", ""), (7, "http://g", "z" * 3_000_000), (7, "http://g", "z" * 3_000_000)]
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], PAGES)


def test_round_trip(spark):
    index = warc.write(pages(spark).repartition(2), date="2024-01-01T00:00:00Z")
    rows = {(r.page_id, r.url): r for r in warc.read(spark, index).collect()}
    kinds = {k: (r.record_type, r.refers_to) for k, r in rows.items()}
    assert kinds[(3, "http://b")] == ("response", None)
    assert kinds[(5, "http://a/%C3%BC%20b")] == kinds[(9, None)] == kinds[(None, "u")] == ("revisit", 3)
    assert all(kinds[k] == ("response", None) for k in kinds if k[0] in (1, 2, 4, 6, 7))
    assert rows[(9, None)].payload is None and rows[(9, None)].payload_bytes == 205
    assert rows[(9, None)].digest == rows[(3, "http://b")].digest
    assert bytes(rows[(4, "http://e")].payload) == b"" and len(rows[(7, "http://g")].payload) == 3_000_000
    assert warc.read(spark, index).count() == 10


def test_archive_is_one_gzip_stream_of_records(spark):
    index = warc.write(pages(spark).coalesce(1), date="2024-01-01T00:00:00Z").collect()
    path = index[0].path
    with open_file(path) as file:
        records = gzip.decompress(file.read()).split(b"WARC/1.1\r\n")[1:]
    assert len(records) == 10 and all(r.endswith(b"\r\n\r\n") for r in records)
    assert sorted(r.offset for r in index)[0] == 0


def test_selected_records(spark):
    index = warc.write(pages(spark).coalesce(1), date="2024-01-01T00:00:00Z")
    got = warc.read(spark, index.filter("page_id in (1, 6)")).orderBy("page_id").collect()
    assert [(r.page_id, bytes(r.payload)) for r in got] == [(1, b"tiny"), (6, b"")]


def test_near_ranges_are_read_together():
    import pyarrow as pa

    rows = [("a", 0, 10), ("a", 10, 5), ("a", 15 + warc.GAP, 5), ("a", 10**8, 7), ("b", 0, 3)]
    batch = pa.RecordBatch.from_pydict({"path": [r[0] for r in rows], "offset": [r[1] for r in rows], "length": [r[2] for r in rows]})
    spans = list(warc._ranges(batch.slice(i, 1) for i in range(5)))
    assert [(p, s, len(h)) for p, s, h in spans] == [("a", 0, 3), ("a", 10**8, 1), ("b", 0, 1)]


def test_no_pages(spark):
    index = warc.write(spark.createDataFrame([], PAGES), date="2024-01-01T00:00:00Z")
    assert index.count() == 0 and warc.read(spark, index).count() == 0


def test_query_equals_oracle(spark, sf_dir, monkeypatch):
    con = duckdb_connection(sf_dir)
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    for module, name in (("checks.compare.QUERIES", queries.QUERIES), ("checks.compare.ORACLE", queries.ORACLE)):
        monkeypatch.setattr(module, name)
    assert compare(spark, con, sf_dir, "op4_warc") == ""
    assert queries.op4_warc(spark, sf_dir).filter(F.length("payload_digest") != 64).count() == 0
