"""WARC archives of web pages: written with an index of byte ranges, read back by coalesced ranges.

Records are gzip members of their own, so a record is found by its offset and length alone. Equal payloads are kept
once: the others are ``revisit`` records that refer to it and hold the response's HTTP headers only.
"""

import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from farelake.llm.batches import run, slices, table
from farelake.llm.store import attempt_name, create, open_file
from farelake.session import shared_folder

# Fixed values of the format.
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMESPACE = uuid.NAMESPACE_URL
_PRINTABLE = "!#$%&'()*+,/:;=?@[]~-._"

# Ranges of one file nearer than GAP are read at once, up to SPAN bytes; a task reads SPLIT bytes of a file in a row.
GAP, SPAN, SPLIT = 64 << 10, 4 << 20, 64 << 20

_INDEX = pa.schema([
    ("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()),
    ("digest", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()),
])
_INDEX_DDL = "path string, offset long, length long, url string, digest string, page_id long, record_type string"


def _record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'page:{page_id}') if page_id is not None else uuid.uuid4()}>"


def record(page_id, url, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One record, not compressed. ``refers_to`` is the page id of the response, or None for a response."""
    revisit = refers_to is not None
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if not revisit:
        block += payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id)}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=_PRINTABLE)}")
    head += [f"WARC-Date: {date}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_record_id(refers_to)}", f"X-Refers-To-Page-Id: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The fields of a record: page_id, url, record_type, digest, payload_bytes, refers_to, payload (None for a revisit)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = fields["WARC-Type"]
    number = lambda name: int(fields[name]) if name in fields else None
    return {
        "page_id": number("X-Page-Id"), "url": fields.get("WARC-Target-URI"), "record_type": kind,
        "digest": fields["WARC-Payload-Digest"].partition(":")[2],
        "payload_bytes": int(http.rpartition(b"Content-Length: ")[2]), "refers_to": number("X-Refers-To-Page-Id"),
        "payload": payload if kind == "response" else None,
    }


def _write(batches, folder, date):
    name, out, offset = f"{folder}/archives/{attempt_name()}.warc.gz", None, 0
    for batch in batches:
        for part in slices(batch, "payload"):
            rows = []
            for page_id, url, payload, digest, first in zip(*(c.to_pylist() for c in part.columns)):
                out = out or create(name)
                refers_to = None if first == page_id else first
                member = zlib.compressobj(6, zlib.DEFLATED, 31)
                data = member.compress(record(page_id, url, payload, digest, refers_to, date)) + member.flush()
                out.write(data)
                rows.append((name, offset, len(data), url, digest, page_id, "response" if refers_to is None else "revisit"))
                offset += len(data)
            yield table(_INDEX, *zip(*rows))
    if out:
        out.close()


def write(pages: DataFrame, date: str, least: int = 100, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record for each row to archives in the shared folder; returns the stored index.

    The index has (path, offset, length, url, digest, page_id, record_type) for each record; ``digest`` is the SHA-256 of
    the payload in hexadecimal. ``date`` (as 2024-01-01T00:00:00Z) is the date of all records.

    A null html is an empty payload, a null url leaves the field out. Of equal payloads of at least ``least`` bytes that
    with the smallest page id is the response (rows repeated with that very id are responses, too), the others are
    revisits. A null id never is the response that others refer to; equal payloads without any id are all responses. An
    empty table gives an empty index and no archive. Other columns are not read.

    Only payloads that occur repeatedly take part in the join, by digest, and they are counted before it, so it is a
    broadcast where those are few, and else a join whose large keys Spark splits. A lost task writes a new archive, and
    the index names only those of kept attempts.
    """
    folder = shared_folder(pages.sparkSession)
    rows = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"),
        F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    repeated = (
        rows.filter(F.octet_length("payload") >= least).groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null").select("digest", "first")
    )
    repeated.write.parquet(f"{folder}/repeated")
    repeated = pages.sparkSession.read.schema("digest string, first long").parquet(f"{folder}/repeated")
    marked = rows.join(repeated, "digest", "left").select("page_id", "url", "payload", "digest", "first")
    run(marked, _write, _INDEX_DDL, folder, date).write.parquet(f"{folder}/index")
    return pages.sparkSession.read.schema(_INDEX_DDL).parquet(f"{folder}/index")


_ROW = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("digest", pa.string()),
    ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary()),
])
_ROW_DDL = "page_id long, url string, record_type string, digest string, payload_bytes long, refers_to long, payload binary"


def _ranges(batches):
    """Spans (path, start, [(offset, length), ...]) of sorted ranges, near ones together."""
    path, start, end, held = None, 0, 0, []
    for batch in batches:
        for p, offset, length in zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "length"))):
            if held and (p != path or offset > end + GAP or offset + length - start > SPAN):
                yield path, start, held
                held = []
            if not held:
                path, start, end = p, offset, offset
            held.append((offset, length))
            end = max(end, offset + length)
    if held:
        yield path, start, held


def _read(batches):
    path, file = None, None
    for wanted, start, held in _ranges(batches):
        if wanted != path:
            if file:
                file.close()
            path, file = wanted, open_file(wanted)
        file.seek(start)
        data = file.read(max(o + n for o, n in held) - start)
        rows = [parse(zlib.decompress(data[o - start : o - start + n], 31)) for o, n in held]
        yield table(_ROW, *([r[name] for r in rows] for name in _ROW.names))
    if file:
        file.close()


def read(spark: SparkSession, selected: DataFrame) -> DataFrame:
    """The records of the selected index rows (path, offset, length): page_id, url, record_type, digest, payload_bytes,
    refers_to, payload. ``payload`` is null for revisits; digest and payload_bytes are those of the full payload.

    Rows of the index are dealt out by file and stretch of it, sorted by offset, and near ranges are read at once. Tasks
    are as many as the ranges have stretches, which their own few bytes do not tell.
    """
    size = selected.agg(F.sum("length")).first()[0] or 0
    tasks = int(size // SPLIT) + spark.sparkContext.defaultParallelism
    ranges = selected.select("path", "offset", "length").repartition(tasks, "path", F.floor(F.col("offset") / SPLIT))
    return run(ranges.sortWithinPartitions("path", "offset"), _read, _ROW_DDL)
