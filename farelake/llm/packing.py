"""Packing by power-of-two decomposition: no sequence crosses documents, and none needs padding.

Every document of n tokens is cut into n // L pieces of the longest length L and one piece for each binary digit of
the rest, longest first. Pieces of equal length form a bucket; each piece is a sequence of its bucket.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from farelake.llm.batches import id_and_text, run, slices, text_array
from farelake.llm.chunks import SLICE, WordEncoder, encoder
from farelake.session import shared_folder

_PIECE = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()),
    ("ids", pa.large_binary()), ("task", pa.int32()), ("place", pa.int64()),
])
_PIECE_DDL = "doc_id long, start long, length long, doc_tokens long, ids binary, task int, place long"


def cut(sizes: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length) of the pieces of documents with ``sizes`` tokens, documents in order."""
    full = sizes // longest
    rest = sizes % longest
    digits = 1 << np.arange(longest.bit_length() - 2, -1, -1, dtype=np.int64)
    which, digit = np.nonzero(rest[:, None] & digits)
    document = np.concatenate([np.repeat(np.arange(len(sizes)), full), which])
    length = np.concatenate([np.full(int(full.sum()), longest, np.int64), digits[digit]])
    order = np.argsort(document, kind="stable")  # full pieces come first, then falling digits
    document, length = document[order], length[order]
    before = np.cumsum(length) - length
    first = np.searchsorted(document, np.arange(len(sizes)))
    start = before - before[first[document]] if len(document) else before
    return document, start, length


def _pieces(batches, definition, longest, end):
    from pyspark import TaskContext

    task = TaskContext.get().partitionId()
    encode = encoder(definition.value, WordEncoder).encode
    given = np.zeros(longest.bit_length(), np.int64)  # sequences so far, by the length's binary logarithm
    for batch in batches:
        for part in slices(batch, size=SLICE // 2):
            ids, sizes = encode(text_array(part), end)
            document, start, length = cut(sizes, longest)
            base = np.cumsum(sizes) - sizes
            at = base[document] + start
            raw = ids.astype("<u4")
            bucket = np.log2(length).astype(np.int64)
            place = np.empty(len(length), np.int64)
            for b in np.unique(bucket):
                own = bucket == b
                place[own] = given[b] + np.arange(own.sum())
                given[b] += own.sum()
            offsets = np.concatenate([[0], np.cumsum(length) * 4]).astype(np.int64)
            # Pieces lie in the order of the ids, so the ids themselves are the column's data.
            assert np.array_equal(at * 4, offsets[:-1])
            column = pa.Array.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id").take(pa.array(document)), pa.array(start), pa.array(length),
                pa.array(sizes[document]), column, pa.array(np.full(len(length), task, np.int32)), pa.array(place),
            ], schema=_PIECE)


def pack(docs: DataFrame, definition: str, end: int, longest: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sequences (sequence_id, offset, doc_id, start, length, doc_tokens, ids) of at most ``longest`` tokens, a power of two.

    ``definition`` is the content of a ``tokenizers`` file, ``end`` the id put after each document. ``ids`` holds the
    sequence's ids as little-endian unsigned 32-bit integers; ``offset`` is 0, as each sequence holds one piece.
    ``sequence_id`` counts from 0 over all sequences, bucket by bucket, shortest first, without gaps.

    Null and empty texts give the one sequence that holds ``end``. A null id is kept as null. Repeated rows are packed
    each for itself. An empty table gives no rows. Other columns are not read.

    The sequences are stored in the shared folder as Parquet; nothing is shuffled. Sequences are numbered from the
    counts of each bucket in each task, a small table.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    spark = docs.sparkSession
    definition = spark.sparkContext.broadcast(definition)  # one vocabulary file, a few MB
    folder = shared_folder(spark)
    pieces = run(id_and_text(docs, id_col, text_col), _pieces, _PIECE_DDL, definition, longest, end)
    pieces.write.option("compression", "zstd").parquet(f"{folder}/pieces")
    stored = spark.read.schema(_PIECE_DDL).parquet(f"{folder}/pieces")
    counts = stored.groupBy("length", "task").agg(F.count("*").alias("n"))
    tasks = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    buckets = {r["length"]: r["n"] for r in stored.groupBy("length").agg(F.count("*").alias("n")).collect()}
    before, base = 0, F.lit(0).cast("long")
    for length in sorted(buckets):
        base = F.when(F.col("length") == length, F.lit(before)).otherwise(base)
        before += buckets[length]
    bases = counts.select("length", "task", (base + F.coalesce(F.sum("n").over(tasks), F.lit(0))).alias("base"))
    # Stored, so that its size is known: a row for each bucket and task.
    bases.write.parquet(f"{folder}/bases")
    bases = spark.read.schema("length long, task int, base long").parquet(f"{folder}/bases")
    return stored.join(bases, ["length", "task"]).select(
        (F.col("base") + F.col("place")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
        "doc_id", "start", "length", "doc_tokens", "ids",
    )
