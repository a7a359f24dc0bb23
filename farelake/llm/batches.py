"""Arrow batches in and out of tasks, and the package on the executors."""

import ctypes
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

# Text that a task holds as Python objects at once.
SLICE_BYTES = 4 << 20


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once a session; they need not have it installed."""
    context = spark.sparkContext
    if not getattr(context, "_farelake_shipped", False):
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        archive = os.path.join(tempfile.mkdtemp(prefix="farelake-"), "farelake.zip")
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
            for folder, _, names in os.walk(package):
                for name in sorted(names):
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        out.write(path, os.path.relpath(path, os.path.dirname(package)))
        context.addPyFile(archive)
        context._farelake_shipped = True
    return spark


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns that an operator reads, as (doc_id long, text string); all others are left out."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def run(df: DataFrame, work: Callable, schema: str, *args) -> DataFrame:
    """``work(batches, *args)`` over the Arrow batches of every partition."""
    ship(df.sparkSession)
    return df.mapInArrow(partial(_run, work, args), schema)


def keep_rows(df: DataFrame, decide: Callable, *args) -> DataFrame:
    """The rows of ``df``, all columns, for which ``decide(*args)`` gives a function of Arrow texts that says True.

    ``df`` has its text in the column ``text``.
    """
    ship(df.sparkSession)
    return df.mapInArrow(partial(_keep, decide, args), df.schema)


def _keep(decide: Callable, args: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    decision = decide(*args)
    for batch in batches:
        for part in slices(batch):
            yield part.filter(pa.array(decision(text_array(part)), pa.bool_()))
    _give_back()


def _run(work: Callable, args: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from work(batches, *args)
    _give_back()


def _give_back() -> None:
    """Memory that the task has freed goes back to the system: workers live on, idle ones too, and share an executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the usual C library
    if trim:
        trim(0)


def slices(batch: pa.RecordBatch, column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts hold about ``size`` bytes (a longer text stands alone)."""
    import numpy as np
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths.astype(np.int64))
    start = 0
    while start < batch.num_rows:
        limit = (ends[start - 1] if start else 0) + size
        stop = max(start + 1, int(np.searchsorted(ends, limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; null is empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def text_array(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """The texts of a batch as an Arrow array; null is empty."""
    return batch.column(column).cast(pa.string()).fill_null("")


def table(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)
