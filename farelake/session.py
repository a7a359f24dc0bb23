"""Session settings and the shared scratch folder."""

import gc
import time
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


LITTLE = 8 << 20  # bytes of a stage for which no shuffles are deleted: that takes the driver up to a second

_SCRATCH: ContextVar[str] = ContextVar("scratch", default="")


def configure(spark: SparkSession) -> SparkSession:
    """Pin the one setting results depend on: timestamps are read and shown in UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` of the session, else the
    checkpoint folder that was set on its context.

    Spark ML uses it for its checkpoints as well. There is no other place: on a cluster,
    a folder of one machine would not be seen by the others.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return root.rstrip("/")


def shared_folder(spark: SparkSession) -> str:
    """A fresh path in the shared folder, below one of this application (and of the ``scratch`` it is asked for in)."""
    return f"{shared_root(spark)}/{spark.sparkContext.applicationId}/{_SCRATCH.get()}{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is stored within lies in one folder, which is deleted at the end, with the shuffles that no frame needs any more."""
    folder = f"{_SCRATCH.get()}{uuid.uuid4().hex}/"
    before = _SCRATCH.set(folder)
    try:
        yield
    finally:
        _SCRATCH.reset(before)
        delete_folders(spark, f"{shared_root(spark)}/{spark.sparkContext.applicationId}/{folder}")
        free_shuffles(spark)


def free_shuffles(spark: SparkSession, stored: str | None = None) -> None:
    """Delete the files of shuffles that no frame needs any more, which else stay until the driver's memory is full, however
    much disk they take. Behind a folder ``stored`` of less than ``LITTLE`` bytes they are left to the next call."""
    if stored:
        place, files = _hadoop(spark, stored)
        if files.getContentSummary(place).getLength() < LITTLE:
            return
    gc.collect()  # frames that Python has let go of
    collect = spark.sparkContext._jvm.System.gc  # Spark deletes shuffle files when their frames are collected
    collect()
    time.sleep(0.1)  # till what held on to the frames of the last job is cleaned away, too
    collect()


def _hadoop(spark: SparkSession, path: str):
    """A path and its file system, as Spark knows them."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete_folders(spark: SparkSession, parent: str, keep: Sequence[str] = ()) -> int:
    """Delete what lies in ``parent``, in any file system Spark knows, but for the names in ``keep``."""
    doomed = [n for n in file_names(spark, parent) if n not in keep]
    for name in doomed:
        delete_folder(spark, f"{parent}/{name}")
    return len(doomed)


def delete_folder(spark: SparkSession, path: str) -> None:
    place, files = _hadoop(spark, path)
    files.delete(place, True)


def file_names(spark: SparkSession, folder: str) -> list[str]:
    """What lies in a folder; nothing if there is none."""
    place, files = _hadoop(spark, folder)
    return [f.getPath().getName() for f in files.listStatus(place)] if files.exists(place) else []


def file_text(spark: SparkSession, path: str) -> str:
    """A small text file."""
    place, files = _hadoop(spark, path)
    stream = files.open(place)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_new_file(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small text file, seen whole or not at all; False if there is one of that name already."""
    folder, name = path.rsplit("/", 1)
    written, files = _hadoop(spark, f"{folder}/.{name}.{uuid.uuid4().hex}")
    stream = files.create(written, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    jvm = spark.sparkContext._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    never_over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(files.makeQualified(written), files.makeQualified(jvm.org.apache.hadoop.fs.Path(path)), never_over)
    except Py4JJavaError as error:
        files.delete(written, False)
        if "FileAlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise
    return True


def clear_stages(spark: SparkSession) -> int:
    """Delete all stages this application has stored; frames read from them are gone with them."""
    return delete_folders(spark, f"{shared_root(spark)}/{spark.sparkContext.applicationId}")


def materialise(df: DataFrame, key: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    For frames that several jobs scan: the work behind them runs once, the copy is
    columnar, and it outlives any executor. It is packed by zstd, a quarter smaller than by snappy. The shuffles behind
    it are deleted.

    With ``key`` it is stored in buckets, as many as shuffle partitions, so that joins and groupings by the key read it without
    a shuffle. ``df`` is to come from one of these, and so dealt out by the key already: any other is stored in many files.
    """
    spark = df.sparkSession
    path = shared_folder(spark)
    if key is None:
        df.write.parquet(path, compression="zstd")
        stored = spark.read.schema(df.schema).parquet(path)
    else:
        # Buckets can only be written through the catalog.
        staged = f"stage_{uuid.uuid4().hex}"
        writer = df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).sortBy(key)
        writer.format("parquet").option("compression", "zstd").option("path", path).saveAsTable(staged)
        stored = spark.table(staged)
        # The entry only: the table is external, its files stay, and the frame knows them.
        spark.sql(f"DROP TABLE {staged}")
    free_shuffles(spark, path)
    return stored
