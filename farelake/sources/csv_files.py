"""Booking CSV files: discovery, header grouping and scan by header name."""

import csv
import functools
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from farelake.functions.numeric import to_number
from farelake.functions.text import missing_to_null
from farelake.schema import CSV_COLUMNS, NUMERIC_TYPES, PROFILE_KEEPS_HEADER

# Name patterns, tried in order.
PATTERNS = ("Flight_Price_*.csv", "*.csv")

POSITION = ("_path", "_block", "_row")

# Spark's names of a store that Arrow calls s3.
_ARROW_SCHEME = re.compile(r"^s3[an]:")
_HEAD_LINES = 100  # that a header may span


# A file is the same as long as all three are.
FILE = "path string, length bigint, modified timestamp"


def file_manifest(spark: SparkSession, folder: str, patterns: Sequence[str] = PATTERNS) -> DataFrame:
    """Non-empty files (path, length, modified) of the first pattern that matches any file at all.

    Only the listing is read: ``binaryFile`` opens a file when its content is asked for.
    """
    for pattern in patterns:
        listing = (
            spark.read.format("binaryFile")
            .option("pathGlobFilter", pattern)
            .option("recursiveFileLookup", "true")
            .load(folder)
            .select("path", "length", F.col("modificationTime").alias("modified"))
        )
        # Empty files count as a match here, though no scan returns them.
        if listing.inputFiles():
            return listing.filter("length > 0")
    return spark.createDataFrame([], FILE)


def new_files(manifest: DataFrame, known: DataFrame) -> DataFrame:
    """Files of ``manifest`` that are not in ``known`` with the same length and time: new ones, and ones sent again."""
    return manifest.join(known, ["path", "length", "modified"], "left_anti")


def manifest_status(manifest: DataFrame) -> DataFrame:
    """One row: ``found`` with the file and byte counts, or ``missing``."""
    return manifest.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).select(
        F.when(F.col("files") > 0, "found").otherwise("missing").alias("outcome"), "files", "bytes"
    )


def _opened_by_arrow(path: str) -> bool:
    from pyarrow import fs

    try:
        fs.FileSystem.from_uri(_ARROW_SCHEME.sub("s3:", path))
    except Exception:  # an unknown scheme, or a store whose client is missing here
        return path.startswith("file:")
    return True


def file_headers(manifest: DataFrame) -> DataFrame:
    """``manifest`` with the column names of each file, ``header``.

    Executors read the first record of each file, line breaks in quotes included. In a
    store that only Spark can open, Spark reads the first lines, by a small job per file.
    """
    spark = manifest.sparkSession
    schema = T.StructType([*manifest.schema.fields, T.StructField("header", T.ArrayType(T.StringType()))])
    first = manifest.first()
    if first is not None and not _opened_by_arrow(first["path"]):
        files = manifest.collect()  # the file list
        heads = [next(csv.reader(r["value"] for r in spark.read.text(f["path"]).take(_HEAD_LINES))) for f in files]
        rows = [(*f, [h.removeprefix("\ufeff") if not i else h for i, h in enumerate(head)]) for f, head in zip(files, heads)]
        return spark.createDataFrame(rows, schema)

    # Nested, so that they travel with the job and executors need not have this package.
    def open_file(path: str):
        import re

        from pyarrow import fs

        if path.startswith("file:"):
            return fs.LocalFileSystem().open_input_stream("/" + path.removeprefix("file:").lstrip("/"))
        filesystem, name = fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", path))
        return filesystem.open_input_stream(name)

    def read_headers(batches):
        import io

        for batch in batches:
            headers = []
            for path in batch["path"]:
                with open_file(path) as stream, io.TextIOWrapper(stream, "utf-8-sig", newline="") as text:
                    headers.append(next(csv.reader(text)))
            yield batch.assign(header=headers)

    tasks = spark.sparkContext.defaultParallelism
    return manifest.repartition(tasks, "path").mapInPandas(read_headers, schema)


def _scan(
    spark: SparkSession, paths: Sequence[str], header: Sequence[str], multi_line: bool, mode: str
) -> DataFrame:
    schema = T.StructType([T.StructField(name, T.StringType()) for name in header])
    # Cells are counted in whole rows only, so no column is skipped while a row is parsed.
    rows = (
        spark.read.option("columnPruning", False)
        .option("mode", mode)
        .csv(list(paths), schema=schema, header=True, escape='"', multiLine=multi_line)
    )
    columns = []
    for label, name in CSV_COLUMNS.items():
        if label in header:
            value = missing_to_null(F.col(f"`{label}`"))
        else:
            value = F.lit(None if name in NUMERIC_TYPES else "").cast("string")
        columns.append(value.alias(name))
    return rows.select(
        *columns,
        F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_block_start").alias("_block"),
        # Rises along a scan task, so it orders the rows of one file block.
        F.monotonically_increasing_id().alias("_row"),
    )


def read_bookings_csv(
    spark: SparkSession, folder: str, max_files: int | None = None, multi_line: bool = False, mode: str = "FAILFAST"
) -> DataFrame:
    """Booking rows as text under column names, with position columns.

    Missing cells are NULL. A text column that a file lacks is blank, a number it
    lacks is NULL. A row with more or fewer cells than its header raises when it is read;
    ``mode`` "PERMISSIVE" fills up or cuts off instead. ``max_files``, where given, keeps
    the first files by path.

    One scan per distinct header: a single scan over differing headers would match
    columns by place. What reaches the driver is the file list, which a scan needs anyway.
    Files are split, so a large one is read by many tasks. Line breaks inside cells need
    ``multi_line``, which reads each file in one task; without it such rows raise.
    """
    manifest = file_manifest(spark, folder)
    if max_files is not None:
        manifest = manifest.orderBy("path").limit(max_files)
    scan = read_files(manifest, multi_line, mode)
    if scan is None:
        raise FileNotFoundError(f"no CSV file with content in {folder}")
    return scan


def read_files(manifest: DataFrame, multi_line: bool = False, mode: str = "FAILFAST") -> DataFrame | None:
    """As ``read_bookings_csv``, the rows of the files that ``manifest`` lists; None if it lists none."""
    spark = manifest.sparkSession
    groups = file_headers(manifest).groupBy("header").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    scans = [_scan(spark, g["paths"], g["header"], multi_line, mode) for g in groups.orderBy("paths").collect()]
    return functools.reduce(DataFrame.unionByName, scans) if scans else None


def read_profile_csv(
    spark: SparkSession, folder: str, max_files: int | None = None, multi_line: bool = False, mode: str = "FAILFAST"
) -> DataFrame:
    """Rows for profiling: fares kept, numbers typed, three columns under their CSV name."""
    rows = read_bookings_csv(spark, folder, max_files, multi_line, mode)
    columns = []
    for label, name in CSV_COLUMNS.items():
        value = to_number(F.col(name)) if name in NUMERIC_TYPES else F.col(name)
        columns.append(value.alias(label if label in PROFILE_KEEPS_HEADER else name))
    return rows.select(*columns)
