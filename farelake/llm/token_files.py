"""Token-id files: ids ranked by frequency, in byte-aligned variable-length coding with separate control bytes.

A file is a row of blocks. A block has a header (ids, ending documents, data bytes), a table of the documents that end
in it (id, whether it is null, tokens), then a control byte for every four ids (two bits each: bytes less one), then the
data bytes, low byte first. What is coded is the id's rank by frequency in the corpus, so common ids take one byte. The
folder also has ``codebook`` (ids by rank), and ``files``, a Parquet table that names the files, in order of document id.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from farelake.llm.batches import id_and_text, run, slices, table, text_array
from farelake.llm.chunks import SLICE, SpacedEncoder, encoder
from farelake.llm.store import attempt_name, create, open_file
from farelake.session import delete_folders, shared_folder

# Ids in a block at most; a longer document continues in the next block.
BLOCK = 1 << 18
# Characters by which texts of one document id are ordered.
HEAD = 64
_HEAD = np.dtype([("ids", "<u4"), ("documents", "<u4"), ("data", "<u8")])
_DOCUMENT = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("tokens", "<u8")])

# Bytes of each of the four ids under a control byte, and their sum.
_WIDTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1
_SUMS = _WIDTHS.sum(axis=1)
_MASKS = np.array([0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def encode_block(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    values = values.astype("<u4")
    extra = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    padded = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    padded[: len(values)] = extra
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    data = values.view(np.uint8).reshape(-1, 4)[np.arange(4) <= extra[:, None]]
    return control.astype(np.uint8).tobytes(), data.tobytes()


def decode_block(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` values of a block: widths by table lookup of the control bytes, then one gather of four bytes each."""
    widths = _WIDTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    starts = np.cumsum(widths) - widths
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.uint32)
    words = raw[:-3] | raw[1:-2] << 8 | raw[2:-1] << 16 | raw[3:] << 24
    return words[starts] & _MASKS[widths - 1]


_FILE_DDL = "task int, path string, tokens long, documents long, id int, n long"
_FILE = pa.schema([
    ("task", pa.int32()), ("path", pa.string()), ("tokens", pa.int64()), ("documents", pa.int64()), ("id", pa.int32()), ("n", pa.int64()),
])


def _encode(batches, definition, vocabulary, end, folder):
    """Blocks of ids, as they are, in a file; a row for it, and (id, n): how often it has each id."""
    from pyspark import TaskContext

    width = max(1, ((vocabulary - 1).bit_length() + 7) // 8)
    name = f"{folder}/raw/{attempt_name()}.ids"
    encode, often = encoder(definition.value, SpacedEncoder).encode, np.zeros(vocabulary, np.int64)
    out, tokens, documents = None, 0, 0
    for batch in batches:
        for part in slices(batch, size=SLICE):
            out = out or create(name)
            ids, sizes = encode(text_array(part), end)
            often += np.bincount(ids, minlength=vocabulary)
            ends = np.cumsum(sizes)
            null = part.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            doc_ids = part.column("doc_id").fill_null(0).to_numpy()
            for start in range(0, len(ids), BLOCK):
                block = ids[start : start + BLOCK]
                own = slice(*np.searchsorted(ends, [start, start + len(block)], side="right"))
                index = np.empty(own.stop - own.start, _DOCUMENT)
                index["doc_id"], index["null"], index["tokens"] = doc_ids[own], null[own], sizes[own]
                # The ids' lowest bytes, then the next ones: alike bytes together pack better.
                planes = block.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width].T.tobytes()
                data = pa.compress(planes, codec="zstd", asbytes=True)
                out.write(np.array([(len(block), len(index), len(data))], _HEAD).tobytes() + index.tobytes() + data)
            tokens, documents = tokens + len(ids), documents + len(sizes)
    if out:
        out.close()
        used = np.flatnonzero(often)
        none = [None] * len(used)
        yield table(_FILE, [TaskContext.get().partitionId()], [name], [tokens], [documents], [None], [None])
        yield table(_FILE, none, none, none, none, used.astype(np.int32), often[used])


def _blocks(file):
    """(ids, bytes of the documents' table, bytes of data) of each block of a file; what follows the table is left to the reader."""
    while head := file.read(_HEAD.itemsize):
        n, documents, length = np.frombuffer(head, _HEAD)[0].tolist()
        yield n, file.read(documents * _DOCUMENT.itemsize), length


def _write(batches, rank_of, width, folder):
    """The same blocks with ranks for ids, in a file for each plain one."""
    schema = pa.schema(list(_FILE)[:4])
    for batch in batches:
        for task, path, tokens, documents in zip(*(batch.column(c).to_pylist() for c in schema.names)):
            name = f"{folder}/data/{path.rsplit('/', 1)[1].removesuffix('.ids')}-{attempt_name()}.ids"
            with open_file(path) as file, create(name) as out:
                for n, index, length in _blocks(file):
                    planes = np.frombuffer(pa.decompress(file.read(length), n * width, codec="zstd", asbytes=True), np.uint8)
                    ids = np.zeros(n, np.uint32)
                    for k, plane in enumerate(planes.reshape(width, n)):
                        ids |= plane.astype(np.uint32) << 8 * k
                    control, data = encode_block(rank_of.value[ids])
                    head = np.array([(n, len(index) // _DOCUMENT.itemsize, len(data))], _HEAD)
                    out.write(head.tobytes() + index + control + data)
            yield table(schema, [task], [name], [tokens], [documents])


def _dealt(listing: DataFrame) -> DataFrame:
    """Rows that stand for a file each, one to a task as far as hashes allow."""
    return listing.repartition(max(1, listing.count()), "path")


def write(docs: DataFrame, definition: str, end: int, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Write the ids of all texts, each followed by ``end``, in ascending order of document id; returns the folder.

    ``definition`` is the content of a ``tokenizers`` file with a byte-level vocabulary. Null texts are empty; null ids
    come first; rows of equal id are ordered by their texts, as far as their first ``HEAD`` characters differ. An empty
    table gives a folder without data files. Other columns are not read.

    Texts are sorted by range of document id; each partition is encoded once, into a file of plain ids, with its counts (at
    most the vocabulary's size per task). When all counts are known, each file is written again with ranks, and the plain
    one deleted. Rows of one id, null among them, are dealt out by text and row, so that none fills a task alone. A lost
    task writes a new file; the table ``files`` names only those of the attempts that were kept.
    """
    spark = docs.sparkSession
    from tokenizers import Tokenizer

    vocabulary = max(Tokenizer.from_str(definition).get_vocab(with_added_tokens=True).values()) + 1
    shared = spark.sparkContext.broadcast(definition)
    folder = shared_folder(spark)
    source = id_and_text(docs, id_col, text_col)
    keys = ["doc_id", F.substring("text", 1, HEAD), F.xxhash64("text")]
    ordered = source.repartitionByRange(*keys, F.monotonically_increasing_id()).sortWithinPartitions("doc_id", "text")
    run(ordered, _encode, _FILE_DDL, shared, vocabulary, end, folder).write.parquet(f"{folder}/raw_files")
    encoded = spark.read.schema(_FILE_DDL).parquet(f"{folder}/raw_files")
    counts = encoded.filter("id is not null").groupBy("id").agg(F.sum("n").alias("n"))
    often = np.zeros(vocabulary, np.int64)
    for row in counts.collect():  # at most the vocabulary's size
        often[row["id"]] = row["n"]
    by_rank = np.argsort(-often, kind="stable").astype("<u4")
    rank_of = np.empty(vocabulary, np.uint32)
    rank_of[by_rank] = np.arange(vocabulary, dtype=np.uint32)
    with create(f"{folder}/codebook") as out:
        out.write(by_rank.tobytes())
    listed = encoded.filter("id is null").select(*_FILE.names[:4])
    width = max(1, ((vocabulary - 1).bit_length() + 7) // 8)
    files = run(_dealt(listed), _write, "task int, path string, tokens long, documents long", spark.sparkContext.broadcast(rank_of), width, folder)
    files.write.parquet(f"{folder}/files")
    for left_over in ("raw", "raw_files"):
        delete_folders(spark, f"{folder}/{left_over}")
    return folder


def _read(batches, by_rank, crc_only):
    schema = _READ if not crc_only else _DIGESTS
    for batch in batches:
        for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
            start, crc, size, kept = base, 0, 0, []
            with open_file(path) as file:
                for n, index, length in _blocks(file):
                    index = np.frombuffer(index, _DOCUMENT)
                    control = file.read(-(-n // 4))
                    ids = by_rank.value[decode_block(control, file.read(length), n)]
                    at, rows = 0, []
                    for doc_id, null, tokens in index.tolist():
                        piece = ids[at : at + tokens - size]
                        at += tokens - size
                        if crc_only:
                            rows.append((None if null else doc_id, start, tokens, zlib.crc32(piece, crc)))
                        else:
                            rows.append((None if null else doc_id, start, tokens, b"".join([*kept, piece.tobytes()])))
                        start, crc, size, kept = start + tokens, 0, 0, []
                    if at < n:  # a document that goes on in the next block
                        size += n - at
                        crc = zlib.crc32(ids[at:], crc) if crc_only else 0
                        kept = kept if crc_only else [*kept, ids[at:].tobytes()]
                    yield table(schema, *zip(*rows)) if rows else table(schema, [], [], [], [])


_READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
_DIGESTS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def read(spark: SparkSession, folder: str, digests: bool = False) -> DataFrame:
    """Per document (doc_id, start, n_tokens, ids) from the files: ``start`` counts the ids of all documents before it.

    ``ids`` are little-endian unsigned 32-bit integers. With ``digests``, ``ids_crc32`` stands for them and no more than
    a block is held at once, however long the document.
    """
    files = spark.read.schema("task int, path string, tokens long, documents long").parquet(f"{folder}/files")
    # A row for each file: the only thing that the driver sees of the data.
    bases, base = [], 0
    for row in sorted(files.collect(), key=lambda r: r["task"]):
        bases.append((row["path"], base))
        base += row["tokens"]
    with open_file(f"{folder}/codebook") as file:
        by_rank = np.frombuffer(file.read(), "<u4")
    listing = _dealt(spark.createDataFrame(bases, "path string, base long"))
    ddl = "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if digests else "ids binary")
    return run(listing, _read, ddl, spark.sparkContext.broadcast(by_rank), digests)
