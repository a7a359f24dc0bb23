"""SimHash fingerprints, and groups of near ones by deletion-variant signatures.

A 64-bit fingerprint is cut into so few segments that two fingerprints within the allowed distance differ by one bit
at most in one of them: three for up to 5 bits. Each fingerprint is indexed under every segment with every single bit of
it left out; near fingerprints share such a key, and what shares a key is verified on all 64 bits.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from farelake.llm.batches import id_and_text, run, slices, table, texts
from farelake.llm.components import components
from farelake.session import materialise

# Fingerprints of a key that are compared in one go; more are dealt out over pairs of chunks.
CHUNK = 4096
# Up to this many under a key, all pairs are compared at once; beyond, a search in breadth links each only once.
_FEW = 16
# Shingles whose bits are counted at once.
_BLOCK = 1 << 17

_PRINT = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _hashes(text: str, width: int, seed: int) -> list[int]:
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()  # of bytes: A-Z only, and ASCII white space only
    if not words:
        return []
    line = b" ".join(words)
    if len(words) <= width:
        return [xxh64_intdigest(line, seed)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = len(words) - width + 1
    return [xxh64_intdigest(line[a:b], seed) for a, b in zip(starts[:last].tolist(), ends[width - 1 :].tolist())]


def fingerprints_of(texts: list[str], width: int, seed: int) -> np.ndarray:
    """The fingerprint of each text, as unsigned 64-bit integers."""
    hashes = [_hashes(t, width, seed) for t in texts]
    sizes = np.fromiter(map(len, hashes), np.int64, len(hashes))
    return majority(np.fromiter((h for x in hashes for h in x), np.uint64, int(sizes.sum())), sizes)


def majority(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bits that most of each text's hashes have; ``flat`` holds ``sizes`` hashes of each text, one after another."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    counts = np.zeros((len(sizes), 64), np.int64)
    for start in range(0, len(flat), _BLOCK):
        own = owner[start : start + _BLOCK]
        bits = np.unpackbits(flat[start : start + _BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first = np.flatnonzero(np.diff(own, prepend=-1))
        counts[own[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    bits = (2 * counts > sizes[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()


def _prints(batches, width, seed):
    for batch in batches:
        for part in slices(batch):
            yield table(_PRINT, part.column("doc_id"), fingerprints_of(texts(part), width, seed).view(np.int64))


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the majority of the bits of XXH64 over the shingles of ``width`` words, repeats included.

    A-Z are lower-cased; words are what white space (ASCII) separates. Fewer words are one shingle; without any word
    (null and empty texts) the fingerprint is 0. ``fp`` is the unsigned value's bits in a long.
    """
    return run(id_and_text(docs, id_col, text_col), _prints, "doc_id long, fp long", width, seed)


def segments(distance: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of the fewest segments of which one differs by at most one bit."""
    n = distance // 2 + 1
    bounds = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(bounds, bounds[1:])]


def _under(value: str, low: int, width: int) -> str:
    """SQL for all keys of one segment's ``value``: the bit left out, then the value without it."""
    return (
        f"transform(sequence({low}, {low + width - 1}), "
        f"w -> (shiftleft(CAST(w AS BIGINT), 56) | ({value} & ~shiftleft(CAST(1 AS BIGINT), w - {low}))))"
    )


def _segment(low: int, width: int) -> str:
    return f"(shiftright(fp, {low}) & {(1 << width) - 1})"


def _pairs(key: np.ndarray, fp: np.ndarray, distance: int):
    """Edges among rows of equal key, which lie together: enough to connect all that is within ``distance``."""
    first = np.flatnonzero(np.diff(key, prepend=key[0] - 1))
    sizes = np.diff(first, append=len(key))
    for offset in range(1, _FEW):
        near = np.flatnonzero((sizes > offset) & (sizes <= _FEW))
        if not len(near):
            break
        reach = sizes[near] - offset
        at = np.repeat(first[near] - (np.cumsum(reach) - reach), reach) + np.arange(int(reach.sum()))
        linked = np.bitwise_count(fp[at] ^ fp[at + offset]) <= distance
        yield fp[at[linked]], fp[at[linked] + offset]
    for start, size in zip(first[sizes > _FEW].tolist(), sizes[sizes > _FEW].tolist()):
        yield from _forest(np.unique(fp[start : start + size]), distance)


def _forest(rest: np.ndarray, distance: int):
    """A spanning forest: every fingerprint is linked to the one that a search in breadth finds it from."""
    while len(rest):
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            near = np.bitwise_count(rest[:, None] ^ front[None, :64]) <= distance
            found = near.any(axis=1)
            reached = rest[found]
            if len(reached):
                yield reached, front[near[found].argmax(axis=1)]
            front, rest = np.concatenate([front[64:], reached]), rest[~found]


def _link(batches, distance):
    held = None
    for batch in batches:
        rows = [batch.column(c).to_numpy() for c in ("group", "fp")]
        held = rows if held is None else [np.concatenate(x) for x in zip(held, rows)]
        if not len(held[0]):
            continue
        # The last key may go on in the next batch.
        end = len(held[0]) - int((held[0][::-1] != held[0][-1]).argmax()) if held[0][0] != held[0][-1] else 0
        if end:
            yield from _edges(held[0][:end], held[1][:end], distance)
            held = [x[end:] for x in held]
    if held is not None and len(held[0]):
        yield from _edges(*held, distance)


def _edges(group, fp, distance):
    sizes = np.diff(np.flatnonzero(np.diff(group, prepend=group[0] - 1)), append=len(group))
    several = np.repeat(sizes > 1, sizes)
    if several.any():
        for a, b in _pairs(group[several], fp[several].view(np.uint64), distance):
            if len(a):
                yield table(_EDGE, a.view(np.int64), b.view(np.int64))


def links(distinct: DataFrame, distance: int) -> DataFrame:
    """Edges (a, b) that connect all fingerprints within ``distance`` bits of one another; ``distinct`` has each ``fp`` once.

    Every key's rows are compared in chunks of at most about ``CHUNK``: where a segment's value is more common, its keys'
    rows are dealt out by hash into more chunks, and each pair of chunks is one group of the join. Which values are so
    common is counted first, on the three segments of each fingerprint.
    """
    parts = segments(distance)
    common = None
    for low, width in parts:
        own = distinct.select(F.expr(_segment(low, width)).alias("value")).groupBy("value").agg(F.count("*").alias("n"))
        own = own.filter(F.col("n") > CHUNK).select(F.explode(F.expr(_under("value", low, width))).alias("key"), "n")
        common = own if common is None else common.union(own)
    common = common.groupBy("key").agg(F.ceil(F.sum("n") / CHUNK + 1).cast("int").alias("chunks"))
    # Stored first: where it is small, which its file tells, the join below needs no shuffle.
    common = materialise(common)
    keys = "concat(" + ", ".join(_under(_segment(low, width), low, width) for low, width in parts) + ")"
    rows = distinct.select("fp", F.explode(F.expr(keys)).alias("key"))
    rows = rows.join(common, "key", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    rows = rows.withColumn("chunk", F.expr("CAST(pmod(xxhash64(fp), chunks) AS INT)"))
    one = rows.filter("chunks = 1").select(F.col("key").alias("group"), "fp")
    pairs = F.expr("transform(sequence(0, chunks - 1), other -> xxhash64(key, least(chunk, other), greatest(chunk, other)))")
    many = rows.filter("chunks > 1").select(F.explode(pairs).alias("group"), "fp")
    dealt = one.union(many).repartition("group").sortWithinPartitions("group")
    return run(dealt, _link, "a long, b long", distance)


def groups(docs: DataFrame, distance: int = 4, width: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for each row: documents whose fingerprints differ in at most ``distance`` bits are
    linked, and ``component_id`` is the smallest document id that links reach, its own included.

    Equal fingerprints are one node, so copies are never paired. Rows without words have fingerprint 0 and are linked
    like any other. A null id stays null, links like any other, and is never a component's id (null where no other id
    is reached). Repeated rows get a row each. An empty table gives no rows. Other columns are not read.
    """
    return grouped(docs, distance, width, seed, id_col, text_col).select("doc_id", "fp", "component_id")


def grouped(docs: DataFrame, distance: int = 4, width: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``groups`` with each component's own mark ``root``: components whose smallest ids are equal differ in it."""
    prints = materialise(fingerprints(docs, width, seed, id_col, text_col))
    distinct = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(distinct.select("fp"), distance)).select(F.col("node").alias("fp"), "root")
    rooted = materialise(distinct.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    labelled = rooted.join(least, "root").select("fp", "root", "component_id")
    return prints.join(labelled, "fp").select("doc_id", "fp", "root", "component_id")
