"""Merkle manifests: one hash tree for each group of rows and one over the groups, and a proof for every row.

Both directions are time-forward processing: nodes are labelled so that messages only go to larger labels, and a priority
queue ordered by label hands each node what was sent to it. Upwards, children send their digests to their parent. The
reversed sweep, by falling labels, sends every child what its parent needs no more: the proof of the parent, preceded by
the child's siblings.

The queue is external in blocks of ``2 ** LEVELS`` neighbouring nodes: Spark's sort delivers a block's messages to one
task in order of their labels, and the queue in the task holds those of that block alone. A block sends one digest up to
the next round and receives one proof in the reversed sweep, so rounds grow as the logarithm of the rows.
"""

from collections.abc import Iterator
from hashlib import sha256
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from farelake.llm.batches import run
from farelake.session import materialise

# Levels of a tree within one block.
LEVELS = 12
# Rows of a block whose proofs leave a task in one batch.
_ROWS = 2048

_NODE = pa.schema([("tree", pa.string()), ("place", pa.int64()), ("size", pa.int64()), ("digest", pa.string())])
_NODE_DDL = "tree string, place long, size long, digest string"


def row_digest(*columns: str) -> Column:
    """SHA-256 over the columns: each ``-`` if null, else its bytes of UTF-8 as a number, ``:``, and the value."""
    parts = []
    for c in columns:
        value = F.col(f"`{c}`").cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(
        proof, leaf,
        lambda digest, step: F.sha2(
            F.when(step.startswith("L"), F.concat(F.substring(step, 2, 64), digest))
            .when(step.startswith("R"), F.concat(digest, F.substring(step, 2, 64)))
            .otherwise(digest), 256,
        ),
    )


def siblings(proof: Column) -> Column:
    """All digests of a proof, in one text."""
    return F.concat_ws("", F.transform(proof, lambda step: F.substring(step, 2, 64)))


def _height(size: int, levels: int) -> int:
    """How far the nodes of a tree of ``size`` nodes rise within a block: to the root, if the block is the whole tree."""
    return min((size - 1).bit_length(), levels)


def _rise(digests: list[str], height: int) -> tuple[str, list[tuple[int, int, list[str]]]]:
    """The block's own digest, and (level, node, digests of its children) by rising label."""
    queue = [(1, i >> 1, i, d) for i, d in enumerate(digests)]  # sorted, so a heap
    nodes = []
    digest = digests[0]
    while queue and queue[0][0] <= height:
        level, node = queue[0][:2]
        children = []
        while queue and queue[0][:2] == (level, node):
            children.append(heappop(queue)[3])
        digest = sha256("".join(children).encode()).hexdigest()
        nodes.append((level, node, children))
        heappush(queue, (level + 1, node >> 1, node, digest))
    return digest, nodes


def _fall(nodes: list[tuple[int, int, list[str]]], above: list[str], n: int) -> list[list[str]]:
    """The proofs of a block's n nodes; ``above`` is that of the block's own digest."""
    top = nodes[-1][0] if nodes else 0
    queue = [(-top, 0, above)]
    proofs: list[list[str]] = [[]] * n
    for level, node, children in reversed(nodes):
        *_, proof = heappop(queue)
        steps = [""] if len(children) == 1 else ["R" + children[1], "L" + children[0]]
        for i, step in enumerate(steps):
            heappush(queue, (1 - level, -(2 * node + i), [step, *proof]))
    while queue:
        _, node, proof = heappop(queue)
        proofs[-node] = proof
    return proofs


def _blocks(batches: Iterator[pa.RecordBatch], levels: int) -> Iterator[tuple[tuple[str, int], pa.Table]]:
    """The rows of one block at a time; they lie together."""
    held, own = [], None
    for batch in batches:
        keys = list(zip(batch.column("tree").to_pylist(), (p >> levels for p in batch.column("place").to_pylist())))
        start = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[start]:
                if held and own != keys[start]:
                    yield own, pa.Table.from_batches(held)
                    held = []
                own = keys[start]
                held.append(batch.slice(start, i - start))
                start = i
    if held:
        yield own, pa.Table.from_batches(held)


def _up(batches, levels):
    for (tree, block), rows in _blocks(batches, levels):
        size = rows.column("size")[0].as_py()
        digest, _ = _rise(rows.column("digest").to_pylist(), _height(size, levels))
        columns = [[tree], [block], [-(-size >> levels)], [digest]]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _NODE)], schema=_NODE)


def _down(batches, levels):
    for _, rows in _blocks(batches, levels):
        above, own = rows.slice(0, 1), rows.slice(1)  # the block's own proof has the place of its first node, and no digest
        digests = own.column("digest").to_pylist()
        _, nodes = _rise(digests, _height(own.column("size")[0].as_py(), levels))
        proofs = _fall(nodes, above.column("proof")[0].as_py(), len(digests))
        tops = pa.array([above.column("top")[0].as_py()] * len(digests), pa.string())
        own = own.drop_columns(["proof", "top"])
        for at in range(0, own.num_rows, _ROWS):
            part = own.slice(at, _ROWS)
            yield from part.append_column("proof", pa.array(proofs[at : at + _ROWS], pa.list_(pa.string()))).append_column(
                "top", tops.slice(at, _ROWS)
            ).combine_chunks().to_batches()


def _dealt(nodes: DataFrame, levels: int, *more: str) -> DataFrame:
    block = F.shiftright("place", levels)
    return nodes.repartition("tree", block).sortWithinPartitions("tree", "place", *more)


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (tree, digest and others), stored, with ``place``, from 0 in each tree by ``order``, and ``size`` of the tree.

    Rows are sorted over all tasks at once; ties are dealt out by digest and row, so that no value fills a task alone.
    """
    keys = ["tree", *order, "digest", "row"]
    rows = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = materialise(rows.withColumn("part", F.spark_partition_id()).withColumn("at", at).drop("row"))
    parts = rows.groupBy("tree", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    own = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        "tree", "part", (F.coalesce(F.sum("n").over(own), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("n").over(Window.partitionBy("tree")).alias("size"),
    )
    return rows.join(parts, ["tree", "part"]).withColumn("place", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def forest(nodes: DataFrame, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """(nodes with ``proof`` and ``top``, roots) of ``nodes`` (tree, place, size, digest and others), which are stored.

    While a tree has several nodes, every two neighbours become the digest of their digests, a last one alone that of its
    own. ``top`` is the root of a node's tree. A proof has a step for each level: ``L`` or ``R`` and the sibling at that side,
    or an empty text where there is none. Roots are (tree, digest).
    """
    rounds = [nodes]
    while (rounds[-1].agg(F.max("size")).first()[0] or 1) > 1:
        own = _dealt(rounds[-1].select("tree", "place", "size", "digest"), levels)
        rounds.append(materialise(run(own, _up, _NODE_DDL, levels)))
    roots = rounds[-1].select("tree", "digest")
    found = rounds.pop().withColumn("proof", F.array().cast("array<string>")).withColumn("top", F.col("digest"))
    steps = [StructField("proof", ArrayType(StringType())), StructField("top", StringType())]
    for own in reversed(rounds):
        above = found.select("tree", F.shiftleft("place", levels).alias("place"), "proof", "top")
        both = own.unionByName(above, allowMissingColumns=True)
        schema = StructType([*own.schema.fields, *steps])
        # Nulls first: a block's own proof precedes its nodes.
        found = run(_dealt(both.select(schema.names), levels, "digest"), _down, schema, levels)
        if own is not nodes:
            found = materialise(found)
    return found, roots


def prove(
    docs: DataFrame, columns: list[str], tree_col: str = "lang", id_col: str = "doc_id", carry: dict[str, Column] | None = None,
    levels: int = LEVELS,
) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof and ``carry``) for each row of ``docs``.

    A row's leaf is the digest of its ``columns``. The rows of one value of ``tree_col`` form a tree by rising ``id_col``; the
    roots of these trees, null first, then by the bytes of the value, form another, whose root is that of all rows. A proof
    leads from the leaf over the root of its tree to that root. ``carry`` are expressions on ``docs`` that go along.

    Null and empty texts have different leaves. Null ids come first. Ties are ordered by leaf; rows with equal leaves are
    interchangeable, and repeated rows are leaves of their own. An only row is its own root, and its proof is empty. An
    empty table gives no rows. Other columns are not read. Texts are read once; what is sorted and shuffled are digests.
    """
    value = F.col(f"`{tree_col}`").cast("string")
    carry = carry or {}
    rows = docs.select(
        F.coalesce(F.concat(F.lit("1"), value), F.lit("0")).alias("tree"), F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        row_digest(*columns).alias("digest"), F.struct(F.lit(0), *(c.alias(n) for n, c in carry.items())).alias("carried"),
    )
    rows = materialise(rows)  # sorting by ranges reads its rows twice
    found, roots = forest(materialise(numbered(rows, ["doc_id"])), levels)
    trees = numbered(roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), ["name"])
    trees, _ = forest(materialise(trees), levels)
    trees = trees.select(F.col("name").alias("tree"), F.col("top").alias("root"), F.col("proof").alias("rest"))
    return found.join(trees, "tree").select(
        "doc_id", F.col("digest").alias("leaf"), F.col("top").alias("subroot"), "root", F.concat("proof", "rest").alias("proof"),
        *(F.col(f"carried.`{n}`").alias(n) for n in carry),
    )
