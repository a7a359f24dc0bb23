"""Nearest neighbours by a forest of random-projection trees, searched through one shared priority queue.

Trees are fitted on a bounded sample; every vector is then put into its leaf of each tree. A query walks all trees at
once: of the branches it left aside in any tree, that with the smallest sum of squared margins is followed next, until
the leaves met hold a given share of all vectors. What lies in those leaves is compared exactly, leaf by leaf.
"""

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from farelake.llm.batches import run
from farelake.session import materialise

# Vectors of a leaf that are compared in one go; larger leaves are dealt out into chunks.
CHUNK = 8192
_QUERIES = 256  # compared with a chunk at once


@dataclass
class Tree:
    """Node k parts vectors by ``directions[k] @ x <= thresholds[k]``; children below 0 are leaves (-1 is leaf 0)."""

    directions: np.ndarray
    thresholds: np.ndarray
    left: np.ndarray
    right: np.ndarray
    leaves: int

    def leaf(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64) if len(self.left) else np.full(len(x), -1)
        while (inner := np.flatnonzero(at >= 0)).size:
            node = at[inner]
            side = np.einsum("ij,ij->i", x[inner], self.directions[node]) <= self.thresholds[node]
            at[inner] = np.where(side, self.left[node], self.right[node])
        return -at - 1


def grow(sample: np.ndarray, depth: int, rng: np.random.Generator) -> Tree:
    """A tree of at most ``depth`` splits: of a few random projections the widest, parted at its median."""
    directions, thresholds, left, right, leaves = [], [], [], [], [0]

    def leaf() -> int:
        leaves[0] += 1
        return -leaves[0]

    def split(rows: np.ndarray, depth: int) -> int:
        if depth == 0 or len(rows) < 2:
            return leaf()
        tries = rng.standard_normal((sample.shape[1], 6))
        tries /= np.linalg.norm(tries, axis=0)
        values = sample[rows] @ tries
        best = int(values.var(axis=0).argmax())
        threshold = np.median(values[:, best])
        low = values[:, best] <= threshold
        if low.all():
            return leaf()
        node = len(left)
        for part, value in ((directions, tries[:, best]), (thresholds, threshold), (left, 0), (right, 0)):
            part.append(value)
        left[node] = split(rows[low], depth - 1)
        right[node] = split(rows[~low], depth - 1)
        return node

    split(np.arange(len(sample)), depth)
    return Tree(np.array(directions).reshape(-1, sample.shape[1]), np.array(thresholds), np.array(left, np.int64), np.array(right, np.int64), leaves[0])


def probe(forest: list[Tree], sizes: list[np.ndarray], x: np.ndarray, budget: float) -> list[tuple[int, int]]:
    """The leaves (tree, leaf) that one query searches, until they hold ``budget`` vectors."""
    margins = [t.directions @ x - t.thresholds for t in forest]
    queue = [(0.0, i, 0 if len(t.left) else -1) for i, t in enumerate(forest)]
    found, held = [], 0
    while queue and held < budget:
        far, i, node = heapq.heappop(queue)
        tree = forest[i]
        while node >= 0:
            margin = margins[i][node]
            near, other = (tree.left[node], tree.right[node]) if margin <= 0 else (tree.right[node], tree.left[node])
            heapq.heappush(queue, (far + margin * margin, i, int(other)))
            node = int(near)
        found.append((i, -node - 1))
        held += int(sizes[i][-node - 1])
    return found


def _spot(vectors: pa.Array) -> pa.Schema:
    """Columns of what is dealt out, with vectors as they are given."""
    numbers = [("tree", pa.int32()), ("leaf", pa.int32()), ("chunk", pa.int32()), ("kind", pa.int32()), ("id", pa.int64())]
    return pa.schema([*numbers, ("vec", vectors.type)])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _place(batches, forest, chunks):
    """A row for each vector and tree."""
    for batch in batches:
        if not batch.num_rows:
            continue
        x, ids = _matrix(batch.column("vec")), batch.column("id").to_numpy()
        for i, tree in enumerate(forest.value):
            leaf = tree.leaf(x)
            part = np.zeros(len(ids), np.int64)
            if chunks is not None:
                mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)
                part = (mixed % chunks.value[i][leaf].astype(np.uint64)).astype(np.int64)
            n = len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, i, np.int32)), pa.array(leaf.astype(np.int32)), pa.array(part.astype(np.int32)),
                 pa.array(np.zeros(n, np.int32)), pa.array(ids), batch.column("vec")], schema=_spot(batch.column("vec")))


def _count(batches, forest):
    schema = pa.schema([("tree", pa.int32()), ("leaf", pa.int32()), ("n", pa.int64())])
    counts = [np.zeros(t.leaves, np.int64) for t in forest.value]
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch.column("vec"))
            for tree, count in zip(forest.value, counts):
                count += np.bincount(tree.leaf(x), minlength=tree.leaves)
    for i, count in enumerate(counts):
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(count), i, np.int32)), pa.array(np.arange(len(count), dtype=np.int32)), pa.array(count)], schema=schema)


def _probe(batches, forest, sizes, chunks, budget):
    """A row for each query, leaf that it searches, and chunk of the leaf."""
    for batch in batches:
        for at in range(0, batch.num_rows, _QUERIES):
            part = batch.slice(at, _QUERIES)
            rows = []
            for row, x in enumerate(_matrix(part.column("vec"))):
                rows += [(i, leaf, c, row) for i, leaf in probe(forest.value, sizes.value, x, budget) for c in range(chunks.value[i][leaf])]
            tree, leaf, chunk, row = (np.array(c, np.int32) for c in zip(*rows))
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(tree), pa.array(leaf), pa.array(chunk), pa.array(np.ones(len(row), np.int32)), part.column("id").take(take), part.column("vec").take(take)],
                schema=_spot(part.column("vec")))


def _compare(batches, k):
    """The ``k`` nearest vectors of each chunk to each of its queries, and what ties with them."""
    schema = pa.schema([("query", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])
    key, ids, vectors = None, [], []
    for batch in batches:
        if not batch.num_rows:
            continue
        spot = np.stack([batch.column(c).to_numpy() for c in ("tree", "leaf", "chunk", "kind")], axis=1)
        bounds = np.flatnonzero(np.any(np.diff(spot, axis=0, prepend=spot[:1] - 1) != 0, axis=1)).tolist() + [len(spot)]
        x, own = _matrix(batch.column("vec")), batch.column("id").to_numpy()
        for a, b in zip(bounds, bounds[1:]):
            if tuple(spot[a, :3]) != key:
                key, ids, vectors = tuple(spot[a, :3]), [], []
            if spot[a, 3] == 0:  # vectors come before the queries of their chunk
                ids.append(own[a:b])
                vectors.append(x[a:b])
                continue
            if not ids:
                continue
            ids, vectors = [np.concatenate(ids)], [np.concatenate(vectors)]
            square = (vectors[0] ** 2).sum(axis=1)
            for start in range(a, b, _QUERIES):
                q = x[start : min(start + _QUERIES, b)]
                near = square + (q**2).sum(axis=1)[:, None] - 2 * q @ vectors[0].T
                if near.shape[1] > k:
                    last = np.partition(near, k - 1, axis=1)[:, k - 1 : k]
                    row, column = np.nonzero(near <= last + 1e-9 * (1 + np.abs(last) + square.max()))
                else:
                    row, column = np.indices(near.shape).reshape(2, -1)
                score = np.sqrt(((q[row] - vectors[0][column]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(own[start + row]), pa.array(ids[0][column]), pa.array(score)], schema=schema)


def search(
    vectors: DataFrame, queries: str, k: int = 10, trees: int = 4, depth: int = 9, sample: int = 16384, share: float = 0.85,
    least: int = 8192, seed: int = 42, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found, by Euclidean distance, for each row that ``queries``
    (SQL on the column ``id``) selects; every other row is a candidate. Equal distances go to the smaller id.

    The forest has ``trees`` trees of ``depth`` splits, fitted on ``sample`` vectors chosen by hash of their id; all
    vectors are indexed. A query searches leaves that hold ``share`` of the vectors, and ``least`` at least, summed over
    trees (a vector met in several trees counts several times). Distances are taken in double precision on the original vectors.

    Vectors that are null, zero, of another length than most, or hold null or non-finite components take no part, nor do
    rows with a null id; repeated rows count once. Equal vectors are one point of the index, with its k + 1 smallest ids,
    so copies never crowd a leaf. Without other vectors a query gets no row. Other columns are not read.
    """
    spark = vectors.sparkSession
    number = "float" if vectors.schema[vector_col].dataType.elementType.typeName() == "float" else "double"
    spot = f"tree int, leaf int, chunk int, kind int, id long, vec array<{number}>"
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast(f"array<{number}>").alias("vec"))
    rows = rows.filter("id is not null and forall(vec, x -> x is not null and not isnan(x) and abs(x) < float('infinity')) and exists(vec, x -> x <> 0)")
    lengths = rows.groupBy(F.size("vec").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), F.desc("n")).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if lengths is None:
        return spark.createDataFrame([], schema)
    rows = rows.filter(F.size("vec") == lengths["n"])
    # The k + 1 smallest ids of each point; they are cut down in each task before the shuffle.
    first = Window.partitionBy("vec").orderBy("id")
    points = rows.withColumn("place", F.dense_rank().over(first)).filter(F.col("place") <= k + 1)
    points = points.groupBy("vec").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    points = materialise(points.select(F.element_at("ids", 1).alias("id"), "vec", "ids"))
    asked = materialise(rows.filter(queries).select(F.col("id").alias("query_id"), "vec").distinct().join(points.select("id", "vec"), "vec").select("query_id", "id"))

    chosen = points.select("id", "vec").orderBy(F.xxhash64("id"), "id").limit(sample).collect()
    fitted = np.array([r["vec"] for r in chosen], np.float64)
    rng = np.random.default_rng(seed)
    depth = max(0, min(depth, int(np.log2(max(len(fitted), 1) / 16)))) if len(fitted) >= 16 else 0
    grown = [grow(fitted, depth, rng) for _ in range(trees)]
    forest = spark.sparkContext.broadcast(grown)  # trees * 2 ** depth directions
    sizes = [np.zeros(t.leaves, np.int64) for t in grown]
    counted = run(points.select("vec"), _count, "tree int, leaf int, n long", forest).groupBy("tree", "leaf").agg(F.sum("n").alias("n"))
    for r in counted.collect():  # a row for each leaf
        sizes[r["tree"]][r["leaf"]] = r["n"]
    chunks = spark.sparkContext.broadcast([np.maximum(1, -(-s // CHUNK)) for s in sizes])
    sizes = spark.sparkContext.broadcast(sizes)
    budget = max(least, share * sum(sizes.value[0]))

    spots = run(points.select("id", "vec"), _place, spot, forest, chunks)
    seekers = points.join(asked.select("id").distinct(), "id", "left_semi").select("id", "vec")
    seekers = seekers.repartition("id")  # few rows, long work each
    probes = run(seekers, _probe, spot, forest, sizes, chunks, budget)
    dealt = spots.union(probes).repartition("tree", "leaf", "chunk").sortWithinPartitions("tree", "leaf", "chunk", "kind")
    near = run(dealt, _compare, "query long, id long, score double", k + 1)
    near = near.groupBy("query", "id").agg(F.min("score").alias("score"))
    best = Window.partitionBy("query").orderBy("score", "id")
    near = near.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k + 1).drop("place")
    # Points become rows again, then queries of one point share its list.
    near = near.join(points.select("id", "ids"), "id").select("query", "score", F.explode("ids").alias("id"))
    near = near.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k + 1)
    lists = near.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("score", "id"))).alias("found"))
    others = F.expr(f"slice(filter(found, f -> f.id <> query_id), 1, {k})")
    return asked.join(lists.withColumnRenamed("query", "id"), "id").select("query_id", F.posexplode(others).alias("at", "f")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("f.id").alias("vec_id"), F.col("f.score").alias("score")
    )
