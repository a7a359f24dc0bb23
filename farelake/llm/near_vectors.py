"""Near copies among vectors of one label, by a pigeonhole join over subspaces.

Two vectors whose cosine is at least c lie, brought to length 1, within a squared distance of 2 - 2c. Rotated and split into
blocks of coordinates, they must, in one block at least, keep that block's share of the distance, in proportion to its
width. So each block is a range join in few dimensions, and the union of what the blocks find is verified on the whole
vectors.

A block's leading coordinates (by the data's variance: the rotation is along its principal axes) are cut into cells of
twice the block's reach. A vector goes to each cell that lies within half the reach, and a pair meets in the cell of its
midpoint. It is taken up in the first block that finds it and in that cell only, so each link is counted once, and links
need not be stored: a task gives how many each vector has, and a spanning forest of them.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from farelake.llm.batches import run
from farelake.llm.components import components
from farelake.session import materialise

# Blocks of coordinates that vectors are split into.
BLOCKS = 8
# Points of a cell that are compared in one go; more are dealt out over pairs of chunks.
CHUNK = 4096
# Numbers of the vectors that are turned, or of the pairs that are verified, at once.
_NUMBERS = 1 << 20
# Rounding errors that block distances may have; verification is exact.
_SLACK = 1e-9

_MOMENT = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("value", pa.float64())])
_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of ``width`` numbers, zeros behind shorter ones, scaled by their largest part, against overflow."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().to_numpy()
    flat = column.flatten().cast(pa.float64()).to_numpy()
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out / np.abs(out).max(axis=1, keepdims=True, initial=0)


def _unit(vectors: np.ndarray) -> np.ndarray:
    """``vectors`` at length 1; as below, summed in one order whatever their number, so that all tasks get the same bits."""
    total = np.zeros(len(vectors))
    for column in vectors.T:
        total += column * column
    return vectors / np.sqrt(total)[:, None]


def _turned(unit: np.ndarray, axes: np.ndarray) -> np.ndarray:
    out = np.zeros((len(unit), len(axes)))
    for k in range(axes.shape[1]):
        out += unit[:, k : k + 1] * axes[:, k]
    return out


def _parts(batch: pa.RecordBatch, width: int) -> Iterator[pa.RecordBatch]:
    step = max(1, _NUMBERS // width)
    return (batch.slice(start, step) for start in range(0, batch.num_rows, step))


class Blocks:
    """Axes of the rotation by block, those of great variance first in each, and each block's share of the distance."""

    def __init__(self, moments: np.ndarray, least: float, blocks: int = BLOCKS):
        width = len(moments)
        blocks = min(blocks, width)
        _, axes = np.linalg.eigh(moments)
        axes = axes.T[::-1]  # by falling variance
        self.axes = np.ascontiguousarray(np.concatenate([axes[b::blocks] for b in range(blocks)]))
        sizes = [len(range(b, width, blocks)) for b in range(blocks)]
        ends = np.cumsum(sizes).tolist()
        self.columns = [range(e - n, e) for e, n in zip(ends, sizes)]
        self.budgets = [(2 - 2 * least) * n / width * (1 + _SLACK) + _SLACK**2 for n in sizes]
        self.least = least

    def side(self, block: int) -> float:
        return 2 * self.budgets[block] ** 0.5

    def distance(self, block: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Squared distances in a block; the same bits for a pair in any order and any shape."""
        out = 0.0
        for c in self.columns[block]:
            gap = a[..., c] - b[..., c]
            out = out + gap * gap
        return out


def _cells(turned: np.ndarray, blocks: Blocks, block: int, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, cells) of all places of the vectors in a block."""
    side = blocks.side(block)
    columns = blocks.columns[block][:depth]
    at = turned[:, columns.start : columns.stop] / side
    home = np.floor(at)
    up = at - home >= 0.5
    gap = np.where(up, home + 1 - at, at - home)
    other = np.where(up, home + 1, home - 1).astype(np.int32)
    home = home.astype(np.int32)
    for mask in range(1 << len(columns)):
        moved = np.array([bool(mask >> i & 1) for i in range(len(columns))])
        rows = np.flatnonzero((gap[:, moved] ** 2).sum(axis=1) <= (0.25 + _SLACK) ** 2)
        if len(rows):
            yield rows, np.where(moved, other[rows], home[rows])


def _moments(batches, width):
    total = np.zeros((width, width))
    for batch in batches:
        for part in _parts(batch, width):
            unit = _unit(_matrix(part.column("vector"), width))
            total += unit.T @ unit
    i, j = np.indices(total.shape, np.int32)
    yield pa.RecordBatch.from_arrays([pa.array(c.ravel()) for c in (i, j, total)], schema=_MOMENT)


def _places(batches, blocks, whole):
    """(key, node) for each cell of each vector, with the vector itself and its copies if ``whole``."""
    shared = blocks.value
    width = shared.axes.shape[1]
    for batch in batches:
        for part in _parts(batch, width):
            turned = _turned(_unit(_matrix(part.column("vector"), width)), shared.axes)
            depths = np.array(part.column("depth").to_pylist())
            tails = [n.to_bytes(4, "little") + label.encode() for n, label in zip(part.column("dims").to_pylist(), part.column("label").to_pylist())]
            for depth in np.unique(depths).tolist():
                own = np.flatnonzero(depths == depth)
                for block in range(len(shared.columns)):
                    for rows, cells in _cells(turned[own], shared, block, depth):
                        rows = own[rows]
                        heads = np.column_stack([np.full(len(rows), block), np.full(len(rows), cells.shape[1]), cells]).astype("<i4").tobytes()
                        step = len(heads) // len(rows)
                        keys = [heads[i * step : (i + 1) * step] + tails[r] for i, r in enumerate(rows.tolist())]
                        taken = part.take(pa.array(rows))
                        columns, names = [pa.array(keys, pa.binary()), taken.column("node")], ["key", "node"]
                        if whole:
                            columns += [taken.column("copies"), taken.column("vector")]
                            names += ["copies", "vector"]
                        yield pa.RecordBatch.from_arrays(columns, names)


def _cell_rows(batches) -> Iterator[tuple[tuple, pa.Table]]:
    """The rows of one cell, or of a pair of chunks of it, at a time."""
    held, own = [], None
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in ("key", "low", "high"))))
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


def _found(blocks: Blocks, block: int, cell: np.ndarray, vectors: np.ndarray, chunk: np.ndarray | None):
    """(i, j) of all links that are this block's and this cell's, some at a time."""
    unit = _unit(vectors)
    turned = _turned(unit, blocks.axes)
    norms = np.sqrt((vectors * vectors).sum(axis=1))
    n, side = len(vectors), blocks.side(block)
    columns = blocks.columns[block][: len(cell)]
    step, pairs = max(1, _NUMBERS // 4 // n), max(1, _NUMBERS // vectors.shape[1])
    for first in range(0, n, step):
        near = blocks.distance(block, turned[first : first + step, None], turned[None]) <= blocks.budgets[block]
        near &= np.arange(n) > np.arange(first, min(first + step, n))[:, None]
        if chunk is not None:
            near &= chunk != chunk[first : first + step, None]
        left, right = np.nonzero(near)
        left += first
        for at in range(0, len(left), pairs):
            i, j = left[at : at + pairs], right[at : at + pairs]
            middle = (turned[i, columns.start : columns.stop] + turned[j, columns.start : columns.stop]) / 2
            own = (np.floor(middle / side) == cell).all(axis=1)
            i, j = i[own], j[own]
            for earlier in range(block):
                own = blocks.distance(earlier, turned[i], turned[j]) > blocks.budgets[earlier]
                i, j = i[own], j[own]
            own = (vectors[i] * vectors[j]).sum(axis=1) / (norms[i] * norms[j]) >= blocks.least
            if own.any():
                yield i[own], j[own]


def _joined(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Roots of all points after links between i and j: the smallest point that each reaches."""
    while True:
        a, b = root[i], root[j]
        if (a == b).all():
            return root
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]


def _link(batches, blocks):
    shared = blocks.value
    for (key, low, high), rows in _cell_rows(batches):
        if rows.num_rows < 2:
            continue
        block, depth = np.frombuffer(key, "<i4", 2).tolist()
        cell = np.frombuffer(key, "<i4", depth, 8)
        node, copies = rows.column("node").to_numpy(), rows.column("copies").to_numpy()
        chunk = rows.column("chunk").to_numpy() if low != high else None
        vectors = _matrix(rows.column("vector"), shared.axes.shape[1])
        root, links = np.arange(len(node)), np.zeros(len(node), np.int64)
        for i, j in _found(shared, block, cell, vectors, chunk):
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            root = _joined(root, i, j)
        linked, moved = np.flatnonzero(links), np.flatnonzero(root != np.arange(len(node)))
        columns = [
            np.concatenate([node[linked], node[moved]]), np.concatenate([node[linked], node[root[moved]]]),
            np.concatenate([links[linked], np.zeros(len(moved), np.int64)]),
        ]
        if len(columns[0]):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=_LINK)


def fit_blocks(points: DataFrame, least: float, blocks: int = BLOCKS) -> Blocks:
    """The rotation for ``points``: second moments over all of them, summed in the tasks; dims x dims figures come back."""
    width = points.agg(F.max("dims")).first()[0] or 1
    rows = run(points.select("vector"), _moments, "i int, j int, value double", width).groupBy("i", "j").agg(F.sum("value").alias("value"))
    moments = np.zeros((width, width))
    for i, j, value in rows.collect():
        moments[i, j] = value
    return Blocks((moments + moments.T) / 2, least, blocks)


def links(points: DataFrame, least: float, blocks: int = BLOCKS, chunk: int = CHUNK) -> DataFrame:
    """(a, b, n), stored: n > 0 other rows are linked to a = b; or n = 0, and a and b are of one component.

    ``points`` (node, label, dims, vector, copies) are distinct in (label, vector).
    """
    spark = points.sparkSession
    fitted = fit_blocks(points, least, blocks)
    narrow = min(map(len, fitted.columns))
    counts = points.groupBy("label", "dims").agg(F.count("*").alias("n"))
    bits = F.ceil(F.log2(F.ceil(F.col("n") / chunk))) + 1
    depth = F.least(F.greatest(bits, F.lit(1)), F.lit(narrow)).cast("int").alias("depth")
    points = points.join(counts.select("label", "dims", depth), ["label", "dims"])
    shared = spark.sparkContext.broadcast(fitted)  # dims x dims figures
    vector = points.schema["vector"].dataType.simpleString()
    full = run(points, _places, "key binary, node long", shared, False).groupBy("key").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks"))
    # Stored first: where it is small, which its file tells, the join below needs no shuffle.
    full = materialise(full.filter("chunks > 1"))
    rows = run(points, _places, f"key binary, node long, copies long, vector {vector}", shared, True).join(full, "key", "left")
    rows = rows.withColumn("chunks", F.coalesce("chunks", F.lit(1))).withColumn("chunk", F.expr("CAST(pmod(xxhash64(node), chunks) AS INT)"))
    pairs = "transform(sequence(0, chunks - 1), other -> struct(least(chunk, other) AS low, greatest(chunk, other) AS high))"
    rows = rows.withColumn("pair", F.explode(F.expr(pairs))).select("key", "pair.low", "pair.high", "chunk", "node", "copies", "vector")
    dealt = rows.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    return materialise(run(dealt, _link, "a long, b long, n long", shared))


def _usable(vector: Column) -> Column:
    numbers = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(numbers & F.exists(vector, lambda x: x != 0), F.lit(False))


def near_copies(
    vectors: DataFrame, least: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    blocks: int = BLOCKS, chunk: int = CHUNK,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors``.

    Rows of one label, not null, whose cosine in double precision is ``least`` or more are linked. ``n_links`` are the other
    rows linked directly, ``component_id`` the smallest id that links reach, its own included, ``kept`` tells whether the row
    has that id. Vectors that are null, empty or zero, hold a null or a number that is not finite, and those of another
    length link with nothing.

    Equal vectors of a label are one point, so copies are never paired. A null id stays null, links like any other, and is
    never a component's id; where no id is reached, such rows are kept. Repeated rows link with one another and are kept
    or not alike. An empty table gives no rows. Other columns are not read.
    """
    given = F.col(f"`{vector_col}`")
    zero = F.lit(0).cast(vectors.schema[vector_col].dataType.elementType)  # added, as signed zeros are one number
    rows = vectors.select(
        F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").cast("string").alias("label"),
        F.when(_usable(given) & F.col(f"`{label_col}`").isNotNull(), F.transform(given, lambda x: x + zero)).alias("vector"),
    )
    points = rows.filter("vector IS NOT NULL").groupBy("label", "vector").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first"))
    points = materialise(points.withColumn("dims", F.size("vector")).withColumn("node", F.monotonically_increasing_id()))
    found = links(points, least, blocks, chunk)
    linked = found.filter("n > 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    roots = components(found.filter("n = 0").select("a", "b"))
    rooted = points.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = rooted.groupBy("root").agg(F.min("first").alias("component"))
    rooted = rooted.join(ids, "root").join(linked, "node", "left")
    rooted = rooted.select("label", "vector", "component", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    component = F.when(F.col("links").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return rows.join(rooted, ["label", "vector"], "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
