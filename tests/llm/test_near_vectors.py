"""The pigeonhole join against all pairs."""

import duckdb
import numpy as np
import pytest

from farelake.llm import near_vectors, queries

COLUMNS = "vec_id long, embedding array<{}>, label int, node long, copies long, key string, component string"


def clusters(seed, n, width, labels, spread):
    """Vectors around a few centres, of any length, a part of them exact copies."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(2, n // 12), width))
    out = []
    for i in range(n):
        v = centres[rng.integers(len(centres))] + rng.normal(size=width) * spread * rng.random()
        if out and rng.random() < 0.2:
            v = np.array(out[rng.integers(len(out))][1])
        out.append((i * 3, (v * rng.choice([1.0, 2.5])).tolist(), int(rng.integers(labels))))
    return out


def expected(rows, least):
    """(vec_id, n_links, component_id, kept) from all pairs."""
    usable = [
        lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, lab in rows
    ]
    near = {i: set() for i in range(len(rows))}
    for i in near:
        for j in range(i):
            if usable[i] and usable[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = (np.array(rows[k][1], float) for k in (i, j))
                a, b = a / np.abs(a).max(), b / np.abs(b).max()
                if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= least:
                    near[i].add(j)
                    near[j].add(i)
    root = {}
    for i in near:
        if i not in root:
            group, front = {i}, [i]
            while front:
                new = near[front.pop()] - group
                group |= new
                front += new
            ids = [rows[k][0] for k in group if rows[k][0] is not None]
            root |= dict.fromkeys(group, min(ids, default=None))
    return sorted(((r[0], len(near[i]), root[i], r[0] == root[i]) for i, r in enumerate(rows)), key=repr)


def found(spark, rows, kind="double", **more):
    frame = spark.createDataFrame([(*r, 1, 2, "k", "c") for r in rows], COLUMNS.format(kind)).repartition(3)
    return sorted(map(tuple, near_vectors.near_copies(frame, **more).collect()), key=repr)


@pytest.mark.parametrize("width, blocks, least", [(16, 4, 0.98), (5, 8, 0.9), (1, 8, 0.98)])
def test_links_equal_those_of_all_pairs(spark, width, blocks, least):
    rows = clusters(width, 260, width, 3, 0.35)
    want = expected(rows, least)
    assert width == 1 or len({w[1] for w in want}) > 4
    assert found(spark, rows, least=least, blocks=blocks) == want


def test_full_cells_are_compared_over_pairs_of_chunks(spark):
    rows = clusters(7, 240, 8, 1, 0.1)
    assert found(spark, rows, least=0.98, blocks=2, chunk=16) == expected(rows, 0.98)


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (4, None, 1), (5, [], 1), (6, [0.0, 0.0], 1), (7, [1.0, None], 1), (8, [nan, 1.0], 1), (9, [inf, 1.0], 1),
        (10, [1.0, 2.0], None), (11, [1.0, 2.0], None), (12, [1.0, 2.0], 1), (13, [2.0, 4.0], 1), (14, [1.0, 2.0, 0.0], 1),
        (15, [1.0, 2.0], 2), (None, [1.0, 2.0], 1), (None, [9.0, -1.0], 3), (13, [2.0, 4.0], 1), (16, [1e300, 2e300], 1),
        (17, [1e-300, 2e-300], 1), (18, [-1.0, -2.0], 1), (19, [0.0, 3.0], 4), (20, [-0.0, 3.0], 4), (None, None, None),
    ]
    want = expected(rows, 0.98)
    assert found(spark, rows) == want
    assert (12, 5, 12, True) in want and (None, 5, 12, False) in want and (None, 0, None, True) in want
    assert found(spark, [r for r in rows if r[1] is None]) == [(4, 0, 4, True), (None, 0, None, True)]


def test_empty_table(spark):
    assert found(spark, []) == []


def test_pairs_meet_once_whatever_the_cells():
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(12, 24)).repeat(30, axis=0) + rng.normal(size=(360, 24)) * 0.06
    unit = near_vectors._unit(vectors)
    blocks = near_vectors.Blocks(unit.T @ unit, 0.98, 6)
    turned = near_vectors._turned(unit, blocks.axes)
    pairs = []
    for block in range(6):
        places = {}
        for rows, cells in near_vectors._cells(turned, blocks, block, 3):
            for r, c in zip(rows.tolist(), cells.tolist()):
                places.setdefault(tuple(c), []).append(r)
        for cell, rows in places.items():
            for i, j in near_vectors._found(blocks, block, np.array(cell), vectors[rows], None):
                pairs += [tuple(sorted((rows[a], rows[b]))) for a, b in zip(i.tolist(), j.tolist())]
    i, j = np.nonzero(np.triu(unit @ unit.T >= 0.98, 1))
    assert len(i) > 1000 and sorted(pairs) == sorted(zip(i.tolist(), j.tolist()))


def test_query_equals_sql(spark, sf_dir, tmp_path):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    rows = sorted(map(tuple, queries.op13_near_vectors(spark, sf_dir).collect()))
    assert rows == sorted(con.execute(queries.ORACLE["op13_near_vectors"]).fetchall())
    near = [(i, v, lab) for i, v, lab in clusters(9, 200, 12, 2, 0.3)]
    spark.createDataFrame(near, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con.execute(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    rows = sorted(map(tuple, queries.op13_near_vectors(spark, str(tmp_path)).collect()))
    assert rows == sorted(con.execute(queries.ORACLE["op13_near_vectors"]).fetchall())
    assert len({r[1] for r in rows}) > 4
