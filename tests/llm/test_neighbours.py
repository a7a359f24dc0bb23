"""Nearest neighbours against brute force."""

import numpy as np

from farelake.llm import neighbours
from farelake.llm.queries import QUERIES

ROWS = "vec_id long, embedding array<float>, score double, leaf int, place int"


def brute(rows, wanted, k):
    """query id -> [(distance, id)] of the k nearest others."""
    points = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            points[i] = np.array(v, np.float32).astype(np.float64)
    out = {}
    for q in filter(wanted, points):
        out[q] = sorted((float(np.sqrt(((points[q] - v) ** 2).sum())), i) for i, v in points.items() if i != q)[:k]
    return out


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    return {q: [(s, i) for _, s, i in sorted(rows)] for q, rows in out.items()}


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0.0, 1, 2) for i, v in rows], ROWS).repartition(3)


def test_copies_ties_and_rows_without_part(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(300)]  # many equal vectors and distances
    rows += [(i, [1.0, 1.0, 1.0, 1.0]) for i in range(300, 360)]
    rows += [(400, None), (410, [0.0] * 4), (420, [1.0, None, 0.0, 0.0]), (430, [float("nan"), 1.0, 1.0, 1.0]),
             (440, [float("inf"), 0.0, 0.0, 0.0]), (450, [1.0]), (None, [1.0, 2.0, 1.0, 1.0]), rows[20]]
    got = found(neighbours.search(frame(spark, rows), queries="id % 10 = 0", k=5))
    want = brute([r for r in rows if r[1] is None or len(r[1]) == 4], lambda i: i % 10 == 0, 5)
    assert {q: [(round(s, 9), i) for s, i in v] for q, v in got.items()} == {q: [(round(s, 9), i) for s, i in v] for q, v in want.items()}


def test_vectors_of_doubles_are_compared_as_they_are(spark):
    rows = [(i, [1.0, 1e-12 * (i * 7 % 10)]) for i in range(10)]  # equal in single precision
    frame_ = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found(neighbours.search(frame_, queries="id = 0", k=3))
    assert [i for _, i in got[0]] == [3, 6, 9] and abs(got[0][1][0] - 2e-12) < 1e-15


def test_few_and_no_vectors(spark):
    assert found(neighbours.search(frame(spark, [(0, [1.0, 0.0]), (7, [0.0, 1.0])]), queries="id % 10 = 0")) == {0: [(2**0.5, 7)]}
    assert neighbours.search(frame(spark, [(0, [1.0, 0.0])]), queries="id % 10 = 0").collect() == []
    assert neighbours.search(frame(spark, [(0, [0.0])]), queries="id % 10 = 0").collect() == []
    assert neighbours.search(spark.createDataFrame([], ROWS), queries="id % 10 = 0").collect() == []


def test_large_leaves_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CHUNK", 20)
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(6).tolist()) for i in range(500)]
    got = found(neighbours.search(frame(spark, rows), queries="id % 50 = 0", k=4))
    want = brute(rows, lambda i: i % 50 == 0, 4)
    assert {q: [i for _, i in v] for q, v in got.items()} == {q: [i for _, i in v] for q, v in want.items()}


def test_recall_of_the_forest(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(32).tolist()) for i in range(3000)]
    got = found(neighbours.search(frame(spark, rows), queries="id % 60 = 0", least=0))
    want = brute(rows, lambda i: i % 60 == 0, 10)
    hits = sum(len({i for _, i in got[q]} & {i for _, i in v}) for q, v in want.items())
    assert hits / sum(map(len, want.values())) >= 0.9
    assert all(len(v) == 10 for v in got.values())


def test_query(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got, want = found(QUERIES["op3_neighbours"](spark, sf_dir)), brute(rows, lambda i: i % 100 == 0, 10)
    assert got.keys() == want.keys()
    hits = sum(len({i for _, i in got[q]} & {i for _, i in v}) for q, v in want.items())
    assert hits / sum(map(len, want.values())) >= 0.9


def test_recall_at_the_defaults_where_not_all_is_searched(spark):
    """With the defaults, where ``share`` is more than ``least`` and leaves part of the vectors out."""
    rng = np.random.default_rng(6)
    vectors = rng.standard_normal((20_000, 32)).astype(np.float32).astype(np.float64)
    got = found(neighbours.search(frame(spark, [(i, v.tolist()) for i, v in enumerate(vectors)]), queries="id % 200 = 0"))
    hits = 0
    for q in range(0, 20_000, 200):
        near = [i for i in np.argsort(((vectors - vectors[q]) ** 2).sum(axis=1), kind="stable")[:11] if i != q][:10]
        hits += len({i for _, i in got[q]} & set(near))
    assert hits / 1000 >= 0.9
