"""Periodic runs against a search of every period."""

import random
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest

from farelake.llm import queries, runs


def every_period(words, least=12):
    n, ends = len(words), {}
    for period in range(1, n // 2 + 1):
        start = 0
        while start < n:
            end = start
            while end + period < n and words[end] == words[end + period]:
                end += 1
            length = end + period - start
            if end > start and length >= max(least, 2 * period):
                ends.setdefault((start, length), period)
            start = end + 1
    return sorted(((s, n, p) for (s, n), p in ends.items()), key=lambda r: (r[0], r[2]))


def some_words(rng):
    n, alphabet = rng.randrange(90), rng.choice([1, 2, 2, 3, 5, 30])
    line = [rng.randrange(alphabet) for _ in range(n)]
    if n > 10 and rng.random() < 0.5:
        a = rng.randrange(n)
        period = 1 + rng.randrange(max(1, (n - a) // 2))
        line = line[:a] + [line[a + (i - a) % period] for i in range(a, n)]
    return line + line[: rng.randrange(n + 1)] + line if rng.random() < 0.3 else line


@pytest.mark.parametrize("seed", range(8))
def test_runs_equal_those_of_every_period(seed):
    rng = random.Random(seed)
    for _ in range(60):
        documents = [some_words(rng) for _ in range(rng.randrange(1, 6))]
        least = rng.choice([2, 5, 7, 12, 13])
        found = runs.runs_of([np.array(d, np.int64) for d in documents], least)
        assert found == [every_period(d, least) for d in documents]


@pytest.mark.parametrize("least", [2, 12])
def test_intervals_of_many_children(least, monkeypatch):
    monkeypatch.setattr(runs, "_MANY", 2)
    rng = random.Random(5)
    line = []
    for _ in range(60):
        line += [0, 1, 2, 0, 1, 2, 0] + [rng.randrange(3, 5) for _ in range(rng.randrange(1, 4))]
    assert runs.runs_of([np.array(line)], least)[0] == every_period(line, least)


def test_long_documents_of_one_word_and_of_one_line():
    one = np.zeros(100_000, np.int64)
    line = np.concatenate([[*range(10), 10 + i] for i in range(20_000)])
    assert runs.runs_of([one, line, np.arange(50_000) % 777]) == [[(0, 100_000, 1)], [], [(0, 50_000, 777)]]


def test_words_in_pieces(monkeypatch):
    monkeypatch.setattr(runs, "_PIECE", 5)
    text = "a bc\t déf \x0b\x1c\x85 ghijklmnop\r\nq  ".encode()
    vocabulary = runs.defaultdict(runs.count().__next__)
    found = runs.word_ids(text, vocabulary)
    assert [list(vocabulary)[i] for i in found] == text.split()


def expected(doc_id, text):
    words = (text or "").encode().split()
    if words and doc_id is not None and crc32(str(doc_id).encode()) % 10 == 0:
        g = crc32(str(doc_id).encode()) // 10
        a, n = g % len(words), len(words)
        words = [words[i] if i < a else words[a + (i - a) % (1 + (n - a) // (3 + g % 8))] for i in range(n)]
    found = every_period(words)
    dropped = {i for s, n, p in found for i in range(s + p, s + n)}
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in found)
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    milli = 1000 * best[1] // best[2] if found else None
    return (doc_id, len(found), *best, milli, sha256(lines.encode()).hexdigest(), sha256(kept).hexdigest())


COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_query_equals_brute_force(spark, odd_rows, tmp_path):
    repeated = "one two three " * 50
    rows = [(r[0], r[1], "x") for r in odd_rows if len(r[1] or "") < 20_000]
    rows += [(i, (repeated if i % 3 else "") + f"w{i % 7} " * (i % 20), None) for i in range(1000, 1120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op11_runs(spark, str(tmp_path)).select(*COLUMNS).collect()
    assert sorted(map(tuple, found), key=repr) == sorted((expected(i, t) for i, t, _ in rows), key=repr)


def test_query_on_the_smallest_tables(spark, sf_dir):
    found = {r.doc_id: tuple(r) for r in queries.op11_runs(spark, sf_dir).select(*COLUMNS).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert len(found) == len(docs)
    for doc in docs:
        if len(doc.text or "") < 15_000:
            assert found[doc.doc_id] == expected(doc.doc_id, doc.text)


def test_empty_table_and_odd_rows(spark, odd_docs, no_docs):
    assert runs.find_runs(no_docs).count() == 0
    found = runs.find_runs(odd_docs).collect()
    assert len(found) == odd_docs.count()
    assert {(r.n_words, r.collapsed) for r in found if r.doc_id == 0} == {(0, "")}
