"""Toxicity, quality and decontamination: held-out accuracy, folding, tiles, and odd rows."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from farelake.llm import decontamination, quality, toxicity
from farelake.llm.queries import QUERIES, grades, held_out


def test_folding():
    assert toxicity.fold("Ѕtυр1d l0ser, Ｉdïot​!").split() == toxicity.fold("stupid loser idiot").split()
    assert toxicity.fold("") == "  "


def test_exceptions_and_heaviest_term():
    model = toxicity.ToxicityModel({toxicity.fold("trash"): 3.0, " tra": 1.0}, [toxicity.fold("trash can")])
    automaton = model.automaton()
    count = lambda text: sorted(toxicity.matches(automaton, toxicity.fold(text)).values())
    assert count("trash talk") == [3.0] and count("the trash can") == [] and count("tramway trash") == [1.0, 3.0]
    assert count("extra astra") == [] and toxicity.matches(toxicity.ToxicityModel({}).automaton(), " x ") == {}


def test_toxicity_of_odd_rows(spark, odd_docs, odd_rows, no_docs):
    model = toxicity.ToxicityModel({" changed ": 9.0})
    rows = toxicity.score(model, odd_docs).collect()
    assert len(rows) == len(odd_rows) and all(0 <= r.score <= 1 for r in rows)
    assert [r.doc_id for r in rows if r.n_matches] == [15]
    assert toxicity.score(model, no_docs).collect() == []
    labels = spark.createDataFrame([(3, None), (None, 1), (999, 1), (12, 0)], "doc_id long, toxic int")
    assert toxicity.fit(odd_docs, labels).terms == {}
    assert toxicity.fit(no_docs, labels).terms == {}


def test_toxicity_held_out(spark):
    sf_dir = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = QUERIES["op1_toxicity"](spark, sf_dir).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    own = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == r.toxic for r in own]) > 0.95
    toxic, clean = ([r.score for r in own if r.toxic == t] for t in (1, 0))
    assert np.mean([a > b for a in toxic for b in clean]) > 0.6  # six toxic texts, two with words that no other has


def test_quality_held_out(spark):
    sf_dir = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").withColumn("held", held_out())
    rows = QUERIES["op7_quality"](spark, sf_dir)
    assert rows.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    own = rows.join(labels, "doc_id").filter("held").collect()
    assert np.mean([r.keep == (r.quality == 1) for r in own]) > 0.95
    assert all(0 <= r.expected_grade <= 2 and 0 <= r.tail_probability <= 1 for r in own)


def test_quality_features():
    texts = pa.array(["ab ab\nab cd ab", "", "ab", "ab cd ab cd", " x  x "])
    kind, start, end = quality._words(texts)
    assert [(kind[a:b] - (1 << quality.BITS)).tolist() for a, b in zip(start, end)] == [[0, 1, 1, 0, 2], [], [0], [0, 0, 2, 2], [0, 1]]
    buckets, start, end = quality._buckets(texts)
    assert (end - start).tolist() == [12, 0, 0, 9, 4]
    alone = [quality._buckets(pa.array([t]))[0][: max(len(t) - 2, 0)].tolist() for t in texts.to_pylist()]
    assert [buckets[a:b].tolist() for a, b in zip(start, end)] == alone


def test_quality_of_odd_rows(spark, odd_docs, odd_rows, no_docs):
    ratings = spark.createDataFrame([(9, 2), (12, 0), (27, 1), (None, 1), (15, None), (18, 7)], "doc_id long, grade int")
    model = quality.fit(odd_docs, ratings, levels=3)
    assert (np.diff(model.thresholds) > 0).all()
    assert quality.score(model, odd_docs).count() == len(odd_rows)
    assert quality.score(model, no_docs).collect() == []
    empty = quality.fit(no_docs, ratings, levels=3)
    assert all(r.tail_probability > 0.5 for r in quality.score(empty, odd_docs).collect())


def test_ordinal_gradient():
    """Training raises the likelihood, and grades come out in order."""
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(300):
        grade = int(rng.integers(3))
        rows.append({"grade": grade, "buckets": np.array([grade, 5], "<i4").tobytes(), "shares": np.array([50, 50], "<f4").tobytes()})
    model = quality._train(rows, 3, 200, 0.05, 1e-4)
    scores = 50 * model.weights[:3] + 50 * model.weights[5]
    expected = model.above(scores).sum(axis=1)
    assert expected[0] < 0.3 < 0.7 < expected[1] < 1.3 < 1.7 < expected[2]


def brute_tiles(document, item, least):
    marked, taken, out = [False] * len(document), [False] * len(item), []
    while True:
        best = (0, 0, 0)
        for a in range(len(document)):
            for b in range(len(item)):
                n = 0
                while a + n < len(document) and b + n < len(item) and document[a + n] == item[b + n] and not marked[a + n] and not taken[b + n]:
                    n += 1
                best = max(best, (n, -a, -b))
        n, a, b = best[0], -best[1], -best[2]
        if n < least:
            return sorted(out)
        marked[a : a + n] = taken[b : b + n] = [True] * n
        out.append((a, b, n))


def test_tiles():
    rng = random.Random(6)
    for _ in range(150):
        alphabet = "abcdefgh"[: rng.randrange(2, 8)]
        document = [rng.choice(alphabet) for _ in range(rng.randrange(35))]
        item = [rng.choice(alphabet) for _ in range(rng.randrange(3, 25))]
        found = decontamination.Benchmark([(1, " ".join(item))], 3).compare(["zz", " ".join(document)])
        assert sorted((t.document_start, t.item_start, t.length) for r in found for t in r[3]) == brute_tiles(document, item, 3)


def test_reordered_passages(spark, odd_docs, no_docs, monkeypatch):
    item = " ".join(f"w{i}" for i in range(40))
    mixed = " ".join(f"W{i}," for i in [*range(20, 40), *range(20)])
    half = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"so {mixed} then"), (2, half), (None, item), (4, None), (5, ""), (1, item)], "doc_id long, text string")
    items = "item_id long, text string, score int"
    benchmark = spark.createDataFrame([(7, item, 0), (8, "too short", 0), (9, None, 0), (None, item, 0), (7, item, 1)], items)
    got = decontamination.matches(docs, benchmark).collect()
    assert sorted(((r.doc_id, r.item_id, r.coverage, r.n_tiles) for r in got), key=repr) == sorted(
        [(1, 7, 1.0, 2), (1, 7, 1.0, 1), (None, 7, 1.0, 1)] * 2, key=repr
    )
    monkeypatch.setattr(decontamination, "PART_BYTES", 100)  # the benchmark in parts
    assert sorted(decontamination.matches(docs, benchmark).collect(), key=repr) == sorted(got, key=repr)
    assert sorted(r.doc_id for r in decontamination.clean(docs, benchmark).collect()) == [2, 4, 5]
    assert decontamination.matches(no_docs, benchmark).collect() == []
    nothing = spark.createDataFrame([], items)
    assert decontamination.matches(docs, nothing).collect() == [] and decontamination.clean(odd_docs, nothing).count() == odd_docs.count()


def test_decontamination_query(spark, sf_dir):
    plain = lambda text: " ".join(re.findall(r"\w+", (text or "").casefold()))
    docs = {r.doc_id: plain(r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    items = {r.item_id: plain(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    whole = {(d, i) for d, text in docs.items() for i, item in items.items() if f" {item} " in f" {text} "}
    got = {(r.doc_id, r.item_id): r for r in QUERIES["op10_decontamination"](spark, sf_dir).collect()}
    assert whole <= got.keys()
    tiles = lambda d, i: brute_tiles(docs[d].split(), items[i].split(), 5)
    for d, i in list(got)[:3]:
        assert got[d, i].matched_words == sum(n for _, _, n in tiles(d, i))


@pytest.mark.parametrize("quality_, toxic, grade", [(0, 0, 0), (0, 1, 0), (1, 1, 1), (1, 0, 2), (None, 0, None), (1, None, 2)])
def test_grades(spark, quality_, toxic, grade):
    assert grades(spark.createDataFrame([(1, quality_, toxic)], "doc_id long, quality int, toxic int")).first().grade == grade


def naive_toxicity(model, text):
    """The score by looking for every term at every place."""
    folded = toxicity.fold(text)
    places = lambda part: [i for i in range(len(folded)) if folded.startswith(part, i)]
    found = {}
    for term, weight in model.terms.items():
        for at in places(term):
            found[at] = max(found.get(at, 0.0), weight)
    for phrase in model.exceptions:
        for at in places(phrase):
            found = {i: w for i, w in found.items() if not at <= i < at + len(phrase) - 1}
    n = len(folded.split())
    x = (max(found.values()), sum(found.values()) / (n + 10) ** 0.5, 10 * sum(found.values()) / (n + 10)) if found else (0, 0, 0)
    z = model.coefficients[0] + sum(a * b for a, b in zip(model.coefficients[1:], x))
    return 1 / (1 + np.exp(-z)), len(found)


def test_toxicity_equals_naive_matching(spark, odd_docs):
    terms = {" bad ": 2.0, " awfu": 1.5, " awful ": 3.0, " worst ": 1.0, " short": 0.5, " xxxx": 2.5}
    model = toxicity.ToxicityModel(terms, [" not bad ", " bad luck "], (-2.0, 0.7, 0.3, 0.2))
    texts = ["b4d not bad BAD luck", "аwful, awfully bad", "w0rst" * 3, "the worst. worst", "", None, "n o t bad", "bad bad bad"]
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(odd_docs.filter("doc_id is not null").select(
        (F.col("doc_id") + 1000 + F.monotonically_increasing_id()).alias("doc_id"), "text"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in toxicity.score(model, docs).collect():
        score, n = naive_toxicity(model, texts[r.doc_id] or "")
        assert (r.n_matches, r.score) == (n, pytest.approx(score, abs=1e-12))


def test_learned_toxicity_equals_naive_matching(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in toxicity.score(model, docs).collect():
        if len(texts[r.doc_id] or "") < 20_000:
            score, n = naive_toxicity(model, texts[r.doc_id] or "")
            assert (r.n_matches, r.score) == (n, pytest.approx(score, abs=1e-9))


def naive_quality(model, text):
    raw = text.encode()
    mean = lambda weights: sum(weights) / max(len(weights), 1)
    bucket = lambda i: ((raw[i] | raw[i + 1] << 8 | raw[i + 2] << 16) * 0x9E3779B1 % 2**32) >> (32 - quality.BITS)
    runs = [float(model.weights[bucket(i)]) for i in range(len(raw) - 2)]
    words = [w for w in re.split(rb"[ \n\t]+", raw) if w]
    kind = [1 if i and words[i - 1] == w else 2 if i > 1 and words[i - 2] == w else 0 for i, w in enumerate(words)]
    return 100 * (mean(runs) + mean([float(model.weights[(1 << quality.BITS) + k]) for k in kind]))


def test_quality_equals_a_naive_score(spark, sf_dir, odd_rows):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, grades(labels), levels=3)
    texts = [r.text or "" for r in docs.collect()] + [r[1] or "" for r in odd_rows]
    found = model.scores(pa.array(texts))
    assert found.tolist() == pytest.approx([naive_quality(model, t) for t in texts], abs=1e-4)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality.score(model, frame).collect():
        above = 1 / (1 + np.exp(-(naive_quality(model, texts[r.doc_id]) - model.thresholds)))
        assert (r.expected_grade, r.tail_probability) == (pytest.approx(above.sum(), abs=1e-4), pytest.approx(above[0], abs=1e-4))


def test_a_sample_is_bounded_and_does_not_depend_on_the_order_of_rows(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    twice = docs.unionByName(docs.withColumn("text", F.concat("text", F.lit(" more"))))
    settings = {"levels": 3, "sample": 40, "features": 20_000, "steps": 5}
    first = quality.fit(twice.repartition(7), grades(labels), **settings)
    again = quality.fit(twice.repartition(2), grades(labels), **settings)
    assert np.array_equal(first.weights, again.weights) and np.array_equal(first.thresholds, again.thresholds)


def longest_runs(document, item, least):
    """Greedy tiles, by a table of common runs that is made anew for each tile; (document, item, length)."""
    number = {w: i for i, w in enumerate(dict.fromkeys(item))}
    d, t = np.array([number.get(w, -1) for w in document]), np.array([number[w] for w in item])
    marked, taken, out = np.zeros(len(d), bool), np.zeros(len(t), bool), []
    while True:
        best, run = (0, 0, 0), np.zeros(len(t) + 1, np.int64)
        for a in range(len(d) - 1, -1, -1):
            run[:-1] = np.where((t == d[a]) & ~taken & (not marked[a]), run[1:] + 1, 0)
            if run.max() >= best[0]:
                b = int(run.argmax())
                best = (int(run[b]), a, b)
        n, a, b = best
        if n < least:
            return out
        marked[a : a + n] = taken[b : b + n] = True
        out.append((a, b, n))


def test_decontamination_equals_all_pairs(spark, sf_dir):
    """Every document with every item, also those that no seed joins."""
    plain = lambda text: re.findall(r"\w+", (text or "").casefold())
    docs = {r.doc_id: plain(r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    items = {r.item_id: plain(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    want = {}
    for d, words_ in docs.items():
        for i, item in items.items():
            if len(item) >= 5 and len(set(item) & set(words_)) * 2 >= len(set(item)) * 0.5:
                marked = sum(n for _, _, n in longest_runs(words_, item, 5))
                if marked >= 0.5 * len(item):
                    want[d, i] = marked
    got = {(r.doc_id, r.item_id): r.matched_words for r in QUERIES["op10_decontamination"](spark, sf_dir).collect()}
    assert got == want


def test_a_line_that_document_and_item_repeat():
    line = "alpha beta gamma delta epsilon zeta eta theta".split()
    document = [w for i in range(60) for w in [*line, f"x{i}"]]
    item = [w for i in range(9) for w in [*line, f"y{i}"]]
    benchmark = decontamination.Benchmark([(1, " ".join(item))], 5)
    found = list(benchmark.compare([" ".join(document)]))
    assert sorted((t.document_start, t.item_start, t.length) for t in found[0][3]) == sorted(longest_runs(document, item, 5))
