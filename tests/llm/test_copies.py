"""SimHash groups, repeated strings and suffix arrays against brute force."""

import hashlib
import random

import numpy as np
import pytest

from farelake.llm import repeats, simhash
from farelake.llm.components import components
from farelake.llm.queries import QUERIES
from farelake.llm.suffixes import repeated, suffix_array
from tests.llm.conftest import words


def fingerprint(text, width=4):
    import re

    import xxhash

    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found = re.findall("[^\x20\x09-\x0d]+", lower)
    shingles = [" ".join(found[i : i + width]) for i in range(max(len(found) - width + 1, min(len(found), 1)))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(rows, distance=4):
    """(doc_id, fingerprint, smallest id reachable) of (doc_id, text)."""
    prints = [fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(least.get(root(i), doc), doc)
    return [(doc, prints[i], least.get(root(i))) for i, (doc, _) in enumerate(rows)]


def test_groups(odd_docs, odd_rows):
    got = [(r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.groups(odd_docs).collect()]
    assert sorted(got, key=repr) == sorted(brute_groups([r[:2] for r in odd_rows]), key=repr)


def test_no_groups(no_docs):
    assert simhash.groups(no_docs).collect() == []


@pytest.mark.parametrize("distance, width", [(0, 64), (1, 64), (2, 32), (4, 22), (5, 22)])
def test_segments_leave_one_bit(distance, width):
    parts = simhash.segments(distance)
    assert sum(w for _, w in parts) == 64 and max(w for _, w in parts) == width
    assert distance // len(parts) <= 1


@pytest.mark.parametrize("chunk", [4096, 3])
def test_links_connect_what_is_near(spark, monkeypatch, chunk):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    rng = random.Random(4)
    prints = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        prints |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(6))) for _ in range(rng.choice([2, 5, 60]))}
    prints = sorted(prints)
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    edges = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), 4)
    got = {}
    for r in components(edges).collect():
        got.setdefault(r.root, set()).add(r.node % 2**64)
    assert all((a % 2**64 ^ b % 2**64).bit_count() <= 4 for a, b in edges.collect())
    left, want = set(prints), set()
    while left:
        front = {left.pop()}
        group = set(front)
        while front:
            near = {p for p in left if any((p ^ f).bit_count() <= 4 for f in front)}
            left -= near
            group |= near
            front = near
        if len(group) > 1:
            want.add(frozenset(group))
    assert {frozenset(g) for g in got.values()} == want


def test_components_of_a_chain(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(chain, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_suffix_arrays():
    rng = random.Random(5)
    for _ in range(150):
        alphabet = rng.choice([b"ab", b"\x00\x01", bytes(range(256))])
        texts = [bytes(rng.choice(alphabet) for _ in range(rng.randrange(1, 25))) for _ in range(rng.randrange(1, 9))]
        texts = [rng.choice(texts) for _ in texts]
        text, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
        owner, depth = np.array([rng.randrange(4) for _ in texts]), rng.randrange(1, 7)
        keys = [t[i : i + depth].ljust(depth, b"\0") for t in texts for i in range(len(t))]
        order = [keys[i] for i in suffix_array(text, ends, depth)]
        assert order == sorted(keys)
        least = {}
        for t, d in zip(texts, owner):
            for i in range(len(t) - depth + 1):
                least[t[i : i + depth]] = min(least.get(t[i : i + depth], 9), d)
        want = [i + depth <= len(t) and least[t[i : i + depth]] < d for t, d in zip(texts, owner) for i in range(len(t))]
        assert repeated(text, ends, owner, depth).tolist() == want


def brute_removal(rows, length=50):
    """(doc_id, kept, spans) of (doc_id, text)."""
    first = {}
    for doc, text in rows:
        data = (text or "").encode()
        for i in range(len(data) - length + 1 if doc is not None else 0):
            first[data[i : i + length]] = min(first.get(data[i : i + length], doc), doc)
    out = []
    for doc, text in rows:
        data, cuts = (text or "").encode(), []
        for i in range(len(data) - length + 1 if doc is not None else 0):
            if first[data[i : i + length]] < doc:
                if cuts and i <= cuts[-1][1]:
                    cuts[-1][1] = i + length
                else:
                    cuts.append([i, i + length])
        kept, at = b"", 0
        for a, b in cuts:
            kept, at = kept + data[at:a], b
        out.append((doc, kept + data[at:], tuple((a, b - a) for a, b in cuts)))
    return out


def removal(df):
    return [(r.doc_id, bytes(r.kept), tuple((s.start, s.length) for s in r.spans)) for r in df.collect()]


@pytest.mark.parametrize("settings", [{}, {"chunk_bytes": 2000, "part_bytes": 5000, "common": 1}])
def test_removal(odd_docs, odd_rows, settings):
    out = repeats.remove_repeats(odd_docs, **settings)
    assert out.columns == [c for c in odd_docs.columns if c not in ("kept", "spans")] + ["kept", "spans"]
    assert sorted(removal(out), key=repr) == sorted(brute_removal([r[:2] for r in odd_rows]), key=repr)


def test_removal_from_nothing(no_docs):
    assert repeats.remove_repeats(no_docs).collect() == []


def test_removal_keeps_whole_characters(spark):
    a, b = "é" * 60, "aé" + "é" * 60 + "z"
    docs = spark.createDataFrame([(1, a), (2, "x" + a[:-1] + "è" * 30), (3, b)], "doc_id long, text string")
    for r in repeats.remove_repeats(docs, whole_characters=True).collect():
        bytes(r.kept).decode()


def test_queries(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    want = {doc: (f"{fp:016x}", group) for doc, fp, group in brute_groups(rows)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op6_simhash"](spark, sf_dir).collect()} == want
    sizes = {doc: len((text or "").encode()) for doc, text in rows}
    want = {
        doc: (sizes[doc], sizes[doc] - len(kept), len(spans), hashlib.sha256(kept).hexdigest())
        for doc, kept, spans in brute_removal(rows)
    }
    got = QUERIES["op5_repeats"](spark, sf_dir).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want


@pytest.mark.parametrize("common", [repeats.COMMON, 50])
def test_a_line_that_one_document_repeats_often(spark, common):
    """One fragment stands for all its places, also where the line has a different word behind it each time."""
    line = "this very line is more than fifty bytes long, and stands here again"
    rows = [(2, "\n".join([line] * 300)), (5, "\n".join(f"{line} {i}" for i in range(300))), (1, f"x {line} y"), (9, "other " + line[:60])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    out = repeats.remove_repeats(docs, common=common, chunk_bytes=20_000, part_bytes=5_000)
    assert sorted(removal(out)) == sorted(brute_removal(rows))
