"""Benchmark decontamination by greedy string tiling with running Karp-Rabin hashes.

Words of a document and of a benchmark item that lie in runs of at least ``least`` equal words are seeds, found by one
rolling hash over the words. For each document and item with seeds, the longest run is marked in both, then the longest
of unmarked words, and so on. The share of the item's words that gets marked is its coverage: passages in another order,
or with other words between, are caught as well.
"""

import heapq
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from farelake.llm.batches import id_and_text, keep_rows, run, slices, table, texts as plain_texts

_WORD = re.compile(r"\w+")
# Bytes of benchmark text that one broadcast may hold; a larger benchmark is gone through in parts.
PART_BYTES = 64 << 20
# Pairs of equal places that are held at once.
PAIRS = 1 << 20


def words(text: str) -> list[str]:
    return _WORD.findall(text.casefold())


@dataclass
class Tile:
    document_start: int
    item_start: int
    length: int


def tiles(document_at: np.ndarray, item_at: np.ndarray, length: np.ndarray, least: int) -> list[Tile]:
    """The tiles of one document and one item, from all their longest common runs of ``least`` words or more."""
    low = int(document_at.min())
    in_document = np.zeros(int((document_at + length).max()) - low, bool)
    in_item = np.zeros(int((item_at + length).max()), bool)
    # Longest first; of equal ones that which comes first in the document, then in the item.
    order = np.lexsort((item_at, document_at, -length))
    lengths, starts, others = length[order], document_at[order] - low, item_at[order]
    parts: list[tuple[int, int, int]] = []  # what marked words leave of longer runs
    found, at = [], 0
    while at < len(order) or parts:
        first = (-int(lengths[at]), int(starts[at]), int(others[at])) if at < len(order) else (1, 0, 0)
        if parts and parts[0] < first:
            n, d, i = heapq.heappop(parts)
        else:
            n, d, i = first
            at += 1
        n = -n
        marked = in_document[d : d + n] | in_item[i : i + n]
        if not marked.any():
            in_document[d : d + n] = in_item[i : i + n] = True
            found.append(Tile(d + low, i, n))
            begins, ends = _gaps(in_item)
            if (ends - begins).max(initial=0) < least:
                break  # the item has no room for another tile
            continue
        for a, b in zip(*(x.tolist() for x in _gaps(marked))):
            if b - a >= least:
                heapq.heappush(parts, (a - b, d + a, i + a))
    return found


def _gaps(marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of what is left between marked words."""
    edges = np.flatnonzero(np.diff(np.concatenate([[True], marked, [True]])))
    return edges[::2], edges[1::2]


def _joined(diagonal: np.ndarray, start: np.ndarray, length: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs on a diagonal of which each begins one place after the last run of ``least`` words of another, as one."""
    order = np.lexsort((start, diagonal))
    diagonal, start, length = diagonal[order], start[order], length[order]
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(diagonal) != 0) | (start[1:] != start[:-1] + length[:-1] - least + 1)
    first = np.flatnonzero(new)
    last = np.append(first, len(order))[1:] - 1
    return diagonal[first], start[first], start[last] + length[last] - start[first]


class Benchmark:
    """Items as word numbers, and the place of every run of ``least`` words by its hash."""

    def __init__(self, items: list[tuple[int, str]], least: int):
        self.least = least
        self.vocabulary: dict[str, int] = {}
        rows = [(item, words(text or "")) for item, text in items]
        rows = [(item, w) for item, w in rows if len(w) >= least]
        number = self.vocabulary.setdefault
        self.item_ids = [item for item, _ in rows]
        self.words = [np.array([number(w, len(self.vocabulary)) for w in ws], np.int64) for _, ws in rows]
        hashes = [self.hashes(w, np.arange(len(w) - least + 1)) for w in self.words]
        sizes = [len(h) for h in hashes]
        flat = np.concatenate([*hashes, np.zeros(0, np.uint64)])
        order = np.argsort(flat, kind="stable")
        self.sorted = flat[order]
        # All items in one line, with a place between two that no word is equal to.
        lengths = np.fromiter((len(w) + 1 for w in self.words), np.int64, len(rows))
        self.begin = np.cumsum(lengths) - lengths
        self.line = np.concatenate([*(np.append(w, -2) for w in self.words), np.zeros(0, np.int64)])
        self.at = np.concatenate([*(b + np.arange(n) for b, n in zip(self.begin, sizes)), np.zeros(0, np.int64)]).astype(np.int64)[order]

    def hashes(self, numbers: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Karp-Rabin hashes of the runs of ``least`` words that begin at ``at``."""
        out = np.zeros(len(at), np.uint64)
        for k in range(self.least):
            out = out * np.uint64(0x9E3779B97F4A7C15) + (numbers[at + k] + 1).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        return out

    def compare(self, texts: list[str]):
        """(text, item, words of the item, tiles) for every text and item with a common run."""
        split = [words(t) for t in texts]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        known = self.vocabulary.get
        numbers = np.fromiter((known(w, -1) for ws in split for w in ws), np.int64, int(sizes.sum()))
        ends = np.cumsum(sizes)
        unknown = np.concatenate([[0], np.cumsum(numbers < 0)])
        runs = max(len(numbers) - self.least + 1, 0)
        at = np.flatnonzero(unknown[self.least :][:runs] == unknown[:runs])
        owner = np.searchsorted(ends, at, side="right")
        inside = at + self.least <= ends[owner] if len(at) else np.zeros(0, bool)
        at, owner = at[inside], owner[inside]
        if not len(at):
            return
        value = self.hashes(numbers, at)
        low = np.searchsorted(self.sorted, value)
        often = np.searchsorted(self.sorted, value, side="right") - low
        hit = often > 0
        at, owner, low, often = at[hit], owner[hit], low[hit], often[hit]
        bounds = np.append(np.flatnonzero(np.diff(owner, prepend=-1)), len(owner))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            text = int(owner[a])
            start = int(ends[text] - sizes[text])
            diagonal, begin, length = self._runs(numbers, at[a:b], low[a:b], often[a:b])
            item = np.searchsorted(self.begin, begin - diagonal, side="right") - 1
            order = np.argsort(item, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(item[order])) + 1) if len(order) else ():
                k = int(item[own[0]])
                there = begin[own] - diagonal[own] - self.begin[k]
                yield text, k, len(self.words[k]), tiles(begin[own] - start, there, length[own], self.least)

    def _runs(self, numbers: np.ndarray, at: np.ndarray, low: np.ndarray, often: np.ndarray):
        """(diagonal, start, length) of the longest common runs of one text and all items.

        Places are paired some at a time and joined to runs at once: of a line that both repeat, all pairs of its places
        are never held, only the runs that they make.
        """
        found = []
        ends = np.cumsum(often)
        first = 0
        while first < len(at):
            stop = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + PAIRS, side="right")))
            times = often[first:stop]
            place = np.repeat(low[first:stop] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
            here, there = np.repeat(at[first:stop], times), self.at[place]
            for k in range(self.least):  # equal hashes are verified
                same = numbers[here + k] == self.line[there + k]
                if not same.all():
                    here, there = here[same], there[same]
            found.append(_joined(here - there, here, np.full(len(here), self.least), self.least))
            first = stop
        return _joined(*(np.concatenate(x) for x in zip(*found)), self.least)


_MATCH = pa.schema([
    ("doc_id", pa.int64()), ("item_id", pa.int64()), ("coverage", pa.float64()), ("matched_words", pa.int64()),
    ("item_words", pa.int64()), ("n_tiles", pa.int64()), ("longest_tile", pa.int64()),
])
_MATCH_DDL = "doc_id long, item_id long, coverage double, matched_words long, item_words long, n_tiles long, longest_tile long"


def _contaminated(texts: list[str], benchmark: Benchmark, threshold: float):
    for text, k, size, found in benchmark.compare(texts):
        marked = sum(t.length for t in found)
        if marked >= threshold * size:
            yield text, benchmark.item_ids[k], marked / size, marked, size, len(found), max(t.length for t in found)


def _match(batches, benchmark, threshold):
    for batch in batches:
        for part in slices(batch):
            ids = part.column("doc_id").to_pylist()
            rows = [(ids[r[0]], *r[1:]) for r in _contaminated(plain_texts(part), benchmark.value, threshold)]
            yield table(_MATCH, *(zip(*rows) if rows else [[]] * len(_MATCH)))


def _parts(benchmark: DataFrame, least: int, id_col: str, text_col: str):
    """Broadcasts of the benchmark, each of at most about ``PART_BYTES`` of text."""
    spark = benchmark.sparkSession
    items = id_and_text(benchmark, id_col, text_col).filter("doc_id is not null and text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(size // PART_BYTES) + 1
    for part in range(parts):
        own = items if parts == 1 else items.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)) == part)
        rows = sorted((r["doc_id"], r["text"]) for r in own.collect())
        yield spark.sparkContext.broadcast(Benchmark(rows, least))


def matches(
    docs: DataFrame, benchmark: DataFrame, least: int = 5, threshold: float = 0.5,
    id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """(doc_id, item_id, coverage, matched_words, item_words, n_tiles, longest_tile): documents that hold at least the
    share ``threshold`` of the words of a benchmark item, in common runs of at least ``least`` words.

    Words are runs of word characters, case folded. Null and empty texts match nothing; items of fewer than ``least``
    words, without an id or a text, are not looked for. Every row is compared for itself, so repeated rows and repeated
    items give repeated results; a null document id stays null. Other columns are not read.

    The benchmark is sent to all tasks, in parts whose size is checked, each with a pass over the documents; documents
    are neither shuffled nor paired with each other.
    """
    source, out = id_and_text(docs, id_col, text_col), None
    for part in _parts(benchmark, least, item_id_col, item_text_col):
        found = run(source, _match, _MATCH_DDL, part, threshold)
        out = found if out is None else out.union(found)
    return out


def _clean(benchmark, threshold):
    def decide(texts: pa.Array) -> np.ndarray:
        keep = np.ones(len(texts), bool)
        for row in _contaminated(texts.to_pylist(), benchmark.value, threshold):
            keep[row[0]] = False
        return keep

    return decide


def clean(docs: DataFrame, benchmark: DataFrame, least: int = 5, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no benchmark item to the share ``threshold`` (see ``matches``)."""
    for part in _parts(benchmark, least, "item_id", "text"):
        docs = keep_rows(docs, _clean, part, threshold)
    return docs
