"""Periodic runs of words, as maximal pairs of one document's suffixes.

A run (a stretch with smallest period q, at least twice as long, that no neighbouring word extends) is a pair of equal
passages q words apart whose left words differ and whose right words differ: a maximal pair. Its passages are longer
than q, so nothing has to be extended. Maximal pairs are read off the tree of LCP intervals, bottom up:

1. Positions whose first ``GRAM`` words recur in their document are sorted by prefix doubling; no others lie in an
   interval deep enough for a run.
2. An interval joins its children's positions, each in the class of its left word. Pairs of different children and
   classes, no further apart than the interval's depth, are maximal pairs.
3. Pairs with the same ends are one run; its period is the smallest distance.

Of the places of a passage within its own length to the right of one, all have the same left word, and of those to the
left all but the first have that of the place itself: equal passages that close repeat with their period. So one look
at the nearest place to the right and at the furthest to the left decides over all, and pairs of one class are never met.
"""

import re
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from farelake.llm.batches import id_and_text, run, slices, text_array

_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_FOUND = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", _RUNS), ("collapsed", pa.string())])
_FOUND_DDL = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
# Bytes of a text whose words are Python objects at once.
_PIECE = 1 << 20
# Children of an interval from which on they are joined at once, by arrays.
_MANY = 32


def word_ids(text: bytes, vocabulary: dict[bytes, int]) -> np.ndarray:
    """The words of ``text`` as numbers of ``vocabulary``, which takes in new ones."""
    parts, at = [np.zeros(0, np.int64)], 0
    while at < len(text):
        cut = _SPACE.search(text, at + _PIECE)
        end = cut.start() if cut else len(text)
        words = text[at:end].split()  # of bytes: ASCII white space only
        parts.append(np.fromiter(map(vocabulary.__getitem__, words), np.int64, len(words)))
        at = end
    return np.concatenate(parts)


def _recurring(line: np.ndarray, owner: np.ndarray, gram: int) -> np.ndarray:
    """Positions whose grams recur in their document (by hash: a few others may be among them)."""
    padded = np.concatenate([line, np.zeros(gram, np.int64)]).astype(np.uint64)
    value = owner.astype(np.uint64)
    for k in range(gram):
        value = value * np.uint64(0x9E3779B97F4A7C15) + padded[k : k + len(line)]
        value ^= value >> np.uint64(29)
    order = np.argsort(value)
    value = value[order]
    same = value[1:] == value[:-1]
    out = np.zeros(len(line), bool)
    out[order] = np.append(same, False) | np.append(False, same)
    return np.flatnonzero(out)


def _ranked(line: np.ndarray, owner: np.ndarray, at: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, new): positions ``at`` by document and the words of their grams, and where another gram begins."""
    bits = int(line.max()).bit_length()
    several = max(1, 63 // bits)
    line = np.concatenate([line, np.zeros(gram, np.int64)])
    columns = [owner[at]]
    for k in range(0, gram, several):
        packed = np.zeros(len(at), np.int64)
        for j in range(k, min(k + several, gram)):
            packed = packed << bits | line[at + j]
        columns.append(packed)
    order = np.lexsort(columns[::-1])
    new = np.ones(len(at), bool)
    new[1:] = np.any([c[order[1:]] != c[order[:-1]] for c in columns], axis=0)
    return at[order], new


def _sorted_suffixes(line: np.ndarray, owner: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes, group): positions with recurring grams in the order of their suffixes; those of one gram are a group.

    Every document ends with a number of its own, so suffixes differ and never match past an end.
    """
    recurring = _recurring(line, owner, gram)
    # What a recurring stretch is continued by decides its order, too.
    order, new = _ranked(line, owner, np.union1d(recurring, np.minimum(recurring + gram, len(line) - 1)), gram)
    place = np.arange(len(order))
    first = np.maximum.accumulate(np.where(new, place, 0))
    rank = np.full(len(line), -1)
    rank[order] = first
    slots = place[~(new & np.append(new[1:], True))] if len(order) else place
    suffixes, group = order[slots], first[slots]
    open_ = np.arange(len(slots))
    depth = gram
    while len(open_):
        own = suffixes[open_]
        after = rank[own + depth]
        by = np.lexsort((after, rank[own]))
        own, after = own[by], after[by]
        head = rank[own]
        new = np.ones(len(own), bool)
        new[1:] = (head[1:] != head[:-1]) | (after[1:] != after[:-1])
        suffixes[open_] = own
        rank[own] = slots[open_][np.maximum.accumulate(np.where(new, np.arange(len(own)), 0))]
        open_ = open_[~(new & np.append(new[1:], True))]
        depth *= 2
    return suffixes, group


def _prefixes(line: np.ndarray, suffixes: np.ndarray, group: np.ndarray, gram: int) -> np.ndarray:
    """The words each suffix shares with the one before it; 0 where that has another gram.

    Where both have the same left word, the suffixes one word earlier are neighbours, too, and share one word more. So only
    places with different left words are compared.
    """
    out = np.zeros(len(suffixes), np.int64)
    slot = np.flatnonzero(group[1:] == group[:-1]) + 1
    slot = slot[np.argsort(suffixes[slot])]
    own, other = suffixes[slot], suffixes[slot - 1]
    at = np.flatnonzero(line[own - 1] != line[other - 1])
    shared = np.full(len(at), gram, np.int64)
    going = np.arange(len(at))
    for _ in range(64):
        if not len(going):
            break
        going = going[line[own[at[going]] + shared[going]] == line[other[at[going]] + shared[going]]]
        shared[going] += 1
    for i in going.tolist():
        a, b, step = int(own[at[i]]), int(other[at[i]]), 256
        while True:
            length = int(shared[i])
            size = min(step, len(line) - length - max(a, b))
            differs = line[a + length : a + length + size] != line[b + length : b + length + size]
            if differs.any():
                shared[i] += int(differs.argmax())
                break
            shared[i] += size
            step *= 4
    if len(slot):
        last = np.searchsorted(at, np.arange(len(slot)), side="right") - 1
        out[slot] = shared[last] - (own - own[at[last]])
    return out


class _Pairs:
    """Maximal pairs of distance and depth within bounds, as runs by their ends."""

    def __init__(self, left: dict[int, int], least: int):
        self.left, self.least = left, least
        self.runs: dict[tuple[int, int], int] = {}

    def add(self, start: int, again: int, depth: int):
        period = again - start
        if period + depth >= self.least:
            ends = (start, again + depth)
            self.runs[ends] = min(self.runs.get(ends, period), period)

    def join(self, depth: int, children: list[list[int]]) -> list[int]:
        """All positions of an interval, in order; ``children`` are its parts."""
        if len(children) > _MANY:
            return self._join_many(depth, children)
        children.sort(key=len)
        whole = children.pop()
        left = self.left
        for child in children:
            for own in child:
                at = bisect_right(whole, own)
                if at < len(whole) and left[whole[at]] != left[own]:
                    while at < len(whole) and whole[at] - own <= depth:
                        self.add(own, whole[at], depth)
                        at += 1
                at = bisect_left(whole, own - depth)
                if at < len(whole) and whole[at] < own and left[whole[at]] != left[own]:
                    self.add(whole[at], own, depth)
            for own in child:
                insort(whole, own)
        return whole

    def _join_many(self, depth: int, children: list[list[int]]) -> list[int]:
        child = np.repeat(np.arange(len(children)), [len(c) for c in children])
        whole = np.array([p for c in children for p in c])
        order = np.argsort(whole)
        whole, child = whole[order], child[order]
        left = np.array([self.left[p] for p in whole.tolist()])
        at = np.flatnonzero(left[1:] != left[:-1])  # the nearest place to the right decides over all
        step = 1
        while len(at):
            at = at[at + step < len(whole)]
            at = at[whole[at + step] - whole[at] <= depth]
            for i in at[child[at + step] != child[at]].tolist():
                self.add(int(whole[i]), int(whole[i + step]), depth)
            step += 1
        return whole.tolist()

    def interval_tree(self, suffixes: list[int], shared: list[int]):
        """The intervals of one gram's suffixes, bottom up."""
        stack: list[tuple[int, list[list[int]]]] = []
        last = [suffixes[0]]
        for own, depth in zip(suffixes[1:], shared[1:]):
            while stack and stack[-1][0] > depth:
                inner, children = stack.pop()
                children.append(last)
                last = self.join(inner, children)
            if stack and stack[-1][0] == depth:
                stack[-1][1].append(last)
            else:
                stack.append((depth, [last]))
            last = [own]
        while stack:
            inner, children = stack.pop()
            children.append(last)
            last = self.join(inner, children)


def runs_of(documents: list[np.ndarray], least: int = 12) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of all runs of ``least`` words or more in each document, by start, then period."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    # A run of L words and period q repeats L - q words: at least L / 2.
    gram = max(1, (least + 1) // 2)
    sizes = np.array([len(d) for d in documents], np.int64)
    if not sizes.sum():
        return found
    top = max(int(d.max()) for d in documents if len(d)) + 2
    parts = [np.array([top - 1])]
    for i, d in enumerate(documents):
        parts += [d, np.array([top + i])]
    line = np.concatenate(parts)
    begin = np.concatenate([[1], 1 + np.cumsum(sizes + 1)])
    owner = np.concatenate([[0], np.repeat(np.arange(len(documents)), sizes + 1)])
    suffixes, group = _sorted_suffixes(line, owner, gram)
    if not len(suffixes):
        return found
    shared = _prefixes(line, suffixes, group, gram)
    left = line[suffixes - 1]
    first = np.flatnonzero(np.diff(group, prepend=-1))
    last = np.append(first[1:], len(group))
    # Where all left words of a gram are the same, none of its intervals has two classes.
    mixed = np.minimum.reduceat(left, first) != np.maximum.reduceat(left, first)
    for a, b in zip(first[mixed].tolist(), last[mixed].tolist()):
        own = suffixes[a:b].tolist()
        pairs = _Pairs(dict(zip(own, left[a:b].tolist())), least)
        pairs.interval_tree(own, shared[a:b].tolist())
        for (start, end), period in pairs.runs.items():
            document = int(np.searchsorted(begin, start, side="right")) - 1
            found[document].append((start - int(begin[document]), end - start, period))
    for own in found:
        own.sort(key=lambda r: (r[0], r[2]))
    return found


def left_over(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: those that no run contains after its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:-1]) == 0


def _find(batches: Iterator[pa.RecordBatch], least: int, rewrite: Callable | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            vocabulary: dict[bytes, int] = defaultdict(count().__next__)
            documents = [word_ids(t, vocabulary) for t in text_array(part).cast(pa.binary()).to_pylist()]
            if rewrite:
                documents = [d[rewrite(i, len(d))] if len(d) else d for i, d in zip(part.column("doc_id").to_pylist(), documents)]
            found = runs_of(documents, least)
            names = np.array(list(vocabulary) or [b""], object)
            kept = [d[left_over(len(d), r)] if r else d for d, r in zip(documents, found)]
            texts = [b" ".join(names[d].tolist()).decode() for d in kept]
            spans = [[{"start": s, "length": n, "period": p} for s, n, p in r] for r in found]
            columns = [part.column("doc_id"), [len(d) for d in documents], spans, texts]
            whole = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _FOUND)], schema=_FOUND)
            yield from slices(whole, "collapsed")


def find_runs(
    docs: DataFrame, least: int = 12, id_col: str = "doc_id", text_col: str = "text", rewrite: Callable | None = None
) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for each row of ``docs``.

    ``runs`` are all runs (start, length, period) of max(``least``, 2 * period) words or more, by start, then period, in
    words from 0; ``collapsed`` are the words that no run contains after its first period, joined by one space. Words are
    what ASCII white space separates, in whole texts. ``rewrite(doc_id, n)`` may give, for each of n > 0 words, the number of
    the word to put in its place.

    Null texts are empty: no words, no runs, an empty collapsed text. Rows are independent of one another: repeated rows
    get a row each, ids may be null. An empty table gives no rows. Other columns are not read. Nothing is shuffled; a
    task holds 4 MB of text, or one longer document, at once.
    """
    return run(id_and_text(docs, id_col, text_col), _find, _FOUND_DDL, least, rewrite)
