"""Token counts by rank-synchronous merging of ragged arrays.

Pre-tokens of a batch lie one after another in numpy arrays. In each round every sequence merges all places of its
lowest-ranked pair at once, until no pair is left; the surviving symbols are its tokens. Each distinct pre-token is
merged once per worker.
"""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from farelake.llm.batches import id_and_text, run, slices, table, texts

# Distinct pre-tokens that a Python worker remembers; beyond, it starts afresh.
REMEMBERED = 400_000

_SPACE = "▁"  # how sentencepiece writes a space
_NONE = np.int32(2**31 - 1)
_COUNTS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])


class PieceMerger:
    """Counts the pieces of a sentencepiece BPE model (its serialized bytes)."""

    def __init__(self, model: bytes, remembered: int = REMEMBERED):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = self.processor.vocab_size()
        kind = self.processor
        pieces = {
            kind.id_to_piece(i): kind.get_score(i) for i in range(n)
            if not (kind.is_control(i) or kind.is_unknown(i) or kind.is_byte(i))
        }
        self.bytes_as_pieces = any(kind.is_byte(i) for i in range(n))
        names = list(pieces)
        number = {p: i for i, p in enumerate(names)}
        # Equal scores have equal rank: the leftmost pair then goes first.
        scores = -np.array([pieces[p] for p in names])
        rank = np.unique(scores, return_inverse=True)[1].astype(np.int32)
        self.size = len(names)
        self.symbol = np.full(0x110000, -1, np.int32)
        rules, neighbours = [], set()
        for piece, i in number.items():
            if len(piece) == 1:
                self.symbol[ord(piece)] = i
                continue
            neighbours.update(zip(map(ord, piece), map(ord, piece[1:])))
            for k in range(1, len(piece)):
                if piece[:k] in number and piece[k:] in number:
                    rules.append((number[piece[:k]] * self.size + number[piece[k:]], rank[i], i))
        rules = np.array(sorted(rules), np.int64).reshape(-1, 3)
        self.keys, self.ranks, self.merged = rules[:, 0].copy(), rules[:, 1].astype(np.int32), rules[:, 2].astype(np.int32)
        self.neighbours = np.sort(np.array([a << 21 | b for a, b in neighbours], np.int64))
        # A space inside a piece, after other characters, would let pieces cross words.
        crossing = any(re.search(f"[^{_SPACE}]{_SPACE}", p) for p in names)
        lone = "".join(c for c in "\n\r\t" if not any(c in p for p in names if len(p) > 1))
        self.pattern = None if crossing else re.compile(f"{_SPACE}*[^{_SPACE}{lone}]+|{_SPACE}+" + (f"|[{lone}]" if lone else ""))
        self.remembered, self.known = remembered, {}

    def _rules(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of pairs of symbols."""
        key = left.astype(np.int64) * self.size + right
        key[(left < 0) | (right < 0)] = -1
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = self.keys[at] == key
        return np.where(found, self.ranks[at], _NONE), self.merged[at]

    def merge(self, symbols: np.ndarray, sequence: np.ndarray, single: bool = False) -> np.ndarray:
        """Survivors of each sequence. ``sequence`` rises from 0; ``single``: only the leftmost pair of a round is merged.

        Where a round merged several places of a sequence, and one of the new pairs ranks as low or lower, a strict
        one-by-one order might have taken that first: such sequences are merged again one by one.
        """
        total = int(sequence[-1]) + 1 if len(sequence) else 0
        left_over, again = np.zeros(total, np.int64), []
        given_symbols, given_sequence, home = symbols, sequence, np.arange(total)
        rank, into = self._pairs(symbols, sequence)
        while len(symbols):
            first = np.flatnonzero(np.diff(sequence, prepend=-1))
            lowest = np.minimum.reduceat(rank, first)
            sizes = np.diff(first, append=len(symbols))
            done = lowest == _NONE
            if done.any():
                left_over[sequence[first[done]]] = sizes[done]
                keep = np.repeat(~done, sizes)
                symbols, sequence, rank, into = symbols[keep], sequence[keep], rank[keep], into[keep]
                lowest, sizes = lowest[~done], sizes[~done]
                if not len(symbols):
                    break
            first = np.cumsum(sizes) - sizes
            take = np.flatnonzero(rank == np.repeat(lowest, sizes))
            owner = sequence[take]
            if single:
                take = take[np.diff(owner, prepend=-1) != 0]
            else:  # of overlapping places every second one goes, from the left
                fresh = np.diff(take, prepend=-2) != 1
                runs = np.maximum.accumulate(np.where(fresh, np.arange(len(take)), 0))
                take = take[(np.arange(len(take)) - runs) % 2 == 0]
            applied, owner = rank[take], sequence[take]
            symbols[take] = into[take]
            keep = np.ones(len(symbols), bool)
            keep[take + 1] = False
            place = np.cumsum(keep) - 1
            symbols, sequence, rank, into = symbols[keep], sequence[keep], rank[keep], into[keep]
            at = place[take]
            before = at - 1
            before = before[(before >= 0)]
            changed = np.unique(np.concatenate([at, before]))
            rank[changed], into[changed] = self._pairs_at(symbols, sequence, changed)
            if not single:
                doubtful = self._doubtful(rank, sequence, at, applied, owner)
                if len(doubtful):
                    again.append(doubtful)
                    keep = ~np.isin(sequence, doubtful)
                    symbols, sequence, rank, into = symbols[keep], sequence[keep], rank[keep], into[keep]
        if again:
            again = np.sort(np.concatenate(again))
            keep = np.isin(given_sequence, again)
            part = np.searchsorted(again, given_sequence[keep])
            left_over[again] = self.merge(given_symbols[keep], part, single=True)
        return left_over

    def _pairs(self, symbols, sequence):
        rank, into = np.full(len(symbols), _NONE, np.int32), np.zeros(len(symbols), np.int32)
        if len(symbols) > 1:
            rank[:-1], into[:-1] = self._rules(symbols[:-1], symbols[1:])
            rank[:-1][sequence[:-1] != sequence[1:]] = _NONE
        return rank, into

    def _pairs_at(self, symbols, sequence, at):
        right = np.minimum(at + 1, len(symbols) - 1)
        rank, into = self._rules(symbols[at], symbols[right])
        rank[(right == at) | (sequence[at] != sequence[right])] = _NONE
        return rank, into

    @staticmethod
    def _doubtful(rank, sequence, at, applied, owner):
        several = np.zeros(len(at), bool)
        same = owner[1:] == owner[:-1]
        several[1:] |= same
        several[:-1] |= same
        at, applied, owner = at[several], applied[several], owner[several]
        if not len(at):
            return at
        before = np.maximum(at - 1, 0)
        new = np.minimum(rank[at], np.where(sequence[before] == sequence[at], np.where(before < at, rank[before], _NONE), _NONE))
        return np.unique(owner[new <= applied])

    def sizes(self, tokens: list[str]) -> np.ndarray:
        """The number of pieces of each pre-token."""
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        code = np.frombuffer("".join(tokens).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        token = np.repeat(np.arange(len(tokens)), lengths)
        symbols = self.symbol[code]
        # No piece holds these two neighbours, so nothing merges across: sequences end here, too.
        pair = code[:-1] << 21 | code[1:]
        at = np.minimum(np.searchsorted(self.neighbours, pair), len(self.neighbours) - 1)
        split = np.ones(len(code), bool)
        split[1:] = (self.neighbours[at] != pair) | (token[1:] != token[:-1])
        sequence = np.cumsum(split) - 1
        cost = np.ones(len(code), np.int64)
        if self.bytes_as_pieces:  # a character without a piece is written as its bytes
            cost = np.where(symbols < 0, 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF), 1)
        survivors = self.merge(symbols.copy(), sequence)
        first = np.flatnonzero(split)
        lone_cost = np.where(np.diff(first, append=len(code)) == 1, cost[first], survivors)
        return np.bincount(token[first], weights=lone_cost, minlength=len(tokens)).astype(np.int64)

    def counts(self, texts: list[str]) -> list[int]:
        """The number of tokens of each text."""
        if len(self.known) > self.remembered:
            self.known = {}
        normal = [self.processor.normalize(t) if t else "" for t in texts]
        split = [self.pattern.findall(t) if self.pattern else [t] * bool(t) for t in normal]
        new = list(set().union(*split).difference(self.known))
        if new:
            self.known.update(zip(new, self.sizes(new).tolist()))
        size = self.known.__getitem__
        return [sum(map(size, s)) for s in split]


_MERGERS: dict[str, PieceMerger] = {}


def _count(batches, model):
    key = hashlib.sha256(model.value).hexdigest()
    if key not in _MERGERS:
        _MERGERS[key] = PieceMerger(model.value)
    for batch in batches:
        for part in slices(batch):
            sizes = pc.fill_null(pc.binary_length(part.column("text")), 0).cast(pa.int64())
            yield table(_COUNTS, part.column("doc_id"), sizes, _MERGERS[key].counts(texts(part)))


def count_tokens(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of each row's whole text by a sentencepiece BPE model, given as its bytes.

    No begin, end or added tokens; special strings inside a text are ordinary text, as the library has it. Null texts
    are empty and have 0 tokens; a null id stays null; repeated rows are counted each for itself; an empty table gives
    no rows; other columns are not read. Each row is counted where it lies: nothing is shuffled.
    """
    model = docs.sparkSession.sparkContext.broadcast(model)  # one model file, under a MB
    return run(id_and_text(docs, id_col, text_col), _count, "doc_id long, n_bytes long, n_tokens long", model)
