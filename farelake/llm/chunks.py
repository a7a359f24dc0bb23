"""Token ids of whole texts by a public tokenizer, with each distinct chunk of a slice encoded once.

A text is cut only where its tokenizer always starts anew, so encoding the chunks one by one gives the ids of the whole
text. Chunks are cut and made distinct in Arrow; the distinct ones are joined, with a separator, and encoded in one call.
Texts or chunks with rare characters, whose rules differ between libraries, are encoded by the tokenizer file's own library.
"""

import hashlib
import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# The byte-level alphabet (printable bytes stand for themselves, others are shifted past 255).
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_OF = {chr(b): b for b in _PRINTABLE} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*_PRINTABLE}))}
# Patterns of the two pre-tokenizers, here with the separators used below.
_LEVEL = r"\x00|'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}\x00]+|\s+(?![^\s\x00])|\s+"
_WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# White space other than space and line end.
_SPACES = r"\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

# Text that is encoded at once: the more, the fewer distinct chunks in proportion.
SLICE = 12 << 20

_END = b"\x00"  # ends a word in the ranks of a vocabulary with word ends


def ragged(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The stretches of ``values`` one after another."""
    ends = np.cumsum(lengths)
    at = np.repeat((starts - (ends - lengths)).astype(np.int32), lengths)
    at += np.arange(len(at), dtype=np.int32)
    return values[at]


class _Chunks:
    """The chunks of a slice of texts: distinct ones with their ids, and where each occurs."""

    def __init__(self, ids, lengths, places, counts):
        self.ids, self.lengths, self.places, self.counts = ids, lengths, places, counts
        self.starts = np.cumsum(lengths) - lengths


class _Encoder:
    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        model = json.loads(definition)["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.ranks = {}
        special = {t["content"] for t in json.loads(definition)["added_tokens"]}
        for token, i in model["vocab"].items():
            if token not in special:
                word = token.removesuffix(self.suffix) if self.suffix else token
                self.ranks[bytes(map(_BYTE_OF.__getitem__, word)) + (_END if word != token else b"")] = i

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lists = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        lengths = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter((i for x in lists for i in x), np.uint32, int(lengths.sum())), lengths

    def _between(self, ids: np.ndarray, separator: int) -> tuple[np.ndarray, np.ndarray]:
        ends = np.flatnonzero(ids == separator)
        return ids[ids != separator], np.diff(ends, prepend=-1) - 1

    def _mixed(self, n: int, odd: np.ndarray, quick, library) -> tuple[np.ndarray, np.ndarray]:
        """Ids and lengths of n distinct chunks, of which ``odd`` went to the library and the rest another way."""
        if not odd.any():
            return quick
        ids = np.concatenate([quick[0], library[0]])
        lengths = np.empty(n, np.int64)
        lengths[~odd], lengths[odd] = quick[1], library[1]
        starts = np.empty(n, np.int64)
        starts[~odd] = np.cumsum(quick[1]) - quick[1]
        starts[odd] = len(quick[0]) + np.cumsum(library[1]) - library[1]
        return ragged(ids, starts, lengths), lengths

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, ``end`` after each text, and how many each text has."""
        chunks = self.chunks(texts)
        lengths = chunks.lengths[chunks.places]
        ids = ragged(chunks.ids, chunks.starts[chunks.places], lengths)
        totals = np.concatenate([[0], np.cumsum(lengths)])
        bounds = np.concatenate([[0], np.cumsum(chunks.counts)])
        sizes = totals[bounds[1:]] - totals[bounds[:-1]]
        where = np.cumsum(sizes + 1) - 1
        out = np.empty(len(ids) + len(sizes), np.uint32)
        text = np.ones(len(out), bool)
        text[where] = False
        out[where], out[text] = end, ids
        return out, sizes + 1


def _distinct(parts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    coded = parts.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)


class SpacedEncoder(_Encoder):
    """For byte-level vocabularies whose pieces may begin with a space.

    A chunk begins at a space or line end. That is exact but for runs of three or more of them, two at a text's end, other
    white space, and special strings: such texts go to the library as a whole.
    """

    def __init__(self, definition: str):
        import tiktoken

        super().__init__(definition)
        self.quick = tiktoken.Encoding("spaced", pat_str=_LEVEL, mergeable_ranks=self.ranks, special_tokens={})
        self.separator = self.ranks[b"\x00"]

    def chunks(self, texts: pa.Array) -> _Chunks:
        odd = pc.match_substring_regex(texts, rf"[ \n]{{3}}|[ \n]{{2}}\z|[{_SPACES}]|\x00|<\|").to_numpy(zero_copy_only=False)
        marked = pc.replace_substring(texts.filter(pa.array(~odd)), "\n", " \n")
        # All but the first part of a text stand after a space; those that begin with a line end do without it.
        lists = pc.split_pattern(marked, " ")
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        distinct, places = _distinct(lists.flatten())
        first = np.zeros(len(places), bool)
        first[np.cumsum(sizes) - sizes] = True
        line = pc.starts_with(distinct, "\n").to_numpy(zero_copy_only=False) if len(distinct) else np.zeros(0, bool)
        # The same part with and without a space are two chunks: 2k without, 2k + 1 with.
        places = 2 * places.astype(np.int64) + ~(first | line[places])
        seen = np.zeros(2 * len(distinct), bool)
        seen[places] = True
        used = np.flatnonzero(seen)
        bare = distinct.take(pa.array(used // 2)).cast(pa.string())
        whole = pc.if_else(pa.array(used % 2 == 1), pc.binary_join_element_wise("", bare, " "), bare) if len(used) else bare
        quick = self.quick.encode_to_numpy("".join(f"{c}\0" for c in whole.to_pylist()), disallowed_special=())
        ids, lengths = self._between(quick.astype(np.uint32), self.separator)
        places = (np.cumsum(seen) - 1)[places]
        counts = np.ones(len(texts), np.int64)
        counts[~odd] = sizes
        if odd.any():
            more, own = self._library(texts.filter(pa.array(odd)).to_pylist())
            every = np.empty(int(counts.sum()), np.int64)
            place_odd = np.repeat(odd, counts)
            every[~place_odd], every[place_odd] = places, len(lengths) + np.arange(len(own))
            places, ids, lengths = every, np.concatenate([ids, more]), np.concatenate([lengths, own])
        return _Chunks(ids, lengths, places, counts)


class WordEncoder(_Encoder):
    """For vocabularies with word ends, that lower-case texts and drop white space: chunks are what stands between spaces.

    Chunks with special strings, or other characters than ASCII and Latin letters, go to the library.
    """

    def __init__(self, definition: str):
        import regex
        import tiktoken

        super().__init__(definition)
        self.quick = tiktoken.Encoding("words", pat_str=r"[^ \x00]+\x00| ", mergeable_ranks=self.ranks, special_tokens={})
        self.separator = self.ranks[b" "]
        self.words = regex.compile(_WORD)

    def chunks(self, texts: pa.Array) -> _Chunks:
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        distinct, places = _distinct(lists.flatten())
        odd = pc.match_substring_regex(distinct, r"[^!-~\x{a1}-\x{24f}]|\x{130}|<\|").to_numpy(zero_copy_only=False) if len(distinct) else np.zeros(0, bool)
        plain = " ".join([*distinct.filter(pa.array(~odd)).to_pylist(), ""]).lower()
        quick = self.quick.encode_to_numpy(self.words.sub("\\g<0>\0", plain), disallowed_special=())
        quick = self._between(quick.astype(np.uint32), self.separator)
        library = self._library(distinct.filter(pa.array(odd)).to_pylist()) if odd.any() else None
        return _Chunks(*self._mixed(len(distinct), odd, quick, library), places.astype(np.int64), counts)


_ENCODERS: dict[str, _Encoder] = {}


def encoder(definition: str, kind: type[_Encoder]) -> _Encoder:
    """The worker's encoder for this file, kept from task to task."""
    key = hashlib.sha256(definition.encode()).hexdigest() + kind.__name__
    if key not in _ENCODERS:
        _ENCODERS[key] = kind(definition)
    return _ENCODERS[key]
