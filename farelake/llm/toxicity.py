"""Toxicity by a weighted lexicon, matched by an Aho-Corasick automaton in folded texts.

Folding lower-cases, turns look-alike letters and digits that stand for letters into plain ones, and everything else into
spaces. A term is a word or the beginning of words; a word counts with its heaviest term, unless an exception phrase
covers it. The weights of a text, normalised by its length, give a probability.
"""

import math
import unicodedata
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from farelake.llm.batches import id_and_text, run, slices, table, texts
from farelake.session import shared_folder

# Letters that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "һ": "h",
    "ӏ": "l", "в": "b", "к": "k", "м": "m", "н": "h", "т": "t", "г": "r", "п": "n", "з": "e",
    "α": "a", "ε": "e", "ο": "o", "ρ": "p", "υ": "u", "ν": "v", "ι": "i", "κ": "k", "τ": "t", "β": "b", "γ": "y", "ω": "w",
    "ɡ": "g", "ı": "i", "ł": "l", "ß": "s", "ø": "o", "đ": "d",
}
# Digits and signs that stand for letters. I, l and 1 are one letter after folding.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "l": "i"}
# Characters without a width.
INVISIBLE = "­​‌‍⁠﻿"

_SHORTEST, _LONGEST = 4, 8  # letters of a term that begins words


class _Folding(dict):
    """Translation of one lower-case character, worked out when it is first met."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        if c in INVISIBLE:
            out = ""
        else:
            base = unicodedata.normalize("NFKD", c)[:1].lower()
            base = HOMOGLYPHS.get(c, HOMOGLYPHS.get(base, base))
            base = DIGITS.get(base, base)
            # Letters stay; marks above letters vanish; all else parts words.
            out = base if base.isalpha() else "" if unicodedata.category(c) == "Mn" else " "
        self[code] = out
        return out


_FOLDING = _Folding()


def fold(text: str) -> str:
    """The folded text, with a space before, between and after words."""
    return f" {text.lower().translate(_FOLDING)} "


@dataclass
class ToxicityModel:
    """Terms and exception phrases are folded: a term is `` word `` or `` begin``, a phrase `` two words ``."""

    terms: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    coefficients: tuple[float, ...] = (-4.0, 1.0, 0.0, 0.0)

    def automaton(self):
        import ahocorasick

        out = ahocorasick.Automaton()
        for term, weight in self.terms.items():
            out.add_word(term, (len(term), weight))
        for phrase in self.exceptions:
            out.add_word(phrase, (len(phrase), None))
        if len(out):
            out.make_automaton()
        return out


def matches(automaton, folded: str) -> dict[int, float]:
    """The heaviest weight by the place where a matched word begins, exceptions taken out."""
    found, excused = {}, []
    if not len(automaton):
        return found
    for end, (length, weight) in automaton.iter(folded):
        start = end - length + 1
        if weight is None:
            excused.append((start, end))
        elif weight > found.get(start, 0.0):
            found[start] = weight
    for start, end in excused:
        for at in [at for at in found if start <= at < end]:
            del found[at]
    return found


def features(automaton, text: str) -> tuple[float, float, float, int]:
    """Heaviest weight, sum over the square root of the length, density, and the number of matches."""
    folded = fold(text)
    found = matches(automaton, folded)
    if not found:
        return 0.0, 0.0, 0.0, 0
    words, total = len(folded.split()), sum(found.values())
    return max(found.values()), total / math.sqrt(words + 10), 10 * total / (words + 10), len(found)


_SCORE = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("n_matches", pa.int64())])


def _score(batches, model):
    automaton, weights = model.value.automaton(), np.array(model.value.coefficients)
    for batch in batches:
        for part in slices(batch):
            rows = np.array([features(automaton, t) for t in texts(part)]).reshape(-1, 4)
            z = weights[0] + rows[:, :3] @ weights[1:]
            yield table(_SCORE, part.column("doc_id"), 1 / (1 + np.exp(-np.clip(z, -30, 30))), rows[:, 3].astype(np.int64))


def score(model: ToxicityModel, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, n_matches) for each row: the probability of being toxic, and the matched words.

    Null and empty texts, and texts without a match, get the score of no match. A null id stays null; repeated rows are
    scored each for itself; an empty table gives no rows; other columns are not read. Nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the lexicon's size
    return run(id_and_text(docs, id_col, text_col), _score, "doc_id long, score double, n_matches long", shared)


def _candidates(text: str) -> set[str]:
    """All terms that a text would match."""
    out = set()
    for word in set(fold(text).split()):
        out.add(f" {word} ")
        out.update(f" {word[:n]}" for n in range(_SHORTEST, min(_LONGEST, len(word)) + 1))
    return out


def _phrases(automaton, text: str) -> set[str]:
    """The matched words of a text with the word before or after."""
    folded, out = fold(text), set()
    words = folded.split()
    line, at, place = f" {' '.join(words)} ", 0, {}
    for i, word in enumerate(words):
        place[at] = i
        at += len(word) + 1
    for start in matches(automaton, line):
        i = place.get(start)
        if i:
            out.add(f" {words[i - 1]} {words[i]} ")
        if i is not None and i + 1 < len(words):
            out.add(f" {words[i]} {words[i + 1]} ")
    return out


def _occurrences(batches, of, allowed):
    """(term, rows) of a batch: how many of its texts have the term."""
    schema = pa.schema([("term", pa.string()), ("n", pa.int64())])
    automaton = of and of.value.automaton()
    collect = _candidates if of is None else lambda text: _phrases(automaton, text)
    only = None if allowed is None else allowed.value
    for batch in batches:
        counts = {}
        for part in slices(batch):
            for text in texts(part):
                terms = collect(text)
                for term in terms if only is None else terms & only:
                    counts[term] = counts.get(term, 0) + 1
        yield table(schema, list(counts), list(counts.values()))


def _document_counts(rows: DataFrame, of=None, allowed=None) -> DataFrame:
    return run(rows, _occurrences, "term string, n long", of, allowed).groupBy("term").agg(F.sum("n").alias("n"))


def _features(batches, model):
    schema = pa.schema([("toxic", pa.int64()), ("x", pa.list_(pa.float64()))])
    automaton = model.value.automaton()
    for batch in batches:
        for part in slices(batch):
            yield table(schema, part.column("toxic"), [list(features(automaton, t)[:3]) for t in texts(part)])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01) -> tuple[float, ...]:
    """Weights of a logistic regression (constant first), by Newton's method; the ridge leaves the constant out."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(w)


def fit(
    docs: DataFrame, labels: DataFrame, sample: int = 8000,
    evidence: float = 16.0, least_weight: float = 2.0, least_clean: int = 3,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
) -> ToxicityModel:
    """Learn terms, weights, exceptions and the score from at most ``sample`` labelled rows, chosen by hash of their id.

    Copies count once. Three quarters of the sample make the lexicon, the rest the score. Terms are words and beginnings of words that
    toxic texts have more often: log-likelihood ratio at least ``evidence``, weight (logarithm of the ratio of document
    rates) at least ``least_weight``. Exceptions are pairs of words around a match that ``least_clean`` clean texts have and
    no toxic one. Terms and exceptions are as many as the sample gives.

    Labels without a document, and null labels or ids, are left out. Without both kinds of labels the model has no term.
    """
    spark = docs.sparkSession
    known = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("long").alias("toxic"))
    known = known.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id")
    chosen = [(r["doc_id"], r["toxic"]) for r in known.orderBy(order, "doc_id").limit(sample).collect()]
    # At most ``sample`` pairs of numbers, so a broadcast.
    part = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(4)).alias("part")
    rows = id_and_text(docs, id_col, text_col).join(
        F.broadcast(spark.createDataFrame(chosen, "doc_id long, toxic long")), "doc_id"
    ).groupBy("text").agg(F.max("toxic").alias("toxic"), F.min("doc_id").alias("doc_id")).select("toxic", "text", part)
    folder = shared_folder(spark)
    rows.write.parquet(f"{folder}/sample")
    rows = spark.read.schema("toxic long, text string, part long").parquet(f"{folder}/sample")
    learn, rest = rows.filter("part < 3"), rows.filter("part = 3")
    n = {r["toxic"]: r["n"] for r in learn.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = n.get(1, 0), n.get(0, 0)
    model = ToxicityModel({})
    if not n_toxic or not n_clean:
        return model
    toxic, clean = learn.filter("toxic = 1"), learn.filter("toxic = 0")
    # A term that toxic texts alone have gives 2 n log(all / toxic): rarer ones cannot reach the evidence.
    rarest = max(3, math.ceil(evidence / (2 * math.log((n_toxic + n_clean) / n_toxic)) - 1e-9))
    common = _document_counts(toxic).filter(F.col("n") >= rarest)
    in_toxic = {r["term"]: r["n"] for r in common.collect()}
    allowed = spark.sparkContext.broadcast(set(in_toxic))
    in_clean = {r["term"]: r["n"] for r in _document_counts(clean, allowed=allowed).collect()}
    terms = {}
    for term, a in in_toxic.items():
        b = in_clean.get(term, 0)
        weight = math.log((a + 0.5) / (n_toxic + 1)) - math.log((b + 0.5) / (n_clean + 1))
        expected = n_toxic * (a + b) / (n_toxic + n_clean)
        ratio = 2 * (a * math.log(a / expected) + (b * math.log(b / (a + b - expected)) if b else 0))
        if weight >= least_weight and ratio >= evidence:
            terms[term] = (weight, ratio)
    # Of a beginning and a longer term that nearly all its texts have, the longer one is the clearer; else a longer one
    # adds nothing where a shorter one is about as heavy.
    longest = {}
    for term in terms:
        for stem in (term[:n] for n in range(_SHORTEST + 1, len(term))):
            longest[stem] = max(longest.get(stem, 0), in_toxic[term])
    kept = {}
    for term in sorted((t for t in terms if longest.get(t, 0) < 0.95 * in_toxic[t]), key=len):
        stems = (term[:n] for n in range(_SHORTEST + 1, len(term)))
        if not any(s in kept and kept[s][0] >= terms[term][0] - 0.7 for s in stems):
            kept[term] = terms[term]
    model.terms = {t: kept[t][0] for t in sorted(kept, key=lambda t: (-kept[t][1], t))}
    shared = spark.sparkContext.broadcast(model)
    spared = _document_counts(clean, of=shared).filter(F.col("n") >= least_clean)
    spared = {r["term"] for r in spared.collect()}
    if spared:
        used = {r["term"] for r in _document_counts(toxic, of=shared, allowed=spark.sparkContext.broadcast(spared)).collect()}
        model = ToxicityModel(model.terms, sorted(spared - used))
        shared = spark.sparkContext.broadcast(model)
    fitted = run(rest, _features, "toxic long, x array<double>", shared).collect()  # four numbers for each row of the sample
    y = np.array([r["toxic"] for r in fitted], float)
    if 0 < y.sum() < len(y):
        model.coefficients = _logistic(np.array([r["x"] for r in fitted]), y)
    return model
