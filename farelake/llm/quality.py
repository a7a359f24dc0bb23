"""Quality by ordinal regression: one weight for each hashed run of three bytes, and for words that repeat the one before
or the one before that, shared by all ordered thresholds.

The chance of a grade above k is logistic(score - threshold k). The thresholds rise, so one score gives the whole
distribution of grades: its expected value, and the tail at or above a grade, by which documents are selected.
"""

from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from farelake.llm.batches import id_and_text, run, slices, table, text_array
from farelake.session import materialise

BITS = 15  # of the hash
_SCALE = 100.0  # of the relative frequencies
_KINDS = 3  # of words: new, like the one before, like the one before that
_SIZE = (1 << BITS) + _KINDS
# Odd multipliers of the bytes of a word, by their place in it.
_PLACES = (np.arange(64, dtype=np.uint32) * np.uint32(0x85EBCA6B) ^ np.uint32(0xC2B2AE35)) | np.uint32(1)


def _buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bucket of every run of three bytes of the joined texts, and where those of each text begin and end."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].astype(np.uint32) if data else np.zeros(0, np.uint32)
    runs = raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16 if len(raw) > 2 else raw[:0]
    runs = runs * np.uint32(0x9E3779B1)
    start = np.minimum(offsets[:-1] - offsets[0], len(runs))
    return (runs >> np.uint32(32 - BITS)).astype(np.int32), start, np.maximum(start, offsets[1:] - offsets[0] - 2)


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The kind of every word of the joined texts, as a bucket, and where those of each text begin and end."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    letter = (raw != 32) & (raw != 10) & (raw != 9)
    begins = letter.copy()
    begins[1:] &= ~letter[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[first] = letter[first]
    at = np.flatnonzero(begins)
    kind = np.full(len(at), 1 << BITS, np.int32)
    if len(at):
        place = np.arange(at[0], len(raw), dtype=np.int32) - np.repeat(at, np.diff(at, append=len(raw))).astype(np.int32)
        value = (raw[at[0] :].astype(np.uint32) + np.uint32(1)) * _PLACES[place & 63] * letter[at[0] :]
        value = np.add.reduceat(value, at - at[0], dtype=np.uint32)
        text = np.searchsorted(offsets, at, side="right")
        for lag in (2, 1):
            same = (value[lag:] == value[:-lag]) & (text[lag:] == text[:-lag])
            kind[lag:][same] = (1 << BITS) + lag
    return kind, np.searchsorted(at, offsets[:-1]), np.searchsorted(at, offsets[1:])


def _mean(weights: np.ndarray, buckets: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0.0], np.cumsum(weights[buckets], dtype=np.float64)])
    return (sums[end] - sums[start]) / np.maximum(end - start, 1)


@dataclass
class QualityModel:
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, scores: np.ndarray) -> np.ndarray:
        """The chance of a grade above each of 0, 1, ... for each score."""
        return 1 / (1 + np.exp(-np.clip(scores[:, None] - self.thresholds, -30, 30)))

    def scores(self, texts: pa.Array) -> np.ndarray:
        return _SCALE * (_mean(self.weights, *_buckets(texts)) + _mean(self.weights, *_words(texts)))


def _sparse(batches):
    """Buckets and their shares, of each text; ``n`` are both together."""
    schema = pa.schema([("doc_id", pa.int64()), ("grade", pa.int64()), ("buckets", pa.binary()), ("shares", pa.binary()), ("n", pa.int64())])
    for batch in batches:
        for part in slices(batch):
            rows = []
            for parts in zip(*([b[x:y] for x, y in zip(start, end)] for b, start, end in (f(text_array(part)) for f in (_buckets, _words)))):
                found = [np.unique(p, return_counts=True) for p in parts]
                shares = [n * (_SCALE / max(n.sum(), 1)) for _, n in found]
                found = np.concatenate([b for b, _ in found]).astype("<i4")
                rows.append((found.tobytes(), np.concatenate(shares).astype("<f4").tobytes(), len(found)))
            yield table(schema, part.column("doc_id"), part.column("grade"), *zip(*rows))


def _arrays(rows) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Grades, and of all rows together the buckets, their shares and the row of each."""
    grades, sizes, buckets, shares = [], [], [], []
    for r in rows:
        grades.append(r["grade"])
        buckets.append(np.frombuffer(r["buckets"], "<i4"))
        shares.append(np.frombuffer(r["shares"], "<f4"))
        sizes.append(len(buckets[-1]))
    at = np.concatenate([*buckets, np.zeros(0, np.int32)])
    return np.array(grades), at, np.concatenate([*shares, np.zeros(0, "<f4")]), np.repeat(np.arange(len(grades), dtype=np.int32), sizes)


def _train(rows, levels: int, steps: int, rate: float, ridge: float) -> QualityModel:
    """Maximum likelihood by Adam over the whole sample; rising thresholds are sums of positive gaps."""
    grade, at, share, row = _arrays(rows)
    over = (grade[:, None] > np.arange(levels - 1)).mean(axis=0).clip(1e-3, 1 - 1e-3)
    thresholds = np.sort(-np.log(over / (1 - over)))
    parameters = np.concatenate([np.zeros(_SIZE), thresholds[:1], np.log(np.maximum(np.diff(thresholds), 1e-2))])
    first, second = np.zeros_like(parameters), np.zeros_like(parameters)
    n_weights = _SIZE
    logistic = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for step in range(1, steps + 1):
        weights, gaps = parameters[:n_weights], np.exp(parameters[n_weights + 1 :])
        thresholds = np.concatenate([parameters[n_weights : n_weights + 1], parameters[n_weights] + np.cumsum(gaps)])
        score = np.bincount(row, weights=share * weights[at], minlength=len(grade))
        # The chance of the observed grade is a difference of two logistic curves.
        upper = np.append(thresholds, np.inf)[grade]
        lower = np.append(-np.inf, thresholds)[grade]
        up, low = logistic(upper - score), logistic(lower - score)
        chance = np.maximum(up - low, 1e-9)
        d_up, d_low = up * (1 - up) / chance, low * (1 - low) / chance
        d_score = (d_up - d_low) / len(grade)  # of the negative log-likelihood
        d_threshold = np.zeros(levels - 1)
        below = grade < levels - 1
        np.add.at(d_threshold, grade[below], -d_up[below] / len(grade))
        np.add.at(d_threshold, grade[grade > 0] - 1, d_low[grade > 0] / len(grade))
        gradient = np.concatenate([
            np.bincount(at, weights=share * d_score[row], minlength=n_weights) + ridge * weights,
            [d_threshold.sum()], np.cumsum(d_threshold[::-1])[::-1][1:] * gaps,
        ])
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        parameters -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
    gaps = np.exp(parameters[n_weights + 1 :])
    thresholds = np.concatenate([parameters[n_weights : n_weights + 1], parameters[n_weights] + np.cumsum(gaps)])
    return QualityModel(parameters[:n_weights].astype(np.float32), thresholds)


def fit(
    docs: DataFrame, ratings: DataFrame, levels: int, sample: int = 4000, steps: int = 150, rate: float = 0.05,
    ridge: float = 1e-4, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade", features: int = 16_000_000,
) -> QualityModel:
    """Learn from at most ``sample`` rated documents, chosen by hash of their id; grades are 0 to ``levels`` - 1.

    The sample ends where its documents have more than ``features`` buckets together, so that the driver holds some thirty
    bytes for each of these at most, however long the texts are.

    Ratings without a document, null ratings and null ids are left out; of several ratings of an id the lowest counts,
    of several texts that with the smallest hash.
    Without any rating, all documents get the same score and thresholds that keep them.
    """
    spark = docs.sparkSession
    rated = ratings.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{grade_col}`").cast("long").alias("grade"))
    rated = rated.filter(f"doc_id is not null and grade between 0 and {levels - 1}").groupBy("doc_id").agg(F.min("grade").alias("grade"))
    chosen = [(r["doc_id"], r["grade"]) for r in rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()]
    # At most ``sample`` pairs of numbers, so a broadcast.
    rows = id_and_text(docs, id_col, text_col).join(F.broadcast(spark.createDataFrame(chosen, "doc_id long, grade long")), "doc_id")
    rows = rows.groupBy("doc_id", "grade").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("row")).select("doc_id", "grade", "row.text")
    sparse = materialise(run(rows, _sparse, "doc_id long, grade long, buckets binary, shares binary, n long"))
    order = F.xxhash64("doc_id")
    # A pair of numbers for each row of the sample.
    sizes = sorted((r["place"], r["n"]) for r in sparse.select(order.alias("place"), "n").collect())
    within = [place for (place, _), total in zip(sizes, accumulate(n for _, n in sizes)) if total <= features] or [p for p, _ in sizes[:1]]
    collected = sparse.filter(order <= within[-1]).sort(order).collect() if within else []
    if not collected:
        return QualityModel(np.zeros(_SIZE, np.float32), np.linspace(-2, -1, levels - 1))
    return _train(collected, levels, steps, rate, ridge)


def _score(batches, model, least):
    schema = pa.schema([("doc_id", pa.int64()), ("expected_grade", pa.float64()), ("tail_probability", pa.float64())])
    for batch in batches:
        for part in slices(batch):
            above = model.value.above(model.value.scores(text_array(part)))
            yield table(schema, part.column("doc_id"), above.sum(axis=1), above[:, least - 1])


def score(model: QualityModel, docs: DataFrame, least: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, expected_grade, tail_probability) for each row; the tail is the chance of grade ``least`` or better.

    Null, empty and shorter texts than three bytes have no evidence: their grade follows from the thresholds alone. A
    null id stays null; repeated rows are scored each for itself; an empty table gives no rows; other columns are not
    read. Nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** BITS weights
    ddl = "doc_id long, expected_grade double, tail_probability double"
    return run(id_and_text(docs, id_col, text_col), _score, ddl, shared, least)
