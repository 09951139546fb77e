"""8. Quality classifier: ordinal cumulative-link regression on graded ratings.

The grade of a labelled document is 0 if it is toxic, else 1 if its quality is 0, else 2. A document's features are
present or not: its words and their beginnings, its runs of symbols, and how much it repeats itself, shouts or consists of
symbols, hashed to
``2 ** HASH_BITS``. One weight vector is shared by all grades: P(grade >= j) = sigmoid(score - threshold_j) with ordered
thresholds, which gives the expected grade and both tail probabilities. Weights are fitted by proximal AdaGrad with an
L1 penalty, so words too rare to tell anything weigh nothing however long the document.

Fitted on at most ``FIT_ROWS`` labelled documents, those whose ids hash lowest; every document is scored on its whole
text. A document is kept if P(grade >= 2) is at least ``KEEP``.

Defined results: null or blank text is never kept; label rows without quality or toxic, or without a document, are left
out; several labels or rows for a document count each; documents of equal scores are kept or not alike, a tail of exactly
``KEEP`` is; without labels every document with text is kept with null scores; a very long text is scored whole; an empty
table gives no row; columns other than doc_id and text aren't looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, words
from .common import only, stored, table
from .op10_bpe_codec import slices

HASH_BITS, FIT_ROWS, KEEP = 18, 20_000, 0.5
#: Beginnings of words that are features as well: stems.
PREFIXES = (4, 5)
PENALTY, RATE, EPOCHS, BATCH, LEAST_DOCS = 2e-4, 0.3, 40, 1024, 4


def span_of(h: np.ndarray, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Words longer than ``length``, and hashes of their first so many characters."""
    which = np.flatnonzero(ends - starts > length)
    return which, words.span_hashes(codes, starts[which], starts[which] + length) ^ words.mixed(np.full(1, length, np.uint64))


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Text number and feature of each feature present, in order."""
    codes, bounds = words.codes_of(texts)
    kind = bpe.classes()[codes]
    lower = codes
    upper = np.zeros(len(codes), bool)
    if len(codes):
        folded, same = words.codes_of([t.lower() for t in texts])
        upper = (codes >= 65) & (codes <= 90)
        if len(folded) == len(codes):
            upper = folded != codes
        lower, lower_bounds = folded, same
    starts, ends = words.word_spans(lower)
    h = words.span_hashes(lower, starts, ends)
    of = np.searchsorted(lower_bounds, starts, "right") - 1 if len(codes) else starts
    inside = np.zeros(len(codes) + 2, np.int8)
    inside[1:-1] = kind == bpe.OTHER
    edge = np.diff(inside)
    s0, s1 = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    symbols = words.span_hashes(codes, s0, s1) ^ np.uint64(0x5555555555555555)
    symbols_of = np.searchsorted(bounds, s0, "right") - 1
    n = len(texts)
    count = np.bincount(of, minlength=n)
    distinct = np.unique(h ^ words.mixed(of.astype(np.uint64) + np.uint64(7)), return_index=True)[1]
    different = np.bincount(of[distinct], minlength=n)
    letters = np.add.reduceat(np.append((kind == bpe.LETTER).astype(np.int64), 0), bounds[:-1]) if n else np.zeros(0)
    caps = np.add.reduceat(np.append(upper.astype(np.int64), 0), bounds[:-1]) if n else np.zeros(0)
    marks = np.bincount(symbols_of, minlength=n)
    runs = np.bincount(symbols_of[s1 - s0 > 1], minlength=n)
    twice = np.bincount(of[1:][(h[1:] == h[:-1]) & (of[1:] == of[:-1])], minlength=n)
    begins = [span_of(h, codes=lower, starts=starts, ends=ends, length=k) for k in PREFIXES]
    share = lambda a, b: np.minimum(9, (10 * a / np.maximum(b, 1)).astype(np.int64))
    # The share of different words falls with length by itself, so it is taken together with length.
    size = np.minimum(12, np.log2(np.maximum(count, 1)).astype(np.int64))
    shape = [share(different, count) + 16 * size + 1000, share(caps, letters) + 2000, share(marks, count) + 3000, size + 4000, share(runs, count) + 5000, share(twice, count) + 6000]
    shape = np.concatenate([words.mixed(x.astype(np.uint64) + np.uint64(1 << 40)) for x in shape])
    every = np.concatenate([of, *[of[x] for x, _ in begins], symbols_of, np.tile(np.arange(n), len(shape) // max(n, 1))])
    feature = (np.concatenate([h, *[x for _, x in begins], symbols, shape]) >> np.uint64(64 - HASH_BITS)).astype(np.int64)
    pairs = np.unique((every << HASH_BITS) | feature)
    return pairs >> HASH_BITS, pairs & (1 << HASH_BITS) - 1


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    thresholds: tuple[float, float]

    def tails(self, texts: list[str]) -> np.ndarray:
        """P(grade >= 1) and P(grade >= 2) of each text."""
        of, feature = features(texts)
        score = np.bincount(of, self.weights[feature], minlength=len(texts))
        return sigmoid(score[:, None] - np.array(self.thresholds))


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def slopes(score: np.ndarray, low: float, high: float, grade: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Derivatives of -log P(grade) by the score through either threshold; their sum is that by the score itself."""
    one, two = sigmoid(score - low), sigmoid(score - high)
    p = np.maximum(np.choose(grade, [1 - one, one - two, two]), 1e-9)
    d1, d2 = one * (1 - one), two * (1 - two)
    return np.choose(grade, [d1, -d1, np.zeros_like(d1)]) / p, np.choose(grade, [np.zeros_like(d2), d2, -d2]) / p


def learn(of: np.ndarray, feature: np.ndarray, grade: np.ndarray, penalty: float = PENALTY, rate: float = RATE, epochs: int = EPOCHS, seed: int = 7) -> Model:
    """``of``: the row of each feature, in order; ``grade``: that of each row."""
    n = len(grade)
    common = np.bincount(feature, minlength=1 << HASH_BITS)
    ids = np.flatnonzero(common >= LEAST_DOCS)
    number = np.full(1 << HASH_BITS, -1, np.int32)
    number[ids] = np.arange(len(ids))
    feature = number[feature]
    of, feature = of[feature >= 0], feature[feature >= 0]
    at = np.searchsorted(of, np.arange(n + 1))
    w, squares = np.zeros(len(ids)), np.full(len(ids), 1e-2)
    # thresholds a and a + exp(b), from the grades' shares
    odds = lambda p: float(np.log(max(p, 1e-3) / max(1 - p, 1e-3)))
    low, high = -odds((grade >= 1).mean()), -odds((grade >= 2).mean())
    t = np.array([low, np.log(max(high - low, 0.1))])
    t_squares = np.full(2, 1e-2)
    random = np.random.default_rng(seed)
    for _ in range(epochs):
        order = random.permutation(n)
        for b in range(0, n, BATCH):
            rows = order[b : b + BATCH]
            size = at[rows + 1] - at[rows]
            own = feature[bpe.ragged(at, rows)]
            row = np.repeat(np.arange(len(rows)), size)
            s = np.bincount(row, w[own], minlength=len(rows))
            by_one, by_two = slopes(s, t[0], t[0] + np.exp(t[1]), grade[rows])
            g = np.bincount(own, np.repeat(by_one + by_two, size), minlength=len(ids)) / len(rows)
            squares += g * g
            step = rate / np.sqrt(squares)
            w -= step * g
            w = np.sign(w) * np.maximum(np.abs(w) - step * penalty, 0)
            gt = np.array([-(by_one + by_two).mean(), -(by_two * np.exp(t[1])).mean()])
            t_squares += gt * gt
            t -= rate / np.sqrt(t_squares) * gt
    weights = np.zeros(1 << HASH_BITS)
    weights[ids] = w
    return Model(weights, (float(t[0]), float(t[0] + np.exp(t[1]))))


def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 2_000_000):
        of, feature = features(batch.column("text").to_pylist())
        bounds = np.searchsorted(of, np.arange(batch.num_rows + 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column("grade"), batch.column("h"), pa.ListArray.from_arrays(pa.array(bounds), pa.array(feature.astype(np.int32)))], names=["grade", "h", "features"])


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model | None:
    labels = only(labels, doc_id="bigint", quality="int", toxic="int").where("doc_id is not null and quality is not null and toxic is not null")
    grade = F.when(F.col("toxic") != 0, 0).when(F.col("quality") == 0, 1).otherwise(2).cast("int")
    chosen = stored(labels.select("doc_id", grade.alias("grade"), F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id", "grade").limit(fit_rows), "labelled")
    docs = only(docs, doc_id="bigint", text="string").where("text is not null")
    # At most fit_rows rows are broadcast, and as many come back.
    rows = docs.join(F.broadcast(chosen), "doc_id").select("text", "grade", "h").mapInArrow(featured, "grade int, h bigint, features array<int>")
    found = rows.withColumn("tie", F.xxhash64("features")).toArrow()
    if not found.num_rows:
        return None
    lists = found["features"].combine_chunks()
    h, y, tie = (found[c].to_numpy() for c in ("h", "grade", "tie"))
    offsets, flat = np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))), lists.flatten().to_numpy()
    order = np.lexsort((tie, y, h))
    of = np.repeat(np.arange(len(order), dtype=np.int32), np.diff(offsets)[order])
    return learn(of, flat[bpe.ragged(offsets, order)], y[order].astype(np.int64))


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, expected_grade, p_ge_1, p_ge_2 and has_text of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches, 2_000_000):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            some = np.array([bool(t.strip()) for t in texts], bool)
            tails = np.zeros((len(texts), 2)) if model is None else model.tails(texts)
            blank = ~some | (model is None)
            columns = [pa.array(x, mask=blank) for x in (tails.sum(1), tails[:, 0], tails[:, 1])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns, pa.array(some)], names=["doc_id", "expected_grade", "p_ge_1", "p_ge_2", "has_text"])

    return only(docs, doc_id="bigint", text="string").mapInArrow(run, "doc_id bigint, expected_grade double, p_ge_1 double, p_ge_2 double, has_text boolean")


def selected(docs: DataFrame, model: Model | None, keep: float = KEEP) -> DataFrame:
    """The kept documents' ids and scores."""
    rows = scored(docs, model).where("has_text")
    if model is not None:
        rows = rows.where(F.col("p_ge_2") >= keep)
    return rows.select("doc_id", *[F.round(c, 6).alias(c) for c in ("expected_grade", "p_ge_1", "p_ge_2")])


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return selected(docs, fit(docs, table(spark, sf_dir, "labels")))
