"""6. Language identification by prediction by partial matching.

Each language has a tree of byte contexts of up to ``ORDER`` bytes, with the escape probabilities of method C and
exclusion of what longer contexts have seen. The statistics are frozen after fitting, so the code length of a byte
depends on its context alone and is tabulated, in 1/1024 bit, for every context of the trees' union; a document's code
length under a language is an exact sum of integers over all its bytes. The language is the one with the shortest code
(the first by name among equals). A document is rejected if even that code is longer than ``REJECT_BITS`` a byte plus
``SLACK_BITS``, or if it has no text.

The trees are fitted on a bounded sample of labelled documents: of each language the ``SAMPLE_DOCS`` documents whose
ids hash lowest, whole, in that order, as far as they have room in ``SAMPLE_BYTES`` bytes; a text that has none is left
out of the sample and the next is taken, so no long text displaces the others and none is cut. Contexts that all
samples together have fewer than ``LEAST_COUNT`` times are left to their shorter ones. Scoring covers all documents and
whole texts, very long ones too.

Defined results: null, empty and blank text is rejected with language null and 0 bits; repeated rows give a row each;
without any labelled text everything is rejected; columns other than doc_id and text (lang when fitting) aren't looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import only, table
from .op10_bpe_codec import SLICE_BYTES, slices

ORDER, SAMPLE_DOCS, SAMPLE_BYTES, LEAST_COUNT = 3, 256, 400_000, 3
REJECT_BITS, SLACK_BITS, UNIT = 5.0, 64.0, 1024
PAD = 0xFF  # in no UTF-8 text


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    #: Byte -> symbol; the last symbol stands for all bytes that the sample lacks.
    symbol: np.ndarray
    #: The deepest context known for three preceding symbols, nearest first.
    context: np.ndarray
    #: Code length of each symbol in each context, by language.
    bits: np.ndarray

    def score(self, raws: list[bytes]) -> np.ndarray:
        """Code lengths of texts (rows) under languages (columns), in units of 1/UNIT bit."""
        pad = bytes([PAD]) * ORDER
        whole = self.symbol[np.frombuffer(pad + b"".join(x for r in raws for x in (r, pad)), np.uint8)]
        a, k = whole.astype(np.int32), int(self.symbol[PAD]) + 1
        node = self.context[(a[2:-1] * k + a[1:-2]) * k + a[:-3]]
        rows = self.bits[node * k + a[3:]]
        ends = np.cumsum([len(r) + ORDER for r in raws])
        starts = ends - [len(r) + ORDER for r in raws]
        bounds = np.column_stack([starts, ends - ORDER]).ravel()
        out = np.empty((len(raws), len(self.languages)), np.int64)
        for j in range(len(self.languages)):
            column = np.append(rows[:, j], 0).astype(np.int64)
            out[:, j] = np.add.reduceat(column, bounds)[::2]
        out[np.array([len(r) for r in raws]) == 0] = 0
        return out


def build(samples: dict[str, list[bytes]], least: int = LEAST_COUNT) -> Model | None:
    languages = tuple(sorted(samples))
    pad = bytes([PAD]) * ORDER
    raws = {x: np.frombuffer(pad + b"".join(r + pad for r in samples[x]), np.uint8) for x in languages}
    seen = np.unique(np.concatenate([[PAD], *raws.values()])).astype(np.int64)
    seen = seen[seen != PAD]
    if not len(languages) or not len(seen):
        return None
    k = len(seen) + 1
    symbol = np.full(256, k - 1, np.uint8)
    symbol[seen] = np.arange(k - 1, dtype=np.uint8)
    counts, keys = {}, {}
    for x in languages:
        a = symbol[raws[x]].astype(np.int64)
        real = raws[x][3:] != PAD
        now, back = a[3:][real], (a[2:-1][real], a[1:-2][real], a[:-3][real])
        for order in range(ORDER + 1):
            # A context with a padding symbol is no context.
            here = np.all([b != k - 1 for b in back[:order]], axis=0) if order else np.ones(len(now), bool)
            code = np.zeros(len(now), np.int64)
            for b in back[:order]:
                code = code * k + b
            keys[x, order], counts[x, order] = np.unique(code[here] * k + now[here], return_counts=True)
    # Contexts of each order that all languages together have seen often enough; node 0 is the empty context.
    nodes: list[np.ndarray] = [np.zeros(1, np.int64)]
    for order in range(1, ORDER + 1):
        both = np.concatenate([keys[x, order] // k for x in languages])
        n = np.concatenate([counts[x, order] for x in languages])
        context, at = np.unique(both, return_inverse=True)
        known = context[np.bincount(at, n) >= least]
        nodes.append(known[np.isin(known // k, nodes[-1])] if order > 1 else known)
    base = np.cumsum([0, *map(len, nodes)])
    total = int(base[-1])
    context = np.zeros(k**3, np.int32)
    for order in range(1, ORDER + 1):
        span = k ** (3 - order)
        for j, code in enumerate(nodes[order].tolist()):
            context[code * span : (code + 1) * span] = base[order] + j
    bits = np.empty((total * k, len(languages)), np.uint16)
    for j, x in enumerate(languages):
        c = []
        for order in range(ORDER + 1):
            rows = np.zeros((len(nodes[order]), k), np.float64)
            if len(nodes[order]) and len(keys[x, order]):
                of = np.searchsorted(nodes[order], keys[x, order] // k)
                of = np.minimum(of, len(nodes[order]) - 1)
                there = nodes[order][of] == keys[x, order] // k
                rows[of[there], keys[x, order][there] % k] = counts[x, order][there]
            c.append(rows)
        # Without the symbols that the next longer context has seen, as far down as no context at all.
        for order in range(ORDER + 1):
            if not len(nodes[order]):
                continue
            code = nodes[order]
            cost = np.zeros((len(code), k))
            open_ = np.ones((len(code), k), bool)
            for down in range(order, -1, -1):
                at = np.searchsorted(nodes[down], code // k ** (order - down))
                here = c[down][at] * open_
                d, n = (here > 0).sum(1, keepdims=True), here.sum(1, keepdims=True)
                with np.errstate(divide="ignore", invalid="ignore"):
                    cost += np.where(here > 0, np.log2((n + d) / here), 0)
                    cost += np.where(open_ & (here == 0) & (d > 0), np.log2((n + d) / d), 0)
                open_ &= here == 0
            left = 256 - (k - open_.sum(1, keepdims=True))
            cost += np.where(open_, np.log2(np.maximum(left, 1)), 0)
            bits[base[order] * k : base[order + 1] * k, j] = np.minimum(np.rint(cost * UNIT), 65535).astype(np.uint16).ravel()
    return Model(languages, symbol, context, bits)


def with_room(sizes: list[int], total: int) -> list[int]:
    """Which of the texts of these sizes are taken: each, in order, that fits into what is left of ``total``."""
    taken = []
    for i, size in enumerate(sizes):
        if size <= total:
            taken.append(i)
            total -= size
    return taken


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> Model | None:
    """The bounded sample is chosen from ids alone, then read: a document is never sorted or shuffled."""
    docs = only(docs, doc_id="bigint", text="string", lang="string")
    order = F.xxhash64("doc_id")
    chosen = (
        docs.where("lang is not null and doc_id is not null")
        .select("lang", "doc_id", order.alias("h"))
        .withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id")))
        .where(F.col("r") <= sample_docs)
        .select("doc_id")
    )
    ids = sorted({r.doc_id for r in chosen.toLocalIterator()})
    if not ids:
        return None
    texts: dict[str, list[bytes]] = {}
    rows = docs.where(F.col("doc_id").isin(ids) & F.col("lang").isNotNull() & (F.octet_length("text") <= sample_bytes)).select("lang", "text", order.alias("h"))
    for r in sorted(rows.toLocalIterator(), key=lambda r: (r.lang, r.h, r.text)):
        if r.text:
            texts.setdefault(r.lang, []).append(r.text.encode("utf-8", "surrogatepass"))
    samples = {}
    for lang, raws in texts.items():  # ids that repeat may bring more than so many documents
        samples[lang] = [raws[i] for i in with_room([len(r) for r in raws[:sample_docs]], sample_bytes)]
    return build(samples)


def _judged(model: Model | None, texts: list[str | None], reject_bits: float, slack_bits: float) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """Language, bits under it, bits more under the second, and whether it is accepted, of each text."""
    raws = [b"" if t is None or not t.strip() else t.encode("utf-8", "surrogatepass") for t in texts]
    n = np.array([len(r) for r in raws], np.int64)
    if model is None or not raws:
        return [None] * len(raws), np.zeros(len(raws)), np.zeros(len(raws)), np.zeros(len(raws), bool)
    scores = model.score(raws)
    ranked = np.sort(scores, 1)
    bits = ranked[:, 0] / UNIT
    best = [model.languages[i] if m else None for i, m in zip(scores.argmin(1).tolist(), n.tolist())]
    return best, bits, (ranked[:, min(1, ranked.shape[1] - 1)] - ranked[:, 0]) / UNIT, (n > 0) & (bits <= reject_bits * n + slack_bits)


def identify(docs: DataFrame, model: Model | None, reject_bits: float = REJECT_BITS, slack_bits: float = SLACK_BITS) -> DataFrame:
    """doc_id, language, bits (of the best language), margin (bits to the second) and accepted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SLICE_BYTES):
            best, bits, margin, accepted = _judged(shared.value, batch.column("text").to_pylist(), reject_bits, slack_bits)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(best, pa.string()), pa.array(bits), pa.array(margin), pa.array(accepted)], names=["doc_id", "language", "bits", "margin", "accepted"])

    return only(docs, doc_id="bigint", text="string").mapInArrow(run, "doc_id bigint, language string, bits double, margin double, accepted boolean")


def accepted_rows(docs: DataFrame, model: Model | None, reject_bits: float = REJECT_BITS, slack_bits: float = SLACK_BITS) -> DataFrame:
    """The rows, with all their columns, that aren't rejected; only their texts go to Python."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def accept(texts: pa.Array) -> pa.Array:
        parts = slices([pa.RecordBatch.from_arrays([texts], names=["text"])], SLICE_BYTES)
        return pa.array(np.concatenate([np.zeros(0, bool), *(_judged(shared.value, x.column("text").to_pylist(), reject_bits, slack_bits)[3] for x in parts)]))

    return docs.where(F.arrow_udf(accept, T.BooleanType())("text"))


def accepted_documents(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, language, bits and margin of the documents that aren't rejected."""
    return identify(docs, model).where("accepted").select("doc_id", "language", F.round("bits", 3).alias("bits"), F.round("margin", 3).alias("margin"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return accepted_documents(docs, fit(docs))
