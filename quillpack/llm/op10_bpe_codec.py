"""10. Byte-level BPE encoding and decoding by overlapping chunks.

Texts beyond ``chunk_chars`` are cut into chunks that overlap. All chunks are pre-tokenised in parallel; a chunk's
boundaries are wrong only near its cut ends. Pre-tokenisation from a true boundary depends on the text to its right
alone, so from the first boundary that a chunk and its successor share, the successor's are true: there the two are
stitched. Then the pieces between stitches are encoded, again in parallel, and the ids put together. Where an overlap
has no shared boundary (a run of one kind of characters longer than the overlap) the text is encoded whole instead.
Shorter texts are a single chunk and never leave their scan task.

Defined results: null text gives null ids and counts; empty text gives an empty list; repeated rows give one result row
each; columns other than ``doc_id`` and ``text`` aren't looked at; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe
from .common import only, parts, table

CHUNK_CHARS, OVERLAP_CHARS = 32_768, 512
#: Boundaries this near to a chunk's cut end may change with the text after it.
UNSETTLED = 4
#: Text that a worker of the pipeline's stages works on at once, in bytes; a longer text is a slice of its own.
SLICE_BYTES = 1_000_000
SCHEMA = "doc_id bigint, token_ids array<int>, n_tokens int, n_bytes bigint, round_trip boolean"
_ARROW = pa.schema([("doc_id", pa.int64()), ("token_ids", pa.list_(pa.int32())), ("n_tokens", pa.int32()), ("n_bytes", pa.int64()), ("round_trip", pa.bool_())])


def slices(batches: Iterator[pa.RecordBatch], chars: int = 4_000_000, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Smaller batches of about as much text, so that a worker's memory doesn't follow the batch size."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(np.array(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64))
        at = 0
        while at < batch.num_rows:
            base = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, base + chars, "right")))
            yield batch.slice(at, to - at)
            at = to


def lists(ids: np.ndarray, bounds: np.ndarray, missing: np.ndarray) -> pa.Array:
    offsets = pa.array(bounds.astype(np.int32), mask=np.append(missing, False)) if missing.any() else pa.array(bounds.astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32)))


def decoded_flat(vocabulary: bpe.Vocabulary, ids: np.ndarray) -> np.ndarray:
    flat, offsets = byte_table(vocabulary)
    return flat[bpe.ragged(offsets, ids.astype(np.int64))]


def byte_table(vocabulary: bpe.Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    made = getattr(vocabulary, "_byte_table", None)
    if made is None:
        lengths = np.fromiter(map(len, vocabulary.bytes_of), np.int64, len(vocabulary.bytes_of))
        made = vocabulary._byte_table = (np.frombuffer(b"".join(vocabulary.bytes_of), np.uint8), np.concatenate([[0], np.cumsum(lengths)]))
    return made


def encoded(batch: pa.RecordBatch, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, their bounds, missing texts, bytes of each, and whether decoding gives each text's bytes back."""
    vocabulary = bpe.vocabulary(path)
    column = batch.column("text")
    missing = np.array(column.is_null())
    texts = ["" if t is None else t for t in column.to_pylist()]
    ids, bounds = vocabulary.encode_flat(*bpe.batch_spans(texts))
    back = decoded_flat(vocabulary, ids)
    sizes = byte_table(vocabulary)[1]
    ends = np.concatenate([[0], np.cumsum(np.diff(sizes)[ids.astype(np.int64)])])[bounds]
    whole = "".join(texts).encode("utf-8", "surrogatepass")
    source = np.concatenate([[0], np.cumsum([len(t) if t.isascii() else len(t.encode("utf-8", "surrogatepass")) for t in texts])]).astype(np.int64)
    if len(whole) == len(back) and (ends == source).all() and back.tobytes() == whole:
        same = np.ones(len(texts), bool)
    else:
        same = np.array([back[ends[i] : ends[i + 1]].tobytes() == t.encode("utf-8", "surrogatepass") for i, t in enumerate(texts)], bool)
    return ids, bounds, missing, np.diff(ends), same


def encode_whole(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SLICE_BYTES):
            ids, bounds, missing, size, same = encoded(batch, path)
            counts = pa.array(np.diff(bounds).astype(np.int32), mask=missing)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), lists(ids, bounds, missing), counts, pa.array(size, mask=missing), pa.array(same, mask=missing)], schema=_ARROW
            )

    return run


def pretokenise(chunk_chars: int, overlap: int):
    """Adds to each chunk the boundaries in its first and its last ``overlap`` characters, as offsets in the document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SLICE_BYTES):
            head, tail = [], []
            for k, last, text in zip(batch.column("k").to_pylist(), batch.column("last").to_pylist(), batch.column("text").to_pylist()):
                begins = bpe.spans_of(text)[:-1]
                settled = begins if last else begins[begins < len(text) - UNSETTLED]
                head.append((settled[settled < overlap] + k * chunk_chars).tolist())
                tail.append([] if last else (settled[settled >= chunk_chars] + k * chunk_chars).tolist())
            arrays = [batch.column(c) for c in ("doc_id", "h", "k", "last", "text")]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(head, pa.list_(pa.int64())), pa.array(tail, pa.list_(pa.int64()))], names=["doc_id", "h", "k", "last", "text", "head", "tail"])

    return run


def encode_parts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SLICE_BYTES):
            ids, bounds, missing, size, same = encoded(batch, path)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("h"), batch.column("k"), batch.column("n"), lists(ids, bounds, missing), pa.array(size), pa.array(same)],
                names=["doc_id", "h", "k", "n", "ids", "size", "same"],
            )

    return run


def encode(docs: DataFrame, path: str = bpe.VOCABULARY, chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """doc_id, token_ids, n_tokens, n_bytes, and round_trip: whether decoding the ids gives the text back."""
    docs = only(docs, doc_id="bigint", text="string")
    long = F.length("text") > chunk_chars + overlap
    short = docs.where(~F.coalesce(long, F.lit(False))).mapInArrow(encode_whole(path), SCHEMA)

    chunks = (
        docs.where(long)
        .select("doc_id", "text", F.xxhash64("text").alias("h"), F.ceil(F.length("text") / chunk_chars).cast("int").alias("n"))
        .select("doc_id", "h", "text", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"))
        .select("doc_id", "h", "k", (F.col("k") == F.col("n") - 1).alias("last"), F.substring("text", F.col("k") * chunk_chars + 1, F.lit(chunk_chars + overlap)).alias("text"))
    )
    cut = chunks.mapInArrow(pretokenise(chunk_chars, overlap), "doc_id bigint, h bigint, k int, last boolean, text string, head array<bigint>, tail array<bigint>")
    by = Window.partitionBy("doc_id", "h")
    beside = by.orderBy("k")
    stitched = (
        cut.withColumn("to", F.array_min(F.array_intersect("tail", F.first("head").over(beside.rangeBetween(1, 1)))))
        .withColumn("from", F.when(F.col("k") == 0, F.lit(0).cast("bigint")).otherwise(F.first("to").over(beside.rangeBetween(-1, -1))))
        .withColumn("n", (F.max("k").over(by) + 1))
        .withColumn("whole", ~F.min(F.col("last") | F.col("to").isNotNull()).over(by))
        .drop("head", "tail")
    )
    base = F.col("k").cast("bigint") * chunk_chars
    pieces = stitched.where("not whole").select(
        "doc_id", "h", "k", "n", F.expr(f"substring(text, int(from - k * {chunk_chars}L) + 1, int(coalesce(to, k * {chunk_chars}L + length(text)) - from))").alias("text")
    )
    # No shared boundary in some overlap: the chunks, without their overlaps, are put together and encoded as one.
    unstitched = (
        stitched.where("whole")
        .select("doc_id", "h", "k", "n", F.when(F.col("last"), F.col("text")).otherwise(F.substring("text", 1, chunk_chars)).alias("text"))
        .groupBy("doc_id", "h")
        .agg(F.array_sort(F.collect_list(F.struct("k", "text"))).alias("all"), F.max("n").alias("n"))
        .select("doc_id", "h", F.expr("size(all) div n").alias("copies"), F.array_join(F.transform(F.array_distinct("all"), lambda x: x["text"]), "").alias("text"))
        .select("doc_id", "text", F.explode(F.expr("sequence(1, copies)")))
        .select("doc_id", "text")
        .mapInArrow(encode_whole(path), SCHEMA)
    )
    spread = pieces.repartition(parts(docs), "doc_id", "h", "k")
    joined = (
        spread.mapInArrow(encode_parts(path), "doc_id bigint, h bigint, k int, n int, ids array<int>, size bigint, same boolean")
        .groupBy("doc_id", "h")
        .agg(F.array_sort(F.collect_list(F.struct("k", "ids", "size", "same"))).alias("all"), F.max("n").alias("n"))
        .select("doc_id", F.expr("size(all) div n").alias("copies"), F.array_distinct("all").alias("all"))
        .select("doc_id", "all", F.explode(F.expr("sequence(1, copies)")))
        .select(
            "doc_id",
            F.flatten(F.transform("all", lambda x: x["ids"])).alias("token_ids"),
            F.aggregate("all", F.lit(0), lambda a, x: a + F.size(x["ids"])).alias("n_tokens"),
            F.aggregate("all", F.lit(0).cast("bigint"), lambda a, x: a + x["size"]).alias("n_bytes"),
            F.forall("all", lambda x: x["same"]).alias("round_trip"),
        )
    )
    return short.unionByName(joined).unionByName(unstitched)


def decode(encoded_docs: DataFrame, path: str = bpe.VOCABULARY) -> DataFrame:
    """doc_id and text from doc_id and token_ids: the raw bytes of the ids, one after the other. Null ids give a null text; bytes that aren't UTF-8 are replaced by U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = bpe.vocabulary(path)
        for batch in batches:
            texts = [None if ids is None else vocabulary.decode_bytes(ids).decode("utf-8", "replace") for ids in batch.column("token_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return only(encoded_docs, doc_id="bigint", token_ids="array<int>").mapInArrow(run, "doc_id bigint, text string")


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
