"""3. Token-id output: independent zstandard frames with a trailing seek table and per-frame checksums.

A shard is a byte string: frames, each holding the ids of whole documents as little-endian integers, then the seek
table of the seekable zstandard format in a skippable frame (compressed size, decompressed size and the low half of the
content's XXH64 for each frame; number of frames; flags; magic number). Any zstandard decoder reads the frames; a reader
of some documents decompresses only theirs. Shards are made within the scan's tasks: nothing is shuffled. ``write`` puts
them into files with an index of the documents, from which ``read_range`` reads the bytes of the frames asked for.

Defined results: null text has -1 in ``doc_tokens`` and no ids; empty text has 0; a repeated row is stored again; other
columns aren't looked at; an empty table gives no shard. A document is never split, so a very long one has a frame alone.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .common import only, stored, table
from .op10_bpe_codec import lists, slices

FRAME_TOKENS, SHARD_TOKENS, LEVEL = 65_536, 8_388_608, 3
SKIPPABLE, SEEKABLE, WITH_CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
SCHEMA = "shard string, n_docs int, n_tokens bigint, n_frames int, id_bytes int, doc_ids array<bigint>, doc_frames array<int>, doc_offsets array<int>, doc_tokens array<int>, data binary"
_LISTS = {"doc_ids": pa.int64(), "doc_frames": pa.int32(), "doc_offsets": pa.int32(), "doc_tokens": pa.int32()}
_ARROW = pa.schema([("shard", pa.string()), ("n_docs", pa.int32()), ("n_tokens", pa.int64()), ("n_frames", pa.int32()), ("id_bytes", pa.int32()), *[(k, pa.list_(v)) for k, v in _LISTS.items()], ("data", pa.binary())])


class Shard:
    def __init__(self, width: int, frame_tokens: int, level: int):
        self.width, self.frame_tokens = width, frame_tokens
        self.compress = zstandard.ZstdCompressor(level=level, write_checksum=True).compress
        self.start()

    def start(self) -> None:
        self.frames: list[bytes] = []
        self.table: list[bytes] = []
        self.lists: dict[str, list] = {k: [] for k in _LISTS}
        self.open: list[bytes] = []
        self.held = self.tokens = 0

    def add(self, doc_id: int | None, ids: np.ndarray | None) -> None:
        n = 0 if ids is None else len(ids)
        if self.held and self.held + n > self.frame_tokens:
            self.close_frame()
        for k, v in zip(_LISTS, (doc_id, len(self.frames), self.held, -1 if ids is None else n)):
            self.lists[k].append(v)
        if n:
            self.open.append(ids.tobytes())
            self.held += n
            self.tokens += n

    def close_frame(self) -> None:
        raw = b"".join(self.open)
        made = self.compress(raw)
        self.table.append(struct.pack("<III", len(made), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.frames.append(made)
        self.open, self.held = [], 0

    def close(self, name: str) -> pa.RecordBatch:
        if self.open or not self.frames:
            self.close_frame()
        body = b"".join(self.table) + struct.pack("<IBI", len(self.table), WITH_CHECKSUMS, SEEKABLE)
        data = b"".join([*self.frames, struct.pack("<II", SKIPPABLE, len(body)), body])
        row = {"shard": name, "n_docs": len(self.lists["doc_ids"]), "n_tokens": self.tokens, "n_frames": len(self.frames), "id_bytes": self.width, **self.lists, "data": data}
        self.start()
        return pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in _ARROW], schema=_ARROW)


def pack(docs: DataFrame, path: str = bpe.VOCABULARY, frame_tokens: int = FRAME_TOKENS, shard_tokens: int = SHARD_TOKENS, level: int = LEVEL) -> DataFrame:
    """One row a shard: its directory of documents and its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = bpe.vocabulary(path)
        shard, n, part = Shard(vocabulary.dtype.itemsize, frame_tokens, level), 0, TaskContext.get().partitionId()
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            ids, bounds = vocabulary.encode_flat(*bpe.batch_spans([t or "" for t in texts]))
            ends = bounds.tolist()
            for i, (doc_id, text) in enumerate(zip(batch.column("doc_id").to_pylist(), texts)):
                shard.add(doc_id, None if text is None else ids[ends[i] : ends[i + 1]])
                if shard.tokens >= shard_tokens:
                    yield shard.close(f"{part:06d}-{n:04d}")
                    n += 1
        if shard.lists["doc_ids"]:
            yield shard.close(f"{part:06d}-{n:04d}")

    return only(docs, doc_id="bigint", text="string").mapInArrow(run, SCHEMA)


def seek_table(data: bytes) -> list[tuple[int, int, int, int]]:
    """Offset, compressed size, decompressed size and checksum of each frame, from the end of the shard alone."""
    n, flags, magic = struct.unpack("<IBI", data[-9:])
    if magic != SEEKABLE or not flags & WITH_CHECKSUMS:
        raise ValueError("no seek table with checksums at the end")
    body, out, at = data[-9 - 12 * n : -9], [], 0
    for packed, size, check in struct.iter_unpack("<III", body):
        out.append((at, packed, size, check))
        at += packed
    if at + 8 + len(body) + 9 != len(data):
        raise ValueError("the seek table doesn't fit the shard")
    return out


def read_frame(data: bytes, entry: tuple[int, int, int, int]) -> bytes:
    at, packed, size, check = entry
    raw = zstandard.ZstdDecompressor().decompress(data[at : at + packed], max_output_size=size) if size else b""
    if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
        raise ValueError("a frame's checksum doesn't hold")
    return raw


def _token_rows(doc_ids: list, ids: list[np.ndarray | None]) -> pa.RecordBatch:
    sizes = np.cumsum([0, *[0 if x is None else len(x) for x in ids]]).astype(np.int32)
    flat = np.concatenate([np.zeros(0, np.int32), *[x for x in ids if x is not None]]).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), lists(flat, sizes, np.array([x is None for x in ids], bool))], names=["doc_id", "token_ids"])


def read_documents(shards: DataFrame, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id and token_ids of the asked documents (all if None); only frames that hold one are decompressed."""
    wanted = None if doc_ids is None else frozenset(doc_ids)
    if wanted is not None:
        shards = shards.where(F.arrays_overlap("doc_ids", F.array(*[F.lit(x).cast("bigint") for x in sorted(wanted)]) if wanted else F.array().cast("array<bigint>")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                entries, kept, out, held = seek_table(row["data"]), {}, ([], []), 0
                for doc_id, frame, at, n in zip(*[row[k] for k in _LISTS]):
                    if wanted is not None and doc_id not in wanted:
                        continue
                    if n > 0 and frame not in kept:
                        kept = {frame: np.frombuffer(read_frame(row["data"], entries[frame]), f"<u{row['id_bytes']}")}
                    out[0].append(doc_id)
                    out[1].append(None if n < 0 else kept[frame][at : at + n] if n else np.zeros(0, np.int32))
                    held += max(n, 0)
                    if held > 1_000_000:
                        yield _token_rows(*out)
                        out, held = ([], []), 0
                yield _token_rows(*out)

    return shards.select("id_bytes", *_LISTS, "data").mapInArrow(run, "doc_id bigint, token_ids array<int>")


def write(shards: DataFrame, folder: str) -> DataFrame:
    """Each shard as a file of a folder that all executors share, and where each document lies as Parquet in index below it.

    A file gets its name when it is whole, so a task that runs again only puts the same file in its place. Returns the
    index: doc_id, shard, id_bytes, frame, offset and n of every document, in ids; by range of doc_id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            for i, (name, data) in enumerate(zip(batch.column("shard").to_pylist(), batch.column("data"))):
                beside = f"{folder}/.{name}-{uuid.uuid4().hex}"
                with open(beside, "wb") as f:
                    f.write(data.as_buffer())
                os.replace(beside, f"{folder}/{name}.zst")
                own = [batch.column(k)[i].values for k in _LISTS]
                n = len(own[0])
                yield pa.RecordBatch.from_arrays([own[0], pa.array([name] * n, pa.string()), pa.array(np.full(n, batch.column("id_bytes")[i].as_py(), np.int32)), *own[1:]], names=["doc_id", "shard", "id_bytes", "frame", "offset", "n"])

    index = shards.select("shard", "id_bytes", *_LISTS, "data").mapInArrow(run, "doc_id bigint, shard string, id_bytes int, frame int, offset int, n int")
    # Written once as it comes and then put in order: the files aren't made a second time.
    index = stored(index, "token-index")
    index.repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.mode("overwrite").parquet(f"{folder}/index")
    return shards.sparkSession.read.schema(index.schema).parquet(f"{folder}/index")


def read_frames(path: str, frames: list[int]) -> Iterator[tuple[int, bytes]]:
    """The asked frames of a file, in order: of the file only the seek table and these frames are read."""
    with open(path, "rb") as f:
        f.seek(-9, os.SEEK_END)
        n, flags, magic = struct.unpack("<IBI", f.read(9))
        if magic != SEEKABLE or not flags & WITH_CHECKSUMS:
            raise ValueError("no seek table with checksums at the end")
        f.seek(-9 - 12 * n, os.SEEK_END)
        table_ = np.frombuffer(f.read(12 * n), "<u4").reshape(-1, 3).astype(np.int64)
        begin = np.concatenate([[0], np.cumsum(table_[:, 0])])
        for k in sorted(set(frames)):
            f.seek(int(begin[k]))
            packed, size, check = table_[k].tolist()
            yield k, read_frame(f.read(packed), (0, packed, size, check))


def read_range(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """doc_id and token_ids of the documents whose doc_id is in ``wanted``; files are read by range, by one task each."""
    asked = wanted.select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct()
    places = spark.read.parquet(f"{folder}/index").join(asked, "doc_id").repartition("shard").sortWithinPartitions("shard", "frame", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, kind = np.array(batch.column("shard").to_pylist(), object), batch.column("id_bytes").to_numpy()
            doc_ids, frame, offset, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "frame", "offset", "n"))
            ids: list[np.ndarray | None] = [np.zeros(0, np.int32) if k >= 0 else None for k in n.tolist()]
            for name in dict.fromkeys(shard.tolist()):
                here = (shard == name) & (n > 0)
                for k, raw in read_frames(f"{folder}/{name}.zst", frame[here].tolist()):
                    for i in np.flatnonzero(here & (frame == k)).tolist():
                        ids[i] = np.frombuffer(raw, f"<u{kind[i]}")[offset[i] : offset[i] + n[i]]
            yield _token_rows(doc_ids.tolist(), ids)

    return places.select("doc_id", "shard", "id_bytes", "frame", "offset", "n").mapInArrow(run, "doc_id bigint, token_ids array<int>")


def op3_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
