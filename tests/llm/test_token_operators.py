"""Operators 3, 4 and 10: encoding, frames and prefix counts."""

import base64
import random
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillpack.llm import bpe
from quillpack.llm import op3_token_frames as frames
from quillpack.llm import op4_token_counts as counts
from quillpack.llm import op10_bpe_codec as codec

DATA = "/root/testdata/sf0.001"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
EDGES = [None, "", " ", "\n\n  x", "don't we'll 'rest", "été ﬁ 漢字 🙂\U0010fffd", "a" * 3000, "  \t word  ", "x'", "1234 56'78", "   y", "no\x00pe"]


@pytest.fixture(scope="module")
def plain():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts(n=150):
    random.seed(3)
    parts = ["the", " word", "'s", "'ll", "  ", "\n", "42", "!?", "é", " naïve", "漢", "🙂", "\t", "'", " x'", "tion", " "]
    return ["".join(random.choices(parts, k=random.randint(0, 60))) for _ in range(n)]


def test_vectorised_encoding(plain):
    held = [t for t in EDGES if t is not None] + texts()
    made = bpe.vocabulary().encode_batch(held)
    assert [x.tolist() for x in made] == [plain.encode_ordinary(t) for t in held]


@pytest.mark.parametrize("chunk, overlap", [(codec.CHUNK_CHARS, codec.OVERLAP_CHARS), (40, 12)])
def test_encode(documents, plain, chunk, overlap):
    rows = [*enumerate([*EDGES, *texts(60), "word " * 300, "z" * 500]), (1, ""), (5, EDGES[5]), (900, "same long text " * 30), (900, "same long text " * 30), (None, "nameless")]
    got = sorted((repr(r.doc_id), r.token_ids, r.n_tokens, r.n_bytes, r.round_trip) for r in codec.encode(documents(*rows), chunk_chars=chunk, overlap=overlap).collect()) if chunk > 1000 else None
    made = codec.encode(documents(*rows), chunk_chars=chunk, overlap=overlap).collect()
    want = [(i, None if t is None else plain.encode_ordinary(t), None if t is None else len(t.encode())) for i, t in rows]
    assert sorted(((r.doc_id, r.token_ids, r.n_bytes) for r in made), key=repr) == sorted(want, key=repr)
    assert all(r.round_trip in (True, None) and r.n_tokens == (None if r.token_ids is None else len(r.token_ids)) for r in made)
    assert got is None or len(got) == len(rows)


def test_memory_follows_the_slice(plain):
    """5 MB of text in one batch took 152 MB at once with slices of 4,000,000 bytes."""
    random.seed(4)
    held = [None, "", *[" ".join(f"word{random.randrange(3000)}" for _ in range(360)) for _ in range(1600)]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(held)), pa.int64()), pa.array(held)], names=["doc_id", "text"])
    run = codec.encode_whole(bpe.VOCABULARY)
    list(run(iter([batch])))  # what a worker keeps is made
    tracemalloc.start()
    for _ in run(iter([batch])):
        pass
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    made = [x for out in run(iter([batch])) for x in out.column("token_ids").to_pylist()]
    assert made == [None if t is None else plain.encode_ordinary(t) for t in held]
    assert batch.nbytes > 4_500_000 and most < 80e6


def test_decode(documents):
    rows = list(enumerate([*EDGES, *texts(20)]))
    back = codec.decode(codec.encode(documents(*rows))).collect()
    assert sorted(((r.doc_id, r.text) for r in back), key=repr) == sorted(rows, key=repr)
    assert codec.encode(documents()).collect() == []


def test_frames(spark, documents):
    rows = list(enumerate([*EDGES, *texts(40)])) + [(3, EDGES[3]), (None, "nameless")]
    docs = documents(*rows)
    shards = frames.pack(docs, frame_tokens=50, shard_tokens=700)
    whole = frames.read_documents(shards).collect()
    want = [(r.doc_id, r.token_ids) for r in codec.encode(docs).collect()]
    assert sorted(((r.doc_id, r.token_ids) for r in whole), key=repr) == sorted(want, key=repr)
    some = frames.read_documents(shards, [3, 0, 20]).collect()
    assert sorted((r.doc_id for r in some)) == [0, 3, 3, 20]
    assert frames.read_documents(shards, []).count() == 0
    assert frames.pack(documents()).collect() == []


def test_files_are_read_by_range(spark, documents, tmp_path, monkeypatch):
    rows = list(enumerate([*EDGES, *texts(40), "long words here " * 6000])) + [(3, EDGES[3]), (None, "nameless")]
    docs, folder = documents(*rows), str(tmp_path / "tokens")
    index = frames.write(frames.pack(docs, frame_tokens=50, shard_tokens=700), folder)
    want = sorted(((r.doc_id, r.token_ids) for r in codec.encode(docs).collect() if r.doc_id is not None), key=repr)
    assert index.count() == len(rows)
    got = lambda ids: sorted(((r.doc_id, r.token_ids) for r in frames.read_range(spark, folder, spark.createDataFrame([(i,) for i in ids], "doc_id int")).collect()), key=repr)
    assert got(range(-5, 70)) == want and got([]) == [] and got([3, 3, 999]) == [x for x in want if x[0] == 3]
    # Written again, as by a task that is run twice: the same files.
    index = frames.write(frames.pack(docs, frame_tokens=50, shard_tokens=700), folder)
    assert got(range(70)) == want
    # Of a file only the table and the frames asked for are decompressed.
    place = index.where("doc_id = 20").first()
    opened = []
    monkeypatch.setattr(frames, "read_frame", lambda data, entry, real=frames.read_frame: opened.append(len(data)) or real(data, entry))
    ((k, raw),) = frames.read_frames(f"{folder}/{place.shard}.zst", [place.frame])
    assert k == place.frame and len(opened) == 1 and opened[0] < (tmp_path / "tokens" / f"{place.shard}.zst").stat().st_size
    assert frames.write(frames.pack(documents()), str(tmp_path / "none")).count() == 0


def test_very_long_texts(documents, plain):
    text = "".join(random.Random(9).choices(["the", " word", "'s", "\n", "42", "é", " naïve", "漢", " x'"], k=40_000))
    rows = documents((1, text), (2, "short"))
    ids = plain.encode_ordinary(text)
    assert {r.doc_id: r.token_ids for r in frames.read_documents(frames.pack(rows)).collect()}[1] == ids
    at = counts.prefix_counts(rows).where("doc_id = 1").select(*[counts.tokens_at(F.col("prefix_counts"), F.lit(i)).alias(f"n{i}") for i in (1, 5_000, 77_777, len(text))]).first()
    assert list(at) == [len(plain.encode_ordinary(text[:i])) for i in (1, 5_000, 77_777, len(text))]


def test_each_frame_stands_alone(documents):
    import zstandard

    row = frames.pack(documents(*enumerate(texts(50))).coalesce(1), frame_tokens=64).first()
    table = frames.seek_table(bytes(row.data))
    assert len(table) == row.n_frames > 5
    # A decoder that knows nothing of the table reads all frames.
    assert len(zstandard.ZstdDecompressor().stream_reader(bytes(row.data), read_across_frames=True).read()) == row.n_tokens * row.id_bytes
    broken = bytearray(row.data)
    at = table[2][0] + 12
    broken[at] ^= 0xFF
    with pytest.raises((ValueError, zstandard.ZstdError)):
        frames.read_frame(bytes(broken), table[2])
    assert frames.read_frame(bytes(broken), table[1]) == frames.read_frame(bytes(row.data), table[1])
    with pytest.raises(ValueError):
        frames.seek_table(bytes(row.data[:-3]) + b"xyz")


def test_counts_of_every_prefix(plain):
    held = [t for t in EDGES if t is not None and len(t) < 200] + texts(60)
    for text, made in zip(held, counts.counter().batch(held)):
        assert made.tolist() == [len(plain.encode_ordinary(text[:i])) for i in range(1, len(text) + 1)], text


def test_budgets(documents, plain):
    rows = [*enumerate([*EDGES, *texts(30)])]
    made = counts.prefix_counts(documents(*rows), budgets=(0, 7, 10_000))
    asked = made.withColumn("at5", counts.tokens_at(F.col("prefix_counts"), F.lit(5))).withColumn("in7", counts.chars_within(F.col("prefix_counts"), F.lit(7)))
    by = dict(rows)
    for r in asked.collect():
        t = by[r.doc_id]
        if t is None:
            assert (r.n_tokens, r.chars_within_7, r.at5, r.in7) == (None,) * 4
            continue
        n = [len(plain.encode_ordinary(t[:i])) for i in range(len(t) + 1)]
        assert (r.n_chars, r.n_tokens, r.at5) == (len(t), n[-1], n[min(5, len(t))])
        assert r.chars_within_7 == r.in7 == max(i for i, x in enumerate(n) if x <= 7)
        assert (r.chars_within_0, r.chars_within_10000) == (0, len(t))


def test_queries(spark, plain):
    texts_ = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    ids = {r.doc_id: r.token_ids for r in codec.op10_bpe_codec(spark, DATA).collect()}
    assert ids == {i: plain.encode_ordinary(t) for i, t in texts_.items()}
    assert {r.doc_id: r.token_ids for r in frames.read_documents(frames.op3_token_frames(spark, DATA)).collect()} == ids
    assert {r.doc_id: r.n_tokens for r in counts.op4_token_counts(spark, DATA).collect()} == {i: len(x) for i, x in ids.items()}
