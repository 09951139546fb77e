"""9. Line dedup by a segment-partition edit join.

Two lines are alike if they are equal, or if both have at least ``LEAST_CHARS`` characters and an edit distance of at
most ``THRESHOLD``. An occurrence of a line is dropped if an alike line occurs earlier, by (doc_id, line number); the
row names the earliest one. Lines are compared without white space at their ends; blank lines are never dropped. The
threshold doesn't grow with the length, so a long line with one word replaced is no repeat; the README has the share.

Lines of each length are cut into ``THRESHOLD + 1`` segments; a line within the threshold has one of them unchanged, at
one of few places, so each line probes the segment index of every admissible length with these substrings only
(multi-match-aware selection; Li, Deng, Wang and Feng, "Pass-Join", 2011). Index and probe entries are hashes: they are
partitioned by hash once, into as many partitions as keep one within ``PART_ENTRIES``, and joined there. Only the lines of
candidate pairs are read again, and verified by bit-parallel edit distance within the band (Hyyrö, "A bit-vector algorithm
for computing Levenshtein and Damerau edit distances", 2003). Candidates meet by 63 bits of a line's hash; a line's
identity is all 128.

Defined results: null text has no lines; null ids count as later than all others; a row that repeats with the same id and
text shares its line numbers, so its lines aren't earlier than themselves and stay; of rows with one id and different
texts, lines of equal number are equally early and both stay; a very long text is read whole, a very long line is a line
like any other; an empty table gives no row; other columns aren't looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, words
from .common import only, parts, stored, table
from .op10_bpe_codec import SLICE_BYTES, slices

THRESHOLD, LEAST_CHARS, BROADCAST_LINES = 2, 24, 4_000_000
#: Entries of a partition of signatures, about, so that its memory doesn't follow the size of the table.
PART_ENTRIES = 3_000_000
BLANK = " \t\r\f\v"
LAST = (1 << 63) - 1


def lines_of(text: str) -> list[str]:
    return [x.strip(BLANK) for x in text.split("\n")]


def line_hash(line: str) -> tuple[int, int]:
    x = xxhash.xxh3_128_intdigest(line.encode("utf-8", "surrogatepass"))
    a, b = x >> 64, x & (1 << 64) - 1
    return (a - (1 << 64) if a >> 63 else a), (b - (1 << 64) if b >> 63 else b)


def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every line that isn't blank, by its 128-bit hash."""
    for batch in slices(batches, SLICE_BYTES):
        row, number, upper, lower, chars = [], [], [], [], []
        for i, text in enumerate(batch.column("text").to_pylist()):
            for j, line in enumerate(lines_of(text or "")):
                if line:
                    a, b = line_hash(line)
                    row.append(i)
                    number.append(j)
                    upper.append(a)
                    lower.append(b)
                    chars.append(len(line))
        at = pa.array(row, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(at), batch.column("key").take(at), pa.array(number, pa.int32()), pa.array(upper, pa.int64()), pa.array(lower, pa.int64()), pa.array(chars, pa.int32())],
            names=["doc_id", "key", "line_no", "a", "b", "chars"],
        )


def segment(lengths: np.ndarray, i: int, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Where segment i of lines of these lengths begins, and its length; the later segments are the longer ones."""
    short = lengths // (threshold + 1)
    longer = lengths % (threshold + 1)
    first_longer = threshold + 1 - longer
    return short * i + np.maximum(0, i - first_longer), short + (i >= first_longer)


def shifts(i: int, d: int, threshold: int) -> range:
    """Where, relative to segment i of a line shorter by d, a line within the threshold may have it."""
    return range(max(-i, d - (threshold - i)), min(i, d + (threshold - i)) + 1)


def entries_of_line(threshold: int) -> int:
    every = range(threshold + 1)
    return len(every) + sum(len(shifts(i, d, threshold)) for d in every for i in every)


def signatures(threshold: int, least: int):
    """sig and line of every index entry (line even) and probe (line odd); of equal lines in a task, the first's."""
    one, two = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches, SLICE_BYTES):
            lines, ids = [], []
            if len(seen) > 2_000_000:
                seen.clear()
            for text in batch.column("text").to_pylist():
                for line in lines_of(text or ""):
                    if len(line) >= least:
                        a = line_hash(line)[0]
                        if a not in seen:
                            seen.add(a)
                            lines.append(line)
                            ids.append(a)
            if not lines:
                continue
            codes, bounds = words.codes_of(lines)
            begin, size = bounds[:-1], np.diff(bounds) - 1
            line = np.array(ids, np.int64) & ~1
            starts, ends, tags, of = [], [], [], []

            def add(at, length, i, of_length, which, odd):
                starts.append(begin[which] + at)
                ends.append(begin[which] + at + length)
                tags.append(np.uint64((i + 1) * one & (1 << 64) - 1) + of_length.astype(np.uint64) * np.uint64(two))
                of.append(line[which] | odd)

            every = np.arange(len(lines))
            for i in range(threshold + 1):
                add(*segment(size, i, threshold), i, size, every, 0)
            for d in range(threshold + 1):
                which = np.flatnonzero(size - d >= least)
                there = size[which] - d
                for i in range(threshold + 1):
                    p, length = segment(there, i, threshold)
                    for shift in shifts(i, d, threshold):
                        ok = (p + shift >= 0) & (p + shift + length <= size[which])
                        add(p[ok] + shift, length[ok], i, there[ok], which[ok], 1)
            sums = words.span_hashes(codes, np.concatenate(starts), np.concatenate(ends))
            sig = words.mixed(sums + np.concatenate(tags)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(np.concatenate(of))], names=["sig", "line"])

    return run


def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of lines of which one's probe meets the other's index entry, within one partition of signatures."""
    held, n = [], 0

    def compact():
        x = np.concatenate(held) if held else np.empty(0, _PAIR)
        return np.unique(x) if len(x) else x

    for batch in batches:
        x = np.empty(batch.num_rows, _PAIR)
        x["sig"], x["line"] = batch.column("sig").to_numpy(), batch.column("line").to_numpy()
        held.append(x)
        n += len(x)
        if n > 8_000_000:
            held = [compact()]
            n = -len(held[0])
    if not held:
        return
    sig, line = np.concatenate([x["sig"] for x in held]), np.concatenate([x["line"] for x in held])
    held.clear()
    order = np.argsort(sig, kind="stable")
    sig, line = sig[order], line[order]
    first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    size = np.diff(np.append(first, len(sig)))
    probes = np.add.reduceat(line & 1, first)
    both = np.flatnonzero((probes > 0) & (probes < size))
    # Only signatures with entries of both sides go on; of equal entries one.
    at = bpe.ragged(np.append(first, len(sig)), both)
    group, line = np.repeat(np.arange(len(both)), size[both]), line[at]
    order = np.lexsort((line, group))
    group, line = group[order], line[order]
    fresh = np.concatenate([[True], (group[1:] != group[:-1]) | (line[1:] != line[:-1])])[: len(line)]
    group, line = group[fresh], line[fresh]
    odd = line & 1 == 1
    index, of, probe = line[~odd], group[~odd], line[odd] & ~1
    bounds = np.concatenate([[0], np.cumsum(np.bincount(group[odd], minlength=len(both)))])
    work = np.cumsum(np.diff(bounds)[of]) if len(of) else np.empty(0, np.int64)
    begin = 0
    while begin < len(index):
        end = max(begin + 1, int(np.searchsorted(work, (work[begin - 1] if begin else 0) + 1_000_000, "right")))
        here = of[begin:end]
        a = np.repeat(index[begin:end], np.diff(bounds)[here])
        b = probe[bpe.ragged(bounds, here)]
        keep = a != b
        pairs = np.unique(np.stack([np.minimum(a, b)[keep], np.maximum(a, b)[keep]], 1), axis=0)
        if len(pairs):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["x", "y"])
        begin = end


_PAIR = np.dtype([("sig", np.int64), ("line", np.int64)])


def banded(left: list[str], right: list[str], threshold: int) -> np.ndarray:
    """Edit distances, or threshold + 1 where they are larger: bit-parallel over a band, for all pairs at once."""
    swap = [core(a, b) if len(a) >= len(b) else core(b, a) for a, b in zip(left, right)]
    m, n = np.array([len(a) for a, _ in swap]), np.array([len(b) for _, b in swap])
    out = np.full(len(swap), threshold + 1, np.int64)
    for i in np.flatnonzero(m <= 2 * threshold + 2).tolist():  # no room for a band
        out[i] = _plain(*swap[i])
    order = np.flatnonzero((m - n <= threshold) & (m > 2 * threshold + 2))
    order = order[np.argsort(n[order], kind="stable")]
    for at in range(0, len(order), 2048):
        which = order[at : at + 2048]
        out[which] = _banded([swap[i][0] for i in which], [swap[i][1] for i in which], m[which], n[which], threshold)
    return np.minimum(out, threshold + 1)


def core(a: str, b: str) -> tuple[str, str]:
    """Both without what they begin with alike and end with alike, which doesn't change their distance."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle - 1)
    a, b = a[low:], b[low:]
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        same = a[len(a) - middle : len(a) - low] == b[len(b) - middle : len(b) - low]
        low, high = (middle, high) if same else (low, middle - 1)
    return a[: len(a) - low], b[: len(b) - low]


def _plain(a: str, b: str) -> int:
    above = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
        above = row
    return above[-1]


def _matrix(texts: list[str], width: int, left: int, fill: int) -> np.ndarray:
    out = np.full((len(texts), left + width), fill, np.uint32)
    for i, t in enumerate(texts):
        out[i, left : left + len(t)] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4")
    return out


def _banded(long: list[str], short: list[str], m: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
    width = int(n.max()) if len(n) else 0
    a = _matrix(long, int(m.max()) + 2 * k + 2, k, 0x110000).T.copy()
    b = _matrix(short, width, 0, 0x110001).T.copy()
    one, all_ones = np.uint64(1), ~np.uint64(0)
    vp = np.full(len(m), (all_ones << np.uint64(63 - k)), np.uint64)
    vn = np.zeros(len(m), np.uint64)
    distance = np.full(len(m), k, np.int64)
    top, mask = np.uint64(63), np.full(len(m), 62, np.uint64)
    result = np.where(n == 0, m, -1)
    for i in range(width):
        x = np.zeros(len(m), np.uint64)
        for j in range(2 * k + 1):
            x |= (a[min(i + j, len(a) - 1)] == b[i]).astype(np.uint64) << np.uint64(63 - 2 * k + j)
        d0 = (((x & vp) + vp) ^ vp) | x | vn
        hp, hn = vn | ~(d0 | vp), d0 & vp
        diagonal = i < m - k
        down = (d0 >> top) & one
        across = ((hp >> mask) & one).astype(np.int64) - ((hn >> mask) & one).astype(np.int64)
        distance += np.where(i < n, np.where(diagonal, 1 - down.astype(np.int64), across), 0)
        mask = np.where(diagonal | (mask == 0), mask, mask - one)
        d0 >>= one
        vp, vn = hn | ~(d0 | hp), d0 & hp
    return np.where(result >= 0, result, distance)


def verified(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(slices(batches, 1_000_000, "left"), 1_000_000, "right"):
            near = banded(batch.column("left").to_pylist(), batch.column("right").to_pylist(), threshold) <= threshold
            at = pa.array(np.flatnonzero(near))
            yield pa.RecordBatch.from_arrays([batch.column(c).take(at) for c in _PAIRED], names=_PAIRED)

    return run


_PAIRED = ["xa", "xb", "ya", "yb"]


def texts_of(docs: DataFrame, lines: DataFrame, least: int, broadcast_lines: int) -> DataFrame:
    """line, both halves of the hash, and text of the lines asked for."""
    few = lines.limit(broadcast_lines + 1).count() <= broadcast_lines
    shared = docs.sparkSession.sparkContext.broadcast(np.sort(np.fromiter((r.line for r in lines.toLocalIterator()), np.int64))) if few else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in slices(batches, SLICE_BYTES):
            if len(seen) > 1_000_000:
                seen.clear()
            ids, texts = [], []
            for text in batch.column("text").to_pylist():
                for line in lines_of(text or ""):
                    if len(line) >= least:
                        ids.append(line_hash(line))
                        texts.append(line)
            both = np.array(ids, np.int64).reshape(-1, 2)
            held = both[:, 0] & ~1
            if shared is not None:
                known = shared.value
                k = np.minimum(np.searchsorted(known, held), max(0, len(known) - 1))
                at = np.flatnonzero(known[k] == held) if len(known) else np.empty(0, np.int64)
            else:
                at = np.arange(len(held))
            new = []
            for i in at.tolist():
                if ids[i] not in seen:
                    seen.add(ids[i])
                    new.append(i)
            columns = [pa.array(held[new]), pa.array(both[new, 0]), pa.array(both[new, 1]), pa.array([texts[i] for i in new], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["line", "a", "b", "text"])

    found = docs.select("text").mapInArrow(run, "line bigint, a bigint, b bigint, text string")
    if not few:
        found = found.join(lines, "line", "left_semi")
    return found.groupBy("line", "a", "b").agg(F.min("text").alias("text"))


def similar_lines(docs: DataFrame, n_lines: int, threshold: int = THRESHOLD, least: int = LEAST_CHARS, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """xa, xb, ya, yb: the hashes of different lines within the threshold; docs has so many lines that are long enough."""
    pieces = max(parts(docs), -(-n_lines * entries_of_line(threshold) // PART_ENTRIES))
    sigs = docs.select("text").mapInArrow(signatures(threshold, least), "sig bigint, line bigint").repartition(pieces, "sig")
    pairs = stored(sigs.mapInArrow(paired, "x bigint, y bigint").distinct(), "line-pairs")
    lines = pairs.select(F.explode(F.array("x", "y")).alias("line")).distinct()
    texts = stored(texts_of(docs, lines, least, broadcast_lines), "line-texts")
    side = lambda line, a, b, text: texts.select(F.col("line").alias(line), F.col("a").alias(a), F.col("b").alias(b), F.col("text").alias(text))
    both = pairs.join(side("x", "xa", "xb", "left"), "x").join(side("y", "ya", "yb", "right"), "y")
    return both.select(*_PAIRED, "left", "right").mapInArrow(verified(threshold), "xa bigint, xb bigint, ya bigint, yb bigint")


def dropped_lines(docs: DataFrame, threshold: int = THRESHOLD, least: int = LEAST_CHARS, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """doc_id, key (xxhash64 of the text), line_no (from 0), and the earliest alike line, of every occurrence to drop."""
    docs = only(docs, doc_id="bigint", text="string")
    lines = stored(docs.withColumn("key", F.xxhash64("text")).mapInArrow(occurrences, "doc_id bigint, key bigint, line_no int, a bigint, b bigint, chars int"), "lines")
    place = F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("doc_id"), "line_no")
    first = lines.groupBy("a", "b").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    n_lines = lines.where(F.col("chars") >= least).count()
    near = stored(similar_lines(docs, n_lines, threshold, least, broadcast_lines), "near-lines")
    near = near.union(near.select("ya", "yb", "xa", "xb")).toDF("a", "b", "oa", "ob")
    of_near = stored(first.join(near.select("a", "b").distinct(), ["a", "b"], "left_semi"), "near-first")
    others = of_near.select(F.col("a").alias("oa"), F.col("b").alias("ob"), F.col("first").alias("at"))
    earliest = near.join(others, ["oa", "ob"]).groupBy("a", "b").agg(F.min("at").alias("near"))
    exact = first.where("n > 1").select("a", "b", "first")
    refs = exact.union(of_near.join(earliest, ["a", "b"]).select("a", "b", F.least("first", "near").alias("first"))).groupBy("a", "b").agg(F.min("first").alias("kept"))
    return (
        lines.join(refs, ["a", "b"])
        .where(F.col("kept") < place)
        .select("doc_id", "key", "line_no", F.nullif(F.col("kept.doc_id"), F.lit(LAST)).alias("kept_doc_id"), F.col("kept.line_no").alias("kept_line_no"))
        .distinct()
    )


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents, with all their columns, without the dropped lines; those of which nothing but blanks is left go."""
    gone = dropped_lines(docs).groupBy(F.col("doc_id").alias("_doc_id"), F.col("key").alias("_key")).agg(F.collect_set("line_no").alias("_gone"))
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_k"))
    joined = source.join(gone, F.col("_id").cast("bigint").eqNullSafe(F.col("_doc_id")) & (F.col("_k") == F.col("_key")), "left")
    kept = F.expr("array_join(filter(split(_row.text, '\\n', -1), (x, i) -> not array_contains(_gone, i)), '\\n')")
    joined = joined.withColumn("_text", F.when(F.col("_gone").isNull(), F.col("_row.text")).otherwise(kept))
    joined = joined.where(F.col("_gone").isNull() | F.col("_text").rlike("[^\\s]"))
    return joined.select(*[F.col("_text").alias(c) if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dropped_lines(table(spark, sf_dir, "documents")).drop("key")


# levenshtein() counts bytes, so letters of two bytes become unused ones of one; letter counts differ by the distance at most.
_COUNTS = [f"length(line) - length(replace(line, '{c}', '')) AS c{i}" for i, c in enumerate("eatn ,")]
_CLOSE = " AND ".join(f"b.c{i} BETWEEN a.c{i} - {THRESHOLD} AND a.c{i} + {THRESHOLD}" for i in range(len(_COUNTS)))
_WIDE, _NARROW = "éèêçñóíäöüßÉÈÊÇÑÓÍÄÖÜ", " || ".join(f"chr({i})" for i in (*range(1, 9), *range(14, 27)))
SQL = f"""
WITH l AS (SELECT doc_id, line_no, trim(line, ' ' || chr(9) || chr(13) || chr(12) || chr(11)) AS line
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents)),
u AS (SELECT line, length(line) AS n, min({{'d': doc_id, 'l': line_no}}) AS first, translate(line, '{_WIDE}', {_NARROW}) AS t, {", ".join(_COUNTS)} FROM l WHERE line <> '' GROUP BY line),
c AS MATERIALIZED (SELECT a.line, a.t AS ta, b.t AS tb, b.first FROM u a JOIN u b ON b.n BETWEEN a.n - {THRESHOLD} AND a.n + {THRESHOLD}
  WHERE a.n >= {LEAST_CHARS} AND b.n >= {LEAST_CHARS} AND a.line <> b.line AND {_CLOSE}),
s AS (SELECT line, min(first) AS near FROM c WHERE levenshtein(ta, tb) <= {THRESHOLD} GROUP BY line),
k AS (SELECT u.line, least(u.first, coalesce(s.near, u.first)) AS kept FROM u LEFT JOIN s USING (line))
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, kept.d AS kept_doc_id, CAST(kept.l AS INTEGER) AS kept_line_no FROM l JOIN k USING (line) WHERE kept < {{'d': doc_id, 'l': line_no}}
"""
