"""7. SimHash near-dedup by tiled exact comparison, within bands.

A document's fingerprint has ``BITS`` bits: each is the majority of that bit over the hashes of the document's distinct
pairs of neighbouring words (its single word, if it has but one). Documents within ``RADIUS`` bits of each other are near
duplicates; groups are the connected components, and the first document of each by id stays.

The radius follows from the copies to be found: those that share at least half of all their distinct runs of three words
(Jaccard), which is about one word changed in eight. Of such pairs of different texts of 30 words or more at the 0.1 scale
1,234 of 1,259 (98 %) are within 28 bits - 836 (66 %) are within 20 -, and of 589 texts that have an earlier copy 9 stay;
from 0.5 to 0.6 it is 25 of 33 pairs. Of the 1,247 pairs of any length within 28 bits 6 share less than half, none less
than 0.3. Two unrelated fingerprints of even bits are within 28 bits with probability 5e-11, so some meet among many.

The result has a row for each document in a group of two or more: kept_doc_id, the group's class, and n_links, the number
of other documents within the radius.

Equal fingerprints are one. The distinct ones, in order of their number of one bits, are cut into tiles, and every pair of
tiles is compared, except those whose bit counts differ by more than the radius - in them no two fingerprints can be near.
Within a pair of tiles the bits are cut into bands, each with a limit, such that fingerprints within the radius keep to the
limit in one band at least (``bands_of``): only those whose value in a band is within its limit are compared, with
exclusive or and bit counts of all bits. Nothing near is lost by that. Where bands would save nothing, as with few
fingerprints or many alike in some bits, all are compared whose bit counts allow it. Several tasks share a pair of tiles by
the bands' values if there are few. What a task finds is reduced to a star for each group before it leaves, so that groups
of thousands stay linear in size. The comparison is exact; of random fingerprints in full tiles bands
leave 11 % of the pairs, but its work still grows with the square of the number of distinct fingerprints.

Defined results: documents without any word (null or empty text, too) have no fingerprint and are in no group; rows that
repeat an id are one document if their text is equal and near duplicates, if their texts are; a null id is reported as
null and counts as later than all others; a very long text is one fingerprint like any other; an empty table gives no
row; other columns aren't looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import words
from .common import only, parts, stored, table
from .groups import components, labels
from .op10_bpe_codec import slices

BITS, RADIUS = 128, 28
#: Rows of a tile at most, and the least number of tasks that tiles are compared by, of so many fingerprints each at least.
TILE_ROWS, LEAST_TASKS, TASK_ROWS = 1 << 18, 24, 4096
#: Pairs compared at once; pairs that are compared without looking for bands; what a band's value costs, in pairs.
CELLS, FEW_CELLS, PER_BUCKET = 1 << 17, 1 << 26, 15_000
_SECOND = np.uint64(0x6A09E667F3BCC909)


def fingerprints(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit words for each text, and whether it has any word at all."""
    w, bounds = words.words_of(texts)
    size = np.diff(bounds)
    pairs = words.shingles_of(w, 2)
    inside = np.ones(len(pairs), bool)
    last = bounds[1:-1] - 1
    inside[last[(last >= 0) & (last < len(pairs))]] = False
    at = np.flatnonzero(inside)
    of = np.searchsorted(bounds, at, "right") - 1
    single = np.flatnonzero(size == 1)
    h = np.concatenate([pairs[at], w[bounds[single]]])
    of = np.concatenate([of, single])
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    h, of = h[fresh], of[fresh]
    out = np.zeros((len(texts), 2), np.uint64)
    some = size > 0
    if len(h):
        starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        n = np.diff(np.append(starts, len(h)))
        for k, half in enumerate((h, words.mixed(h ^ _SECOND))):
            bits = np.unpackbits(half.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            votes = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
            packed = np.packbits(2 * votes > n[:, None], axis=1, bitorder="little")
            out[of[starts], k] = packed.view("<u8").ravel()
    return out, some


def fingerprinted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 400_000):  # each word takes some 150 bytes on the way
        out, some = fingerprints(["" if t is None else t for t in batch.column("text").to_pylist()])
        f = out.view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(f[:, 0].copy(), mask=~some), pa.array(f[:, 1].copy(), mask=~some)], names=["doc_id", "key", "f", "g"])


@lru_cache(32)
def bands_of(n: int, radius: int) -> tuple[tuple[int, int, np.ndarray], ...]:
    """First bit, width and the differences allowed of the bands that cost least for n fingerprints on each side.

    The bits are cut into m bands with limits t whose sum of t + 1 is radius + 1: fingerprints within the radius differ by
    at most t in some band, else they would differ by more in all.
    """

    def made(m: int) -> list[tuple[int, int, int]]:
        limits = [(radius + 1 + i) // m - 1 for i in range(m)]
        out, at = [], 0
        for i, t in enumerate(limits):
            width = (BITS + i) // m  # the wider bands are those of the larger limits
            out.append((at, width, t))
            at += width
        return [x for x in out if x[2] >= 0]

    def cost(m: int) -> float:
        ball = [(w, sum(comb(w, k) for k in range(t + 1))) for _, w, t in made(m)]
        return sum(min(n, 1 << w) * (PER_BUCKET + 5 * v * n / (1 << w)) + n * n * v / (1 << w) for w, v in ball)

    best = min((m for m in range(BITS // 18, 33) if max(t for *_, t in made(m)) <= 4), key=cost)
    return tuple((at, w, np.array([sum(1 << i for i in c) for k in range(t + 1) for c in combinations(range(w), k)], np.int64)) for at, w, t in made(best))


def band(x: np.ndarray, at: int, width: int) -> np.ndarray:
    """The bits at .. at + width of fingerprints of two words, as numbers."""
    low, shift = x[:, at // 64] >> np.uint64(at % 64), 64 - at % 64
    if shift < width:
        low = low | (x[:, 1] << np.uint64(shift))
    return (low & np.uint64((1 << width) - 1)).astype(np.int64)


class Cells:
    """Near pairs of some rows with others, in blocks of a bounded number of cells in the same buffers."""

    def __init__(self, radius: int):
        self.radius, self.x, self.d, self.e = radius, np.empty(CELLS, np.uint64), np.empty(CELLS, np.uint8), np.empty(CELLS, np.uint8)

    def near(self, rows: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for i in range(0, len(rows), 64):
            some = rows[i : i + 64]
            step = CELLS // len(some)
            for j in range(0, len(b0), step):
                shape = len(some), len(b0[j : j + step])
                x, d, e = (v[: shape[0] * shape[1]].reshape(shape) for v in (self.x, self.d, self.e))
                np.bitwise_count(np.bitwise_xor(some[:, :1], b0[j : j + step], out=x), out=d)
                np.bitwise_count(np.bitwise_xor(some[:, 1:], b1[j : j + step], out=x), out=e)
                # Near pairs are so few that most blocks end here.
                if np.add(d, e, out=d).min() <= self.radius:
                    p, q = np.divmod(np.flatnonzero(self.d[: d.size] <= self.radius), shape[1])
                    yield p + i, q + j


def blocks(a: np.ndarray, b: np.ndarray, radius: int, same: bool, share: int = 0, shares: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of the near pairs of two arrays of fingerprints, each in order of its bit counts, each pair once.

    Of the work one share is done; all shares together give all pairs.
    """
    if not len(a) or not len(b):
        return
    count = lambda x: np.bitwise_count(x).sum(1, dtype=np.int32)
    ca, cb = count(a), count(b)
    starts = np.arange(0, len(a), 64)
    low = np.maximum(np.searchsorted(cb, ca[starts] - radius), starts if same else 0)
    high = np.searchsorted(cb, ca[np.minimum(starts + 63, len(a) - 1)] + radius, "right")
    whole = 64 * int(np.maximum(high - low, 0).sum())
    cells = Cells(radius)
    if whole > FEW_CELLS:
        bands, cost, at_b = bands_of((len(a) + len(b)) // 2, radius), 0, []
        for at, width, ball in bands:
            va = band(a, at, width)
            vb = va if same else band(b, at, width)
            na, nb = np.bincount(va, minlength=1 << width), np.bincount(vb, minlength=1 << width)
            held = np.flatnonzero(na)
            met = sum(nb[held ^ d] for d in ball)
            cost += len(held) * PER_BUCKET + int((met * (na[held] + 5)).sum()) // (1 + same)
            at_b.append((va, vb, nb))
        if cost < whole:
            yield from _banded(a, b, same, share, shares, bands, at_b, cells)
            return
    b0, b1 = np.ascontiguousarray(b[:, 0]), np.ascontiguousarray(b[:, 1])
    for k in range(share, len(starts), shares):
        i, j = int(starts[k]), int(low[k])
        for x, y in cells.near(a[i : i + 64], b0[j : high[k]], b1[j : high[k]]):
            x, y = x + i, y + j
            keep = x < y if same else slice(None)
            if len(x[keep]):
                yield x[keep], y[keep]


def _banded(a: np.ndarray, b: np.ndarray, same: bool, share: int, shares: int, bands, values, cells: Cells) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Band by band, those of a with a value in the band are compared with those of b whose value is within its limit."""
    def fresh(k: int, held: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        x, y = map(np.concatenate, zip(*held))
        va, vb, _ = values[k]
        keep = (x < y) | (va[x] != vb[y]) if same else np.ones(len(x), bool)
        for (_, _, earlier), (ea, eb, _) in zip(bands[:k], values):  # met by an earlier band
            x, y = x[keep], y[keep]
            keep = np.bitwise_count(ea[x] ^ eb[y]) > int(earlier[-1]).bit_count()
        if len(x := x[keep]):
            y = y[keep]
            yield (np.minimum(x, y), np.maximum(x, y)) if same else (x, y)

    for k, ((_, _, ball), (va, vb, nb)) in enumerate(zip(bands, values)):
        order_a = np.argsort(va.astype(np.uint16) if va.max() < 1 << 16 else va, kind="stable")  # 16 bits are sorted by radix
        order_b = order_a if same else np.argsort(vb.astype(np.uint16) if vb.max() < 1 << 16 else vb, kind="stable")
        first = np.cumsum(nb) - nb
        b0, b1, rows = b[order_b, 0], b[order_b, 1], a[order_a]
        values_a, from_a = np.unique(va[order_a], return_index=True)
        to_a = np.append(from_a[1:], len(a))
        held, met = [], 0
        for i in np.flatnonzero(values_a % shares == share).tolist():
            v, lo, hi = int(values_a[i]), int(from_a[i]), int(to_a[i])
            near = v ^ ball
            if same:  # the other half is met from the other side
                near = near[near >= v]
            n = nb[near]
            ends = np.cumsum(n)
            if not ends[-1]:
                continue
            at = np.repeat(first[near] - ends + n, n)
            at += np.arange(len(at))
            for x, y in cells.near(rows[lo:hi], b0[at], b1[at]):
                held.append((order_a[lo + x], order_b[at[y]]))
                met += len(x)
                if met > 1 << 17:
                    yield from fresh(k, held)
                    held, met = [], 0
        if held:
            yield from fresh(k, held)


def compared(radius: int):
    """From the two tiles of a pair, each fingerprint with a near one: the first of its group, and the documents near it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for same, share, shares, left, right in zip(*[batch.column(c).to_pylist() for c in ("same", "share", "shares")], batch.column("left"), batch.column("right")):
                a = np.frombuffer(left.as_buffer(), "<i8").reshape(-1, 3)
                b = a if same else np.frombuffer(right.as_buffer(), "<i8").reshape(-1, 3)
                both, shift = (a, 0) if same else (np.concatenate([a, b]), len(a))
                links = np.zeros(len(both), np.int64)
                held, n = [], 0
                for x, y in blocks(a[:, :2].view(np.uint64), b[:, :2].view(np.uint64), radius, same, share, shares):
                    np.add.at(links, x, b[y, 2])
                    np.add.at(links, y + shift, a[x, 2])
                    held.append((x, y + shift))
                    n += len(x)
                    if n > 1_000_000:  # no more pairs are kept than a star for each group has
                        root = labels(len(both), *map(np.concatenate, zip(*held)))
                        held, n = [(x := np.flatnonzero(root != np.arange(len(root))), root[x])], 0
                if held:
                    root = labels(len(both), *map(np.concatenate, zip(*held)))
                    at = np.flatnonzero(links)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (both[at, 0], both[at, 1], both[root[at], 0], both[root[at], 1], links[at])], names=["f", "g", "rf", "rg", "links"])

    return run


def tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A tile's fingerprints and how many documents have each, in order of the bit counts, as bytes."""
    for batch in batches:
        for tile, rows in zip(batch.column("tile").to_pylist(), batch.column("rows")):
            v = rows.values
            x = np.column_stack([v.field(c).to_numpy() for c in ("f", "g", "n")]).astype("<i8")
            n = np.bitwise_count(x[:, :2].astype(np.uint64)).sum(1, dtype=np.int32)
            order = np.argsort(n, kind="stable")
            yield pa.RecordBatch.from_arrays([pa.array([tile], pa.int32()), pa.array([int(n.min())], pa.int32()), pa.array([int(n.max())], pa.int32()), pa.array([x[order].tobytes()], pa.binary())], names=["tile", "low", "high", "data"])


def near_edges(distinct: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """From distinct fingerprints (f, g) of n documents each: every f, g near others, with another of its group (rf, rg),
    enough of them to connect it, and the number of documents near it; in parts, to be added up."""
    n = distinct.count()
    tiles = max(1, -(-n // tile_rows))
    pairs = tiles * (tiles + 1) // 2
    shares = max(1, min(-(-LEAST_TASKS // pairs), -(-n // TASK_ROWS)))
    ones = F.bit_count("f") + F.bit_count("g")
    # Tiles of about equal size in order of the bit count: a count's fingerprints are spread over its share of tiles.
    by_count = distinct.groupBy(ones.alias("ones")).count()
    before = F.sum("count").over(Window.orderBy("ones")) - F.col("count")
    share = by_count.select("ones", "count", before.alias("before"))
    slot = F.floor((F.col("before") + F.pmod(F.xxhash64("f", "g"), F.col("count"))) * tiles / max(n, 1)).cast("int")
    placed = distinct.withColumn("ones", ones).join(F.broadcast(share), "ones").select(slot.alias("tile"), "f", "g", "n")
    packed = placed.groupBy("tile").agg(F.collect_list(F.struct("f", "g", "n")).alias("rows")).mapInArrow(tiled, "tile int, low int, high int, data binary")
    packed = stored(packed, "tiles")
    a, b = packed.select(*[F.col(c).alias(f"a_{c}") for c in packed.columns]), packed.select(*[F.col(c).alias(f"b_{c}") for c in packed.columns])
    # All pairs of tiles that pass the count test, each once; there are few tiles, so their numbers are paired first.
    heads = packed.select("tile", "low", "high")
    x, y = heads.toDF("a_tile", "a_low", "a_high"), heads.toDF("b_tile", "b_low", "b_high")
    near = x.join(y, (F.col("a_tile") <= F.col("b_tile")) & (F.col("a_low") <= F.col("b_high") + radius) & (F.col("b_low") <= F.col("a_high") + radius)).select("a_tile", "b_tile")
    joined = near.join(a.select("a_tile", "a_data"), "a_tile").join(b.select("b_tile", "b_data"), "b_tile")
    joined = joined.select("a_tile", "b_tile", (F.col("a_tile") == F.col("b_tile")).alias("same"), F.col("a_data").alias("left"), F.when(F.col("a_tile") == F.col("b_tile"), F.unhex(F.lit(""))).otherwise(F.col("b_data")).alias("right"))
    joined = joined.withColumn("shares", F.lit(shares)).withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    spread = joined.repartition(max(parts(distinct), min(16 * parts(distinct), pairs * shares)), "a_tile", "b_tile", "share")
    return spread.select("same", "share", "shares", "left", "right").mapInArrow(compared(radius), "f bigint, g bigint, rf bigint, rg bigint, links bigint")


def keyed(docs: DataFrame) -> DataFrame:
    return only(docs, doc_id="bigint", text="string").withColumn("key", F.xxhash64("text"))


def prints_of(docs: DataFrame) -> DataFrame:
    """doc_id, key (xxhash64 of the text), f and g of the documents that have a word."""
    return docs.mapInArrow(fingerprinted, "doc_id bigint, key bigint, f bigint, g bigint").where("f is not null").distinct()


def near_rows(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, key, kept_doc_id, kept_key and n_links of every row of prints in a group of two or more, the kept one too."""
    rank = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "key")
    # A fingerprint is its own identity: documents of equal ones are one until the end.
    same = stored(prints.groupBy("f", "g").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n")), "distinct-fingerprints")
    found = stored(near_edges(same.select("f", "g", "n"), radius), "near-fingerprints")
    links = found.groupBy("f", "g").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.struct("f", "g").alias("x"), F.struct(F.col("rf").alias("f"), F.col("rg").alias("g")).alias("y")))
    roots = roots.select("id.f", "id.g", "root")
    rooted = same.join(roots, ["f", "g"], "left").where("root is not null or n > 1").withColumn("root", F.coalesce("root", F.struct("f", "g")))
    kept = rooted.groupBy("root").agg(F.min("first").alias("kept"))
    grouped = rooted.join(kept, "root").join(links, ["f", "g"], "left").select("f", "g", "kept", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return prints.join(grouped, ["f", "g"]).select("doc_id", "key", F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.key").alias("kept_key"), "n_links")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, key (xxhash64 of the text), kept_doc_id, kept_key and n_links of every document in a group of two or more."""
    return near_rows(stored(prints_of(keyed(docs)), "fingerprints"), radius)


def prints_of_originals(docs: DataFrame, originals: DataFrame) -> DataFrame:
    """doc_id and key of the rows of docs (with text, under an id) that are cut from an original, and that one's fingerprint.

    A row is cut from an original of its id if all its lines are among the original's; lines are compared by hash. Of
    several originals the one with the least fingerprint counts.
    """
    hashes = F.transform(F.split("text", "\n", -1), lambda x: F.xxhash64(x))
    lines = keyed(docs).where("doc_id is not null and text is not null").select("doc_id", "key", hashes.alias("lines"))
    whole = keyed(originals).where("doc_id is not null and text is not null")
    held = prints_of(whole).join(whole.select("doc_id", "key", hashes.alias("whole")).dropDuplicates(["doc_id", "key"]), ["doc_id", "key"]).drop("key")
    cut = lines.join(held, "doc_id").where(F.size(F.array_except("lines", "whole")) == 0)
    return cut.groupBy("doc_id", "key").agg(F.min(F.struct("f", "g")).alias("p")).select("doc_id", "key", "p.f", "p.g")


def one_of_each(docs: DataFrame, originals: DataFrame | None = None) -> DataFrame:
    """The documents, with all their columns, of which nothing nearly equal stays; of repeated rows one stays.

    If docs were cut from ``originals``, near copies are found among the originals of what docs has first: two copies of
    which one lost its repeated lines are no longer alike. What stays is then compared as it is.
    """
    of = lambda known: known.where(~(F.col("doc_id").eqNullSafe(F.col("kept_doc_id")) & (F.col("key") == F.col("kept_key")))).select(F.col("doc_id").alias("_d"), F.col("key").alias("_k"))
    match = lambda doc_id, key, other: doc_id.cast("bigint").eqNullSafe(other["_d"]) & (key == other["_k"])
    prints = stored(prints_of(keyed(docs)), "fingerprints")
    if originals is None:
        gone = of(near_rows(prints))
    else:
        before = stored(of(near_rows(stored(prints_of_originals(docs, originals), "fingerprints"))), "gone")
        gone = before.union(of(near_rows(prints.join(before, match(prints["doc_id"], prints["key"], before), "left_anti"))))
    key = F.xxhash64("text")
    kept = docs.join(gone, match(docs["doc_id"], key, gone), "left_anti")
    # Rows whose id and text repeat: only these few are numbered.
    counted = docs.groupBy(F.col("doc_id").cast("bigint").alias("_d"), key.alias("_k")).count().where("count > 1").select("_d", "_k")
    counted = stored(counted, "repeated")
    repeats = match(docs["doc_id"], key, counted)
    others = kept.join(counted, repeats, "left_anti")
    first = Window.partitionBy(F.col("doc_id"), key).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind]))
    nth = "__quillpack_nth"
    once = kept.join(counted, repeats, "left_semi").withColumn(nth, F.row_number().over(first)).where(f"{nth} = 1").drop(nth)
    return others.unionByName(once)


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "kept_doc_id", "n_links").distinct()
