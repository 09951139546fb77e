"""2. Benchmark decontamination by a prefix-filtered set join.

A document is contaminated by an item if some window of as many words as the item holds at least ``CONTAINMENT`` of the
item's distinct ``SHINGLE``-word shingles. Shingles are ordered by how often the corpus has them, rarest first; to reach
``need = ceil(CONTAINMENT * n)`` of n shingles, a window must hold one of the ``n - need + 1`` rarest, so only these are
joined. Bounds on length (the document has at least ``need`` shingles) and position (the window lies around a rare
shingle) leave few windows, in which containment is counted exactly.

One pass over the texts finds the occurrences of any item's shingle: the items' shingle hashes go to every executor if
they are few enough (``BROADCAST_SHINGLES``), otherwise the texts' shingles are joined with them.

Defined results: null or empty text, and text or items of fewer than ``SHINGLE`` words, match nothing; an item that
repeats counts once for each item_id; repeated document rows give one result row, rows that share an id (or have none)
and differ in text one each; a very long text is searched whole; of windows that hold equally much the first is reported;
an empty table gives no row; other columns aren't looked at. A document or item without an id is reported under a null id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words
from .common import only, stored, table
from .op10_bpe_codec import SLICE_BYTES, slices

SHINGLE, CONTAINMENT, BROADCAST_SHINGLES = 3, 0.6, 4_000_000


def shingles(df: DataFrame, id_column: str, n: int, within: np.ndarray | None = None) -> DataFrame:
    """id, key (xxhash64 of the text), n_shingles, pos and h of every shingle, or of those within the given hashes."""
    shared = None if within is None else df.sparkSession.sparkContext.broadcast(within)
    names = [id_column, "key", "n_shingles", "pos", "h"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = known = None
        if shared is not None:
            known = shared.value
            bits = np.zeros(1 << 24, bool)  # a first sieve, by the upper bits
            bits[known >> np.uint64(40)] = True
        for batch in slices(batches, SLICE_BYTES):
            texts = ["" if t is None else t for t in batch.column("text").to_pylist()]
            w, bounds = words.words_of(texts)
            h = words.shingles_of(w, n)
            whole = np.zeros(len(h), bool)  # shingles within one text
            sizes = np.diff(bounds)
            counts = np.maximum(sizes - n + 1, 0)
            first = np.zeros(len(h) + 1, np.int32)
            a, b = bounds[:-1][counts > 0], (bounds[:-1] + counts)[counts > 0]
            np.add.at(first, a, 1)
            np.add.at(first, b, -1)
            whole = np.cumsum(first[:-1]) > 0
            if bits is not None:
                at = np.flatnonzero(whole & bits[h >> np.uint64(40)])
                k = np.searchsorted(known, h[at])
                at = at[known[np.minimum(k, len(known) - 1)] == h[at]] if len(known) else at[:0]
            else:
                at = np.flatnonzero(whole)
            of = np.searchsorted(bounds, at, "right") - 1
            rows = pa.array(of)
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_column).take(rows), batch.column("key").take(rows), pa.array(counts[of].astype(np.int32)), pa.array((at - bounds[of]).astype(np.int32)), pa.array(h[at].view(np.int64))], names=names
            )

    return df.withColumn("key", F.xxhash64("text")).mapInArrow(run, f"{id_column} bigint, key bigint, n_shingles int, pos int, h bigint")


def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Most distinct shingles in a window of the item's size, and where it begins (the first of equals)."""
    for batch in batches:
        out = {"best": [], "window_start": []}
        for at, span, rare in zip(batch.column("at").to_pylist(), batch.column("span").to_pylist(), batch.column("rare").to_pylist()):
            pairs = sorted((x["pos"], x["h"]) for x in at)
            rare = sorted(rare)
            best, where, j, r, held = 0, 0, 0, 0, {}
            for i, (pos, h) in enumerate(pairs):
                while j < len(pairs) and pairs[j][0] < pos + span:
                    held[pairs[j][1]] = held.get(pairs[j][1], 0) + 1
                    j += 1
                while r < len(rare) and rare[r] < pos:
                    r += 1
                if r < len(rare) and rare[r] < pos + span and len(held) > best:
                    best, where = len(held), pos
                held[h] -= 1
                if not held[h]:
                    del held[h]
            out["best"].append(best)
            out["window_start"].append(where)
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in ("doc_id", "key", "item_id", "item_key", "n")], pa.array(out["best"], pa.int32()), pa.array(out["window_start"], pa.int32())],
            names=["doc_id", "key", "item_id", "item_key", "n", "best", "window_start"],
        )


def contaminated(docs: DataFrame, items: DataFrame, n: int = SHINGLE, containment: float = CONTAINMENT, broadcast_shingles: int = BROADCAST_SHINGLES) -> DataFrame:
    """doc_id, key (xxhash64 of the text), item_id, containment and window_start (in words) of every pair above the threshold."""
    item = shingles(only(items, item_id="bigint", text="string"), "item_id", n).withColumnRenamed("key", "item_key")
    item = stored(item.groupBy("item_id", "item_key", "n_shingles", "h").agg(F.min("pos").alias("pos")), "items")
    few = item.select("h").distinct().limit(broadcast_shingles + 1).count() <= broadcast_shingles
    docs = only(docs, doc_id="bigint", text="string")
    if few:
        known = np.sort(np.array([r.h for r in item.select("h").distinct().toLocalIterator()], np.int64).view(np.uint64))
        hits = shingles(docs, "doc_id", n, known)
    else:
        hits = shingles(docs, "doc_id", n).join(item.select("h").distinct(), "h", "left_semi").select("doc_id", "key", "n_shingles", "pos", "h")
    hits = stored(hits, "hits")

    # The items in order of rarity over all documents; what the corpus lacks is rarest of all.
    frequency = hits.groupBy("h").count()
    sized = item.join(frequency, "h", "left").groupBy("item_id", "item_key", "n_shingles").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("count", F.lit(0)).alias("f"), "h"))).alias("order"))
    need = F.ceil(F.size("order") * F.lit(containment) - 1e-9).cast("int")
    ranked = sized.select("item_id", "item_key", F.col("n_shingles").alias("span"), F.size("order").alias("n"), need.alias("need"), F.posexplode("order").alias("rank", "x"))
    ranked = stored(ranked.select("item_id", "item_key", "span", "n", "need", "rank", F.col("x.h").alias("h")), "ranked")
    prefix = ranked.where("rank <= n - need")

    pair = ["doc_id", "key", "item_id", "item_key"]
    same = lambda a, b, on: [a[c].eqNullSafe(b[c]) for c in on]
    found = hits.join(prefix, "h").where("n_shingles >= need").groupBy(*pair, "span", "n", "need").agg(F.collect_set("pos").alias("rare"))
    found = found.withColumn("doc_id_", F.coalesce("doc_id", F.lit(0))).withColumn("absent", F.col("doc_id").isNull())
    all_hits = hits.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id_"), F.col("doc_id").isNull().alias("absent"), "key", "pos", "h")
    of_item = ranked.select(F.col("item_id").alias("item"), F.col("item_key").alias("ikey"), F.col("h").alias("ih"))
    near = found.join(all_hits, ["doc_id_", "absent", "key"]).where(F.exists("rare", lambda p: F.abs(p - F.col("pos")) < F.col("span")))
    near = near.join(of_item, (near["h"] == of_item["ih"]) & (near["item_key"] == of_item["ikey"]) & near["item_id"].eqNullSafe(of_item["item"]), "left_semi")
    gathered = near.groupBy(*pair, "span", "n", "need").agg(F.collect_set(F.struct("pos", "h")).alias("at"), F.first("rare").alias("rare")).where(F.size("at") >= F.col("need"))
    checked = gathered.select(*pair, "span", "n", "at", "rare").mapInArrow(verify, "doc_id bigint, key bigint, item_id bigint, item_key bigint, n int, best int, window_start int")
    return (
        checked.where(F.col("best") >= F.ceil(F.col("n") * F.lit(containment) - 1e-9))
        .groupBy("doc_id", "key", "item_id")
        .agg(F.max(F.struct((F.col("best") / F.col("n")).alias("c"), (-F.col("window_start")).alias("w"))).alias("m"))
        .select("doc_id", "key", "item_id", F.round("m.c", 6).alias("containment"), (-F.col("m.w")).cast("int").alias("window_start"))
    )


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents, with all their columns, that no item contaminates."""
    bad = contaminated(docs, items).select(F.col("doc_id").alias("_d"), F.col("key").alias("_k")).distinct()
    key = F.xxhash64(docs["text"].cast("string"))
    return docs.join(bad, docs["doc_id"].cast("bigint").eqNullSafe(bad["_d"]) & (key == bad["_k"]), "left_anti")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("key")


SQL = f"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM benchmark),
bs AS (SELECT item_id, len(w) - {SHINGLE - 1} AS span, list_aggregate(w[i : i + {SHINGLE - 1}], 'string_agg', ' ') AS s FROM b, unnest(range(1, len(w) - {SHINGLE - 2})) AS u(i) WHERE len(w) >= {SHINGLE}),
n AS (SELECT item_id, span, count(DISTINCT s) AS n, ceil(count(DISTINCT s) * {CONTAINMENT} - 1e-9) AS need FROM bs GROUP BY ALL),
ds AS (SELECT doc_id, i - 1 AS pos, list_aggregate(w[i : i + {SHINGLE - 1}], 'string_agg', ' ') AS s FROM d, unnest(range(1, len(w) - {SHINGLE - 2})) AS u(i) WHERE len(w) >= {SHINGLE}),
hit AS (SELECT DISTINCT doc_id, item_id, span, pos, s FROM ds JOIN (SELECT DISTINCT item_id, span, s FROM bs) USING (s)),
enough AS (SELECT doc_id, item_id FROM hit JOIN n USING (item_id, span) GROUP BY ALL HAVING count(DISTINCT s) >= any_value(need)),
win AS (SELECT doc_id, item_id, a.span, a.pos, count(DISTINCT z.s) AS best FROM hit a JOIN enough USING (doc_id, item_id) JOIN hit z USING (doc_id, item_id) WHERE z.pos >= a.pos AND z.pos < a.pos + a.span GROUP BY ALL)
SELECT doc_id, item_id, round(max(best / n), 6) AS containment, CAST(arg_min(pos, struct_pack(b := -best, p := pos)) AS INTEGER) AS window_start
FROM win JOIN n USING (item_id, span) WHERE best >= need GROUP BY doc_id, item_id
"""
