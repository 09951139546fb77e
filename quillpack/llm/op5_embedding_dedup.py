"""5. Embedding near-dedup by lattice hashing.

Each of ``TABLES`` tables projects the unit vectors at random to 16 dimensions and decodes each half to the nearest point
of the E8 lattice; both points make the cell. A vector is indexed in its own cell and probes the ``PROBES`` neighbouring
cells that are next nearest to its projection (each half's minimal vectors, by distance). Every vector is a query; pairs
that meet in any table are verified by their exact cosine, in double precision. Two vectors whose cosine is exactly the
threshold meet in some table with probability 0.99, at 0.97 with 0.999 (measured on random directions; tests hold it).

Equal vectors are one class, never expanded. Cells are counted first, as hashes combined before the shuffle; only
entries of cells where an indexed vector meets another go on, and only these are joined with their vectors. A cell of
more than ``BLOCK`` vectors is cut into blocks, and each pair of blocks is a task's unit of work. What a unit finds is
reduced to a star for each of its groups, so everything that is shuffled is linear in the vectors. Groups are the
connected components; within them links are counted by comparing all vectors of the group, again by pairs of blocks, so
a link counts even where the tables missed it but others connect its ends. Comparing takes time in the square of a group
of different vectors, as the number of its links does.

The result has a row for each id and vector: class_id, the least id in its group, and n_links, the number of other rows
(by id and vector) at the threshold or above. A vector goes if its class_id isn't its id.

Defined results: null vectors, vectors of no or zero length, and those with null, infinite or undefined components match
nothing, not even their equals: they are a class each, without links; vectors of different dimensions don't match; rows
that repeat both id and vector are one; equal vectors under different ids match; an id with different vectors has a row
for each; vectors without an id are left out; an empty table gives no row; other columns aren't looked at. Vectors of
any length are taken, a long one being only slower to compare.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, words
from .common import only, stored, table
from .groups import components, labels

THRESHOLD, TABLES, PROBES, WIDTH, SEED = 0.95, 12, 8, 1.3, 20240229
#: Vectors of a block, and numbers gathered at once when pairs are compared.
BLOCK, GATHERED = 2048, 8_000_000
_NEAR = 6  # neighbours of each half that take part in the probes


@lru_cache(1)
def minimal() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) / 2 for s in product((1, -1), repeat=8) if s.count(-1) % 2 == 0]
    return np.array(out)


def _d8(y: np.ndarray) -> np.ndarray:
    """The nearest point with integer coordinates of even sum."""
    p = np.rint(y)
    odd = np.flatnonzero(p.sum(1) % 2 != 0)
    e = y[odd] - p[odd]
    k = np.abs(e).argmax(1)
    p[odd, k] += np.where(e[np.arange(len(odd)), k] >= 0, 1, -1)
    return p


def nearest(y: np.ndarray) -> np.ndarray:
    """The nearest point of E8: of the points with integer coordinates, or of those with half-integer ones."""
    a, b = _d8(y), _d8(y - 0.5) + 0.5
    return np.where((((y - a) ** 2).sum(1) <= ((y - b) ** 2).sum(1))[:, None], a, b)


def _cell(p: np.ndarray) -> np.ndarray:
    """A hash of lattice points."""
    h = np.zeros(p.shape[:-1], np.uint64)
    for i in range(8):
        h = (h + np.rint(2 * p[..., i]).astype(np.int64).view(np.uint64) + np.uint64(0x51)) * np.uint64(0x9E3779B97F4A7C15)
    return words.mixed(h)


@lru_cache(64)
def projection(t: int, dimension: int) -> np.ndarray:
    return np.random.default_rng([SEED, t, dimension]).standard_normal((dimension, 16)) / WIDTH


def keys(x: np.ndarray, t: int, probes: int = PROBES) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each unit vector in table t, and the cells it probes."""
    y = x @ projection(t, x.shape[1])
    cells, costs = [], []
    for half in (y[:, :8], y[:, 8:]):
        p = nearest(half)
        # |e - v|^2 - |e|^2 = 2 - 2 e.v
        gain = 2 - 2 * ((half - p) @ minimal().T)
        near = np.argpartition(gain, _NEAR, axis=1)[:, :_NEAR]
        cost = np.take_along_axis(gain, near, 1)
        cells.append(np.concatenate([_cell(p)[:, None], _cell(p[:, None, :] + minimal()[near])], 1))
        costs.append(np.concatenate([np.zeros((len(x), 1)), cost], 1))
    both = (costs[0][:, :, None] + costs[1][:, None, :]).reshape(len(x), -1)
    chosen = np.argpartition(both[:, 1:], probes, axis=1)[:, :probes] + 1
    salt = words.mixed(np.full(1, t + 1, np.uint64))
    i, j = np.divmod(chosen, _NEAR + 1)
    join = lambda a, b: words.mixed(a * np.uint64(3) + words.mixed(b + salt))
    return join(cells[0][:, 0], cells[1][:, 0]), join(np.take_along_axis(cells[0], i, 1), np.take_along_axis(cells[1], j, 1))


def flat_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All components of a column of lists, null ones as NaN, and where each list begins (with the end)."""
    size = np.array(column.value_lengths().fill_null(0), np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.concatenate([[0], np.cumsum(size)])


def by_dimension(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of usable vectors of each dimension, and these as unit vectors."""
    flat, bounds = flat_of(column)
    size = np.diff(bounds)
    for d in np.unique(size[size > 0]).tolist():
        rows = np.flatnonzero(size == d)
        x = flat[bpe.ragged(bounds, rows)].reshape(-1, d)
        with np.errstate(invalid="ignore", over="ignore", divide="ignore"):
            x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither overflow nor vanish
            x /= np.sqrt((x * x).sum(1, keepdims=True))
        fine = np.isfinite(x).all(1)
        if fine.any():
            yield rows[fine], x[fine]


def signed(tables: int, probes: int):
    """sig, id, h and own of every index entry (own) and probe."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                ids, h = (part.column(c).to_numpy() for c in ("id", "h"))
                for rows, x in by_dimension(part.column("embedding")):
                    for t in range(tables):
                        cell, others = keys(x, t, probes)
                        of = np.concatenate([rows, np.repeat(rows, others.shape[1])])
                        own = np.arange(len(of)) < len(rows)
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([cell, others.ravel()]).view(np.int64)), pa.array(ids[of]), pa.array(h[of]), pa.array(own)], names=["sig", "id", "h", "own"])

    return run


def gathered(batches: Iterator[pa.RecordBatch], names: list[str], rows: int = 20_000) -> Iterator[pa.Table]:
    """Whole groups of equal ``names``, which arrive in order, some at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < rows:
            continue
        whole = pa.Table.from_batches(held).combine_chunks()
        last = np.ones(whole.num_rows, bool)
        for c in names:
            x = whole[c].to_numpy()
            last &= x == x[-1]
        cut = whole.num_rows - int(last.sum())
        if cut:
            yield whole.slice(0, cut)
        held = whole.slice(cut).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def group_bounds(whole: pa.Table, names: list[str]) -> np.ndarray:
    fresh = np.zeros(whole.num_rows, bool)
    fresh[:1] = True
    for c in names:
        x = whole[c].to_numpy()
        fresh[1:] |= x[1:] != x[:-1]
    return np.append(np.flatnonzero(fresh), whole.num_rows)


def met(x: np.ndarray, y: np.ndarray, unit: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the cosine of each pair of rows is at the threshold at least."""
    out = np.empty(len(x), bool)
    step = max(1, GATHERED // unit.shape[1])
    for at in range(0, len(x), step):
        out[at : at + step] = np.einsum("ij,ij->i", unit[x[at : at + step]], unit[y[at : at + step]]) >= threshold
    return out


_UNIT = ["sig", "i", "j"]


def stars(threshold: float):
    """From the vectors of each pair of blocks of a cell, an edge to the least of its group for every vector linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in gathered(batches, _UNIT):
            bounds = group_bounds(whole, _UNIT)
            group = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            own, side = whole["own"].to_numpy(), whole["b"].to_numpy()
            cross = (whole["i"].to_numpy() != whole["j"].to_numpy())[bounds[:-1]] if whole.num_rows else np.zeros(0, bool)
            ids, h = whole["id"].to_numpy(), whole["h"].to_numpy()
            a, b = [], []
            for rows, unit in by_dimension(whole["embedding"].combine_chunks()):
                number = np.full(whole.num_rows, -1)
                number[rows] = np.arange(len(rows))
                left = rows[own[rows]]
                size = np.diff(bounds)[group[left]]
                work = np.cumsum(size)
                at = 0
                while at < len(left):
                    to = max(at + 1, int(np.searchsorted(work, (work[at - 1] if at else 0) + 2_000_000, "right")))
                    x, y = np.repeat(left[at:to], size[at:to]), bpe.ragged(bounds, group[left[at:to]])
                    # Two indexed vectors once; of two blocks only pairs from both.
                    keep = (number[y] >= 0) & (x != y) & (~own[y] | (x < y)) & (~cross[group[x]] | (side[x] != side[y]))
                    x, y = x[keep], y[keep]
                    near = met(number[x], number[y], unit, threshold)
                    a.append(x[near])
                    b.append(y[near])
                    at = to
            a, b = np.concatenate([*a, np.zeros(0, np.int64)]), np.concatenate([*b, np.zeros(0, np.int64)])
            root = labels(whole.num_rows, a, b)
            x = np.flatnonzero(root != np.arange(len(root)))
            y = root[x]
            edges = np.unique(np.stack([ids[x], h[x], ids[y], h[y]], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(edges[:, k].copy()) for k in range(4)], names=["xi", "xh", "yi", "yh"])

    return run


def counted(threshold: float):
    """Links of every vector with those of the other block, or of its own, by the number of copies of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["ri", "rh", "i", "j"]
        for whole in gathered(batches, names):
            bounds = group_bounds(whole, names)
            n, side, copies = np.zeros(whole.num_rows, np.int64), whole["b"].to_numpy(), whole["copies"].to_numpy()
            where = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            for rows, unit in by_dimension(whole["embedding"].combine_chunks()):
                cuts = np.flatnonzero(np.diff(where[rows])) + 1
                for k in np.split(np.arange(len(rows)), cuts):
                    one, two = (k[side[rows[k]] == s] for s in (side[rows[k]].min(), side[rows[k]].max()))
                    same = len(one) == len(k)
                    near = unit[one] @ unit[two].T >= threshold
                    if same:
                        np.fill_diagonal(near, False)
                        # Where rounding makes a difference between both orders, a link counts for both.
                        near |= near.T
                        if np.unique(whole["i"].to_numpy()[rows[k]] != whole["j"].to_numpy()[rows[k]]).tolist() == [True]:
                            continue  # the other block has no vector of this dimension
                    n[rows[one]] += near @ copies[rows[two]]
                    if not same:
                        n[rows[two]] += near.T @ copies[rows[one]]
            yield pa.RecordBatch.from_arrays([whole["id"].combine_chunks(), whole["h"].combine_chunks(), pa.array(n)], names=["id", "h", "links"])

    return run


def in_blocks(df: DataFrame, n: str, block: int, *of: str) -> DataFrame:
    """Adds b, the block of a row, and i and j: a row for each pair of blocks that the row's own is one of."""
    blocks = F.ceil(F.col(n) / block).cast("int")
    df = df.withColumn("b", F.pmod(F.xxhash64("id", "h"), blocks).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), blocks - 1)))
    df = df.withColumn("i", F.least("b", "o")).withColumn("j", F.greatest("b", "o")).drop("o", n)
    return df.repartition(*of, "i", "j").sortWithinPartitions(*of, "i", "j")


def near_vectors(embeddings: DataFrame, threshold: float = THRESHOLD, tables: int = TABLES, probes: int = PROBES, block: int = BLOCK) -> DataFrame:
    """vec_id, class_id and n_links of every vector."""
    rows = only(embeddings, vec_id="bigint", embedding="array<float>").where("vec_id is not null")
    # A vector's identity has 128 bits; h, one half, tells vectors of one id apart.
    rows = rows.withColumn("h", F.xxhash64("embedding")).withColumn("g", F.xxhash64(F.lit(1), "embedding"))
    members = stored(rows.select("vec_id", "h", "g").distinct(), "vectors")
    firsts = members.groupBy("h", "g").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies"))
    whole = rows.where("size(embedding) > 0").join(firsts.withColumnRenamed("id", "vec_id"), ["h", "g", "vec_id"])
    classes = stored(whole.groupBy("h", "g", F.col("vec_id").alias("id"), "copies").agg(F.first("embedding").alias("embedding")), "vector-classes")

    entries = classes.select("id", "h", "embedding").mapInArrow(signed(tables, probes), "sig bigint, id bigint, h bigint, own boolean")
    cells = stored(entries.groupBy("sig").agg(F.count(F.lit(1)).alias("n"), F.max("own").alias("own")).where("n > 1 and own").select("sig", "n"), "cells")
    found = entries.join(cells, "sig").join(classes.select("id", "h", "embedding"), ["id", "h"])
    edges = in_blocks(found, "n", block, "sig").select(*_UNIT, "b", "own", "id", "h", "embedding").mapInArrow(stars(threshold), "xi bigint, xh bigint, yi bigint, yh bigint")
    node = lambda i, h, name: F.struct(F.col(i).alias("id"), F.col(h).alias("h")).alias(name)
    roots = components(edges.distinct().select(node("xi", "xh", "x"), node("yi", "yh", "y")))
    roots = stored(roots.select("id.id", "id.h", F.col("root.id").alias("ri"), F.col("root.h").alias("rh")), "vector-groups")

    sizes = roots.groupBy("ri", "rh").agg(F.count(F.lit(1)).alias("n"))
    grouped = roots.join(sizes, ["ri", "rh"]).join(classes.select("id", "h", "copies", "embedding"), ["id", "h"])
    links = in_blocks(grouped, "n", block, "ri", "rh").select("ri", "rh", "i", "j", "b", "id", "h", "copies", "embedding").mapInArrow(counted(threshold), "id bigint, h bigint, links bigint")
    links = links.groupBy("id", "h").agg(F.sum("links").alias("links"))

    usable = classes.mapInArrow(_usable, "id bigint, h bigint, g bigint, copies bigint")
    known = usable.join(roots, ["id", "h"], "left").join(links, ["id", "h"], "left")
    known = known.select("h", "g", F.coalesce("ri", "id").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    made = members.join(known, ["h", "g"], "left")
    return made.select("vec_id", F.coalesce("class_id", "vec_id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("n_links"))


def _usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = np.sort(np.concatenate([np.zeros(0, np.int64), *[r for r, _ in by_dimension(batch.column("embedding"))]]))
        yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(rows)) for c in ("id", "h", "g", "copies")], names=["id", "h", "g", "copies"])


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table, and near copies of all its vectors whose number is no multiple of 3: five of those ending in 7."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    turned = "transform(embedding, (x, i) -> CAST(x * (1 + k * 0.02D * ((i % 5) - 2)) AS FLOAT))"
    return rows.union(rows.where("vec_id % 3 <> 0").selectExpr("vec_id", "embedding", "explode(sequence(1, IF(vec_id % 10 = 7, 5, 1))) AS k").selectExpr("vec_id + CAST(k AS BIGINT) * 1000000000 AS vec_id", f"{turned} AS embedding"))


def planted_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator over vectors that do have near copies, whole and joined with themselves."""
    return near_vectors(planted(spark, sf_dir))


_PLANTED = """
  SELECT vec_id, embedding FROM embeddings UNION ALL
  SELECT vec_id + k * 1000000000, list_transform(embedding, lambda x, i: CAST(x * (1 + k * CAST(0.02 AS DOUBLE) * ((i - 1) % 5 - 2)) AS FLOAT)) FROM embeddings, unnest(range(1, 6)) AS u(k) WHERE vec_id % 3 <> 0 AND (k = 1 OR vec_id % 10 = 7)
"""


def _sql(vectors: str) -> str:
    return f"""
WITH RECURSIVE r AS (SELECT DISTINCT vec_id, embedding FROM ({vectors}) WHERE vec_id IS NOT NULL),
v AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM r),
p AS MATERIALIZED (SELECT a.n AS x, b.n AS y FROM v a JOIN v b ON a.n <> b.n AND len(a.e) = len(b.e) AND len(a.e) > 0 WHERE list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
c(n, root) AS (SELECT n, n FROM v UNION SELECT p.y, c.root FROM c JOIN p ON p.x = c.n)
SELECT v.vec_id, min(o.vec_id) AS class_id, (SELECT count(*) FROM p WHERE p.x = v.n) AS n_links FROM v JOIN c USING (n) JOIN v o ON o.n = c.root GROUP BY v.n, v.vec_id
"""


SQL, PLANTED_SQL = _sql("SELECT vec_id, embedding FROM embeddings"), _sql(_PLANTED)
