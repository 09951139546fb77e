"""Connected components: of a graph of pairs, as DataFrames, and of pairs in memory, as arrays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, stored


def components(edges: DataFrame) -> DataFrame:
    """id and root (the least id it is connected with) of every id in the edges (x, y), by alternating star contraction.

    Ids may be of any type that has an order, structs too. Least neighbours are aggregates, combined before the shuffle,
    and joined back, so that no task holds all neighbours of a hub. Each round's edges are written to the shared folder
    and the last round's go. A round never lengthens the table, and the number of rounds grows with the logarithm of
    the longest chain. It ends when the number of edges and the exclusive or of their hashes stay as they are.
    """

    def kept(df: DataFrame) -> tuple[DataFrame, tuple]:
        made = stored(df, "edges")
        return made, tuple(made.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("x", "y"))).first())

    edges, mark = kept(edges.where("x <> y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct())
    while True:
        both = edges.union(edges.select("y", "x")).toDF("u", "v")
        least = both.groupBy(F.col("u")).agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("x"), F.col("m").alias("y")).where("x <> y").distinct()
        # Each node with its smaller neighbours; the least of them takes the others.
        first = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(first, "x").where("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y")).union(first.select("x", F.col("m").alias("y"))).distinct()
        new, now = kept(small)
        release(edges)
        if now == mark:
            return new.select(F.col("x").alias("id"), F.col("y").alias("root")).union(new.select("y", "y").distinct())
        edges, mark = new, now


def labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For n nodes with edges a - b, the least node that each is connected with."""
    made = np.arange(n)
    while len(a):
        low = np.minimum(made[a], made[b])
        new = made.copy()
        np.minimum.at(new, made[a], low)
        np.minimum.at(new, made[b], low)
        while (new != (new := new[new])).any():
            pass
        if (new == made).all():
            break
        made = new
    return made
