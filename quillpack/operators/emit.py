"""The lines of a run of pairs of keys and values, as columns. functions/document.py has those of whole documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import patterns as P

NOTHING = "array<string>"


def none() -> Column:
    return F.array().cast(NOTHING)


def common_prefix(keys: Column) -> Column:
    """What all keys begin with, up to its last separator; nothing if that is the very beginning.

    The least and the greatest key have in common what all have.
    """
    same = F.zip_with(F.split(F.array_min(keys), ""), F.split(F.array_max(keys), ""), lambda a, b: a.eqNullSafe(b))
    length = P.let(F.array_position(same, False).cast("int"), lambda n: F.when(n > 0, n - 1).otherwise(F.length(F.array_min(keys))))
    return F.when(F.size(keys) < 2, "").otherwise(F.regexp_extract(F.substring(F.array_min(keys), F.lit(1), length), r"^(.+[-_.])", 1))


def extracted_prefix(pairs: Column, settings: Settings) -> Column:
    """The prefix to say once, or nothing."""
    if settings.compression < 1 or not settings.prefix_extraction or settings.min_prefix_pct > 1:
        return F.lit("")
    found = P.let(F.transform(pairs, lambda x: x["k"]), common_prefix)
    return P.let(found, lambda p: F.when((F.size(pairs) >= 3) & (F.length(p) >= settings.min_prefix_len), p).otherwise(""))


def pair_lines(pairs: Column, settings: Settings) -> Column:
    """Attribute lines of a run of pairs, in time linear in the run. Keys and values are parts of lines: they hold no newline."""
    if settings.compression < 1:
        return F.transform(pairs, lambda x: F.concat(F.lit(":"), x["k"], F.lit("="), x["v"]))

    def lines(prefix: Column) -> Column:
        before = lambda i: F.when(i == 0, ":").when(i % settings.max_kv_per_line == 0, "\n:").otherwise(" ")
        said = F.transform(pairs, lambda x, i: F.concat(before(i), F.substring(x["k"], F.length(prefix) + 1, F.length(x["k"])), F.lit("="), x["v"]))
        head = F.when(prefix != "", F.concat(F.lit(":_pfx="), prefix, F.lit("\n"))).otherwise("")
        return F.split(F.concat(head, F.array_join(said, "")), "\n", -1)

    return F.when(F.size(pairs) == 0, none()).otherwise(P.let(extracted_prefix(pairs, settings), lines))
