"""Pipe tables: their kind, their yes/no columns, and the lines and pairs they turn into."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import patterns as P
from ..functions import text as X

BAR = "¦"
PAIR = "struct<k:string,v:string>"


def body(rows: Column) -> Column:
    return F.slice(rows, F.lit(2), F.size(rows))


def table_class(rows: Column) -> Column:
    """property (two columns), keyed_multi (more), or raw where the first column isn't a set of short identifiers or rows differ in length."""
    width = F.size(rows[0])
    first = F.transform(body(rows), lambda r: P.strip(r[0]))
    regular = (F.size(rows) >= 2) & (width >= 2) & F.forall(body(rows), lambda r: F.size(r) == width)
    # Where rows are empty their first cell is null, but then they aren't regular either.
    identifiers = (F.size(F.array_distinct(first)) == F.size(first)) & F.forall(first, lambda v: v.rlike(P.IDENTIFIER) & (X.token_count(v) <= 4))
    return F.when(~regular | ~F.coalesce(identifiers, F.lit(False)), "raw").when(width == 2, "property").otherwise("keyed_multi")


def boolean_columns(rows: Column, settings: Settings) -> Column:
    """For each column, whether every data cell is one of the boolean words; never the first."""
    columns = F.sequence(F.lit(0), F.greatest(F.size(rows[0]) - 1, F.lit(0)))
    if not settings.bool_compress or settings.compression < 2:
        return F.transform(columns, lambda c: F.lit(False))
    all_ = lambda c: F.forall(body(rows), lambda r: X.is_boolean(F.coalesce(F.get(r, c), F.lit(""))))
    return F.transform(columns, lambda c: (c > 0) & (c < F.size(rows[0])) & (F.size(rows) > 1) & all_(c))


def cell(text: Column, index: Column, flags: Column, settings: Settings) -> Column:
    flagged = F.coalesce(F.get(flags, index), F.lit(False))
    return P.let(X.inline(text, settings), lambda plain: F.when(flagged, X.boolean(plain)).otherwise(plain))


def _joined(row: Column, flags: Column, settings: Settings, skip: int = 0) -> Column:
    cells = F.transform(row, lambda c, i: cell(c, i, flags, settings))
    return F.array_join(F.slice(cells, F.lit(1 + skip), F.size(cells)) if skip else cells, BAR)


def header_lines(rows: Column, kind: Column) -> Column:
    """At most one line that names the columns."""
    head = rows[0]
    name = X.key_name(F.get(head, F.lit(1)))
    named = F.when(X.informative(F.get(head, F.lit(1))) & (name != ""), F.array(F.concat(F.lit(":_col="), name))).otherwise(F.array().cast("array<string>"))
    all_names = F.array(F.concat(F.lit(":_cols="), F.array_join(F.transform(head, X.key_name), BAR)))
    return F.when(kind == "property", named).when((kind == "keyed_multi") | (F.size(head) >= 2), all_names).otherwise(F.array().cast("array<string>"))


def row_lines(rows: Column, kind: Column, flags: Column, settings: Settings) -> Column:
    """Rows said at once: all of a raw table, elsewhere those without a key."""
    keyless = F.filter(body(rows), lambda r: X.key_name(r[0]) == "")
    return (
        F.when(kind == "property", F.transform(keyless, lambda r: X.inline(F.concat(r[0], F.lit(BAR), r[1]), settings)))
        .when(kind == "keyed_multi", F.transform(keyless, lambda r: _joined(r, flags, settings)))
        .otherwise(F.transform(body(rows), lambda r: _joined(r, flags, settings)))
    )


def pairs(rows: Column, kind: Column, flags: Column, settings: Settings) -> Column:
    """Key and value of each row that has a key."""
    keyed = F.filter(body(rows), lambda r: X.key_name(r[0]) != "")
    value = lambda r: F.when(kind == "property", cell(r[1], F.lit(1), flags, settings)).otherwise(_joined(r, flags, settings, 1))
    made = F.transform(keyed, lambda r: F.struct(X.key_name(r[0]).alias("k"), value(r).alias("v")))
    return F.when(kind == "raw", F.array().cast(f"array<{PAIR}>")).otherwise(made)
