"""Checks and anchors on finished lines, and lines put together as texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..config import Settings
from ..functions import text as X


def so_far() -> WindowSpec:
    return Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)


def line_type(line: Column) -> Column:
    made = F.when(line.isin("<<<", ">>>"), "fence").when(line.startswith("::"), "block").when(line.startswith("@"), "scope").when(line.startswith(":"), "attribute")
    return made.when(line.startswith("-"), "list").when(line.startswith("~"), "metadata").when(line.startswith("→") | line.startswith("←") | line.startswith("="), "relation").otherwise("text")


def violations(lines: DataFrame) -> DataFrame:
    """doc_id and line_no of lines outside of code blocks that stand before the first scope; the lines stay as they are."""
    line = F.col("line")
    fence = F.last(F.when(line.isin("<<<", ">>>"), line), ignorenulls=True).over(so_far())
    scoped = F.coalesce(F.max(line.startswith("@") & ~F.coalesce(fence == "<<<", F.lit(False))).over(so_far()), F.lit(False))
    checked = lines.select("doc_id", "line_no", "line", F.coalesce(fence == "<<<", F.lit(False)).alias("inside"), scoped.alias("scoped"))
    return checked.where(~F.col("inside") & ~F.col("scoped") & ~line.isin("<<<", ">>>") & ~line.startswith("~") & (line != "")).select("doc_id", "line_no")


def anchored(lines: DataFrame, settings: Settings) -> DataFrame:
    """The current scope again before every so many-th line since it was said, lines numbered anew."""
    if not settings.anchor_every:
        return lines
    line = F.col("line")
    scope = line.startswith("@")
    made = lines.withColumn("scope", F.last(F.when(scope, line), ignorenulls=True).over(so_far())).withColumn("said_at", F.last(F.when(scope, F.col("line_no")), ignorenulls=True).over(so_far()))
    again = ~scope & F.col("scope").isNotNull() & ((F.col("line_no") - F.col("said_at")) % settings.anchor_every == 0)
    both = made.select("doc_id", "line_no", F.posexplode(F.when(again, F.array("scope", "line")).otherwise(F.array("line"))).alias("sub", "line"))
    order = Window.partitionBy("doc_id").orderBy("line_no", "sub")
    return both.select("doc_id", (F.row_number().over(order) - 1).alias("line_no"), "line")


def texts(lines: DataFrame) -> DataFrame:
    """doc_id, compiled (every line with a newline after it), n_lines and n_tokens."""
    joined = F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n"), F.lit("\n"))
    made = lines.groupBy("doc_id").agg(joined.alias("compiled"), F.count(F.lit(1)).alias("n_lines"))
    return made.withColumn("n_tokens", X.token_count(F.col("compiled")))
