"""What a line is by itself, as columns. functions/document.py reads lines in their order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P


def kind_of(line: Column, t: Column) -> Column:
    """What a line is by itself; ``t`` is the line without white space at its ends."""
    return (
        F.when(line.isNull(), "block")
        .when(t == "", "blank")
        .when(t.rlike(P.THEMATIC), "thematic")
        .when(t.rlike(P.HEADING), "heading")
        .when(line.rlike(P.BULLET), "bullet")
        .when(line.rlike(P.NUMBERED), "numbered")
        .when(t.contains(":") & t.rlike(P.KEY_VALUE), "kv")
        .otherwise("text")
    )


def classified(lines: DataFrame) -> DataFrame:
    """Adds t, kind and structural: whether the line ends a paragraph before it."""
    t = F.when(F.col("line").rlike(rf"^{P.S}"), P.strip(F.col("line"))).otherwise(F.col("line"))
    made = lines.withColumn("t", t)
    kind = kind_of(F.col("line"), F.col("t"))
    made = made.withColumn("kind", kind)
    return made.withColumn("structural", ~F.col("kind").isin("text", "thematic") | F.coalesce(F.col("t").contains("|"), F.lit(False)))


def table_row(t: Column) -> Column:
    """The cells of a line: one empty cell at each end doesn't count."""
    cells = F.transform(F.split(t, r"\|", -1), P.strip)
    cells = F.when(F.get(cells, F.lit(0)) == "", F.slice(cells, F.lit(2), F.size(cells))).otherwise(cells)
    return F.when((F.size(cells) > 0) & (F.element_at(cells, F.when(F.size(cells) > 0, -1).otherwise(1)) == ""), F.slice(cells, F.lit(1), F.size(cells) - 1)).otherwise(cells)
