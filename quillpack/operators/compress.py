"""Compression of lines at level 0, as columns. functions/document.py compresses whole documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X


def level0(lines: DataFrame) -> DataFrame:
    """Single spaces, without empty lines and rules. Level 1 is the same again, so it has no pass of its own."""
    made = lines.withColumn("line", F.when(F.col("verbatim"), F.col("line")).otherwise(P.squeeze(F.col("line"))))
    return made.where(F.col("verbatim") | (F.col("line") != "") & ~X.is_rule(F.col("line")))
