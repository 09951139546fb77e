"""The training-data pipeline: five stages over ``documents``, each on all that the one before kept.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, with the columns
of documents from all but the last. ``run`` writes each stage's result as Parquet to the shared folder and reads it
again for the next; the last one's stays there until the driver exits. Null text, empty tables and columns that documents doesn't have are passed through as each
operator's docstring defines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillpack.llm import op2_decontamination as decontamination
from quillpack.llm import op6_language_id as language
from quillpack.llm import op7_simhash_dedup as simhash
from quillpack.llm import op9_line_dedup as lines
from quillpack.llm import op10_bpe_codec as codec
from quillpack.llm.common import release, scratch, stored, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go: no text, or text that no language's statistics describe."""
    return language.accepted_rows(docs, language.fit(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that occurred before, or nearly so, are cut out; documents with no other lines go."""
    return lines.without_repeats(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the first document by id stays.

    Line dedup has cut what a copy shares with an earlier document, and what is left of the two is no longer alike. So the
    documents that are left are compared first as they were in documents, then, those that stay, as they are now.
    """
    return simhash.one_of_each(docs, table(spark, sf_dir, "documents"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold most of a benchmark item go."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def bpe_codec(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, checked by decoding."""
    return codec.encode(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("bpe_codec", bpe_codec),
]

#: SQL can express neither the language models nor the fingerprints; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = before = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch(spark):  # a stage's own intermediates go when its result is written
            docs = stored(stage(spark, docs, sf_dir), name, keep=True)
        if hasattr(before, "_quillpack_path"):
            release(before)
        before = docs
    return docs
