"""The compiler as one plan: from documents to compiled lines or texts.

One pass over each document, where it is read; nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings, standard
from ..operators import documents


def nodes(docs: DataFrame) -> DataFrame:
    """Nodes of documents (doc_id, text); ids are unique."""
    return documents.nodes(docs)


def outline(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """doc_id, node_no, level and scope of every heading."""
    return documents.outline(docs, settings or standard())


def compile_lines(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """doc_id, line_no and line; a document that says nothing has no lines."""
    return documents.lines(docs, settings or standard())


def compile_corpus(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """doc_id, compiled, n_lines and n_tokens of the documents that say something."""
    return documents.texts(docs, settings or standard())


def concatenated(files: DataFrame) -> DataFrame:
    """All files (path, text) as one document with id 0, in order of path: headings, fences and paragraphs run on from file to file.

    A newline stands before a file if there is any text before it. This is one row by definition, so it takes one task.
    """
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("path", "text"))), lambda x: x["text"])
    first = F.array_position(F.transform(ordered, lambda t: t != ""), True).cast("int")
    joined = F.when(first > 0, F.array_join(F.slice(ordered, F.greatest(first, F.lit(1)), F.size(ordered)), "\n")).otherwise("")
    return files.agg(joined.alias("text")).select(F.lit(0).cast("bigint").alias("doc_id"), "text")
