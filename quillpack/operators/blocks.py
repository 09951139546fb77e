"""Code fences: found in the whole text at once, so that what is inside is never taken for Markdown."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions import document as D
from .documents import Fields, each

BLOCK: Fields = (("lang", "string", pa.string()), ("content", "string", pa.string()))


def normalised(docs: DataFrame) -> DataFrame:
    """doc_id and text: compatibility form, newlines as \\n, no white space at the ends of lines."""
    return each(docs, lambda: lambda t: [(None if t is None else "\n".join(D.normalised(t)),)], (("text", "string", pa.string()),))


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, and either line or, for a code block, lang and content; normalised before or not."""
    rows = lambda t: [(i, None, *x) if isinstance(x, D.Block) else (i, x, None, None) for i, x in enumerate(D.with_blocks(D.normalised(t)))]
    return each(docs, lambda: rows, (("line_no", "int", pa.int32()), ("line", "string", pa.string()), *BLOCK))


def code_blocks(docs: DataFrame) -> DataFrame:
    """doc_id, block_idx, lang and content of every code block; normalised before or not."""
    rows = lambda t: [(i, *x) for i, x in enumerate(x for x in D.with_blocks(D.normalised(t)) if isinstance(x, D.Block))]
    return each(docs, lambda: rows, (("block_idx", "int", pa.int32()), *BLOCK))
