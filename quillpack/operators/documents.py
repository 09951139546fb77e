"""Nodes, outlines, compiled lines and texts of whole documents: each row by itself, in Python, in Arrow batches.

No row is shuffled, sorted or held back: a task's memory is that of a batch and of the longest document, whatever the
table's size, and its time is in proportion to the text it reads.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..config import Settings
from ..functions import document as D

#: Characters read before a batch goes out.
SLICE = 1 << 20
#: Fields of a result: name, Spark's type, Arrow's type.
Fields = tuple[tuple[str, str, pa.DataType], ...]
LINE: Fields = (("line_no", "int", pa.int32()), ("line", "string", pa.string()))
TEXT: Fields = (("compiled", "string", pa.string()), ("n_lines", "bigint", pa.int64()), ("n_tokens", "int", pa.int32()))
SCOPE: Fields = (("node_no", "bigint", pa.int64()), ("level", "int", pa.int32()), ("scope", "string", pa.string()))
NODE: Fields = (
    ("node_no", "bigint", pa.int64()), ("kind", "string", pa.string()), ("level", "int", pa.int32()), ("text", "string", pa.string()), ("depth", "int", pa.int32()), ("ordered", "boolean", pa.bool_()),
    ("key", "string", pa.string()), ("value", "string", pa.string()), ("rows", "array<array<string>>", pa.list_(pa.list_(pa.string()))), ("lang", "string", pa.string()), ("content", "string", pa.string()),
)


def each(docs: DataFrame, made: Callable[[], Callable[[str | None], Iterable[tuple]]], fields: Fields, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key and the rows that a function makes of each text; ``made`` gives that function, once a task."""
    names, kinds = [key, *(n for n, *_ in fields)], [k for *_, k in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = made()
        for batch in batches:
            keys, texts, at, rows, size = batch.column(0), batch.column(1), [], [], 0
            for i in range(len(texts)):
                t = texts[i].as_py()
                before = len(rows)
                rows += f(t)
                at += [i] * (len(rows) - before)
                size += len(t or "")
                if rows and (size > SLICE or i + 1 == len(texts)):
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names=names)
                    at, rows, size = [], [], 0

    schema = ", ".join([f"`{key}` {dict(docs.dtypes)[key]}", *(f"`{n}` {t}" for n, t, _ in fields)])
    return docs.select(key, text).mapInArrow(run, schema)


def nodes(docs: DataFrame) -> DataFrame:
    """doc_id, node_no, kind (heading, paragraph, list_item, table, kv, blank or block) and the fields of that kind."""
    return each(docs, lambda: lambda t: [(i, *x) for i, x in enumerate(D.nodes_of(t))], NODE)


def outline(docs: DataFrame, settings: Settings) -> DataFrame:
    """doc_id, node_no, level and scope of every heading."""
    return each(docs, lambda: lambda t: D.outline(D.nodes_of(t), settings), SCOPE)


def lines(docs: DataFrame, settings: Settings) -> DataFrame:
    """doc_id, line_no and line."""

    def made():
        compiler = D.Compiler(settings)
        return lambda t: enumerate(compiler.lines(t))

    return each(docs, made, LINE)


def texts(docs: DataFrame, settings: Settings) -> DataFrame:
    """doc_id, compiled (every line with a newline after it), n_lines and n_tokens of the documents that say something."""

    def made():
        compiler = D.Compiler(settings)

        def one(t: str | None) -> list[tuple[str, int, int]]:
            said = compiler.lines(t)
            whole = "".join(x + "\n" for x in said)
            return [(whole, len(said), len(whole.split()))] if said else []

        return one

    return each(docs, made, TEXT)
