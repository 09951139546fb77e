"""JSON Schemas to lines: an inventory of objects, then every property once with its richest description."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings, standard
from ..functions.document import Compiler
from ..functions.json_schema import Schema
from ..functions.text import BOOLEANS
from .documents import each

PROPERTY = pa.struct([("prop_no", pa.int32()), ("name", pa.string()), ("required", pa.bool_()), ("type", pa.string()), ("description", pa.string())])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, number, names, properties = [], [], [], []
        for i, text in enumerate(batch.column("json").to_pylist()):
            for n, name, props in Schema(text).objects() if text else ():
                at.append(i)
                number.append(n)
                names.append(name)
                properties.append([dict(zip(("prop_no", "name", "required", "type", "description"), p)) for p in props])
        yield pa.RecordBatch.from_arrays(
            [batch.column("schema_id").take(pa.array(at, pa.int64())), pa.array(number, pa.int32()), pa.array(names, pa.string()), pa.array(properties, pa.list_(PROPERTY))],
            names=["schema_id", "def_no", "definition", "properties"],
        )


def unreadable(schemas: DataFrame) -> DataFrame:
    """schema_id of the schemas that aren't JSON: they have no definitions, and their text has the fixed lines only."""
    read = F.pandas_udf(lambda texts: texts.map(lambda t: t is not None and not Schema(t).readable).astype(bool), "boolean")
    return schemas.where(read("json")).select("schema_id")


def objects(schemas: DataFrame) -> DataFrame:
    """schema_id, def_no, definition and properties of every object definition of schemas (schema_id, json)."""
    kind = dict(schemas.dtypes)["schema_id"]
    fields = "array<struct<prop_no:int,name:string,required:boolean,type:string,description:string>>"
    return schemas.select("schema_id", "json").mapInArrow(_read, f"schema_id {kind}, def_no int, definition string, properties {fields}")


def properties(objects: DataFrame) -> DataFrame:
    """One row for each property of each object."""
    return objects.select("schema_id", "def_no", "definition", F.explode("properties").alias("p")).select("schema_id", "def_no", "definition", "p.*")


def richest(properties: DataFrame) -> DataFrame:
    """Of each name the type and description where that is longest, the first of equals, and its place in the inventory."""
    place = F.struct("def_no", "prop_no")
    rank = F.struct(F.length("description").alias("n"), (-F.col("def_no")).alias("d"), (-F.col("prop_no")).alias("p"))
    return properties.groupBy("schema_id", "name").agg(F.min(place).alias("place"), F.max_by(F.struct("type", "description"), rank).alias("best")).select("schema_id", "name", "place", "best.*")


def compressed(text: str, compiler: Compiler) -> str:
    """Phrases, units, booleans, stopwords, final full stop and white space of a description."""
    text = compiler.units(compiler.phrases(text))
    if compiler.s.bool_compress:
        text = " ".join(BOOLEANS.get(t.lower(), t) for t in text.split())
    return " ".join(compiler.without_period(compiler.without_stopwords(text)).split())


def schema_lines(text: str | None, compiler: Compiler) -> list[str]:
    """The inventory of objects, then every property in order of its first appearance, with its richest description."""
    found = Schema(text).objects() if text else []
    out = ["@Objects.Properties", "Required properties marked with `!`."]
    best: dict[str, tuple[str, str]] = {}
    for _, name, properties in found:
        out.append(f":{name}.properties=" + ", ".join(p + "!" * required for _, p, required, *_ in properties))
        for _, p, _, kind, description in properties:
            if p not in best or len(description) > len(best[p][1]):
                best[p] = kind, description
    return [*out, "@Properties", *(f"-{p} ({kind}): {compressed(description, compiler)}" for p, (kind, description) in best.items())]


def schema_texts(schemas: DataFrame, settings: Settings | None = None) -> DataFrame:
    """schema_id and compiled; each schema by itself."""
    settings = settings or standard()

    def made():
        compiler = Compiler(settings)
        return lambda t: [("".join(x + "\n" for x in schema_lines(t, compiler)),)]

    return each(schemas, made, (("compiled", "string", pa.string()),), key="schema_id", text="json")
