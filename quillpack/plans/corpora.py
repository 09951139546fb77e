"""Markdown, lines and JSON Schemas made from the star schema, as SQL expressions that Spark and other engines read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NEWLINE = " || chr(10) || "
_KEY = "CAST(p_partkey AS STRING)"
_SIZE = "CAST(p_size AS STRING)"
_YES_NO = "CASE WHEN p_size % 2 = 0 THEN 'No' ELSE 'TRUE' END"

#: One line each: headings, pairs, a rule, links, lists, a paragraph of two lines, a code block, a table, a pair right after it.
PART_LINES = (
    "'# ' || p_brand || ' Line'",
    "''",
    "'## ' || p_type",
    f"'Size: ' || {_SIZE}",
    "'part type: **' || p_type || '**'",
    "'---'",
    f"'unit price: [' || {_KEY} || '](http://shop/' || {_KEY} || ')'",
    "'* ' || p_name || '.'",
    f"'    2. Made in order to last ' || {_SIZE} || ' milliseconds.'",
    "''",
    "'Sold as ~~is~~ ' || p_name || '. Ready'",
    "'  by `' || p_brand || '`'",
    "'```sql'",
    f"'select ' || {_KEY}",
    "'# no heading'",
    "'```'",
    "'| Feature | Available |'",
    "'|---|---|'",
    "'| warranty | yes |'",
    f"'| ' || p_name || ' | ' || {_YES_NO} || ' |'",
    "'after sale: ' || p_type",
    "''",
    "'Last words.  '",
)
PART_TEXT = NEWLINE.join(PART_LINES)
#: Emphasis, code, strikes, an image and a link before a document's own text.
INLINE_TEXT = "'**' || source || '** __' || lang || '__ *' || lang || '* ~~' || source || '~~ `' || lang || '` ![' || lang || '](http://img/' || source || ') [' || source || '](http://x/' || lang || ') ' || replace(text, '*', '')"
PAIR_TEXT = "'Order Status: ' || o_orderstatus || chr(10) || 'order priority:   ' || o_orderpriority || chr(10) || 'http://x' || chr(10) || '9 lives: no'"
LINES = "SELECT o_custkey AS doc_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS line_no, CASE WHEN o_orderkey % 5 = 0 THEN '@' || o_orderstatus WHEN o_orderkey % 7 = 0 THEN '~note' ELSE '-' || o_orderpriority END AS line FROM orders"
JSON = (
    """'{"definitions":{"1.Part":{"type":"object","required":["size"],"properties":{"size":{"type":"number","default":' || """
    + _SIZE
    + """ || ',"description":"The [size](#s) of ' || p_name || ' in order to fit."},"kind":{"const":"' || p_type || '"}}},"""
    + """"Box":{"allOf":[{"$ref":"#/definitions/1.Part"}],"required":["label"],"properties":{"label":{"pattern":"^([B|b][X|x]1|' || p_type || ')$"},"size":{"description":"short"}}},"""
    + """"Word":{"type":"string"}}}'"""
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Short rows over enough tasks for all cores before each becomes a whole document.

    A table of some MB is a single split however many rows it has, and AQE would join small partitions again if their
    number weren't given.
    """
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism), key)


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and text of a Markdown document for each part."""
    return spread(table(spark, sf_dir, "part"), "p_partkey").select(F.col("p_partkey").alias("doc_id"), F.expr(PART_TEXT).alias("text"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and text of a few pairs for each order."""
    return spread(table(spark, sf_dir, "orders"), "o_orderkey").select(F.col("o_orderkey").alias("doc_id"), F.expr(PAIR_TEXT).alias("text"))


def schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """schema_id and json of a JSON Schema for each part."""
    return spread(table(spark, sf_dir, "part"), "p_partkey").select(F.col("p_partkey").alias("schema_id"), F.expr(JSON).alias("json"))


def status_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines for each customer: scopes, remarks and list items in order of the customer's orders."""
    body = LINES.removeprefix("SELECT ").removesuffix(" FROM orders")
    number, rest = "CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS line_no", body.rpartition("line_no, ")[2]
    return table(spark, sf_dir, "orders").selectExpr("o_custkey AS doc_id", number, rest)
