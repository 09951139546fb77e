"""Compiling streams: documents are compiled whole, so each micro-batch is compiled by the same plan as a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..config import Settings
from ..plans.compile import compile_corpus
from ..sources.files import ENDINGS, pattern


def markdown_stream(spark: SparkSession, path: str, per_batch: int = 1000, endings: tuple[str, ...] = ENDINGS) -> DataFrame:
    """New Markdown files below a folder as they appear: doc_id (the file's path) and text."""
    read = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern(endings)).option("maxFilesPerTrigger", per_batch)
    return read.load(path).select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))


def to_parquet(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes each batch to a folder of its own number, so that a batch that is run again replaces itself."""
    return lambda compiled, batch: compiled.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def compile_stream(docs: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, settings: Settings | None = None) -> DataStreamWriter:
    """A writer to start: compiles each micro-batch of documents (doc_id, text) and hands it to the sink with its number."""
    return docs.writeStream.foreachBatch(lambda batch, number: sink(compile_corpus(batch, settings), number)).option("checkpointLocation", checkpoint)
