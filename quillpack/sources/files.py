"""Files in and out: Markdown and JSON Schema by folder or name, compiled texts and lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Endings of the files that are read, in any case; others can be given, such as that of texts compiled before.
ENDINGS = ("md", "markdown")
FILES = "doc_id string, text string"


def pattern(endings: tuple[str, ...] = ENDINGS) -> str:
    """A file name pattern for these endings in any case; other files aren't even listed."""
    return "*.{" + ",".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e) for e in endings) + "}"


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """The paths that exist; inputs that don't are passed over."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    made = [(p, jvm.org.apache.hadoop.fs.Path(p)) for p in paths]
    return [p for p, path in made if path.getFileSystem(conf).exists(path)]


def read_markdown(spark: SparkSession, *paths: str, endings: tuple[str, ...] = ENDINGS) -> DataFrame:
    """doc_id (the file's path) and text of all Markdown files, folders with all that is below them."""
    found = existing(spark, list(paths))
    if not found:
        return spark.createDataFrame([], FILES)
    read = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern(endings)).text(found, wholetext=True)
    return read.select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))


def read_schemas(spark: SparkSession, *paths: str) -> DataFrame:
    """schema_id (the file's path) and json of all .json files."""
    read = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.[jJ][sS][oO][nN]").text(list(paths), wholetext=True)
    return read.select(F.col("_metadata.file_path").alias("schema_id"), F.col("value").alias("json"))


def write_lines(lines: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Parquet, by range of document so that a document's lines stay together and in order."""
    lines.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "line_no").write.mode(mode).parquet(path)


def write_texts(texts: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Plain text: the compiled texts one after the other. Each ends with a newline already, which the writer adds again itself."""
    texts.select(F.regexp_replace("compiled", "\n\\z", "")).write.mode(mode).text(path)


def write_one(texts: DataFrame, path: str) -> None:
    """One file with the compiled texts in order of their ids. A single task writes it beside, then it gets its name."""
    spark = texts.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    made, beside = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.parts")
    files = made.getFileSystem(conf)
    id_column = texts.columns[0]
    write_texts(texts.repartitionByRange(1, id_column).sortWithinPartitions(id_column), beside.toString(), "overwrite")
    part = next((x.getPath() for x in files.listStatus(beside) if x.getPath().getName().startswith("part-")), None)
    files.delete(made, False)
    if part is None:
        files.create(made).close()
    else:
        files.rename(part, made)
    files.delete(beside, True)
