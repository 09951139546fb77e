import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    made = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    made.sparkContext.setLogLevel("ERROR")
    return made


@pytest.fixture
def documents(spark):
    """Makes documents from (doc_id, text) pairs, with columns whose names operators use themselves."""

    def make(*rows):
        held = [(i, t, "en", "s", len(t or ""), 1, 2, "x", 3) for i, t in rows]
        return spark.createDataFrame(held, "doc_id bigint, text string, lang string, source string, n_chars bigint, key bigint, n int, line string, h bigint")

    return make
