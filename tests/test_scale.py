"""What lets a query grow: rows spread before they become documents, nothing shuffled after, long documents in linear time."""

import os
import re
import time

import pytest
from plain_compiler import Compiler

from quillpack import registry
from quillpack.config import standard
from quillpack.functions import document
from quillpack.plans import corpora
from quillpack.plans.compile import compile_lines

DATA = os.environ.get("QUILLPACK_TESTDATA", "/root/testdata/sf0.001")
#: Queries on documents made of short rows: these are spread once.
SPREAD = (
    *(f"compiled_{x}" for x in ("level2", "level1", "level0", "concat", "keeping_urls", "sentences", "anchored", "texts")), "detected_tables", "node_kinds", "scopes_flat", "scopes_concat", "scopes_stacked", "headings", "paragraphs", "list_items",
    "code_blocks", "protected_lines", "root_scopes", "key_values", "schema_texts", "schema_properties",
)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", SPREAD)
def test_one_exchange_of_rows(spark, name):
    """Not one task for a small file, and no window, sort or group whose tasks grow with the table."""
    plan = plan_of(registry.queries()[name](spark, DATA))
    exchanges = re.findall(r"Exchange [^\n]*", plan)
    assert len(exchanges) == 1 and re.search(r"hashpartitioning\([po]_\w+key#\d+L?, \d+\), REPARTITION_BY_NUM", exchanges[0]), plan
    assert not re.search("Window|Sort|Aggregate", plan)


def test_text_is_made_after_the_exchange(spark):
    """Nothing is made of a row before it is spread: below the exchange there is only the table."""
    below = plan_of(registry.queries()["code_blocks"](spark, DATA)).partition("Exchange")[2].partition("\n")[2]
    assert "concat" not in below and "regexp" not in below and "Python" not in below and "Arrow" not in below


def test_rows_are_spread(spark):
    assert corpora.parts(spark, DATA).rdd.getNumPartitions() >= 3 * spark.sparkContext.defaultParallelism


def test_documents_stay_where_they_are_read(spark):
    plan = plan_of(registry.queries()["compiled_documents"](spark, DATA))
    assert not re.search("Exchange|Window|Sort|Aggregate", plan)


def test_many_fences_and_headings_in_one_document():
    """Each twice as long takes about twice as long; the sequential compiler's result is the same."""
    piece = "# H {0}\n## S {0}\n```\ncode {0}\n````x\n```\n````y\nnever\n```\nk{0}: v\n| a | b |\n|---|---|\n| c{0} | d |\nwords in order to last {0} seconds.\n"
    for given in ({}, {"scope_mode": "concat", "anchor_every": 3}):
        settings = standard().override(**given)
        text = "".join(map(piece.format, range(200)))
        assert document.Compiler(settings).lines(text) == Compiler(settings)(text)
    took = []
    for n in (5_000, 20_000):
        text, began = "".join(map(piece.format, range(n))), time.process_time()
        document.Compiler(standard()).lines(text)
        took.append(time.process_time() - began)
    assert took[1] < 10 * took[0]


def test_batches_of_long_documents(documents):
    """Documents longer than what is read before a batch goes out, and ones that say nothing, beside each other."""
    texts = [f"# T{i}\n" + "word " * (i % 3 * 300_000) + "end" if i % 4 else "" for i in range(12)]
    got = {}
    for r in compile_lines(documents(*enumerate(texts)).coalesce(1)).collect():
        got.setdefault(r.doc_id, []).append((r.line_no, r.line))
    plain = Compiler(standard())
    assert {i: [x for _, x in sorted(v)] for i, v in got.items()} == {i: plain(t) for i, t in enumerate(texts) if t}
