"""The compiler against a sequential one, line by line, and single cases of each operator."""

import json
import os
import random
import unicodedata

import pytest
from plain_compiler import Compiler, fenced, parsed
from pyspark.sql import functions as F

from quillpack import registry
from quillpack.config import Settings, standard
from quillpack.functions import json_schema
from quillpack.functions import patterns as P
from quillpack.functions import text as X
from quillpack.operators import blocks, emit, finish, parse, schemas
from quillpack.plans.compile import compile_corpus, compile_lines, concatenated, nodes

DATA = os.environ.get("QUILLPACK_TESTDATA", "/root/testdata/sf0.001")

PIECES = [
    "", "", "word", "more words.", "Sold in order to last 10 seconds. Then it is the end...", "---", "***", "a | b", "|---|---|", "| x | y |", "| X | yes |", "| | no |", "|---|---|---|", "| a | b | c |", "| No | TRUE | enabled |",
    "- item", "  1. item of 5 megabytes.", "    * deep **bold** item", "key: value", "rate_limit_a: 1", "rate_limit_b: yes", "rate_limit_c: [l](http://u)", "Key: `code`", "# Top", "## Sub one", "### 漢字", "# Top", "text: ", "--- | ---",
    "```", "```py", "````", "  x = *1*", "# no heading", "![i](u) ~~gone~~ __init__", "ﬁne ① ５ minutes", "> quoted", "→ x", "~meta", "@deco", "<<<", ">>>", ":attr=the second", "-", "e.g.", "a\tb\x0bc", "| `q` | v |", "http://x: y",
]


def random_texts(n):
    rng = random.Random(5)
    return ["\n".join(rng.choices(PIECES, k=rng.randint(1, 14))) for _ in range(n)]


def test_nodes_of_random_lines(documents):
    texts = random_texts(600)
    made = nodes(documents(*enumerate(texts))).orderBy("doc_id", "node_no").collect()
    got = {}
    for r in made:
        what = {"heading": (r.level, r.text), "list_item": (r.depth, r.text), "kv": (r.key, r.value), "table": r.rows, "block": (r.lang, r.content), "blank": None}.get(r.kind, r.text)
        got.setdefault(r.doc_id, []).append(({"list_item": "item"}.get(r.kind, r.kind), what))
    for i, t in enumerate(texts):
        lines = [x.rstrip() for x in unicodedata.normalize("NFKC", t).split("\n")]
        assert got.get(i, []) == list(parsed(fenced(lines))), t


@pytest.mark.parametrize("given", [{}, {"compression": 0}, {"compression": 1, "scope_mode": "concat"}, {"keep_urls": True, "sentence_split": True, "anchor_every": 2, "scope_mode": "stacked"}])
def test_whole_compiler_on_random_lines(documents, given):
    """Random documents from the first step to the last against the sequential compiler."""
    settings, texts = standard().override(**given), random_texts(600)
    got = {r.doc_id: r.compiled for r in compile_corpus(documents(*enumerate(texts)), settings).collect()}
    plain = Compiler(settings)
    for i, t in enumerate(texts):
        want = plain(t)
        assert got.get(i, "") == "".join(x + "\n" for x in want), (t, got.get(i), want)


def test_flagship(spark):
    """compiled_documents and token_savings over the whole table against the sequential compiler."""
    plain, docs = Compiler(standard()), spark.read.parquet(f"{DATA}/documents.parquet").collect()
    want = {r.doc_id: "".join(x + "\n" for x in plain(r.text)) for r in docs}
    made = registry.queries()["compiled_documents"](spark, DATA).collect()
    assert {r.doc_id: (r.compiled, r.n_lines, r.n_tokens) for r in made} == {i: (c, c.count("\n"), len(c.split())) for i, c in want.items() if c}
    savings = {r.lang: (r.tokens_before, r.tokens_after) for r in registry.queries()["token_savings"](spark, DATA).collect()}
    assert savings == {x: (sum(len(r.text.split()) for r in docs if r.lang == x), sum(len(want[r.doc_id].split()) for r in docs if r.lang == x)) for x in {r.lang for r in docs}}


CASES = [
    ("# A b\n\n## C\nword", {"scope_mode": "concat"}, ["@a_b", "@a_b_c", "word"]),
    ("# A\nx one\n# A\nx two", {}, ["@a", "x one", "x two"]),
    ("plain words.\nsame sentence", {}, ["@root", "plain words. sentence"]),
    ("rate_limit_a: 1\nrate_limit_b: 2\nrate_limit_c: 3", {}, ["@root", ":_pfx=rate_limit_", ":a=1 b=2 c=3"]),
    ("a: 1\n\nb: 2", {}, ["@root", ":a=1", ":b=2"]),
    ("a: 1\n---\nb: 2", {}, ["@root", ":a=1 b=2"]),
    ("text\n---", {}, ["@root", "text ---"]),
    ("# 漢字\ntext", {}, ["@root", "text"]),
    ("```\n\n```", {"compression": 0}, ["@root", "::code", "<<<", ">>>"]),
    ("````md\n```\nx\n```\n````", {}, ["@root", "::md", "<<<", "``` x ```", ">>>"]),
    ("```js title\nx\n```", {"compression": 0}, ["@root", "```js title x"]),
    ("| a |\n|---|\n| b |", {}, ["@root", "b"]),
    ("The a an", {}, ["@root", ""]),
    ("", {}, []),
    ("never the end...", {}, ["@root", "never end..."]),
    ("| K | Value |\n|---|---|\n| a b | yes |\n| c | no |", {}, ["@root", ":a_b=Y c=N"]),
    ("| K | X |\n|---|---|\n| 1 | yes |\n| 1 | no |", {}, ["@root", ":_cols=k¦x", "1¦Y", "1¦N"]),
    ("> quoted **bold** [l](http://u)", {"keep_urls": True}, ["@root", "> quoted bold l<http://u>"]),
]


def test_cases(documents):
    """Single documents and what is said of them, compiled together by settings."""
    by: dict = {}
    for i, (text, given, _) in enumerate(CASES):
        by.setdefault(tuple(sorted(given.items())), []).append((i, text))
    said = {}
    for given, rows in by.items():
        said |= {r.doc_id: r.compiled.removesuffix("\n").split("\n") for r in compile_corpus(documents(*rows), standard().override(**dict(given))).collect()}
    for i, (text, _, want) in enumerate(CASES):
        assert said.get(i, []) == want, text


def test_a_document_does_not_depend_on_others_or_partitions(documents):
    rows = [(i, f"# T{i}\n\nkey: {i}\n- item {i}\n```\ncode {i}\n```\nwords") for i in range(30)] + [(99, None), (98, "")]
    whole = {r.doc_id: r.compiled for r in compile_corpus(documents(*rows)).collect()}
    assert {r.doc_id: r.compiled for r in compile_corpus(documents(*rows).repartition(7)).collect()} == whole
    assert {r.doc_id: r.compiled for r in compile_corpus(documents(rows[3])).collect()} == {3: whole[3]}
    assert set(whole) == set(range(30))


def test_empty_table(documents):
    assert compile_lines(documents()).collect() == []


def test_blocks_are_kept_if_asked(documents):
    from dataclasses import replace

    rows = compile_lines(documents((1, "```\n a\n\nb  c\n```")), replace(standard(), preserve_blocks=True)).orderBy("line_no").collect()
    assert [r.line for r in rows] == ["@root", "::code", "<<<", " a", "", "b  c", ">>>"]


def test_unclosed_fences(documents):
    found = lambda t: [(r.lang, r.content) for r in blocks.code_blocks(blocks.normalised(documents((1, t)))).collect()]
    assert found("```py\nx\ny") == [("py", "x\ny")]
    assert found("x\n```") == []
    assert found("~~~\nx\n~~~") == []


def test_long_document(documents):
    """A run of 20,000 pairs, and a table of as many rows."""
    n = 20_000
    rows = ["| Setting | Value |", "|---|---|", *[f"| opt-{i} | v{i} |" for i in range(n)]]
    made = compile_lines(documents((1, "\n".join(f"key_{i}: value {i}" for i in range(n))), (2, "\n".join(rows)))).orderBy("doc_id", "line_no").collect()
    pairs = lambda f: [" ".join(map(f, range(i, i + 4))) for i in range(0, n, 4)]
    assert [r.line for r in made if r.doc_id == 1] == ["@root", *[":" + x for x in pairs(lambda i: f"key_{i}=value {i}")]]
    assert [r.line for r in made if r.doc_id == 2] == ["@root", *[":" + x for x in pairs(lambda i: f"opt-{i}=v{i}")]]


def test_columns(spark):
    one = spark.createDataFrame([("a **b** *c* `d` ~~e~~ __f__ ![i](u) [l](v) ﬁ",)], "t string")
    assert one.select(X.inline(X.nfkc(F.col("t")), standard())).first()[0] == "a b c d e f i l fi"
    names = spark.createDataFrame([(" -Key  (Special)- ",)], "t string")
    assert names.select(X.key_name(F.col("t")), X.scope_name(F.col("t"), 1)).first() == ("key_special", "-Key_Special-")
    keys = spark.createDataFrame([(["rate_limit-a", "rate_limit-b"],), (["a"],), (["ab", "ac"],)], "k array<string>")
    assert [r[0] for r in keys.select(emit.common_prefix(F.col("k"))).collect()] == ["rate_limit-", "", ""]
    rows = spark.createDataFrame([("| a | | b |",), ("|",), ("a|b",)], "t string")
    assert [r[0] for r in rows.select(parse.table_row(F.col("t"))).collect()] == [["a", "", "b"], [], ["a", "b"]]


def test_inert_characters():
    """Each is its own compatibility form, and none joins with another."""
    import re

    inert = [c for c in map(chr, range(0x10000)) if not "\ud800" <= c <= "\udfff" and re.match(f"[{X.INERT}]", c)]
    assert len(inert) > 300 and all(unicodedata.is_normalized("NFKC", c) and not unicodedata.combining(c) for c in inert)
    random.seed(1)
    for _ in range(3000):
        t = "".join(random.choices(inert, k=8))
        assert unicodedata.normalize("NFKC", t) == t


def test_white_space(spark):
    """Trimming, squeezing and splitting as Python's own, for every kind of white space."""
    random.seed(2)
    assert set(P.WHITE_CHARS) == {c for c in map(chr, range(0x110000)) if c.isspace()}
    texts = ["".join(random.choices([*P.WHITE_CHARS, " ", " ", "a", "é", "漢", "B."], k=random.randint(0, 9))) for _ in range(2000)] + ["a b c", "", " "]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", P.strip(F.col("t")), P.rstrip(F.col("t")), P.squeeze(F.col("t")), X.tokens(F.col("t")), X.token_count(F.col("t"))).collect()
    for i, *got in rows:
        assert got == [texts[i].strip(), texts[i].rstrip(), " ".join(texts[i].split()), texts[i].split(), len(texts[i].split())], repr(texts[i])


def test_replacements_are_literal(spark):
    settings = Settings(phrases=(("cost", r"$1\x"),), units=(("second", "$"),))
    row = spark.createDataFrame([("Cost 5 seconds",)], "t string").select(X.units(X.phrases(F.col("t"), settings), settings)).first()
    assert row[0] == r"$1\x 5$s"


def test_settings(tmp_path):
    path = tmp_path / "s.json"
    path.write_text(json.dumps({"compression": 1, "stopwords": ["The"], "phrase_map": {"b": "c"}, "unknown": 1}))
    held = Settings.load(path)
    assert (held.compression, held.stopwords, held.phrases) == (1, {"the"}, (("b", "c"),))
    assert held.override(keep_urls=True, compression=2).keep_urls and not held.keep_urls
    for wrong in ({"compression": 3}, {"scope_mode": "deep"}, {"max_kv_per_line": 0}, {"anchor_every": -1}):
        with pytest.raises(ValueError):
            Settings.of(wrong)


def test_files(spark, tmp_path, capsys):
    from quillpack.__main__ import main
    from quillpack.sources.files import read_markdown, read_schemas, write_texts

    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.md").write_text("# One\nfirst")
    (tmp_path / "in" / "deep" / "b.MARKDOWN").write_text("second")
    (tmp_path / "in" / "c.txt").write_text("never")
    files = read_markdown(spark, str(tmp_path / "in"), str(tmp_path / "missing"))
    assert files.count() == 2 and read_markdown(spark, str(tmp_path / "in"), endings=("txt",)).count() == 1
    joined = concatenated(files.withColumnRenamed("doc_id", "path")).first().text
    assert joined == "# One\nfirst\nsecond"
    write_texts(compile_corpus(files), str(tmp_path / "out"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ["@one", "@root", "first", "second"]
    assert main(["compile", str(tmp_path / "in"), "-o", str(tmp_path / "again"), "-c", "1"]) == 0
    assert [r.value for r in spark.read.text(str(tmp_path / "again")).collect()] == ["@One", "first second"]
    assert main(["compile", str(tmp_path / "in"), "-o", str(tmp_path / "one.txt")]) == 0
    assert (tmp_path / "one.txt").read_text() == "@one\nfirst second\n" and not (tmp_path / "one.txt.parts").exists()
    assert main(["compile", str(tmp_path / "in"), "--separate", "-o", str(tmp_path / "one.txt")]) == 0
    assert (tmp_path / "one.txt").read_text() == "@one\nfirst\n@root\nsecond\n"
    (tmp_path / "in" / "s.json").write_text('{"definitions": {"A": {"properties": {"b": {"type": "string"}}}}}')
    assert read_schemas(spark, str(tmp_path / "in")).count() == 1
    (tmp_path / "in" / "bad.json").write_text("{")
    capsys.readouterr()
    assert main(["schema", str(tmp_path / "in"), "-o", str(tmp_path / "schemas.txt")]) == 0
    assert ":A.properties=b" in (tmp_path / "schemas.txt").read_text()
    said = capsys.readouterr().err
    assert "bad.json isn't JSON" in said and "s.json isn't" not in said


def test_stream(spark, tmp_path):
    from quillpack.streaming.compile import compile_stream, markdown_stream, to_parquet

    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.md").write_text(f"# S{i}\nwords")
    run = compile_stream(markdown_stream(spark, str(tmp_path / "in"), 2), to_parquet(str(tmp_path / "out")), str(tmp_path / "at")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert sorted(r.compiled for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [f"@s{i}\nwords\n" for i in range(3)]


def test_schema(spark):
    schema = {
        "definitions": {
            "1.Node": {"properties": {"next": {"$ref": "#/definitions/1.Node"}, "kind": {"oneOf": [{"const": "a"}, {"type": "number"}]}}, "required": ["kind"]},
            "Loop": {"allOf": [{"$ref": "#/definitions/Loop"}, {"$ref": "#/definitions/1.Node"}]},
            "Plain": {"type": "string"},
        }
    }
    made = schemas.schema_texts(spark.createDataFrame([(1, json.dumps(schema)), (2, None)], "schema_id bigint, json string")).collect()
    got = {r.schema_id: r.compiled.split("\n") for r in made}
    assert got[1][2:4] == [":Node.properties=next, kind!", ":Loop.properties=next, kind!"]
    assert len(got[2]) == 4
    assert json_schema.pattern_values("^([A|a][B|b]12|plain|x(y|z))$") == ["AB12", "plain"]
    assert json_schema.top_level("a|(b|c)|[d|e]|") == ["a", "(b|c)", "[d|e]"]
    assert not json_schema.balanced(")(")


ODD_SCHEMAS = [
    "", "null", "[1]", "{", "3", '{"definitions": 3}', '{"definitions": {"A": true, "B": null, "C": {"properties": 3, "required": true, "allOf": {"x": 1}}}}',
    '{"definitions": {"A": {"properties": {"p": true, "q": {"oneOf": [true, {"type": ["a", "b"]}]}, "r": {"$ref": 3}, "s": {"pattern": 3, "description": 4}, "t": {"type": "array", "items": {"$ref": null}}}, "required": [1, "p"], "anyOf": [true, null]}}}',
    '{"definitions": {"A": {"type": ["object", "null"], "properties": {}}}}', "[" * 100_000,
]


def test_odd_schemas(spark):
    """Malformed schemas, and keywords of a wrong kind, have a defined result and stop nothing."""
    rows = spark.createDataFrame([*enumerate(ODD_SCHEMAS), (99, None)], "schema_id int, json string")
    made = {(r.schema_id, r.definition, r.name): (r.required, r.type, r.description) for r in schemas.properties(schemas.objects(rows)).collect()}
    assert made == {(7, "A", "p"): (True, "any", ""), (7, "A", "q"): (False, "['a', 'b']", ""), (7, "A", "r"): (False, "string", ""), (7, "A", "s"): (False, "any", ""), (7, "A", "t"): (False, "array of any", "")}
    assert {(r.schema_id, r.definition) for r in schemas.objects(rows).collect()} == {(6, "C"), (7, "A"), (8, "A")}
    assert {r.schema_id for r in schemas.unreadable(rows).collect()} == {0, 3, 9}
    assert schemas.schema_texts(rows).count() == len(ODD_SCHEMAS) + 1


def test_violations(spark):
    lines = spark.createDataFrame([(1, 0, "early"), (1, 1, "<<<"), (1, 2, "@x"), (1, 3, ">>>"), (1, 4, "late"), (1, 5, "@s"), (1, 6, "fine")], "doc_id bigint, line_no int, line string")
    assert [r.line_no for r in finish.violations(lines).orderBy("line_no").collect()] == [0, 4]
