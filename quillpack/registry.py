"""Every query of the library by name, with its SQL where SQL can express it.

Each query runs one operator over whole tables. Operators on structure take Markdown made from the star schema
(plans/corpora.py); their SQL states the result in terms of the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import standard
from .functions import patterns as P
from .functions import text as X
from .operators import blocks, compress, emit, finish, parse, schemas, tables
from .plans import compile as plan
from .plans import corpora as C
from .plans.corpora import table

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

# SQL fragments. RE2 has no idea of Unicode's white space, so it is spelt out.
_W = r"\t\n\x0b\x0c\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_S = f"[{_W}]"
_LINES = "SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no, regexp_replace(l[i], '" + _S + "+$', '') AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), unnest(range(1, len(l) + 1)) AS u(i)"


def _strip(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '^{_S}+', ''), '{_S}+$', '')"


def _squeeze(c: str) -> str:
    return f"trim(regexp_replace({c}, '{_S}+', ' ', 'g'))"


def _words(c: str) -> str:
    return f"list_filter(string_split_regex({c}, '{_S}+'), lambda t: t <> '')"


def _scope(c: str, lower: bool = True) -> str:
    made = f"regexp_replace(regexp_replace({_strip(c)}, '{_S}+', '_', 'g'), '[^A-Za-z0-9_-]', '', 'g')"
    return f"lower({made})" if lower else made


def _key(c: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace(lower({_strip(c)}), '{_S}+', '_', 'g'), '[^a-z0-9_-]', '', 'g'), '^-+|-+$', '', 'g')"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _swap(c: str, pattern: str, by: str) -> str:
    return f"regexp_replace({c}, {_text(pattern)}, {_text(by)}, 'g')"


def _phrased(c: str) -> str:
    for k, v in sorted(standard().phrases, key=lambda p: -len(p[0])):
        c = _swap(c, "(?i)" + P.literal(k), v)
    return c


def _united(c: str) -> str:
    for k, v in sorted(standard().units, key=lambda p: -len(p[0])):
        c = _swap(_swap(c, rf"(?i)(\p{{Nd}}+){_S}+{P.literal(k)}", r"\1" + v), "(?i)" + P.literal(k), v)
    return c


def _stopped(c: str) -> str:
    dropped = ", ".join(_text(w) for w in sorted(standard().stopwords - standard().protect_words))
    return f"array_to_string(list_filter({_words(c)}, lambda t: regexp_replace(lower(t), '[^a-z]', '', 'g') NOT IN ({dropped})), ' ')"


def _unperioded(c: str) -> str:
    return f"CASE WHEN {c} LIKE '%.' AND NOT ({c} LIKE '%...' OR {c} LIKE '%e.g.' OR {c} LIKE '%i.e.' OR {c} LIKE '%etc.') THEN left({c}, length({c}) - 1) ELSE {c} END"


def _of_parts(*lines: str) -> str:
    """The lines that each part's document turns into; null ones aren't there."""
    held = ", ".join(lines)
    return f"SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no, l[i] AS line FROM (SELECT p_partkey AS doc_id, list_filter([{held}], lambda x: x IS NOT NULL) AS l FROM part), unnest(range(1, len(l) + 1)) AS u(i)"


def query(sql: str | None = None):
    def register(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, line_no and line of the documents."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", F.posexplode(X.lines(F.col("text"))).alias("line_no", "line"))


# Texts and lines


@query(f"SELECT doc_id, CAST(len({_words('text')}) AS INTEGER) AS n_tokens FROM documents")
def token_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.token_count(F.col("text")).alias("n_tokens"))


@query("SELECT doc_id, regexp_replace(text || chr(13) || chr(10) || source || chr(13) || lang, '\\r\\n?', chr(10), 'g') AS text FROM documents")
def unix_newlines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.unix_newlines(F.expr("text || chr(13) || chr(10) || source || chr(13) || lang")).alias("text"))


@query()
def compatibility_form(spark, sf_dir):
    """Unicode's compatibility form isn't in SQL."""
    return table(spark, sf_dir, "documents").select("doc_id", X.nfkc(F.concat(F.lit("ﬁ① "), "text")).alias("text"))


@query(_LINES)
def text_lines(spark, sf_dir):
    return _lines(spark, sf_dir)


@query(f"SELECT n_nationkey AS schema_id, {_squeeze('n_name')} AS line, CAST(length(n_name) AS INTEGER) AS n FROM nation")
def squeezed_names(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("schema_id"), P.squeeze(F.col("n_name")).alias("line"), F.length("n_name").alias("n"))


@query("SELECT CAST(0 AS BIGINT) AS doc_id, string_agg('# ' || n_name || chr(10) || 'region: ' || CAST(n_regionkey AS VARCHAR), chr(10) ORDER BY n_name) AS text FROM nation")
def concatenated_files(spark, sf_dir):
    files = table(spark, sf_dir, "nation").select(F.col("n_name").alias("path"), F.expr("'# ' || n_name || chr(10) || 'region: ' || CAST(n_regionkey AS STRING)").alias("text"))
    return plan.concatenated(files)


# Code blocks


@query(f"SELECT p_partkey AS doc_id, CAST(0 AS INTEGER) AS block_idx, 'sql' AS lang, {C.PART_LINES[13]} || chr(10) || '# no heading' AS content FROM part")
def code_blocks(spark, sf_dir):
    return blocks.code_blocks(C.parts(spark, sf_dir))


@query(
    f"SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no, CASE WHEN i <> 13 THEN rtrim(l[i]) END AS line, CASE WHEN i = 13 THEN 'sql' END AS lang FROM (SELECT p_partkey AS doc_id, [{', '.join(x for i, x in enumerate(C.PART_LINES) if i not in (13, 14, 15))}] AS l FROM part), unnest(range(1, len(l) + 1)) AS u(i)"
)
def protected_lines(spark, sf_dir):
    return blocks.lines(C.parts(spark, sf_dir)).select("doc_id", "line_no", "line", "lang")


# Lines to nodes


@query(
    f"""
SELECT doc_id, line_no, kind, kind NOT IN ('text', 'thematic') OR contains(t, '|') AS structural FROM (SELECT *, CASE WHEN t = '' THEN 'blank' WHEN regexp_matches(t, '^[-*_]{{3,}}$') THEN 'thematic'
  WHEN regexp_matches(t, '(?s)^#{{1,6}}{_S}+.+$') THEN 'heading' WHEN regexp_matches(line, '(?s)^{_S}*[-*+]{_S}+.+$') THEN 'bullet' WHEN regexp_matches(line, '(?s)^{_S}*\\p{{Nd}}+\\.{_S}+.+$') THEN 'numbered'
  WHEN regexp_matches(t, '(?s)^[A-Za-z][A-Za-z0-9 _-]{{0,63}}{_S}*:{_S}+.+$') THEN 'kv' ELSE 'text' END AS kind FROM (SELECT *, {_strip("line")} AS t FROM ({_LINES})))
"""
)
def line_kinds(spark, sf_dir):
    return parse.classified(_lines(spark, sf_dir)).select("doc_id", "line_no", "kind", "structural")


@query(
    f"""
SELECT doc_id, line_no, CASE WHEN len(d) > 0 AND d[-1] = '' THEN d[:-2] ELSE d END AS cells
FROM (SELECT doc_id, line_no, CASE WHEN c[1] = '' THEN c[2:] ELSE c END AS d FROM (SELECT doc_id, line_no, list_transform(string_split(line, '|'), lambda x: {_strip("x")}) AS c FROM ({_LINES}) WHERE contains(line, '|')))
"""
)
def table_rows(spark, sf_dir):
    return _lines(spark, sf_dir).where(F.col("line").contains("|")).select("doc_id", "line_no", parse.table_row(F.col("line")).alias("cells"))


_NODES = ("heading", "blank", "heading", "kv", "kv", "kv", "list_item", "list_item", "blank", "paragraph", "block", "table", "kv", "blank", "paragraph")


@query(f"SELECT p_partkey AS doc_id, CAST(i - 1 AS INTEGER) AS node_no, ([{', '.join(map(_text, _NODES))}])[i] AS kind FROM part, unnest(range(1, {len(_NODES) + 1})) AS u(i)")
def node_kinds(spark, sf_dir):
    return plan.nodes(C.parts(spark, sf_dir)).select("doc_id", F.col("node_no").cast("int").alias("node_no"), "kind")


@query("SELECT p_partkey AS doc_id, CAST(1 AS INTEGER) AS level, p_brand || ' Line' AS text FROM part UNION ALL SELECT p_partkey, 2, p_type FROM part")
def headings(spark, sf_dir):
    return plan.nodes(C.parts(spark, sf_dir)).where("kind = 'heading'").select("doc_id", "level", "text")


@query(f"SELECT p_partkey AS doc_id, CAST(0 AS INTEGER) AS depth, false AS ordered, p_name || '.' AS text FROM part UNION ALL SELECT p_partkey, 2, true, 'Made in order to last ' || CAST(p_size AS VARCHAR) || ' milliseconds.' FROM part")
def list_items(spark, sf_dir):
    return plan.nodes(C.parts(spark, sf_dir)).where("kind = 'list_item'").select("doc_id", "depth", "ordered", "text")


@query("SELECT o_orderkey AS doc_id, 'Order Status' AS key, o_orderstatus AS value FROM orders UNION ALL SELECT o_orderkey, 'order priority', o_orderpriority FROM orders")
def key_values(spark, sf_dir):
    return plan.nodes(C.pairs(spark, sf_dir)).where("kind = 'kv'").select("doc_id", "key", "value")


@query("SELECT p_partkey AS doc_id, 'Sold as ~~is~~ ' || p_name || '. Ready by `' || p_brand || '`' AS text FROM part UNION ALL SELECT p_partkey, 'Last words.' FROM part")
def paragraphs(spark, sf_dir):
    return plan.nodes(C.parts(spark, sf_dir)).where("kind = 'paragraph'").select("doc_id", "text")


@query(f"SELECT p_partkey AS doc_id, CAST(i - 1 AS INTEGER) AS row_no, (CASE i WHEN 1 THEN ['Feature', 'Available'] WHEN 2 THEN ['warranty', 'yes'] ELSE [p_name, {C._YES_NO}] END) AS cells FROM part, unnest(range(1, 4)) AS u(i)")
def detected_tables(spark, sf_dir):
    return plan.nodes(C.parts(spark, sf_dir)).where("kind = 'table'").select("doc_id", F.posexplode("rows").alias("row_no", "cells"))


# Inline Markdown and names


def _inline(name: str, made, sql: str):
    def f(spark, sf_dir):
        return table(spark, sf_dir, "documents").select("doc_id", made(F.expr(C.INLINE_TEXT)).alias("text"))

    f.__name__ = f"inline_{name}"
    query(f"SELECT doc_id, {sql} AS text FROM (SELECT doc_id, {C.INLINE_TEXT} AS t FROM documents)")(f)


_BOLD, _UNDER = (lambda c: _swap(c, r"(?s)\*\*(.+?)\*\*", r"\1")), (lambda c: _swap(c, "(?s)__(.+?)__", r"\1"))
_ITALIC, _CODE, _STRIKE = (lambda c: _swap(c, r"\*([^*]+)\*", r"\1")), (lambda c: _swap(c, "`([^`]+)`", r"\1")), (lambda c: _swap(c, "(?s)~~(.+?)~~", r"\1"))
_IMAGE, _LINK = (lambda c, by: _swap(c, r"!\[([^\]]*)\]\(([^)]+)\)", by)), (lambda c, by: _swap(c, r"\[([^\]]*)\]\(([^)]+)\)", by))
_STRIPPED = _STRIKE(_CODE(_ITALIC(_UNDER(_BOLD("t")))))

_inline("bold", X.bold, _BOLD("t"))
_inline("underscore_bold", X.underscore_bold, _UNDER("t"))
_inline("italic", lambda c: X.italic(X.bold(c)), _ITALIC(_BOLD("t")))
_inline("code", X.code_span, _CODE("t"))
_inline("strike", X.strike, _STRIKE("t"))
_inline("image", lambda c: X.image(c, False), _IMAGE("t", r"\1"))
_inline("link_with_url", lambda c: X.link(c, True), _LINK("t", r"\1<\2>"))
_inline("all", lambda c: X.inline(c, standard()), _LINK(_IMAGE(_STRIPPED, r"\1"), r"\1"))
_inline("all_keeping_urls", lambda c: X.inline(c, standard().override(compression=1)), _LINK(_IMAGE(_STRIPPED, r"\1<\2>"), r"\1<\2>"))


@query(
    f"SELECT doc_id, list_filter(string_split({_swap('text', f'([.!?]){_S}+([A-Z])', chr(92) + '1' + chr(1) + chr(92) + '2')}, chr(1)), lambda s: regexp_matches(s, '[^{_W}]')) AS sentences FROM documents"
)
def sentences(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.sentences(F.col("text"), standard().override(sentence_split=True)).alias("sentences"))


@query(f"SELECT p_partkey AS doc_id, {_scope('n')} AS flat, {_scope('n', False)} AS cased FROM (SELECT p_partkey, ' ' || p_brand || ' ' || p_type || chr(9) || '(' || p_name || ')!' AS n FROM part)")
def scope_names(spark, sf_dir):
    name = F.expr("' ' || p_brand || ' ' || p_type || chr(9) || '(' || p_name || ')!'")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), X.scope_name(name, 2).alias("flat"), X.scope_name(name, 1).alias("cased"))


@query(f"SELECT c_custkey AS doc_id, {_key('n')} AS key FROM (SELECT c_custkey, '-' || c_name || '  ' || c_mktsegment || ' (Special)-' AS n FROM customer)")
def key_names(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), X.key_name(F.expr("'-' || c_name || '  ' || c_mktsegment || ' (Special)-'")).alias("key"))


# Scopes


def _outline(mode: str):
    return lambda spark, sf_dir: plan.outline(C.parts(spark, sf_dir), standard().override(scope_mode=mode)).select("doc_id", "level", "scope")


for _mode, _second in (("flat", _scope("p_type")), ("concat", f"{_scope("p_brand || ' Line'")} || '_' || {_scope('p_type')}")):
    _f = _outline(_mode)
    _f.__name__ = f"scopes_{_mode}"
    query(f"SELECT p_partkey AS doc_id, CAST(1 AS INTEGER) AS level, {_scope("p_brand || ' Line'")} AS scope FROM part UNION ALL SELECT p_partkey, 2, {_second} FROM part")(_f)
_f = _outline("stacked")
_f.__name__ = "scopes_stacked"
query(_SQL["scopes_concat"])(_f)


@query("SELECT o_orderkey AS doc_id, CAST(0 AS INTEGER) AS line_no, '@root' AS line FROM orders UNION ALL SELECT o_orderkey, 1, ':order_status=' || o_orderstatus || ' order_priority=' || o_orderpriority FROM orders UNION ALL SELECT o_orderkey, 2, 'http://x 9 lives: no' FROM orders")
def root_scopes(spark, sf_dir):
    return plan.compile_lines(C.pairs(spark, sf_dir), standard().override(compression=1))


# Tables


def _order_rows(spark, sf_dir) -> DataFrame:
    """For each customer the rows of a table of orders: two columns or three, by the customer's number."""
    row = F.when(F.col("o_custkey") % 2 == 0, F.array("o_orderstatus", "o_orderpriority")).otherwise(F.array("o_orderstatus", "o_orderpriority", F.lit("yes")))
    head = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("Status"), F.lit("Priority"))).otherwise(F.array(F.lit("Status"), F.lit("Priority"), F.lit("Open")))
    made = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", row.alias("r")))).alias("all"))
    return made.select("doc_id", F.concat(F.array(head), F.transform("all", lambda x: x["r"])).alias("rows"))


_KIND = "CASE WHEN count(DISTINCT o_orderstatus) < count(*) THEN 'raw' WHEN o_custkey % 2 = 0 THEN 'property' ELSE 'keyed_multi' END"


@query(f"SELECT o_custkey AS doc_id, {_KIND} AS kind FROM orders GROUP BY o_custkey")
def table_kinds(spark, sf_dir):
    return _order_rows(spark, sf_dir).select("doc_id", tables.table_class(F.col("rows")).alias("kind"))


@query(
    f"SELECT doc_id, CASE WHEN kind = 'property' THEN [':_col=priority'] WHEN doc_id % 2 = 0 THEN [':_cols=status¦priority'] ELSE [':_cols=status¦priority¦open'] END AS lines FROM (SELECT o_custkey AS doc_id, {_KIND} AS kind FROM orders GROUP BY o_custkey)"
)
def table_headers(spark, sf_dir):
    return _order_rows(spark, sf_dir).select("doc_id", tables.header_lines(F.col("rows"), tables.table_class(F.col("rows"))).alias("lines"))


@query("SELECT o_custkey AS doc_id, [false, false] || CASE WHEN o_custkey % 2 = 0 THEN [] ELSE [true] END AS flags FROM orders GROUP BY o_custkey")
def boolean_columns(spark, sf_dir):
    return _order_rows(spark, sf_dir).select("doc_id", tables.boolean_columns(F.col("rows"), standard()).alias("flags"))


@query("SELECT l_orderkey, l_linenumber, CASE word WHEN 'Yes' THEN 'Y' WHEN 'FALSE' THEN 'F' WHEN 'enabled' THEN 'Y' ELSE word END AS letter FROM (SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'Yes' WHEN 'R' THEN 'FALSE' WHEN 'N' THEN CASE l_linestatus WHEN 'O' THEN 'enabled' ELSE 'perhaps' END END AS word FROM lineitem)")
def boolean_words(spark, sf_dir):
    word = F.expr("CASE l_returnflag WHEN 'A' THEN 'Yes' WHEN 'R' THEN 'FALSE' WHEN 'N' THEN CASE l_linestatus WHEN 'O' THEN 'enabled' ELSE 'perhaps' END END")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", X.boolean(word).alias("letter"))


_ROW = "o_orderstatus || '¦' || o_orderpriority || CASE WHEN o_custkey % 2 = 0 THEN '' ELSE '¦Y' END"


@query(f"SELECT o_custkey AS doc_id, CASE WHEN {_KIND} = 'raw' THEN list({_ROW} ORDER BY o_orderkey) ELSE [] END AS lines FROM orders GROUP BY o_custkey")
def raw_table_lines(spark, sf_dir):
    rows = _order_rows(spark, sf_dir)
    return rows.select("doc_id", tables.row_lines(F.col("rows"), tables.table_class(F.col("rows")), tables.boolean_columns(F.col("rows"), standard()), standard()).alias("lines"))


@query(
    f"WITH k AS (SELECT o_custkey, {_KIND} AS kind FROM orders GROUP BY o_custkey) SELECT o_custkey AS doc_id, lower(o_orderstatus) AS k, o_orderpriority || CASE WHEN kind = 'property' THEN '' ELSE '¦Y' END AS v FROM orders JOIN k USING (o_custkey) WHERE kind <> 'raw'"
)
def table_pairs(spark, sf_dir):
    rows = _order_rows(spark, sf_dir)
    made = tables.pairs(F.col("rows"), tables.table_class(F.col("rows")), tables.boolean_columns(F.col("rows"), standard()), standard())
    return rows.select("doc_id", F.explode(made).alias("x")).select("doc_id", "x.*")


# Pairs


def _item_pairs(spark, sf_dir) -> DataFrame:
    pair = F.expr("struct('line_item_' || CAST(l_linenumber AS STRING) AS k, l_returnflag || CAST(l_suppkey AS STRING) AS v)")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_sort(F.collect_list(pair)).alias("pairs"))


_SAID = "list(CAST(l_linenumber AS VARCHAR) || '=' || l_returnflag || CAST(l_suppkey AS VARCHAR) ORDER BY CAST(l_linenumber AS VARCHAR), l_returnflag || CAST(l_suppkey AS VARCHAR))"


@query(
    f"""
SELECT doc_id, CASE WHEN len(p) < 3 THEN [] ELSE [':_pfx=line_item_'] END || list_transform(range(0, CAST(ceil(len(p) / 4) AS BIGINT)), lambda i: ':' || array_to_string(list_transform(p[i * 4 + 1 : i * 4 + 4], lambda x: CASE WHEN len(p) < 3 THEN 'line_item_' ELSE '' END || x), ' ')) AS lines
FROM (SELECT l_orderkey AS doc_id, {_SAID} AS p FROM lineitem GROUP BY l_orderkey)
"""
)
def pair_lines(spark, sf_dir):
    return _item_pairs(spark, sf_dir).select("doc_id", emit.pair_lines(F.col("pairs"), standard()).alias("lines"))


@query(f"SELECT doc_id, list_transform(p, lambda x: ':line_item_' || x) AS lines FROM (SELECT l_orderkey AS doc_id, {_SAID} AS p FROM lineitem GROUP BY l_orderkey)")
def single_pair_lines(spark, sf_dir):
    return _item_pairs(spark, sf_dir).select("doc_id", emit.pair_lines(F.col("pairs"), standard().override(compression=0)).alias("lines"))


_NAME = "'n_' || l_returnflag || '_' || l_linestatus || '.' || CAST(l_linenumber AS STRING)"


@query(
    f"SELECT doc_id, CASE WHEN n < 2 THEN '' ELSE regexp_extract(left(a, list_max(list_filter(range(0, length(a) + 1), lambda i: left(a, i) = left(b, i)))), '^(.+[-_.])', 1) END AS prefix FROM (SELECT l_orderkey AS doc_id, count(*) AS n, min({_NAME}) AS a, max({_NAME}) AS b FROM lineitem GROUP BY l_orderkey)"
)
def common_prefixes(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.collect_list(F.expr(_NAME)).alias("keys")).select("doc_id", emit.common_prefix(F.col("keys")).alias("prefix"))


# Compression


@query(f"SELECT doc_id, line_no, line FROM (SELECT doc_id, line_no, {_squeeze('line')} AS line FROM ({_LINES})) WHERE line <> '' AND line <> '>---' AND NOT regexp_matches(line, '^[-*_]{{3,}}$')")
def compression_level0(spark, sf_dir):
    return compress.level0(_lines(spark, sf_dir).withColumn("verbatim", F.lit(False))).select("doc_id", "line_no", "line")


@query(f"SELECT doc_id, line_no FROM ({_LINES}) WHERE line <> '' AND NOT regexp_matches(line, '^(@|:|-|~|<<<|>>>|→|←|=)')")
def plain_text_lines(spark, sf_dir):
    return _lines(spark, sf_dir).where(X.is_text_line(F.col("line"))).select("doc_id", "line_no")


@query(f"SELECT doc_id, line_no, {_phrased('line')} AS line FROM (SELECT doc_id, line_no, line || ' In order to Approximately configure, as well as' AS line FROM ({_LINES}))")
def replaced_phrases(spark, sf_dir):
    lines = _lines(spark, sf_dir).withColumn("line", F.concat("line", F.lit(" In order to Approximately configure, as well as")))
    return lines.select("doc_id", "line_no", X.phrases(F.col("line"), standard()).alias("line"))


@query(f"SELECT doc_id, line_no, {_united('line')} AS line FROM (SELECT doc_id, line_no, line || ' 10 Milliseconds, ' || CAST(doc_id AS VARCHAR) || ' megabytes per minute' AS line FROM ({_LINES}))")
def replaced_units(spark, sf_dir):
    lines = _lines(spark, sf_dir).withColumn("line", F.concat("line", F.lit(" 10 Milliseconds, "), F.col("doc_id").cast("string"), F.lit(" megabytes per minute")))
    return lines.select("doc_id", "line_no", X.units(F.col("line"), standard()).alias("line"))


@query(f"SELECT doc_id, line_no, {_stopped('line')} AS line FROM ({_LINES})")
def without_stopwords(spark, sf_dir):
    return _lines(spark, sf_dir).select("doc_id", "line_no", X.without_stopwords(F.col("line"), standard()).alias("line"))


@query(f"SELECT doc_id, line_no, {_unperioded('line')} AS line FROM ({_LINES})")
def without_periods(spark, sf_dir):
    return _lines(spark, sf_dir).select("doc_id", "line_no", X.without_period(F.col("line")).alias("line"))


# The whole compiler

_TOP, _SUB, _PRICE = _scope("p_brand || ' Line'"), _scope("p_type"), C._KEY
_CASED = [f"'@' || {_scope(x, False)}" for x in ("p_brand || ' Line'", "p_type")]
_FLAG = "CASE WHEN p_size % 2 = 0 THEN 'N' ELSE 'T' END"
_BLOCK = ["'::sql'", "'<<<'", f"'select ' || {C._KEY} || ' # no heading'", "'>>>'"]
_LEVEL2 = [
    f"':size=' || {C._SIZE} || ' part_type=' || p_type || ' unit_price=' || {_PRICE}",
    "'-' || p_name",
    f"'-.. Made last ' || {C._SIZE} || 'ms'",
    "'Sold as ' || p_name || '. Ready ' || p_brand",
    *_BLOCK,
    "':_col=available'",
    f"':warranty=Y ' || {_key('p_name')} || '=' || {_FLAG} || ' after_sale=' || p_type",
    "'Last words'",
]
_LINK1 = f"{_PRICE} || '<http://shop/' || {_PRICE} || '>'"
_TEXT1 = ["'-' || p_name || '.'", f"'-.. Made in order to last ' || {C._SIZE} || ' milliseconds.'", "'Sold as is ' || p_name || '. Ready by ' || p_brand", *_BLOCK, "':_col=available'"]
_LEVEL1 = [f"':size=' || {C._SIZE} || ' part_type=' || p_type || ' unit_price=' || {_LINK1}", *_TEXT1, f"':warranty=yes ' || {_key('p_name')} || '=' || {C._YES_NO} || ' after_sale=' || p_type", "'Last words.'"]
_LEVEL0 = [f"':size=' || {C._SIZE}", "':part_type=' || p_type", f"':unit_price=' || {_LINK1}", *_TEXT1, "':warranty=yes'", f"':' || {_key('p_name')} || '=' || {C._YES_NO}", "':after_sale=' || p_type", "'Last words.'"]
_SPLIT = [x for line in _LEVEL2 for x in (["'Sold as ' || p_name", "'Ready ' || p_brand"] if line.startswith("'Sold") else [line])]
_COMPILED = {
    "level2": ({}, [f"'@' || {_TOP}", f"'@' || {_SUB}", *_LEVEL2]),
    "level1": ({"compression": 1}, [*_CASED, *_LEVEL1]),
    "level0": ({"compression": 0}, [*_CASED, *_LEVEL0]),
    "concat": ({"scope_mode": "concat"}, [f"'@' || {_TOP}", f"'@' || {_TOP} || '_' || {_SUB}", *_LEVEL2]),
    "keeping_urls": ({"keep_urls": True}, [f"'@' || {_TOP}", f"'@' || {_SUB}", f"':size=' || {C._SIZE} || ' part_type=' || p_type || ' unit_price=' || {_LINK1}", *_LEVEL2[1:]]),
    "sentences": ({"sentence_split": True}, [f"'@' || {_TOP}", f"'@' || {_SUB}", *_SPLIT]),
    "anchored": ({"anchor_every": 4}, [f"'@' || {_TOP}", f"'@' || {_SUB}", *[x for i, line in enumerate(_LEVEL2, 1) for x in ([f"'@' || {_SUB}", line] if i % 4 == 0 else [line])]]),
}
for _name, (_given, _said) in _COMPILED.items():

    def _f(spark, sf_dir, given=_given):
        return plan.compile_lines(C.parts(spark, sf_dir), standard().override(**given))

    _f.__name__ = f"compiled_{_name}"
    query(_of_parts(*_said))(_f)


@query(f"SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) || chr(10) AS compiled, count(*) AS n_lines, CAST(sum(len({_words('line')})) AS INTEGER) AS n_tokens FROM ({_of_parts(*_COMPILED['level2'][1])}) GROUP BY doc_id")
def compiled_texts(spark, sf_dir):
    return plan.compile_corpus(C.parts(spark, sf_dir))


@query()
def compiled_documents(spark, sf_dir):
    """The flagship; tests hold it against a sequential compiler."""
    return plan.compile_corpus(table(spark, sf_dir, "documents").where("text is not null"))


@query()
def token_savings(spark, sf_dir):
    """Tokens before and after by language."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    made = plan.compile_corpus(docs).select("doc_id", F.col("n_tokens").alias("after"))
    before = docs.select("doc_id", "lang", X.token_count(F.col("text")).alias("before"))
    return before.join(made, "doc_id", "left").groupBy("lang").agg(F.sum("before").alias("tokens_before"), F.sum("after").alias("tokens_after"))


# Checks and anchors

_SCOPED = f"SELECT *, last_value(CASE WHEN line LIKE '@%' THEN line END IGNORE NULLS) OVER w AS scope, last_value(CASE WHEN line LIKE '@%' THEN line_no END IGNORE NULLS) OVER w AS said FROM ({C.LINES}) WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@query(f"SELECT doc_id, line_no FROM ({_SCOPED}) WHERE scope IS NULL AND line NOT LIKE '~%'")
def unscoped_lines(spark, sf_dir):
    return finish.violations(C.status_lines(spark, sf_dir))


@query(
    f"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_no, sub) - 1 AS INTEGER) AS line_no, line FROM (SELECT doc_id, line_no, 0 AS sub, scope AS line FROM ({_SCOPED}) WHERE line NOT LIKE '@%' AND scope IS NOT NULL AND (line_no - said) % 3 = 0 UNION ALL SELECT doc_id, line_no, 1, line FROM ({_SCOPED}))"
)
def anchored_lines(spark, sf_dir):
    return finish.anchored(C.status_lines(spark, sf_dir), standard().override(anchor_every=3))


@query(f"SELECT doc_id, line_no, CASE left(line, 1) WHEN '@' THEN 'scope' WHEN '~' THEN 'metadata' ELSE 'list' END AS line_type FROM ({C.LINES})")
def line_types(spark, sf_dir):
    return C.status_lines(spark, sf_dir).select("doc_id", "line_no", finish.line_type(F.col("line")).alias("line_type"))


# JSON Schemas

_DESCRIBED = f"'The size of ' || p_name || ' in order to fit. Default: ' || {C._SIZE} || '.'"


@query(
    f"""
SELECT p_partkey AS schema_id, 'Part' AS definition, 'size' AS name, true AS required, 'number' AS type, {_DESCRIBED} AS description FROM part
UNION ALL SELECT p_partkey, 'Part', 'kind', false, 'string', '[' || p_type || ']' FROM part UNION ALL SELECT p_partkey, 'Box', 'size', true, 'any', 'short' FROM part
UNION ALL SELECT p_partkey, 'Box', 'kind', false, 'string', '[' || p_type || ']' FROM part UNION ALL SELECT p_partkey, 'Box', 'label', true, 'any', '[BX1, ' || p_type || ']' FROM part
"""
)
def schema_properties(spark, sf_dir):
    return schemas.properties(schemas.objects(C.schemas(spark, sf_dir))).select("schema_id", "definition", "name", "required", "type", "description")


@query(f"SELECT p_partkey AS schema_id, 'size' AS name, 'number' AS type, {_DESCRIBED} AS description FROM part UNION ALL SELECT p_partkey, 'kind', 'string', '[' || p_type || ']' FROM part UNION ALL SELECT p_partkey, 'label', 'any', '[BX1, ' || p_type || ']' FROM part")
def richest_properties(spark, sf_dir):
    return schemas.richest(schemas.properties(schemas.objects(C.schemas(spark, sf_dir)))).select("schema_id", "name", "type", "description")


@query(
    f"""
SELECT p_partkey AS schema_id, '@Objects.Properties' || chr(10) || 'Required properties marked with `!`.' || chr(10) || ':Part.properties=size!, kind' || chr(10) || ':Box.properties=size!, kind, label!' || chr(10) || '@Properties' || chr(10)
  || '-size (number): size ' || p_name || ' fit. Default: ' || {C._SIZE} || chr(10) || '-kind (string): [' || p_type || ']' || chr(10) || '-label (any): [BX1, ' || p_type || ']' || chr(10) AS compiled FROM part
"""
)
def schema_texts(spark, sf_dir):
    return schemas.schema_texts(C.schemas(spark, sf_dir))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compiled_documents(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
