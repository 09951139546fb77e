"""Column functions: normalisation, inline Markdown, names, token counts and the dictionary passes."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Settings
from . import patterns as P

BOOLEANS = dict(zip("disabled enabled no yes false true".split(), "NYNYFT"))
GENERIC_HEADERS = tuple("type default notes info details description value".split())
NOT_TEXT = ("@", ":", "-", "~", "<<<", ">>>", "→", "←", "=")


# Normalisation


def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


#: Characters that are their own compatibility form whatever stands beside them: ASCII, most Latin letters, usual punctuation.
INERT = r"\x00-\x7f\xa1-\xa7\xa9\xab-\xac\xae\xb0-\xb1\xb6-\xb7\xbb\xbf-\u0131\u0134-\u013e\u0141-\u0148\u014a-\u017e\u2013-\u2014\u2018-\u201e\u2020-\u2022\u20ac"


def nfkc(c: Column) -> Column:
    """Compatibility normal form. Only texts with other than inert characters go to Python; the others are their own normal form."""
    foreign = F.when(c.rlike(f"[^{INERT}]"), c)
    return F.coalesce(F.pandas_udf(_nfkc, T.StringType())(foreign), c)


def unix_newlines(c: Column) -> Column:
    return P.replace(c, r"\r\n?", "\n")


def lines(c: Column) -> Column:
    """The lines of a text without white space at their ends; a text always has one line at least."""
    return F.transform(F.split(c, "\n", -1), P.rstrip)


def token_count(c: Column) -> Column:
    """Tokens between white space."""
    return F.size(tokens(c))


# Inline Markdown


def bold(c: Column) -> Column:
    return P.replace(c, r"(?s)\*\*(.+?)\*\*", "$1")


def underscore_bold(c: Column) -> Column:
    return P.replace(c, r"(?s)__(.+?)__", "$1")


def italic(c: Column) -> Column:
    return P.replace(c, r"(?s)(?<!\*)\*(?!\*)(.+?)(?<!\*)\*(?!\*)", "$1")


def code_span(c: Column) -> Column:
    return P.replace(c, r"`([^`]+)`", "$1")


def strike(c: Column) -> Column:
    return P.replace(c, r"(?s)~~(.+?)~~", "$1")


def image(c: Column, keep_url: bool) -> Column:
    return P.replace(c, r"!\[([^\]]*)\]\(([^)]+)\)", "$1<$2>" if keep_url else "$1")


def link(c: Column, keep_url: bool) -> Column:
    return P.replace(c, r"\[([^\]]*)\]\(([^)]+)\)", "$1<$2>" if keep_url else "$1")


def strip_inline(c: Column) -> Column:
    return strike(code_span(italic(underscore_bold(bold(c)))))


def keeps_urls(settings: Settings) -> bool:
    return settings.compression < 2 or settings.keep_urls


def inline(c: Column, settings: Settings) -> Column:
    """Emphasis, code, strikes and links without their marks."""
    keep = keeps_urls(settings)
    return link(image(strip_inline(c), keep), keep)


def sentences(c: Column, settings: Settings) -> Column:
    """An array: the sentences if the settings split, else the whole text."""
    if not settings.sentence_split or settings.compression < 2:
        return F.array(c)
    return F.filter(F.split(c, P.SENTENCE_END, -1), lambda s: s.rlike(P.NOT_S))


# Names


def scope_name(c: Column, compression: int) -> Column:
    made = P.replace(P.replace(P.strip(c), f"{P.S}+", "_"), "[^A-Za-z0-9_-]", "")
    return F.lower(made) if compression >= 2 else made


def key_name(c: Column) -> Column:
    made = P.replace(P.replace(F.lower(P.strip(c)), f"{P.S}+", "_"), "[^a-z0-9_-]", "")
    return P.replace(made, r"^-+|-+\z", "")


# Tables


def informative(header: Column) -> Column:
    return (header != "") & ~F.lower(P.strip(header)).isin(*GENERIC_HEADERS)


def is_boolean(cell: Column) -> Column:
    return F.lower(P.strip(cell)).isin(*BOOLEANS)


def boolean(c: Column) -> Column:
    """yes, no, true, false, enabled and disabled as one letter; anything else as it is."""
    letters = F.create_map(*[F.lit(x) for pair in BOOLEANS.items() for x in pair])
    return P.let(c, lambda x: F.coalesce(F.element_at(letters, F.lower(P.strip(x))), x))


# Dictionaries


def is_rule(c: Column) -> Column:
    return c.rlike(P.THEMATIC) | (c == ">---")


def is_text_line(c: Column) -> Column:
    return (c != "") & ~reduce(lambda a, b: a | b, [c.startswith(p) for p in NOT_TEXT])


def _longest_first(pairs) -> list[tuple[str, str]]:
    return sorted(pairs, key=lambda p: -len(p[0]))


def _folded(c: Column) -> Column:
    """Lower case in which every letter that a pattern takes for an ASCII one in either case is that letter."""
    odd = c.contains("ſ") | c.contains("K") | c.contains("İ")
    return F.lower(F.when(odd, F.translate(c, "ſKİ", "ski")).otherwise(c))


def _known(pairs) -> Column:
    """For each phrase: in lower case, as a pattern, its replacement; and as a pattern after a number. One parsed constant: as columns it would be hundreds of calls."""
    text = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    rows = [(k.translate(str.maketrans("ſKİ", "ski")).lower(), "(?iu)" + P.literal(k), P.quoted(v), rf"(?iu)(\p{{Nd}}+){P.S}+{P.literal(k)}") for k, v in _longest_first(pairs)]
    return F.expr("array(" + ", ".join("named_struct(" + ", ".join(f"'{n}', {text(x)}" for n, x in zip("kpvn", row)) + ")" for row in rows) + ")")


def _swapped(c: Column, pairs, by) -> Column:
    """Each phrase in turn, a pattern being applied only where a plain substring test finds the phrase.

    A fold over a constant array: the expression stays as small as one step, however many phrases there are. Most texts
    hold none, and for them the fold isn't begun: a replacement can bring a phrase into being only where one was before.
    """
    if not pairs:
        return c
    held = lambda x: F.struct(x.alias("text"), _folded(x).alias("low"))
    step = lambda made, p: F.when(made["low"].contains(p["k"]), P.let(by(made["text"], p), held)).otherwise(made)
    known = _known(pairs)
    return P.let(held(c), lambda x: F.when(F.exists(known, lambda p: x["low"].contains(p["k"])), F.aggregate(known, x, step)["text"]).otherwise(x["text"]))


def phrases(c: Column, settings: Settings) -> Column:
    """Each phrase anywhere in the text, in any case, by its replacement; the longest first."""
    return _swapped(c, settings.phrases, lambda made, p: F.regexp_replace(made, p["p"], p["v"]))


def units(c: Column, settings: Settings) -> Column:
    """Each unit after a number, then anywhere; the longest first."""
    return _swapped(c, settings.units, lambda made, p: F.regexp_replace(F.regexp_replace(made, p["n"], F.concat(F.lit("$1"), p["v"])), p["p"], p["v"]))


def tokens(c: Column) -> Column:
    return F.filter(P.split_white(c), lambda t: t != "")


def without_stopwords(c: Column, settings: Settings) -> Column:
    """Tokens joined by single spaces, without those whose letters a to z spell a stopword that isn't protected.

    All but letters and white space goes in one pass over the text, whose parts then stand where its tokens do.
    """
    dropped = sorted(settings.stopwords - settings.protect_words)
    if not dropped:
        return F.array_join(tokens(c), " ")

    def by(separator: str, white: str) -> Column:
        letters = F.split(P.replace(F.lower(c), f"[^a-z{white}]+", ""), separator, -1)
        return P.let(letters, lambda keys: F.filter(F.split(c, separator, -1), lambda t, i: (t != "") & ~F.get(keys, i).isin(dropped)))

    return F.array_join(F.when(c.rlike(P.ODD), by(f"{P.S}+", P.WHITE)).otherwise(by(" ", " ")), " ")


def without_period(c: Column) -> Column:
    """One full stop at the end goes, unless it ends an ellipsis or e.g., i.e., etc."""
    ends = c.endswith(".") & ~(c.endswith("...") | c.endswith("e.g.") | c.endswith("i.e.") | c.endswith("etc."))
    return F.when(ends, F.substring(c, F.lit(1), F.length(c) - 1)).otherwise(c)
