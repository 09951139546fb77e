"""Every regular expression in one place, in Java's dialect but with Python's idea of white space and of a dot."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Inside brackets: what str.isspace() holds for, without the newline and with it.
BLANK = r"\t\x0b-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WHITE = r"\n" + BLANK
S = f"[{WHITE}]"
#: The same one by one, for trimming, which needs no regular expression; and all but the space.
WHITE_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
ODD = f"[{WHITE.replace(r'\x1c-\x20', r'\x1c-\x1f')}]"
NOT_S = f"[^{WHITE}]"

THEMATIC = r"^[-*_]{3,}\z"
HEADING = rf"(?s)^(#{{1,6}}){S}+(.+)\z"
BULLET = rf"(?s)^({S}*)([-*+]){S}+(.+)\z"
NUMBERED = rf"(?s)^({S}*)(\p{{Nd}}+)\.{S}+(.+)\z"
KEY_VALUE = rf"(?s)^([A-Za-z][A-Za-z0-9 _-]{{0,63}}){S}*:{S}+(.+)\z"
SENTENCE_END = rf"(?<=[.!?]){S}+(?=[A-Z])"
IDENTIFIER = r"^[A-Za-z._-]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used: an expression is otherwise repeated at each use."""
    return F.transform(F.array(value), body)[0]


def literal(text: str) -> str:
    """A pattern for exactly this text."""
    return "".join("\\" + c if not c.isalnum() and c.isascii() else c for c in text)


def quoted(replacement: str) -> str:
    """A replacement that stands for itself."""
    return replacement.replace("\\", "\\\\").replace("$", "\\$")


def replace(c: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(by))


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(WHITE_CHARS))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(WHITE_CHARS))


def squeeze(c: Column) -> Column:
    """White space as single spaces, none at the ends."""
    return F.trim(replace(c, f"{S}+", " "))


def split_white(c: Column) -> Column:
    """Parts between white space, some perhaps empty; by plain spaces where there is no other."""
    return F.when(c.rlike(ODD), F.split(c, f"{S}+", -1)).otherwise(F.split(c, " ", -1))
