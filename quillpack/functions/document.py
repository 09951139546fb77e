"""One document at a time, in plain Python: text to lines, lines to nodes, nodes to compiled lines.

Every function is one pass over its input, so a document takes time in proportion to its length and no other document is
looked at. operators/documents.py runs them over tables. Patterns and dictionary passes stand behind plain substring
tests, for most lines hold no mark and no phrase.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

from ..config import Settings
from .text import BOOLEANS, GENERIC_HEADERS

BAR = "¦"
_FENCE = re.compile(r"(`{3,})(\w*)")
_THEMATIC = re.compile(r"[-*_]{3,}")
_HEADING = re.compile(r"(#{1,6})\s+(.+)", re.DOTALL)
_ITEM = re.compile(r"(\s*)([-*+]|\d+\.)\s+(.+)", re.DOTALL)
_PAIR = re.compile(r"([A-Za-z][A-Za-z0-9 _-]{0,63})\s*:\s+(.+)", re.DOTALL)
_DELIMITER = re.compile(r"\|?[\s:-]+\|")
_IDENTIFIER = re.compile("[A-Za-z._-]")
_BOLD, _UNDER = re.compile(r"\*\*(.+?)\*\*", re.DOTALL), re.compile("__(.+?)__", re.DOTALL)
_ITALIC, _CODE, _STRIKE = re.compile(r"(?<!\*)\*(?!\*)(.+?)(?<!\*)\*(?!\*)", re.DOTALL), re.compile("`([^`]+)`"), re.compile("~~(.+?)~~", re.DOTALL)
_IMAGE, _LINK = re.compile(r"!\[([^\]]*)\]\(([^)]+)\)"), re.compile(r"\[([^\]]*)\]\(([^)]+)\)")
_SENTENCE_END = re.compile(r"(?<=[.!?])\s+(?=[A-Z])")
_SPACES, _NO_SCOPE, _NO_KEY, _NO_LETTER = re.compile(r"\s+"), re.compile("[^A-Za-z0-9_-]"), re.compile("[^a-z0-9_-]"), re.compile("[^a-z]")
_PREFIX = re.compile("(.+[-_.])", re.DOTALL)
#: The letters that count as ASCII ones in either case.
_FOLD = str.maketrans("\u017f\u212a\u0130", "ski")
#: Words whose fate is remembered, at most.
_REMEMBERED = 1 << 16


class Block(NamedTuple):
    lang: str
    content: str


class Node(NamedTuple):
    """kind is heading, paragraph, list_item, table, kv, blank or block; the other fields are those of that kind."""

    kind: str
    level: int | None = None
    text: str | None = None
    depth: int | None = None
    ordered: bool | None = None
    key: str | None = None
    value: str | None = None
    rows: list[list[str]] | None = None
    lang: str | None = None
    content: str | None = None


# Text to lines


def normalised(text: str | None) -> list[str]:
    """The lines of the compatibility form, without white space at their ends; no text is one empty line."""
    text = text or ""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    return [x.rstrip() for x in text.split("\n")]


def with_blocks(rows: list[str]) -> list[str | Block]:
    """Each fence with what it holds as one block; it ends with a line that is the same fence, or with the document."""
    starts = [i for i, x in enumerate(rows) if x.startswith("```") and _FENCE.fullmatch(x)]
    if not starts:
        return rows
    closing: dict[str, list[int]] = {}
    for i in reversed(starts):
        closing.setdefault(rows[i], []).append(i)
    out: list[str | Block] = []
    at = 0
    for i in starts:
        if i < at:
            continue
        out += rows[at:i]
        mark, lang = _FENCE.fullmatch(rows[i]).groups()
        ends = closing.get(mark, [])
        while ends and ends[-1] <= i:
            ends.pop()
        end = ends[-1] if ends else len(rows)
        # A fence that is the last line of all holds nothing and isn't there.
        if i + 1 < len(rows):
            out.append(Block(lang, "\n".join(rows[i + 1 : end])))
        at = end + 1
    return out + rows[at:]


# Lines to nodes


def cells(t: str) -> list[str]:
    """The cells of a line: one empty cell at each end doesn't count."""
    made = [c.strip() for c in t.split("|")]
    if made and not made[0]:
        del made[0]
    if made and not made[-1]:
        del made[-1]
    return made


def _listed(row: str, t: str) -> re.Match | None:
    return _ITEM.fullmatch(row) if t[0] in "-*+" or t[0].isdecimal() else None


def _paired(t: str) -> re.Match | None:
    return _PAIR.fullmatch(t) if ":" in t else None


def _goes_on(row: str | Block) -> bool:
    """Whether a line continues a paragraph before it."""
    if isinstance(row, Block):
        return False
    t = row.strip()
    return bool(t) and "|" not in t and not (t[0] == "#" and _HEADING.fullmatch(t)) and not _listed(row, t) and not _paired(t)


def nodes(rows: list[str | Block]) -> Iterator[Node]:
    at, n = 0, len(rows)
    while at < n:
        row = rows[at]
        at += 1
        if isinstance(row, Block):
            yield Node("block", lang=row.lang, content=row.content)
            continue
        t = row.strip()
        if not t:
            yield Node("blank")
            continue
        if t[0] in "-*_" and _THEMATIC.fullmatch(t):
            continue
        if t[0] == "#" and (m := _HEADING.fullmatch(t)):
            yield Node("heading", level=len(m[1]), text=m[2].strip())
            continue
        if "|" in t and at < n and isinstance(after := rows[at], str) and "---" in after and _DELIMITER.match(after.strip()):
            held = [cells(t)]
            at += 1
            while at < n and isinstance(rows[at], str) and "|" in rows[at]:
                held.append(cells(rows[at].strip()))
                at += 1
            yield Node("table", rows=held)
        elif m := _listed(row, t):
            yield Node("list_item", text=m[3].strip(), depth=len(m[1]) // 2, ordered=m[2] not in "-*+")
        elif m := _paired(t):
            yield Node("kv", key=m[1], value=m[2].strip())
        else:
            held = [t]
            while at < n and _goes_on(rows[at]):
                held.append(rows[at].strip())
                at += 1
            yield Node("paragraph", text=" ".join(held))


def nodes_of(text: str | None) -> Iterator[Node]:
    return nodes(with_blocks(normalised(text)))


# Names


@lru_cache(1 << 12)
def key_name(x: str) -> str:
    return _NO_KEY.sub("", _SPACES.sub("_", x.strip().lower())).strip("-")


def scope_name(x: str, compression: int) -> str:
    made = _NO_SCOPE.sub("", _SPACES.sub("_", x.strip()))
    return made.lower() if compression >= 2 else made


def letter(x: str) -> str:
    """yes, no, true, false, enabled and disabled as one letter; anything else as it is."""
    return BOOLEANS.get(x.strip().lower(), x)


def outline(made: Iterable[Node], settings: Settings) -> Iterator[tuple[int, int, str]]:
    """node_no, level and scope of every heading; the scope may be empty."""
    stack: list[tuple[int, str]] = []
    for i, node in enumerate(made):
        if node.kind == "heading":
            stack = [h for h in stack if h[0] < node.level] + [(node.level, scope_name(node.text, settings.compression))]
            yield i, node.level, stack[-1][1] if settings.scope_mode == "flat" else "_".join(s for _, s in stack)


def common_prefix(keys: list[str]) -> str:
    """What all keys begin with, up to its last separator; nothing if that is the very beginning."""
    if len(keys) < 2:
        return ""
    first, last = min(keys), max(keys)
    n = next((i for i, (a, b) in enumerate(zip(first, last)) if a != b), min(len(first), len(last)))
    m = _PREFIX.match(first[:n])
    return m[1] if m else ""


# Dictionaries


class _Phrases:
    """Replacements one after the other, the longest first; a pattern is applied where a plain test finds its phrase."""

    def __init__(self, pairs, numbered: bool):
        self.known = []
        for k, v in sorted(pairs, key=lambda p: -len(p[0])):
            by = lambda m, v=v: v
            steps = [(re.compile(re.escape(k), re.IGNORECASE), by)]
            if numbered:
                steps.insert(0, (re.compile(r"(\d+)\s+" + re.escape(k), re.IGNORECASE), lambda m, v=v: m[1] + v))
            # A phrase with other than ASCII letters may be met in forms that lower case doesn't bring together.
            self.known.append((k.lower() if k.isascii() else "", steps))

    def held(self, x: str) -> list[str]:
        low = self.low(x)
        return [k for k, _ in self.known if k in low]

    @staticmethod
    def low(x: str) -> str:
        return (x.translate(_FOLD) if not x.isascii() and ("\u017f" in x or "\u212a" in x or "\u0130" in x) else x).lower()

    def __call__(self, x: str) -> str:
        low = self.low(x)
        for k, steps in self.known:
            if k in low:
                for pattern, by in steps:
                    x = pattern.sub(by, x)
                low = self.low(x)
        return x


class _Gone(dict):
    """Whether a word is left out; the words met last are remembered."""

    def __init__(self, dropped: frozenset[str]):
        self.dropped = dropped

    def __missing__(self, w: str) -> bool:
        if len(self) >= _REMEMBERED:
            self.clear()
        gone = _NO_LETTER.sub("", w.lower()) in self.dropped
        if len(w) < 64:
            self[w] = gone
        return gone


class Compiler:
    """Documents to compiled lines, by settings."""

    def __init__(self, settings: Settings):
        self.s = settings
        self.phrases, self.units = _Phrases(settings.phrases, False), _Phrases(settings.units, True)
        self.gone = _Gone(settings.stopwords - settings.protect_words)
        self.by = r"\1<\2>" if settings.compression < 2 or settings.keep_urls else r"\1"
        self.splits = settings.sentence_split and settings.compression >= 2
        self.letters = settings.bool_compress and settings.compression >= 2
        self.prefixes = settings.compression >= 1 and settings.prefix_extraction and settings.min_prefix_pct <= 1

    # Inline Markdown

    def inline(self, x: str) -> str:
        """Emphasis, code, strikes and links without their marks."""
        if "**" in x:
            x = _BOLD.sub(r"\1", x)
        if "__" in x:
            x = _UNDER.sub(r"\1", x)
        if "*" in x:
            x = _ITALIC.sub(r"\1", x)
        if "`" in x:
            x = _CODE.sub(r"\1", x)
        if "~~" in x:
            x = _STRIKE.sub(r"\1", x)
        if "](" in x:
            x = _LINK.sub(self.by, _IMAGE.sub(self.by, x))
        return x

    # Tables and pairs

    def _table(self, rows: list[list[str]], out: list[str], pairs: list[tuple[str, str]]) -> None:
        """The lines of a table, and the pairs of the rows that have a key."""
        head, body = rows[0], rows[1:]
        width = len(head)
        kind = "raw"
        if body and width >= 2 and all(len(r) == width for r in body):
            first = [r[0].strip() for r in body]
            if len(set(first)) == len(first) and all(_IDENTIFIER.match(x) and len(x.split()) <= 4 for x in first):
                kind = "property" if width == 2 else "keyed_multi"
        flags = {c for c in range(1, width) if all((r[c] if c < len(r) else "").strip().lower() in BOOLEANS for r in body)} if self.letters and body else set()
        joined = lambda r, skip=0: BAR.join(letter(self.inline(x)) if c in flags else self.inline(x) for c, x in enumerate(r[skip:], skip))
        if kind == "property":
            name = key_name(head[1])
            if head[1] and head[1].strip().lower() not in GENERIC_HEADERS and name:
                out.append(":_col=" + name)
        elif width >= 2:
            out.append(":_cols=" + BAR.join(map(key_name, head)))
        for r in body:
            key = key_name(r[0]) if kind != "raw" else ""
            if key:
                pairs.append((key, joined(r, 1)))
            else:
                out.append(self.inline(BAR.join(r)) if kind == "property" else joined(r))

    def _pair_lines(self, pairs: list[tuple[str, str]]) -> list[str]:
        if self.s.compression < 1:
            return [f":{k}={v}" for k, v in pairs]
        prefix = common_prefix([k for k, _ in pairs]) if self.prefixes and len(pairs) >= 3 else ""
        if len(prefix) < self.s.min_prefix_len:
            prefix = ""
        said, size = [f"{k[len(prefix):]}={v}" for k, v in pairs], self.s.max_kv_per_line
        lines = [":" + " ".join(said[i : i + size]) for i in range(0, len(said), size)]
        return [f":_pfx={prefix}", *lines] if prefix else lines

    def emitted(self, made: Iterable[Node]) -> tuple[list[str], set[int]]:
        """What is said, line by line, and the places of lines that stay as they are."""
        out: list[str] = []
        verbatim: set[int] = set()
        pairs: list[tuple[str, str]] = []
        stack: list[tuple[int, str]] = []
        scope = ""
        for node in made:
            kind = node.kind
            if pairs and kind != "kv":
                out += self._pair_lines(pairs)
                pairs = []
            if kind == "blank":
                continue
            if kind == "heading":
                own = scope_name(node.text, self.s.compression)
                if self.s.scope_mode != "flat":
                    stack = [h for h in stack if h[0] < node.level] + [(node.level, own)]
                    own = "_".join(s for _, s in stack)
                if own and own != scope:
                    scope = own
                    out.append("@" + own)
                continue
            if not scope:
                scope = "root"
                out.append("@root")
            if kind == "paragraph":
                x = self.inline(node.text)
                out += [t for p in (_SENTENCE_END.split(x) if self.splits else [x]) if (t := p.strip())]
            elif kind == "list_item":
                out.append("-" + "." * node.depth + (" " if node.depth else "") + self.inline(node.text))
            elif kind == "kv":
                pairs.append((key_name(node.key), self.inline(node.value)))
            elif kind == "table":
                self._table(node.rows, out, pairs)
            else:
                out += ["::" + (node.lang or "code"), "<<<"]
                if self.s.preserve_blocks:
                    rows = node.content.split("\n")
                    verbatim.update(range(len(out), len(out) + len(rows)))
                    out += rows
                else:
                    out.append(node.content)
                out.append(">>>")
        return out + self._pair_lines(pairs), verbatim

    # Compression

    def without_stopwords(self, x: str) -> str:
        """Tokens joined by single spaces, without those whose letters a to z spell a stopword that isn't protected."""
        gone = self.gone
        return " ".join([w for w in x.split() if not gone[w]])

    @staticmethod
    def without_period(x: str) -> str:
        return x[:-1] if x.endswith(".") and not x.endswith(("...", "e.g.", "i.e.", "etc.")) else x

    def compressed(self, lines: list[str], verbatim: set[int]) -> list[str]:
        """Single spaces, without empty lines and rules; at level 2 the dictionaries too."""
        held: list[tuple[str, bool]] = []
        for i, x in enumerate(lines):
            if i in verbatim:
                held.append((x, True))
                continue
            x = " ".join(x.split())
            if x and x != ">---" and not (x[0] in "-*_" and _THEMATIC.fullmatch(x)):
                held.append((x, False))
        if self.s.compression < 2:
            return [x for x, _ in held]
        worded = Worded(self, [x for x, _ in held])
        out, inside = [], False
        for x, fixed in held:
            if not fixed and x in ("<<<", ">>>"):
                inside = x == "<<<"
            if fixed or inside or x.startswith(("<<<", ">>>", "::", "@", "~", "→", "←", "=")):
                out.append(x)
            elif x[0] == ":":
                out.append(":" + worded(x[1:]))
            elif x[0] == "-":
                out.append(self.without_period("-" + self.without_stopwords(worded(x[1:]))))
            else:
                out.append(self.without_period(self.without_stopwords(worded(x))))
        return out

    def anchored(self, lines: list[str]) -> list[str]:
        """The current scope again before every so many-th line since it was said."""
        if not self.s.anchor_every:
            return lines
        out, scope, n = [], None, 0
        for x in lines:
            if x.startswith("@"):
                scope, n = x, 0
            else:
                n += 1
                if scope is not None and n % self.s.anchor_every == 0:
                    out.append(scope)
            out.append(x)
        return out

    def lines(self, text: str | None) -> list[str]:
        return self.anchored(self.compressed(*self.emitted(nodes_of(text))))


class Worded:
    """Phrases and units in the lines of one document: those that it doesn't hold anywhere aren't looked for line by line.

    A replacement can bring a phrase into being only where one was before, so a line without any stays as it is.
    """

    def __init__(self, compiler: Compiler, lines: list[str]):
        self.c = compiler
        whole = "\n".join(lines)
        self.phrases, self.units = compiler.phrases.held(whole), compiler.units.held(whole)

    def __call__(self, x: str) -> str:
        low = _Phrases.low(x)
        changed = False
        if any(k in low for k in self.phrases):
            x, changed = self.c.phrases(x), True
        if changed or any(k in low for k in self.units):
            x = self.c.units(x)
        return x
