"""1. Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in the whole text: at-signs, schemes, digits and the words that announce an
identifier. At each anchor, local parsers expand to both sides and accept only what validates:

- email: a local part and a host name of two labels at least, in Latin letters with or without accents;
- url: a scheme or www. and a host; ip: four octets, or a valid IPv6 address;
- phone: an international number, or ten digits as 3-3-4 with separators; ssn: 3-2-4 digits in assigned ranges;
- card: 13 to 19 digits of a known issuer range that pass Luhn's check; iban: country's length and remainder 1 modulo 97;
- account: 6 to 17 digits after an account cue; secret: a value of 8 characters at least assigned to a secret's name,
  or one of the well-known key formats.

Cues and schemes count in any casing. An anchor within a URL or a secret that was found isn't expanded to another of the
same kind. Of overlapping spans the one that begins first stays, then the longest, then the first kind in this order:
secret, url, email, iban, card, ssn, account, phone, ip.

Each parser looks at a bounded stretch around its anchor, or at one that no other anchor of its kind looks at again, so
the time is linear in the text, whatever it holds; a very long text is parsed whole.

Defined results: null and empty text have no spans; repeated rows report theirs each; other columns aren't looked at; an
empty table gives an empty result. Offsets are in characters, from 0, the end exclusive.
"""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import only, table
from .op10_bpe_codec import slices

KINDS = ("secret", "url", "email", "iban", "card", "ssn", "account", "phone", "ip")
_RANK = {k: i for i, k in enumerate(KINDS)}
SECRET_CUES = ("token", "password", "passwd", "pwd", "secret", "api_key", "apikey", "api-key", "access_key", "private_key", "auth_key")
ACCOUNT_CUES = ("account", "acct", "konto", "cuenta", "compte")
FIXED = {"AKIA": re.compile(r"AKIA[0-9A-Z]{16}(?![0-9A-Za-z])"), "ghp_": re.compile(r"ghp_[0-9A-Za-z]{36}(?![0-9A-Za-z])"), "sk-": re.compile(r"sk-[0-9A-Za-z_-]{20,}"), "-----BEGIN ": re.compile(r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----(?:[^-]*-----END [A-Z ]{0,30}PRIVATE KEY-----)?")}
_LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
_LOCAL = re.compile(f"[{_LATIN}0-9._%+-]")
_HOST = re.compile(rf"(?:[{_LATIN}0-9](?:[{_LATIN}0-9-]{{0,61}}[{_LATIN}0-9])?\.)+[{_LATIN}]{{2,24}}(?![{_LATIN}0-9])")
#: A host name, with what may stand before and after it in a URL, is looked for in so many characters.
HOST_CHARS = 512
_URL = re.compile(r"[^\s<>\"'`|]+")
_ADDRESS = re.compile(r"\d{1,3}(?:\.\d{1,3}){3}", re.ASCII)
_PHONE = re.compile(r"\+\d{1,3}(?:[ .-]?\(\d{1,4}\))?(?:[ .-]?\d{2,4}){2,5}|\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}|\d{3}([.-])\d{3}\1\d{4}", re.ASCII)
_SSN = re.compile(r"(\d{3})-(\d{2})-(\d{4})", re.ASCII)
_CARD = re.compile(r"\d(?:[ -]?\d){12,18}", re.ASCII)
_IBAN = re.compile(r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,30}", re.ASCII)
_ASSIGNED = re.compile(r"[\"']?[ \t]{0,3}[:=][ \t]{0,3}([\"']?)([A-Za-z0-9_./+=~-]{8,})")
_ACCOUNT = re.compile(r"(?:[ \t]{0,2}(?:no\.?|number|nr\.?|num\.?|#|:|=|is)){0,3}[ \t]{0,2}(\d{6,17})(?!\d)", re.IGNORECASE | re.ASCII)
_IBAN_LENGTH = dict(x.split(":") for x in "AD:24 AE:23 AT:20 BE:16 BG:22 CH:21 CY:28 CZ:24 DE:22 DK:18 EE:20 ES:24 FI:18 FR:27 GB:22 GI:23 GR:27 HR:21 HU:28 IE:22 IS:26 IT:27 LI:21 LT:20 LU:20 LV:21 MC:27 MT:31 NL:18 NO:15 PL:28 PT:25 RO:24 SA:24 SE:24 SI:19 SK:24 SM:27 TR:26".split())
Span = tuple[int, int, str]


@lru_cache(1)
def anchors() -> ahocorasick.Automaton:
    """Of text in lower case."""
    made = ahocorasick.Automaton()
    for word in ("@", "://", "www.", "::", *"0123456789"):
        made.add_word(word, (word, len(word)))
    for kind, cues in (("secret", SECRET_CUES), ("account", ACCOUNT_CUES)):
        for cue in cues:
            made.add_word(cue, (kind, len(cue)))
    for word in FIXED:
        made.add_word(word.lower(), (word, len(word)))
    made.make_automaton()
    return made


def lowered(text: str) -> str:
    """Lower case, character by character, so that places stay as they are."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def _alnum(text: str, i: int) -> bool:
    return 0 <= i < len(text) and text[i].isalnum()


def email(text: str, at: int) -> Span | None:
    start = at
    while start and at - start < 65 and _LOCAL.match(text, start - 1):
        start -= 1
    while start < at and text[start] in ".-%+":
        start += 1
    local = text[start:at]
    if not local or len(local) > 64 or local[-1] == "." or ".." in local:
        return None
    host = _HOST.match(text, at + 1)
    return (start, host.end(), "email") if host else None


def trimmed(text: str, start: int, end: int) -> int:
    """Where a URL ends without the punctuation, and the closing brackets that it hasn't opened, after it."""
    left = {c: text.count(o, start, end) - text.count(c, start, end) for c, o in (")(", "][", "}{")}
    while end > start and (text[end - 1] in ".,;:!?*$%&#" or left.get(text[end - 1], 0) < 0):
        left[text[end - 1]] = left.get(text[end - 1], 0) + 1
        end -= 1
    return end


def url(text: str, start: int, host: int) -> Span | None:
    """A host is sought first, near by; only the one URL that a run of characters holds is followed to its end."""
    near = _URL.match(text, host, host + HOST_CHARS)
    if not near:
        return None
    name = re.split(r"[/?#]", text[host : trimmed(text, host, near.end())], maxsplit=1)[0].rpartition("@")[2].split(":")[0]
    if not (_HOST.fullmatch(name) or name == "localhost" or _ADDRESS.fullmatch(name)):
        return None
    return start, trimmed(text, host, _URL.match(text, host).end()), "url"


def scheme(text: str, at: int) -> Span | None:
    start = at
    while start and at - start < 12 and text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "+."):
        start -= 1
    while start < at and not text[start].isalpha():
        start += 1
    return url(text, start, at + 3) if at - start > 1 else None


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if not i & 1 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def issuer(d: str) -> bool:
    n = len(d)
    return (
        d[0] == "4" and n in (13, 16, 19)
        or n == 16 and (51 <= int(d[:2]) <= 55 or 2221 <= int(d[:4]) <= 2720 or d[:2] in ("35", "65") or d[:4] == "6011" or 644 <= int(d[:3]) <= 649)
        or n == 15 and d[:2] in ("34", "37")
        or n == 14 and (d[:2] in ("36", "38", "39") or 300 <= int(d[:3]) <= 305)
        or n in (17, 18, 19) and d[:2] in ("62", "65")
    )


def cards(text: str, start: int) -> Iterator[Span]:
    """Of the groups of digits that follow, those from the first on that make a card number."""
    found = _CARD.match(text, start)
    if not found:
        return
    ends = [m.end() for m in re.finditer(r"\d(?!\d)", text[start : found.end()])]
    for end in reversed(ends):
        digits = re.sub(r"\D", "", text[start : start + end])
        if 13 <= len(digits) <= 19 and issuer(digits) and luhn(digits) and not _alnum(text, start + end):
            yield start, start + end, "card"
            return


def iban(text: str, start: int) -> Span | None:
    if start < 2 or _alnum(text, start - 3) or not _IBAN.match(text, start - 2):
        return None
    length = int(_IBAN_LENGTH.get(text[start - 2 : start], 0))
    end, have = start - 2, 0
    while end < len(text) and have < length and (text[end] == " " or text[end].isascii() and text[end].isalnum()):
        have += text[end] != " "
        end += 1
    code = text[start - 2 : end].replace(" ", "")
    if not length or have < length or _alnum(text, end):
        return None
    return (start - 2, end, "iban") if int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1 else None


def number(text: str, at: int) -> tuple[list[Span], int]:
    """What the run of digits at an anchor begins, and where the run ends."""
    start, end = at, at + 1
    while start and text[start - 1].isdigit():
        start -= 1
    while end < len(text) and text[end].isdigit():
        end += 1
    out: list[Span] = []
    before = text[start - 1] if start else ""
    inside = _alnum(text, start - 1)
    if not inside:
        found = _ADDRESS.match(text, start)
        if found and before != "." and all(int(x) < 256 for x in found[0].split(".")) and not _alnum(text, found.end()) and not (text[found.end() : found.end() + 1] == "." and _alnum(text, found.end() + 1)):
            out.append((start, found.end(), "ip"))
        out += cards(text, start)
        found = _SSN.match(text, start)
        if found and before != "-" and not _alnum(text, found.end()) and text[found.end() : found.end() + 1] != "-" and found[1] not in ("000", "666") and found[1] < "900" and found[2] != "00" and found[3] != "0000":
            out.append((start, found.end(), "ssn"))
        for back in (2, 1, 0):  # a phone number may begin with a plus sign or a bracket, or both
            head = start - back
            if head < 0 or back and text[head] not in "+(" or _alnum(text, head - 1) or not back and before in "+-.(" and before:
                continue
            found = _PHONE.match(text, head)
            if found and not _alnum(text, found.end()) and 8 <= sum(c.isdigit() for c in found[0]) <= 15:
                out.append((head, found.end(), "phone"))
                break
    else:
        found = iban(text, start)
        if found:
            out.append(found)
    return out, end


def six(text: str, at: int) -> Span | None:
    start, end, hexes = at, at, "0123456789abcdefABCDEF:."
    while start and text[start - 1] in hexes and at - start < 46:
        start -= 1
    while end < len(text) and text[end] in hexes and end - start < 46:
        end += 1
    while end > start and text[end - 1] in ".":
        end -= 1
    if end - start > 45 or text.count(":", start, end) < 2 or _alnum(text, start - 1) or _alnum(text, end) or end - start < 4:
        return None
    try:
        ipaddress.IPv6Address(text[start:end])
    except ValueError:
        return None
    return start, end, "ip"


def spans(text: str) -> list[Span]:
    """What one text holds, without overlaps, in order."""
    found: list[Span] = []
    past = -1  # digits before this were looked at
    ends = {"url": 0, "secret": 0}  # of the last one of its kind
    for end, (what, size) in anchors().iter(lowered(text)):
        start = end + 1 - size
        one: Span | None = None
        if what.isdigit():
            if start < past:
                continue
            new, past = number(text, start)
            found += new
            if start and text[start - 1] == ":" or text[past : past + 1] == ":":
                one = six(text, start)
        elif what == "@":
            one = email(text, start)
        elif what == "::":
            one = six(text, start)
        elif what == "account":
            value = _ACCOUNT.match(text, end + 1) if not _alnum(text, start - 1) else None
            if value:
                one = (value.start(1), value.end(1), "account")
        elif start < ends["url" if what in ("://", "www.") else "secret"]:
            continue
        elif what == "://":
            one = scheme(text, start)
        elif what == "www.":
            one = None if _alnum(text, start - 1) or text[start - 1 : start] in ("/", ".", "@") else url(text, start, start)
        elif _alnum(text, start - 1):
            continue
        elif what == "secret":
            value = _ASSIGNED.match(text, end + 1)
            if value:
                stop = value.end() + (value[1] != "" and text[value.end() : value.end() + 1] == value[1])
                one = (start, stop, "secret")
        else:
            value = FIXED[what].match(text, start)
            if value:
                one = (start, value.end(), "secret")
        if one:
            found.append(one)
            if one[2] in ends:
                ends[one[2]] = one[1]
    out: list[Span] = []
    for x in sorted(found, key=lambda x: (x[0], -x[1], _RANK[x[2]])):
        if not out or x[0] >= out[-1][1]:
            out.append(x)
    return out


def find(docs: DataFrame) -> DataFrame:
    """doc_id, kind, start, end and value of every span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at, rows = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                for a, b, kind in spans(text) if text else ():
                    at.append(i)
                    rows.append((kind, a, b, text[a:b]))
            kinds, starts, ends, values = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array(kinds, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(values, pa.string())],
                names=["doc_id", "kind", "start", "end", "value"],
            )

    return only(docs, doc_id="bigint", text="string").mapInArrow(run, "doc_id bigint, kind string, start int, end int, value string")


def redacted(text: str) -> str:
    out, at = [], 0
    for a, b, kind in spans(text):
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """doc_id and text with each span replaced by its kind in brackets; null text stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [None if t is None else redacted(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return only(docs, doc_id="bigint", text="string").mapInArrow(run, "doc_id bigint, text string")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
