"""Operator 1 against a detector that tries every place of a text by plain patterns, and on hostile texts."""

import ipaddress
import random
import re
import time

import pytest

from quillpack.llm import op1_pii as pii

DATA = "/root/testdata/sf0.001"
L = "A-Za-zÀ-ÖØ-öø-ɏ"
HOST = rf"(?:[{L}0-9](?:[{L}0-9-]{{0,61}}[{L}0-9])?\.)+[{L}]{{2,24}}(?![{L}0-9])"
IP4 = r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"


def alnum(text, i):
    return 0 <= i < len(text) and text[i].isalnum()


def tail(piece):
    """A URL's end: punctuation goes, and closing brackets while there are more of them than of opening ones."""
    while piece and (piece[-1] in ".,;:!?*$%&#" or any(piece[-1] == c and piece.count(c) > piece.count(o) for o, c in ("()", "[]", "{}"))):
        piece = piece[:-1]
    return piece


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(d[::-1])) % 10 == 0


def emails(t):
    for m in re.finditer(rf"([{L}0-9._%+-]+)@(?=({HOST}))", t):
        local = m[1].lstrip(".-%+")
        if local and len(local) <= 64 and local[-1] != "." and ".." not in local:
            yield m.end(1) - len(local), m.end(2), "email"


def urls(t):
    for run in re.finditer(r"[^\s<>\"'`|]+", t):
        past = 0
        for m in re.finditer(r"(?i)://|www\.", t[: run.end()]):
            if m.start() < run.start() or m.start() < past:
                continue
            if m[0] == "://":
                start, host = m.start() - len(re.search(r"[A-Za-z]?[A-Za-z0-9+.]*$", re.sub(r"^[^A-Za-z]+", "", re.search(r"[A-Za-z0-9+.]{0,12}$", t[: m.start()])[0]))[0]), m.end()
                if m.start() - start < 2:
                    continue
            else:
                start = host = m.start()
                if alnum(t, start - 1) or t[start - 1 : start] in ("/", ".", "@"):
                    continue
            whole = tail(t[host : run.end()])
            name = re.split("[/?#]", whole)[0].split("@")[-1].split(":")[0]
            if re.fullmatch(rf"{HOST}|localhost|{IP4}", name):
                past = host + len(whole)
                yield start, past, "url"


def numbers(t):
    for m in re.finditer(rf"(?<![^\W_])(?<!\.)(?=({IP4})(?![^\W_])(?!\.[^\W_]))", t):
        if all(int(x) < 256 for x in m[1].split(".")):
            yield m.start(), m.end(1), "ip"
    for m in re.finditer(r"(?<![^\W_])(?<!-)(?=(([0-9]{3})-([0-9]{2})-([0-9]{4}))(?![^\W_])(?!-))", t):
        if m[2] not in ("000", "666") and m[2] < "900" and m[3] != "00" and m[4] != "0000":
            yield m.start(), m.end(1), "ssn"
    for i in (m.start() for m in re.finditer(r"(?<![^\W_])[0-9]", t)):
        for j in range(min(len(t), i + 40), i, -1):
            d = re.sub("[ -]", "", t[i:j])
            if re.fullmatch(r"[0-9](?:[ -]?[0-9]){12,18}", t[i:j]) and pii.issuer(d) and luhn(d) and not alnum(t, j):
                yield i, j, "card"
                break
    for m in re.finditer(r"(?=([A-Z]{2}[0-9]{2}))", t):
        i, want = m.start(), int(pii._IBAN_LENGTH.get(m[1][:2], 0))
        found = re.match(r"(?:[A-Za-z0-9] *){%d}" % max(want - 1, 1) + "[A-Za-z0-9]", t[i:]) if want and not alnum(t, i - 1) and re.match(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}", t[i:]) else None
        if found and not alnum(t, i + found.end()):
            code = found[0].replace(" ", "")
            if int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1:
                yield i, i + found.end(), "iban"
    for m in re.finditer(r"(?i)(?<![^\W_])(?:account|acct|konto|cuenta|compte)(?:[ \t]{0,2}(?:no\.?|number|nr\.?|num\.?|#|:|=|is)){0,3}[ \t]{0,2}([0-9]{6,17})(?![0-9])", t):
        yield m.start(1), m.end(1), "account"


def sixes(t):
    for m in re.finditer(r"[0-9a-fA-F:.]+", t):
        x = m[0].rstrip(".")
        if 4 <= len(x) <= 45 and x.count(":") >= 2 and re.search("::|[0-9]:|:[0-9]", x) and not alnum(t, m.start() - 1) and not alnum(t, m.start() + len(x)):
            try:
                ipaddress.IPv6Address(x)
            except ValueError:
                continue
            yield m.start(), m.start() + len(x), "ip"


def secrets(t):
    past = 0
    cues = "token|password|passwd|pwd|secret|api_key|apikey|api-key|access_key|private_key|auth_key"
    for m in re.finditer(rf"(?<![^\W_])(?=((?i:{cues})[\"']?[ \t]{{0,3}}[:=][ \t]{{0,3}}([\"']?)[A-Za-z0-9_./+=~-]{{8,}}|AKIA[0-9A-Z]{{16}}(?![0-9A-Za-z])|ghp_[0-9A-Za-z]{{36}}(?![0-9A-Za-z])|sk-[0-9A-Za-z_-]{{20,}}))", t):
        if m.start() >= past:
            past = m.end(1) + (bool(m[2]) and t[m.end(1) : m.end(1) + 1] == m[2])
            yield m.start(), past, "secret"


def brute(t, phones):
    found = [*emails(t), *urls(t), *numbers(t), *sixes(t), *secrets(t), *phones]
    out = []
    for x in sorted(found, key=lambda x: (x[0], -x[1], pii.KINDS.index(x[2]))):
        if not out or x[0] >= out[-1][1]:
            out.append(x)
    return out


def phones_of(t):
    """By the pattern that defines them, at every place where one may begin."""
    for m in re.finditer(r"[0-9+(]", t):
        i = m.start()
        before, first = t[i - 1 : i], re.match(r"[+(]{0,2}", t[i:]).end()
        if alnum(t, i - 1) or alnum(t, i + first - 1) and first or not t[i + first : i + first + 1].isdigit() or not first and before and before in "+-.(":
            continue
        found = pii._PHONE.match(t, i)
        if found and not alnum(t, found.end()) and 8 <= sum(c.isdigit() for c in found[0]) <= 15:
            yield i, found.end(), "phone"


PIECES = ["a.b@ex.org", "@", "ann_", "müller@exämple.de", "..", "http://", "HTTPS://Ex.org/p(1)", "www.a-b.co", "/x?u=http://b.org", ")", "(", "10.0.0.1", "256.1.1.1", ".7", "2001:db8::1", "::", "fe80", ":", "4111 1111 1111 1111", "4111111111111112", "378282246310005", "123-45-6789", "-1", "GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "account no. ", "Konto: ", "1234567", "PassWord", " = ", "'", "hunter2hunter2", "ApI_Key", "=", "sk-" + "a" * 22, "AKIA" + "B" * 16, "token", " ", " ", " ", "\n", "word", ", ", ".", "x", "é", "0", "55"]


def test_against_every_place():
    rng = random.Random(11)
    texts = ["".join(rng.choices(PIECES, k=rng.randint(1, 14))) for _ in range(6000)]
    seen = set()
    for t in texts:
        made = pii.spans(t)
        phones = [x for x in made if x[2] == "phone"]  # their own test is below
        assert made == brute(t, phones), t
        seen |= {k for _, _, k in made}
    assert seen >= set(pii.KINDS) - {"phone"}


def test_phones():
    rng = random.Random(12)
    pieces = ["+1 415-555-0132", "(415) 555-0199", "415.555.0132", "+49 (30) 1234567", " ", " ", "x", "1", "-", ".", "(", "+", ", "]
    some = 0
    for _ in range(3000):
        t = "".join(rng.choices(pieces, k=rng.randint(1, 7)))
        made = [x for x in pii.spans(t) if x[2] == "phone"]
        every = list(phones_of(t))
        assert all(x in every for x in made), t
        others = [x for x in pii.spans(t) if x[2] != "phone"]
        assert all(any(a < y[1] and y[0] < b for y in made + others) for a, b, _ in every), t
        some += len(made)
    assert some > 1000


def test_query_against_every_place(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    want = []
    for r in docs.collect():
        found = brute(r.text, [x for x in pii.spans(r.text) if x[2] == "phone"])
        want += [(r.doc_id, k, a, b, r.text[a:b]) for a, b, k in found]
    assert sorted(map(tuple, pii.op1_pii(spark, DATA).collect())) == sorted(want) and len(want) > 10


@pytest.mark.parametrize("piece", ["::", "1:", "a::b", "ab://", "://", ")", "http://a.b)(", "@", "a@", "token=", "sk-", "1.1.1.1.", "4111 1111 ", "account ", "İ1"])
def test_time_is_linear(piece):
    """A megabyte takes no more than some tens of times what a fiftieth of it does; when it grew with the square it took days."""

    def took(n):
        began = time.process_time()
        pii.spans(piece * (n // len(piece)))
        return time.process_time() - began

    took(1000)
    assert took(1_000_000) < 250 * max(took(20_000), 0.02)


def test_a_long_tail_of_brackets():
    text = "http://a.bc/" * 40_000 + ")" * 400_000 + " a@b.org"
    assert [(a, b - a, k) for a, b, k in pii.spans(text)] == [(0, 480_000, "url"), (880_001, 7, "email")]


def test_any_casing_and_letters():
    text = "PassWord: hunter2hunter2 ApI_Key=abcdefgh12 müller@exämple.de KONTO 1234567 Www.Ex.Org"
    assert [text[a:b] for a, b, _ in pii.spans(text)] == ["PassWord: hunter2hunter2", "ApI_Key=abcdefgh12", "müller@exämple.de", "1234567", "Www.Ex.Org"]
