"""The compiler as one cursor over lines, in plain Python: what the operators are held against."""

import re
import unicodedata

GENERIC = set("type default notes info details description value".split())
LETTERS = dict(zip("disabled enabled no yes false true".split(), "NYNYFT"))
LISTED = re.compile(r"(\s*)(?:[-*+]|\d+\.)\s+(.+)", re.DOTALL)
PAIR = re.compile(r"([A-Za-z][A-Za-z0-9 _-]{0,63})\s*:\s+(.+)", re.DOTALL)
HEAD = re.compile(r"(#{1,6})\s+(.+)", re.DOTALL)


def cells(row):
    made = [c.strip() for c in row.split("|")]
    made = made[1:] if made and not made[0] else made
    return made[:-1] if made and not made[-1] else made


def fenced(rows):
    """Lines, and (lang, content) for each block."""
    at = 0
    while at < len(rows):
        m = re.fullmatch(r"(`{3,})(\w*)", rows[at])
        at += 1
        if not m:
            yield rows[at - 1]
            continue
        end = rows.index(m[1], at) if m[1] in rows[at:] else len(rows)
        if end < len(rows) or at < len(rows):
            yield m[2], "\n".join(rows[at:end])
        at = end + 1


def parsed(rows):
    rows, at, text = list(rows), 0, lambda r: isinstance(r, str)
    breaks = lambda r: not text(r) or not r.strip() or "|" in r or HEAD.fullmatch(r.strip()) or LISTED.fullmatch(r) or PAIR.fullmatch(r.strip())
    while at < len(rows):
        row = rows[at]
        at += 1
        if not text(row):
            yield "block", row
            continue
        bare = row.strip()
        if not bare:
            yield "blank", None
        elif re.fullmatch("[-*_]{3,}", bare):
            continue
        elif m := HEAD.fullmatch(bare):
            yield "heading", (len(m[1]), m[2])
        elif "|" in bare and at < len(rows) and text(rows[at]) and re.match(r"\|?[\s:-]+\|", rows[at].strip()) and "---" in rows[at]:
            held, at = [cells(bare)], at + 1
            while at < len(rows) and text(rows[at]) and "|" in rows[at]:
                held.append(cells(rows[at].strip()))
                at += 1
            yield "table", held
        elif m := LISTED.fullmatch(row):
            yield "item", (len(m[1]) // 2, m[2].strip())
        elif m := PAIR.fullmatch(bare):
            yield "kv", (m[1], m[2])
        else:
            held = [bare]
            while at < len(rows) and not breaks(rows[at]):
                held.append(rows[at].strip())
                at += 1
            yield "paragraph", " ".join(held)


def key_of(x):
    return re.sub("[^a-z0-9_-]", "", re.sub(r"\s+", "_", x.strip().lower())).strip("-")


class Compiler:
    def __init__(self, s):
        self.s = s

    def inline(self, x):
        for mark in (r"\*\*(.+?)\*\*", "__(.+?)__", r"(?<!\*)\*(?!\*)(.+?)(?<!\*)\*(?!\*)", "`([^`]+)`", "~~(.+?)~~"):
            x = re.sub(mark, r"\1", x, flags=re.DOTALL)
        by = r"\1<\2>" if self.s.compression < 2 or self.s.keep_urls else r"\1"
        for mark in (r"!\[([^\]]*)\]\(([^)]+)\)", r"\[([^\]]*)\]\(([^)]+)\)"):
            x = re.sub(mark, by, x)
        return x

    def scope_of(self, x):
        x = re.sub("[^A-Za-z0-9_-]", "", re.sub(r"\s+", "_", x.strip()))
        return x.lower() if self.s.compression == 2 else x

    def pair_lines(self, pairs):
        if not pairs or not self.s.compression:
            return [f":{k}={v}" for k, v in pairs]
        first, last = min(k for k, _ in pairs), max(k for k, _ in pairs)
        n = next((i for i, (a, b) in enumerate(zip(first, last)) if a != b), min(len(first), len(last)))
        n = max(first[:n].rfind(c) for c in "-_.") + 1
        lead = first[:n] if n > 1 and len(pairs) >= 3 and n >= self.s.min_prefix_len and self.s.prefix_extraction else ""
        said = [f"{k[len(lead):]}={v}" for k, v in pairs]
        size = self.s.max_kv_per_line
        return ([f":_pfx={lead}"] if lead else []) + [":" + " ".join(said[i : i + size]) for i in range(0, len(said), size)]

    def table(self, rows, say, pairs):
        head, body = rows[0], rows[1:]
        first = [r[0].strip() for r in body if r]
        fine = body and len(head) > 1 and all(len(r) == len(head) for r in body) and len(set(first)) == len(first) and all(re.match("[A-Za-z._-]", x) and len(x.split()) <= 4 for x in first)
        flags = {c for c in range(1, len(head)) if self.s.compression == 2 and self.s.bool_compress and body and all((r[c] if c < len(r) else "").strip().lower() in LETTERS for r in body)}

        def cell(x, c):
            x = self.inline(x)
            return LETTERS.get(x.strip().lower(), x) if c in flags else x

        joined = lambda r, skip=0: "¦".join(cell(x, c) for c, x in enumerate(r) if c >= skip)
        if fine and len(head) == 2:
            if head[1] and head[1].strip().lower() not in GENERIC and key_of(head[1]):
                say(":_col=" + key_of(head[1]))
        elif fine or len(head) > 1:
            say(":_cols=" + "¦".join(map(key_of, head)))
        for r in body:
            if fine and key_of(r[0]):
                pairs.append((key_of(r[0]), joined(r, 1)))
            else:
                say(self.inline("¦".join(r)) if fine and len(head) == 2 else joined(r))

    def emitted(self, nodes):
        out, pairs, stack, scope = [], [], [], None
        for kind, x in [*nodes, ("blank", None)]:
            if kind != "kv":
                out += self.pair_lines(pairs)
                pairs = []
            if kind == "heading":
                stack = [h for h in stack if h[0] < x[0]] + [(x[0], self.scope_of(x[1]))]
                name = stack[-1][1] if self.s.scope_mode == "flat" else "_".join(n for _, n in stack)
                if name and name != scope:
                    scope = name
                    out.append("@" + name)
            elif kind != "blank" and not scope:
                scope = "root"
                out.append("@root")
            if kind == "paragraph":
                x = self.inline(x)
                split = self.s.sentence_split and self.s.compression == 2
                out += [p.strip() for p in (re.split(r"(?<=[.!?])\s+(?=[A-Z])", x) if split else [x]) if p.strip()]
            elif kind == "item":
                out.append("-" + "." * x[0] + " " * (x[0] > 0) + self.inline(x[1]))
            elif kind == "kv":
                pairs.append((key_of(x[0]), self.inline(x[1])))
            elif kind == "table":
                self.table(x, out.append, pairs)
            elif kind == "block":
                out += ["::" + (x[0] or "code"), "<<<", x[1], ">>>"]
        return out

    def worded(self, x, whole):
        """Phrases and units; on whole text also without stopwords."""
        longest = lambda pairs: sorted(pairs, key=lambda p: -len(p[0]))
        for k, v in longest(self.s.phrases):
            x = re.sub(re.escape(k), lambda m, v=v: v, x, flags=re.IGNORECASE)
        for k, v in longest(self.s.units):
            x = re.sub(r"(\d+)\s+" + re.escape(k), lambda m, v=v: m[1] + v, x, flags=re.IGNORECASE)
            x = re.sub(re.escape(k), lambda m, v=v: v, x, flags=re.IGNORECASE)
        if not whole:
            return x
        letters = lambda w: re.sub("[^a-z]", "", w.lower())
        return " ".join(w for w in x.split() if letters(w) not in self.s.stopwords or letters(w) in self.s.protect_words)

    def squeezed(self, lines):
        lines = [" ".join(x.split()) for x in lines]
        lines = [x for x in lines if x and x != ">---" and not re.fullmatch("[-*_]{3,}", x)]
        if self.s.compression < 2:
            return lines
        out, inside = [], False
        for x in lines:
            inside = {"<<<": True, ">>>": False}.get(x, inside)
            if inside or x[0] in "@~→←=" or x.startswith(("::", "<<<", ">>>")):
                out.append(x)
            elif x[0] == ":":
                out.append(":" + self.worded(x[1:], False))
            else:
                mark = x[0] * (x[0] == "-")
                x = mark + self.worded(x[len(mark) :], True)
                out.append(x[:-1] if x.endswith(".") and not x.endswith(("...", "e.g.", "i.e.", "etc.")) else x)
        return out

    def anchored(self, lines):
        out, scope, n = [], None, 0
        for x in lines:
            if x.startswith("@"):
                scope, n = x, 0
            else:
                n += 1
                if self.s.anchor_every and scope and n == self.s.anchor_every:
                    out.append(scope)
                    n = 0
            out.append(x)
        return out

    def __call__(self, text):
        text = re.sub("\r\n?", "\n", unicodedata.normalize("NFKC", text))
        return self.anchored(self.squeezed(self.emitted(parsed(fenced([x.rstrip() for x in text.split("\n")])))))

