"""What a JSON Schema says about its definitions: properties, requirements, types, descriptions and allowed values.

Schemas are trees whose references may form cycles and whose patterns hold balanced brackets, so they are read in
Python, one schema at a time; everything after that is relational (operators/schemas.py).

Text that isn't JSON, or too deep to be read, is a schema without definitions, and ``readable`` tells so. Keywords whose
value isn't of their kind (a list for required and the branches, an object for properties, a string for description,
pattern and a reference) are passed over.
"""

from __future__ import annotations

import json
import re

_SCALARS = ("string", "number", "boolean", "object")
_LINK = re.compile(r"\[([^\]]+)\]\([^)]+\)")
_EITHER_CASE = re.compile(r"(?:\[[A-Za-z0-9]\|[A-Za-z0-9]\])+(\d*)")
_PLAIN = re.compile(r"[A-Za-z0-9_:.*]+")
LONGEST = 200


def clean_name(name: str) -> str:
    """Without a number and a point in front."""
    return re.sub(r"\A\d+\.", "", name)


def balanced(text: str) -> bool:
    open_ = 0
    for c in text:
        open_ += (c == "(") - (c == ")")
        if open_ < 0:
            return False
    return not open_


def top_level(text: str, at: str = "|") -> list[str]:
    """Parts between separators that stand in no brackets; an empty last part doesn't count."""
    cuts, depth, classed = [-1], 0, False
    for i, c in enumerate(text):
        if c in "[]":
            classed = c == "["
        elif not classed and c in "()":
            depth += 1 if c == "(" else -1
        if c == at and not depth and not classed:
            cuts.append(i)
    parts = [text[a + 1 : b] for a, b in zip(cuts, [*cuts[1:], len(text)])]
    return parts if parts[-1] else parts[:-1]


def pattern_values(pattern) -> list[str]:
    """The words that a pattern spells out, alternative by alternative; others are left out."""
    if not pattern or not isinstance(pattern, str):
        return []
    inner = re.sub(r"\$\s*\Z", "", pattern.removeprefix("^"))
    if inner[:1] == "(" and inner[-1:] == ")":
        inner = inner[1:-1]
    found = []
    for part in map(str.strip, top_level(inner)):
        while part[:1] == "(" and part[-1:] == ")" and balanced(part[1:-1]):
            part = part[1:-1].strip()
        cased = _EITHER_CASE.fullmatch(part)
        if cased:
            found.append("".join(re.findall(r"\[(.)\|", part)) + cased[1])
        elif _PLAIN.fullmatch(part):
            found.append(part)
    return found


def _of(node, keyword: str, kind: type):
    """The value of a keyword, or None if it has another kind."""
    value = node.get(keyword)
    return value if isinstance(value, kind) else None


def _branches(node: dict, *keywords: str) -> list[dict]:
    return [b for k in keywords for b in _of(node, k, list) or () if isinstance(b, dict)]


class Schema:
    def __init__(self, text: str):
        try:
            self.root, self.readable = json.loads(text), True
        except (ValueError, RecursionError):
            self.root, self.readable = None, False
        held = self.root.get("definitions") if isinstance(self.root, dict) else None
        self.definitions: dict = held if isinstance(held, dict) else {}

    def resolve(self, ref) -> object:
        """What a reference points to, or None."""
        here = self.root if ref else None
        for step in (ref if isinstance(ref, str) else "").removeprefix("#/").split("/"):
            here = here.get(step) if isinstance(here, dict) else None
        return here

    def properties(self, node, seen: frozenset = frozenset()) -> dict:
        """All properties, in order of first appearance; of several by one name the last counts."""
        if not isinstance(node, dict):
            return {}
        if "$ref" in node:  # a reference hides what stands beside it
            ref = _of(node, "$ref", str)
            return {} if ref is None or ref in seen else self.properties(self.resolve(ref), seen | {ref})
        found: dict = {}
        for branch in _branches(node, "allOf", "anyOf", "oneOf"):
            found |= self.properties(branch, seen)
        return found | (_of(node, "properties", dict) or {})

    def required(self, node, seen: frozenset = frozenset()) -> set[str]:
        if not isinstance(node, dict):
            return set()
        found = {x for x in _of(node, "required", list) or () if isinstance(x, str)}
        for branch in _branches(node, "allOf"):
            found |= self.required(branch, seen)
        ref = _of(node, "$ref", str)
        if ref and ref not in seen:
            found |= self.required(self.resolve(ref), seen | {ref})
        return found

    def type_of(self, prop) -> str:
        if not isinstance(prop, dict) or not prop:
            return "any"
        if "const" in prop:
            return "string"
        if prop.get("type") == "array":
            return f"array of {self.item_type(prop['items'])}" if "items" in prop else "array"
        if "type" in prop:
            return str(prop["type"])
        if "$ref" in prop:
            target = self.resolve(prop["$ref"])
            named = target.get("type") if isinstance(target, dict) else None
            return named if isinstance(named, str) and named in _SCALARS else "string"
        kinds = set()
        options = _of(prop, "oneOf", list) or _of(prop, "anyOf", list)
        for option in _branches(prop, "oneOf") or _branches(prop, "anyOf"):
            if "type" in option:
                kinds.add(str(option["type"]))
            elif "$ref" in option:
                target = self.resolve(option["$ref"])
                kinds.add(str(target["type"]) if isinstance(target, dict) and "type" in target else "object")
        return "¦".join(sorted(kinds)) if options else "any"

    def item_type(self, items) -> str:
        if not isinstance(items, dict) or not items:
            return "any"
        if _of(items, "type", str) in ("string", "number"):
            return items["type"]
        return clean_name(ref.rpartition("/")[2]) if (ref := _of(items, "$ref", str)) is not None else "any"

    def values(self, prop) -> list:
        """Constants and words of patterns that a property may have; enum isn't looked at."""
        if not isinstance(prop, dict) or not prop:
            return []
        if "const" in prop:
            return [prop["const"]]
        if "pattern" in prop:
            return pattern_values(prop["pattern"])
        target = self.resolve(prop["$ref"]) if "$ref" in prop else None
        if isinstance(target, dict):
            if "pattern" in target:
                return pattern_values(target["pattern"])
            if "oneOf" in target or "anyOf" in target:
                return self.values(target)
        found = []
        for option in _branches(prop, "oneOf") or _branches(prop, "anyOf"):
            aim = self.resolve(option["$ref"]) if "$ref" in option and "const" not in option else None
            if "const" in option:
                found.append(option["const"])
            elif isinstance(aim, dict) and "const" in aim:
                found.append(aim["const"])
            found += pattern_values(option.get("pattern"))
        return found

    def describe(self, prop) -> str:
        """Description of 200 characters at most, default and allowed values."""
        if not isinstance(prop, dict) or not prop:
            return ""
        words = _LINK.sub(r"\1", " ".join((_of(prop, "description", str) or "").split()))
        if len(words) > LONGEST:
            words = words[: LONGEST - 3] + "..."
        default = f"Default: {json.dumps(prop['default'])}." if "default" in prop else ""
        values = ", ".join(v if isinstance(v, str) else json.dumps(v) for v in self.values(prop))
        return " ".join(x for x in (words, default, f"[{values}]" if values else "") if x)

    def is_object(self, definition) -> bool:
        """Whether a definition describes an object: it has properties, is of that type, or puts others together."""
        if not isinstance(definition, dict) or not definition:
            return False
        if "properties" in definition:
            return True
        kind = _of(definition, "type", str) or ""
        return kind not in ("string", "number", "boolean") and (kind == "object" or "allOf" in definition)

    def objects(self) -> list[tuple[int, str, list[tuple[int, str, bool, str, str]]]]:
        """Number and name of each object definition; number, name, requirement, type and description of its properties."""
        found = []
        for i, (name, definition) in enumerate(self.definitions.items()):
            if self.is_object(definition):
                needed = self.required(definition)
                rows = [(j, p, p in needed, self.type_of(s), self.describe(s)) for j, (p, s) in enumerate(self.properties(definition).items())]
                found.append((i, clean_name(name), rows))
        return found
