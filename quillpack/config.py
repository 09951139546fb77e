"""Settings of the compiler: defaults, JSON files, overrides. Invalid settings are refused when they are made."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from functools import lru_cache
from pathlib import Path

#: Where a settings file is looked for when none is named.
SEARCHED = ("quillpack.config.json", "config/quillpack.config.json")
SCOPE_MODES = ("flat", "concat", "stacked")
Pairs = tuple[tuple[str, str], ...]


@dataclass(frozen=True)
class Settings:
    """``phrases`` and ``units`` keep their order: of replacements of equal length, the first goes first."""

    compression: int = 2
    scope_mode: str = "flat"
    keep_urls: bool = False
    sentence_split: bool = False
    anchor_every: int = 0
    max_kv_per_line: int = 4
    prefix_extraction: bool = True
    min_prefix_len: int = 6
    min_prefix_pct: float = 0.6
    bool_compress: bool = True
    stopwords: frozenset[str] = frozenset()
    protect_words: frozenset[str] = frozenset()
    phrases: Pairs = ()
    units: Pairs = ()
    #: Not in the JSON files: keep the lines of code blocks apart instead of joining them with spaces.
    preserve_blocks: bool = field(default=False)

    def __post_init__(self):
        if self.compression not in (0, 1, 2):
            raise ValueError(f"compression is 0, 1 or 2, not {self.compression!r}")
        if self.scope_mode not in SCOPE_MODES:
            raise ValueError(f"scope_mode is one of {SCOPE_MODES}, not {self.scope_mode!r}")
        if self.max_kv_per_line < 1:
            raise ValueError("max_kv_per_line is 1 at least")
        if self.anchor_every < 0:
            raise ValueError("anchor_every is 0 (none) or more")

    @classmethod
    def of(cls, values: dict) -> Settings:
        """From the keys of a settings file; unknown keys are ignored, missing ones have their defaults."""
        known = {k: values[k] for k in cls.__dataclass_fields__ if k in values and k not in ("stopwords", "protect_words", "phrases", "units")}
        words = {k: frozenset(w.lower() for w in values.get(k, ())) for k in ("stopwords", "protect_words")}
        return cls(**known, **words, phrases=tuple(values.get("phrase_map", {}).items()), units=tuple(values.get("units", {}).items()))

    @classmethod
    def load(cls, path: str | Path | None = None) -> Settings:
        """The named file, else the first of ``SEARCHED`` that exists, else bare defaults without dictionaries."""
        if path is None:
            path = next((p for p in SEARCHED if Path(p).is_file()), None)
        return cls() if path is None else cls.of(json.loads(Path(path).read_text(encoding="utf-8")))

    def override(self, compression: int | None = None, scope_mode: str | None = None, keep_urls: bool = False, sentence_split: bool = False, anchor_every: int | None = None) -> Settings:
        """As command-line flags do: booleans can only be turned on, None leaves a setting as it is."""
        given = {"compression": compression, "scope_mode": scope_mode, "anchor_every": anchor_every, "keep_urls": keep_urls or None, "sentence_split": sentence_split or None}
        return replace(self, **{k: v for k, v in given.items() if v is not None})


@lru_cache(1)
def standard() -> Settings:
    """The settings with the dictionaries that come with the package."""
    held = json.loads((Path(__file__).parent / "defaults.json").read_text(encoding="utf-8"))
    pairs = lambda rows: tuple(tuple(r.split(" => ")) for r in rows)
    return Settings(stopwords=frozenset(held["stopwords"].split()), protect_words=frozenset(held["protected"].split()), phrases=pairs(held["phrases"]), units=pairs(held["units"]))
