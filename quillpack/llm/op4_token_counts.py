"""4. Token counts by prefix dynamic programming: the exact token count of every prefix of every document.

Within a pre-token, ``count[i] = count[i - len(t)] + 1`` where ``t`` is the one token that ends at byte ``i`` and is
compatible with the last token of the prefix before it, i.e. byte-pair merging would not join across the two (Neubeck and
van Antwerpen, "So many tokens, so little time", 2024). Before
the pre-token all pieces are complete. Two places need care: a prefix that ends in white space followed by a word in
the whole text (there the white space is one piece), and one that cuts a contraction. Counts are stored as compressed
differences, one a character; truncation and budget questions are answered from them without encoding anything again.

Defined results: null text gives nulls; empty text 0 tokens and an empty store; repeated rows give a row each; other
columns aren't looked at; a very long text is counted whole; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe
from .common import only, table
from .op10_bpe_codec import slices

BUDGETS = (512, 2048)
_CONTRACTIONS = ("'re", "'ve", "'ll")


class PrefixCounter:
    """Token counts of all prefixes of a pre-token."""

    def __init__(self, vocabulary: bpe.Vocabulary):
        self.of = vocabulary
        self.rank = vocabulary.rank
        self.tokens = ahocorasick.Automaton()
        for t, token in self.rank.items():
            self.tokens.add_word(t.decode("latin-1"), (len(t), token))
        self.tokens.make_automaton()
        self.halves: dict[int, tuple[int, int]] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.known: dict[str, bytes] = {}

    def split(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge makes this one; a byte is both its own."""
        halves = self.halves.get(token)
        if halves is None:
            raw = self.of.bytes_of[token]
            halves = (token, token)
            if len(raw) > 1:
                halves = self.merged_below(raw, token)
            self.halves[token] = halves
        return halves

    def merged_below(self, raw: bytes, token: int) -> tuple[int, int]:
        have = [self.rank[raw[i : i + 1]] for i in range(len(raw))]
        while len(have) > 2:
            best, at = min((self.rank.get(self.of.bytes_of[a] + self.of.bytes_of[b], token), i) for i, (a, b) in enumerate(zip(have, have[1:])))
            if best >= token:
                break
            have[at : at + 2] = [best]
        return (have[0], have[1]) if len(have) == 2 else (token, token)

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both leaves exactly these two tokens."""
        found = self.fits.get((left, right))
        if found is None:
            found = self._compatible(left, right)
            if len(self.fits) > 1_000_000:
                self.fits.clear()
            self.fits[left, right] = found
        return found

    def _compatible(self, left: int, right: int) -> bool:
        limit, raw, rank = 1 << 60, self.of.bytes_of, self.rank
        while True:
            joined = rank.get(raw[left] + raw[right])
            if joined is not None and joined < limit and self.split(joined) == (left, right):
                return False
            # Undo the later of the two tokens' last merges, on the side of the border.
            if left > right:
                limit, (_, left) = left, self.split(left)
                if left == limit:
                    limit, (right, _) = right + 1, self.split(right)
                    if right + 1 == limit:
                        return True
            else:
                limit, (right, _) = right + 1, self.split(right)
                if right + 1 == limit:
                    limit, (_, left) = left, self.split(left)
                    if left == limit:
                        return True

    def of_bytes(self, raw: bytes) -> list[int]:
        """Counts of the prefixes of 1, 2, ... bytes. The automaton gives the tokens that end at each byte, the longest first."""
        known, last, count, solved = self.fits.get, [], [], -1
        for end, (k, t) in self.tokens.iter(raw.decode("latin-1")):
            if end == solved:
                continue
            k = end - k
            if k < 0:
                last.append(t)
                count.append(1)
                solved = end
                continue
            before = last[k]
            fits = known((before, t))
            if fits is None:
                fits = self.compatible(before, t)
            if fits:
                last.append(t)
                count.append(count[k] + 1)
                solved = end
        return count

    def of_piece(self, piece: str) -> bytes:
        """Counts of the prefixes of 1, 2, ... characters, as int32 bytes."""
        found = self.known.get(piece)
        if found is None:
            raw = piece.encode("utf-8", "surrogatepass")
            count = self.of_bytes(raw)
            if len(raw) != len(piece):
                count = [count[i] for i in range(len(raw)) if i + 1 == len(raw) or raw[i + 1] & 0xC0 != 0x80]
            if piece in _CONTRACTIONS:
                count[1] = 2
            found = np.array(count, np.int32).tobytes()
            if len(piece) <= bpe.CACHE_CHARS:
                self.known[piece] = found
        return found

    def trim(self) -> None:
        if len(self.known) > bpe.CACHE_PIECES:
            self.known.clear()

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        """For each text, counts of the prefixes of 1, 2, ... characters."""
        if not texts:
            return []
        joined, begins, first = bpe.batch_spans(texts)
        distinct, inverse = bpe.intern(joined, begins)
        self.trim()
        made = list(map(self.of_piece, distinct))
        offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, made), np.int64, len(made)) // 4)])
        flat = np.frombuffer(b"".join(made), np.int32)
        total = flat[offsets[1:] - 1] if len(flat) else np.empty(0, np.int32)
        n = total[inverse].astype(np.int64)
        n[first[1:] - 1] = 0  # separators
        before = np.cumsum(n) - n
        at_text = np.zeros(len(inverse), np.int64)
        at_text[first[1:]] = 1
        number = np.cumsum(at_text)
        base = before - (before[first] if len(before) == len(inverse) and len(inverse) else before)[number]
        chars = np.diff(begins)
        counts = np.repeat(base, chars) + flat[bpe.ragged(offsets, inverse)]
        kind = bpe.classes()
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        starts = begins[:-1]
        white = kind[codes[starts]] == bpe.SPACE
        after = np.flatnonzero(white[1:] & (kind[codes[starts[1:] - 1]] == bpe.SPACE)) + 1
        for q in after.tolist():
            run = joined[begins[q - 1] : begins[q] + 1]
            counts[begins[q]] = base[q - 1] + int(np.frombuffer(self.of_piece(run), np.int32)[-1])
        ends = np.concatenate([[0], np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))])
        return [counts[a : b - 1] for a, b in zip(ends.tolist(), ends[1:].tolist())]


_counters: dict[str, PrefixCounter] = {}


def counter(path: str = bpe.VOCABULARY) -> PrefixCounter:
    if path not in _counters:
        _counters[path] = PrefixCounter(bpe.vocabulary(path))
    return _counters[path]


def store(counts: np.ndarray, compress) -> bytes:
    steps = np.diff(counts, prepend=0)
    width = next(w for w in (np.int8, np.int16, np.int64) if not len(steps) or np.iinfo(w).min <= steps.min() and steps.max() <= np.iinfo(w).max)
    return bytes([np.dtype(width).itemsize]) + compress(steps.astype(width).tobytes())


def stored_counts(data: bytes) -> np.ndarray:
    """Counts of the prefixes of 1, 2, ... characters."""
    raw = zstandard.ZstdDecompressor().decompress(data[1:])
    return np.cumsum(np.frombuffer(raw, f"<i{data[0]}"), dtype=np.int64)


def within(counts: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix of at most ``budget`` tokens; prefixes may have more tokens than longer ones."""
    fits = np.flatnonzero(counts[::-1] <= budget)
    return len(counts) - int(fits[0]) if len(fits) else 0


def prefix_counts(docs: DataFrame, budgets: tuple[int, ...] = BUDGETS, path: str = bpe.VOCABULARY, level: int = 1) -> DataFrame:
    """doc_id, n_chars, n_tokens, prefix_counts (store), and for each budget the characters of the longest prefix within it."""
    fields = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("n_tokens", pa.int64()), *[(f"chars_within_{b}", pa.int64()) for b in budgets], ("prefix_counts", pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, compress = counter(path), zstandard.ZstdCompressor(level=level).compress
        for batch in slices(batches, 2_000_000):
            texts = batch.column("text").to_pylist()
            rows = []
            for text, counts in zip(texts, count.batch([t or "" for t in texts])):
                if text is None:
                    rows.append((None,) * (3 + len(budgets)))
                else:
                    rows.append((len(text), int(counts[-1]) if len(counts) else 0, *[within(counts, b) for b in budgets], store(counts, compress)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, f[1]) for c, f in zip(zip(*rows), fields[1:])]], schema=pa.schema(fields))

    ints = ", ".join(f"{name} bigint" for name, _ in fields[:-1])
    return only(docs, doc_id="bigint", text="string").mapInArrow(run, f"{ints}, prefix_counts binary")


def _tokens_at(data: pd.Series, chars: pd.Series) -> pd.Series:
    def one(d, c):
        if d is None or pd.isna(c):
            return None
        counts = stored_counts(bytes(d))
        c = min(int(c), len(counts))
        return int(counts[c - 1]) if c > 0 else 0

    return pd.Series([one(d, c) for d, c in zip(data, chars)], dtype="Int64")


def _chars_within(data: pd.Series, budget: pd.Series) -> pd.Series:
    return pd.Series([None if d is None or pd.isna(b) else within(stored_counts(bytes(d)), int(b)) for d, b in zip(data, budget)], dtype="Int64")


def tokens_at(data: Column, chars: Column) -> Column:
    """Tokens of the prefix of so many characters (of all, if there are fewer)."""
    return F.pandas_udf(_tokens_at, T.LongType())(data, chars)


def chars_within(data: Column, budget: Column) -> Column:
    """Characters of the longest prefix of at most so many tokens."""
    return F.pandas_udf(_chars_within, T.LongType())(data, budget)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_counts(table(spark, sf_dir, "documents"))
