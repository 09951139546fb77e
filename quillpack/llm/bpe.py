"""Byte-level BPE shared by the token operators: vocabulary, vectorised pre-tokenisation, cached pieces.

The pre-tokenisation is that of the usual byte-level pattern::

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

computed with numpy over the character classes of a whole batch rather than by a regex engine, one match at a time.
"""

from __future__ import annotations

import base64
import unicodedata
from array import array
from functools import lru_cache

import numpy as np

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pieces whose encodings a worker remembers at once; a full cache is emptied, so memory stays bounded and results don't change.
CACHE_PIECES = 500_000
#: Longer pieces aren't remembered.
CACHE_CHARS = 48

LETTER, NUMBER, SPACE, OTHER, END = 1, 2, 3, 4, 5
#: Stands between texts of a batch; a text that contains it is cut there for pre-tokenisation only through ``spans_of``.
SEPARATOR = "\U0010ffff"
_WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(1)
def classes() -> np.ndarray:
    kinds = np.full(0x110001, OTHER, np.uint8)
    of = {"L": LETTER, "N": NUMBER}
    category = unicodedata.category
    for low in range(0, 0x110000, 0x100):
        if 0x30000 <= low < 0xE0000 and low > 0x323FF or low >= 0xE0200:
            continue
        for c in range(low, low + 0x100):
            k = of.get(category(chr(c))[0])
            if k:
                kinds[c] = k
    kinds[_WHITE] = SPACE
    kinds[0x110000] = END
    return kinds


def starts_of(codes: np.ndarray) -> np.ndarray:
    """Marks the first character of every piece. ``codes``: code points, 0x110000 between texts."""
    n = len(codes)
    start = np.ones(n + 1, bool)
    if n == 0:
        return start[:0]
    kind = classes()[codes]
    start[1:n] = kind[1:] != kind[:-1]
    # The last white space before a word leaves its run; a plain space joins the word.
    word = (kind == LETTER) | (kind == NUMBER) | (kind == OTHER)
    joins = np.flatnonzero(word[1:] & (kind[:-1] == SPACE))
    start[joins] = True
    start[joins[codes[joins] == 0x20] + 1] = False
    at = np.flatnonzero(codes == 0x27)
    at = at[start[at]]
    if len(at):
        padded = np.concatenate([codes, np.full(3, 0x110000, codes.dtype)])
        a, b = padded[at + 1], padded[at + 2]
        one = np.isin(a, [ord(x) for x in "stmd"])
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        start[at[one | two] + 1] = False
        start[at[one] + 2] = True
        start[at[two] + 3] = True
    return start[:n]


def spans_of(text: str) -> np.ndarray:
    """Offsets at which the pieces of one text begin, and its length."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.append(np.flatnonzero(starts_of(codes)), len(text))


def batch_spans(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """One string of all texts, where its pieces begin (with its length at the end), and the number of the first piece of each text.

    Between two texts stands one separator, which is a piece of its own.
    """
    joined = SEPARATOR.join(texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths + 1)[:-1] - 1
    if len(ends):
        codes = codes.copy()
        codes[ends] = 0x110000
    start = starts_of(codes)
    start[ends] = True
    after = ends + 1
    start[after[after < len(start)]] = True
    begins = np.append(np.flatnonzero(start), len(joined))
    return joined, begins, np.searchsorted(begins, np.concatenate([[0], ends + 1])[: len(texts)])


def intern(joined: str, begins: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The distinct pieces, and for each piece the number of its distinct one.

    Pieces of up to 15 bytes are compared as two machine words, grouped by a mixed key and checked against their
    group's first; longer ones, and all if the mixed keys ever collide, go through a dictionary.
    """
    n = len(begins) - 1
    raw = np.frombuffer(joined.encode("utf-8", "surrogatepass") + bytes(16), np.uint8)
    if len(raw) - 16 == len(joined):
        at = begins
    else:
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        size = 1 + (codes >= 0x80).astype(np.int8) + (codes >= 0x800) + (codes >= 0x10000)
        at = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])[begins]
    size = np.diff(at)
    words = np.lib.stride_tricks.as_strided(raw[:8].view("<u8"), (len(raw) - 7,), (1,))
    inverse = np.empty(n, np.int64)
    distinct: list[str] = []
    short = np.flatnonzero(size <= 15)
    rest = np.flatnonzero(size > 15)
    if len(short):
        a, k = at[short], size[short].astype(np.uint64)
        lower = words[a] & _LOW[np.minimum(k, 8)]
        upper = (words[a + 8] & _LOW[np.maximum(k, 8) - 8]) | (k << np.uint64(60))
        key = (lower ^ (lower >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + (upper ^ (upper >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        _, one, group = np.unique(key, return_index=True, return_inverse=True)
        if (lower[one][group] == lower).all() and (upper[one][group] == upper).all():
            inverse[short] = group
            p = short[one]
            distinct = [joined[x:y] for x, y in zip(begins[p].tolist(), begins[p + 1].tolist())]
        else:
            rest = np.arange(n)
    seen: dict[str, int] = {}
    for i, x, y in zip(rest.tolist(), begins[rest].tolist(), begins[rest + 1].tolist()):
        piece = joined[x:y]
        j = seen.get(piece)
        if j is None:
            j = seen[piece] = len(distinct)
            distinct.append(piece)
        inverse[i] = j
    return distinct, inverse


#: Masks that keep the first 0 to 8 bytes of a little-endian word.
_LOW = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def ragged(offsets: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Positions of the elements of the rows ``which`` of a ragged array, one row after the other."""
    lengths = (offsets[1:] - offsets[:-1])[which]
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(offsets[:-1][which] - before, lengths) + np.arange(total)


class Vocabulary:
    """Ranks of a byte-level BPE; the rank of a token is its id."""

    def __init__(self, path: str = VOCABULARY):
        import tiktoken

        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = [b""] * (max(self.rank.values()) + 1)
        for k, v in self.rank.items():
            self.bytes_of[v] = k
        # The pattern isn't used: pieces come from starts_of.
        self.core = tiktoken.Encoding("pieces", pat_str=r"\S+|\s+", mergeable_ranks=self.rank, special_tokens={})._core_bpe
        self.dtype = np.dtype("<u2") if len(self.bytes_of) <= 1 << 16 else np.dtype("<u4")
        self.packed = Pieces(self)

    def piece(self, raw: bytes) -> list[int]:
        return self.core.encode_single_piece(raw)

    def encode(self, text: str) -> np.ndarray:
        return self.encode_batch([text])[0]

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        if not texts:
            return []
        ids, bounds = self.encode_flat(*batch_spans(texts))
        return np.split(ids, bounds[1:-1])

    def encode_flat(self, joined: str, begins: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a batch, and where those of each begin (with the end)."""
        distinct, inverse = intern(joined, begins)
        self.packed.trim()
        made = list(map(self.packed.__getitem__, distinct))
        offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, made), np.int64, len(made)) // self.dtype.itemsize)])
        flat = np.frombuffer(b"".join(made), self.dtype)
        lengths = np.diff(offsets)[inverse]
        keep = np.ones(len(inverse), bool)
        keep[first[1:] - 1] = False
        lengths[~keep] = 0
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return flat[ragged(offsets, inverse[keep])], np.append(ends[first], ends[-1])

    def decode_bytes(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode(self, ids) -> str:
        return self.decode_bytes(ids).decode("utf-8", "surrogatepass")


class Pieces(dict):
    """Piece of text -> its ids as bytes."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.of = vocabulary
        self.kind = "H" if vocabulary.dtype.itemsize == 2 else "I"

    def make(self, piece: str) -> bytes:
        return array(self.kind, self.of.piece(piece.encode("utf-8", "surrogatepass"))).tobytes()

    def __missing__(self, piece: str) -> bytes:
        made = self.make(piece)
        if len(piece) <= CACHE_CHARS:
            self[piece] = made
        return made

    def trim(self) -> None:
        if len(self) > CACHE_PIECES:
            self.clear()


@lru_cache(4)
def vocabulary(path: str = VOCABULARY) -> Vocabulary:
    """One per Python worker."""
    return Vocabulary(path)
