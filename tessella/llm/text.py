"""Words, hashes and shingles of a column of texts, a block of Arrow memory at a time.

Every function works on UTF-8 bytes: the separators of all word definitions used here are
ASCII, and no byte of a multi-byte character is ASCII, so cutting bytes equals cutting
characters.  A block holds about ``BLOCK`` bytes, or one longer text by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 2 << 20
#: Values that are hashed at once.
SLICE = 1 << 17

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _table(pattern: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(pattern)] = True
    return out


#: ``[^\x20\x09-\x0D]+``: words between ASCII white space.
SPACE = _table(b" \t\n\x0b\x0c\r")
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing: digits, letters and all above ASCII.
NOT_ALNUM = _table(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
#: Lower-cases A-Z alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    if len(_powers[0]) < n:
        made = []
        for base in (_BASE, _BASE_INV):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            made.append(np.cumprod(p, dtype=np.uint64))
        if n > 8 * SLICE:  # one very long text; not kept
            return made[0], made[1]
        _powers[:] = made
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rabin-Karp hash of each span of ``values``, from prefix sums: O(1) a span.

    Spans are sorted by start and by end; some at a time are hashed, so that the sums stay in cache.
    """
    out, low = np.empty(len(starts), np.uint64), 0
    while low < len(starts):
        base = starts[low]
        high = max(low + 1, int(np.searchsorted(ends, base + SLICE, "right")))
        n = int(ends[high - 1] - base)
        up, down = powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values[base : base + n] * up[:n], out=sums[1:], dtype=np.uint64)
        s, e = starts[low:high] - base, ends[low:high] - base
        out[low:high] = mix((sums[e] - sums[s]) * down[s])
        low = high
    return out


class Block:
    """Some texts: their bytes, offsets and words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool, separators: np.ndarray) -> None:
        self.raw, self.offsets = data, offsets
        self.data = LOWER[data] if lower else data
        word = ~separators[self.data]
        before = np.zeros(len(word), bool)
        before[1:] = word[:-1]
        before[offsets[:-1][offsets[:-1] < len(word)]] = False
        self.starts = np.flatnonzero(word & ~before)
        after = np.zeros(len(word), bool)
        after[:-1] = word[1:]
        after[offsets[1:][offsets[1:] > 0] - 1] = False
        self.ends = np.flatnonzero(word & ~after) + 1
        #: Words of text i are first[i] to first[i + 1].
        self.first = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owners(self) -> np.ndarray:
        """The text that each word is in."""
        return np.repeat(np.arange(len(self)), self.counts)

    def hashes(self) -> np.ndarray:
        return spans_hash(_BYTE[self.data], self.starts, self.ends)

    def text_hashes(self) -> np.ndarray:
        """Of whole texts, as they are."""
        return spans_hash(_BYTE[self.raw], self.offsets[:-1], self.offsets[1:])

    def windows(self, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Where each run of ``size`` words inside one text begins, and its Rabin-Karp hash."""
        at = np.arange(len(hashes))
        at = at[at + size <= np.repeat(self.first[1:], self.counts)]
        return at, spans_hash(hashes, at, at + size)


def slices(batch: pa.RecordBatch, column: str, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row past the last, bytes, offsets) of some texts of a batch at a time; null counts as empty."""
    texts = batch.column(batch.schema.get_field_index(column)).cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    _, where, content = texts.buffers()
    offsets = np.frombuffer(where, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(content, np.uint8) if content is not None else np.zeros(0, np.uint8)
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def blocks(batch: pa.RecordBatch, column: str, limit: int = BLOCK, lower: bool = False, separators: np.ndarray = SPACE) -> Iterator[tuple[int, int, Block]]:
    """(first row, row past the last, Block) over the texts of a batch; null counts as empty."""
    for low, high, data, offsets in slices(batch, column, limit):
        yield low, high, Block(data, offsets, lower, separators)
