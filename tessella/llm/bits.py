"""A table of bits that tells most values apart that cannot be in a set; its size has a bound."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Most bits of a table: 16 MiB to each executor.
MOST = 27


class Bits:
    """Bits for 64-bit hashes; ``has`` is never False for a value of the set."""

    def __init__(self, size: int, packed: bytes) -> None:
        self.size, self.packed, self.table = size, packed, None

    def has(self, h: np.ndarray) -> np.ndarray:
        if self.table is None:
            self.table = np.unpackbits(np.frombuffer(self.packed, np.uint8)).view(bool)
        return self.table[slots(h, self.size)]

    def __getstate__(self) -> dict:
        return {"size": self.size, "packed": self.packed, "table": None}


def slots(h: np.ndarray, size: int) -> np.ndarray:
    return (h.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - size)


def bits(hashes: DataFrame, count: int) -> Bits:
    """Of the one long column of ``hashes``, which holds about ``count`` values; tasks send slots, never more than the table has."""
    size = int(np.clip(np.ceil(np.log2(16 * max(1, count))), 10, MOST))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(1 << size, bool)
        for batch in batches:
            found[slots(batch.column(0).to_numpy(zero_copy_only=False), size)] = True
        at = np.flatnonzero(found)
        # Bits of a part of the table in one row.
        part, first = np.unique(at >> 13, return_index=True)
        rows = [(at[a:b] & 8191).astype(np.uint16).tobytes() for a, b in zip(first, np.r_[first[1:], len(at)][: len(first)], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(rows, pa.binary())], ["part", "at"])

    out = np.zeros(1 << size, bool)
    for r in hashes.mapInArrow(mark, "part long, at binary").toLocalIterator():
        out[(r.part << 13) + np.frombuffer(r.at, np.uint16).astype(np.int64)] = True
    return Bits(size, np.packbits(out).tobytes())
