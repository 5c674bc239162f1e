"""Best-fit packing of token sequences, planned over a histogram of lengths.

The plan is made from one count for each length, so its size and cost do not depend on how
many documents there are.  Documents then take the planned slots: pieces of a length are
ranked, and slot r of that length belongs to the piece of rank r.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.store import keep, table
from tessella.llm.text import _BYTE, slices, spans_hash
from tessella.plans.ship import ship

#: A worker's table of encoded segments has 2 ** SLOTS places, for at most WIDTH ids each.
SLOTS = 20
WIDTH = 10
#: Pieces that are ranked in one group, about.
RANKED = 256
#: Bytes after which a space begins no segment: white space (ASCII), and what may begin other white space.
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_MAYBE = np.zeros(256, bool)
_MAYBE[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
#: Other ASCII but the space.
_OTHER = ~_LETTER
_OTHER[[32, *range(128, 256)]] = False


def _segments(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where segments begin: at each text, at each space that something other than white space follows, where
    a letter (ASCII) ends before another sign, and behind a single line break."""
    begins = np.zeros(len(data) + 3, bool)
    space = np.flatnonzero(data == 32)
    after = np.r_[data, np.zeros(3, np.uint8)]
    space = space[~_WHITE[after[space + 1]]]
    odd = _MAYBE[after[space + 1]]
    if odd.any():
        a, b, c = (after[space[odd] + k].astype(np.uint32) for k in (1, 2, 3))
        code = (a << 16) | (b << 8) | c
        # NEL, NBSP, OGHAM SPACE, U+2000-200A, U+2028, U+2029, U+202F, U+205F, U+3000
        white = (code >> 8 == 0xC285) | (code >> 8 == 0xC2A0) | (code == 0xE19A80) | ((code >= 0xE28080) & (code <= 0xE2808A)) | np.isin(code, [0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080])
        space = np.delete(space, np.flatnonzero(odd)[white])
    begins[space] = True
    # A text's last byte is followed by nothing.
    begins[offsets[1:][offsets[1:] > 0] - 1] = False
    begins[1 : len(data)] |= _LETTER[data[:-1]] & _OTHER[data[1:]]
    line = np.flatnonzero(data == 10)
    line = line[(line > 0) & (line + 1 < len(data))]
    alone = (data[line - 1] < 128) & ~_WHITE[data[line - 1]] & (data[line + 1] < 128) & ~_WHITE[data[line + 1]]
    begins[line[alone] + 1] = True
    begins[offsets[:-1]] = True
    return np.flatnonzero(begins[: len(data)])


class Encoder:
    """Ids of texts, encoded by segments; what a segment gave is looked up when it comes again.

    Byte-level BPE first cuts a text into runs of letters, of digits, of other signs and of
    white space, of which the first three may take one space before them, and never merges
    across a cut.  Segments begin at such cuts, so a text's ids are those of its segments, one
    after another.  They are told apart by a 64-bit hash; the table has a fixed size, and a
    new segment may take an older one's place.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.keys = np.zeros(1 << SLOTS, np.uint64)
        self.counts = np.zeros(1 << SLOTS, np.int64)
        self.pool = np.zeros((WIDTH << SLOTS) + (1 << 16), np.uint32)  # behind the places, room for segments of one call

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one after another; where those of each text begin, and the end)."""
        starts = _segments(data, offsets)
        ends = np.r_[starts[1:], len(data)][: len(starts)]
        h = spans_hash(_BYTE[data], starts, ends)
        first, second = (h >> np.uint64(64 - SLOTS)).astype(np.int64), (h & np.uint64((1 << SLOTS) - 1)).astype(np.int64)
        slot = np.where(self.keys[first] == h, first, second)
        new = np.flatnonzero(self.keys[slot] != h)
        n, at = self.counts[slot], slot * WIDTH
        if len(new):
            _, one, which = np.unique(h[new], return_index=True, return_inverse=True)
            one = new[one]
            found = [e.ids for e in self.tokenizer.encode_batch_fast([data[s:e].tobytes().decode() for s, e in zip(starts[one], ends[one], strict=True)], add_special_tokens=False)]
            length = np.array([len(x) for x in found])
            base = WIDTH << SLOTS
            begin = base + np.cumsum(length) - length
            if base + length.sum() > len(self.pool):
                self.pool = np.concatenate([self.pool[:base], np.zeros(length.sum(), np.uint32)])
            self.pool[base : base + length.sum()] = [i for x in found for i in x]
            n[new], at[new] = length[which], begin[which]
        total = np.cumsum(n)
        out = self.pool[np.arange(total[-1] if len(n) else 0) + np.repeat(at - total + n, n)]
        if len(new):
            short = length <= WIDTH
            one, begin, length = one[short], begin[short], length[short]
            place = np.where(self.keys[first[one]] == 0, first[one], second[one])
            place, k = np.unique(place, return_index=True)
            one, begin, length = one[k], begin[k], length[k]
            self.keys[place], self.counts[place] = h[one], length
            self.pool[: WIDTH << SLOTS].reshape(-1, WIDTH)[place] = self.pool[np.minimum(begin[:, None] + np.arange(WIDTH), len(self.pool) - 1)]
        return out, np.r_[0, total][np.searchsorted(starts, offsets)]


@cache
def encoder(path: str) -> Encoder:
    """One for each Python worker, whose table then serves all its tasks."""
    return Encoder(path)


def plan(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """Slots as (length, first rank, past the last rank, first sequence, offset), by best fit over counts.

    Lengths go from the longest down.  Open sequences with the same room are one group; a
    length fills the group of least sufficient room first, whole or in part, and opens new
    sequences for what remains, as many pieces in each as fit.  Each step ends a length or a
    group, so slots number at most a few for each pair of length and room.
    """
    rooms: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> (first sequence, how many)
    order: list[int] = []  # the rooms that have some, ascending
    slots, opened = [], 0

    def add(room: int, first: int, n: int) -> None:
        if room:
            if not rooms[room]:
                bisect.insort(order, room)
            rooms[room].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(order, length)
            if at < len(order):
                room = order[at]
                first, n = rooms[room].pop()
                if not rooms[room]:
                    order.pop(at)
                if n > left:
                    add(room, first + left, n - left)
                    n = left
            else:
                # As many new sequences as full ones of this length need; the last may take fewer.
                room, first = size, opened
                n = max(1, left // (size // length))
                opened += n
            slots.append((length, rank, rank + n, first, size - room))
            rank, left = rank + n, left - n
            add(room - length, first, n)
    return slots


def cut_pieces(counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, piece, start, length) of all pieces of texts of so many ids: whole if it fits, else all of ``size`` ids but the first, which may be shorter."""
    many = -(-counts // size)
    text = np.repeat(np.arange(len(counts)), many)
    piece = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    head = (counts - (many - 1) * size)[text]
    return text, piece, np.where(piece > 0, head + (piece - 1) * size, 0), np.where(piece > 0, size, head)


def pieces(docs: DataFrame, tokenizer: str, size: int, end_id: int, id_col: str, text_col: str, with_ids: bool) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]) of all texts."""
    ship(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokens = encoder(tokenizer)
        for batch in batches:
            for low, _, data, offsets in slices(batch, "text"):
                ids, first = tokens.encode(data, offsets)
                ids = np.insert(ids, first[1:], end_id).astype("<u4")
                text, piece, start, length = cut_pieces(np.diff(first) + 1, size)
                # Pieces follow each other in ``ids``.
                ends = 4 * np.cumsum(length)
                raw = memoryview(ids).cast("B")
                crc = [zlib.crc32(raw[a:b]) for a, b in zip((ends - 4 * length).tolist(), ends.tolist(), strict=True)]
                out = [batch.column(0).take(pa.array(low + text)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                if with_ids:
                    out.append(pa.Array.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(np.r_[0, ends].tobytes()), pa.py_buffer(ids.tobytes())]).cast(pa.binary()))
                yield pa.RecordBatch.from_arrays(out, names)

    names = ["id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(encode, f"id {source.dtypes[0][1]}, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else ""))


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset[, ids]) of each piece of each row.

    A row's ids are those of its text, then ``end_id``; a null or empty text is ``end_id``
    alone.  Rows longer than ``size`` are cut into pieces of ``size`` ids, the first of which
    may be shorter.  Every piece has a place of its own: pieces fill a sequence from offset 0
    without a gap.  Rows that are equal are packed once for each.
    """
    found = keep(pieces(docs, tokenizer, size, end_id, id_col, text_col, with_ids), "pieces")
    counts = {r.length: r.n for r in found.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # ``size`` rows at most
    slots = np.array(plan(counts, size), np.int64).reshape(-1, 5)
    # Groups of about RANKED pieces of a length, by a hash that spreads even equal rows' pieces.
    groups = np.ones(size + 1, np.int64)
    for length, n in counts.items():
        groups[length] = -(-n // RANKED)
    many = F.get(F.lit([int(g) for g in groups]), F.col("length").cast("int"))
    part = F.pmod(F.xxhash64("id", "piece", "ids_crc32"), many)
    found = found.withColumn("part", part)
    sizes = found.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("length", "part", before.alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "part").orderBy("id", "piece"))
    ranked = found.withColumn("within", within).join(sizes, ["length", "part"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("within") - 1).drop("part", "before", "within")
    # The plan has slots for pairs of length and room at most, so its size has a bound.
    shared = docs.sparkSession.sparkContext.broadcast(slots[np.lexsort((slots[:, 1], slots[:, 0]))])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = shared.value
        width = slots[:, 2].max() + 1
        keys = slots[:, 0] * width + slots[:, 1]
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(keys, length * width + rank, "right") - 1
            names = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(slots[at, 3] + rank - slots[at, 1]), pa.array(slots[at, 4])], [*names, "sequence_id", "offset"])

    columns = [c for c in ranked.columns if c != "rank"]
    out = ranked.mapInArrow(place, ", ".join(f"`{n}` {t}" for n, t in ranked.select(columns).dtypes) + ", sequence_id long, offset long")
    return out.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else []))


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)
