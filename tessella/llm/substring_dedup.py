"""Removal of passages that repeat an earlier one, within a document or between documents.

Every window of ``window`` consecutive words gets a Rabin-Karp hash.  A task writes each hash
that its block holds once, with the earliest place, into a bucket of the hash space; Spark
gathers the buckets, and a window that is not its hash's earliest occurrence is repeated.
The repeated windows of a document merge into maximal intervals, whose words go.

A window that stands in a third of all documents costs its bucket one entry for each block
read, not one for each document: blocks settle their own repeats before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.store import input_bytes, table
from tessella.llm.text import Block, blocks, mix
from tessella.plans.ship import ship

#: Bytes of text whose windows a task settles at once, and bytes of text for each bucket.
SETTLED = 6 << 20
BUCKET_BYTES = 10 << 20
_NO_ID = np.iinfo(np.int64).min


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of one length, byte plane by byte plane, so that empty planes cost nothing."""
    planes = [c.view(np.uint8).reshape(len(c), c.dtype.itemsize).T.tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _unpack(packed: bytes, *kinds: type) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    sizes = [np.dtype(k).itemsize for k in kinds]
    n, out, at = len(raw) // sum(sizes), [], 0
    for kind, size in zip(kinds, sizes, strict=True):
        out.append(np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).view(kind).ravel())
        at += n * size
    return out


def _pack_windows(h: np.ndarray, doc: np.ndarray, start: np.ndarray) -> bytes:
    """``h`` is sorted; its differences and the distance of ids from the least are small numbers."""
    low = doc.min() if len(doc) else np.int64(0)
    return np.int64(low).tobytes() + _pack(np.diff(h, prepend=np.uint64(0)), (doc - low).astype(np.uint64), start.astype(np.uint32))


def _unpack_windows(packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h, doc, start = _unpack(packed[8:], np.uint64, np.uint64, np.uint32)
    return np.cumsum(h, dtype=np.uint64), doc.astype(np.int64) + np.frombuffer(packed[:8], np.int64)[0], start


def _repeated(h: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For windows sorted by hash, document and start: the first of each hash, and those that come later than it."""
    first = np.ones(len(h), bool)
    first[1:] = h[1:] != h[:-1]
    leader = np.flatnonzero(first)[np.cumsum(first) - 1]
    return first, (doc != doc[leader]) | (start != start[leader])


def _parts(doc: np.ndarray, start: np.ndarray, bits: int) -> Iterator[tuple[int, bytes]]:
    """Places packed by a hash of their document, ``2**bits`` parts at most."""
    part = (mix(doc.view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)
    order = np.lexsort((doc, part))
    part, doc, start = part[order], doc[order], start[order]
    cuts = np.flatnonzero(np.diff(part)) + 1
    for low, high in zip(np.r_[0, cuts], np.r_[cuts, len(doc)], strict=True) if len(doc) else ():
        yield int(part[low]), _pack(doc[low:high], start[low:high].astype(np.uint32))


def _document(id_col: str, text_col: str) -> Column:
    """The id as a whole number; for a row without one, a number below those of all others that follows from its text."""
    own = F.lit(int(_NO_ID)) + F.xxhash64(text_col).bitwiseAND(F.lit((1 << 62) - 1))
    return F.coalesce(F.col(id_col).try_cast("long"), own)


def repeated_windows(docs: DataFrame, window: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, starts): for each id that has some, the places of windows that occur earlier too, packed."""
    bits = max(5, int(np.ceil(np.log2(max(1, input_bytes(docs, text_col) / BUCKET_BYTES)))))
    shift = np.uint64(64 - bits)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for low, high, block in blocks(batch, "text", SETTLED):
                at, h = block.windows(block.hashes(), window)
                owner = block.owners()[at]
                doc, start = ids[low:high][owner], (at - block.first[owner]).astype(np.uint32)
                order = np.lexsort((start, doc)) if np.any(np.diff(doc) < 0) else np.arange(len(h))
                order = order[np.argsort(h[order], kind="stable")]
                h, doc, start = h[order], doc[order], start[order]
                first, again = _repeated(h, doc, start)
                rows = [(part, True, packed) for part, packed in _parts(doc[again], start[again], bits)]
                h, doc, start = h[first], doc[first], start[first]
                bucket = (h >> shift).astype(np.int64)
                cuts = np.searchsorted(bucket, np.arange((1 << bits) + 1))
                rows += [(b, False, _pack_windows(h[lo:hi], doc[lo:hi], start[lo:hi])) for b, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if hi > lo]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.bool_()), pa.array([r[2] for r in rows], pa.binary())], ["bucket", "settled", "packed"])

    def gather(found: pa.Table) -> pa.Table:
        settled, packed = found.column("settled").to_pylist(), found.column("packed").to_pylist()
        rows = [(found.column("bucket")[0].as_py(), p) for done, p in zip(settled, packed, strict=True) if done]
        lists = [_unpack_windows(p) for done, p in zip(settled, packed, strict=True) if not done]
        if lists:
            h, doc, start = (np.concatenate(x) for x in zip(*lists, strict=True))
            del lists
            order = np.argsort(h, kind="stable")
            h, doc, start = h[order], doc[order], start[order]
            shared = np.zeros(len(h), bool)
            same = h[1:] == h[:-1]
            shared[1:] |= same
            shared[:-1] |= same
            h, doc, start = h[shared], doc[shared], start[shared]
            order = np.lexsort((start, doc, h))
            h, doc, start = h[order], doc[order], start[order]
            _, again = _repeated(h, doc, start)
            rows += _parts(doc[again], start[again], bits)
        return pa.table({"part": pa.array([r[0] for r in rows], pa.int64()), "packed": pa.array([r[1] for r in rows], pa.binary())})

    def by_document(found: pa.Table) -> pa.Table:
        doc, start = (np.concatenate(x) for x in zip(*(_unpack(p.as_py(), np.int64, np.uint32) for p in found.column("packed")), strict=True))
        order = np.argsort(doc, kind="stable")
        doc, start = doc[order], start[order]
        cuts = np.flatnonzero(np.diff(doc)) + 1
        low, high = np.r_[0, cuts], np.r_[cuts, len(doc)]
        return pa.table({"id": pa.array(doc[low]), "starts": pa.array([_pack(start[a:b]) for a, b in zip(low, high, strict=True)], pa.binary())})

    found = docs.select(_document(id_col, text_col).alias("doc"), F.col(text_col).alias("text")).mapInArrow(settle, "bucket long, settled boolean, packed binary")
    places = found.groupBy("bucket").applyInArrow(gather, "part long, packed binary")
    return places.groupBy("part").applyInArrow(by_document, "id long, starts binary")


def remove_repeats(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row of ``docs`` as (id, n_words, n_removed, kept_text): its text without the words that a repeated window covers.

    The earliest occurrence (least id, then least start) stays.  Rows without an id come first,
    in an order that follows from their texts; ids below -2**62 are not told from them.
    Windows are judged on the input, so a passage goes even where it overlaps another that
    goes.  Words are runs of anything but ASCII white space; a null text has none.  Texts of
    fewer than ``window`` words have no window.  Rows that share an id count as one document:
    equal rows do not remove each other, and a place that goes in one of them goes in all.
    ``kept_text`` joins the kept words by one space.

    Windows compare by a 64-bit hash, one for each place: among n windows, n * n / 2**65
    chance matches are to be expected (0.0005 in 10**8 windows).
    """
    ship(docs.sparkSession)
    starts = repeated_windows(docs, window, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), _document(id_col, text_col).alias("_key"))
    rows = rows.join(starts.withColumnRenamed("id", "_key"), "_key", "left").select("id", "text", "starts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = batch.column(2)
            for low, high, block in blocks(batch, "text"):
                yield _cut(block, batch.column(0)[low:high], places[low:high], window)

    kind = dict(docs.dtypes)[id_col]
    return rows.mapInArrow(cut, f"`{id_col}` {kind}, n_words long, n_removed long, kept_text string")


def _cut(block: Block, ids: pa.Array, places: pa.Array, window: int) -> pa.RecordBatch:
    edges = np.zeros(len(block.starts) + 1, np.int64)
    for i, found in enumerate(places.to_pylist()):
        if found is not None:
            at = block.first[i] + _unpack(found, np.uint32)[0].astype(np.int64)
            at = at[at + window <= block.first[i + 1]]
            np.add.at(edges, at, 1)
            np.add.at(edges, at + window, -1)
    gone = np.cumsum(edges[:-1]) > 0
    removed = np.diff(np.r_[0, np.cumsum(gone)][block.first])
    # A kept word takes along the separator behind it, as a space; the last one of a text may have none.
    s, e = block.starts[~gone], block.ends[~gone]
    last = block.offsets[1:][block.owners()[~gone]]
    data, inside = block.raw.copy(), np.zeros(len(block.raw) + 1, np.int64)
    data[e[e < last]] = 32
    inside[s] += 1
    np.add.at(inside, np.minimum(e + 1, last), -1)
    mask = np.cumsum(inside[:-1]) > 0
    ends = np.r_[0, np.cumsum(mask)][block.offsets]
    data = data[mask]
    trailing = np.zeros(len(block), np.int64)
    some = ends[1:] > ends[:-1]
    trailing[some] = data[ends[1:][some] - 1] == 32
    if trailing.any():
        keep = np.ones(len(data), bool)
        keep[ends[1:][trailing > 0] - 1] = False
        data = data[keep]
        ends = ends - np.r_[0, np.cumsum(trailing)]
    kept = pa.Array.from_buffers(pa.large_string(), len(block), [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())])
    return pa.RecordBatch.from_arrays([ids, pa.array(block.counts), pa.array(removed), kept.cast(pa.string())], [str(i) for i in range(4)])


def query(spark, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
