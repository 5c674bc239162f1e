"""Documents that contain windows of benchmark items, by a prefix-filtered join.

The set of a window is its runs of ``SHINGLE`` words.  A document that contains the window
contains all of them, so joining on one is enough: the prefix of a window is the one shingle
that is rarest in the documents.  Shingles of documents pass a bit table of bounded size first,
then Spark joins what is left with the windows by shingle; length and positional bounds drop
places where the window would stick out of the document, and the words themselves decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.bits import bits
from tessella.llm.store import keep, row_key, sized, table
from tessella.llm.text import NOT_ALNUM, Block, blocks
from tessella.plans.ship import ship

#: Words of a shingle; a window of fewer words is one shingle itself.
SHINGLE = 4


def _words(block: Block, low: int, high: int) -> str:
    """Words low to high of a block, lower-cased, joined by spaces."""
    return b" ".join(block.data[s:e].tobytes() for s, e in zip(block.starts[low:high], block.ends[low:high], strict=True)).decode()


def item_windows(items: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """(text, size, shingles, items): the distinct windows of all items, their shingle hashes in order, and the items that have them."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, _, block in blocks(batch, text_col, lower=True, separators=NOT_ALNUM):
                hashes, rows = block.hashes(), []
                for i in range(len(block)):
                    a, b = int(block.first[i]), int(block.first[i + 1])
                    size = min(window, b - a)
                    for at in range(a, b - size + 1) if size else ():
                        h = _shingles(hashes[at : at + size], min(SHINGLE, size))
                        rows.append((batch.column(0)[low + i].as_py(), _words(block, at, at + size), size, h.tolist()))
                item, text, size, shingles = zip(*rows, strict=True) if rows else ([],) * 4
                yield pa.RecordBatch.from_arrays([pa.array(item, batch.column(0).type), pa.array(text, pa.string()), pa.array(size, pa.int32()), pa.array(shingles, pa.list_(pa.int64()))], ["item", "text", "size", "shingles"])

    kind = dict(items.dtypes)[id_col]
    found = items.select(id_col, text_col).mapInArrow(cut, f"item {kind}, text string, size int, shingles array<long>")
    return found.groupBy("text").agg(F.first("size").alias("size"), F.first("shingles").alias("shingles"), F.collect_set(F.coalesce(F.col("item").cast("string"), F.lit(""))).alias("items"))


def _shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of ``size`` word hashes."""
    if len(hashes) < size:
        return np.zeros(0, np.int64)
    h = np.zeros(len(hashes) - size + 1, np.uint64)
    for j in range(size):
        h = h * np.uint64(0x100000001B3) + (hashes[j : len(hashes) - size + 1 + j] ^ np.uint64(size))
    return (h ^ (h >> np.uint64(29))).view(np.int64)


def _in_text(block: Block, h: np.ndarray, size: int) -> np.ndarray:
    """Which shingle starts have all their words in one text."""
    return np.arange(len(h)) + size <= np.repeat(block.first[1:], block.counts)[: len(h)]


def shingle_counts(docs: DataFrame, sizes: list[int], wanted, text_col: str) -> DataFrame:
    """(h, n): in how many places of ``docs`` each shingle stands that may be an item's; blocks add up their own first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, block in blocks(batch, text_col, lower=True, separators=NOT_ALNUM):
                hashes, found = block.hashes(), [np.zeros(0, np.int64)]
                for size in sizes:
                    h = _shingles(hashes, size)
                    hit = wanted.value.has(h)
                    found.append(h[hit & _in_text(block, h, size)])
                h, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n, pa.int64())], ["h", "n"])

    return docs.select(text_col).mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 13, share: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, n_words, n_hit, hit_items, contaminated) of each row of ``docs``.

    Words are runs of ASCII letters and digits and of anything above ASCII, with A-Z
    lower-cased.  A window is ``window`` consecutive words of an item, or all words of a
    shorter one; a document word inside any occurrence of a window is hit.  ``hit_items`` has
    the ids, as strings in ascending order, of items with an occurring window (a null item id
    as an empty string).  A document is contaminated if at least one word in ``share`` is hit.
    Null and empty texts have no words and are clean.  Each row has its own result, so rows may
    share an id or have none.  Without items, or without documents, nothing is hit.
    """
    ship(docs.sparkSession)
    items = items.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text"))
    # Windows of the same items share one list of them, which hits name by its hash.
    windows = keep(item_windows(items, window, "item", "text").withColumn("list", F.xxhash64(F.array_sort("items"))), "windows")
    lists = keep(windows.groupBy("list").agg(F.first("items").alias("items")), "lists")
    sizes = sorted({min(SHINGLE, r.size) for r in windows.select("size").distinct().collect()})  # at most ``window`` rows
    context = docs.sparkSession.sparkContext
    shingles = windows.select("text", "size", "list", F.posexplode("shingles").alias("at", "h"))
    counts = shingle_counts(docs, sizes, context.broadcast(bits(shingles.select("h"), shingles.count())), text_col)
    # The rarest shingle of each window is its prefix.
    ranked = shingles.join(counts, "h").groupBy("text").agg(F.min(F.struct("n", "at", "h")).alias("x"), F.first("size").alias("size"), F.first("list").alias("list"), F.count(F.lit(1)).alias("seen"))
    complete = F.col("seen") == F.col("size") - F.least("size", F.lit(SHINGLE)) + 1  # a shingle that no document has rules its window out
    prefixes = keep(ranked.where(complete).select("text", "size", "list", F.col("x.at").alias("at"), F.col("x.h").alias("h")), "prefixes")
    wanted = context.broadcast(bits(prefixes.select("h"), prefixes.count()))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, block in blocks(batch, "text", lower=True, separators=NOT_ALNUM):
                hashes = block.hashes()
                # Every row has one entry of its own, by a hash that spreads them; it joins with nothing.
                row, h, at, words, begin = [np.arange(low, high)], [_shingles(np.arange(low, high).view(np.uint64) + np.uint64(len(hashes)), 1)], [np.full(high - low, -1)], [None] * (high - low), [np.zeros(high - low, np.int64)]
                owner = block.owners()
                for size in sizes:
                    x = _shingles(hashes, size)
                    found = np.flatnonzero(wanted.value.has(x) & _in_text(block, x, size)) if len(x) else np.zeros(0, np.int64)
                    a = np.maximum(block.first[owner[found]], found - (window - size))
                    b = np.minimum(block.first[owner[found] + 1], found + window)
                    row.append(low + owner[found])
                    h.append(x[found])
                    at.append(found - block.first[owner[found]])
                    begin.append(a - block.first[owner[found]])
                    words += [_words(block, int(p), int(q)) for p, q in zip(a, b, strict=True)]
                n = np.concatenate([block.counts, np.zeros(len(words) - (high - low), np.int64)])
                row = np.concatenate(row)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(2).take(pa.array(row)), pa.array(n), *(pa.array(np.concatenate(x), pa.int64()) for x in (h, at, begin)), pa.array(words, pa.string())], ["id", "key", "n", "h", "at", "begin", "words"])

    kind = dict(docs.dtypes)[id_col]
    places = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), row_key(id_col, text_col).alias("key")).mapInArrow(probe, f"id {kind}, key long, n long, h long, at long, begin long, words string")
    p = prefixes.select("h", F.col("at").alias("inside"), "size", "list", F.concat(F.lit(" "), "text", F.lit(" ")).alias("window"))
    found = places.join(p, "h", "left")
    start = F.col("at") - F.col("inside")
    # The window's words must follow at that very place: the word before it ends where the window begins.
    skip = start - F.col("begin")
    cut = F.concat(F.lit(" "), F.array_join(F.slice(F.split("words", " "), (skip + 1).cast("int"), F.col("size")), " "), F.lit(" "))
    hit = F.col("window").isNotNull() & (F.col("at") >= 0) & (skip >= 0)
    hit = F.when(hit, F.when(cut == F.col("window"), F.struct(start.alias("low"), (start + F.col("size")).alias("high"), F.col("list").alias("list"))))
    # Rows of one key are equal, and so are their hits.
    rows = found.groupBy("id", "key").agg(F.max("n").alias("n_words"), F.sum((F.col("at") == -1).cast("int")).alias("copies"), F.collect_set(hit).alias("hits"))
    spans = F.array_sort(F.transform("hits", lambda x: F.struct(x["low"].alias("low"), x["high"].alias("high"))))
    covered = F.aggregate(
        spans,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")),
        lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0).cast("long"), x["high"] - F.greatest(x["low"], s["to"]))).alias("n"), F.greatest(s["to"], x["high"]).alias("to")),
        lambda s: s["n"],
    )
    rows = rows.select("id", "key", "copies", "n_words", covered.alias("n_hit"), F.explode_outer(F.array_distinct(F.transform("hits", lambda x: x["list"]))).alias("list"))
    rows = rows.join(sized(lists), "list", "left").groupBy("id", "key").agg(*(F.first(c).alias(c) for c in ("copies", "n_words", "n_hit")), F.flatten(F.collect_set("items")).alias("hit_items"))
    rows = rows.select("id", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))), "n_words", "n_hit", F.array_sort(F.array_distinct("hit_items")).alias("hit_items"))
    return rows.select(F.col("id").alias(id_col), "n_words", "n_hit", "hit_items", ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def query(spark, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), "contaminated")
