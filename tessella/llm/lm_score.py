"""Log-likelihood of texts under a unigram model of subword pieces, over all segmentations.

The pieces are an existing vocabulary's.  No vocabulary of a unigram model is at hand, so in
place of a unigram file's scores, probabilities start from the order of a BPE vocabulary and
are re-estimated on the training texts by expectation maximisation.  A text is a sequence of
words, each a space and its bytes, and an end.  The likelihood of a word is the sum over all
ways to cut it into pieces, by forward recursion in log space, so it is worked out once for
each distinct word and weighted by its count.

Documents meet the table of words in two ways: the ``FREQUENT`` most frequent words, a table
of fixed size, go to all tasks, and all other words are joined by Spark.  So a word that
stands in every document makes no row to shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.store import keep, row_key, table
from tessella.llm.text import _BYTE, blocks, spans_hash
from tessella.plans.ship import ship

FREQUENT = 1 << 16
ROUNDS = 2
#: Added to each expected count.
SMOOTH = 0.1
#: Words of more bytes are gone through some bytes at a time, with one number kept for each byte.
LONG = 1 << 14


class Pieces:
    """The pieces of a vocabulary file by hash, and the log probability of each."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        found: dict[bytes, int] = {bytes([b]): 0 for b in range(256)}  # a piece for each byte covers any text
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or "▁" in piece[1:]):
                found[piece.replace("▁", " ").encode()] = i
        text = sorted(found, key=lambda x: (len(x), x))
        ends = np.cumsum([len(x) for x in text])
        h = spans_hash(_BYTE[np.frombuffer(b"".join(text), np.uint8)], ends - [len(x) for x in text], ends)
        length = np.array([len(x) for x in text])
        self.longest, self.tables = int(length.max()), {}
        for n in np.unique(length):
            ids = np.flatnonzero(length == n)
            ids = ids[np.argsort(h[ids])]
            self.tables[int(n)] = (h[ids], ids)
        self.n = len(text)
        rank = np.array([found[x] if len(x) > 1 else model.get_piece_size() for x in text], float)
        self.logp = -np.log(rank + 10)
        self.logp -= np.logaddexp.reduce(self.logp)

    def at(self, data: np.ndarray, last: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(length, piece that begins at each byte, or -1); ``last`` is where each byte's word ends."""
        out, where = [], np.arange(len(data))
        for n, (h, ids) in self.tables.items():
            found = np.full(len(data), -1)
            ok = where[where + n <= last]
            if len(ok):
                x = spans_hash(_BYTE[data], ok, ok + n)
                k = np.minimum(np.searchsorted(h, x), len(h) - 1)
                found[ok] = np.where(h[k] == x, ids[k], -1)
            out.append((n, found))
        return out


def _edges(data: np.ndarray, pieces: Pieces, logp: np.ndarray, low: int, high: int) -> tuple[np.ndarray, ...]:
    """(where it begins, length, piece, its log probability) of each piece that begins from ``low`` on and before ``high``."""
    some = data[low : high + pieces.longest]
    at = [(np.flatnonzero(p[: high - low] >= 0), n, p) for n, p in pieces.at(some, np.full(len(some), len(some)))]
    begin = np.concatenate([k for k, _, _ in at])
    order = np.argsort(begin, kind="stable")
    piece = np.concatenate([p[k] for k, _, p in at])[order]
    return begin[order] + low, np.concatenate([np.full(len(k), n) for k, n, _ in at])[order], piece, logp[piece]


def _add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def long_word(word: bytes, pieces: Pieces, logp: np.ndarray, count: float | None = None) -> float | np.ndarray:
    """As ``lattice``, of one very long word."""
    data, longest = np.frombuffer(b" " + word, np.uint8), pieces.longest
    ahead = np.full(len(data) + 1 + longest, -np.inf)
    ahead[0] = 0
    lows = range(0, len(data), LONG)
    for low in lows:
        begin, length, _, score = _edges(data, pieces, logp, low, min(len(data), low + LONG))
        a = ahead[low : low + LONG + longest].tolist()
        for i, n, s in zip((begin - low).tolist(), length.tolist(), score.tolist(), strict=True):
            a[i + n] = _add(a[i + n], a[i] + s)
        ahead[low : low + LONG + longest] = a
    likelihood = float(ahead[len(data)])
    if count is None:
        return likelihood
    behind, expected = np.full(len(ahead), -np.inf), np.zeros(pieces.n)
    behind[len(data)] = 0
    for low in reversed(lows):
        begin, length, piece, score = _edges(data, pieces, logp, low, min(len(data), low + LONG))
        b = behind[low : low + LONG + longest].tolist()
        for i, n, s in zip((begin - low)[::-1].tolist(), length[::-1].tolist(), score[::-1].tolist(), strict=True):
            b[i] = _add(b[i], s + b[i + n])
        behind[low : low + LONG + longest] = b
        expected += np.bincount(piece, np.exp(ahead[begin] + score + behind[begin + length] - likelihood) * count, pieces.n)
    return expected


def lattice(words: list[bytes], pieces: Pieces, logp: np.ndarray, counts: np.ndarray | None = None) -> np.ndarray:
    """The natural log likelihood of each word; with ``counts``, the expected count of each piece instead."""
    long = np.array([len(w) > LONG for w in words], bool)
    if long.any():
        parts = [long_word(words[i], pieces, logp, None if counts is None else float(counts[i])) for i in np.flatnonzero(long)]
        short = [w for w, far in zip(words, long, strict=True) if not far]
        rest = lattice(short, pieces, logp, None if counts is None else counts[~long]) if short else 0.0
        if counts is not None:
            return rest + sum(parts)
        out = np.empty(len(words))
        out[long], out[~long] = parts, rest
        return out
    order = np.argsort([-len(w) for w in words], kind="stable")
    length = np.array([len(words[i]) for i in order]) + 1
    data = np.frombuffer(b"".join(b" " + words[i] for i in order), np.uint8)
    end = np.cumsum(length)
    start = end - length
    found = [(n, p, np.where(p >= 0, logp[p], -np.inf)) for n, p in pieces.at(data, np.repeat(end, length)) if (p >= 0).any()]
    # Nodes of word w are start[w] + w to end[w] + w: one more than its bytes.
    node, total = start + np.arange(len(words)), len(data) + len(words)
    ahead = np.full(total, -np.inf)
    ahead[node] = 0
    active = np.searchsorted(-length, -np.arange(1, length[0] + 1), "right")  # words of at least j bytes come first
    for j in range(1, int(length[0]) + 1):
        w = slice(0, active[j - 1])
        terms = [ahead[node[w] + j - n] + s[start[w] + j - n] for n, _, s in found if n <= j]
        ahead[node[w] + j] = np.logaddexp.reduce(terms, axis=0)
    likelihood = ahead[node + length]
    if counts is None:
        out = np.empty(len(words))
        out[order] = likelihood
        return out
    behind = np.full(total, -np.inf)
    behind[node + length] = 0
    for j in range(int(length[0]) - 1, -1, -1):
        # Words of more than j bytes; a piece must not run past a word's end, which its score rules out.
        w = slice(0, active[j])
        terms = [np.where(np.isfinite(s[start[w] + j]), s[start[w] + j] + behind[np.minimum(node[w] + j + n, total - 1)], -np.inf) for n, _, s in found]
        behind[node[w] + j] = np.logaddexp.reduce(terms, axis=0)
    expected = np.zeros(pieces.n)
    byte_node = np.arange(len(data)) + np.repeat(np.arange(len(words)), length)
    weight = np.repeat(counts[order], length)
    whole = np.repeat(likelihood, length)
    for n, p, s in found:
        k = np.flatnonzero(p >= 0)
        g = np.exp(ahead[byte_node[k]] + s[k] + behind[byte_node[k] + n] - whole[k]) * weight[k]
        expected += np.bincount(p[k], g, pieces.n)
    return expected


def _batches(batch: pa.RecordBatch, word: int) -> Iterator[tuple[int, list[bytes]]]:
    """Some words at a time, a bounded number of bytes."""
    texts, low, size = batch.column(word).to_pylist(), 0, 0
    for i, w in enumerate(texts):
        size += len(w) + 1
        if size > 1 << 17 or i == len(texts) - 1:
            yield low, texts[low : i + 1]
            low, size = i + 1, 0


def count_words(docs: DataFrame, training: Column, text_col: str) -> DataFrame:
    """(h, word, c): the distinct words of all texts by hash, with their count in those of the ``training`` rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            train = np.array(batch.column(1).to_pylist(), bool)
            for low, _, block in blocks(batch, "text", lower=True):
                h = block.hashes()
                values, first, inverse = np.unique(h, return_index=True, return_inverse=True)
                c = np.bincount(inverse, train[low + block.owners()], len(values)).astype(np.int64)
                words = [block.data[s:e].tobytes() for s, e in zip(block.starts[first], block.ends[first], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(words, pa.binary()), pa.array(c)], ["h", "word", "c"])

    found = docs.select(F.col(text_col).alias("text"), training.alias("train")).mapInArrow(count, "h long, word binary, c long")
    return found.groupBy("h").agg(F.min("word").alias("word"), F.sum("c").alias("c"))


def fit(words: DataFrame, pieces: Pieces, texts: int, rounds: int) -> tuple[np.ndarray, float]:
    """(log probability of each piece, that of the end), from words with counts and the number of texts."""
    context, logp, end = words.sparkSession.sparkContext, pieces.logp, -math.log(2)
    known = words.where("c > 0").select("word", "c")
    for _ in range(rounds):
        model = context.broadcast((pieces, logp))  # the size of the vocabulary

        def expect(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            pieces, logp = model.value
            total = np.zeros(pieces.n)
            for batch in batches:
                c = batch.column(1).to_numpy().astype(float)
                for low, some in _batches(batch, 0):
                    total += lattice(some, pieces, logp, c[low : low + len(some)])
            k = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total[k])], ["piece", "n"])

        rows = known.mapInArrow(expect, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
        n = np.full(pieces.n, SMOOTH)
        for r in rows:
            n[r.piece] += r.n
        everything = math.log(n.sum() + texts + SMOOTH)
        logp, end = np.log(n) - everything, math.log(texts + SMOOTH) - everything
    return logp, end


def score(docs: DataFrame, training: Column, vocabulary: str, rounds: int = ROUNDS, frequent: int = FREQUENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row of ``docs``.

    Texts are lower-cased (A-Z) and cut at ASCII white space; each ends with one end token.  A
    null or empty text is the end alone.  ``training`` says which rows are learnt from, and
    ``held_out`` is its negation.  ``base_score`` is the log10 likelihood under word counts
    with 0.5 added; ``score`` that under the pieces.  Each row has its own result, so rows may
    share an id or have none; a row for which ``training`` is null is not learnt from.  An
    empty table gives no row; without training rows no word is known.
    """
    ship(docs.sparkSession)
    train = F.coalesce(training, F.lit(False))
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), train.alias("train"), row_key(id_col, text_col).alias("key"))
    texts = source.where("train").count()
    words = keep(count_words(source, F.col("train"), "text"), "words")
    pieces = Pieces(vocabulary)
    logp, end = fit(words, pieces, texts, rounds)
    context = docs.sparkSession.sparkContext
    model = context.broadcast((pieces, logp))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, logp = model.value
        for batch in batches:
            p = [lattice(some, pieces, logp) for _, some in _batches(batch, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.concatenate(p) / math.log(10))], ["h", "c", "p"])

    weighed = keep(words.mapInArrow(weigh, "h long, c long, p double"), "weighed")
    tokens, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    n, v = tokens + texts, distinct + (texts > 0)
    total = math.log10(n + 0.5 * (v + 1))
    top = weighed.orderBy(F.desc("c"), "h").limit(frequent).toPandas().sort_values("h")  # ``frequent`` rows at most
    shared = context.broadcast((top.h.to_numpy(np.int64), top.c.to_numpy(float), top.p.to_numpy(float)))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, logs = shared.value
        for batch in batches:
            for low, high, block in blocks(batch, "text", lower=True):
                h, owner = block.hashes().view(np.int64), block.owners()
                k = np.minimum(np.searchsorted(keys, h), max(0, len(keys) - 1))
                hit = keys[k] == h if len(keys) else np.zeros(len(h), bool)
                k, o = k[hit], owner[hit]
                known = np.bincount(o, counts[k] > 0, len(block)).astype(np.int64)
                base = np.bincount(o, np.log10(counts[k] + 0.5), len(block))
                by_piece = np.bincount(o, logs[k], len(block))
                # One row for each text with what it has so far, then one for each other word of it.
                order = np.lexsort((h[~hit], owner[~hit]))
                h, o = h[~hit][order], owner[~hit][order]
                new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (o[1:] != o[:-1])]) if len(h) else np.zeros(0, np.int64)
                times = np.diff(np.r_[new, len(h)])
                row = np.r_[np.arange(low, high), low + o[new]]
                zero = np.zeros(len(new))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(row)),
                        pa.array(np.r_[np.arange(low, high) * 0x9E3779B97F4A7C1, h[new]]),
                        pa.array(np.r_[np.zeros(len(block), np.int64), times]),
                        pa.array(np.r_[block.counts, zero].astype(np.int64)),
                        pa.array(np.r_[known, zero].astype(np.int64)),
                        pa.array(np.r_[base, zero]),
                        pa.array(np.r_[by_piece, zero]),
                        pa.array(np.r_[np.ones(len(block), np.int64), zero.astype(np.int64)]),
                        batch.column(2).take(pa.array(row)),
                        batch.column(3).take(pa.array(row)),
                    ],
                    ["id", "h", "times", "words", "known", "base", "p0", "rows", "train", "key"],
                )

    kind = dict(docs.dtypes)[id_col]
    parts = source.select("id", "text", "train", "key").mapInArrow(look_up, f"id {kind}, h long, times long, words long, known long, base double, p0 double, rows long, train boolean, key long")
    found = parts.join(weighed, "h", "left")
    some = F.col("times") > 0
    # Rows of one key are equal; sums over them are shared out.
    sums = found.groupBy("id", "key").agg(
        F.sum("rows").alias("rows"),
        F.sum("words").alias("words"),
        F.sum(F.col("known") + F.when(some & (F.col("c") > 0), F.col("times")).otherwise(0)).alias("known"),
        F.sum(F.col("base") + F.when(some, F.col("times") * F.log10(F.col("c") + 0.5)).otherwise(0.0)).alias("base"),
        F.sum(F.col("p0") + F.when(some, F.col("times") * F.col("p")).otherwise(0.0)).alias("p"),
        F.min("train").alias("train"),
    )
    each = lambda x: (F.col(x) / F.col("rows")).cast("long")
    n_tokens = each("words") + 1
    return sums.select(
        F.col("id").alias(id_col),
        (~F.col("train")).alias("held_out"),
        n_tokens.alias("n_tokens"),
        (each("known") + int(texts > 0)).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") / F.col("rows") + math.log10(texts + 0.5) - n_tokens * total).alias("base_score"),
        (F.col("p") / F.col("rows") + end / math.log(10)).alias("score"),
        F.explode(F.array_repeat(F.lit(0), F.col("rows").cast("int"))).alias("_"),
    ).drop("_")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    training = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1
    return score(table(spark, sf_dir, "documents"), training, public_tokenizers.path("piece_bpe_32k.model"))
