"""Quality rules for texts.

Every document gets plain counts and the mean log-likelihood ratio of its hashed words and
pairs of words under two multinomials: one of trusted documents, one of the whole corpus.
Both are counted over all documents into ``BUCKETS`` buckets, so the table of ratios has that
size at any scale.  How low a document may score follows from the trusted documents: each is
scored as if it were not trusted, and a quantile of these scores is the least score, by
language and length.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.store import keep, sized, table

#: Buckets that n-grams hash into, a power of two.
BUCKETS = 1 << 18
#: Lengths of the n-grams.
NGRAMS = (1, 2)
#: Weight of the corpus's own rate in the trusted rate, as a count: a bucket needs about so many expected words to say much.
PRIOR = 10.0
#: The least score is this quantile of the trusted documents' scores, each without its own words.
QUANTILE = 0.01
#: A language, or a length in it, has a least score of its own from so many trusted documents on.
ENOUGH = 200
#: Documents of fewer words fail the base rules, so they do not count for the quantile.
LEAST_WORDS = 50
#: Ratios and least scores are stored in thousandths.
SCALE = 1000

_SPACE = " \t\n\x0b\f\r"
_SPACES = "[ \t\n\x0b\f\r]+"


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(_SPACE))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, _SPACES)).otherwise(F.array().cast("array<string>"))


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _bucket(gram: Column) -> Column:
    return gram.bitwiseAND(F.lit(BUCKETS - 1).cast("long")).cast("int")


def _grams(hashes: Column) -> list[Column]:
    """For each n of ``NGRAMS``, the hashes of the n-grams in order, from the hashes of words."""
    out, gram = [], hashes
    for n in range(1, max(NGRAMS) + 1):
        if n > 1:
            rest = F.slice(hashes, F.lit(n), F.greatest(F.size(hashes) - (n - 1), F.lit(0)))
            gram = F.zip_with(F.slice(gram, F.lit(1), F.size(rest)), rest, lambda a, b: F.xxhash64(a, b))
        if n in NGRAMS:
            out.append(gram)
    return out


class Ratios:
    """Counts of each bucket in all documents and in trusted ones, and the log-likelihood ratios, in 1 / SCALE."""

    def __init__(self, raw: np.ndarray, good: np.ndarray) -> None:
        self.raw, self.good, self.n_raw, self.n_good = raw, good, int(raw.sum()), int(good.sum())
        self.table = self.of(np.arange(BUCKETS)).tolist() if self.n_good else [0] * BUCKETS

    def of(self, buckets: np.ndarray) -> np.ndarray:
        """Ratios of some buckets."""
        share = self.n_good / max(1, self.n_raw)
        return np.rint(SCALE * np.log((self.good[buckets] + PRIOR) / (self.raw[buckets] * share + PRIOR))).astype(np.int64)

    def held_out(self, grams: Column) -> Column:
        """The sum of a trusted document's ratios, in 1 / SCALE, as if it were not trusted, from its buckets in sorted order."""
        # Each table stands in the expression once: plans and their descriptions hold its literal.
        raw, good = (F.from_json(F.lit(str(x.tolist()).replace(" ", "")), "array<long>") for x in (self.raw, self.good))
        share = (F.lit(self.n_good) - F.size(grams)) / F.lit(float(max(1, self.n_raw)))
        # Equal buckets are neighbours; a run of them ends where another begins, the last one at a bucket that is none.
        ended = lambda s: s["own"] * F.rint(F.lit(float(SCALE)) * F.log((s["good"] - s["own"] + F.lit(PRIOR)) / (s["raw"] * share + F.lit(PRIOR))))
        state = lambda b, own, g, r, total: F.struct(b.alias("b"), own.alias("own"), g.alias("good"), r.alias("raw"), total.alias("sum"))
        none = F.lit(0).cast("long")
        return F.aggregate(
            F.concat(grams, F.array(F.lit(-1))),
            state(F.lit(-1), F.lit(0), none, none, F.lit(0.0)),
            lambda s, b: F.when(s["b"] == b, state(b, s["own"] + 1, s["good"], s["raw"], s["sum"])).otherwise(state(b, F.lit(1), F.coalesce(F.get(good, b), none), F.coalesce(F.get(raw, b), none), s["sum"] + F.when(s["own"] > 0, ended(s)).otherwise(0.0))),
            lambda s: s["sum"],
        )


def ratio_table(marked: DataFrame) -> Ratios:
    """Counts over ``marked`` (good, text); ``good`` is null for rows that are not trusted."""
    hashed = marked.select("good", _hashes(_words(F.col("text"))).alias("h"))
    grams = hashed.select("good", F.explode(F.concat(*_grams(F.col("h")))).alias("gram"))
    counts = grams.select("good", _bucket(F.col("gram")).alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("raw"), F.count("good").alias("good"))
    raw, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for r in counts.toLocalIterator():  # BUCKETS rows at most
        raw[r.b], good[r.b] = r.raw, r.good
    return Ratios(raw, good)


def _band(n_words: Column) -> Column:
    """Lengths from one power of two to the next."""
    return (F.length(F.bin(n_words)) - 1).cast("int")


def least_scores(marked: DataFrame, ratios: Ratios, quantile: float) -> dict[tuple[str | None, int | None], float]:
    """By language and length band, by language (band null), and of all (both null): the quantile of held-out scores.

    ``marked`` has (good, text, lang).  At most that share of a group's trusted documents is below its least score.
    """
    hashed = marked.where("good is not null").select("lang", _hashes(_words(F.col("text"))).alias("h"))
    long = hashed.where(F.size("h") >= LEAST_WORDS).select("lang", _band(F.size("h")).alias("band"), F.sort_array(F.transform(F.concat(*_grams(F.col("h"))), _bucket)).alias("grams"))
    score = F.floor(ratios.held_out(F.col("grams")) / F.size("grams")).cast("int").alias("score")
    counts = long.select("lang", "band", score).groupBy("lang", "band", "score").agg(F.count(F.lit(1)).alias("n"))
    key = lambda lang, band: F.struct(F.lit(lang).cast("string").alias("lang") if lang is None else F.col(lang).alias("lang"), F.lit(band).cast("int").alias("band") if band is None else F.col(band).alias("band"))
    # Rows without a language count for all alone.
    keys = F.when(F.col("lang").isNull(), F.array(key(None, None))).otherwise(F.array(key(None, None), key("lang", None), key("lang", "band")))
    every = keep(counts.select(F.explode(keys).alias("key"), "score", "n").groupBy("key", "score").agg(F.sum("n").alias("n")), "held_out")
    # Windows are over scores in thousandths, not over documents.
    by = Window.partitionBy("key")
    placed = every.withColumn("upto", F.sum("n").over(by.orderBy("score"))).withColumn("all", F.sum("n").over(by))
    first = placed.where(F.col("upto") > quantile * F.col("all")).groupBy("key", "all").agg(F.min("score").alias("score"))
    return {(r.key.lang, r.key.band): r.score / SCALE for r in first.where((F.col("all") >= ENOUGH) | F.col("key.lang").isNull()).collect()}


def score(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = QUANTILE) -> DataFrame:
    """``docs`` in a column ``row``, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr and kept.

    ``trusted`` has the ids of trusted documents.  Words are runs of anything but ASCII white
    space; a null text has none.  ``llr`` is the mean log ratio of a document's words and pairs
    of words, 0 without words.  A document is kept unless the base rules fail it or ``llr`` is
    below the least score of its language and length; where too few trusted documents are of
    these, that of its language counts, and then that of all, as for tables without
    ``lang_col``.  Without trusted documents every ratio is 0, and the base rules decide.  Each
    row has its own result, so rows may share an id or have none.
    """
    lang = F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    marks = keep(trusted.select(F.col(id_col).alias("id")).where("id is not null").distinct().withColumn("good", F.lit(1)), "trusted")
    # Rows without an id match nothing; where the join shuffles, their texts spread them.
    salt = F.when(F.col(id_col).isNull(), F.pmod(F.xxhash64(text_col), F.lit(1000)) + 1).otherwise(0)
    marks = marks.withColumn("salt", F.lit(0).cast("long"))
    marked = docs.select(F.col(id_col).alias("id"), salt.alias("salt"), F.coalesce(text_col, F.lit("")).alias("text"), lang.alias("lang")).join(sized(marks), ["id", "salt"], "left")
    ratios = ratio_table(marked)
    least = least_scores(marked, ratios, quantile) if ratios.n_good else {}
    # One foldable literal each: the optimiser parses it once.
    lookup = F.from_json(F.lit(str(ratios.table).replace(" ", "")), "array<int>")
    known = F.from_json(F.lit(json.dumps({f"{g}/{'' if n is None else n}": x for (g, n), x in least.items() if g is not None})), "map<string,double>")
    band = _band(F.col("n_words"))
    lowest = F.coalesce(F.try_element_at(known, F.concat("lang", F.lit("/"), band)), F.try_element_at(known, F.concat("lang", F.lit("/"))), F.lit(least.get((None, None), float("-inf"))))
    t = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), lang.alias("lang"), F.coalesce(text_col, F.lit("")).alias("text"))
    t = t.select("row", "lang", "text", _words(F.col("text")).alias("words"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.btrim(x, F.lit(_SPACE))) > 0)
    t = t.select(
        "row",
        "lang",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        _hashes(F.col("words")).alias("h"),
    )
    triples = F.slice(F.transform("h", lambda x, i: F.xxhash64(x, F.get("h", i + 1), F.get("h", i + 2))), F.lit(1), F.greatest(F.size("h") - 2, F.lit(0)))
    total = F.aggregate(F.concat(*_grams(F.col("h"))), F.lit(0).cast("long"), lambda s, x: s + F.get(lookup, _bucket(x)))
    grams = F.lit(0).cast("long")
    for n in NGRAMS:
        grams = grams + F.greatest(F.col("n_words") - (n - 1), F.lit(0))
    t = t.select(
        *("row", "lang", "n_words", "word_chars", "n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(total / F.lit(float(SCALE)) / F.when(F.col("n_words") > 0, grams), F.lit(0.0)).alias("llr"),
        triples.alias("triples"),
    )
    # Only texts with a repeated window are sorted: equal windows are then neighbours.
    placed = F.when(F.size(F.array_distinct("triples")) < F.size("triples"), F.sort_array(F.transform("triples", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    t = t.withColumn("placed", placed).drop("triples")
    same = lambda x, j: F.coalesce(F.get("placed", j)["h"] == x["h"], F.lit(False))
    repeated = F.filter("placed", lambda x, j: same(x, j - 1) | same(x, j + 1))
    t = t.withColumn("at", F.sort_array(F.transform(repeated, lambda x: x["i"]))).drop("placed")
    covered = F.aggregate(
        "at",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda s, i: F.struct((s["n"] + 3 - F.greatest(F.lit(0), s["to"] - i)).alias("n"), (i + 3).alias("to")),
        lambda s: s["n"],
    )
    t = t.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("at")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    t = t.withColumn("base_failed", failed)
    results = ("row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr")
    # A row number is not deterministic for the optimiser, so it neither moves a caller's filter
    # below this projection nor repeats the scores in it for every element of every list.
    held = F.struct(*results, (~failed & (F.col("llr") >= lowest)).alias("kept"), F.monotonically_increasing_id().alias("number"))
    return t.select(held.alias("held")).select(*(F.col(f"held.{c}").alias(c) for c in (*results, "kept")))


def kept_rows(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``score`` keeps, unchanged."""
    return score(docs, trusted, id_col, text_col).where("kept").select("row.*")


def trusted(labels: DataFrame) -> DataFrame:
    """Ids that the labels call good and not toxic."""
    return labels.where("quality = 1 and coalesce(toxic, 0) = 0").select("doc_id")


def query(spark, sf_dir: str) -> DataFrame:
    found = score(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), trusted(table(spark, sf_dir, "labels")))
    return found.select("row.doc_id", *(c for c in found.columns if c not in ("row", "llr")))
