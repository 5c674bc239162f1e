"""Language of a text: its family first, then the language within the family.

Both levels are one-versus-one linear support vector machines over relative counts of hashed
byte n-grams of the lower-cased text.  They are fitted on a bounded sample of labelled texts,
``SAMPLE`` of each language about, chosen by a hash of the id; every text is then scored whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.store import table
from tessella.plans.ship import ship

SAMPLE = 600
#: Texts of all languages together, about; beyond, each language gets an equal share.
SAMPLE_ALL = 12_000
#: Features: hashed n-grams of one to three bytes.
SIZE = 1 << 12
NGRAMS = (1, 2, 3)
#: Bytes that are scored at once.
BLOCK = 1 << 20
#: Families of languages by ISO 639-1 code; a language in none is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bg", "mk"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "indic": ("hi", "mr", "ne", "bn", "pa", "gu"),
    "semitic": ("ar", "he", "mt"),
    "sinitic": ("zh", "yue"),
}


def family(lang: str) -> str:
    base = lang.split("-")[0].lower()
    return next((f for f, members in FAMILIES.items() if base in members), lang)


def _texts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row past the last, bytes, offsets) of lower-cased texts, about ``BLOCK`` bytes or one text at a time."""
    texts = pc.utf8_lower(column.cast(pa.large_string()).fill_null(""))
    if not len(texts):
        return
    _, where, content = texts.buffers()
    offsets = np.frombuffer(where, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(content, np.uint8) if content is not None else np.zeros(0, np.uint8)
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + BLOCK, "right")) - 1)
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def _grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n: the feature of the n-gram at each byte, and which n-grams lie in one text."""
    x = data.astype(np.uint32)
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(data))
    code = np.zeros(len(data), np.uint32)
    for n in NGRAMS:
        code = code.copy()
        code[: len(x) - n + 1] |= x[n - 1 :] << np.uint32(8 * (n - 1))
        yield ((code + np.uint32(n << 24)) * np.uint32(2654435761)) >> np.uint32(32 - SIZE.bit_length() + 1), left >= n


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Relative counts of each text's n-grams."""
    out = np.zeros((len(offsets) - 1, SIZE), np.float32)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    for f, inside in _grams(data, offsets):
        np.add.at(out, (rows[inside], f[inside]), 1)
    return out / np.maximum(1, np.diff(offsets)).astype(np.float32)[:, None]


def fit_pair(x: np.ndarray, y: np.ndarray, rounds: int = 300, penalty: float = 1e-3) -> tuple[np.ndarray, float, float]:
    """(weights, bias, steepness): a linear SVM with squared hinge loss for y in {-1, 1}, by accelerated gradient.

    Classes weigh the same.  The steepness turns a margin into a probability.
    """
    mean, scale = x.mean(0), x.std(0) + 1e-4
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))]).astype(np.float64)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    v = np.ones(z.shape[1])
    for _ in range(20):  # largest eigenvalue, for the step
        v = z.T @ (weight * (z @ v))
        v /= np.linalg.norm(v)
    step = 1 / (2 * np.linalg.norm(z.T @ (weight * (z @ v))) + penalty)
    w, ahead = np.zeros(z.shape[1]), np.zeros(z.shape[1])
    for k in range(rounds):
        slack = np.maximum(0, 1 - y * (z @ ahead))
        new = ahead - step * (penalty * np.r_[ahead[:-1], 0] - 2 * z.T @ (weight * y * slack))
        w, ahead = new, new + k / (k + 3) * (new - w)
    margin = y * (z @ w)
    steep = min((float((weight * np.log1p(np.exp(-a * margin))).sum()), a) for a in (0.5, 1.0, 2.0, 3.0, 4.0, 6.0))[1]
    real = w[:-1] / scale
    return real, float(w[-1] - real @ mean), steep


class Model:
    """Pairs of families, and of languages within each family."""

    def __init__(self, x: np.ndarray, langs: list[str]) -> None:
        families = [family(g) for g in langs]
        self.pairs: list[tuple[str, str]] = []
        fitted = []
        self.families = {f: sorted({g for g in langs if family(g) == f}) for f in sorted(set(families))}
        for names, labels in [(sorted(self.families), families), *((members, langs) for members in self.families.values())]:
            for a, b in combinations(names, 2):
                rows = np.array([i for i, g in enumerate(labels) if g in (a, b)])
                y = np.array([1.0 if labels[i] == a else -1.0 for i in rows])
                self.pairs.append((a, b))
                fitted.append(fit_pair(x[rows], y))
        self.weights = np.array([f[0] for f in fitted], np.float32).reshape(-1, SIZE)
        self.bias = np.array([f[1] for f in fitted])
        self.steep = np.array([f[2] for f in fitted])

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(texts, pairs): margins from sums over all n-grams."""
        out = np.zeros((len(offsets) - 1, len(self.pairs)))
        for f, inside in _grams(data, offsets):
            for k in range(len(self.pairs)):
                sums = np.zeros(len(data) + 1)
                np.cumsum(np.where(inside, self.weights[k][f], 0), out=sums[1:], dtype=np.float64)
                out[:, k] += sums[offsets[1:]] - sums[offsets[:-1]]
        return out / np.maximum(1, np.diff(offsets))[:, None] + self.bias

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        margins = self.margins(data, offsets)
        prob = 1 / (1 + np.exp(-np.clip(self.steep * margins, -30, 30)))
        column = {p: k for k, p in enumerate(self.pairs)}

        def choose(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
            """(index of the name with most votes, then the largest sum of margins; its least probability against another)."""
            if len(names) == 1:
                return np.zeros(len(margins), int), np.ones(len(margins))
            votes, least = np.zeros((len(margins), len(names))), np.ones((len(margins), len(names)))
            for i, j in combinations(range(len(names)), 2):
                k = column[(names[i], names[j])]
                for side, sign, p in ((i, 1, prob[:, k]), (j, -1, 1 - prob[:, k])):
                    votes[:, side] += (sign * margins[:, k] > 0) + 1e-3 * np.tanh(sign * margins[:, k])
                    least[:, side] = np.minimum(least[:, side], p)
            best = votes.argmax(1)
            return best, least[np.arange(len(margins)), best]

        names = list(self.families)
        best, score = choose(names)
        out = np.empty(len(margins), object)
        for i, members in enumerate(self.families.values()):
            rows = np.flatnonzero(best == i)
            inner, p = choose(members)
            out[rows] = [members[k] for k in inner[rows]]
            score[rows] = score[rows] * p[rows]
        return list(out), score


def fit(docs: DataFrame, sample: int, id_col: str, text_col: str, lang_col: str) -> Model | None:
    """A model from about ``sample`` texts of each language, ``SAMPLE_ALL`` in all; None without labelled texts."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in known.groupBy(lang_col).count().collect()}  # a row for each language
    if not counts:
        return None
    sample, rate = min(sample, -(-SAMPLE_ALL // len(counts))), F.lit(0.0)
    for lang, n in counts.items():
        rate = F.when(F.col(lang_col) == lang, F.lit(min(1.0, sample / n))).otherwise(rate)
    chosen = known.where(F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(7)), F.lit(1 << 20)) < rate * (1 << 20))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in _texts(batch.column(1)):
                rows = [x.tobytes() for x in features(data, offsets)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[low:high].cast(pa.string()), batch.column(2)[low:high], pa.array(rows, pa.binary())], ["id", "lang", "x"])

    rows = chosen.select(F.col(id_col).cast("string"), text_col, lang_col).mapInArrow(count, "id string, lang string, x binary").collect()
    rows = sorted(rows, key=lambda r: (r.lang, r.id or "", r.x))
    return Model(np.array([np.frombuffer(r.x, np.float32) for r in rows]).reshape(-1, SIZE), [r.lang for r in rows]) if rows else None


def predict(docs: DataFrame, training: Column, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, lang_pred, score) of each row of ``docs``, from its text alone.

    ``training`` says which rows may be learnt from; of these, rows without language or text
    are not.  ``lang_pred`` is a language of the training rows, or ``und`` with score 0 where
    the text is null or has no letter, or nothing could be learnt.  ``score`` is the
    probability of the family times that of the language in it, each its least against
    another.  Each row has its own result, so rows may share an id or have none; a row for
    which ``training`` is null is not learnt from.  With one language, that is all to predict.
    """
    ship(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit(docs.where(training), sample, id_col, text_col, lang_col))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in _texts(batch.column(1)):
                pred, score = model.value.predict(data, offsets) if model.value else (["und"] * (high - low), np.zeros(high - low))
                letters = np.r_[0, np.cumsum((data - 97 < 26) & (data >= 97))]
                for i in np.flatnonzero(letters[offsets[1:]] == letters[offsets[:-1]]):
                    if not any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode()):
                        pred[i], score[i] = "und", 0.0
                yield pa.RecordBatch.from_arrays([batch.column(0)[low:high], pa.array(pred, pa.string()), pa.array(np.asarray(score, float))], ["id", "pred", "score"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(look, f"`{id_col}` {kind}, lang_pred string, score double")


def query(spark, sf_dir: str) -> DataFrame:
    # A row without id is held out: nothing is learnt from it.
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(True))
    found = predict(table(spark, sf_dir, "documents"), ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
