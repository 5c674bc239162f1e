"""Personal identifiers: fixed forms, and unseen forms found by the contexts of known ones.

The fixed forms are seeds, and loosely shaped strings are candidates.  The words before either
are patterns; a pattern is worth what share of its occurrences in the whole corpus is followed
by good instances of its kind, and an instance is as good as its confident patterns make it.
Spark scores the two sides of this graph in turns: seeds make the first patterns confident,
these make candidates good, and candidates that are good make further patterns confident,
which need not precede any seed.  Candidates after confident patterns become identifiers too.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.bits import bits
from tessella.llm.store import keep, row_key, sized, table
from tessella.llm.text import _BYTE, SPACE, blocks, spans_hash
from tessella.plans.ship import ship

KINDS = ("email", "ip", "card", "phone")
#: A pattern needs so many different seeds, in so many documents, and such a share of its occurrences.
SUPPORT = 5
CONFIDENCE = 0.8
ROUNDS = 6
#: What a candidate is worth to a pattern before a confident pattern speaks for it.
UNKNOWN = 0.5
#: Characters before an identifier that are looked at for the words of its patterns; longer words give none.
LOOK_BACK = 120
#: Documents with identifiers whose places may be broadcast for redaction; more are joined by shuffling.
FEW_SPANS = 1 << 17

# The fixed forms.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

# Loose forms of each kind; only a pattern of high confidence makes them identifiers.
_LOOSE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]{1,64}(?: ?[(\[{]at[)\]}] ?)[A-Za-z0-9-]{1,64}(?:(?:\.| ?[(\[{]dot[)\]}] ?)[A-Za-z0-9-]{1,64})+", re.I),
    "ip": re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])"),
    "card": re.compile(r"(?<![0-9A-Za-z+])[0-9]{4}(?:[./_][0-9]{4}){2}[./_][0-9]{1,7}(?![0-9A-Za-z])"),
    "phone": re.compile(r"(?<![0-9A-Za-z+.-])(?:\([0-9]{2,4}\)|[0-9]{2,5})(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9A-Za-z.-])"),
}
_HINT = re.compile(r"[(\[{]at[)\]}]", re.I)
_BEFORE = re.compile(r"(?:([^ \t-\r]+)[ \t-\r]+)?([^ \t-\r]+)[ \t-\r]+[(\[\"']?$")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of ``[A-Za-z0-9._%+-]+`` before a match of ``_DOMAIN``, leftmost and apart; linear in the text."""
    last = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            last = m.end()
            yield start, last


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed forms, by start and then kind."""
    found = [(s, e, "email") for s, e in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        found += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m.group().split("."))] if "." in text else []
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = re.sub(r"[^0-9]", "", m.group())
                if 12 <= len(digits) <= 19 and _luhn(digits):
                    found.append((m.start(), m.end(), "card"))
        if "+" in text:
            found += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def loose_spans(text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """(start, end, kind) of loosely shaped strings that no fixed form overlaps."""
    digits = _DIGIT.search(text)
    out, covered = [], []
    for s, e, _ in sorted(taken):
        if covered and s <= covered[-1][1]:
            covered[-1] = (covered[-1][0], max(e, covered[-1][1]))
        else:
            covered.append((s, e))
    for kind in KINDS:
        if (kind != "email" and digits) or (kind == "email" and _HINT.search(text)):
            for m in _LOOSE[kind].finditer(text):
                s, e = m.span()
                at = bisect.bisect(covered, (s, e))
                free = (at == 0 or covered[at - 1][1] <= s) and (at == len(covered) or covered[at][0] >= e)
                if free and (kind != "phone" or 9 <= sum(c.isdigit() for c in m.group()) <= 15):
                    out.append((s, e, kind))
                    covered.insert(at, (s, e))
    return out


def _contexts(text: str, start: int) -> list[str]:
    """The one and the two words that stand before a place, lower-cased (A-Z)."""
    low = max(0, start - LOOK_BACK)
    m = _BEFORE.search(text, low, start)
    if not m or m.start(2) == low > 0:
        return []
    lower = lambda x: x.encode().lower().decode()  # noqa: E731  A-Z alone
    return [lower(m[2])] + ([lower(f"{m[1]} {m[2]}")] if m[1] and m.start(1) > low else [])


def pattern_hash(words: list[str]) -> np.ndarray:
    """The hash that one or two words have in a block of text, as a signed number."""
    out = []
    for w in words:
        parts = [x.encode() for x in w.split(" ")]
        h = np.concatenate([spans_hash(_BYTE[np.frombuffer(p, np.uint8)], np.array([0]), np.array([len(p)])) for p in parts])
        out.append(h[0] if len(h) == 1 else spans_hash(h, np.array([0]), np.array([2]))[0])
    return np.array(out, np.uint64).view(np.int64)


_SPAN = "array<struct<start:long,end:long,kind:string>>"
_FOUND = "array<struct<start:long,end:long,kind:string,seed:boolean,value:string,h:long,size:int>>"


def occurrences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, base, found): fixed forms of each row, and with each pattern before it every fixed or loose form."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            for low in range(0, len(batch), 512):
                base, found = [], []
                for text in batch.column(1)[low : low + 512].fill_null("").to_pylist():
                    spans = base_spans(text)
                    base.append([{"start": s, "end": e, "kind": k} for s, e, k in spans])
                    rows = []
                    for s, e, k, seed in [(*x, True) for x in spans] + [(*x, False) for x in loose_spans(text, spans)]:
                        for words in _contexts(text, s):
                            if words not in known:
                                if len(known) > 100_000:
                                    known.clear()
                                known[words] = int(pattern_hash([words])[0])
                            rows.append({"start": s, "end": e, "kind": k, "seed": seed, "value": re.sub(r"[^0-9A-Za-z@]", "", text[s:e]).lower(), "h": known[words], "size": 1 + (" " in words)})
                    found.append(rows)
                span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])
                more = pa.struct([*span, pa.field("seed", pa.bool_()), pa.field("value", pa.string()), pa.field("h", pa.int64()), pa.field("size", pa.int32())])
                yield pa.RecordBatch.from_arrays([batch.column(0)[low : low + 512], batch.column(2)[low : low + 512], pa.array(base, pa.list_(span)), pa.array(found, pa.list_(more))], ["id", "key", "base", "found"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col, row_key(id_col, text_col).alias("key")).mapInArrow(scan, f"id {kind}, key long, base {_SPAN}, found {_FOUND}")


def pattern_totals(docs: DataFrame, patterns: DataFrame, text_col: str) -> DataFrame:
    """(h, total): how often each pattern's words occur in all texts."""
    patterns = patterns.select("h").distinct()
    wanted = docs.sparkSession.sparkContext.broadcast(bits(patterns, patterns.count()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, block in blocks(batch, text_col, lower=True, separators=SPACE):
                one = block.hashes()
                h = np.concatenate([one, block.windows(one, 2)[1]])
                h, n = np.unique(h[wanted.value.has(h)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n, pa.int64())], ["h", "n"])

    found = docs.select(text_col).mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("total"))
    return found.join(patterns, "h", "left_semi")


def confident_patterns(docs: DataFrame, found: DataFrame, text_col: str, rounds: int, support: int, confidence: float) -> DataFrame:
    """(kind, h) of patterns that scoring in turns leaves at ``confidence`` or more, until two turns add none."""
    edges = found.select("key", F.explode("found").alias("x")).select("key", "x.kind", "x.h", "x.value", "x.seed")
    edges = keep(edges.groupBy("kind", "h", "value").agg(F.count(F.lit(1)).alias("n"), F.max("seed").alias("seed"), F.max("key").alias("key")), "edges")
    several = edges.groupBy("kind", "h").agg(F.count(F.lit(1)).alias("values"), F.approx_count_distinct("key").alias("docs"), F.sum("n").alias("most")).where((F.col("values") >= support) & (F.col("docs") >= support))
    # Were all its instances good, a pattern would be worth this at most.
    patterns = keep(several.join(pattern_totals(docs, several, text_col), "h").where(F.col("most") >= confidence * F.col("total")).select("kind", "h", "total"), "patterns")
    edges = edges.join(patterns.select("kind", "h"), ["kind", "h"], "left_semi")
    good = edges.select("kind", "value", F.when(F.col("seed"), 1.0).otherwise(UNKNOWN).alias("good")).groupBy("kind", "value").agg(F.max("good").alias("good"))
    confident, known = patterns.select("kind", "h").limit(0), [-1, 0]
    for _ in range(0 if patterns.isEmpty() else rounds):
        scores = edges.join(good, ["kind", "value"]).groupBy("kind", "h").agg(F.sum(F.col("n") * F.col("good")).alias("worth"), F.count_if(F.col("good") >= confidence).alias("supporting"))
        score = F.least(F.lit(1.0), F.col("worth") / F.col("total"))
        confident = keep(patterns.join(scores, ["kind", "h"]).select("kind", "h", score.alias("score"), "supporting").where((F.col("score") >= confidence) & (F.col("supporting") >= support)), "confident")
        known.append(confident.count())
        if known[-1] == known[-2] == known[-3]:
            break
        # An instance is bad only if all its confident patterns are; seeds stay good.
        miss = F.exp(F.sum(F.log1p(-F.least(F.coalesce("score", F.lit(0.0)), F.lit(0.999)))))
        good = keep(edges.join(confident, ["kind", "h"], "left").groupBy("kind", "value").agg(F.when(F.max("seed"), F.lit(1.0)).otherwise(F.greatest(F.lit(UNKNOWN), 1 - miss)).alias("good")), "instances")
    return confident.select("kind", "h")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """(id, base, spans) of each row of ``docs``: its fixed forms, and those with what patterns add, as (start, end, kind).

    Places count code points, the end excluded; spans go by start, then by kind as in
    ``KINDS``.  A null or empty text has none.  Each row has its own result, so rows may share
    an id or have none; equal rows have equal results.  Words longer than ``LOOK_BACK``
    characters give no pattern.  A table without identifiers, or an empty one, has no patterns.
    """
    return keyed(docs, id_col, text_col, rounds, support, confidence).select(F.col("id").alias(id_col), "base", "spans")


def keyed(docs: DataFrame, id_col: str, text_col: str, rounds: int = ROUNDS, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """(id, key, base, spans) as in ``find``; the key is the hash of a row's id and text."""
    ship(docs.sparkSession)
    found = keep(occurrences(docs, id_col, text_col), "occurrences")
    patterns = confident_patterns(docs, found, text_col, rounds, support, confidence)
    loose = found.select("key", F.explode("found").alias("x")).where("not x.seed").select("key", "x.*")
    extra = loose.join(patterns, ["kind", "h"], "left_semi").groupBy("key").agg(F.collect_set(F.struct("start", "end", "kind")).alias("extra"))
    order = F.array(*map(F.lit, KINDS))
    rank = lambda x: F.struct(x["start"].alias("start"), F.array_position(order, x["kind"]).alias("rank"), x["end"].alias("end"), x["kind"].alias("kind"))
    spans = F.transform(F.sort_array(F.transform(F.concat("base", F.coalesce("extra", F.array().cast(_SPAN))), rank)), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))
    return found.join(extra, "key", "left").select("id", "key", "base", spans.alias("spans"))


def _joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with each identifier of its texts replaced by its kind in angle brackets; overlapping ones as one, named after the first."""
    # Names that no column of the table has.
    own = "_" * (1 + max(map(len, docs.columns)))
    key, spans = f"{own}key", f"{own}spans"
    # Rows of one key share id and text, so one row's spans are those of all.
    found = keyed(docs.select(id_col, text_col), id_col, text_col).where(F.size("spans") > 0).groupBy(F.col("key").alias(key)).agg(F.first("spans").alias(spans))
    out = docs.join(sized(keep(found, "redactions"), FEW_SPANS), row_key(id_col, text_col) == F.col(key), "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = batch.column(at).to_pylist()
            for i, found in enumerate(batch.column(batch.schema.get_field_index(spans)).to_pylist()):
                if found:
                    texts[i] = _replace(texts[i], [(x["start"], x["end"], x["kind"]) for x in found])
            columns = [pa.array(texts, batch.column(at).type) if k == at else batch.column(k) for k in range(len(batch.schema)) if batch.schema.names[k] != spans]
            yield pa.RecordBatch.from_arrays(columns, [n for n in batch.schema.names if n != spans])

    return out.select(*docs.columns, spans).mapInArrow(cut, docs.schema)


def _replace(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, last = [], 0
    for s, e, kind in spans:
        if s >= last:
            out += [text[last:s], f"<{kind.upper()}>"]
        last = max(last, e)
    return "".join([*out, text[last:]])


def query(spark, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(k) for k in KINDS), F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))


def digest(spans: list[tuple[int, int, str]]) -> str:
    """``base_sha256`` of spans in order."""
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in spans).encode()).hexdigest()
