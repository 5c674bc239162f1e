"""The criteria grammar of the SUMIF family and of database functions, as predicates.

Matching is two-valued: what cannot be decided does not match.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators import aggregates as A
from tessella.plans.scratch import written

_OPERATOR = re.compile(r"^(<=|>=|<>|<|>|=)(.*)$", re.S)


def wildcard(pattern: str) -> str:
    """A regular expression for a pattern of ``*``, ``?`` and ``~`` escapes."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "~" and i + 1 < len(pattern):
            i += 1
            out += re.escape(pattern[i])
        else:
            out += {"*": ".*", "?": "."}.get(c, re.escape(c))
        i += 1
    return f"(?i)^{out}$"


def _number(text: str) -> float | None:
    try:
        return float(text)
    except ValueError:
        return None


def _text_equal(c: Column, text: str) -> Column:
    return c.rlike(wildcard(text)) if re.search(r"[*?~]", text) else F.lower(c) == text.lower()


def matches(x: Column | str, criterion, text_column: bool | None = None) -> Column:
    """Whether a value of column ``x`` meets a criterion given as a Python value.

    ``text_column`` says that the column holds text; without it, the column's type decides at
    run time.  ``<>`` with an operand matches cells of the operand's own kind alone, and an
    order comparison with text matches nothing.
    """
    c = F.col(x) if isinstance(x, str) else x
    kind = F.typeof(c)
    is_text = F.lit(text_column) if text_column is not None else kind == "string"
    n = F.when(~is_text & (kind != "boolean"), c.try_cast("double")) if text_column is None else (F.lit(None).cast("double") if text_column else c.try_cast("double"))
    s = F.when(is_text, c.cast("string")) if text_column is None else (c.cast("string") if text_column else F.lit(None).cast("string"))
    if criterion is None:
        return F.lit(False)
    if isinstance(criterion, bool):
        return F.coalesce((kind == "boolean") & (c.cast("string") == str(criterion).lower()), F.lit(False))
    if isinstance(criterion, (int, float)):
        return F.coalesce(n == float(criterion), F.lit(False))
    m = _OPERATOR.match(criterion)
    if not m:
        value = _number(criterion)
        found = _text_equal(s, criterion)
        return F.coalesce(found, F.lit(False)) if value is None else F.coalesce(found, F.lit(False)) | F.coalesce(n == value, F.lit(False))
    op, operand = m.groups()
    value = _number(operand)
    if operand == "" and op in ("=", "<>"):
        blank = c.isNull() | (c.cast("string") == "")
        return blank if op == "=" else ~blank
    if value is not None:
        compared = {"=": n == value, "<>": n != value, "<": n < value, "<=": n <= value, ">": n > value, ">=": n >= value}[op]
        return F.coalesce(compared, F.lit(False))
    if op == "=":
        return F.coalesce(_text_equal(s, operand), F.lit(False))
    if op == "<>":
        return F.coalesce(s.isNotNull() & ~_text_equal(s, operand), F.lit(False))
    return F.lit(False)


def all_of(criteria: dict) -> Column:
    """AND of a criterion for each column."""
    return reduce(lambda a, b: a & b, (matches(c, v) for c, v in criteria.items()), F.lit(True))


def database(df: DataFrame, criteria: list[dict]) -> DataFrame:
    """Rows that meet any of the criteria rows; empty criteria and unknown columns do not restrict."""
    known = {c.lower(): c for c in df.columns}
    rows = [{known[k.lower()]: v for k, v in row.items() if k.lower() in known and v not in (None, "")} for row in criteria]
    return df.where(reduce(lambda a, b: a | b, (all_of(r) for r in rows), F.lit(False))) if rows else df


#: Database functions by name, over the rows that ``database`` keeps.
DATABASE = {
    "DSUM": A.sum_, "DAVERAGE": A.average, "DCOUNT": A.count, "DCOUNTA": A.counta, "DMAX": A.max_, "DMIN": A.min_, "DPRODUCT": A.product,
    "DSTDEV": A.stdev_s, "DSTDEVP": A.stdev_p, "DVAR": A.var_s, "DVARP": A.var_p,
    "DGET": lambda x: F.when(F.count(F.lit(1)) == 1, F.first(F.col(x) if isinstance(x, str) else x)),
}


def by_criteria(df: DataFrame, criteria: DataFrame, keys: list[str], **aggregates: Column) -> DataFrame:
    """SUMIFS and its kin for a criterion in each row of ``criteria``: one aggregate by key, then a left join.

    Text keys compare without case.  Aggregates of no row are null.
    """
    types = dict(df.dtypes)
    fold = lambda c: F.lower(c) if types[c] == "string" else F.col(c)
    found = df.groupBy(*(fold(k).alias(f"_{k}") for k in keys)).agg(*(v.alias(n) for n, v in aggregates.items()))
    on = reduce(lambda a, b: a & b, ((F.lower(criteria[k]) if types[k] == "string" else criteria[k]) == found[f"_{k}"] for k in keys))
    return criteria.join(found, on, "left").drop(*(f"_{k}" for k in keys))


def by_operators(df: DataFrame, key: str, value: str, criteria: DataFrame, criterion: str) -> DataFrame:
    """SUMIFS and COUNTIFS for criteria such as ``>=5`` or ``<>2`` in a column: ``criteria`` with ``sum`` and ``count``.

    Values are summed by key first, with running totals in the order of keys; each criterion
    then needs the totals at the key nearest to its number, so no range is joined.  A criterion
    that is no number after its operator matches nothing.
    """
    from tessella.operators.lookup import nearest
    from tessella.operators.ranking import running_total

    each = df.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("double").alias("_key")).agg(F.coalesce(F.sum(F.col(value).cast("double")), F.lit(0.0)).alias("_own"), F.count(F.lit(1)).alias("_n"))
    upto = running_total(running_total(each, ["_key"], "_own", "_sum"), ["_key"], "_n", "_count")
    table = written(upto.select("_key", F.struct("_key", "_own", "_n", "_sum", "_count").alias("_at")), "criteria")
    whole = F.broadcast(table.agg(F.max_by("_at", "_key").alias("_all")))  # one row
    shape = r"^(<=|>=|<>|<|>|=)?(.*)$"
    c = F.col(criterion).cast("string")
    asked = criteria.withColumn("_op", F.coalesce(F.nullif(F.regexp_extract(c, shape, 1), F.lit("")), F.lit("="))).withColumn("_x", F.regexp_extract(c, shape, 2).try_cast("double"))
    found = nearest(asked, "_x", table, "_key", ["_at"]).join(whole)
    part = lambda name, own: (F.coalesce(F.col(f"_at.{name}"), F.lit(0)), F.when(F.col("_at._key") == F.col("_x"), F.col(f"_at.{own}")).otherwise(0), F.coalesce(F.col(f"_all.{name}"), F.lit(0)))

    def total(name: str, own: str) -> Column:
        below, at, every = part(name, own)
        by = {"=": at, "<>": every - at, "<=": below, "<": below - at, ">": every - below, ">=": every - below + at}
        return F.when(F.col("_x").isNull(), 0).otherwise(reduce(lambda rest, op: F.when(F.col("_op") == op, by[op]).otherwise(rest), by, F.lit(None)))

    return found.select(*criteria.columns, total("_sum", "_own").cast("double").alias("sum"), total("_count", "_n").cast("long").alias("count"))


def matching(df: DataFrame, key: str, patterns: DataFrame, pattern: str) -> DataFrame:
    """Wildcard lookup as a join: (all columns of both) where a text key matches a pattern of ``patterns``.

    Patterns meet only the distinct keys that share their first letters, without case, up to
    the first sign of the pattern, so a pattern that begins with one meets all distinct keys.
    """
    size = 3
    own = "_" * (1 + max(map(len, [*df.columns, *patterns.columns])))
    head = F.lower(F.regexp_extract(pattern, r"^[^*?~]*", 0))
    text = F.regexp_replace(F.col(pattern), r"([\\.+^$(){}\[\]|])", r"\\$1")
    # Escaped signs stand aside while the others become regular expressions.
    for escaped, aside in (("~*", "\x01"), ("~?", "\x02"), ("~~", "\x03")):
        text = F.replace(text, F.lit(escaped), F.lit(aside))
    for sign, regex in (("*", ".*"), ("?", "."), ("\x01", r"\*"), ("\x02", r"\?"), ("\x03", "~")):
        text = F.replace(text, F.lit(sign), F.lit(regex))
    asked = patterns.withColumn(f"{own}regex", F.concat(F.lit("(?is)^"), text, F.lit("$"))).withColumn(f"{own}head", F.substring(head, 1, size))
    keys = df.where(F.col(key).isNotNull()).select(F.col(key).alias(f"{own}key")).distinct()
    heads = keys.withColumn(f"{own}head", F.explode(F.transform(F.sequence(F.lit(0), F.lit(size)), lambda n: F.substring(F.lower(f"{own}key"), F.lit(1), n))))
    pairs = asked.join(heads.dropDuplicates(), f"{own}head").where(F.expr(f"`{own}key` rlike `{own}regex`"))
    return df.join(pairs.drop(f"{own}head", f"{own}regex").dropDuplicates(), F.col(key) == F.col(f"{own}key")).drop(f"{own}key")
