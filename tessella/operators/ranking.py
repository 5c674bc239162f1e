"""Positions, ranks and order statistics of whole tables, without one task that sorts it all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.plans.scratch import few, written


def with_position(df: DataFrame, order: list[Column | str], name: str = "position") -> DataFrame:
    """``df`` with each row's place, from 1, in a total order.

    Rows are dealt into ranges of the order and numbered within each; the sizes of earlier
    ranges, one number for each range, are then added.  A small table is numbered by one task.
    """
    if few(df):
        return df.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    # The id is the range's number above 33 bits, and the row's number in it below.
    numbered = written(sorted_.withColumn("_id", F.monotonically_increasing_id()), "position")
    part, within = F.shiftright("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
    sizes = numbered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = numbered.withColumn("_part", part).join(F.broadcast(sizes.select("_part", before.alias("_before"))), "_part")
    return out.withColumn(name, F.col("_before") + within + 1).drop("_id", "_part", "_before")


def with_rank(df: DataFrame, x: str, ascending: bool = False, average: bool = False, name: str = "rank") -> DataFrame:
    """RANK.EQ or RANK.AVG of a column over the whole table: counts by value, then values in order."""
    values = df.where(F.col(x).isNotNull()).groupBy(x).agg(F.count(F.lit(1)).alias("_n"))
    placed = running_total(values, [F.col(x) if ascending else F.col(x).desc()], "_n", "_to")
    rank = F.col("_to") - F.col("_n") + 1
    placed = placed.select(F.col(x).alias("_x"), (rank + (F.col("_n") - 1) / 2 if average else rank).alias(name))
    return df.join(placed, df[x] == placed["_x"], "left").drop("_x")


def running_total(df: DataFrame, order: list[Column | str], x: str, name: str = "running") -> DataFrame:
    """SUM(A$1:A1) filled down: the sum of ``x`` up to each row, by ranges of the order; a small table in one task."""
    if few(df):
        return df.withColumn(name, F.coalesce(F.sum(x).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "running")
    sizes = ranged.groupBy("_part").agg(F.sum(x).alias("_s"))
    before = F.coalesce(F.sum("_s").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = F.broadcast(sizes.select("_part", before.alias("_before")))
    own = F.sum(x).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return ranged.withColumn("_own", own).join(sizes, "_part").withColumn(name, F.col("_before") + F.coalesce("_own", F.lit(0))).drop("_part", "_own", "_before")


def order_statistics(df: DataFrame, x: str, ranks: list[int]) -> dict[int, float]:
    """The values of some ranks (from 1, ascending) of a column."""
    wanted = [int(r) for r in ranks]
    found = with_position(df.where(F.col(x).isNotNull()).select(x), [x]).where(F.col("position").isin(*wanted)).collect()
    return {r["position"]: r[x] for r in found}


def percentile(df: DataFrame, x: str, p: float, exclusive: bool = False) -> float | None:
    """PERCENTILE.INC or .EXC of a whole column by two order statistics; None outside its bounds or of nothing."""
    n = df.where(F.col(x).isNotNull()).count()
    at = p * (n + 1) if exclusive else p * (n - 1) + 1
    if not n or not 1 <= at <= n:
        return None
    low = int(at)
    found = order_statistics(df, x, [low, min(low + 1, n)])
    return found[low] + (at - low) * (found[min(low + 1, n)] - found[low])


def large(df: DataFrame, x: str, k: int) -> DataFrame:
    """The k-th largest: a distributed top-k."""
    return df.where(F.col(x).isNotNull()).select(x).orderBy(F.desc(x)).limit(k).orderBy(x).limit(1)


def small(df: DataFrame, x: str, k: int) -> DataFrame:
    return df.where(F.col(x).isNotNull()).select(x).orderBy(x).limit(k).orderBy(F.desc(x)).limit(1)


def mode(df: DataFrame, x: str, order: list[str]) -> DataFrame:
    """MODE.SNGL: the most frequent value, of several the one seen first; no row (``#N/A``) if none repeats."""
    counts = df.where(F.col(x).isNotNull()).groupBy(x).agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(*order)).alias("_first")).where("_n > 1")
    return counts.orderBy(F.desc("_n"), "_first").limit(1).select(x)


def mode_mult(df: DataFrame, x: str) -> DataFrame:
    """MODE.MULT: all most frequent values."""
    counts = df.where(F.col(x).isNotNull()).groupBy(x).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    best = counts.agg(F.max("_n").alias("_n"))
    return counts.join(F.broadcast(best), "_n").select(x)


def trimmean(df: DataFrame, x: str, share: float) -> DataFrame:
    """The mean without ``floor(n * share / 2)`` values at each end."""
    some = df.where(F.col(x).isNotNull()).select(x)
    n = some.count()
    cut = int(n * share / 2)
    return with_position(some, [x]).where(F.col("position").between(cut + 1, n - cut)).agg(F.avg(x).alias("trimmean"))


def percentrank(df: DataFrame, x: str, exclusive: bool = False, digits: int = 3, name: str = "percentrank") -> DataFrame:
    """PERCENTRANK of each value among all, cut to digits."""
    ranked = with_rank(df, x, ascending=True, name="_rank")
    n = df.where(F.col(x).isNotNull()).count()
    share = F.col("_rank") / (n + 1) if exclusive else (F.col("_rank") - 1) / max(1, n - 1)
    scale = 10**digits
    return ranked.withColumn(name, F.floor(F.round(share * scale, 9)) / scale).drop("_rank")


def frequency(df: DataFrame, x: str, edges: list[float]) -> DataFrame:
    """(bin, n): values up to each edge and beyond the one before; the last bin, null, has what is above all."""
    edges = sorted(edges)
    bin_ = F.lit(None).cast("double")
    for e in reversed(edges):
        bin_ = F.when(F.col(x) <= e, F.lit(float(e))).otherwise(bin_)
    counts = df.where(F.col(x).isNotNull()).groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("_n"))
    bins = df.sparkSession.createDataFrame([(float(e),) for e in edges] + [(None,)], "bin double")
    return bins.join(counts, bins["bin"].eqNullSafe(counts["bin"]), "left").select(bins["bin"], F.coalesce("_n", F.lit(0)).alias("n"))
