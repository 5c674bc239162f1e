"""Registered queries over operators on whole tables, with the SQL that they are compared with."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions.cell import call
from tessella.operators import arrays, criteria, forecast, inference, lookup, rules, tables
from tessella.operators import filters as fl
from tessella.plans.registry import query, table

r2 = lambda c, n=2: F.round(c, n) + F.lit(0.0)


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def filter_countif_absent_some(spark, d):
    return lookup.within(table(spark, d, "customer").select("c_custkey"), "c_custkey", table(spark, d, "orders").where("o_orderstatus = 'P'"), "o_custkey", present=False)


@query("SELECT p_partkey, 'p_name' AS \"column\", p_name AS value FROM part WHERE lower(p_name) LIKE '%widget%'")
def find_cells_some(spark, d):
    return rules.find(table(spark, d, "part").select("p_partkey", "p_name"), ["p_partkey"], "WIDGET")


@query("SELECT k, criterion, CASE op WHEN '>=' THEN coalesce(sum(l_extendedprice) FILTER (l_quantity >= k), 0) WHEN '<' THEN coalesce(sum(l_extendedprice) FILTER (l_quantity < k), 0) WHEN '<>' THEN coalesce(sum(l_extendedprice) FILTER (l_quantity <> k), 0) WHEN '>' THEN coalesce(sum(l_extendedprice) FILTER (l_quantity > k), 0) WHEN '<=' THEN coalesce(sum(l_extendedprice) FILTER (l_quantity <= k), 0) ELSE coalesce(sum(l_extendedprice) FILTER (l_quantity = k), 0) END::BIGINT total, CASE op WHEN '>=' THEN count(*) FILTER (l_quantity >= k) WHEN '<' THEN count(*) FILTER (l_quantity < k) WHEN '<>' THEN count(*) FILTER (l_quantity <> k) WHEN '>' THEN count(*) FILTER (l_quantity > k) WHEN '<=' THEN count(*) FILTER (l_quantity <= k) ELSE count(*) FILTER (l_quantity = k) END AS count FROM (SELECT k, op, op || k AS criterion FROM (SELECT p_size k, ['>=', '<', '<>', '>', '<=', ''][p_partkey % 6 + 1] op FROM part) GROUP BY ALL) JOIN (SELECT l_quantity, floor(l_extendedprice)::BIGINT l_extendedprice FROM lineitem) ON true GROUP BY k, op, criterion")
def sumifs_by_operators(spark, d):
    op = F.get(F.array(*map(F.lit, (">=", "<", "<>", ">", "<=", ""))), (F.col("p_partkey") % 6).cast("int"))
    asked = table(spark, d, "part").select(F.col("p_size").alias("k"), F.concat(op, F.col("p_size")).alias("criterion")).distinct()
    some = table(spark, d, "lineitem").select("l_quantity", F.floor("l_extendedprice").alias("v"))
    return criteria.by_operators(some, "l_quantity", "v", asked, "criterion").select("k", "criterion", F.col("sum").cast("long").alias("total"), "count")


@query("SELECT n_nationkey, pattern, p_partkey FROM part JOIN (SELECT n_nationkey, concat(['Brand#1', 'brand#2', '?rand#3', '*5'][n_nationkey % 4 + 1], CASE WHEN n_nationkey % 4 = 3 THEN '' ELSE '*' END) pattern FROM nation) ON p_brand ILIKE replace(replace(pattern, '*', '%'), '?', '_')")
def wildcard_join(spark, d):
    head = F.get(F.array(*map(F.lit, ("Brand#1*", "brand#2*", "?rand#3*", "*5"))), (F.col("n_nationkey") % 4).cast("int"))
    patterns = table(spark, d, "nation").select("n_nationkey", head.alias("pattern"))
    return criteria.matching(table(spark, d, "part").select("p_partkey", "p_brand"), "p_brand", patterns, "pattern").select("n_nationkey", "pattern", "p_partkey")


@query("SELECT p_partkey, (SELECT count(*) FROM part b WHERE b.p_partkey <= a.p_partkey) AS \"position\" FROM part a WHERE p_partkey % 7 = 0")
def xmatch_position(spark, d):
    p = table(spark, d, "part").select("p_partkey")
    placed = arrays.with_position(p, ["p_partkey"]).select(F.col("p_partkey").alias("key"), "position")
    return lookup.xmatch(p.where("p_partkey % 7 = 0"), "p_partkey", placed, "key", "position").select("p_partkey", "position")


@query("SELECT r_name, r_regionkey AS again, r_name AS again_name FROM region")
def choose_columns(spark, d):
    return arrays.choose_columns(table(spark, d, "region").select("r_regionkey", "r_name"), [2, 1, -1]).toDF("r_name", "again", "again_name")


@query("SELECT i AS \"position\", r_name, CASE WHEN r_name IS NULL THEN 'none' ELSE 'none' END note FROM (SELECT i FROM range(1, 9) t(i)) LEFT JOIN (SELECT r_name, row_number() OVER (ORDER BY r_regionkey) k FROM region) ON i = k")
def expand(spark, d):
    x = arrays.expand(table(spark, d, "region").select("r_regionkey", "r_name"), 8, ["note"], ["r_regionkey"], "none")
    return x.select("position", F.when(F.col("r_regionkey").isNotNull(), F.col("r_name")).alias("r_name"), "note")


@query("SELECT (row_number() OVER (ORDER BY r_regionkey, c))::BIGINT AS \"column\", value FROM (SELECT r_regionkey, 1 c, r_name AS value FROM region UNION ALL SELECT r_regionkey, 2, r_regionkey::VARCHAR FROM region)")
def torow(spark, d):
    r = table(spark, d, "region").select("r_regionkey", "r_name", F.col("r_regionkey").cast("string").alias("k"))
    return arrays.torow(r, ["r_name", "k"], ["r_regionkey"])


@query("SELECT ((i - 1) % 4 + 1)::BIGINT AS \"row\", ((i - 1) // 4 + 1)::BIGINT AS \"column\", n_name AS value FROM (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) i FROM nation)")
def wrapcols(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    return arrays.wrapcols(n, "n_name", 4, ["n_nationkey"])


@query("SELECT max(l_quantity) l_quantity, max(l_tax) l_tax FROM lineitem")
def bycol(spark, d):
    return arrays.bycol(table(spark, d, "lineitem"), ["l_quantity", "l_tax"], F.max)


@query("SELECT i AS \"row\", i * 1 c1, i * 2 c2, i * 3 c3 FROM range(1, 6) t(i)")
def makearray(spark, d):
    return arrays.makearray(spark, 5, 3, lambda r, c: r * c)


@query("SELECT i, j, (CASE WHEN i = j THEN 1 ELSE 0 END)::DOUBLE AS value FROM range(1, 5) a(i), range(1, 5) b(j)")
def munit(spark, d):
    return arrays.munit(spark, 4)


@query("SELECT p_partkey, round((p_size + 1) * 3.0 - 2.0 * p_size, 6)::DOUBLE + 0.0::DOUBLE det, round(3.0 / (p_size + 3), 9)::DOUBLE + 0.0::DOUBLE inv_a, round(-2.0 / (p_size + 3), 9)::DOUBLE + 0.0::DOUBLE inv_b FROM part")
def matrices(spark, d):
    one = F.lit(1.0)
    m = F.array(F.array(F.col("p_size") + one, F.lit(2.0)), F.array(F.col("p_size").cast("double"), F.lit(3.0)))
    inverse = arrays.minverse(m)
    return table(spark, d, "part").select("p_partkey", r2(arrays.mdeterm(m), 6).alias("det"), r2(F.get(F.get(inverse, F.lit(0)), F.lit(0)), 9).alias("inv_a"), r2(F.get(F.get(inverse, F.lit(0)), F.lit(1)), 9).alias("inv_b"))


@query("SELECT count(*) n, count(*) FILTER (v) inside FROM (SELECT unnest(range(0, 1000)) i, true v)")
def randarray(spark, d):
    return arrays.randarray(spark, 1000, 1, 5, 9, whole=True).agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("c1") >= 5) & (F.col("c1") <= 9) & (F.col("c1") == F.floor("c1"))).alias("inside"))


@query("SELECT g, k AS step, round(2 * (39 + k) + g, 0) + 0.0::DOUBLE forecast FROM range(1, 4) t(k), range(0, 5) u(g)")
def forecast_ets(spark, d):
    """A straight line goes on as it is."""
    line = spark.range(40).select(F.col("id").alias("t"), F.explode(F.sequence(F.lit(0), F.lit(4)).cast("array<long>")).alias("g"))
    return forecast.ets(line.withColumn("v", F.col("t") * 2 + F.col("g")), ["g"], "t", "v", 3, seasonality=0).select("g", F.col("step").cast("long").alias("step"), r2(F.col("forecast"), 0).alias("forecast"))


@query("SELECT g, (g + 3) AS period FROM range(0, 5) u(g)")
def forecast_ets_seasonality(spark, d):
    wave = spark.range(60).select(F.col("id").alias("t"), F.explode(F.sequence(F.lit(0), F.lit(4)).cast("array<long>")).alias("g"))
    return forecast.ets_seasonality(wave.withColumn("v", F.when(F.col("t") % (F.col("g") + 3) == 0, 10).otherwise(1)), ["g"], "t", "v").select("g", F.col("period").cast("long").alias("period"))


@query("SELECT event_type, 86400.0::DOUBLE AS step, true AS sound FROM events GROUP BY 1")
def forecast_ets_stat(spark, d):
    e = table(spark, d, "events").select("event_type", F.date_trunc("day", "ts").alias("day"), "value")
    made = forecast.ets_stat(e, ["event_type"], "day", "value", seasonality=0, aggregation=7)
    sound = (F.col("mae") <= F.col("rmse")) & F.col("smape").between(0, 200) & (F.col("mase") >= 0) & F.col("alpha").between(0.05, 0.9)
    return made.select("event_type", "step", sound.alias("sound"))


@query("SELECT round(avg(abs(l_quantity - (SELECT avg(l_quantity) FROM lineitem))), 6) + 0.0::DOUBLE avedev FROM lineitem")
def average_deviation(spark, d):
    return inference.avedev(table(spark, d, "lineitem"), "l_quantity").select(r2(F.col("avedev"), 6).alias("avedev"))


@query("SELECT 3.0::DOUBLE quantity, -2.0::DOUBLE line, 7.0::DOUBLE constant")
def linest_two(spark, d):
    t = table(spark, d, "lineitem").select("l_quantity", "l_linenumber", (3 * F.col("l_quantity") - 2 * F.col("l_linenumber") + 7).alias("y"))
    found = inference.linest_many(t, "y", ["l_quantity", "l_linenumber"])
    return spark.range(1).select(r2(F.lit(found["l_quantity"]), 6).alias("quantity"), r2(F.lit(found["l_linenumber"]), 6).alias("line"), r2(F.lit(found[""]), 6).alias("constant"))


@query("SELECT round(regr_slope(ln(l_extendedprice), l_quantity), 9) + 0.0::DOUBLE slope, round(regr_intercept(l_extendedprice, l_quantity), 2) + 0.0::DOUBLE intercept FROM lineitem")
def fitted_lines(spark, d):
    t = table(spark, d, "lineitem")
    curve = inference.logest(t, "l_extendedprice", "l_quantity").select(r2(F.ln("m"), 9).alias("slope"))
    return curve.join(F.broadcast(inference.linest(t, "l_extendedprice", "l_quantity").select(r2(F.col("intercept")).alias("intercept"))))  # one row each


@query("SELECT p_partkey, concat('$', chr(64 + p_size % 26 + 1), '$', p_size) address_, round(least(p_retailprice * 0.1, greatest(0, p_retailprice - 100 - p_retailprice * 0.1 * 0.5 - p_retailprice * 0.1 * (p_size % 12 - 1))), 6) + 0.0::DOUBLE amorlinc FROM part WHERE p_size % 12 > 0")
def address_and_depreciation(spark, d):
    z = F.col("p_size")
    made = call("AMORLINC", F.col("p_retailprice"), F.to_date(F.lit("2020-01-01")), F.to_date(F.lit("2020-07-01")), 100, z % 12, 0.1)
    return table(spark, d, "part").where("p_size % 12 > 0").select("p_partkey", call("ADDRESS", z, z % 26 + 1).value.alias("address_"), r2(made.value, 6).alias("amorlinc"))


@query("SELECT s_suppkey, s_name, CASE WHEN s_suppkey < 5 THEN s_acctbal * 2 ELSE s_acctbal END s_acctbal FROM supplier WHERE s_suppkey <= 20")
def table_edits(spark, d):
    s = tables.rename_columns(table(spark, d, "supplier").select("s_suppkey", F.col("s_name").alias("n"), "s_nationkey", "s_acctbal"), {"n": "s_name"})
    s = tables.delete_columns(s, 3)
    return tables.fill_formula(tables.resize(s, "s_suppkey", 20, ["s_suppkey", "s_name", "s_acctbal"]), "s_acctbal", F.col("s_suppkey") < 5, F.col("s_acctbal") * 2)


@query("SELECT c_mktsegment, min(c_custkey) c_custkey FROM customer GROUP BY 1")
def remove_duplicates(spark, d):
    return tables.remove_duplicates(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), ["c_mktsegment"], ["c_custkey"]).select("c_mktsegment", "c_custkey")


@query("SELECT o_orderkey + 3 AS o_orderkey FROM orders WHERE o_orderkey >= 10 UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey < 10")
def insert_rows(spark, d):
    return tables.insert_rows(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 10, 3)


@query("SELECT CASE WHEN o_orderkey >= 15 THEN o_orderkey - 5 ELSE o_orderkey END o_orderkey FROM orders WHERE o_orderkey NOT BETWEEN 10 AND 14")
def delete_rows(spark, d):
    return tables.delete_rows(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 10, 5)


@query("SELECT o_orderkey, CASE WHEN NOT (o_orderkey < 5) THEN o_totalprice END o_totalprice FROM orders")
def clear_range(spark, d):
    return tables.clear_range(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), F.col("o_orderkey") < 5, ["o_totalprice"])


@query("SELECT o_orderkey FROM orders WHERE year(o_orderdate) = 1995 AND month(o_orderdate) IN (2, 3)")
def filter_timeline(spark, d):
    return tables.timeline(table(spark, d, "orders"), "o_orderdate", "1995-02-01", "1995-03-31").select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P')")
def filter_slicer(spark, d):
    return tables.slicer(table(spark, d, "orders"), "o_orderstatus", ["F", "P"]).select("o_orderkey")


@query("SELECT p_partkey, concat('Dear buyer of ', p_name) letter FROM part")
def merge_template(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.concat(F.lit("Dear {{who}} of "), F.col("p_name")).alias("letter"))
    return tables.merge_template(p, {"who": "buyer"})


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 7 OFFSET 30")
def windowed_read(spark, d):
    return tables.page(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 30, 7)


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity) / sum(sum(l_quantity)) OVER (PARTITION BY l_returnflag), 9) + 0.0::DOUBLE AS share FROM lineitem GROUP BY 1, 2")
def share_of_group(spark, d):
    from tessella.operators import pivot

    t = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("q"))
    return pivot.show_as_percent(t, "q", ["l_returnflag"]).select("l_returnflag", "l_linestatus", r2(F.col("share"), 9).alias("share"))


@query("SELECT i AS \"row\", (1.5 + (i - 1) * 2 * 0.5)::DOUBLE c1, (1.5 + ((i - 1) * 2 + 1) * 0.5)::DOUBLE c2 FROM range(1, 7) t(i)")
def sequence(spark, d):
    return arrays.sequence(spark, 6, 2, 1.5, 0.5)


@query("SELECT l_orderkey, l_linenumber, round(sum(l_quantity) OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_extendedprice), 6) + 0.0::DOUBLE AS scan FROM lineitem")
def scan(spark, d):
    t = table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_linenumber", "l_extendedprice", "l_quantity")
    return arrays.scan(t, ["l_orderkey", "l_returnflag"], ["l_linenumber", "l_extendedprice"], "l_quantity", 0.0, lambda s, v: s + v).select("l_orderkey", "l_linenumber", r2(F.col("scan"), 6).alias("scan"))


@query("SELECT p_partkey, CASE WHEN p_retailprice < 950 THEN 0 WHEN p_retailprice < 1000 THEN 1 ELSE 2 END icon FROM part")
def icon_set(spark, d):
    edges = [950, 1000]
    which = F.when(fl.icon("p_retailprice", 0, edges), 0).when(fl.icon("p_retailprice", 1, edges), 1).when(fl.icon("p_retailprice", 2, edges), 2)
    return table(spark, d, "part").select("p_partkey", which.alias("icon"))
