"""Registered queries over the test tables, each with the SQL that it is compared with."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

import tessella.functions.date
import tessella.functions.distributions
import tessella.functions.engineering
import tessella.functions.financial
import tessella.functions.logical
import tessella.functions.math
import tessella.functions.text  # noqa: F401  these register functions
from tessella.functions.cell import NA, call, cell, raised
from tessella.operators import aggregates as A
from tessella.operators import arrays, criteria, filters, lookup, pivot, ranking, rules, tables
from tessella.plans.registry import query, table

r2 = lambda c, n=2: F.round(c, n)


# Aggregates and conditional aggregates: one scan, one partial aggregation.


@query("""SELECT l_returnflag, round(sum(l_quantity), 2) sum_qty, round(avg(l_extendedprice), 2) avg_price, count(l_tax) n, count(l_comment0) filled, min(l_discount) min_disc, max(l_discount) max_disc,
    round(sum(l_quantity * l_discount), 4) sumproduct, round(sum(l_quantity * l_quantity), 2) sumsq FROM (SELECT *, l_linestatus l_comment0 FROM lineitem) GROUP BY 1""")
def aggregates_by_flag(spark, d):
    t = table(spark, d, "lineitem")
    return t.groupBy("l_returnflag").agg(r2(A.sum_("l_quantity")).alias("sum_qty"), r2(A.average("l_extendedprice")).alias("avg_price"), A.count("l_tax").alias("n"), A.counta("l_linestatus").alias("filled"), A.min_("l_discount").alias("min_disc"), A.max_("l_discount").alias("max_disc"), r2(A.sumproduct("l_quantity", "l_discount"), 4).alias("sumproduct"), r2(A.sumsq("l_quantity")).alias("sumsq"))


@query("""SELECT round(sum(l_quantity*l_quantity - l_linenumber*l_linenumber), 2) sumx2my2, round(sum(l_quantity*l_quantity + l_linenumber*l_linenumber), 2) sumx2py2, round(sum((l_quantity-l_linenumber)*(l_quantity-l_linenumber)), 2) sumxmy2 FROM lineitem""")
def sum_pairs(spark, d):
    t = table(spark, d, "lineitem")
    return t.agg(r2(A.sumx2my2("l_quantity", "l_linenumber")).alias("sumx2my2"), r2(A.sumx2py2("l_quantity", "l_linenumber")).alias("sumx2py2"), r2(A.sumxmy2("l_quantity", "l_linenumber")).alias("sumxmy2"))


@query("""SELECT l_linestatus, count(*) FILTER (l_quantity >= 25) countif, round(coalesce(sum(l_extendedprice) FILTER (l_returnflag = 'R' AND l_discount > 0.05), 0), 2) sumifs,
    round(avg(l_extendedprice) FILTER (l_returnflag LIKE 'A%'), 2) averageif, coalesce(min(l_extendedprice) FILTER (l_quantity < 5), 0) minifs, coalesce(max(l_extendedprice) FILTER (l_quantity <> 50), 0) maxifs FROM lineitem GROUP BY 1""")
def conditional_aggregates(spark, d):
    t, m = table(spark, d, "lineitem"), criteria.matches
    return t.groupBy("l_linestatus").agg(
        A.countif(m("l_quantity", ">=25")).alias("countif"), r2(A.sumif(criteria.all_of({"l_returnflag": "r", "l_discount": ">0.05"}), "l_extendedprice")).alias("sumifs"),
        r2(A.averageif(m("l_returnflag", "a*"), "l_extendedprice")).alias("averageif"), A.minif(m("l_quantity", "<5"), "l_extendedprice").alias("minifs"), A.maxif(m("l_quantity", "<>50"), "l_extendedprice").alias("maxifs"),
    )


@query("""SELECT n.n_name, n.n_nationkey, x.total, x.n FROM nation n LEFT JOIN (SELECT c_nationkey, round(sum(c_acctbal), 2) total, count(*) n FROM customer GROUP BY 1) x ON n.n_nationkey = x.c_nationkey""")
def sumifs_by_criteria_column(spark, d):
    n = table(spark, d, "nation").select("n_name", "n_nationkey", F.col("n_nationkey").alias("c_nationkey"))
    return criteria.by_criteria(table(spark, d, "customer"), n, ["c_nationkey"], total=r2(F.sum("c_acctbal")), n=F.count(F.lit(1))).drop("c_nationkey")


@query("""SELECT round(coalesce(sum(o_totalprice), 0), 2) dsum, round(avg(o_totalprice), 2) daverage, count(o_totalprice) dcount, max(o_totalprice) dmax, min(o_totalprice) dmin, round(stddev_samp(o_totalprice), 2) dstdev, round(var_pop(o_totalprice) / 1e6, 2) dvarp
    FROM orders WHERE (o_orderstatus = 'F' AND o_totalprice > 1000) OR o_orderpriority LIKE '1%'""")
def database_functions(spark, d):
    x = criteria.database(table(spark, d, "orders"), [{"O_ORDERSTATUS": "F", "o_totalprice": ">1000"}, {"o_orderpriority": "1*"}])
    f = criteria.DATABASE
    return x.agg(r2(f["DSUM"]("o_totalprice")).alias("dsum"), r2(f["DAVERAGE"]("o_totalprice")).alias("daverage"), f["DCOUNT"]("o_totalprice").alias("dcount"), f["DMAX"]("o_totalprice").alias("dmax"), f["DMIN"]("o_totalprice").alias("dmin"), r2(f["DSTDEV"]("o_totalprice")).alias("dstdev"), r2(f["DVARP"]("o_totalprice") / 1e6).alias("dvarp"))


@query("SELECT n_name dget FROM nation WHERE n_nationkey = 7")
def dget(spark, d):
    return criteria.database(table(spark, d, "nation"), [{"n_nationkey": 7}]).agg(criteria.DATABASE["DGET"]("n_name").alias("dget"))


@query("""SELECT l_linestatus, round(avg(l_quantity) FILTER (NOT f), 4) sub1, count(l_quantity) FILTER (NOT f) sub2, round(sum(l_quantity) FILTER (NOT f AND NOT h), 2) sub109, round(stddev_samp(l_quantity) FILTER (NOT f), 4) sub7,
    round(median(l_quantity) FILTER (NOT h), 4) agg12, round(quantile_cont(l_quantity, 0.9) FILTER (NOT h), 4) agg16 FROM (SELECT *, l_discount > 0.07 f, l_linenumber = 2 h FROM lineitem) GROUP BY 1""")
def subtotal_and_aggregate(spark, d):
    t, f, h = table(spark, d, "lineitem"), F.col("l_discount") > 0.07, F.col("l_linenumber") == 2
    return t.groupBy("l_linestatus").agg(r2(A.subtotal(1, "l_quantity", f, h), 4).alias("sub1"), A.subtotal(2, "l_quantity", f, h).alias("sub2"), r2(A.subtotal(109, "l_quantity", f, h)).alias("sub109"), r2(A.subtotal(7, "l_quantity", f, h), 4).alias("sub7"), r2(A.aggregate(12, "l_quantity", h, option=5), 4).alias("agg12"), r2(A.aggregate(16, "l_quantity", h, option=5, k=0.9), 4).alias("agg16"))


# Lookups.


@query("""SELECT c.c_custkey, coalesce(n.n_name, 'none') n_name FROM customer c LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) n ON c.c_nationkey = n.n_nationkey""")
def xlookup_nation(spark, d):
    n = table(spark, d, "nation").where("n_nationkey < 20")
    return lookup.xlookup(table(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", n, "n_nationkey", ["n_name"], ["n_nationkey"], if_not_found="none").drop("c_nationkey")


@query("""SELECT c.c_custkey, o.o_orderkey last_order FROM customer c LEFT JOIN (SELECT o_custkey, max(o_orderkey) o_orderkey FROM orders GROUP BY 1) o ON c.c_custkey = o.o_custkey""")
def xlookup_last(spark, d):
    o = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("last_order"))
    return lookup.xlookup(table(spark, d, "customer").select("c_custkey"), "c_custkey", o, "o_custkey", ["last_order"], ["last_order"], search=-1)


@query("""SELECT s.s_suppkey, (SELECT max(p.p_retailprice) FROM part p WHERE p.p_retailprice <= s.s_acctbal) below, (SELECT min(p.p_retailprice) FROM part p WHERE p.p_retailprice >= s.s_acctbal) above FROM supplier s""")
def approximate_match(spark, d):
    s, p = table(spark, d, "supplier").select("s_suppkey", "s_acctbal"), table(spark, d, "part")
    low = lookup.nearest(s, "s_acctbal", p.select("p_retailprice", F.col("p_retailprice").alias("below")), "p_retailprice", ["below"])
    high = lookup.nearest(low, "s_acctbal", p.select("p_retailprice", F.col("p_retailprice").alias("above")), "p_retailprice", ["above"], larger=True)
    return high.drop("s_acctbal")


@query("""SELECT a.event_id, max(b.ts) last_purchase FROM events a LEFT JOIN events b ON a.user_id = b.user_id AND b.event_type = 'purchase' AND b.ts <= a.ts WHERE a.event_type = 'click' GROUP BY 1""")
def asof_within_user(spark, d):
    e = table(spark, d, "events")
    left = e.where("event_type = 'click'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'purchase'").select("user_id", "ts", F.col("ts").alias("last_purchase"))
    return lookup.nearest(left, "ts", right, "ts", ["last_purchase"], by=["user_id"]).select("event_id", "last_purchase")


@query("SELECT p_partkey, p_name FROM part WHERE lower(p_brand) LIKE '%3' ORDER BY p_partkey LIMIT 1")
def wildcard_lookup(spark, d):
    return lookup.wildcard_lookup(table(spark, d, "part"), "p_brand", "*3", ["p_partkey", "p_name"], ["p_partkey"])


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def filter_countif_present(spark, d):
    return lookup.within(table(spark, d, "customer").select("c_custkey"), "c_custkey", table(spark, d, "orders"), "o_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def filter_countif_absent(spark, d):
    return lookup.within(table(spark, d, "customer").select("c_custkey"), "c_custkey", table(spark, d, "orders"), "o_custkey", present=False)


@query("SELECT c_name FROM customer ORDER BY c_custkey LIMIT 1 OFFSET 41")
def index_row(spark, d):
    return lookup.index(table(spark, d, "customer"), ["c_custkey"], 42, "c_name")


# Dynamic arrays and set operations.


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def sort_take(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return o.orderBy(*arrays.sort_keys(o, ["o_totalprice"], [True]), "o_orderkey").limit(25)


@query("SELECT event_type, min(event_id) first_id FROM events GROUP BY 1")
def unique_first(spark, d):
    return arrays.unique(table(spark, d, "events"), ["event_type"], ["event_id"]).select("event_type", F.col("_first.event_id").alias("first_id"))


@query("SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) = 1")
def unique_exactly_once(spark, d):
    return arrays.unique(table(spark, d, "orders"), ["o_custkey"], ["o_orderkey"], exactly_once=True).select("o_custkey")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey OFFSET 100")
def drop_rows(spark, d):
    return arrays.drop(table(spark, d, "orders").select("o_orderkey"), 100, ["o_orderkey"])


@query("SELECT s_name, pos AS \"at\" FROM (SELECT s_name, row_number() OVER (ORDER BY s_suppkey) rn FROM supplier) JOIN (VALUES (3, 1), (1, 2), (3, 3), (5, 4)) v(rn, pos) USING (rn)")
def choose_rows(spark, d):
    return arrays.choose_rows(table(spark, d, "supplier").select("s_suppkey", "s_name"), [3, 1, 3, 5], ["s_suppkey"]).select("s_name", F.col("at"))


@query("SELECT n_nationkey k, n_name name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region")
def vstack(spark, d):
    return arrays.vstack(table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")), table(spark, d, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name")))


@query("SELECT coalesce(a.i, b.i) AS \"position\", n_name, r_name FROM (SELECT row_number() OVER (ORDER BY n_nationkey) i, n_name FROM nation) a FULL JOIN (SELECT row_number() OVER (ORDER BY r_regionkey) i, r_name FROM region) b ON a.i = b.i")
def hstack(spark, d):
    n, r = table(spark, d, "nation").select("n_nationkey", "n_name"), table(spark, d, "region").select("r_regionkey", "r_name")
    return arrays.hstack(n, r, ["n_nationkey"], ["r_regionkey"]).select(F.col("position").cast("long").alias("position"), "n_name", "r_name")


@query("SELECT s_suppkey, 1 AS \"column\", s_acctbal AS value FROM supplier UNION ALL SELECT s_suppkey, 2, s_nationkey::DOUBLE FROM supplier")
def tocol(spark, d):
    s = table(spark, d, "supplier").withColumn("n", F.col("s_nationkey").cast("double"))
    return arrays.tocol(s, ["s_acctbal", "n"], ["s_suppkey"])


@query("SELECT ((i - 1) // 3 + 1)::BIGINT AS \"row\", max(CASE WHEN (i-1) % 3 = 0 THEN r END) c1, max(CASE WHEN (i-1) % 3 = 1 THEN r END) c2, max(CASE WHEN (i-1) % 3 = 2 THEN r END) c3 FROM (SELECT r_regionkey r, row_number() OVER (ORDER BY r_regionkey) i FROM region) GROUP BY 1")
def wraprows(spark, d):
    return arrays.wraprows(table(spark, d, "region").select("r_regionkey"), "r_regionkey", 3, ["r_regionkey"])


@query("SELECT (a.l_linenumber)::BIGINT i, (b.l_linenumber)::BIGINT j, round(sum(a.v * b.v), 2) AS value FROM (SELECT l_linenumber, l_suppkey % 5 k, sum(l_quantity) v FROM lineitem GROUP BY 1, 2) a JOIN (SELECT l_linenumber, l_suppkey % 5 k, sum(l_quantity) v FROM lineitem GROUP BY 1, 2) b ON a.k = b.k GROUP BY 1, 2")
def mmult(spark, d):
    m = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").cast("long").alias("i"), (F.col("l_suppkey") % 5).alias("k")).agg(F.sum("l_quantity").alias("value"))
    return arrays.mmult(m, m.select("k", F.col("i").alias("j"), "value")).withColumn("value", r2(F.col("value")))


# Statistics.


@query("""SELECT l_returnflag, round(stddev_samp(l_quantity), 6) stdev, round(var_pop(l_quantity), 6) varp, round(median(l_extendedprice), 4) median, round(quantile_cont(l_extendedprice, 0.9), 4) p90, round(quantile_cont(l_extendedprice, 0.25), 4) q1,
    round(exp(avg(ln(l_quantity))), 6) geomean, round(count(*) / sum(1 / l_quantity), 6) harmean, round(skewness(l_extendedprice), 6) skew, round(kurtosis(l_extendedprice), 6) kurt FROM lineitem GROUP BY 1""")
def statistics(spark, d):
    median, p90, q1 = A.percentiles("l_extendedprice", [0.5, 0.9, 0.25])
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(*(r2(c, n).alias(name) for name, c, n in (("stdev", A.stdev_s("l_quantity"), 6), ("varp", A.var_p("l_quantity"), 6), ("median", median, 4), ("p90", p90, 4), ("q1", q1, 4), ("geomean", A.geomean("l_quantity"), 6), ("harmean", A.harmean("l_quantity"), 6), ("skew", A.skew("l_extendedprice"), 6), ("kurt", A.kurt("l_extendedprice"), 6))))


@query("""SELECT round(regr_slope(l_extendedprice, l_quantity), 4) slope, round(regr_intercept(l_extendedprice, l_quantity), 2) intercept, round(regr_r2(l_extendedprice, l_quantity), 6) rsq, round(corr(l_extendedprice, l_quantity), 6) correl,
    round(covar_pop(l_extendedprice, l_quantity), 2) covar_p, round(covar_samp(l_extendedprice, l_quantity), 2) covar_s, round(regr_intercept(l_extendedprice, l_quantity) + 10 * regr_slope(l_extendedprice, l_quantity), 2) forecast,
    round(sqrt((regr_syy(l_extendedprice, l_quantity) - regr_sxy(l_extendedprice, l_quantity) ** 2 / regr_sxx(l_extendedprice, l_quantity)) / (count(*) - 2)), 2) steyx FROM lineitem""")
def regression(spark, d):
    y, x = "l_extendedprice", "l_quantity"
    return table(spark, d, "lineitem").agg(r2(A.slope(y, x), 4).alias("slope"), r2(A.intercept(y, x)).alias("intercept"), r2(A.rsq(y, x), 6).alias("rsq"), r2(A.correl(y, x), 6).alias("correl"), r2(A.covariance_p(y, x)).alias("covar_p"), r2(A.covariance_s(y, x)).alias("covar_s"), r2(A.forecast(10, y, x)).alias("forecast"), r2(A.steyx(y, x)).alias("steyx"))


@query("SELECT o_orderkey, rank() OVER (ORDER BY o_totalprice DESC) AS \"rank\" FROM orders")
def rank_eq(spark, d):
    return ranking.with_rank(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice").select("o_orderkey", F.col("rank").cast("long").alias("rank"))


@query("SELECT l_orderkey, l_linenumber, rank() OVER (ORDER BY l_quantity DESC) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS \"rank\" FROM lineitem")
def rank_avg(spark, d):
    return ranking.with_rank(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity", average=True).select("l_orderkey", "l_linenumber", F.col("rank").cast("double").alias("rank"))


@query("SELECT (SELECT l_extendedprice FROM lineitem ORDER BY 1 DESC LIMIT 1 OFFSET 9) large10, (SELECT l_extendedprice FROM lineitem ORDER BY 1 LIMIT 1 OFFSET 9) small10")
def large_small(spark, d):
    t = table(spark, d, "lineitem")
    return ranking.large(t, "l_extendedprice", 10).withColumnRenamed("l_extendedprice", "large10").crossJoin(F.broadcast(ranking.small(t, "l_extendedprice", 10).withColumnRenamed("l_extendedprice", "small10")))


@query("SELECT l_quantity FROM lineitem GROUP BY 1 HAVING count(*) > 1 ORDER BY count(*) DESC, min(l_orderkey * 10 + l_linenumber) LIMIT 1")
def mode_single(spark, d):
    t = table(spark, d, "lineitem").withColumn("i", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return ranking.mode(t, "l_quantity", ["i"])


@query("SELECT l_linenumber FROM lineitem GROUP BY 1 QUALIFY count(*) = max(count(*)) OVER ()")
def mode_multiple(spark, d):
    return ranking.mode_mult(table(spark, d, "lineitem"), "l_linenumber")


@query("SELECT round(avg(x), 4) trimmean FROM (SELECT l_extendedprice x, row_number() OVER (ORDER BY l_extendedprice) i, count(*) OVER () n FROM lineitem) WHERE i > floor(n * 0.05) AND i <= n - floor(n * 0.05)")
def trimmean(spark, d):
    return ranking.trimmean(table(spark, d, "lineitem"), "l_extendedprice", 0.1).select(r2(F.col("trimmean"), 4).alias("trimmean"))


@query("SELECT CASE WHEN l_quantity <= 10 THEN 10.0::DOUBLE WHEN l_quantity <= 20 THEN 20.0::DOUBLE WHEN l_quantity <= 40 THEN 40.0::DOUBLE END bin, count(*) n FROM lineitem GROUP BY 1")
def frequency(spark, d):
    return ranking.frequency(table(spark, d, "lineitem"), "l_quantity", [10, 20, 40])


@query("SELECT c_custkey, floor(round((rank() OVER (ORDER BY c_acctbal) - 1) / (count(*) OVER () - 1) * 1000, 9)) / 1000 percentrank FROM customer")
def percentrank(spark, d):
    return ranking.percentrank(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal").select("c_custkey", "percentrank")


@query("SELECT o_orderkey, round(sum(o_totalprice) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING), 2) running FROM orders")
def running_total(spark, d):
    o = ranking.running_total(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], "o_totalprice")
    return o.select("o_orderkey", r2(F.col("running")).alias("running"))


@query("SELECT event_id, round(avg(value) OVER w, 6) moving, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) change FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 2 PRECEDING)")
def moving_average(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", r2(arrays.moving("value", ["ts", "event_id"], 3, ["user_id"]), 6).alias("moving"), (F.col("value") - arrays.lag("value", ["ts", "event_id"], ["user_id"])).alias("change"))


# Scalar functions, a column each.


@query("""SELECT l_orderkey, l_linenumber, sign(l_tax) sign, floor(l_extendedprice) int_, l_extendedprice - 7 * floor(l_extendedprice / 7) mod_, trunc(l_extendedprice / 7) quotient, floor(l_extendedprice * 10 + 0.5) / 10 round_, ceil(l_extendedprice / 10) * 10 roundup, floor(l_extendedprice / 100) * 100 rounddown,
    floor(l_quantity / 4 + 0.5) * 4 mround, ceil(l_quantity / 3) * 3 ceiling, floor(l_quantity / 3) * 3 floor_, ceil(l_quantity / 2) * 2 even, ceil((greatest(l_quantity, 1) - 1) / 2) * 2 + 1 odd FROM lineitem""")
def math_rounding(spark, d):
    p, q = F.col("l_extendedprice"), F.col("l_quantity")
    made = {"sign": call("SIGN", F.col("l_tax")), "int_": call("INT", p), "mod_": call("MOD", p, 7), "quotient": call("QUOTIENT", p, 7), "round_": call("ROUND", p, 1), "roundup": call("ROUNDUP", p, -1), "rounddown": call("ROUNDDOWN", p, -2), "mround": call("MROUND", q, 4), "ceiling": call("CEILING", q, 3), "floor_": call("FLOOR", q, 3), "even": call("EVEN", q), "odd": call("ODD", q)}
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *(c.value.cast("double").alias(n) if n != "sign" else c.value.cast("tinyint").alias(n) for n, c in made.items()))


@query("""SELECT l_orderkey, l_linenumber, round(sin(l_quantity), 9) sin, round(atan2(l_quantity, l_linenumber), 9) atan2, round(degrees(l_quantity), 6) degrees, round(1 / tan(l_quantity), 6) cot, round(ln(l_quantity), 9) ln, round(log10(l_quantity), 9) log10, round(sqrt(l_quantity), 9) sqrt, round(tanh(l_discount), 9) tanh, factorial(l_linenumber)::DOUBLE fact, gcd(l_quantity::BIGINT, 12)::DOUBLE gcd FROM lineitem""")
def math_trigonometry(spark, d):
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    made = (("sin", call("SIN", q), 9), ("atan2", call("ATAN2", n, q), 9), ("degrees", call("DEGREES", q), 6), ("cot", call("COT", q), 6), ("ln", call("LN", q), 9), ("log10", call("LOG10", q), 9), ("sqrt", call("SQRT", q), 9), ("tanh", call("TANH", F.col("l_discount")), 9))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *(r2(c.value, k).alias(name) for name, c, k in made), call("FACT", n).value.alias("fact"), call("GCD", q, 12).value.alias("gcd"))


@query("""SELECT p_partkey, left(p_name, 3) left_, right(p_name, 2) right_, substr(p_name, 2, 4) mid_, length(p_name)::DOUBLE len_, upper(p_name) upper_, concat(p_brand, '-', p_type) concat_, replace(p_name, 'a', 'Z') substitute_, concat(substr(p_name, 1, 1), '##', substr(p_name, 4)) replace_, repeat('ab', p_size % 4) rept_, instr(p_brand, '#')::DOUBLE find_, p_name = p_brand exact_, regexp_matches(p_type, '[A-Z]+') regextest, regexp_replace(p_name, '[0-9]+', 'N', 'g') regexreplace FROM part""")
def text_functions(spark, d):
    n, b = F.col("p_name"), F.col("p_brand")
    found = call("IFERROR", call("FIND", F.lit("#"), b), 0)
    made = {"left_": call("LEFT", n, 3), "right_": call("RIGHT", n, 2), "mid_": call("MID", n, 2, 4), "len_": call("LEN", n), "upper_": call("UPPER", n), "concat_": call("CONCAT", b, "-", F.col("p_type")), "substitute_": call("SUBSTITUTE", n, "a", "Z"), "replace_": call("REPLACE", n, 2, 2, "##"), "rept_": call("REPT", "ab", F.col("p_size") % 4), "find_": found, "exact_": call("EXACT", n, b), "regextest": call("REGEXTEST", F.col("p_type"), "[A-Z]+"), "regexreplace": call("REGEXREPLACE", n, "[0-9]+", "N")}
    return table(spark, d, "part").select("p_partkey", *((c.value.cast("double") if k == "find_" else c.value).alias(k) for k, c in made.items()))


@query("""SELECT o_orderkey, year(o_orderdate)::DOUBLE y, month(o_orderdate)::DOUBLE m, day(o_orderdate)::DOUBLE dd, date_diff('day', DATE '1899-12-30', o_orderdate::DATE)::DOUBLE serial, date_diff('day', DATE '1899-12-30', (o_orderdate::DATE + INTERVAL 3 MONTH)::DATE)::DOUBLE edate, date_diff('day', DATE '1899-12-30', last_day(o_orderdate::DATE + INTERVAL 1 MONTH))::DOUBLE eomonth, (dayofweek(o_orderdate) + 1)::DOUBLE weekday, week(o_orderdate)::DOUBLE isoweek,
    date_diff('day', o_orderdate::DATE, DATE '2000-01-01')::DOUBLE AS days_ FROM orders""")
def date_functions(spark, d):
    o = F.col("o_orderdate")
    made = {"y": call("YEAR", o), "m": call("MONTH", o), "dd": call("DAY", o), "serial": call("DATEVALUE", o), "edate": call("EDATE", o, 3), "eomonth": call("EOMONTH", o, 1), "weekday": call("WEEKDAY", o), "isoweek": call("ISOWEEKNUM", o), "days_": call("DAYS", F.lit(dt.date(2000, 1, 1)), o)}
    return table(spark, d, "orders").select("o_orderkey", *(c.value.alias(k) for k, c in made.items()))


@query("""SELECT o_orderkey, (SELECT count(*) FROM range(0, 30) r(i) WHERE isodow(o_orderdate::DATE + r.i::INTEGER) < 6 AND (o_orderdate::DATE + r.i::INTEGER) <> DATE '1995-12-25')::DOUBLE networkdays FROM orders""")
def networkdays(spark, d):
    o = F.to_date("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", call("NETWORKDAYS", o, F.date_add(o, 29), ["1995-12-25"]).value.alias("networkdays"))


@query("""SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'big' WHEN o_totalprice > 50000 THEN 'mid' ELSE 'small' END ifs_, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END switch_, (o_totalprice > 1000 AND o_orderstatus = 'F') and_, coalesce(o_totalprice / nullif(o_custkey % 3, 0), -1) iferror_, CASE WHEN o_custkey % 3 = 0 THEN '#DIV/0!' ELSE 'ok' END shown FROM orders""")
def logical_functions(spark, d):
    p, s = F.col("o_totalprice"), F.col("o_orderstatus")
    ratio = cell(p) / cell(F.col("o_custkey") % 3)
    return table(spark, d, "orders").select(
        "o_orderkey", call("IFS", p > 100000, "big", p > 50000, "mid", True, "small").value.alias("ifs_"), call("SWITCH", s, "F", 1, "O", 2, 0).value.alias("switch_"), call("AND", p > 1000, s == "F").value.alias("and_"),
        call("IFERROR", ratio, -1.0).value.alias("iferror_"), F.coalesce(ratio.error, F.lit("ok")).alias("shown"),
    )


@query("""SELECT event_id, bin(user_id) dec2bin, upper(to_hex(user_id)) dec2hex, (user_id & 6)::DOUBLE bitand_, xor(user_id, 5)::DOUBLE bitxor_, (user_id * 4)::DOUBLE lshift, round(value * 1.609344, 9) miles FROM events WHERE user_id < 500""")
def engineering_functions(spark, d):
    u = F.col("user_id")
    made = {"dec2bin": call("DEC2BIN", u), "dec2hex": call("DEC2HEX", u), "bitand_": call("BITAND", u, 6), "bitxor_": call("BITXOR", u, 5), "lshift": call("BITLSHIFT", u, 2)}
    return table(spark, d, "events").where("user_id < 500").select("event_id", *(c.value.alias(k) for k, c in made.items()), r2(call("CONVERT", F.col("value"), "mi", "km").value, 9).alias("miles"))


@query("""SELECT event_id, CASE WHEN user_id BETWEEN -512 AND 511 THEN bin(user_id) END dec2bin, CASE WHEN user_id NOT BETWEEN -512 AND 511 THEN '#NUM!' END dec2bin_error, upper(to_hex(user_id)) dec2hex, (user_id & 6)::DOUBLE bitand_, xor(user_id, 5)::DOUBLE bitxor_, (user_id * 4)::DOUBLE lshift, round(value * 1.609344, 9) miles FROM events""")
def engineering_functions_all(spark, d):
    """``engineering_functions`` of every event; where DEC2BIN is not defined its value is null, and its error has a column."""
    u, binary = F.col("user_id"), call("DEC2BIN", F.col("user_id"))
    made = {"dec2bin": binary, "dec2hex": call("DEC2HEX", u), "bitand_": call("BITAND", u, 6), "bitxor_": call("BITXOR", u, 5), "lshift": call("BITLSHIFT", u, 2)}
    return table(spark, d, "events").select("event_id", *(c.value.alias(k) for k, c in made.items()), binary.error.alias("dec2bin_error"), r2(call("CONVERT", F.col("value"), "mi", "km").value, 9).alias("miles"))


@query("""SELECT o_orderkey, round(-(o_totalprice * power(1.005, 60)) * 0.005 / (power(1.005, 60) - 1), 6) pmt, round(-o_totalprice * power(1.01, 12), 4) fv, round((o_totalprice - 100) / 5, 6) sln, round((o_totalprice - 100) * (5 - 2 + 1) * 2 / 30, 6) syd, round(power(1 + 0.06 / 12, 12) - 1, 9) effect, round(o_totalprice / 1.1 + 100 / power(1.1, 2), 6) npv FROM orders""")
def financial_functions(spark, d):
    p = F.col("o_totalprice")
    made = (("pmt", call("PMT", 0.005, 60, p), 6), ("fv", call("FV", 0.01, 12, 0, p), 4), ("sln", call("SLN", p, 100, 5), 6), ("syd", call("SYD", p, 100, 5, 2), 6), ("effect", call("EFFECT", 0.06, 12), 9), ("npv", call("NPV", 0.1, p, 100), 6))
    return table(spark, d, "orders").select("o_orderkey", *(r2(c.value, k).alias(n) for n, c, k in made))


_ERF = "(2 / sqrt(pi()) * list_sum(list_transform(range(0, 80), lambda k: (CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END) * pow({z}, 2 * k + 1) / (gamma(k + 1) * (2 * k + 1)))))"


@query(f"""SELECT l_orderkey, l_linenumber, round(0.5 + 0.5 * {_ERF.format(z="((l_quantity - 25) / 10 / sqrt(2))")}, 9) normal, round(1 - sin(a) * (1 + cos(a) ** 2 / 2 + cos(a) ** 4 * 3 / 8 + cos(a) ** 6 * 5 / 16), 9) t,
    round(exp(-l_quantity / 2) * list_sum(list_transform(range(0, 10), lambda k: pow(l_quantity / 2, k) / gamma(k + 1))), 9) chisq, round(exp(-3) * list_sum(list_transform(range(0, l_linenumber + 1), lambda k: pow(3, k) / gamma(k + 1))), 9) poisson, round({_ERF.format(z="(l_quantity / 50)")}, 9) erf FROM (SELECT *, atan(l_quantity / 10 / sqrt(8)) a FROM lineitem)""")
def distribution_functions(spark, d):
    t, q = table(spark, d, "lineitem"), F.col("l_quantity")  # the table first: it ships the package that Python functions need
    made = {"normal": call("NORM.DIST", q, 25, 10, 1), "t": call("T.DIST.2T", q / 10, 8), "chisq": call("CHISQ.DIST.RT", q, 20), "poisson": call("POISSON.DIST", F.col("l_linenumber"), 3, 1), "erf": call("ERF", q / 50)}
    return t.select("l_orderkey", "l_linenumber", *(r2(c.value, 9).alias(k) for k, c in made.items()))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 2 THEN '#DIV/0!' WHEN l_tax > 0.05 THEN '#N/A' ELSE (l_quantity / (l_linenumber - 2) + l_tax)::VARCHAR END shown, CASE WHEN l_linenumber = 2 THEN 2.0::DOUBLE WHEN l_tax > 0.05 THEN 7.0::DOUBLE END kind, l_tax > 0.05 isna FROM lineitem""")
def error_values(spark, d):
    t = table(spark, d, "lineitem")
    x = cell(F.col("l_quantity")) / cell(F.col("l_linenumber") - 2)
    na = raised(F.col("l_tax"), (F.col("l_tax") > 0.05, NA))
    return t.select("l_orderkey", "l_linenumber", (x + na).shown().alias("shown"), call("ERROR.TYPE", x + na).value.alias("kind"), call("ISNA", na).value.alias("isna"))


# Pivots, filters, rules and edits.


@query("""SELECT l_returnflag, round(sum(l_quantity) FILTER (l_linestatus = 'F'), 2) F, round(sum(l_quantity) FILTER (l_linestatus = 'O'), 2) O, round(sum(l_quantity), 2) total FROM lineitem GROUP BY ROLLUP (l_returnflag)""")
def pivot_sum(spark, d):
    p = pivot.pivot(table(spark, d, "lineitem"), ["l_returnflag"], "l_linestatus", "l_quantity", items=["F", "O"])
    return p.select("l_returnflag", *(r2(F.col(c)).alias(c) for c in ("F", "O", "total")))


@query("""SELECT o_orderstatus, year(o_orderdate) y, count(*) total FROM orders WHERE o_orderpriority LIKE '1%' GROUP BY GROUPING SETS ((o_orderstatus, year(o_orderdate)), ())""")
def pivot_two_rows(spark, d):
    o = table(spark, d, "orders").withColumn("y", F.year("o_orderdate").cast("long"))
    return pivot.pivot(o, ["o_orderstatus", "y"], None, "o_orderkey", "count", page=F.col("o_orderpriority").startswith("1"))


@query("""SELECT l_returnflag, round(sum(l_quantity) FILTER (l_linestatus = 'F') / sum(l_quantity), 6) F, round(sum(l_quantity) FILTER (l_linestatus = 'O') / sum(l_quantity), 6) O FROM lineitem GROUP BY 1""")
def pivot_percent_of_row(spark, d):
    p = pivot.pivot(table(spark, d, "lineitem"), ["l_returnflag"], "l_linestatus", "l_quantity", items=["F", "O"], totals=False, percent_of_row=True)
    return p.select("l_returnflag", *(r2(F.col(c), 6).alias(c) for c in ("F", "O")))


@query("SELECT round(sum(l_quantity), 2) v FROM lineitem WHERE l_returnflag = 'A'")
def getpivotdata(spark, d):
    p = pivot.pivot(table(spark, d, "lineitem"), ["l_returnflag"], None, "l_quantity")
    return pivot.getpivotdata(p, "total", l_returnflag="A").select(r2(F.col("total")).alias("v"))


@query("SELECT o_orderkey FROM orders WHERE o_totalprice >= (SELECT min(p) FROM (SELECT o_totalprice p FROM orders ORDER BY 1 DESC LIMIT 20))")
def filter_top10(spark, d):
    return filters.top(table(spark, d, "orders"), "o_totalprice", 20).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)")
def filter_above_average(spark, d):
    return filters.average(table(spark, d, "orders"), "o_totalprice").select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE month(o_orderdate) = 3 OR (o_orderdate >= TIMESTAMP '1995-04-01' AND o_orderdate < TIMESTAMP '1995-07-01')")
def filter_periods(spark, d):
    today = dt.date(1995, 5, 17)
    return table(spark, d, "orders").where(filters.period("o_orderdate", "M3", today) | filters.period("o_orderdate", "thisQuarter", today)).select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE (p_size >= 10 AND p_size < 20) AND lower(p_type) IN (SELECT lower(p_type) FROM part WHERE p_partkey <= 3)")
def filter_custom(spark, d):
    p = table(spark, d, "part")
    allowed = [r.p_type for r in p.where("p_partkey <= 3").select("p_type").collect()]
    return p.where(filters.custom("p_size", [("greaterThanOrEqual", 10), ("lessThan", 20)]) & filters.values("p_type", allowed)).select("p_partkey")


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'negative' WHEN c_acctbal BETWEEN 0 AND 1000 THEN 'low' END rule, n > 1 duplicate FROM (SELECT *, count(*) OVER (PARTITION BY lower(c_mktsegment)) n FROM customer)")
def conditional_format(spark, d):
    c = rules.duplicates(table(spark, d, "customer"), "c_mktsegment")
    return c.select("c_custkey", rules.first_rule([("negative", rules.cell_is("c_acctbal", "lessThan", 0)), ("low", rules.cell_is("c_acctbal", "between", 0, 1000))]).alias("rule"), "duplicate")


@query("SELECT l_orderkey, l_linenumber, concat_ws(',', CASE WHEN l_quantity > 45 THEN 'quantity' END, CASE WHEN lower(l_returnflag) NOT IN ('a', 'n') THEN 'flag' END) broken FROM lineitem WHERE l_quantity > 45 OR lower(l_returnflag) NOT IN ('a', 'n')")
def data_validation(spark, d):
    found = rules.violations(table(spark, d, "lineitem"), {"quantity": rules.valid("l_quantity", "whole", "between", 1, 45), "flag": rules.valid("l_returnflag", "list", items=["A", "N"])})
    return found.select("l_orderkey", "l_linenumber", F.array_join("broken", ",").alias("broken"))


@query("SELECT 'l_quantity' AS \"column\", count(*) cells, round(sum(l_quantity), 2) AS \"sum\", min(l_quantity) AS \"min\" FROM lineitem UNION ALL SELECT 'l_tax', count(*), round(sum(l_tax), 2), min(l_tax) FROM lineitem")
def range_profile(spark, d):
    return rules.profile(table(spark, d, "lineitem"), ["l_quantity", "l_tax"]).select("column", "cells", r2(F.col("sum")).alias("sum"), "min")


@query("SELECT n_nationkey, 'n_name' AS \"column\", n_name AS value FROM nation WHERE lower(n_name) LIKE '%an%'")
def find_cells(spark, d):
    return rules.find(table(spark, d, "nation").select("n_nationkey", "n_name"), ["n_nationkey"], "AN")


@query("SELECT s_suppkey, 'changed' change, 's_acctbal' AS \"column\" FROM supplier WHERE s_suppkey % 7 = 0")
def table_diff(spark, d):
    s = table(spark, d, "supplier")
    edited = s.withColumn("s_acctbal", F.when(F.col("s_suppkey") % 7 == 0, F.col("s_acctbal") + 1).otherwise(F.col("s_acctbal")))
    return rules.diff(s, edited, ["s_suppkey"]).select("s_suppkey", "change", "column")


@query("SELECT s_suppkey, CASE WHEN s_suppkey <= 5 THEN 0.0::DOUBLE ELSE s_acctbal END s_acctbal FROM supplier UNION ALL SELECT 1000000, 1.5::DOUBLE")
def set_cells(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    edits = s.where("s_suppkey <= 5").withColumn("s_acctbal", F.lit(0.0)).unionByName(spark.createDataFrame([(1000000, 1.5)], "s_suppkey long, s_acctbal double"))
    return tables.set_cells(s, ["s_suppkey"], edits)


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) net, l_extendedprice * (1 - l_discount) * (1 + l_tax) gross FROM lineitem")
def calculated_columns(spark, d):
    made = {"net": F.col("l_extendedprice") * (1 - F.col("l_discount")), "gross": F.col("net") * (1 + F.col("l_tax"))}
    return tables.calculated_columns(table(spark, d, "lineitem"), made).select("l_orderkey", "l_linenumber", "net", "gross")


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 4) reduce_, round(list_max(embedding)::DOUBLE, 6) byrow_max FROM embeddings")
def map_reduce_rows(spark, d):
    e = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", r2(F.aggregate(F.transform(e, lambda x: x * x), F.lit(0.0), lambda s, x: s + x), 4).alias("reduce_"), r2(F.array_max(e), 6).alias("byrow_max"))
