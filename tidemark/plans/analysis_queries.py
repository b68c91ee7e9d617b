"""Aggregations over runs: cubes, intervals, paired differences, rank tests, taxonomies."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import analysis, metrics
from tidemark.plans import fixtures as fx
from tidemark.plans.registry import query
from tidemark.session import table

RUN = f"WITH {fx.RUNS} "
KEYS = ["algorithm_id", "cell"]


def r6(c, name=None):
    return F.round(c, 6).alias(name or c)


def _each(spark, sf_dir):
    """One value of each metric a run: (algorithm_id, cell, repeat_idx)."""
    return fx.runs(spark, sf_dir).groupBy(*KEYS, "repeat_idx").agg(F.avg("quantity").alias("quantity"), F.avg("price").alias("price"), F.avg("discount").alias("discount"))


_EACH = RUN + ", ea AS (SELECT algorithm_id, cell, repeat_idx, avg(quantity) AS quantity, avg(price) AS price, avg(discount) AS discount FROM runs GROUP BY ALL) "
_STATS = ", ".join(f"round(avg({m}), 6) AS {m}_mean, round(coalesce(stddev_samp({m}), 0), 6) AS {m}_std, round(1.96::DOUBLE * coalesce(stddev_samp({m}), 0) / sqrt(count({m})), 6) AS {m}_ci95" for m in ("quantity", "price", "discount"))


@query("a2g_cube", _EACH + f", cells AS (SELECT a.algorithm_id, c.cell FROM (SELECT DISTINCT algorithm_id FROM ea) a, (SELECT DISTINCT cell FROM ea) c), st AS (SELECT algorithm_id, cell, count(*) AS runs, {_STATS} FROM ea GROUP BY ALL) SELECT cells.*, coalesce(runs, 0) AS runs, " + ", ".join(f"{m}_{s}" for m in ("quantity", "price", "discount") for s in ("mean", "std", "ci95")) + " FROM cells LEFT JOIN st USING (algorithm_id, cell)")
def a2g(spark, sf_dir):
    e = _each(spark, sf_dir)
    cells = e.select("algorithm_id").distinct().crossJoin(F.broadcast(e.select("cell").distinct()))
    found = metrics.cube(cells, e, KEYS, ["quantity", "price", "discount"])
    return found.select(*KEYS, "runs", *(r6(f"{m}_{s}") for m in ("quantity", "price", "discount") for s in ("mean", "std", "ci95")))


@query("a3g_mean_std_ci", RUN + "SELECT algorithm_id, round(avg(price), 4) AS price_mean, round(stddev_samp(price), 4) AS price_std, round(1.96::DOUBLE * stddev_samp(price) / sqrt(count(price)), 4) AS price_ci95 FROM runs GROUP BY algorithm_id")
def a3g(spark, sf_dir):
    found = fx.runs(spark, sf_dir).groupBy("algorithm_id").agg(*metrics.mean_std_ci("price"))
    return found.select("algorithm_id", *(F.round(c, 4).alias(c) for c in found.columns[1:]))


@query("a4g_student_ci", _EACH + "SELECT algorithm_id, cell, round(CASE count(*) WHEN 7 THEN 2.446912::DOUBLE WHEN 6 THEN 2.570582 WHEN 5 THEN 2.776445 WHEN 4 THEN 3.182446 WHEN 3 THEN 4.302653 WHEN 2 THEN 12.706205 ELSE 0 END * coalesce(stddev_samp(quantity), 0) / sqrt(count(*)), 6) AS half FROM ea GROUP BY ALL")
def a4g(spark, sf_dir):
    return _each(spark, sf_dir).groupBy(*KEYS).agg(r6(metrics.student_ci("quantity"), "half"))


@query("a5g_welch_ci", RUN + "SELECT cell, round(1.96::DOUBLE * sqrt(var_samp(quantity) FILTER (algorithm_id = 'A') / count(*) FILTER (algorithm_id = 'A') + var_samp(quantity) FILTER (algorithm_id = 'R') / count(*) FILTER (algorithm_id = 'R')), 6) AS half FROM runs WHERE cell = 'F' GROUP BY cell")
def a5g(spark, sf_dir):
    of = lambda a: F.when(F.col("algorithm_id") == a, F.col("quantity"))
    return fx.runs(spark, sf_dir).where("cell = 'F'").groupBy("cell").agg(r6(metrics.welch_ci(F.stddev_samp(of("A")), F.count(of("A")), F.stddev_samp(of("R")), F.count(of("R"))), "half"))


@query("a6g_quantiles", RUN + "SELECT algorithm_id, quantile_cont(price, 0.5) AS p50, quantile_cont(price, 0.75) AS p75, round(quantile_cont(price, 0.9), 6) AS p90, round(quantile_cont(price, 0.99), 6) AS p99 FROM runs GROUP BY algorithm_id".replace("quantile_cont(price, 0.5)", "round(quantile_cont(price, 0.5), 6)").replace("quantile_cont(price, 0.75)", "round(quantile_cont(price, 0.75), 6)"))
def a6g(spark, sf_dir):
    return fx.runs(spark, sf_dir).groupBy("algorithm_id").agg(*(r6(F.percentile("price", q), f"p{round(q * 100)}") for q in (0.5, 0.75, 0.9, 0.99)))


@query("a12g_taxonomy", "WITH e AS (SELECT l_returnflag = 'R' AS bad, l_linestatus AS s, CASE WHEN l_quantity <= 10 THEN 'few' ELSE 'many' END AS q, l_linenumber AS k FROM lineitem), u AS (SELECT bad, 'status' AS breakdown, s AS bin FROM e UNION ALL SELECT bad, 'quantity', q FROM e UNION ALL SELECT bad, 'line', k::VARCHAR FROM e), g AS (SELECT breakdown, bin, count(*) AS sessions, count(*) FILTER (bad) AS errors FROM u GROUP BY ALL) SELECT *, round(errors / sessions, 6) AS error_rate, round(errors / sum(errors) OVER (PARTITION BY breakdown), 6) AS share_of_errors FROM g")
def a12g(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").withColumn("bad", F.col("l_returnflag") == "R")
    t = analysis.taxonomy(e, {"status": "l_linestatus", "quantity": "if(l_quantity <= 10, 'few', 'many')", "line": "l_linenumber"}, "bad")
    return t.select("breakdown", "bin", "sessions", "errors", r6("error_rate"), r6("share_of_errors"))


_ROLL = "SELECT coalesce(algorithm_id, 'all') AS algorithm_id, coalesce(bin, 'all') AS bin, count(*) AS n, round(avg(price), 4) AS price FROM (SELECT algorithm_id, price, CASE WHEN quantity <= 10 THEN '1-10' WHEN quantity <= 30 THEN '11-30' ELSE '31+' END AS bin FROM runs) GROUP BY ROLLUP (algorithm_id, bin)"


@query("a13g_rollup_bins", RUN + _ROLL)
def a13g(spark, sf_dir):
    from tidemark.functions.columns import label_of

    b = fx.runs(spark, sf_dir).withColumn("bin", label_of(F.col("quantity"), [10, 30], ["1-10", "11-30", "31+"]))
    found = b.rollup("algorithm_id", "bin").agg(F.count("*").alias("n"), F.round(F.avg("price"), 4).alias("price"))
    return found.select(F.coalesce("algorithm_id", F.lit("all")).alias("algorithm_id"), F.coalesce("bin", F.lit("all")).alias("bin"), "n", "price")


@query("a14g_totals_row", _EACH + "SELECT algorithm_id, count(*) AS runs, min(quantity) AS least, round(avg(price), 4) AS price FROM ea GROUP BY algorithm_id UNION ALL SELECT 'all', count(*), min(quantity), round(avg(price), 4) FROM ea".replace("min(quantity)", "round(min(quantity), 6)"))
def a14g(spark, sf_dir):
    e = _each(spark, sf_dir)
    aggs = [F.count("*").alias("runs"), r6(F.min("quantity"), "least"), F.round(F.avg("price"), 4).alias("price")]
    return e.groupBy("algorithm_id").agg(*aggs).unionByName(e.agg(*aggs).withColumn("algorithm_id", F.lit("all")))


@query("a17g_seed_robustness", RUN + "SELECT algorithm_id, cell, repeat_idx, round(avg(quantity), 6) AS quantity, round(avg(price), 4) AS price, round(avg(discount), 6) AS discount, count(*) AS n FROM runs GROUP BY ALL")
def a17g(spark, sf_dir):
    return fx.runs(spark, sf_dir).groupBy(*KEYS, "repeat_idx").agg(r6(F.avg("quantity"), "quantity"), F.round(F.avg("price"), 4).alias("price"), r6(F.avg("discount"), "discount"), F.count("*").alias("n"))


@query("a18g_ablation_delta", _EACH + "SELECT b.cell, b.repeat_idx, round(100 * (b.discount - a.discount), 6) AS delta FROM ea a JOIN ea b USING (cell, repeat_idx) WHERE a.algorithm_id = 'A' AND b.algorithm_id = 'R'")
def a18g(spark, sf_dir):
    p = analysis.paired(_each(spark, sf_dir), ["cell", "repeat_idx"], "algorithm_id", "discount", "R", "A")
    return p.select("cell", "repeat_idx", r6(100 * F.col("diff"), "delta"))


@query("j16_paired_difference", _EACH + "SELECT a.cell, a.repeat_idx, round(a.quantity - b.quantity, 6) AS diff FROM ea a JOIN ea b USING (cell, repeat_idx) WHERE a.algorithm_id = 'A' AND b.algorithm_id = 'R'")
def j16(spark, sf_dir):
    return analysis.paired(_each(spark, sf_dir), ["cell", "repeat_idx"], "algorithm_id", "quantity", "A", "R").select("cell", "repeat_idx", r6("diff"))


@query("j17_pairing_gate", _EACH + "SELECT cell, repeat_idx, 'N' AS missing FROM (SELECT cell, repeat_idx FROM ea WHERE algorithm_id = 'A' EXCEPT SELECT cell, repeat_idx FROM ea WHERE algorithm_id = 'N') UNION ALL SELECT cell, repeat_idx, 'A' FROM (SELECT cell, repeat_idx FROM ea WHERE algorithm_id = 'N' EXCEPT SELECT cell, repeat_idx FROM ea WHERE algorithm_id = 'A')")
def j17(spark, sf_dir):
    return analysis.unpaired(_each(spark, sf_dir), ["cell", "repeat_idx"], "algorithm_id", "A", "N")


@query("a22g_pivot", _EACH + "SELECT repeat_idx, round(avg(quantity) FILTER (algorithm_id = 'A'), 6) AS a, round(avg(quantity) FILTER (algorithm_id = 'N'), 6) AS n, round(avg(quantity) FILTER (algorithm_id = 'R'), 6) AS r FROM ea GROUP BY repeat_idx")
def a22g(spark, sf_dir):
    p = _each(spark, sf_dir).groupBy("repeat_idx").pivot("algorithm_id", ["A", "N", "R"]).avg("quantity")
    return p.select("repeat_idx", r6("A", "a"), r6("N", "n"), r6("R", "r"))


_DIFF = "WITH d AS (SELECT l_suppkey % 10 AS g, l_quantity - 25 AS diff FROM lineitem), z AS (SELECT g, diff, abs(diff) AS a FROM d WHERE diff <> 0), r AS (SELECT *, rank() OVER (PARTITION BY g ORDER BY a) + (count(*) OVER (PARTITION BY g, a) - 1) / 2 AS r FROM z), t AS (SELECT g, sum(k * k * k - k) AS tie FROM (SELECT g, a, count(*) AS k FROM z GROUP BY ALL) GROUP BY g), w AS (SELECT g, count(*) AS n, least(coalesce(sum(r) FILTER (diff > 0), 0), coalesce(sum(r) FILTER (diff < 0), 0)) AS w FROM r GROUP BY g) "


def _signed(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 10).alias("g"), (F.col("l_quantity") - 25).alias("diff"))
    return analysis.signed_rank(d, ["g"])


@query("a23g_signed_rank", _DIFF + "SELECT g, n, w, round((w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - tie / 48), 6) AS z FROM w JOIN t USING (g)")
def a23g(spark, sf_dir):
    return _signed(spark, sf_dir).select("g", "n", "w", r6("z"))


@query("a23g_holm", "WITH p AS (SELECT l_suppkey AS g, avg(l_discount) AS p FROM lineitem GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS m FROM p) SELECT g, round(least(max((m - k + 1) * p) OVER (ORDER BY p ROWS UNBOUNDED PRECEDING), 1.0), 6) AS p_holm FROM k")
def a23h(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("g")).agg(F.avg("l_discount").alias("p"))
    return analysis.holm(p).select("g", r6("p_holm"))


@query("w10_running_max", "SELECT s_suppkey, max(s_acctbal) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey ROWS UNBOUNDED PRECEDING) AS top FROM supplier")
def w10(spark, sf_dir):
    own = Window.partitionBy("s_nationkey").orderBy("s_suppkey").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.max("s_acctbal").over(own).alias("top"))


_RK = "rank() OVER (PARTITION BY g ORDER BY {c}) + (count(*) OVER (PARTITION BY g, {c}) - 1) / 2"


@query("a24g_spearman", f"WITH d AS (SELECT l_suppkey % 10 AS g, l_quantity AS x, l_extendedprice AS y FROM lineitem), r AS (SELECT g, {_RK.format(c='x')} AS rx, {_RK.format(c='y')} AS ry FROM d) SELECT g, round(corr(rx, ry), 6) AS rho FROM r GROUP BY g")
def a24g(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 10).alias("g"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    return analysis.spearman(d, ["g"], "x", "y").select("g", r6("rho"))


@query("a25g_monotone", _EACH + ", l AS (SELECT algorithm_id, cell, quantity >= lag(quantity) OVER (PARTITION BY algorithm_id, cell ORDER BY repeat_idx) AS up FROM ea) SELECT algorithm_id, cell, coalesce(bool_and(up), true) AS rising, count(*) FILTER (NOT up) AS drops FROM l GROUP BY ALL")
def a25g(spark, sf_dir):
    own = Window.partitionBy(*KEYS).orderBy("repeat_idx")
    u = _each(spark, sf_dir).withColumn("up", F.col("quantity") >= F.lag("quantity").over(own))
    return u.groupBy(*KEYS).agg(F.coalesce(F.bool_and("up"), F.lit(True)).alias("rising"), F.count_if(~F.col("up")).alias("drops"))


@query("a26g_claim_checks", "SELECT name, round(value, 4) AS value, expected, abs(value - expected) <= tolerance AS ok FROM (SELECT l_returnflag AS name, avg(l_quantity) AS value, 25.5::DOUBLE AS expected, 0.5::DOUBLE AS tolerance FROM lineitem GROUP BY 1)")
def a26g(spark, sf_dir):
    v = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("name")).agg(F.avg("l_quantity").alias("value"))
    want = spark.createDataFrame([(n, 25.5, 0.5) for n in "ANR"], "name string, expected double, tolerance double")
    return analysis.checks(v, want).where("value is not null").select("name", F.round("value", 4).alias("value"), "expected", "ok")


@query("a27g_sweep", RUN + ", s AS (SELECT repeat_idx, avg(price) AS price FROM runs WHERE algorithm_id = 'R' AND cell = 'F' GROUP BY 1) SELECT repeat_idx, round(price, 4) AS price FROM s WHERE (SELECT count(*) FROM s) >= 2")
def a27g(spark, sf_dir):
    return analysis.sweep(fx.runs(spark, sf_dir), {"algorithm_id": "R", "cell": "F"}, "repeat_idx", "price").select("repeat_idx", F.round("price", 4).alias("price"))


@query("a28g_finite_mean", RUN + "SELECT algorithm_id, round(avg(quantity) FILTER (discount > 0), 6) AS quantity, round(avg(CASE WHEN discount > 0 THEN price / discount END), 3) AS ratio FROM runs GROUP BY algorithm_id")
def a28g(spark, sf_dir):
    ratio = F.try_divide("price", "discount")
    return fx.runs(spark, sf_dir).groupBy("algorithm_id").agg(r6(F.avg(F.when(F.col("discount") > 0, F.col("quantity"))), "quantity"), F.round(F.avg(ratio), 3).alias("ratio"))


@query("a29g_trajectory", "WITH s AS (SELECT user_id, count(DISTINCT event_type) AS stages FROM events GROUP BY 1), t AS (SELECT user_id FROM s ORDER BY stages >= 4 DESC, stages DESC, user_id LIMIT 1) SELECT event_id, event_type FROM (SELECT *, row_number() OVER (ORDER BY event_id DESC) AS k FROM events WHERE user_id IN (FROM t)) WHERE k > 1")
def a29g(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    s = e.groupBy("user_id").agg(F.count_distinct("event_type").alias("stages"))
    pick = s.orderBy(F.desc(F.col("stages") >= 4), F.desc("stages"), "user_id").limit(1)
    own = e.join(F.broadcast(pick), "user_id")
    return own.withColumn("last", F.max("event_id").over(Window.partitionBy("user_id"))).where("event_id < last").select("event_id", "event_type")


@query("a30g_first_events", "SELECT success, event_id FROM (SELECT value >= 50 AS success, event_id, row_number() OVER (PARTITION BY value >= 50 ORDER BY ts, event_id) AS k FROM events) WHERE k = 1")
def a30g(spark, sf_dir):
    return analysis.first_of_each(table(spark, sf_dir, "events").select("ts", "event_id", "value"), F.col("value") >= 50, ["ts", "event_id"]).select("success", "event_id")


@query("a31g_figure_series", _EACH + "SELECT algorithm_id, cell, round(avg(quantity) - 1.96::DOUBLE * stddev_samp(quantity) / sqrt(count(*)), 6) AS low, round(avg(quantity) + 1.96::DOUBLE * stddev_samp(quantity) / sqrt(count(*)), 6) AS high FROM ea WHERE repeat_idx >= 3 GROUP BY ALL")
def a31g(spark, sf_dir):
    found = _each(spark, sf_dir).where("repeat_idx >= 3").groupBy(*KEYS).agg(*metrics.mean_std_ci("quantity"))
    return found.select(*KEYS, r6(F.col("quantity_mean") - F.col("quantity_ci95"), "low"), r6(F.col("quantity_mean") + F.col("quantity_ci95"), "high"))


@query("a13g_cube_sets", RUN + "SELECT algorithm_id, cell, count(*) AS n, sum(quantity) AS total, grouping(algorithm_id)::INT AS ga, grouping(cell)::INT AS gc FROM runs GROUP BY CUBE (algorithm_id, cell)")
def cube(spark, sf_dir):
    return fx.runs(spark, sf_dir).cube(*KEYS).agg(F.count("*").alias("n"), F.sum("quantity").alias("total"), F.grouping("algorithm_id").cast("int").alias("ga"), F.grouping("cell").cast("int").alias("gc"))
