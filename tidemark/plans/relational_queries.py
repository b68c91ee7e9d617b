"""Filters, scalars, joins, sorts and set operations over patterns, runs and orders."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import columns as col
from tidemark.plans import fixtures as fx
from tidemark.plans.registry import query
from tidemark.session import table

PAT = f"WITH {fx.PAT} "
RUN = f"WITH {fx.RUNS} "


def r6(c, name=None):
    return F.round(c, 6).alias(name or c)


@query("p1_equality_filter", RUN + "SELECT * FROM runs WHERE algorithm_id = 'R' AND cell = 'F' AND repeat_idx = 1")
def p1(spark, sf_dir):
    return fx.runs(spark, sf_dir).where(col.equals({"algorithm_id": "R", "cell": "F", "repeat_idx": 1}))


@query("p2_tolerant_equality", RUN + "SELECT * FROM runs WHERE abs(discount - 0.05::DOUBLE) <= greatest(1e-9, 0.05::DOUBLE * 1e-6) AND NOT isnan(discount)")
def p2(spark, sf_dir):
    return fx.runs(spark, sf_dir).where(col.close("discount", 0.05))


@query("p3_held_out_slice", RUN + "SELECT algorithm_id, cell, count(*) AS n FROM runs WHERE repeat_idx >= CASE algorithm_id WHEN 'A' THEN 1 WHEN 'N' THEN 3 WHEN 'R' THEN 5 END GROUP BY ALL")
def p3(spark, sf_dir):
    first = F.create_map(F.lit("A"), F.lit(1), F.lit("N"), F.lit(3), F.lit("R"), F.lit(5))
    return fx.runs(spark, sf_dir).where(F.col("repeat_idx") >= F.try_element_at(first, F.col("algorithm_id"))).groupBy("algorithm_id", "cell").agg(F.count("*").alias("n"))


_SUM = "list_sum(list_transform(list_zip({a}, {b}), lambda t: abs(t[1] - t[2])))"


def _twice(spark, sf_dir):
    p = fx.patterns(spark, sf_dir)
    q = p.select(F.col("pattern_idx").alias("other"), F.col("p").alias("q"))
    return p, q


@query("p18_pattern_l1", PAT + f"SELECT a.pattern_idx, b.pattern_idx AS other, {_SUM.format(a='a.p[2:6]', b='b.p[2:6]')} AS l1 FROM pat a JOIN pat b ON b.pattern_idx = a.pattern_idx + 1")
def p18(spark, sf_dir):
    p, q = _twice(spark, sf_dir)
    return p.join(q, F.col("other") == F.col("pattern_idx") + 1).select("pattern_idx", "other", col.l1("p", "q").alias("l1"))


_PZ = "CASE WHEN list_aggregate({v}, 'stddev_pop') < 1e-6 THEN list_transform({v}, lambda x: 0.0::DOUBLE) ELSE list_transform({v}, lambda x: (x - list_avg({v})) / list_aggregate({v}, 'stddev_pop')) END"
_PROXY = PAT + f""", z AS (SELECT pattern_idx, p, {_PZ.format(v='p')} AS z, list_transform(range(2, 7), lambda k: p[k] - p[k - 1]) AS d FROM pat)
SELECT a.pattern_idx, b.pattern_idx AS other, round(sqrt(list_sum(list_transform(list_zip(a.z, b.z), lambda t: (t[1] - t[2]) * (t[1] - t[2])))) + 0.05::DOUBLE * {_SUM.format(a='a.p', b='b.p')} / 6 + 0.02::DOUBLE * {_SUM.format(a='a.d', b='b.d')} / 5 + 0.01::DOUBLE * abs(list_avg(a.p) - list_avg(b.p)), 6) AS far FROM z a JOIN z b ON b.pattern_idx = a.pattern_idx + 1"""


@query("p19_proxy_distance", _PROXY)
def p19(spark, sf_dir):
    p, q = _twice(spark, sf_dir)
    return p.join(q, F.col("other") == F.col("pattern_idx") + 1).select("pattern_idx", "other", r6(col.proxy_distance("p", "q"), "far"))


_PP = PAT + f", pp AS (SELECT a.pattern_idx AS a, b.pattern_idx AS b, {_SUM.format(a='a.p[2:6]', b='b.p[2:6]')} AS l1 FROM pat a JOIN pat b ON a.pattern_idx < b.pattern_idx) "


def _pattern_pairs(spark, sf_dir):
    # a codebook has at most some hundred patterns: its pairs are the result
    p, q = _twice(spark, sf_dir)
    return p.join(F.broadcast(q), F.col("pattern_idx") < F.col("other")).select(F.col("pattern_idx").alias("a"), F.col("other").alias("b"), col.l1("p", "q").alias("l1"))


@query("j14_pattern_pairs", _PP + "SELECT a, b, l1 FROM pp")
def j14(spark, sf_dir):
    return _pattern_pairs(spark, sf_dir)


@query("p20_codebook_statistics", _PP + ", g AS (SELECT min(list_min(list_transform(range(3, 7), lambda k: abs(p[k] - p[k - 1])))) AS consecutive, min(list_min(flatten(list_transform(range(2, 6), lambda i: list_transform(range(i + 1, 7), lambda j: abs(p[i] - p[j])))))) AS internal, count(DISTINCT p) AS patterns FROM pat) SELECT patterns, min(l1) AS l1_min, round(avg(l1), 6) AS l1_mean, any_value(consecutive) AS consecutive_min, any_value(internal) AS internal_min FROM pp, g GROUP BY patterns")
def p20(spark, sf_dir):
    p = fx.patterns(spark, sf_dir)
    gap = F.expr("array_min(transform(sequence(2, 5), k -> abs(p[k] - p[k - 1])))")
    any_two = F.expr("array_min(flatten(transform(sequence(1, 4), i -> transform(sequence(i + 1, 5), j -> abs(p[i] - p[j])))))")
    own = p.agg(F.min(gap).alias("consecutive_min"), F.min(any_two).alias("internal_min"), F.count_distinct("p").alias("patterns"))
    return _pattern_pairs(spark, sf_dir).agg(F.min("l1").alias("l1_min"), r6(F.avg("l1"), "l1_mean")).crossJoin(F.broadcast(own))


@query("j18_nearest_pattern", _PP + ", bo AS (SELECT a, b, l1 FROM pp UNION ALL SELECT b, a, l1 FROM pp) SELECT a, b, l1 FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY l1, b) AS k FROM bo) WHERE k = 1")
def j18(spark, sf_dir):
    pp = _pattern_pairs(spark, sf_dir)
    both = pp.unionByName(pp.select(F.col("b").alias("a"), F.col("a").alias("b"), "l1"))
    return both.groupBy("a").agg(F.min(F.struct("l1", "b")).alias("m")).select("a", "m.b", "m.l1")


@query("j19_nearest_of_candidates", _PP + ", bo AS (SELECT a, b, l1 FROM pp UNION ALL SELECT b, a, l1 FROM pp) SELECT a, min(l1) FILTER (b % 4 <> a % 4) AS nearest, count(*) FILTER (b % 4 <> a % 4) AS others FROM bo GROUP BY a")
def j19(spark, sf_dir):
    pp = _pattern_pairs(spark, sf_dir)
    both = pp.unionByName(pp.select(F.col("b").alias("a"), F.col("a").alias("b"), "l1"))
    other = F.col("b") % 4 != F.col("a") % 4
    return both.groupBy("a").agg(F.min(F.when(other, F.col("l1"))).alias("nearest"), F.count_if(other).alias("others"))


_BINS = "CASE WHEN l1 <= 40 THEN '0-40' WHEN l1 <= 60 THEN '41-60' WHEN l1 <= 80 THEN '61-80' ELSE '81+' END"


@query("p25_separation_bins", _PP + f"SELECT {_BINS} AS bin, count(*) AS n FROM pp GROUP BY 1")
def p25(spark, sf_dir):
    return _pattern_pairs(spark, sf_dir).groupBy(col.label_of(F.col("l1"), [40, 60, 80], ["0-40", "41-60", "61-80", "81+"]).alias("bin")).agg(F.count("*").alias("n"))


@query("p28_pattern_text", PAT + "SELECT pattern_idx, array_to_string(list_transform(p, lambda x: x::BIGINT), '|') AS txt, list_sum(list_transform(p, lambda x: x::BIGINT))::BIGINT AS total FROM pat")
def p28(spark, sf_dir):
    t = fx.patterns(spark, sf_dir).select("pattern_idx", col.to_pattern_text("p").alias("txt"))
    return t.withColumn("total", F.aggregate(col.from_pattern_text("txt"), F.lit(0).cast("long"), lambda s, x: s + x))


@query("w12_step_differences", PAT + ", s AS (SELECT pattern_idx, unnest(range(1, 7)) AS pos, unnest(p) AS v FROM pat) SELECT pattern_idx, pos, lead(v) OVER (PARTITION BY pattern_idx ORDER BY pos) - v AS step FROM s")
def w12(spark, sf_dir):
    s = fx.patterns(spark, sf_dir).select("pattern_idx", F.posexplode("p").alias("pos", "v"))
    return s.select("pattern_idx", (F.col("pos") + 1).cast("long").alias("pos"), (F.lead("v").over(Window.partitionBy("pattern_idx").orderBy("pos")) - F.col("v")).alias("step"))


@query("s7_command_table", PAT + "SELECT pattern_idx, 60 * (pos - 1) AS second, p[pos] AS command FROM (SELECT pattern_idx, p, unnest(range(1, 7)) AS pos FROM pat)")
def s7(spark, sf_dir):
    s = fx.patterns(spark, sf_dir).select("pattern_idx", F.posexplode("p").alias("pos", "command"))
    return s.select("pattern_idx", (60 * F.col("pos")).cast("long").alias("second"), "command")


@query("s9_inferred_spacing", PAT + "SELECT pattern_idx, 60::BIGINT AS tau FROM pat")
def s9(spark, sf_dir):
    c = s7(spark, sf_dir)
    gap = F.lead("second").over(Window.partitionBy("pattern_idx").orderBy("second")) - F.col("second")
    return c.select("pattern_idx", "second", gap.alias("gap")).where("second = 0").select("pattern_idx", F.coalesce("gap", F.lit(60)).cast("long").alias("tau"))


@query("o4_first_wins_argmin", PAT + "SELECT pattern_idx, arg_min(pos, v * 10 + pos) - 1 AS at FROM (SELECT pattern_idx, unnest(range(1, 7)) AS pos, unnest(p) AS v FROM pat) WHERE pos > 1 GROUP BY pattern_idx")
def o4(spark, sf_dir):
    s = fx.patterns(spark, sf_dir).select("pattern_idx", F.posexplode("p").alias("pos", "v")).where("pos > 0")
    return s.groupBy("pattern_idx").agg(F.min(F.struct("v", "pos")).alias("m")).select("pattern_idx", F.col("m.pos").cast("long").alias("at"))


@query("p21_ceiling", "SELECT vec_id, list_sum(list_transform(embedding, lambda x: ceil(greatest(x::DOUBLE * 10 * 1.03::DOUBLE + 0.35::DOUBLE, 0) - 1e-9)))::BIGINT AS total FROM embeddings")
def p21(spark, sf_dir):
    return fx.waveforms(spark, sf_dir).select("vec_id", F.expr("aggregate(v, 0L, (a, x) -> a + cast(ceil(greatest(x * 10 * 1.03D + 0.35D, 0D) - 1e-9D) as bigint))").alias("total"))


_TEL = f"WITH {fx.TEL} "


@query("p23_start_estimate", _TEL + ", a AS (SELECT ev, min(ts_us) AS arrival, min(ts_us) FILTER (value >= 50) AS first FROM tel GROUP BY ev) SELECT ev, least(greatest(coalesce(first, arrival) + (ev % 41 - 20) * 1000000, arrival - 30000000), arrival + 86400000000) AS start_est FROM a")
def p23(spark, sf_dir):
    a = fx.telemetry(spark, sf_dir).groupBy("ev").agg(F.min("ts_us").alias("arrival"), F.min(F.when(F.col("value") >= 50, F.col("ts_us"))).alias("first"))
    return a.select("ev", F.expr("least(greatest(coalesce(first, arrival) + (ev % 41 - 20) * 1000000, arrival - 30000000), arrival + 86400000000)").alias("start_est"))


_REASON = "CASE WHEN long_share >= 0.6 THEN 'long_session_occupancy_domination' WHEN overlap >= 0.95 THEN 'session_overlap_concentration' ELSE 'arrival_slot_full' END"


@query("p24_blocked_reason", f"WITH a AS (SELECT o_custkey, count(*) FILTER (o_totalprice > 200000) / count(*) AS long_share, count(DISTINCT o_orderpriority) / 5 AS overlap FROM orders GROUP BY o_custkey) SELECT {_REASON} AS reason, count(*) AS n FROM a GROUP BY 1")
def p24(spark, sf_dir):
    from tidemark.operators.analysis import primary_cause

    a = table(spark, sf_dir, "orders").groupBy("o_custkey").agg((F.count_if(F.col("o_totalprice") > 200000) / F.count("*")).alias("long_share"), (F.count_distinct("o_orderpriority") / 5).alias("overlap"))
    return a.groupBy(primary_cause([("long_session_occupancy_domination", F.col("long_share") >= 0.6), ("session_overlap_concentration", F.col("overlap") >= 0.95)], "arrival_slot_full").alias("reason")).agg(F.count("*").alias("n"))


@query("p26_primary_cause", "SELECT CASE WHEN l_discount > 0.08 THEN 'truncation' WHEN l_tax > 0.06 THEN 'ingestion' WHEN l_quantity > 40 THEN 'sensing' ELSE 'overlap' END AS cause, count(*) AS n FROM lineitem GROUP BY 1")
def p26(spark, sf_dir):
    from tidemark.operators.analysis import primary_cause

    c = primary_cause([("truncation", F.col("l_discount") > 0.08), ("ingestion", F.col("l_tax") > 0.06), ("sensing", F.col("l_quantity") > 40)], "overlap")
    return table(spark, sf_dir, "lineitem").groupBy(c.alias("cause")).agg(F.count("*").alias("n"))


@query("p29_half_up", "SELECT l_suppkey, round(round(1000000 * count(*) FILTER (l_returnflag = 'R') / count(*)) / 1000000, 3)::DOUBLE AS share FROM lineitem GROUP BY l_suppkey")
def p29(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("a"), F.count("*").alias("b"))
    return n.select("l_suppkey", col.half_up(F.col("a"), F.col("b"), 3).cast("double").alias("share"))


@query("p30_canonical_hash", "SELECT o_custkey, sha256(array_to_string(list_sort(list(o_orderkey || ',' || o_orderstatus)), ';')) AS signature FROM orders GROUP BY o_custkey")
def p30(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.groupBy("o_custkey").agg(col.canonical_hash(o, ["o_custkey"], ["o_orderkey", "o_orderstatus"]).alias("signature"))


@query("p31_safe_numbers", "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS k, try_cast(event_type AS DOUBLE) AS bad FROM events")
def p31(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("t", F.get_json_object("props", "$.k"))
    return e.select("event_id", col.finite("t").alias("k"), col.finite("event_type").alias("bad"))


@query("p32_text_normalised", "SELECT s_suppkey, left(lower(trim(s_name)), 12) AS title, regexp_matches(s_name, '^Supplier#[0-9]+$') AS valid FROM supplier")
def p32(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.substring(F.lower(F.trim("s_name")), 1, 12).alias("title"), F.col("s_name").rlike("^Supplier#[0-9]+$").alias("valid"))


@query("j12_left_join_checked", "SELECT o_orderkey, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_nationkey < 10")
def j12(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_nationkey < 10").select("c_custkey", "c_mktsegment")
    return table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "c_mktsegment")


@query("j12_key_is_unique", "SELECT count(*) AS rows_, count(DISTINCT c_custkey) AS keys FROM customer")
def j12u(spark, sf_dir):
    return table(spark, sf_dir, "customer").agg(F.count("*").alias("rows_"), F.count_distinct("c_custkey").alias("keys"))


@query("j13_error_cost_lookup", "SELECT l_orderkey, max(CASE WHEN l_linenumber = 1 THEN l_extendedprice END) AS true_cost, max(CASE WHEN l_linenumber = 2 THEN l_extendedprice END) AS pred_cost FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY l_orderkey")
def j13(spark, sf_dir):
    bad = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    at = lambda k: F.max(F.when(F.col("l_linenumber") == k, F.col("l_extendedprice")))
    return table(spark, sf_dir, "lineitem").join(bad, "l_orderkey", "left_semi").groupBy("l_orderkey").agg(at(1).alias("true_cost"), at(2).alias("pred_cost"))


# sorts, limits, set operations

@query("o1_custom_order", "SELECT o_orderpriority, count(*) AS n, row_number() OVER (ORDER BY list_position(['3-MEDIUM', '1-URGENT', '2-HIGH'], o_orderpriority), o_orderpriority) AS place FROM orders GROUP BY o_orderpriority")
def o1(spark, sf_dir):
    n = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    place = F.nullif(F.array_position(F.array(*map(F.lit, ("3-MEDIUM", "1-URGENT", "2-HIGH"))), F.col("o_orderpriority")), F.lit(0))
    return n.withColumn("place", F.row_number().over(Window.orderBy(place.asc_nulls_last(), "o_orderpriority")).cast("long"))


@query("o2_newest", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
def o2(spark, sf_dir):
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(50).select("o_orderkey", "o_totalprice")


@query("o3_featured_pick", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS k FROM orders WHERE o_totalprice >= 1000) WHERE k = 1")
def o3(spark, sf_dir):
    top = table(spark, sf_dir, "orders").where("o_totalprice >= 1000").groupBy("o_custkey").agg(F.min(F.struct("o_totalprice", "o_orderkey")).alias("m"))
    return top.select("o_custkey", "m.o_orderkey")


@query("o5_union_all", "SELECT s_suppkey AS id, s_acctbal AS balance, 's' AS side, NULL::VARCHAR AS segment FROM supplier UNION ALL SELECT c_custkey, c_acctbal, 'c', c_mktsegment FROM customer")
def o5(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"), F.lit("s").alias("side"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.lit("c").alias("side"), F.col("c_mktsegment").alias("segment"))
    return s.unionByName(c, allowMissingColumns=True)


@query("o6_set_union", "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def o6(spark, sf_dir):
    a = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"))
    return a.union(table(spark, sf_dir, "customer").where("c_acctbal < 0").select("c_custkey")).distinct()


@query("o7_set_difference", "SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderpriority = '1-URGENT')")
def o7(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(o, "c_custkey", "left_anti").select(F.col("c_custkey").alias("k"))


@query("o8_intersection", "SELECT DISTINCT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 5000")
def o8(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).intersect(table(spark, sf_dir, "customer").where("c_acctbal > 5000").select("c_custkey"))


@query("o9_keep_last", "SELECT user_id, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY user_id")
def o9(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("value", "event_id").alias("value"), F.max("event_id").alias("event_id"))


@query("w1_forward_fill", "SELECT event_id, last_value(CASE WHEN event_id % 3 = 0 THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS filled FROM events")
def w1(spark, sf_dir):
    own = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "events").select("event_id", F.last(F.when(F.col("event_id") % 3 == 0, F.col("value")), ignorenulls=True).over(own).alias("filled"))


@query("w9_top_two", "SELECT l_orderkey, max(l_extendedprice) FILTER (k = 1) AS top1, max(l_extendedprice) FILTER (k = 2) AS top2 FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS k FROM lineitem) GROUP BY l_orderkey")
def w9(spark, sf_dir):
    k = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber"))
    ranked = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", k.alias("k")).where("k <= 2")
    at = lambda i: F.max(F.when(F.col("k") == i, F.col("l_extendedprice")))
    return ranked.groupBy("l_orderkey").agg(at(1).alias("top1"), at(2).alias("top2"))


# dates, JSON, maps

@query("d1_dates", "SELECT event_id, epoch_us(ts) AS us, strftime(ts, '%Y-%m-%d %H:%M') AS minute, epoch_us(ts) // 5000000 * 5 AS grid FROM events")
def d1(spark, sf_dir):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", us.alias("us"), F.date_format("ts", "yyyy-MM-dd HH:mm").alias("minute"), (F.floor(us / 5000000) * 5).cast("long").alias("grid"))


@query("d2_json_default", "SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.missing') AS BIGINT), -1) AS missing, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def d2(spark, sf_dir):
    j = F.from_json("props", "k long, missing long")
    return table(spark, sf_dir, "events").withColumn("j", j).select("event_id", F.coalesce("j.missing", F.lit(-1)).cast("long").alias("missing"), "j.k")


@query("d3_math", "SELECT l_orderkey, l_linenumber, round(exp(-l_discount), 6) AS e, round(ln(l_extendedprice), 6) AS l, round(sqrt(l_quantity), 6) AS s, least(greatest(l_tax, 0.02), 0.06) AS clipped, floor(l_extendedprice)::BIGINT AS f, ceil(l_extendedprice)::BIGINT AS c FROM lineitem")
def d3(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", r6(F.exp(-F.col("l_discount")), "e"), r6(F.ln("l_extendedprice"), "l"), r6(F.sqrt("l_quantity"), "s"), F.least(F.greatest("l_tax", F.lit(0.02)), F.lit(0.06)).alias("clipped"), F.floor("l_extendedprice").cast("long").alias("f"), F.ceil("l_extendedprice").cast("long").alias("c"))


@query("d4_map_default", "SELECT l_returnflag, count(*) AS n, CASE l_returnflag WHEN 'A' THEN 1.5::DOUBLE WHEN 'N' THEN 2.5 ELSE 0.0 END AS w FROM lineitem GROUP BY l_returnflag")
def d4(spark, sf_dir):
    m = F.create_map(F.lit("A"), F.lit(1.5), F.lit("N"), F.lit(2.5))
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n")).withColumn("w", F.coalesce(F.try_element_at(m, F.col("l_returnflag")), F.lit(0.0)))
