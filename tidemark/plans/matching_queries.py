"""Waveform costs, assignment and posteriors over the vector table's batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.config import MATCHERS, BayesConfig
from tidemark.functions import columns as col
from tidemark.functions.kernels import cost_column, terms_column
from tidemark.operators import assign, bayes, matchers
from tidemark.plans import fixtures as fx
from tidemark.plans.registry import query

WITH = f"WITH {fx.WAVE} "


def r6(c, name=None):
    return F.round(c, 6).alias(name or c)


def _pairs(spark, sf_dir):
    return fx.pairs(spark, sf_dir).withColumn("delta", F.abs(F.col("row") - F.col("slot")).cast("double"))


def _joined(v):
    return F.expr(f"array_join(transform({v}, x -> cast(cast(round(x * 1000000) as bigint) as string)), ',')")


_Z = "CASE WHEN list_aggregate({v}, 'stddev_pop') < 1e-6 THEN list_transform({v}, lambda x: 0.0::DOUBLE) ELSE list_transform({v}, lambda x: (x - list_avg({v})) / list_aggregate({v}, 'stddev_pop')) END"
_MED = "list_transform(range(0, 6), lambda k: CASE WHEN k * 12 < len({v}) THEN list_aggregate({v}[k * 12 + 1 : k * 12 + 12], 'median') ELSE list_aggregate({v}, 'median') END)"
_TXT = "array_to_string(list_transform({v}, lambda x: round(x * 1000000)::BIGINT), ',')"


@query("p7_prefix_slice", WITH + f"SELECT vec_id, {_TXT.format(v='v[1:20]')} AS head FROM wv")
def p7(spark, sf_dir):
    return fx.waveforms(spark, sf_dir).withColumn("h", F.slice("v", 1, 20)).select("vec_id", _joined("h").alias("head"))


@query("p8_z_scores", WITH + f", z AS (SELECT vec_id, {_Z.format(v='v')} AS z FROM wv) SELECT vec_id, round(z[1], 6) AS first, round(z[64], 6) AS last, round(list_sum(list_transform(z, lambda x: abs(x))), 6) AS total FROM z")
def p8(spark, sf_dir):
    z = fx.waveforms(spark, sf_dir).withColumn("z", col.z_scores("v"))
    return z.select("vec_id", r6(F.col("z")[0], "first"), r6(F.col("z")[63], "last"), r6(F.expr("aggregate(z, 0D, (a, x) -> a + abs(x))"), "total"))


@query("p9_segment_medians", WITH + f", m AS (SELECT vec_id, {_MED.format(v='v')} AS a, {_MED.format(v='v[1:40]')} AS b FROM wv) SELECT vec_id, {_TXT.format(v='a')} AS whole, {_TXT.format(v='b')} AS short FROM m")
def p9(spark, sf_dir):
    w = fx.waveforms(spark, sf_dir).withColumn("u", F.slice("v", 1, 40))
    m = w.select("vec_id", col.segment_medians("v", 12, 6).alias("a"), col.segment_medians("u", 12, 6).alias("b"))
    return m.select("vec_id", _joined("a").alias("whole"), _joined("b").alias("short"))


@query("p10_mean_gap", WITH + "SELECT row, slot, round(abs(list_avg(e) - list_avg(s)), 6) AS gap FROM pr")
def p10(spark, sf_dir):
    return _pairs(spark, sf_dir).select("row", "slot", r6(col.mean_gap("e", "s"), "gap"))


_DTW = """(list_reduce(list_prepend(list_concat([0.0::DOUBLE], list_transform(range(1, len({y}) + 1), lambda z: 1e18::DOUBLE)), list_transform(range(1, len({x}) + 1), lambda r: [r::DOUBLE])),
  lambda prev, rr: list_reduce(list_prepend([1e18::DOUBLE], list_transform(range(1, len({y}) + 1), lambda k: [k::DOUBLE])),
    lambda cur, kk: list_append(cur, CASE WHEN abs(rr[1] - kk[1]) <= 3 THEN pow({x}[rr[1]::INT] - {y}[kk[1]::INT], 2) + least(prev[kk[1]::INT + 1], cur[kk[1]::INT], prev[kk[1]::INT]) ELSE 1e18 END))))[len({y}) + 1]"""
_ZP = WITH + f", zp AS (SELECT batch, row, slot, ri, cj, same, e, s, {_Z.format(v='e')} AS ze, {_Z.format(v='s')} AS zs FROM pr) "
_STEP = f"list_avg(list_transform(list_zip({_MED.format(v='e')}, {_MED.format(v='s')}), lambda t: abs(t[1] - t[2])))"


@query("p11_banded_dtw", _ZP + f"SELECT row, slot, round({_DTW.format(x='zs', y='ze')} / 64, 6) AS dtw FROM zp")
def p11(spark, sf_dir):
    return _pairs(spark, sf_dir).withColumn("t", terms_column("e", "s")).select("row", "slot", r6("t.dtw", "dtw"))


# cells are [cost, steps of the path]; of equal ways back the diagonal goes first, then up
_PATH = """list_reduce(list_prepend(list_concat([[0.0::DOUBLE, 0.0::DOUBLE]], list_transform(range(1, len({y}) + 1), lambda z: [1e18::DOUBLE, z::DOUBLE])), list_transform(range(1, len({x}) + 1), lambda r: [[r::DOUBLE]])),
  lambda prev, rr: list_reduce(list_prepend([[1e18::DOUBLE, rr[1][1]]], list_transform(range(1, len({y}) + 1), lambda k: [[k::DOUBLE]])),
    lambda cur, kk: list_append(cur, [abs({x}[rr[1][1]::INT] - {y}[kk[1][1]::INT]) + least(prev[kk[1][1]::INT][1], prev[kk[1][1]::INT + 1][1], cur[kk[1][1]::INT][1]),
      1 + CASE WHEN prev[kk[1][1]::INT][1] <= least(prev[kk[1][1]::INT + 1][1], cur[kk[1][1]::INT][1]) THEN prev[kk[1][1]::INT][2] WHEN prev[kk[1][1]::INT + 1][1] <= cur[kk[1][1]::INT][1] THEN prev[kk[1][1]::INT + 1][2] ELSE cur[kk[1][1]::INT][2] END])))[len({y}) + 1]"""
_WAYS = (
    WITH
    + ", fl AS (SELECT batch, row, slot, ri, cj, e, s, list_transform(e, lambda x: x::FLOAT::DOUBLE) AS fe, list_transform(s, lambda x: x::FLOAT::DOUBLE) AS fs FROM pr), "
    + f"pw AS MATERIALIZED (SELECT batch, row, slot, ri, cj, e, s, {_PATH.format(x='fe', y='fs')} AS p FROM fl)"
)


@query("p12_path_dtw", _WAYS + " SELECT row, slot, round(p[1] / p[2], 6) AS dtw FROM pw")
def p12(spark, sf_dir):
    return _pairs(spark, sf_dir).withColumn("t", terms_column("e", "s")).select("row", "slot", r6("t.path", "dtw"))


_CORR = "CASE WHEN list_aggregate(e, 'stddev_pop') > 1e-8 AND list_aggregate(s, 'stddev_pop') > 1e-8 THEN list_sum(list_transform(list_zip(e, s), lambda t: (t[1] - list_avg(e)) * (t[2] - list_avg(s)))) / 64 / (list_aggregate(e, 'stddev_pop') * list_aggregate(s, 'stddev_pop')) ELSE 0.0 END"


@query("p13_correlation", WITH + f"SELECT row, slot, round({_CORR}, 6) AS corr FROM pr")
def p13(spark, sf_dir):
    return _pairs(spark, sf_dir).select("row", "slot", r6(col.correlation("e", "s"), "corr"))


@query("p14_waveform_cost", _ZP + f"SELECT row, slot, round({_DTW.format(x='zs', y='ze')} / 64 + 0.40::DOUBLE * {_STEP}, 6) AS cost FROM zp")
def p14(spark, sf_dir):
    return _pairs(spark, sf_dir).select("row", "slot", r6(cost_column("e", "s"), "cost"))


@query("p15_coarse_cost", WITH + f"SELECT row, slot, round(0.95::DOUBLE * {_STEP} + 0.05::DOUBLE * abs(list_avg(e) - list_avg(s)), 6) AS cost FROM pr")
def p15(spark, sf_dir):
    return _pairs(spark, sf_dir).withColumn("t", terms_column("e", "s")).select("row", "slot", r6("t.coarse", "cost"))


_HOLES = WITH + f""", h AS (SELECT row, slot, list_filter(list_zip(e, s, range(0, 64)), lambda t: (t[3] + row) % 3 <> 0) AS z FROM pr), k AS (SELECT row, slot, list_transform(z, lambda t: t[1]) AS e, list_transform(z, lambda t: t[2]) AS s FROM h) SELECT row, slot, round({_STEP}, 6) AS step FROM k"""


@query("p16_shared_points", _HOLES)
def p16(spark, sf_dir):
    holes = _pairs(spark, sf_dir).withColumn("e", F.expr("transform(e, (x, i) -> if((i + row) % 3 = 0, null, x))"))
    return holes.withColumn("t", terms_column("e", "s")).select("row", "slot", r6("t.step", "step"))


@query("p17_cost_terms", WITH + f"SELECT row, slot, round({_STEP}, 6) AS step, round({_CORR}, 6) AS corr, round(abs(list_avg(e) - list_avg(s)), 6) AS gap FROM pr")
def p17(spark, sf_dir):
    return _pairs(spark, sf_dir).withColumn("t", terms_column("e", "s")).select("row", "slot", r6("t.step", "step"), r6("t.corr", "corr"), r6("t.mean", "gap"))


# assignment on mean absolute differences, which SQL can give

_L1 = "list_avg(list_transform(list_zip(e, s), lambda t: abs(t[1] - t[2])))"
_CO = WITH + f", co AS (SELECT batch, row, slot, ri, cj, same, {_L1} + 1e-6::DOUBLE * (ri + 0.01::DOUBLE * cj) AS c FROM pr) "


def _edges(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    return p.withColumn("cost", col.mean_abs("e", "s") + matchers.tie_break())


@query("m5_tie_break", _CO + "SELECT row, slot, round(c, 7) AS cost FROM co")
def m5(spark, sf_dir):
    return _edges(spark, sf_dir).select("row", "slot", F.round("cost", 7).alias("cost"))


def _cheapest(cost: str, source: str) -> str:
    """SQL relations up to `chosen`, the cheapest of all matchings of 5 x 5 batches."""
    at = ", ".join(f"max(CASE WHEN ri = {i} AND cj = {j} THEN {cost} END) AS c{i}{j}, max(CASE WHEN cj = {j} THEN slot END) AS s{j}" if i == 0 else f"max(CASE WHEN ri = {i} AND cj = {j} THEN {cost} END) AS c{i}{j}" for i in range(5) for j in range(5))
    rows = ", ".join(f"max(CASE WHEN ri = {i} THEN row END) AS r{i}" for i in range(5))
    pick = lambda i, names: f"list_extract([{names}], p{i} + 1)"
    total = " + ".join(pick(i, ", ".join(f"c{i}{j}" for j in range(5))) for i in range(5))
    slots = ", ".join(f"s{j}" for j in range(5))
    return (
        f", wide AS (SELECT batch, {at}, {rows} FROM {source} GROUP BY batch HAVING count(*) = 25), k AS (SELECT unnest(range(0, 5)) AS p), perm AS (SELECT a.p AS p0, b.p AS p1, c.p AS p2, d.p AS p3, e.p AS p4 FROM k a, k b, k c, k d, k e WHERE len(list_distinct([a.p, b.p, c.p, d.p, e.p])) = 5), "
        f"every AS (SELECT batch, {total} AS total, [{', '.join(pick(i, slots) for i in range(5))}] AS chosen, [{', '.join(f'r{i}' for i in range(5))}] AS rows_ FROM wide, perm), best AS (SELECT batch, arg_min(chosen, total) AS chosen, any_value(rows_) AS rows_ FROM every GROUP BY batch)"
        ", chosen AS (SELECT batch, unnest(rows_) AS row, unnest(chosen) AS slot FROM best)"
    )


def _enumerated(cost: str, source: str) -> str:
    return _cheapest(cost, source) + " SELECT batch, row, slot FROM chosen"


def _full(edges):
    """Batches of five by five."""
    full = edges.groupBy("batch").agg(F.count("*").alias("n")).where("n = 25").select("batch")
    return edges.join(full, "batch")


@query("m1_optimal_assignment", _CO + _enumerated("c", "co"))
def m1(spark, sf_dir):
    return assign.assigned(_full(_edges(spark, sf_dir)), "optimal").select("batch", "row", "slot")


_PICKS = "".join(
    f", g{k} AS (SELECT o.batch, o.row, (SELECT arg_min(c.slot, c.c) FROM co c WHERE c.row = o.row" + "".join(f" AND c.slot <> p{i}.slot" for i in range(1, k)) + f") AS slot FROM ord o" + "".join(f" JOIN g{i} p{i} ON p{i}.batch = o.batch" for i in range(1, k)) + f" WHERE o.k = {k})"
    for k in range(1, 6)
)
_PICKED = ", ra AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY c, slot) AS q FROM co), mg AS (SELECT batch, row, min(c) FILTER (q = 1) AS b, min(c) FILTER (q = 2) - min(c) FILTER (q = 1) AS m FROM ra GROUP BY ALL), ord AS (SELECT batch, row, row_number() OVER (PARTITION BY batch ORDER BY m DESC, b, row) AS k FROM mg)" + _PICKS + ", chosen AS (" + " UNION ALL ".join(f"SELECT * FROM g{k}" for k in range(1, 6)) + ")"
_GREEDY = _CO + _PICKED + " SELECT batch, row, slot FROM chosen"


@query("m4_greedy_assignment", _GREEDY)
def m4(spark, sf_dir):
    # batches of any size; where slots are fewer than rows, the last rows have none
    found = assign.assigned(_edges(spark, sf_dir), "greedy")
    return found.select("batch", "row", F.when(~F.col("fallback"), F.col("slot")).alias("slot"))


_ALLOWED = "(same OR (ri + cj) % 4 <> 0) AND NOT (ri = 2 AND batch % 3 = 0)"


@query("m2_forbidden_pairs", _CO + f", al AS (SELECT *, {_ALLOWED} AS allowed FROM co), fb AS (SELECT batch, row, slot, ri, cj, allowed, CASE WHEN allowed THEN c ELSE max(c) FILTER (allowed) OVER (PARTITION BY batch) + 1 END AS c FROM al)" + _cheapest("c", "fb") + " SELECT batch, row, slot, allowed FROM chosen JOIN fb USING (batch, row, slot)")
def m2(spark, sf_dir):
    # in each third batch one row has no allowed slot: it gets the one that is left, at an infinite cost
    e = _edges(spark, sf_dir).withColumn("cost", F.expr(f"if({_ALLOWED}, cost, null)"))
    return assign.assigned(_full(e), "penalised").select("batch", "row", "slot", (F.col("cost") < float("inf")).alias("allowed"))


@query("m3_drop_forbidden", _CO + "SELECT batch, row, arg_min(slot, c) AS slot FROM co WHERE cj = 0 GROUP BY ALL")
def m3(spark, sf_dir):
    # one slot a batch: the cheapest row gets it, the others fall back to it
    return assign.assigned(_edges(spark, sf_dir).where("cj = 0"), "optimal").select("batch", "row", "slot")


@query("w6_batch_min_max", _CO + "SELECT row, slot, round((c - min(c) OVER w) / (max(c) OVER w - min(c) OVER w), 6) AS scaled FROM co WINDOW w AS (PARTITION BY batch)")
def w6(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("batch")
    low, high = F.min("cost").over(w), F.max("cost").over(w)
    return _edges(spark, sf_dir).select("row", "slot", F.round((F.col("cost") - low) / (high - low), 6).alias("scaled"))


# posterior

_N1 = "list_avg(list_transform(list_zip(e[1:38], s[1:38]), lambda t: abs(t[1] - t[2])))"
_B0 = WITH + f", x AS (SELECT batch, row, slot, ri, cj, abs(row - slot)::DOUBLE AS d, {_N1} AS c1, {_L1} AS c2 FROM pr) "
_NORM = "greatest({x}, 1e-9) / sum(greatest({x}, 1e-9)) OVER (PARTITION BY row)"
_PRIOR = ", st AS (SELECT row, greatest(quantile_cont(d, 0.75), 1.0) AS sc, count(*) AS n FROM x GROUP BY row), a1 AS (SELECT x.*, n, exp(-(d / sc)) AS raw FROM x JOIN st USING (row)), a2 AS (SELECT *, " + _NORM.format(x="raw") + " AS sh FROM a1), a3 AS (SELECT *, 0.35::DOUBLE * sh + 0.65::DOUBLE / n AS mx FROM a2), pri AS (SELECT *, " + _NORM.format(x="mx") + " AS prior FROM a3) "
_B1 = _B0 + _PRIOR


def _like(cost: str, source: str, out: str) -> str:
    return (
        f", l{out}0 AS (SELECT row, min({cost}) AS lo, max({cost}) AS hi, median({cost}) AS md, mad({cost}) AS mad_, stddev_pop({cost}) AS sd FROM {source} GROUP BY row), "
        f"l{out}1 AS (SELECT s.*, exp(-least((s.{cost} - lo) / CASE WHEN mad_ > 1e-6 THEN mad_ WHEN sd > 1e-6 THEN sd WHEN hi - lo > 1e-6 THEN hi - lo ELSE 1.0 END, 80.0)) AS raw_{out} FROM {source} s JOIN l{out}0 USING (row)), "
        f"l{out}2 AS (SELECT *, " + _NORM.format(x=f"raw_{out}") + f" AS like{out} FROM l{out}1)"
    )


def _post(source: str, before: str, like: str, power: str, out: str) -> str:
    return (
        f", u{out}0 AS (SELECT *, 0.60::DOUBLE * ln(greatest({before}, 1e-9)) + {power}::DOUBLE * ln(greatest(prior, 1e-9)) + ln(greatest({like}, 1e-9)) AS s{out} FROM {source}), "
        f"u{out}1 AS (SELECT *, exp(s{out} - max(s{out}) OVER (PARTITION BY row)) AS e{out} FROM u{out}0), u{out} AS (SELECT *, e{out} / sum(e{out}) OVER (PARTITION BY row) AS post{out} FROM u{out}1)"
    )


_STAGES = _like("c1", "pri", "1") + _post("l12", "1.0 / n", "like1", "1.0", "1") + _like("c2", "u1", "2") + _post("l22", "post1", "like2", "0.2", "2") + ", fin AS (SELECT *, 0.85::DOUBLE * -ln(greatest(post2, 1e-9)) + 0.15::DOUBLE * -ln(greatest(like2, 1e-9)) AS cost FROM u2) "
_B3 = _B1 + _STAGES


def _staged(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    cut = p.withColumn("_n", matchers.prefix_points(F.size("e"), 0.6, 4)).withColumn("_e", F.expr("slice(e, 1, _n)")).withColumn("_s", F.expr("slice(s, 1, _n)"))
    return cut.withColumn("c1", col.mean_abs("_e", "_s")).withColumn("c2", col.mean_abs("e", "s")).drop("_e", "_s", "_n", "e", "s")


def _posterior(spark, sf_dir):
    return bayes.posterior(_staged(spark, sf_dir), ["batch", "row"], "delta", ["c1", "c2"], BayesConfig())


@query("b1_time_prior", _B1 + "SELECT row, slot, round(prior, 6) AS prior FROM pri")
def b1(spark, sf_dir):
    return bayes.time_prior(_staged(spark, sf_dir), ["batch", "row"], "delta", BayesConfig()).select("row", "slot", r6("prior"))


@query("b2_likelihood", _B1 + _like("c1", "pri", "1") + " SELECT row, slot, round(like1, 6) AS like1 FROM l12")
def b2(spark, sf_dir):
    return bayes.likelihood(_staged(spark, sf_dir), ["batch", "row"], "c1", "like1", BayesConfig()).select("row", "slot", r6("like1"))


@query("b3_posterior", _B3 + "SELECT row, slot, round(post1, 6) AS post1, round(post2, 6) AS post2, round(cost, 5) AS cost FROM fin")
def b3(spark, sf_dir):
    return _posterior(spark, sf_dir).select("row", "slot", r6("post1"), r6("post2"), F.round("cost", 5).alias("cost"))


@query("b4_normalised", _B1 + "SELECT row, round(sum(prior), 6) AS total, round(min(prior), 6) AS least, count(*) AS slots FROM pri GROUP BY row")
def b4(spark, sf_dir):
    p = bayes.time_prior(_staged(spark, sf_dir), ["batch", "row"], "delta", BayesConfig())
    return p.groupBy("row").agg(r6(F.sum("prior"), "total"), r6(F.min("prior"), "least"), F.count("*").alias("slots"))


@query("b5_top_two", _B3 + ", t AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY post2 DESC, slot) AS k FROM fin) SELECT row, max(slot) FILTER (k = 1) AS top_slot, round(max(post2) FILTER (k = 1), 6) AS top1, round(max(post2) FILTER (k = 2), 6) AS top2, round(max(post2) FILTER (k = 1) - max(post2) FILTER (k = 2), 6) AS gap FROM t GROUP BY row")
def b5(spark, sf_dir):
    return bayes.top_two(_posterior(spark, sf_dir), ["row"], "post2").select("row", "top_slot", r6("top1"), r6("top2"), r6("gap"))


@query("b6_stage_points", WITH + "SELECT row, slot, least(greatest(4, round_even(0.6 * len(e), 0)::INT), len(e))::INT AS n1, len(e)::INT AS n2 FROM pr")
def b6(spark, sf_dir):
    return _pairs(spark, sf_dir).select("row", "slot", matchers.prefix_points(F.size("e"), 0.6, 4).alias("n1"), matchers.prefix_points(F.size("e"), 1.0, 4).alias("n2"))


_B7 = (
    _B3
    + ", k0 AS (SELECT row, slot, post1, post2, 1.0 / n AS c1, 0.60::DOUBLE * ln(1.0 / n) + ln(greatest(prior, 1e-9)) AS s2, "
    + "0.60::DOUBLE * ln(greatest(post1, 1e-9)) AS s4, 0.60::DOUBLE * ln(greatest(post1, 1e-9)) + 0.2::DOUBLE * ln(greatest(prior, 1e-9)) AS s5 FROM fin), "
    + "k1 AS (SELECT row, slot, unnest([1, 2, 3, 4, 5, 6]) AS checkpoint, unnest([c1, exp(s2) / sum(exp(s2)) OVER w, post1, exp(s4) / sum(exp(s4)) OVER w, exp(s5) / sum(exp(s5)) OVER w, post2]) AS p FROM k0 WINDOW w AS (PARTITION BY row)), "
    + "k2 AS (SELECT *, row_number() OVER (PARTITION BY row, checkpoint ORDER BY p DESC, slot) AS k FROM k1) "
    + "SELECT row, checkpoint, round(max(p) FILTER (k = 1), 6) AS top1, round(max(p) FILTER (k = 2), 6) AS top2, CASE WHEN checkpoint = 6 THEN max(slot) FILTER (k = 1) END AS top_slot FROM k2 GROUP BY row, checkpoint"
)


@query("b7_checkpoints", _B7)
def b7(spark, sf_dir):
    """The top slot at the last checkpoint only: before it, slots can be equal but for rounding."""
    found = bayes.checkpoints(_posterior(spark, sf_dir), ["row"], BayesConfig())
    return found.select("row", "checkpoint", r6("top1"), r6("top2"), F.when(F.col("checkpoint") == 6, F.col("top_slot")).alias("top_slot"))


@query("w7_softmax", _B0 + "SELECT row, slot, round(exp(-c1 + min(c1) OVER w) / sum(exp(-c1)) OVER w * exp(-min(c1) OVER w), 6) AS p FROM x WINDOW w AS (PARTITION BY row)")
def w7(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("row")
    risen = _staged(spark, sf_dir).withColumn("_e", F.exp(F.min("c1").over(w) - F.col("c1")))
    return risen.select("row", "slot", F.round(F.col("_e") / F.sum("_e").over(w), 6).alias("p"))


@query("p34_near_tie", _B3 + ", g AS (SELECT row, max(post2) AS top FROM fin GROUP BY row) SELECT row, slot, top - post2 < 0.05 AS near FROM fin JOIN g USING (row)")
def p34(spark, sf_dir):
    from pyspark.sql import Window

    return _posterior(spark, sf_dir).select("row", "slot", (F.max("post2").over(Window.partitionBy("row")) - F.col("post2") < 0.05).alias("near"))


# the registry's matchers



def _wave(n: int) -> str:
    """SQL relations up to c{n}, the waveform cost over the first n points."""
    return (
        f", w{n} AS (SELECT batch, row, slot, ri, cj, e[1:{n}] AS e, s[1:{n}] AS s FROM pr), z{n} AS (SELECT *, {_Z.format(v='e')} AS ze, {_Z.format(v='s')} AS zs FROM w{n}), "
        f"c{n} AS MATERIALIZED (SELECT batch, row, slot, ri, cj, {_DTW.format(x='zs', y='ze')} / {n} + 0.40::DOUBLE * {_STEP} AS c FROM z{n})"
    )


def _ranked(cost: str, source: str) -> str:
    """SQL relation co: the costs of full batches with what breaks ties."""
    return f", co AS MATERIALIZED (SELECT batch, row, slot, ri, cj, {cost} + 1e-6::DOUBLE * (ri + 0.01::DOUBLE * cj) AS c FROM {source} QUALIFY count(*) OVER (PARTITION BY batch) = 25)"


_FOUND = " SELECT batch, row, slot, round(c, 5) AS cost, false AS fallback FROM chosen JOIN co USING (batch, row, slot)"
_SINGLE = WITH + _wave(64) + _ranked("c", "c64")
# 38 of 64 points are the share 0.6
_BOTH = WITH + _wave(38) + _wave(64) + ", x AS (SELECT batch, row, slot, ri, cj, abs(row - slot)::DOUBLE AS d, a.c AS c1, b.c AS c2 FROM c38 a JOIN c64 b USING (batch, row, slot, ri, cj))"
_TWO = _BOTH + _ranked("(c1 + c2) / 2", "x")
_SIMILAR = (
    _WAYS
    + f", sm AS (SELECT batch, row, slot, ri, cj, p[1] / p[2] AS d, ({_CORR} + 1) / 2 AS r FROM pw), nr AS (SELECT *, min(d) OVER w AS lo, max(d) OVER w AS hi FROM sm WINDOW w AS (PARTITION BY batch))"
    + _ranked("1 - r * CASE WHEN hi = lo THEN 1.0 ELSE 1 - (d - lo) / (hi - lo) END", "nr")
)
_BELIEF = _BOTH + _PRIOR + _STAGES + _ranked("cost", "fin")


def _match(name: str):
    def run(spark, sf_dir):
        return matchers.matched(_full(_pairs(spark, sf_dir)), MATCHERS[name]).select("batch", "row", "slot", F.round("cost", 5).alias("cost"), "fallback")

    return run


query("m6_time_only")(_match("time_only"))
query("m7_single_only", _SINGLE + _PICKED + _FOUND)(_match("single_only"))
query("m8_similarity", _SIMILAR + _cheapest("c", "co") + _FOUND)(_match("nomura_original_hungarian"))
query("m9_bayesian", _BELIEF + _cheapest("c", "co") + _FOUND)(_match("bayesian_windowed"))
query("m10_two_prefix_greedy", _TWO + _PICKED + _FOUND)(_match("two_prefix_greedy"))
query("m11_two_prefix_optimal", _TWO + _cheapest("c", "co") + _FOUND)(_match("two_prefix_hungarian"))


@query("m12_ablations")
def m12(spark, sf_dir):
    """Every variant of the registry with its share of right rows."""
    from functools import reduce

    pairs = _full(_pairs(spark, sf_dir))
    every = reduce(lambda a, b: a.unionByName(b), (matchers.matched(pairs, m) for n, m in MATCHERS.items() if n.endswith("_off")))
    truth = pairs.select("row", "slot", "same")
    return every.join(truth, ["row", "slot"]).groupBy("algorithm_id").agg(F.count("*").alias("rows_"), F.count_if("same").alias("correct"), F.count_if("fallback").alias("fallbacks"))
