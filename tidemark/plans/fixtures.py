"""The engine's relations over the order, event and vector tables, and the same as SQL for the checks.

One day of the order tables stands for one time unit: slots are suppliers that are busy from order to shipment,
sessions are the orders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import RuntimeConfig
from tidemark.session import table

DAYS = RuntimeConfig(window=60, grid=5, tick=5, bound=10, margin=20, bucket=60)


def day(column: str) -> Column:
    return F.unix_date(F.col(column).cast("date")).cast("long")


def slot_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(slot, st, et)"""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("slot"), day("l_shipdate").alias("et"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", day("o_orderdate").alias("st"))
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).where("et between st and st + 121").select("slot", "st", "et")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ev, arrival, start_est, session_end, gt_slot)"""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", day("o_orderdate").alias("arrival"))
    truth = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("gt_slot"))
    joined = orders.join(truth, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.select(F.col("o_orderkey").alias("ev"), "arrival", F.expr("arrival + (o_orderkey div 50) % 41 - 20").alias("start_est"), F.expr("arrival + 30 + o_custkey % 90").alias("session_end"), "gt_slot")


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ev, event_id, ts_us, value, ingest_us or null if lost, measurement)"""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("ev"), "event_id", us.alias("ts_us"), "value")
    return events.withColumn("ingest_us", F.expr("if(event_id % 200 = 7, null, ts_us + (event_id * 7919) % 10000 * 1000)")).withColumn("measurement", F.expr("ts_us div 1800000000"))


def waveforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(batch, plane, vec_id, label, v)"""
    return table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 10").alias("batch"), F.expr("cast(vec_id % 2 as int)").alias("plane"), "vec_id", "label", F.expr("transform(embedding, x -> cast(x as double))").alias("v"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(batch, row, slot, ri, cj, same, e, s): sessions and slots of each batch, with their places in it."""
    w = waveforms(spark, sf_dir)
    e = w.where("plane = 0").select("batch", F.col("vec_id").alias("row"), F.col("label").alias("le"), F.col("v").alias("e"))
    s = w.where("plane = 1").select(F.col("batch").alias("b"), F.col("vec_id").alias("slot"), F.col("label").alias("ls"), F.col("v").alias("s"))
    return e.join(s, F.col("batch") == F.col("b")).select("batch", "row", "slot", F.expr("cast((row % 10) div 2 as int)").alias("ri"), F.expr("cast((slot % 10) div 2 as int)").alias("cj"), (F.col("le") == F.col("ls")).alias("same"), "e", "s")


def patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pattern_idx, p): zero, then a supplier's first five quantities by order and line."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_quantity"))).alias("q"))
    return lines.select(F.col("l_suppkey").alias("pattern_idx"), F.expr("concat(array(cast(0 as double)), transform(slice(q, 1, 5), x -> x.l_quantity))").alias("p")).where("size(p) = 6")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(algorithm_id, cell, repeat_idx, quantity, price, discount)"""
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("algorithm_id"), F.col("l_linestatus").alias("cell"), F.col("l_linenumber").alias("repeat_idx"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"))


_DAY = "(({}::DATE - DATE '1970-01-01'))::BIGINT"
IV = f"""iv AS (SELECT slot, st, et FROM (SELECT l_suppkey AS slot, {_DAY.format('o_orderdate')} AS st, {_DAY.format('l_shipdate')} AS et FROM lineitem JOIN orders ON l_orderkey = o_orderkey) WHERE et BETWEEN st AND st + 121)"""
S2 = f"""s2 AS (SELECT o_orderkey AS ev, d AS arrival, d + (o_orderkey // 50) % 41 - 20 AS start_est, d + 30 + o_custkey % 90 AS session_end, gt AS gt_slot
  FROM (SELECT o_orderkey, o_custkey, {_DAY.format('o_orderdate')} AS d FROM orders)
  LEFT JOIN (SELECT l_orderkey, min(l_suppkey) AS gt FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey)"""
DEC = """pts AS (SELECT arrival AS t FROM s2 UNION SELECT session_end FROM s2), base AS (SELECT min(arrival) AS b FROM s2),
w AS (SELECT *, start_est + 60 AS decision_end, least(start_est + 60, session_end) AS te, least(start_est + 60, session_end) + 10 AS wm FROM s2),
dec AS (SELECT w.*, CASE WHEN session_end >= wm THEN least(b + 5 * ceil((greatest(wm, arrival) - b) / 5.0)::BIGINT, coalesce((SELECT min(t) FROM pts WHERE t >= greatest(wm, arrival)), 999999999)) ELSE session_end END AS decision_ts,
  CASE WHEN session_end >= wm THEN 'window_watermark' ELSE 'session_end_before_watermark' END AS reason,
  least(greatest((te - start_est) // 5 + 1, 1), 13) AS prefix_n FROM w, base)"""
GATED = """gated AS (SELECT DISTINCT ev, slot FROM dec JOIN iv ON greatest(0, ceil((st - (te - 20)) / 5.0)) <= least(floor((least(te + 20, decision_ts) - (te - 20)) / 5.0), floor((et - (te - 20)) / 5.0)))"""
COST = """tc AS (SELECT g.ev, g.slot, min(greatest(st - te, te - et, 0)) AS end_dist, min(greatest(st - te, te - et, 0)) + 0.10::DOUBLE * min(abs(st - start_est)) AS cost
  FROM gated g JOIN dec USING (ev) JOIN iv ON iv.slot = g.slot GROUP BY g.ev, g.slot),
rk AS (SELECT *, row_number() OVER (PARTITION BY ev ORDER BY cost, slot) AS candidate_rank FROM tc)"""
CHAIN = ", ".join((IV, S2, DEC, GATED, COST))
TEL = """tel AS (SELECT user_id AS ev, event_id, epoch_us(ts) AS ts_us, value, CASE WHEN event_id % 200 = 7 THEN NULL ELSE epoch_us(ts) + (event_id * 7919) % 10000 * 1000 END AS ingest_us, epoch_us(ts) // 1800000000 AS measurement FROM events)"""
WAVE = """wv AS (SELECT vec_id // 10 AS batch, vec_id % 2 AS plane, vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
pr AS (SELECT a.batch, a.vec_id AS row, b.vec_id AS slot, (a.vec_id % 10) // 2 AS ri, (b.vec_id % 10) // 2 AS cj, a.label = b.label AS same, a.v AS e, b.v AS s FROM wv a JOIN wv b ON a.batch = b.batch AND a.plane = 0 AND b.plane = 1)"""
PAT = """pat AS (SELECT * FROM (SELECT l_suppkey AS pattern_idx, list_concat([0.0::DOUBLE], (list(l_quantity ORDER BY l_orderkey, l_linenumber, l_quantity))[1:5]) AS p FROM lineitem GROUP BY l_suppkey) WHERE len(p) = 6)"""
RUNS = """runs AS (SELECT l_returnflag AS algorithm_id, l_linestatus AS cell, l_linenumber AS repeat_idx, l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount FROM lineitem)"""
