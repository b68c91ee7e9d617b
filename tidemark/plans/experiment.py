"""The experiment grid: one scenario, replayed under many matchers, and the cube over the runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import Matcher, RuntimeConfig
from tidemark.operators import gate, matchers, metrics, timeline
from tidemark.sources import generator, waves
from tidemark.sources.scratch import written


def edges(spark: SparkSession, ids: list[int], scenario: generator.Scenario, config: RuntimeConfig) -> tuple[DataFrame, DataFrame]:
    """(decided sessions, pairs (batch, row, slot, ri, cj, e, s, delta)) of the scenarios, waveforms on the grid as far as they were known."""
    made = written(generator.scenarios(spark, ids, scenario, "sessions"))
    busy = written(generator.scenarios(spark, ids, scenario, "slot_intervals"))
    seen = written(generator.unobserved(generator.scenarios(spark, ids, scenario, "telemetry")))
    # scenarios side by side on one time line, far apart; slots and sessions get numbers of their own
    shift = F.col("scenario_id") * 10 * scenario.horizon
    s = made.select((F.col("scenario_id") * 100_000 + F.col("ev_idx")).alias("ev"), "scenario_id", (F.col("arrival_s") + shift).cast("long").alias("arrival"), (F.col("start_est_s") + shift).cast("long").alias("start_est"), (F.col("session_end_s") + shift).cast("long").alias("session_end"), (F.col("scenario_id") * 100_000 + F.col("gt_slot")).alias("gt_slot"))
    decided = written(timeline.decisions(s, config))
    iv = busy.select((F.col("scenario_id") * 100_000 + F.col("slot")).alias("slot"), (F.col("start_s") + shift).cast("long").alias("st"), (F.col("end_s") + shift).cast("long").alias("et"), "pattern", "response_lag_s", "response_ramp")
    gated = gate.candidates(decided, iv, config)
    costs = gate.time_costs(gated, decided, iv.select("slot", "st", "et"), config)
    shifted = seen.select((F.col("scenario_id") * 100_000 + F.col("ev_idx")).alias("ev"), "grid_idx", "value", (F.col("ingest_s") + shift).alias("ingest"))
    now = decided.select("ev", "decision_ts", "prefix_n")
    known = shifted.join(now, "ev").where("grid_idx < prefix_n")
    from pyspark.sql import Window

    last = F.last(F.when(F.col("ingest") <= F.col("decision_ts"), F.col("value")), ignorenulls=True).over(Window.partitionBy("ev").orderBy("grid_idx").rowsBetween(Window.unboundedPreceding, 0))
    e = known.withColumn("seen", last).groupBy("ev").agg(F.array_sort(F.collect_list(F.struct("grid_idx", "seen"))).alias("g")).select("ev", F.expr("transform(g, x -> x.seen)").alias("e"))
    # a slot's wave at the session's grid points, for each candidate pair
    waved = iv.withColumn("wave", waves.response_column("pattern", F.coalesce("response_lag_s", F.lit(15.0)), F.col("response_ramp")))
    near = costs.select("ev", "slot").join(decided.select("ev", "start_est", "effective_end", "prefix_n"), "ev").join(waved.select("slot", "st", "et", "wave"), "slot").where("et >= start_est and st <= effective_end")
    part = near.withColumn("v", F.expr("transform(sequence(0L, prefix_n - 1), k -> if(start_est + 5 * k > st and start_est + 5 * k <= et, get(wave, cast((start_est + 5 * k - st - 1) % size(wave) as int)), null))"))
    overlaid = part.groupBy("ev", "slot").agg(F.array_sort(F.collect_list(F.struct("st", "v"))).alias("o"))
    sv = overlaid.select("ev", "slot", F.expr("transform(aggregate(slice(o, 2, size(o)), o[0].v, (a, x) -> zip_with(a, x.v, (p, q) -> coalesce(q, p))), x -> coalesce(x, 0D))").alias("s"))
    zero = F.expr("transform(sequence(0L, prefix_n - 1), k -> 0D)")
    pairs = costs.join(decided.select("ev", "decision_ts", "reason", "prefix_n"), "ev").join(e, "ev").join(sv, ["ev", "slot"], "left")
    pairs = pairs.select(F.concat_ws("/", F.expr("ev div 100000"), "decision_ts", "reason").alias("batch"), F.col("ev").alias("row"), "slot", F.coalesce("s", zero).alias("s"), "e", F.col("cost").alias("delta"))
    pairs = pairs.withColumn("ri", F.dense_rank().over(Window.partitionBy("batch").orderBy("row")) - 1).withColumn("cj", F.dense_rank().over(Window.partitionBy("batch").orderBy("slot")) - 1)
    return decided, written(pairs)


def replay(spark: SparkSession, ids: list[int], scenario: generator.Scenario, algorithms: list[Matcher], config: RuntimeConfig | None = None) -> DataFrame:
    """One row for each scenario and matcher: the run metrics."""
    config = config or RuntimeConfig()
    decided, pairs = edges(spark, ids, scenario, config)
    links = reduce(lambda a, b: a.unionByName(b), (matchers.matched(pairs, m, config.min_shared) for m in algorithms))
    found = links.select("algorithm_id", F.col("row").alias("ev"), "slot", "cost", "fallback").join(decided, "ev")
    return metrics.run_metrics(found, F.lit(scenario.sessions), ("algorithm_id", "scenario_id"))
