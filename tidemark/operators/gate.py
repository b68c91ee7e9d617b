"""Which slots a session may have come from: range joins by time buckets, and what a slot costs by time alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import RuntimeConfig


def bucketed(df: DataFrame, low: Column, high: Column, width: int) -> DataFrame:
    """df once for each time bucket that low..high touches; a plain range join would compare every pair."""
    cell = lambda t: F.floor(t / width).cast("long")
    return df.where(low <= high).withColumn("_bucket", F.explode(F.sequence(cell(low), cell(high))))


def probes(decided: DataFrame, config: RuntimeConfig, *more: Column) -> DataFrame:
    """(ev, _lo, _hi, more): first and last probe of each session's window."""
    low = F.col("effective_end") - config.margin
    high = F.least(F.col("effective_end") + config.margin, F.col("decision_ts"))
    if config.margin <= 0:
        low = high = F.least(F.col("effective_end"), F.col("decision_ts"))
    return decided.select("ev", F.least(low, high).alias("_lo"), high.alias("_hi"), *more)


def _met(windows: DataFrame, intervals: DataFrame, config: RuntimeConfig, *keys: str) -> DataFrame:
    """windows with each interval that one of their probes lies in; keys: columns that window and interval share."""
    step = config.tick
    first = F.greatest(F.lit(0), F.ceil((F.col("st") - F.col("_lo")) / step))
    last = F.least(F.floor((F.col("_hi") - F.col("_lo")) / step), F.floor((F.col("et") - F.col("_lo")) / step))
    left = bucketed(windows, F.col("_lo"), F.col("_hi"), config.bucket)
    right = bucketed(intervals.select("slot", "st", "et").distinct(), F.col("st"), F.col("et"), config.bucket)
    return left.join(right, ["_bucket", *keys]).where(first <= last)


def candidates(decided: DataFrame, intervals: DataFrame, config: RuntimeConfig) -> DataFrame:
    """(ev, slot) of decided, a row a session: slots busy at any of the probes, every `tick` from effective_end - margin to the decision or + margin.

    Both ends of an interval are busy. An interval between two probes isn't seen; a window that ends before it begins has one probe at its end.
    """
    asked = probes(decided, config)
    # sessions with the same window ask once
    met = _met(asked.select("_lo", "_hi").distinct(), intervals, config).select("_lo", "_hi", "slot").distinct()
    return asked.join(met, ["_lo", "_hi"]).select("ev", "slot")


def candidate_counts(decided: DataFrame, intervals: DataFrame, config: RuntimeConfig) -> DataFrame:
    """(ev, candidates): how many slots candidates() gives each session, 0 if none, without listing them. Times are whole units.

    The probes of a window share their remainder by `tick`. For each remainder a slot's intervals are cut into pieces of
    probes that don't overlap. A window's slots are the pieces at its first probe and those that begin at a later one,
    unless the slot's probe before lies in the window too. Joined are counts by probe, as few as there are times.
    """
    step, far = config.tick, 2 * max(config.margin, 0) // config.tick + 1
    asked = probes(decided, config)
    place = lambda t: F.floor((F.col(t) - F.col("_r")) / step).cast("long")
    windows = asked.where("_lo <= _hi").select("_lo", "_hi").distinct().withColumn("_r", F.pmod(F.col("_lo"), F.lit(step))).withColumn("_a", place("_lo")).withColumn("_b", place("_hi"))
    held = intervals.select("slot", "st", "et").distinct().crossJoin(F.broadcast(windows.select("_r").distinct()))
    held = held.select("slot", "_r", F.ceil((F.col("st") - F.col("_r")) / step).cast("long").alias("_s"), place("et").alias("_e")).where("_s <= _e")
    before = Window.partitionBy("slot", "_r").orderBy("_s", "_e").rowsBetween(Window.unboundedPreceding, -1)
    pieces = held.withColumn("_prev", F.max("_e").over(before)).where("_prev is null or _e > _prev").withColumn("_s", F.greatest("_s", F.col("_prev") + 1))
    begun = pieces.groupBy("_r", F.col("_s").alias("_p"), F.when(F.col("_s") - F.col("_prev") <= far, F.col("_prev")).alias("_prev")).agg(F.count("*").alias("_n"))
    ended = pieces.groupBy("_r", (F.col("_e") + 1).alias("_p")).agg((-F.count("*")).alias("_d"))
    points = windows.select("_lo", "_hi", "_r", "_a", F.explode(F.sequence("_a", "_b")).alias("_p"))
    none = F.lit(None).cast("array<struct<_prev:bigint,_n:bigint>>")
    changes = begun.groupBy("_r", "_p").agg(F.sum("_n").alias("_d"), F.collect_list(F.struct("_prev", "_n")).alias("_begun"))
    changes = changes.unionByName(ended.withColumn("_begun", none)).unionByName(points.select("_r", "_p").distinct().withColumn("_d", F.lit(0).cast("long")).withColumn("_begun", none))
    by_probe = changes.groupBy("_r", "_p").agg(F.sum("_d").alias("_d"), F.first("_begun", ignorenulls=True).alias("_begun"))
    by_probe = by_probe.withColumn("_busy", F.sum("_d").over(Window.partitionBy("_r").orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)))
    fresh = F.expr("aggregate(filter(coalesce(_begun, array()), x -> x._prev is null or x._prev < _a), 0L, (n, x) -> n + x._n)")
    found = points.join(by_probe, ["_r", "_p"]).groupBy("_lo", "_hi").agg(F.sum(F.when(F.col("_p") == F.col("_a"), F.col("_busy")).otherwise(fresh)).alias("candidates"))
    return asked.join(found, ["_lo", "_hi"], "left").select("ev", F.coalesce("candidates", F.lit(0)).alias("candidates"))


def own_in_gate(decided: DataFrame, intervals: DataFrame, config: RuntimeConfig, own: str) -> DataFrame:
    """(ev) of the sessions whose slot `own` is among their candidates."""
    return _met(probes(decided, config, F.col(own).alias("slot")), intervals, config, "slot").select("ev").distinct()


def gated_or_all(decided: DataFrame, intervals: DataFrame, config: RuntimeConfig) -> DataFrame:
    """(ev, slot, gated): with_fallback() of candidates(); which windows are without a slot is known before sessions meet slots."""
    asked = probes(decided, config)
    met = _met(asked.select("_lo", "_hi").distinct(), intervals, config).groupBy("_lo", "_hi").agg(F.collect_set("slot").alias("_slots"), F.count_if(F.col("slot").isNull()).alias("_none"))
    # sets leave out a null, which is a slot here
    held = F.when(F.col("_none") > 0, F.concat("_slots", F.array(F.lit(None).cast(intervals.schema["slot"].dataType)))).otherwise(F.col("_slots"))
    joined = asked.join(met.select("_lo", "_hi", held.alias("_slots")), ["_lo", "_hi"], "left")
    rest = joined.where("_slots is null").select("ev").crossJoin(F.broadcast(intervals.select("slot").distinct()))
    return joined.select("ev", F.explode("_slots").alias("slot"), F.lit(True).alias("gated")).unionByName(rest.withColumn("gated", F.lit(False)))


def with_fallback(decided: DataFrame, gated: DataFrame, slots: DataFrame) -> DataFrame:
    """(ev, slot, gated): sessions without a candidate get every slot. slots: the distinct ones, as few as there are chargers."""
    rest = decided.select("ev").join(gated, "ev", "left_anti").crossJoin(F.broadcast(slots.select("slot").distinct()))
    return gated.withColumn("gated", F.lit(True)).unionByName(rest.withColumn("gated", F.lit(False)))


def end_distance(t: Column, st: Column, et: Column) -> Column:
    """How far t lies outside st..et."""
    return F.greatest(st - t, t - et, F.lit(0))


def nearest(points: DataFrame, intervals: DataFrame, width: int) -> DataFrame:
    """points (slot, t) with before, after, reach: the last start at or before t, the first start after it, the latest end of those that start at or before it.

    Intervals are sorted within cells of `width` of a slot, so a busy slot is many tasks; what lies in other cells is
    known from one row a cell. No point meets all intervals of its slot.
    """
    cell = lambda t: F.floor(F.col(t) / width).cast("long").alias("_cell")
    asked = points.select("slot", "t", cell("t"))
    held = intervals.select("slot", F.col("st").alias("t"), cell("st"), "st", "et").where("st is not null")
    every = held.unionByName(asked, allowMissingColumns=True)
    cells = every.groupBy("slot", "_cell").agg(F.min("st").alias("_lo"), F.max("st").alias("_hi"), F.max("et").alias("_et"))
    earlier = Window.partitionBy("slot").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy("slot").orderBy(F.desc("_cell")).rowsBetween(Window.unboundedPreceding, -1)
    around = cells.select("slot", "_cell", F.max("_hi").over(earlier).alias("_before"), F.max("_et").over(earlier).alias("_reach"), F.min("_lo").over(later).alias("_after"))
    up = Window.partitionBy("slot", "_cell").orderBy("t", F.col("st").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("slot", "_cell").orderBy(F.desc("t"), F.desc(F.col("st").isNull())).rowsBetween(Window.unboundedPreceding, 0)
    within = every.select("slot", "_cell", "t", "st", F.max("st").over(up).alias("before"), F.max("et").over(up).alias("reach"), F.min("st").over(down).alias("after")).where("st is null")
    both = within.join(around, ["slot", "_cell"])
    return both.select("slot", "t", F.coalesce("before", "_before").alias("before"), F.coalesce("after", "_after").alias("after"), F.greatest("reach", "_reach").alias("reach"))


def time_costs(edges: DataFrame, decided: DataFrame, intervals: DataFrame, config: RuntimeConfig) -> DataFrame:
    """(ev, slot, end_dist, start_dist, cost) over all intervals of the slot, later ones too; an interval ends at its start or later."""
    asked = edges.select("ev", "slot").join(decided.select("ev", "effective_end", "start_est"), "ev")
    found = nearest(asked.select("slot", F.explode(F.array("effective_end", "start_est")).alias("t")).where("t is not null").distinct(), intervals, config.bucket)
    at = lambda t, *names: found.select("slot", F.col("t").alias(t), *(F.col(a).alias(b) for a, b in names))
    near = asked.join(at("effective_end", ("after", "_next"), ("reach", "_reach")), ["slot", "effective_end"]).join(at("start_est", ("before", "_lo"), ("after", "_hi")), ["slot", "start_est"])
    past = F.when(F.col("_reach").isNotNull(), F.greatest(F.col("effective_end") - F.col("_reach"), F.lit(0)))
    end_dist, start_dist = F.least(F.col("_next") - F.col("effective_end"), past), F.least(F.col("start_est") - F.col("_lo"), F.col("_hi") - F.col("start_est"))
    costs = near.select("ev", "slot", end_dist.alias("end_dist"), start_dist.alias("start_dist")).where("start_dist is not null")
    return costs.withColumn("cost", F.col("end_dist") + F.lit(config.start_weight) * F.col("start_dist"))


def ranked(costs: DataFrame, cost: str = "cost", row: str = "ev", slot: str = "slot") -> DataFrame:
    """costs with candidate_rank: 1 is the cheapest, then the lowest slot."""
    return costs.withColumn("candidate_rank", F.row_number().over(Window.partitionBy(row).orderBy(cost, slot)).cast("long"))


def best(costs: DataFrame, cost: str = "cost", row: str = "ev", slot: str = "slot") -> DataFrame:
    """(row, slot, cost) of each row's cheapest slot, each on its own: slots may be taken twice. One aggregation, no sort."""
    top = costs.groupBy(row).agg(F.min(F.struct(F.col(cost).alias("c"), F.col(slot).alias("s"))).alias("_m"))
    return top.select(row, F.col("_m.s").alias(slot), F.col("_m.c").alias(cost))


def pattern_in_window(windows: DataFrame, intervals: DataFrame, width: int) -> DataFrame:
    """(id, st, et, contains, overlap): of the intervals that meet lo..hi the one that holds lo, else the one with the largest overlap; the earliest of equals."""
    left = bucketed(windows, F.col("lo"), F.col("hi"), width)
    right = bucketed(intervals, F.col("st"), F.col("et"), width).select("slot", "st", "et", F.col("_bucket").alias("_cell"))
    met = left.withColumnRenamed("slot", "_slot").join(right, (F.col("_slot") == F.col("slot")) & (F.col("_bucket") == F.col("_cell")) & (F.col("st") <= F.col("hi")) & (F.col("et") >= F.col("lo")))
    holds = (F.col("st") <= F.col("lo")) & (F.col("et") >= F.col("lo"))
    overlap = F.least("et", "hi") - F.greatest("st", "lo")
    top = met.groupBy("id").agg(F.min(F.struct((~holds).alias("out"), (-overlap).alias("less"), "st", "et")).alias("_m"))
    return top.select("id", F.col("_m.st").alias("st"), F.col("_m.et").alias("et"), (~F.col("_m.out")).alias("contains"), (-F.col("_m.less")).alias("overlap"))
