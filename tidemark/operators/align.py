"""Irregular measurements on regular grids: as-of joins, visibility by ingestion time, blocks, sessions, delay statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(points: DataFrame, series: DataFrame, keys: list[str], at: str, value: str, default: float | None = None, out: str | None = None) -> DataFrame:
    """points with the latest value of the series at or before each point; `default` before the first. One sort for each key."""
    out = out or value
    tagged = points.select("*", F.lit(None).cast(series.schema[value].dataType).alias("_v"), F.lit(1).alias("_side")).unionByName(series.select(*keys, at, F.col(value).alias("_v"), F.lit(0).alias("_side")), allowMissingColumns=True)
    seen = F.last("_v", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0))
    filled = tagged.withColumn("_last", seen).where("_side = 1")
    value_ = F.col("_last") if default is None else F.coalesce("_last", F.lit(default))
    return filled.select(*points.columns, value_.alias(out))


def visible(series: DataFrame, keys: list[str], order: str, value: str, ingest: str, now: Column) -> DataFrame:
    """series with `seen`: the last value, by `order`, of those that were ingested by `now`; null before the first."""
    ok = F.when(F.col(ingest) <= now, F.col(value))
    return series.withColumn("seen", F.last(ok, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def blocks(series: DataFrame, keys: list[str], at: str, start: Column, width: int, value: str, ingest: str) -> DataFrame:
    """(keys, block, mean, n, ready): means of blocks that begin at each key's own start; ready when the last one received was, null if none was."""
    return series.withColumn("block", F.floor((F.col(at) - start) / width).cast("long")).groupBy(*keys, "block").agg(F.avg(value).alias("mean"), F.count("*").alias("n"), F.max(ingest).alias("ready"))


def sessionised(events: DataFrame, keys: list[str], at: str, gap: int) -> DataFrame:
    """(keys, session, start, end, n): runs of events less than `gap` apart."""
    own = Window.partitionBy(*keys).orderBy(at)
    opens = F.coalesce(F.col(at) - F.lag(at).over(own) >= gap, F.lit(True)).cast("int")
    numbered = events.withColumn("_open", opens).withColumn("session", F.sum("_open").over(own.rangeBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "session").agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count("*").alias("n"))


def delay_histogram(series: DataFrame, at: str, ingest: str, width: int) -> DataFrame:
    """(bin, n, till): delays of what was received, in bins of `width`, with running counts."""
    bins = series.where(F.col(ingest).isNotNull()).groupBy(F.floor((F.col(ingest) - F.col(at)) / width).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    # as many rows as bins
    return bins.withColumn("till", F.sum("n").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)))


def delay_quantiles(histogram: DataFrame, width: int, levels: list[float]) -> DataFrame:
    """(level, value): the middle of the first bin whose running count reaches the level's share."""
    total = histogram.agg(F.sum("n").alias("_all"))
    wanted = histogram.sparkSession.createDataFrame([(float(q),) for q in levels], "level double")
    reached = histogram.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(wanted)).where(F.col("till") >= F.ceil(F.col("level") * F.col("_all")))
    return reached.groupBy("level").agg(((F.min("bin") + 0.5) * width).alias("value"))


def delay_stats(series: DataFrame, at: str, ingest: str) -> DataFrame:
    """One row: received, lost, loss share, mean and largest delay."""
    delay = F.col(ingest) - F.col(at)
    lost = F.count_if(F.col(ingest).isNull())
    return series.agg(F.count(ingest).alias("received"), lost.alias("lost"), (lost / F.count("*")).alias("loss_share"), F.avg(delay).alias("mean_delay"), F.max(delay).alias("max_delay"))
