"""When each session is decided: watermarks, evaluation points, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import RuntimeConfig

WATERMARK, EARLY_END = "window_watermark", "session_end_before_watermark"


def prefix_length(start: Column, now: Column, step: int, most: int) -> Column:
    """Grid points seen by `now`, from 1 to `most`."""
    return F.least(F.greatest(F.floor((now - start) / step) + 1, F.lit(1)), F.lit(most)).cast("long")


def watermarks(sessions: DataFrame, config: RuntimeConfig) -> DataFrame:
    """sessions with decision_end, effective_end and watermark_ready."""
    end = F.col("start_est") + config.window
    effective = F.least(end, F.col("session_end"))
    return sessions.withColumn("decision_end", end).withColumn("effective_end", effective).withColumn("watermark_ready", effective + config.bound)


def decisions(sessions: DataFrame, config: RuntimeConfig) -> DataFrame:
    """watermarks() with decision_ts, reason and prefix_n.

    A session is decided at the first evaluation point at or after its watermark: a tick, an arrival or a session's end;
    or at its own end if that comes first. The next tick is arithmetic. Any earlier point lies in the same tick cell, so
    the points are joined on the cell: no ordering of all points is needed.
    """
    base = sessions.agg(F.min("arrival").alias("_base"))
    marked = watermarks(sessions, config).crossJoin(F.broadcast(base))
    cell = lambda t: F.ceil((t - F.col("_base")) / config.tick).cast("long")
    ready = F.greatest("watermark_ready", "arrival")
    points = marked.select("_base", F.explode(F.array("arrival", "session_end")).alias("_t")).select(cell(F.col("_t")).alias("_cell"), "_t").distinct()
    aimed = marked.withColumn("_ready", ready).withColumn("_own", cell(F.col("_ready")))
    near = aimed.where("session_end >= watermark_ready").select("_ready", "_own").distinct().join(points, (F.col("_own") == F.col("_cell")) & (F.col("_t") >= F.col("_ready"))).groupBy("_ready").agg(F.min("_t").alias("_event"))
    joined = aimed.join(near.withColumnRenamed("_ready", "_at"), F.col("_ready") == F.col("_at"), "left")
    on_time = F.col("session_end") >= F.col("watermark_ready")
    tick = F.col("_base") + config.tick * F.col("_own")
    out = joined.withColumn("decision_ts", F.when(on_time, F.least(tick, F.coalesce("_event", tick))).otherwise(F.col("session_end")))
    out = out.withColumn("reason", F.when(on_time, WATERMARK).otherwise(EARLY_END)).withColumn("prefix_n", prefix_length(F.col("start_est"), F.col("effective_end"), config.grid, config.points))
    return out.select(*marked.columns, "decision_ts", "reason", "prefix_n").drop("_base")


def batches(decided: DataFrame) -> DataFrame:
    """(decision_ts, reason, sessions): sessions of one point and reason are decided together."""
    return decided.groupBy("decision_ts", "reason").agg(F.count("*").alias("sessions"))
