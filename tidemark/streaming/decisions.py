"""The streaming tier: sessions decided by event-time windows, tumbling and session windows over telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import RuntimeConfig
from tidemark.operators.timeline import EARLY_END, WATERMARK

STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def decided(sessions: DataFrame, config: RuntimeConfig, seconds: int = 1, late: str = "0 seconds") -> DataFrame:
    """(ev, decision_ts, reason) of a stream of sessions (ev, start_est, session_end, arrival, event_time).

    A session's window lasts until event time passes its watermark or its early end; then its one decision is given. Times
    are whole units, event time is unit `seconds` after the epoch. Sessions of negative ids only move event time on.
    """
    ready = F.least(F.col("start_est") + config.window, F.col("session_end")) + config.bound
    on_time = F.col("session_end") >= ready
    due, why = F.when(on_time, F.greatest(ready, "arrival")).otherwise(F.col("session_end")), F.when(on_time, WATERMARK).otherwise(EARLY_END)
    # a window must last: what is due on arrival waits for the next second
    wait = F.greatest(due * seconds - F.unix_seconds("event_time"), F.lit(1))
    kept = sessions.withWatermark("event_time", late).withColumn("_due", F.struct("event_time", due.alias("decision_ts"), why.alias("reason")))
    found = kept.groupBy("ev", F.session_window("event_time", F.concat(wait.cast("string"), F.lit(" seconds")))).agg(F.min("_due").alias("_due"), F.max("ev").alias("_last"))
    # a filter by the key would drop negative ids before they move event time
    return found.where("_last >= 0").select("ev", "_due.decision_ts", "_due.reason")


def block_means(events: DataFrame, width: str, late: str) -> DataFrame:
    """Means of tumbling windows; rows later than `late` are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(F.col("window.start").alias("start"), "event_type", "n", "mean")


def activity(events: DataFrame, gap: str, late: str) -> DataFrame:
    """Sessions of each user: events less than `gap` apart."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def latest_visible(events: DataFrame, late: str) -> DataFrame:
    """One row for each measurement, however often it arrives within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
