"""Streams over stored tables, run to their end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.plans import fixtures as fx
from tidemark.plans.registry import query
from tidemark.sources.scratch import folder
from tidemark.streaming import decisions

SECONDS = 86_400


def run_to_end(stream: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over what is there now and reads what it wrote; complete mode keeps the last batch."""
    spark = stream.sparkSession
    out, state = folder(spark), folder(spark)
    spark.createDataFrame([], stream.schema).write.parquet(out)

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(out)

    stream.writeStream.outputMode(mode).option("checkpointLocation", state).foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    path = folder(spark)
    raw.withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(path)
    return spark.readStream.schema(schemas.EVENTS).parquet(path)


_DEC = f"WITH {fx.S2} SELECT ev, CASE WHEN session_end >= least(start_est + 60, session_end) + 10 THEN greatest(least(start_est + 60, session_end) + 10, arrival) ELSE session_end END AS decision_ts, CASE WHEN session_end >= least(start_est + 60, session_end) + 10 THEN 'window_watermark' ELSE 'session_end_before_watermark' END AS reason FROM s2"


@query("t1_stream_decisions", _DEC)
def t1(spark, sf_dir):
    for key, value in decisions.STATE_STORE.items():
        spark.conf.set(key, value)
    s = fx.sessions(spark, sf_dir).select("ev", "start_est", "session_end", "arrival", F.timestamp_seconds(F.col("arrival") * SECONDS).alias("event_time"))
    # a row without a session that moves event time past all timers
    end = s.agg(F.lit(-1).cast("long").alias("ev"), F.lit(0).cast("long").alias("start_est"), F.lit(0).cast("long").alias("session_end"), F.lit(0).cast("long").alias("arrival"), F.timestamp_seconds((F.max("session_end") + 1_000) * SECONDS).alias("event_time"))
    path = folder(spark)
    s.unionByName(end).write.parquet(path)
    return run_to_end(decisions.decided(spark.readStream.schema(s.schema).parquet(path), fx.DAYS, SECONDS), "append")


@query("t2_stream_blocks", "SELECT epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS start_us, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def t2(spark, sf_dir):
    found = run_to_end(decisions.block_means(event_stream(spark, sf_dir), "1 day", "2 hours"), "complete")
    return found.select(F.unix_micros("start").alias("start_us"), "event_type", "n", F.round("mean", 6).alias("mean"))


_SESS = """WITH o AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w < 21600000000 THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
k AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS s FROM o) SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 21600000000 AS end_us, count(*) AS n FROM k GROUP BY user_id, s"""


@query("t12_stream_sessions", _SESS)
def t12(spark, sf_dir):
    found = run_to_end(decisions.activity(event_stream(spark, sf_dir), "6 hours", "30 days"), "complete")
    return found.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


@query("t9_stream_distinct", "SELECT event_id, user_id FROM events")
def t9(spark, sf_dir):
    found = run_to_end(decisions.latest_visible(event_stream(spark, sf_dir), "30 days"), "append")
    return found.select("event_id", "user_id")
