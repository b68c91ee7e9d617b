import datetime as dt

from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.plans.stream_queries import run_to_end
from tidemark.streaming import decisions


def test_late_rows_are_dropped(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    first = [(1, at(0), 1, "a", 1.0, None), (2, at(200), 1, "a", 3.0, None)]
    late = [(3, at(5), 1, "a", 9.0, None), (4, at(400), 1, "a", 5.0, None), (4, at(400), 1, "a", 5.0, None)]
    # a batch drops by the watermark that the batch before it began with
    for i, rows in enumerate((first, [(6, at(210), 1, "a", 3.0, None)], late, [(5, at(2_000), 1, "a", 0.0, None)])):
        spark.createDataFrame(rows, schemas.EVENTS).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(schemas.EVENTS).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in/*"))
    got = {r.start: (r.n, r["mean"]) for r in run_to_end(decisions.block_means(stream, "1 hour", "30 minutes"), "append").collect()}
    assert got[at(0)] == (1, 1.0) and got[at(180)] == (2, 3.0) and got[at(360)] == (2, 5.0)
    once = spark.readStream.schema(schemas.EVENTS).parquet(str(tmp_path / "in/*"))
    assert run_to_end(decisions.latest_visible(once, "10 days"), "append").groupBy().agg(F.count("*")).first()[0] == 6


def test_decisions_keep_no_python_state(spark, tmp_path):
    from tidemark.config import RuntimeConfig

    at = lambda s: dt.datetime.fromtimestamp(s, dt.UTC)
    rows = [(1, 0, 100, 0, at(0)), (2, 0, 30, 0, at(0)), (3, 900, 905, 0, at(0)), (4, 5, 5, 5, at(5)), (-1, 0, 0, 0, at(500))]
    spark.createDataFrame(rows, "ev long, start_est long, session_end long, arrival long, event_time timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ev long, start_est long, session_end long, arrival long, event_time timestamp").parquet(str(tmp_path / "in"))
    found = decisions.decided(stream, RuntimeConfig(window=60, bound=10))
    assert "Pandas" not in found._jdf.queryExecution().logical().toString()
    # the third isn't due by the last event time, the fourth is due when it arrives
    got = {r.ev: (r.decision_ts, r.reason) for r in run_to_end(found, "append").collect()}
    assert got == {1: (70, "window_watermark"), 2: (30, "session_end_before_watermark"), 4: (5, "session_end_before_watermark")}
