"""Sources and sinks over the driver's tables: each query writes what it reads back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.config import MATCHERS
from tidemark.plans import fixtures as fx
from tidemark.plans.registry import query
from tidemark.session import table
from tidemark.sources import generator, scans, sinks, waves
from tidemark.sources.scratch import folder


@query("s13_csv_scan", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def s13(spark, sf_dir):
    s, path = table(spark, sf_dir, "supplier"), folder(spark)
    sinks.write_csv(s, path, s.columns)
    return scans.csv_table(spark, path, s.schema)


@query("k1_csv_padded", "SELECT n_nationkey, n_name, NULL::VARCHAR AS note FROM nation")
def k1(spark, sf_dir):
    path = folder(spark)
    sinks.write_csv(table(spark, sf_dir, "nation"), path, ["n_nationkey", "n_name", "note"], single=True)
    return spark.read.schema("n_nationkey int, n_name string, note string").option("header", True).csv(path)


@query("s14_json_projection", "SELECT event_id, value FROM events")
def s14(spark, sf_dir):
    path = folder(spark)
    sinks.write_json_lines(table(spark, sf_dir, "events").drop("ts"), path)
    from pyspark.sql.types import DoubleType, LongType, StructField, StructType

    return scans.json_lines(spark, path, StructType([StructField("event_id", LongType()), StructField("value", DoubleType())]))


@query("s15_json_predicate", "SELECT event_id, event_type FROM events WHERE value > 50")
def s15(spark, sf_dir):
    from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

    path = folder(spark)
    sinks.write_json_lines(table(spark, sf_dir, "events").drop("ts"), path)
    schema = StructType([StructField("event_id", LongType()), StructField("event_type", StringType()), StructField("value", DoubleType())])
    return scans.json_lines(spark, path, schema, F.col("value") > 50).select("event_id", "event_type")


@query("s16_broken_lines", "SELECT conv_id, turn FROM conversations WHERE turn % 2 = 0")
def s16(spark, sf_dir):
    from pyspark.sql.types import LongType, StructField, StructType

    path = folder(spark)
    line = F.when(F.col("turn") % 2 == 0, F.to_json(F.struct("conv_id", "turn"))).when(F.col("turn") % 3 == 0, F.lit("")).otherwise(F.lit('{"conv_id": 1, "turn"'))
    table(spark, sf_dir, "conversations").select(line.alias("value")).write.text(path)
    return scans.json_lines(spark, path, StructType([StructField("conv_id", LongType()), StructField("turn", LongType())]))


def _reports(spark, sf_dir) -> str:
    """Run folders with a report each: one for each nation."""
    path = folder(spark)
    n = table(spark, sf_dir, "nation").select(F.format_string("run_%03d", "n_nationkey").alias("run"), F.to_json(F.struct(F.when(F.col("n_regionkey") == 0, F.lit("sweep")).otherwise(F.lit("compare")).alias("mode"), F.col("n_regionkey").alias("knob"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).alias("title"), F.array(F.struct(F.lit("a").alias("algo"), F.col("n_nationkey").alias("score"))).alias("rows"))).alias("value"))
    n.repartition(1).write.partitionBy("run").text(path)
    return path


_SCHEMA = "mode string, knob int, title string, rows array<struct<algo:string,score:int>>"


@query("s17_document_defaults", "SELECT 'run=run_' || lpad(n_nationkey::VARCHAR, 3, '0') AS run_id, coalesce(CASE WHEN n_nationkey % 2 = 0 THEN n_name END, 'untitled') AS title FROM nation")
def s17(spark, sf_dir):
    from pyspark.sql.types import _parse_datatype_string

    docs = scans.document(spark, f"{_reports(spark, sf_dir)}/run=*/*", _parse_datatype_string(_SCHEMA), {"title": "untitled"})
    return docs.select(F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1).alias("run_id"), "title")


@query("s18_run_catalog", "SELECT 'run=run_' || lpad(n_nationkey::VARCHAR, 3, '0') AS run_id, n_regionkey AS knob FROM nation WHERE n_regionkey <> 0 ORDER BY n_nationkey DESC LIMIT 10")
def s18(spark, sf_dir):
    from pyspark.sql.types import _parse_datatype_string

    return scans.catalog(spark, f"{_reports(spark, sf_dir)}/run=*/*", _parse_datatype_string(_SCHEMA), "compare", 10).select("run_id", "knob")


@query("s19_same_signature", "SELECT 'run=run_' || lpad(n_nationkey::VARCHAR, 3, '0') AS run_id, n_regionkey AS knob, 'a' AS algo, n_nationkey AS score FROM nation WHERE n_regionkey = (SELECT n_regionkey FROM nation WHERE n_nationkey = 7)")
def s19(spark, sf_dir):
    from pyspark.sql.types import _parse_datatype_string

    runs = scans.catalog(spark, f"{_reports(spark, sf_dir)}/run=*/*", _parse_datatype_string(_SCHEMA))
    return scans.same_signature(runs, runs.where("run_id = 'run=run_007'"), ["knob"], ["knob"], "rows")


@query("s20_path_parts", "SELECT n_nationkey AS number, count(*) AS n FROM nation GROUP BY 1")
def s20(spark, sf_dir):
    from pyspark.sql.types import _parse_datatype_string

    found = spark.read.schema(_parse_datatype_string(_SCHEMA)).json(f"{_reports(spark, sf_dir)}/run=*/*")
    return scans.with_path_parts(found, r"run=run_(\d+)", ["number"]).groupBy(F.col("number").cast("int").alias("number")).agg(F.count("*").alias("n"))


@query("k2_json_non_finite", "SELECT s_suppkey, CASE WHEN s_acctbal >= 0 THEN s_acctbal END AS s_acctbal FROM supplier")
def k2(spark, sf_dir):
    path = folder(spark)
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_acctbal") >= 0, F.col("s_acctbal")).otherwise(F.lit(float("nan"))).alias("s_acctbal"))
    sinks.write_json_lines(s, path)
    return spark.read.schema(s.schema).json(path)


@query("k3_parquet_round_trip", "SELECT r_regionkey, r_name FROM region")
def k3(spark, sf_dir):
    path = folder(spark)
    sinks.write_parquet(table(spark, sf_dir, "region"), path)
    return spark.read.parquet(path)


@query("k5_list_text", f"WITH {fx.PAT} SELECT pattern_idx, '[' || array_to_string(list_transform(p, lambda x: x::BIGINT), ', ') || ']' AS txt FROM pat")
def k5(spark, sf_dir):
    return fx.patterns(spark, sf_dir).withColumn("p", F.expr("transform(p, x -> cast(x as bigint))")).select("pattern_idx", sinks.list_text("p").alias("txt"))


@query("k7_presentation_table", f"WITH {fx.RUNS} SELECT algorithm_id, cell, round(avg(discount), 4) AS accuracy FROM runs GROUP BY ALL")
def k7(spark, sf_dir):
    return fx.runs(spark, sf_dir).groupBy("algorithm_id", "cell").agg(F.round(F.avg("discount"), 4).alias("accuracy")).orderBy("algorithm_id", "cell")


@query("k9_retention", "SELECT o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey DESC) AS k FROM orders) WHERE k <= 20")
def k9(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey")
    return sinks.retained(o, 20, "o_orderpriority", "o_orderkey")[0]


_GRID = f"""WITH {fx.IV}, {fx.PAT}, b AS (SELECT slot, st, et, p FROM iv JOIN pat ON slot = pattern_idx), g AS (SELECT DISTINCT slot, unnest(range(8000, 11000, 25)) AS t FROM b),
m AS (SELECT g.slot, g.t, p[((g.t - st - 1) % 6) + 1] AS v, st, et, row_number() OVER (PARTITION BY g.slot, g.t ORDER BY st DESC, et DESC) AS k FROM g LEFT JOIN b ON b.slot = g.slot AND g.t > st AND g.t <= et)
SELECT slot, t, coalesce(v, 0.0) AS value FROM m WHERE k = 1"""


@query("s12_slot_grid", _GRID)
def s12(spark, sf_dir):
    busy = fx.slot_intervals(spark, sf_dir).join(fx.patterns(spark, sf_dir), F.col("slot") == F.col("pattern_idx")).select("slot", "st", "et", F.col("p").alias("wave"))
    points = busy.select("slot").distinct().select("slot", F.explode(F.expr("sequence(8000L, 10999L, 25L)")).alias("t"))
    return waves.slot_grid(points, busy, 60)


@query("s8_response")
def s8(spark, sf_dir):
    """Seconds and charge of each pattern's response."""
    w = fx.patterns(spark, sf_dir).withColumn("pattern", F.expr("transform(p, x -> cast(6 + x % 25 as int))")).withColumn("wave", waves.response_column("pattern"))
    return w.select("pattern_idx", F.size("wave").alias("seconds"), F.round(F.expr("aggregate(wave, 0D, (a, x) -> a + x)"), 3).alias("charge"))


_SMALL = generator.Scenario(sessions=40, slots=20, patterns=20)


@query("s1_scenario_sessions")
def s1(spark, sf_dir):
    return generator.scenarios(spark, [1, 2, 3, 4], _SMALL, "sessions")


@query("s2_fixed_arrivals")
def s2(spark, sf_dir):
    return generator.scenarios(spark, [1], generator.Scenario(sessions=3, slots=2, patterns=5, arrivals=(0.0, 10.0, 20.0)), "sessions")


@query("t6_admission")
def t6(spark, sf_dir):
    """Requests that found no free slot."""
    return generator.scenarios(spark, [1, 2], generator.Scenario(sessions=300, slots=5, patterns=20), "blocked")


@query("t7_generated_telemetry")
def t7(spark, sf_dir):
    return generator.unobserved(generator.scenarios(spark, [1, 2], _SMALL, "telemetry"))


@query("g1_replayed_grid")
def g1(spark, sf_dir):
    """Every matcher over the same scenarios, with accuracy and latency of each: the experiment grid."""
    from tidemark.plans.experiment import replay

    return replay(spark, [1, 2], generator.Scenario(sessions=60, slots=15, patterns=20), [MATCHERS[n] for n in ("time_only", "single_only", "nomura_original_hungarian", "bayesian_windowed")])
