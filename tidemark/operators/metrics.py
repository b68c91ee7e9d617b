"""Run metrics, cubes over runs, confidence intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .timeline import EARLY_END, WATERMARK

REASONS = (WATERMARK, EARLY_END, "session_end_fallback", "timeline_end_fallback")


def run_metrics(links: DataFrame, requested: Column | int, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row a run from links (slot, gt_slot, cost, arrival, decision_ts, reason; slot null if unmatched)."""
    latency = F.when(F.col("slot").isNotNull(), F.col("decision_ts") - F.col("arrival"))
    counts = [F.count_if((F.col("reason") == r) & F.col("slot").isNotNull()).alias(f"{r}_count") for r in REASONS]
    found = links.groupBy(*keys).agg(
        F.count("*").alias("total_evs"), F.count_if(F.col("slot") == F.col("gt_slot")).alias("correct"), F.count_if(F.col("slot").isNull()).alias("unmatched"),
        F.avg("cost").alias("avg_cost"), F.max("cost").alias("max_cost"), F.avg(latency).alias("avg_latency"), F.percentile(latency, 0.9).alias("p90_latency"), *counts,
    )
    asked = requested if isinstance(requested, Column) else F.lit(requested)
    total = F.nullif(F.col("total_evs"), F.lit(0))
    found = found.withColumn("requested_evs", F.coalesce(asked.cast("long"), F.col("total_evs")))
    found = found.withColumn("blocked_evs", F.greatest(F.lit(0), F.col("requested_evs") - F.col("total_evs")))
    wanted = F.nullif(F.col("requested_evs"), F.lit(0))
    found = found.withColumns({"accuracy": F.col("correct") / total, "accuracy_requested": F.col("correct") / wanted, "blocked_ratio": F.col("blocked_evs") / wanted})
    late = sum((F.col(f"{r}_count") for r in REASONS[2:]), F.col(f"{REASONS[1]}_count"))
    return found.withColumns({f"{r}_ratio": F.col(f"{r}_count") / total for r in REASONS} | {"fallback_finalized_count": late, "fallback_finalized_ratio": late / total})


def mean_std_ci(column: str, name: str | None = None) -> list[Column]:
    """Mean, sample deviation and half-width 1.96 s / sqrt(n); the last two are 0 for a single row."""
    name = name or column
    std = F.coalesce(F.stddev_samp(column), F.lit(0.0))
    return [F.avg(column).alias(f"{name}_mean"), std.alias(f"{name}_std"), (1.96 * std / F.sqrt(F.count(column))).alias(f"{name}_ci95")]


def cube(cells: DataFrame, runs: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """cells (the dense grid) with runs and mean, deviation and half-width of every metric; empty cells stay, with nulls."""
    found = runs.groupBy(*keys).agg(F.count("*").alias("runs"), *(c for m in metrics for c in mean_std_ci(m)))
    return cells.join(found, keys, "left").withColumn("runs", F.coalesce("runs", F.lit(0)))


#: The 0.975 quantile of Student's t for 1 to 30 degrees of freedom; above, 1.96 with the usual correction.
T975 = (
    12.706205, 4.302653, 3.182446, 2.776445, 2.570582, 2.446912, 2.364624, 2.306004, 2.262157, 2.228139, 2.200985, 2.178813, 2.160369, 2.144787, 2.131450,
    2.119905, 2.109816, 2.100922, 2.093024, 2.085963, 2.079614, 2.073873, 2.068658, 2.063899, 2.059539, 2.055529, 2.051831, 2.048407, 2.045230, 2.042272,
)


def t975(degrees: Column) -> Column:
    z = 1.959964
    far = z + (z**3 + z) / (4 * degrees)
    return F.when(degrees.between(1, len(T975)), F.element_at(F.array(*map(F.lit, T975)), F.least(F.greatest(degrees, F.lit(1)), F.lit(len(T975))).cast("int"))).when(degrees > len(T975), far)


def student_ci(column: str) -> Column:
    """Half-width t s / sqrt(n); 0 for a single row."""
    n = F.count(column)
    return F.coalesce(t975(n - 1) * F.stddev_samp(column) / F.sqrt(n), F.lit(0.0))


def welch_ci(std_a: Column, n_a: Column, std_b: Column, n_b: Column) -> Column:
    """Half-width of the difference of two independent means."""
    return 1.96 * F.sqrt(std_a * std_a / n_a + std_b * std_b / n_b)
