"""The registry's matchers over one batch table of pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import Matcher
from tidemark.functions.kernels import cost_column, terms_column

from . import bayes
from .assign import assigned


def tie_break() -> Column:
    """Less than any real difference of costs, and different for each pair of a batch."""
    return 1e-6 * (F.col("ri") + 0.01 * F.col("cj"))


def prefix_points(n: Column, share: float, min_shared: int) -> Column:
    """Points of a stage: the share of n, rounded half to even, at least min_shared, from 1 to n."""
    return F.greatest(F.lit(1), F.least(F.greatest(F.lit(min_shared), F.bround(F.lit(share) * n).cast("int")), n))


def stage_costs(pairs: DataFrame, shares: tuple[float, ...], matcher: Matcher, min_shared: int) -> tuple[DataFrame, list[str]]:
    names = []
    for k, share in enumerate(shares, 1):
        n = prefix_points(F.size("e"), share, min_shared)
        cut = pairs.withColumn("_e", F.slice("e", F.lit(1), n)).withColumn("_s", F.slice("s", F.lit(1), n))
        pairs = cut.withColumn(f"c{k}", cost_column("_e", "_s", matcher.weights, min_shared)).drop("_e", "_s")
        names.append(f"c{k}")
    return pairs, names


def costed(pairs: DataFrame, matcher: Matcher, min_shared: int = 4) -> DataFrame:
    """pairs (batch, row, slot, ri, cj, e, s, delta) with cost; null where the pair isn't allowed."""
    if matcher.cost == "time":
        return pairs.withColumn("cost", F.col("delta") + tie_break())
    if matcher.cost == "waveform":
        found, names = stage_costs(pairs, matcher.prefixes, matcher, min_shared)
        return found.withColumn("cost", sum((F.col(c) for c in names[1:]), F.col(names[0])) / len(names) + tie_break()).drop(*names)
    if matcher.cost == "similarity":
        whole = Window.partitionBy("batch")
        found = pairs.withColumn("_t", terms_column("e", "s", matcher.weights, min_shared)).withColumn("_d", F.nanvl("_t.path", F.lit(None)))
        low, high = F.min("_d").over(whole), F.max("_d").over(whole)
        near = F.when(high == low, 1.0).otherwise(1 - (F.col("_d") - low) / F.nullif(high - low, F.lit(0.0)))
        corr = (F.nanvl("_t.corr", F.lit(0.0)) + 1) / 2
        value = F.lit(0.0) if matcher.corr_weight <= 0 and matcher.dtw_weight <= 0 else near if matcher.corr_weight <= 0 else corr if matcher.dtw_weight <= 0 else corr * near
        return found.withColumn("cost", F.when(F.col("_d").isNotNull(), 1 - value + tie_break())).drop("_t", "_d")
    found, names = stage_costs(pairs, tuple(s for s, _ in matcher.bayes.stages), matcher, min_shared)
    scored = bayes.posterior(found, ["batch", "row"], "delta", names, matcher.bayes)
    return scored.withColumn("cost", F.col("cost") + tie_break()).select(*pairs.columns, "cost")


def matched(pairs: DataFrame, matcher: Matcher, min_shared: int = 4) -> DataFrame:
    """(algorithm_id, batch, row, slot, cost, fallback)"""
    # only the greedy matcher by waveform gives a row without an allowed slot one
    last_resort = (matcher.cost, matcher.assign, len(matcher.prefixes)) == ("waveform", "greedy", 1)
    return assigned(costed(pairs, matcher, min_shared), matcher.assign, last_resort).withColumn("algorithm_id", F.lit(matcher.name))
