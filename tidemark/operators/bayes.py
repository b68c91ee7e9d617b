"""Two-stage posterior over a row's candidate slots: one shuffle by the row, then windows over its candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import BayesConfig


def _normalised(x: Column, own: Window, eps: float) -> Column:
    """x, at least eps, over its sum."""
    floor = F.greatest(F.coalesce(x, F.lit(eps)), F.lit(eps))
    return floor / F.sum(floor).over(own)


def time_prior(edges: DataFrame, keys: list[str], delta: str, cfg: BayesConfig) -> DataFrame:
    """edges with `prior`: a decay by the time distance over its upper quartile, mixed with the uniform one."""
    own = Window.partitionBy(*keys)
    scale = F.greatest(F.coalesce(F.percentile(delta, 0.75).over(own), F.lit(1.0)), F.lit(1.0))
    known = edges.withColumns({"_scale": scale, "_most": F.max(delta).over(own), "_n": F.count("*").over(own)})
    far = F.coalesce(F.col(delta), F.col("_most") + F.col("_scale"))
    raw = F.exp(F.greatest(F.least(-cfg.alpha * F.greatest(far, F.lit(0.0)) / F.col("_scale"), F.lit(80.0)), F.lit(-80.0)))
    shaped = known.withColumn("_shape", F.when(F.col("_most").isNull(), 1 / F.col("_n")).otherwise(_normalised(raw, own, cfg.eps)))
    mixed = shaped.withColumn("_mix", cfg.mix * F.col("_shape") + (1 - cfg.mix) / F.col("_n"))
    return mixed.withColumn("prior", _normalised(F.col("_mix"), own, cfg.eps)).select(*edges.columns, "prior")


def likelihood(edges: DataFrame, keys: list[str], cost: str, out: str, cfg: BayesConfig) -> DataFrame:
    """edges with the likelihood of their costs: a decay by the distance from the least one, in units of the median absolute deviation."""
    own = Window.partitionBy(*keys)
    over = lambda x: x.over(own)
    near = edges.withColumns({"_lo": over(F.min(cost)), "_hi": over(F.max(cost)), "_mid": over(F.median(cost)), "_std": over(F.stddev_pop(cost)), "_n": over(F.count("*"))})
    near = near.withColumn("_mad", F.median(F.abs(F.col(cost) - F.col("_mid"))).over(own))
    span = F.col("_hi") - F.col("_lo")
    scale = F.when(F.col("_mad") > 1e-6, F.col("_mad")).when(F.col("_std") > 1e-6, F.col("_std")).when(span > 1e-6, span).otherwise(1.0)
    z = F.least(cfg.beta * F.greatest((F.col(cost) - F.col("_lo")) / scale, F.lit(0.0)), F.lit(80.0))
    raw = F.when(F.col(cost).isNull(), F.lit(cfg.eps)).otherwise(F.exp(-z))
    return near.withColumn(out, F.when(F.col("_lo").isNull(), 1 / F.col("_n")).otherwise(_normalised(raw, own, cfg.eps))).select(*edges.columns, out)


def combined(edges: DataFrame, keys: list[str], parts: list[tuple[str, float]], out: str, eps: float) -> DataFrame:
    """edges with the distribution whose logarithm is the sum of the parts' (column, power), normalised in each row."""
    own = Window.partitionBy(*keys)
    score = sum((power * F.log(F.greatest(F.col(c), F.lit(eps))) for c, power in parts), F.lit(0.0))
    risen = edges.withColumn("_s", score).withColumn("_e", F.exp(F.col("_s") - F.max("_s").over(own)))
    return risen.withColumn(out, F.col("_e") / F.sum("_e").over(own)).select(*edges.columns, out)


def checkpoints(scored: DataFrame, keys: list[str], cfg: BayesConfig | None = None, slot: str = "slot") -> DataFrame:
    """(keys, checkpoint, stage, label, top_slot, top1, top2) from posterior(): what was carried over, with the prior, and with the likelihood, in each stage."""
    cfg = cfg or BayesConfig()
    now, names = scored, []
    for k, (_, power) in enumerate(cfg.stages, 1):
        before = f"post{k - 1}"
        now = combined(now, keys, [(before, 1.0 if k == 1 else cfg.carry)], f"_carry{k}", cfg.eps)
        now = combined(now, keys, [(before, cfg.carry), ("prior", power)], f"_prior{k}", cfg.eps)
        carried = "carry_over_uniform_prior" if k == 1 else "carry_over_prev_power"
        names += [(k, carried, f"_carry{k}"), (k, "time_prior_applied", f"_prior{k}"), (k, "current_likelihood_renormalized", f"post{k}")]
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("checkpoint"), F.lit(k).alias("stage"), F.lit(label).alias("label"), F.col(c).alias("p")) for i, (k, label, c) in enumerate(names, 1))))
    flat = now.select(*keys, slot, each.alias("_c")).select(*keys, slot, "_c.*")
    return top_two(flat, [*keys, "checkpoint", "stage", "label"], "p", slot).drop("gap")


def updated(edges: DataFrame, keys: list[str], before: str, prior: str, like: str, power: float, out: str, cfg: BayesConfig) -> DataFrame:
    """edges with the posterior: a weighted sum of logarithms, shifted by its maximum, then normalised."""
    return combined(edges, keys, [(before, cfg.carry), (prior, power), (like, 1.0)], out, cfg.eps)


def posterior(edges: DataFrame, keys: list[str], delta: str, costs: list[str], cfg: BayesConfig | None = None) -> DataFrame:
    """edges with prior, post1.., like1.. and `cost`, what assignment minimises; costs: the column of each stage."""
    cfg = cfg or BayesConfig()
    now = time_prior(edges, keys, delta, cfg).withColumn("post0", 1 / F.count("*").over(Window.partitionBy(*keys)))
    for k, (cost, (_, power)) in enumerate(zip(costs, cfg.stages, strict=True), 1):
        now = likelihood(now, keys, cost, f"like{k}", cfg)
        now = updated(now, keys, f"post{k - 1}", "prior", f"like{k}", power, f"post{k}", cfg)
    last = len(costs)
    minus_log = lambda c: -F.log(F.greatest(F.col(c), F.lit(cfg.eps)))
    return now.withColumn("cost", (1 - cfg.current) * minus_log(f"post{last}") + cfg.current * minus_log(f"like{last}"))


def top_two(edges: DataFrame, keys: list[str], prob: str, slot: str = "slot") -> DataFrame:
    """(keys, top_slot, top1, top2, gap): the most probable slot, the lowest of equals."""
    order = Window.partitionBy(*keys).orderBy(F.desc(prob), slot)
    ranked = edges.withColumn("_k", F.row_number().over(order)).where("_k <= 2")
    at = lambda k, c: F.max(F.when(F.col("_k") == k, F.col(c)))
    found = ranked.groupBy(*keys).agg(at(1, slot).alias("top_slot"), at(1, prob).alias("top1"), F.coalesce(at(2, prob), F.lit(0.0)).alias("top2"))
    return found.withColumn("gap", F.col("top1") - F.col("top2"))
