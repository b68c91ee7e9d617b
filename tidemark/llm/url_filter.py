"""URL verdicts by a tree of path templates for each host.

URLs that a rule fits take its verdict; they are the labels. Level by level, the segments of a host's paths become
branches. A section (a segment that paths go on below) stays by name, however few URLs it has, if only it has labels or
if its labels differ from its siblings' by more than chance (a two-sample z-test); a path's last segment does if it is
frequent too. The others fall together in a wildcard *. Sections without labels whose siblings have some fall in a
wildcard of their own, ~, so that the siblings' labels don't judge them. A template's purity is the share of blocked labels, smoothed
towards the corpus' share with the weight of `prior` labels; at `reject` or more the template's other URLs are blocked.
All of it runs in Spark's own operators, with one aggregation for each level; there are as many levels
as tell labelled URLs from others.

A null URL or one without :// has an empty host and path and is judged as such. Equal URLs get equal verdicts; a null
id stays null; an empty table gives an empty result. Only the two named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Written, small

RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.expr("substring(url, instr(url, '://') + 3)")
    return F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)).otherwise("")


def path_of(url: Column) -> Column:
    rest = F.expr("substring(url, instr(url, '://') + 3)")
    return F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def rule_of(host: Column, path: Column, rules) -> Column:
    """struct(verdict, rule) of the longest rule that fits, or null; of equally long ones the last by name."""
    found = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        at, _, rest = rule.partition("/")
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(f"/{rest}")
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(found)
    return found


def templates(urls: DataFrame, levels: int = 6, least: int = 8, z: float = 2.0) -> DataFrame:
    """urls (host, path, label) with `template`: the path with variable and merged segments as * or ~, deeper ones as one **.

    At least `levels` levels are told apart, and more as long as a template has both labelled and other URLs below it.
    """
    now = urls.withColumn("_seg", F.split("path", "/")).withColumn("_last", F.size(F.split(F.rtrim("path", F.lit("/")), "/")) - 1).withColumn("template", F.lit(""))
    level = 0
    while level < levels or open_below(now, level):
        level += 1
        now = now.withColumn("_s", F.expr(f"get(_seg, {level})"))
        counts = now.where("_s is not null").groupBy("host", "template", "_s").agg(F.count("*").alias("n"), F.count("label").alias("m"), F.coalesce(F.sum("label"), F.lit(0)).alias("k"), F.bool_or(F.col("_last") > level).alias("section"))
        total = counts.groupBy("host", "template").agg(F.sum("m").alias("all_m"), F.sum("k").alias("all_k"))
        pair = counts.withColumnsRenamed({"host": "h", "template": "t"}).join(total.withColumnsRenamed({"host": "h2", "template": "t2"}), (F.col("h") == F.col("h2")) & (F.col("t") == F.col("t2")))
        # this branch against its siblings together: equal up to chance, or nothing to tell by
        pooled = F.col("all_k") / F.greatest("all_m", F.lit(1))
        rest = F.col("all_m") - F.col("m")
        gap = F.abs(F.col("k") / F.greatest("m", F.lit(1)) - (F.col("all_k") - F.col("k")) / F.greatest(rest, F.lit(1)))
        chance = z * F.sqrt(pooled * (1 - pooled) * (1 / F.greatest("m", F.lit(1)) + 1 / F.greatest(rest, F.lit(1))))
        labelled = (F.col("m") > 0) != (rest > 0)
        often = F.col("n") >= least
        # one label is too little to differ by: such branches would leave the wildcard with the labels of the majority only
        differs = (F.col("m") > 0) & (rest > 0) & (gap > chance) & (often | F.col("section") & (F.col("m") > 1))
        stays = differs | labelled & (often | F.col("section") & (F.col("m") > 0))
        apart = labelled & F.col("section") & (F.col("m") == 0)
        kept = pair.where(stays | apart).select("h", "t", F.col("_s").alias("s"), F.when(stays, F.col("_s")).otherwise(F.lit("~")).alias("as"))
        now = now.join(kept, (F.col("host") == F.col("h")) & (F.col("template") == F.col("t")) & (F.col("_s") == F.col("s")), "left")
        now = now.withColumn("template", F.when(F.col("_s").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), F.coalesce("as", F.lit("*"))))).drop("h", "t", "s", "as", "_s")
        now = Written(now).df
    deeper = F.size("_seg") > level + 1
    return now.withColumn("template", F.when(deeper, F.concat("template", F.lit("/**"))).otherwise(F.col("template"))).drop("_seg", "_last")


def open_below(now: DataFrame, level: int) -> bool:
    """Whether a template has both labelled and other URLs, and some of them go on below the level."""
    groups = now.groupBy("host", "template").agg(F.count("*").alias("n"), F.count("label").alias("m"), F.max(F.size("_seg")).alias("size"))
    return not groups.where((F.col("size") > level + 1) & (F.col("m") > 0) & (F.col("m") < F.col("n"))).isEmpty()


def verdicts(pages: DataFrame, rules=RULES, prior: float = 4.0, reject: float = 0.8, id_column: str = "page_id", url: str = "url", **tree) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) of each URL."""
    parsed = pages.select(F.col(id_column).alias("page_id"), F.col(url).alias("url")).select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ruled = parsed.withColumn("_r", rule_of(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", F.col("_r.rule").alias("rule"), F.col("_r.verdict").alias("_v"))
    placed = templates(ruled.withColumn("label", F.when(F.col("_v") == "block", 1).when(F.col("_v") == "allow", 0)), **tree)
    corpus = placed.agg(F.count("label").alias("_m"), F.coalesce(F.sum("label"), F.lit(0)).alias("_k"))
    each = placed.where("label is not null").groupBy("host", "template").agg(F.count("*").alias("m"), F.sum("label").alias("k")).crossJoin(F.broadcast(corpus))
    base = F.col("_k") / F.greatest("_m", F.lit(1))
    pure = Written(each.select(F.col("host").alias("h"), F.col("template").alias("t"), ((F.col("k") + prior * base) / (F.col("m") + prior)).alias("purity"))).df
    joined = placed.join(small(pure, pure.count(), 200), (F.col("host") == F.col("h")) & (F.col("template") == F.col("t")), "left")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("_v", F.when(F.col("purity") >= reject, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "template", "purity")
