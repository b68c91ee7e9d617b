"""Quality rules with thresholds that follow the corpus.

Each document is measured. The measures of each (lang, source) go into mergeable quantile sketches: counts of
integer bins whose width is at most 1/16 of their value, so sketches merge by adding counts, exactly and in any order,
and have a bounded size. A document is rejected where a measure lies outside the fences of its group, quartile plus or
minus `FENCE` times the quartile distance (at least the measure's `least`). Groups of fewer than `min_docs` documents
take the fences of their language, or else those of all documents. Documents that fail the base rules don't enter the
sketches. All of it runs in Spark's own operators.

A null or empty text has no words: it fails the base rules. A null lang or source is a group of its own. Very long
texts are measured whole and counted exactly. Equal rows each keep their row and values on a fence pass; an empty table
gives an empty result. The input's columns travel in a struct: no names clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Written, small

BLANK = r"[\x20\x09-\x0D]"
SYMBOLS = "[#*$%&|<>]"
CAPITALS = "[A-Z]"
MARKS = "[!?]"
FENCE = 3
#: measure -> (the least quartile distance, whether values below the lower fence are rejected too)
MEASURES = {"symbols": (20, False), "capitals": (25, False), "marks": (60, False), "dup_lines": (150, False), "repeats": (100, False), "word_length": (60, True)}


def repeated_words(words: str, n: str) -> list[tuple[str, Column]]:
    """Steps of columns; the last, _repeat, is the number of words inside 3-word windows that are found twice or more.

    Windows are first compared by what is left of a 64-bit hash beside the bits of the position; those that agree are
    compared by their words, so the count is exact for texts of any length.
    """
    hashes = f"transform(sequence(0L, {n} - 3), i -> (xxhash64({words}[i], {words}[i + 1], {words}[i + 2]) & _high) | i)"
    # beyond either end get() is null, which a filter takes for false
    maybe = "filter(_hashes, (x, j) -> (x ^ get(_hashes, j - 1)) & _high = 0 or (x ^ get(_hashes, j + 1)) & _high = 0)"
    # no word has a blank, so the joined words are equal only if the words are
    joined = f"transform(transform(_maybe, x -> cast(x & ~_high as int)), p -> named_struct('w', concat_ws(' ', {words}[p], {words}[p + 1], {words}[p + 2]), 'p', p))"
    same = "sort_array(transform(filter(_windows, (x, j) -> x.w = get(_windows, j - 1).w or x.w = get(_windows, j + 1).w), x -> x.p))"
    covered = "aggregate(_at, named_struct('last', -3, 'n', 0L), (a, p) -> named_struct('last', p, 'n', a.n + least(3, p - a.last))).n"
    return [
        ("_high", F.expr(f"~(shiftleft(1L, length(bin({n}))) - 1)")),
        ("_hashes", F.expr(f"if({n} < 4, array(), sort_array({hashes}))")),
        ("_maybe", F.expr(maybe)),
        ("_windows", F.expr(f"array_sort({joined})")),
        ("_at", F.expr(same)),
        ("_repeat", F.expr(covered)),
    ]


def measured(docs: DataFrame, keep: list[str] | None = None, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(row: the columns `keep`, all by default; lang, source, the base counts and the measures) of each document."""
    rows = docs.select(F.struct(*(keep or docs.columns)).alias("row"), F.col(lang).alias("lang"), F.col(source).alias("source"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # a split at runs of blanks has an empty part where the text begins or ends with one
    rows = rows.withColumn("_words", F.array_remove(F.split("text", f"{BLANK}+"), "")).withColumn("_lines", F.expr(r"filter(split(text, r'\n'), x -> x rlike r'[^\x20\x09-\x0D]')"))
    of = lambda pattern: F.regexp_count("text", F.lit(pattern)).cast("long")
    rows = rows.select(
        "row",
        "lang",
        "source",
        "_words",
        F.size("_words").cast("long").alias("n_words"),
        (F.length("text") - of(BLANK)).alias("word_chars"),
        of(SYMBOLS).alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        of(CAPITALS).alias("n_capitals"),
        of(MARKS).alias("n_marks"),
    )
    no_longer = {"_maybe": "_hashes", "_windows": "_words", "_at": "_maybe", "_repeat": "_windows"}
    for name, column in repeated_words("_words", "n_words"):
        rows = rows.withColumn(name, column).drop(no_longer.get(name, ""))
    n, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    share = lambda a, b: F.floor(F.col(a) * 1000 / b).cast("long")
    measures = F.struct(
        share("n_symbols", chars).alias("symbols"),
        share("n_capitals", chars).alias("capitals"),
        share("n_marks", n).alias("marks"),
        share("n_dup_lines", F.greatest("n_lines", F.lit(1))).alias("dup_lines"),
        share("_repeat", n).alias("repeats"),
        F.floor(F.col("word_chars") * 100 / n).cast("long").alias("word_length"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("_repeat") > 50 * F.col("n_words"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", F.col("_repeat").alias("n_repeat_words")]
    return rows.select("row", "lang", "source", *counts, failed.alias("base_failed"), measures.alias("measures"))


def sketches(rows: DataFrame) -> DataFrame:
    """(lang, source, measure, bin, n): the quantile sketch of each group; sums over n merge sketches."""
    pairs = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(f"measures.{m}").alias("x")) for m in MEASURES))).alias("p")
    # up to 31 a bin for each number; above, 16 for each power of two
    e = "(length(bin(x)) - 5)"
    return rows.where("not base_failed").select("lang", "source", pairs).select("lang", "source", "p.*").withColumn("bin", F.expr(f"if(x < 32, x, 16 + 16 * {e} + shiftright(x, {e}) - 16)")).groupBy("lang", "source", "measure", "bin").agg(F.count("*").alias("n"))


def thresholds(leaves: DataFrame, min_docs: int) -> DataFrame:
    """(lang, source, fences): the lowest and highest value of each measure that passes, for each group in the sketches."""
    keys = F.explode(F.array(F.struct(F.lit(0).alias("level"), F.col("lang").alias("l"), F.col("source").alias("s")), F.struct(F.lit(1).alias("level"), F.col("lang").alias("l"), F.lit(None).alias("s")), F.struct(F.lit(2).alias("level"), F.lit(None).alias("l"), F.lit(None).alias("s")))).alias("k")
    merged = leaves.select("measure", "bin", "n", keys).groupBy("k", "measure", "bin").agg(F.sum("n").alias("n"))
    whole = Window.partitionBy("k", "measure")
    ranked = merged.withColumn("till", F.sum("n").over(whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(whole))
    value = ranked.withColumn("x", F.expr("if(bin < 32, bin, shiftleft(16 + (bin - 32) % 16, cast(1 + (bin - 32) div 16 as int)))"))
    quartiles = value.groupBy("k", "measure").agg(F.min(F.when(F.col("till") * 4 >= F.col("all"), F.col("x"))).alias("q1"), F.min(F.when(F.col("till") * 4 >= F.col("all") * 3, F.col("x"))).alias("q3"), F.max("all").alias("docs"))
    least = F.coalesce(*(F.when(F.col("measure") == m, F.lit(v)) for m, (v, _) in MEASURES.items()))
    low = F.col("measure").isin([m for m, (_, both) in MEASURES.items() if both])
    far = FENCE * F.greatest(F.col("q3") - F.col("q1"), least)
    fences = quartiles.select("k", "measure", "docs", F.when(low, F.col("q1") - far).otherwise(F.lit(-1)).alias("lo"), (F.col("q3") + far).alias("hi"))
    wide = fences.groupBy("k").agg(F.max("docs").alias("docs"), *(F.max(F.when(F.col("measure") == m, F.struct("lo", "hi"))).alias(m) for m in MEASURES)).select("k", "docs", F.struct(*MEASURES).alias("fences"))
    of = lambda level: wide.where(F.col("k.level") == level)
    top = of(2).select(F.col("fences").alias("f2"))
    middle = of(1).select(F.col("k.l").alias("l1"), F.when(F.col("docs") >= min_docs, F.col("fences")).alias("f1"))
    groups = of(0).select(F.col("k.l").alias("lang"), F.col("k.s").alias("source"), F.when(F.col("docs") >= min_docs, F.col("fences")).alias("f0"))
    return groups.join(middle, F.col("lang").eqNullSafe(F.col("l1")), "left").crossJoin(F.broadcast(top)).select("lang", "source", F.coalesce("f0", "f1", "f2").alias("fences"))


def judged(docs: DataFrame, keep: list[str] | None = None, min_docs: int = 100, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """measured() with kept: neither the base rules nor a fence of the group reject the document."""
    rows = Written(measured(docs, keep, text, lang, source)).df
    # six pairs of bounds a group, as many groups as (lang, source) has
    found = Written(thresholds(sketches(rows), min_docs)).df.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    join = small(found, found.count(), 400)
    joined = rows.join(join, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    inside = F.lit(True)
    for m in MEASURES:
        x = F.col(f"measures.{m}")
        inside = inside & (x >= F.col(f"fences.{m}.lo")) & (x <= F.col(f"fences.{m}.hi"))
    return joined.select(*rows.columns, (~F.col("base_failed") & F.coalesce(inside, F.lit(False))).alias("kept"))
