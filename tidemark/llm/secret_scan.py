"""Secrets in texts, told from widely copied examples by who has them.

Patterns give candidate spans; a bare word is a candidate too if the corpus has it as the value of a pattern
elsewhere. The values' hashes are aggregated over the corpus by distinct repositories and distinct owners: a value
that many owners or very many repositories have is an example that was copied around, one that few have and that looks
random is live. All of
it runs in Spark's own operators; only rows with candidates are shuffled, by value and then by row.

Places are code points, the end exclusive. A null or empty text has no spans; a very long one is scanned whole. Null repositories and owners count as
one of their kind each. Rows are told apart by a number given when they are written, so repeated rows and null ids keep
theirs; an empty table gives an empty result. The input's columns travel in a struct: no names clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Written, small

_KEY = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
#: kind -> (pattern, group of the value, least length of the value); the first three are the base kinds, in their order
PATTERNS = {
    "assign": (rf"({_KEY})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
    "prefixed": (r"(?:gh[pousr]_|sk_live_|xox[abprs]-|glpat-)[A-Za-z0-9_-]{16,}", 0, 20),
    "jwt": (r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 30),
    # from the head line to the end line, else to the next head or the end of the text
    "pem": (r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----[\s\S]*?(?:-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----|(?=-----BEGIN )|\z)", 0, 20),
}
BASE = ("assign", "access", "hex")
BARE = r"[A-Za-z0-9+/_=-]{16,}"
#: What is not a key's body: its head and end lines, and white space, also as it is written in strings
_AROUND = r"-----(?:BEGIN|END) [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----|\\[nrt]|\s"
_SPAN = "array<struct<start:bigint,kind:int,end:bigint,value:string>>"


def spans(text: str, pattern: str, group: int, least: int, kind: int) -> Column:
    """The matches of a pattern, from the left without overlap, whose value has `least` characters; the value ends the match."""
    rx = F.lit(pattern)
    parts, found, values = F.split(F.col(text), pattern, -1), F.regexp_extract_all(F.col(text), rx, F.lit(0)), F.regexp_extract_all(F.col(text), rx, F.lit(group))
    zipped = F.arrays_zip(F.slice(F.transform(parts, F.length), F.lit(1), F.size(found)).alias("gap"), found.alias("hit"), values.alias("value"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr(f"cast(array() as {_SPAN})").alias("out"))

    def step(a, x):
        at = a["at"] + x["gap"]
        end = at + F.length(x["hit"])
        one = F.struct(at.cast("long").alias("start"), F.lit(kind).alias("kind"), end.cast("long").alias("end"), x["value"].alias("value"))
        return F.struct(end.cast("long").alias("at"), F.when(F.length(x["value"]) >= least, F.concat(a["out"], F.array(one))).otherwise(a["out"]).alias("out"))

    listed = F.aggregate(zipped, start, step, lambda a: a["out"])
    return F.when(F.col(text).rlike(pattern), listed).otherwise(F.expr(f"cast(array() as {_SPAN})"))


def body_of(s: str) -> Column:
    """The body of a key block, without line ends; the value of other spans."""
    return F.when(F.col(f"{s}.kind") == list(PATTERNS).index("pem"), F.regexp_replace(f"{s}.value", _AROUND, "")).otherwise(F.col(f"{s}.value"))


def hash_of(s: str) -> Column:
    return F.sha2(body_of(s).cast("binary"), 256)


def candidates(docs: DataFrame, keep: list[str] | None = None, text: str = "text", repository: str = "doc_id", owner: str = "source") -> DataFrame:
    """(rid, row, repo, owner, spans: those of the patterns, bare: words that may be values) of each document, written."""
    rows = docs.select(F.struct(*(keep or docs.columns)).alias("row"), F.coalesce(F.col(repository).cast("string"), F.lit("")).alias("repo"), F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    found = F.concat(*(spans("_t", p, g, n, k) for k, (p, g, n) in enumerate(PATTERNS.values())))
    bare = F.filter(spans("_t", BARE, 0, 16, len(PATTERNS)), lambda x: x["value"].rlike("[0-9]") & x["value"].rlike("[A-Za-z]"))
    # array_sort orders by start, then kind
    return Written(rows.select("row", "repo", "owner", F.array_sort(found).alias("spans"), bare.alias("bare")).withColumn("rid", F.monotonically_increasing_id())).df


def ownership(rows: DataFrame) -> DataFrame:
    """(hash, repositories, owners): how many distinct ones have each value of a pattern's span."""
    values = rows.select("repo", "owner", F.explode("spans").alias("s")).select(hash_of("s").alias("hash"), "repo", "owner")
    return values.groupBy("hash", "repo", "owner").agg(F.count("*").alias("n")).groupBy("hash").agg(F.count_distinct("repo").alias("repositories"), F.count_distinct("owner").alias("owners"))


def scanned(docs: DataFrame, keep: list[str] | None = None, widely: int = 10, copies: int = 1000, text: str = "text", repository: str = "doc_id", owner: str = "source") -> DataFrame:
    """(row, spans: array of (start, kind, end, value, owners, live)) of each document, base and added spans in order.

    Copied: `widely` owners have the value, or half of the corpus' owners where that is less (three at least), or `copies`
    repositories, whoever owns them. Live: it isn't copied, and it has a digit and at least 6 different characters, or is a key block with a body.
    Ownership of a key block is that of its body.
    """
    rows = candidates(docs, keep, text, repository, owner)
    bound = min(widely, max(3, (rows.agg(F.count_distinct("owner")).first()[0] + 1) // 2))
    known = Written(ownership(rows)).df
    known = small(known, known.count(), 160)
    some = rows.where("size(spans) > 0 or size(bare) > 0")
    each = some.select("rid", F.explode(F.concat("spans", "bare")).alias("s")).withColumn("hash", hash_of("s")).join(known, "hash")
    random = (F.col("s.value").rlike("[0-9]") & (F.size(F.array_distinct(F.split("s.value", ""))) >= 6)) | ((F.col("s.kind") == list(PATTERNS).index("pem")) & body_of("s").rlike("[A-Za-z0-9+/]{16,}"))
    copied = (F.col("owners") >= bound) | (F.col("repositories") >= copies)
    told = each.select("rid", F.struct("s.start", "s.kind", "s.end", "s.value", "owners", (~copied & random).alias("live")).alias("s"))
    # a bare word inside a pattern's span is that span's
    listed = told.groupBy("rid").agg(F.array_sort(F.collect_list("s")).alias("all"))
    bare = len(PATTERNS)
    own = F.expr(f"filter(all, x -> x.kind < {bare} or not exists(all, y -> y.kind < {bare} and y.start <= x.start and y.end >= x.end))")
    none = F.expr("cast(array() as array<struct<start:bigint,kind:int,end:bigint,value:string,owners:bigint,live:boolean>>)")
    with_some = some.join(listed.withColumnRenamed("rid", "_rid"), F.col("rid") == F.col("_rid"), "left").select("row", F.coalesce(own, none).alias("spans"))
    return with_some.union(rows.where("size(spans) = 0 and size(bare) = 0").select("row", none.alias("spans")))


def joined_spans(which: str) -> Column:
    names = "array(" + ", ".join(f"'{n}'" for n in [*PATTERNS, "bare"]) + ")"
    return F.expr(f"array_join(transform(filter(spans, x -> {which}), x -> concat(element_at({names}, x.kind + 1), ':', x.start, ':', x.end)), ',')")


def redacted(text: str, spans_column: str, mark: str = "[secret]") -> Column:
    """The text with the values of live spans replaced by a mark; overlapping ones by one."""
    return F.expr(
        f"aggregate(filter({spans_column}, x -> x.live), named_struct('at', 0L, 'out', ''), "
        f"(a, x) -> if(x.end <= a.at, a, named_struct('at', x.end, 'out', if(x.end - length(x.value) < a.at, a.out, concat(a.out, substring({text}, cast(a.at + 1 as int), cast(x.end - length(x.value) - a.at as int)), '{mark}')))), "
        f"a -> concat(a.out, substring({text}, cast(a.at + 1 as int))))"
    )
