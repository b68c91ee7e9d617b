"""Benchmark passages in documents by a distributed positional inverted index.

The items' windows of `width` words are the test phrases. The corpus frequency of every test term is counted over all
documents; a phrase with a term that no document has is out. The index stores the postings (document, position) of
each phrase's two rarest terms, those of the rarest with the words around them, and each document's number of words.
The lists, each shifted by the term's offset in the phrase, are gathered by document and intersected; where they meet
the phrase must stand word for word in the words around. Lists that come within `distance` words of each other are a
proximity match. Two scans of the texts do all of it, and no text is shuffled. Terms are joined by 64-bit hash; a
collision costs time only, since phrases are compared by their words. Postings are spread by document, so a term or
passage that many documents share is no hot spot. All of it runs in Spark's own operators.

Documents are matched by (id, hash of the text), so equal ids and repeated rows keep their own rows. A null or empty
text has no words, no hits and isn't contaminated; an item without a word has no window, an item without an id counts
as one whose id is empty. Very long texts are scanned whole, in time that grows with their length. Empty tables give
empty or clean results. Only the columns named are read, so others can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Written, small
from .url_filter import LOWER, UPPER

#: The ASCII characters that no word has.
NO_WORD = "".join(chr(c) for c in (*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)))
#: Stands behind the last word of each document; no word has a blank.
END = " end"


def words_of(text: Column) -> Column:
    """The words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ in order, A-Z lower-cased: one mapping of characters and a split at blanks, without a pattern."""
    mapped = F.translate(F.coalesce(text, F.lit("")), UPPER + NO_WORD, LOWER + " " * len(NO_WORD))
    return F.array_remove(F.split(mapped, " "), "")


def phrases(items: DataFrame, width: int, id_column: str = "item_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(wid, phrase) of the distinct windows, and (wid, item_id): a row for each pair, so a passage of all items is no hot row."""
    own = items.select(F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("item_id"), words_of(F.col(text)).alias("w")).where("size(w) > 0")
    own = own.select("item_id", "w", F.explode(F.expr(f"sequence(0, greatest(0, size(w) - {width}))")).alias("i"))
    own = Written(own.select("item_id", F.expr(f"slice(w, i + 1, {width})").alias("phrase")).distinct())
    windows = Written(own.df.select("phrase").distinct().withColumn("wid", F.monotonically_increasing_id()))
    pairs = Written(own.df.join(windows.df, "phrase").select("wid", "item_id"))
    own.drop()
    return windows.df.select("wid", "phrase"), pairs.df


class Index:
    """Postings of the test phrases' rarest terms in the documents."""

    def __init__(self, docs: DataFrame, windows: DataFrame, width: int = 13, id_column: str = "doc_id", text: str = "text"):
        spark = docs.sparkSession
        self.docs = docs.select(F.col(id_column).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h"), words_of(F.col(text)).alias("w"))
        terms = windows.select("wid", F.posexplode("phrase").alias("off", "term")).select("wid", "off", F.xxhash64("term").alias("key"))
        vocabulary = Written(terms.select("key").distinct())
        counted = self.docs.select(F.explode("w").alias("term")).select(F.xxhash64("term").alias("key"))
        counted = counted.join(small(vocabulary.df, vocabulary.df.count(), 16), "key").groupBy("key").agg(F.count("*").alias("n"))
        self.frequency = Written(counted)
        vocabulary.drop()
        found = terms.join(self.frequency.df, "key", "left").withColumn("missing", F.max(F.col("n").isNull()).over(Window.partitionBy("wid")))
        rank = F.row_number().over(Window.partitionBy("wid").orderBy("n", "off"))
        chosen = found.where("not missing").withColumn("rank", rank - 1).where("rank < 2").select("wid", "key", "off", "rank")
        self.anchors = Written(chosen)
        self._n, self._words = self.anchors.df.agg(F.count("*"), F.count_distinct("key")).first()
        # the phrases with what is known of them, and how many bytes they take
        held = self.anchors.df.groupBy("wid").agg(F.count("*").alias("terms"))
        self.windows = Written(windows.join(held, "wid").select("wid", "phrase", F.size("phrase").alias("n"), "terms"))
        self._bytes = self.windows.df.agg(F.coalesce(F.sum(48 + 24 * F.size("phrase") + F.octet_length(F.array_join("phrase", ""))), F.lit(0))).first()[0]
        end = spark.range(1).select(F.xxhash64(F.lit(END)).alias("key"), F.lit(1).alias("rank"))
        listed = self.anchors.df.groupBy("key").agg(F.min("rank").alias("rank")).unionByName(end)
        placed = self.docs.select("doc_id", "h", "w", F.posexplode(F.concat("w", F.array(F.lit(END)))).alias("pos", "term"))
        placed = placed.select("doc_id", "h", "w", "pos", F.xxhash64("term").alias("key")).join(small(listed, self._words + 1, 24), "key")
        first = F.greatest(F.col("pos") - width + 1, F.lit(0))
        around = F.when(F.col("rank") == 0, F.slice("w", first + 1, F.lit(2 * width - 1)))
        self.postings = Written(placed.select("doc_id", "h", "pos", "key", first.alias("first"), around.alias("around")))

    def lists(self) -> DataFrame:
        """(doc_id, h, wid, n, terms, rank, start, exact): the postings shifted to where their phrase would start; exact: the words around the rarest are the phrase."""
        found = self.postings.df.join(small(self.anchors.df, self._n, 40), "key").withColumn("start", F.col("pos") - F.col("off"))
        whole = found.join(small(self.windows.df, self._bytes, 1), "wid")
        same = F.slice("around", F.greatest(F.col("start") - F.col("first"), F.lit(0)) + 1, F.size("phrase")) == F.col("phrase")
        exact = (F.col("rank") == 0) & (F.col("start") >= 0) & same
        return whole.select("doc_id", "h", "wid", "n", "terms", "rank", "start", F.coalesce(exact, F.lit(False)).alias("exact"))

    def met(self, distance: int) -> DataFrame:
        """(doc_id, h, wid, n, starts, near) of each document and phrase whose lists meet.

        starts: where the phrase stands word for word; near: the lists come within `distance` words of each other. One
        shuffle by document; the next grouping by document keeps its partitions.
        """
        at = F.array_sort(F.collect_list(F.struct("start", "rank", "exact")))
        each = self.lists().repartition("doc_id", "h").groupBy("doc_id", "h", "wid", "n", "terms").agg(at.alias("at"))
        each = each.where("terms = 1 or (exists(at, x -> x.rank = 0) and exists(at, x -> x.rank = 1))")
        list_of = lambda which: f"transform(filter(at, x -> {which}), x -> x.start)"
        starts = f"if(terms = 1, array_distinct({list_of('x.exact')}), array_intersect({list_of('x.exact')}, {list_of('x.rank = 1')}))"
        # in order of starts, the nearest of the two lists are neighbours
        step = f"""(a, x) -> named_struct('zero', if(x.rank = 0, x.start, a.zero), 'one', if(x.rank = 1, x.start, a.one),
            'near', a.near or if(x.rank = 0, coalesce(x.start - a.one <= {distance}, false), coalesce(x.start - a.zero <= {distance}, false)))"""
        near = f"aggregate(at, named_struct('zero', cast(null as int), 'one', cast(null as int), 'near', false), {step}).near"
        return each.select("doc_id", "h", "wid", "n", F.expr(starts).alias("starts"), F.expr(f"terms = 1 or {near}").alias("near"))

    def matches(self, distance: int = 5) -> DataFrame:
        """(doc_id, h, n_words, hits: sorted array of (start, n, wid), n_near) of all documents: where a phrase stands word for word, and how many phrases are near."""
        met = self.met(distance).where("near or size(starts) > 0")
        hits = F.array_sort(F.flatten(F.collect_list(F.transform("starts", lambda s: F.struct(s.alias("start"), F.col("n").alias("n"), F.col("wid").alias("wid"))))))
        found = Written(met.groupBy("doc_id", "h").agg(hits.alias("hits"), F.count_if("near").alias("n_near")).withColumnsRenamed({"doc_id": "_id", "h": "_h"})).df
        rows, most = found.agg(F.count("*"), F.coalesce(F.sum(F.size("hits")), F.lit(0))).first()
        every = self.postings.df.where(F.col("key") == F.xxhash64(F.lit(END))).select("doc_id", "h", F.col("pos").cast("long").alias("n_words"))
        joined = every.join(small(found, rows + most, 48), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left")
        none = F.expr("cast(array() as array<struct<start:int,n:int,wid:bigint>>)")
        return joined.select("doc_id", "h", "n_words", F.coalesce("hits", none).alias("hits"), F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"))

    def drop(self) -> None:
        for table in (self.frequency, self.anchors, self.windows, self.postings):
            table.drop()


def contamination(
    docs: DataFrame, items: DataFrame, width: int = 13, part: int = 20, id_column: str = "doc_id", text: str = "text", item_column: str = "item_id", item_text: str = "text", distance: int = 5
) -> DataFrame:
    """(doc_id, h, n_words, n_hit, n_items, items_sha256, n_near, contaminated).

    n_hit: words inside occurrences of the items' windows; n_near: windows whose two rarest terms stand within `distance`
    words of their places in it, the occurrences included.
    """
    windows, of = phrases(items, width, item_column, item_text)
    index = Index(docs, windows, width, id_column, text)
    covered = F.expr(
        "aggregate(hits, named_struct('till', 0L, 'n', 0L), (a, x) -> named_struct('till', greatest(a.till, cast(x.start + x.n as bigint)), "
        "'n', a.n + greatest(0L, x.start + x.n - greatest(a.till, cast(x.start as bigint))))).n"
    )
    wids = F.expr("array_distinct(transform(hits, x -> x.wid))")
    rows = Written(index.matches(distance).select("doc_id", "h", "n_words", covered.alias("n_hit"), "n_near", wids.alias("wids"))).df
    index.drop()
    named = rows.where("n_hit > 0").select("doc_id", "h", F.explode("wids").alias("wid")).join(of, "wid").groupBy("doc_id", "h").agg(F.sort_array(F.collect_set("item_id")).alias("ids"))
    hit = rows.where("n_hit > 0").join(named.withColumnsRenamed({"doc_id": "_id", "h": "_h"}), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")))

    def told(df: DataFrame, ids: Column) -> DataFrame:
        sha = F.sha2(F.array_join(ids, ",").cast("binary"), 256)
        return df.select("doc_id", "h", "n_words", "n_hit", F.size(ids).cast("long").alias("n_items"), sha.alias("items_sha256"), "n_near")

    every = told(hit, F.col("ids")).union(told(rows.where("n_hit = 0"), F.expr("cast(array() as array<string>)")))
    return every.withColumn("contaminated", (F.col("n_hit") > 0) & (part * F.col("n_hit") >= F.col("n_words")))
