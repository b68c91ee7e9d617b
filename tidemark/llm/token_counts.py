"""Token counts by a map-side two-tier lookup.

First tier: the lengths, in tokens, of the corpus' most frequent pre-tokens, a table of at most `tier_rows` rows that
is broadcast. They are found by Misra-Gries summaries of all texts, one of at most `tier_rows` counters a task, merged
as a tree; only these bounded summaries move, never the pre-tokens. Second tier: each worker keeps the lengths of what
the first lacks in a cache. The tiers change the speed only: each pre-token's length is the tokenizer's own.

A null or empty text has 0 tokens; a very long one is counted whole. Equal rows and equal ids each keep their row; a null id stays null. Columns of the
input other than the two named aren't read, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import pretoken
from .shared import slices

TIER_ROWS = 1 << 13
_SUMMARY = T.StructType([T.StructField("part", T.LongType()), T.StructField("token", T.ArrayType(T.BinaryType())), T.StructField("n", T.ArrayType(T.LongType()))])


def trimmed(counts: dict, most: int) -> dict:
    """Misra-Gries: at most `most` counters stay, each less the largest that goes."""
    if len(counts) <= most:
        return counts
    n = np.fromiter(counts.values(), dtype=np.int64, count=len(counts))
    less = np.partition(n, len(n) - most - 1)[len(n) - most - 1]
    return {k: v - int(less) for k, v in counts.items() if v > less}


def _summaries(path: str, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, kept, names = pretoken.encoder(path), {}, {}
        for batch in (part for whole in batches for part in slices(whole, 0)):
            texts = [x.encode() if x else b"" for x in batch.column(0).to_pylist()]
            for numbers, sizes, raw in enc.chunks(texts):
                if sizes is None:
                    continue
                data, starts, ends, _ = enc.pieces(raw, sizes)
                a, b = pretoken.piece_hashes(data, starts, ends)
                order = np.argsort(a)
                edge = np.flatnonzero(np.append(True, a[order][1:] != a[order][:-1]))
                n = np.diff(np.append(edge, len(order)))
                few = np.argsort(n)[-2 * most :]
                less = int(n[np.argsort(n)[-2 * most - 1]]) if len(n) > 2 * most else 0
                for k in few:
                    at = order[edge[k]]
                    if n[k] > less and ends[at] - starts[at] <= pretoken.LONG:
                        key = int(a[at])
                        kept[key] = kept.get(key, 0) + int(n[k]) - less
                        names.setdefault(key, raw[starts[at] : ends[at]])
                kept = trimmed(kept, most)
                names = {k: names[k] for k in kept}
        if kept:
            yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([[names[k] for k in kept]], pa.list_(pa.binary())), pa.array([list(kept.values())], pa.list_(pa.int64()))], names=["part", "token", "n"])

    return run


def _merged(most: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        counts: dict = {}
        for tokens, ns in zip(rows["token"], rows["n"], strict=True):
            for t, n in zip(tokens, ns, strict=True):
                counts[t] = counts.get(t, 0) + int(n)
            counts = trimmed(counts, 2 * most)
        counts = trimmed(counts, most)
        return pd.DataFrame({"part": [int(rows["part"].iloc[0])], "token": [list(counts)], "n": [list(counts.values())]})

    return run


def frequent_pretokens(docs: DataFrame, path: str, most: int = TIER_ROWS, text: str = "text", fan_in: int = 32) -> list[bytes]:
    """At most `most` of the pre-tokens that are the most frequent in all texts; each level merges `fan_in` summaries."""
    tree = docs.select(F.col(text)).mapInArrow(_summaries(path, most), _SUMMARY)
    parts = docs.select(F.col(text)).rdd.getNumPartitions()
    while parts > 1:
        tree = tree.groupBy(F.expr(f"part div {fan_in}").alias("to")).applyInPandas(_merged(most), _SUMMARY).withColumn("part", F.expr(f"part div {fan_in}"))
        parts = -(-parts // fan_in)
    found: dict[bytes, int] = {}
    for row in tree.collect():
        found |= dict(zip(map(bytes, row["token"]), row["n"], strict=True))
    return sorted(found, key=lambda t: (-found[t], t))[:most]


def length_table(tokens: list[bytes], path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the pre-tokens and their lengths in tokens, by the library itself."""
    enc = pretoken.encoder(path)
    raw, sizes = b"".join(tokens), np.array([len(t) for t in tokens], dtype=np.int64)
    ends = np.cumsum(sizes)
    a, b = pretoken.piece_hashes(np.frombuffer(raw, dtype=np.uint8), ends - sizes, ends)
    n = [len(x.ids) for x in enc.library.encode_batch([t.decode() for t in tokens], add_special_tokens=False)]
    return a, b, np.array(n, dtype=np.int64)


def counter(docs: DataFrame, path: str, most: int = TIER_ROWS, text: str = "text") -> Column:
    """A column with the number of tokens of the text; gathers the first tier from `docs` now."""
    tier = docs.sparkSession.sparkContext.broadcast(length_table(frequent_pretokens(docs, path, most, text), path))

    @F.pandas_udf(T.LongType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = pretoken.encoder(path)
        a, b, n = tier.value
        first = pretoken.Cache(max(4, int(len(a) * 4).bit_length()))
        first.add(a, b)
        n = np.append(n, -1)
        known = lambda x, y: n[first.find(x, y)]
        for batch in batches:
            yield pd.Series(enc.counts([x.encode() if x else b"" for x in batch], known if len(a) else None))

    return count(F.col(text))


def token_counts(docs: DataFrame, path: str, limit: int = 1024, most: int = TIER_ROWS, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of each document."""
    n = docs.select(F.col(id_column), F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_bytes"), counter(docs, path, most, text).alias("n_tokens"))
    return n.withColumn("over_limit", F.col("n_tokens") > limit)
