"""Near-duplicates: fast similarity sketches, banding, exact verification, connected components.

Sketch. The 64-bit hashes of a document's word shingles are thrown into `coordinates` bins for as many rounds as it
takes; a coordinate keeps the first, then smallest, value that falls on it. Rounds 1..t place by hash, rounds
t+1..2t hit one bin each, so every coordinate fills, and the estimate is concentrated as if the coordinates were
independent. Documents with the same set are one node from here on.

Banding. Two nodes are candidates if all `rows` coordinates of one of the bands agree. A pair at the threshold is
missed with probability (1 - 0.8^5)^32 < 3e-6; one that is more alike with less.

Buckets of any size. A bucket's pairs aren't listed. A node's score is the size of all its buckets together: the middle
of a group of copies has the highest. Every node is compared with the node of the highest score in each of its
buckets; nodes that are linked share a label. Pairs whose sizes are too far apart for the threshold aren't verified, nor, in
buckets of three or more, those whose sketches (four bits of each of the 160 coordinates) are by five standard
deviations. Buckets of three or more that still hold different labels go on, whatever was left out before: their nodes without the most frequent label are compared, by an inverted index of the full sets, with all
nodes of other labels. The two sides are cut into blocks of at most BLOCK shingles, about, so any number of tasks
shares a large bucket, and each node gives one link for each label it meets. No pair whose outcome matters is left out.

Verification. The full sets of both sides are recomputed from the texts and intersected.

Null text, or text without a word: no shingles, linked with nothing. Very long texts are shingled whole, one at a time.
Rows that share an id are one document, linked
with whatever any of them is linked with. A null id is linked with nothing: its component is null and it is kept.
An empty table gives an empty result. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import components
from .shared import Written, slices, small

COORDINATES, BAND_ROWS = 160, 5
#: Of 160 four-bit coordinates a pair at similarity 0.8 differs in 30, with a deviation of 4.9.
MOST_APART = 55
#: Shingles of one side of a block of nodes.
BLOCK = 500_000
_SIG = [f"g{i}" for i in range(COORDINATES // 16)]

_rng = np.random.default_rng(8_128)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = np.uint64(_rng.integers(1, 1 << 62) * 2 + 1)
_ROUND = _rng.integers(1, 1 << 63, 4 * COORDINATES, dtype=np.uint64)
_WORD = _rng.integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = np.ones(1, dtype=np.uint64)
_INVERSE = np.ones(1, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads each bit over all 64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _grow(n: int) -> None:
    global _POWERS, _INVERSE
    if len(_POWERS) < n:
        size = max(n, 1 << 16, 2 * len(_POWERS) if n < 1 << 24 else n)
        for name, base in (("_POWERS", int(_BASE)), ("_INVERSE", pow(int(_BASE), -1, 1 << 64))):
            x = np.full(size, base, dtype=np.uint64)
            x[0] = 1
            globals()[name] = np.multiply.accumulate(x)


def word_hashes(text: bytes) -> np.ndarray:
    """Hashes of the words [^\\x20\\x09-\\x0D]+ in order, A-Z lower-cased."""
    data = np.frombuffer(text, dtype=np.uint8)
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    word = ~((data == 32) | (data >= 9) & (data <= 13))
    edge = np.diff(word.view(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    _grow(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * _POWERS[: len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * _INVERSE[starts] + (ends - starts).astype(np.uint64))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles of `size` words; fewer words are one shingle, none are none."""
    words = word_hashes((text or "").encode())
    if not len(words):
        return words
    n = max(1, len(words) - size + 1)
    out = np.full(n, len(words) if len(words) < size else size, dtype=np.uint64)
    for k in range(min(size, len(words))):
        out += words[k : k + n] * _WORD[k]
    return np.unique(mixed(out))


def sketch(shingles: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """t values: round number above, hash below; the smallest that falls on each coordinate. shingles aren't empty."""
    out = np.full(t, np.iinfo(np.uint64).max, dtype=np.uint64)
    low, top = np.uint64((1 << 48) - 1), np.uint64(48)
    first, at_once = 0, max(1, 4 * t // len(shingles))
    while first < t:
        rounds = np.arange(first, min(t, first + at_once))
        x = mixed(shingles[None, :] ^ _ROUND[rounds][:, None])
        bins = ((x >> top) * np.uint64(t)) >> np.uint64(16)
        value = (rounds.astype(np.uint64)[:, None] << top) | (x & low)
        np.minimum.at(out, bins.ravel().astype(np.int64), value.ravel())
        if out.max() < np.uint64(first + len(rounds)) << top:
            return out
        first += len(rounds)
    empty = np.flatnonzero(out == np.iinfo(np.uint64).max)
    for part in np.array_split(empty, -(-len(empty) * len(shingles) // 100_000)) if len(empty) else []:
        x = mixed(shingles[None, :] ^ _ROUND[t + part][:, None]) & low
        out[part] = ((t + part).astype(np.uint64) << top) | x.min(axis=1)
    return out


def digest(text: str | None, size: int) -> tuple | None:
    """(set size, key of the set, band hashes, sketch: four bits of each coordinate), or None without a word."""
    own = shingle_set(text, size)
    if not len(own):
        return None
    s = mixed(sketch(own))
    bands = s.reshape(-1, BAND_ROWS)
    keys = mixed((bands * _WORD[:BAND_ROWS]).sum(axis=1, dtype=np.uint64) + np.arange(len(bands), dtype=np.uint64) * _WORD[60])
    low = (s & np.uint64(15)).astype(np.uint8).reshape(-1, 2)
    return len(own), hashlib.blake2b(own.tobytes(), digest_size=16).digest(), keys.view(np.int64).tolist(), (low[:, 0] << 4 | low[:, 1]).view(np.int64).tolist()


_DIGEST = [T.StructField("n_shingles", T.LongType()), T.StructField("set_key", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType(), False)), T.StructField("sig", T.ArrayType(T.LongType(), False))]


def digests(docs: DataFrame, size: int, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, set_key, bands, sig) of each row; key and below null without a word."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), *_DIGEST])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        for batch in (part for whole in batches for part in slices(whole, 1)):
            rows = [digest(x, size) or (0, None, None, None) for x in batch.column(1).to_pylist()]
            columns = zip(*rows, strict=True) if rows else [()] * 4
            yield pa.record_batch([batch.column(0), *(pa.array(list(c), kind) for c, kind in zip(columns, kinds, strict=True))], names=schema.names)

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text)).mapInArrow(run, schema)


def sets_of(ids: DataFrame, docs: DataFrame, size: int, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, own: the set's hashes as bytes) of the documents with these ids, from their texts; written."""
    wanted = Written(ids.toDF("_id").distinct()).df
    needed = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("text")).join(small(wanted, wanted.count(), 16), F.col("id") == F.col("_id"), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            yield pa.record_batch([batch.column(0), pa.array([shingle_set(x, size).tobytes() for x in batch.column(1).to_pylist()], pa.binary())], names=["id", "own"])

    return Written(needed.mapInArrow(run, "id long, own binary")).df


def verified(pairs: Written, docs: DataFrame, size: int, part: int, whole: int, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The pairs (a, b) whose full sets have part * union <= whole * intersection."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) else 0
                keep.append(both > 0 and whole * both >= part * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    own = sets_of(pairs.df.select("a").union(pairs.df.select("b")), docs, size, id_column, text)
    left, right = own.withColumnsRenamed({"id": "a", "own": "x"}), own.withColumnsRenamed({"id": "b", "own": "y"})
    return pairs.df.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(compare, "a long, b long").distinct()


def block_links(rows: list[tuple[bool, int, int, bytes]], part: int, whole: int) -> list[tuple[int, int]]:
    """Links (a, b) of rows (whether it is of the compared side, node, label, set) to rows of the other side: one for each label met."""
    sets = [np.frombuffer(r[3], dtype=np.uint64) for r in rows]
    label, node = np.array([r[2] for r in rows]), np.array([r[1] for r in rows])
    there = np.flatnonzero([not r[0] for r in rows])
    if not len(there):
        return []
    size = np.array([len(sets[i]) for i in there])
    flat = np.concatenate([sets[i] for i in there])
    order = np.argsort(flat, kind="stable")
    owner = np.repeat(np.arange(len(there)), size)[order]
    values, first = np.unique(flat[order], return_index=True)
    first = np.append(first, len(flat))
    out = []
    for i in (i for i, r in enumerate(rows) if r[0]):
        at = np.searchsorted(values, sets[i])
        at = at[(at < len(values)) & (values[np.minimum(at, len(values) - 1)] == sets[i])]
        n = first[at + 1] - first[at]
        hits = owner[np.repeat(first[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        both = np.bincount(hits, minlength=len(there))
        linked = (both > 0) & (whole * both >= part * (size + len(sets[i]) - both)) & (label[there] != label[i])
        found = there[linked]
        for k in np.unique(label[found], return_index=True)[1] if len(found) else []:
            out.append((max(int(node[i]), int(node[found[k]])), min(int(node[i]), int(node[found[k]]))))
    return out


def rest_links(open_: DataFrame, docs: DataFrame, size: int, part: int, whole: int, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Links between different labels in the buckets of open_ (key, node, label, n; written)."""
    counts = open_.groupBy("key", "label").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    shape = counts.groupBy("key").agg(F.max(F.struct("c", "label", "s")).alias("most"), F.sum("s").alias("all"))
    blocks = lambda s: F.greatest(F.ceil(s / BLOCK), F.lit(1)).cast("int")
    shape = shape.select("key", F.col("most.label").alias("usual"), blocks(F.col("all")).alias("nm"), blocks(F.col("all") - F.col("most.s")).alias("nl"))
    own = sets_of(open_.select("node"), docs, size, id_column, text)
    known = open_.select("key", "node", "label").join(shape, "key")
    at = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    members = known.select("key", spread("nl").alias("i"), at("nm").alias("j"), F.lit(False).alias("side"), "node", "label")
    others = known.where("label <> usual").select("key", at("nl").alias("i"), spread("nm").alias("j"), F.lit(True).alias("side"), "node", "label")

    def run(table: pa.Table) -> pa.Table:
        rows = list(zip(*(table.column(c).to_pylist() for c in ("side", "node", "label", "own")), strict=True))
        found = block_links(rows, part, whole)
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    joined = members.union(others).join(own.withColumnRenamed("id", "node"), "node")
    return joined.groupBy("key", "i", "j").applyInArrow(run, "a long, b long").distinct()


def _close(part: int, whole: int) -> Column:
    """Of columns m, n, g0.. and h_n, h_g0..: whether the pair can reach the threshold.

    Only the sizes can rule out the pair of a bucket of two, since it is compared once only.
    """
    near = F.lit(0)
    for g in _SIG:
        x = F.col(g).bitwiseXOR(F.col(f"h_{g}"))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        near = near + F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
    return (F.col("n") * whole >= F.col("h_n") * part) & (F.col("h_n") * whole >= F.col("n") * part) & ((F.col("m") == 2) | (near <= MOST_APART))


def _labels(edges: DataFrame) -> Written:
    """(node, label): the same label only in the same component; the nodes of a star all have one."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label"))
    around = both.join(least, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("m"))
    near = around.join(least, F.col("a") == F.col("node")).select("node", F.least("m", "label").alias("label"))
    return Written(near)


def links(nodes: DataFrame, docs: DataFrame, size: int, part: int, whole: int, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Verified links (a, b) between nodes (node, n, sig, bands) that join all nodes of each component."""
    banded = nodes.select(F.explode("bands").alias("key"), "node")
    sizes = banded.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    shared = Written(banded.join(sizes, "key"))
    scores = shared.df.groupBy("node").agg(F.sum("m").alias("score"))
    known = nodes.join(scores, "node").select("node", "score", "n", *(F.col("sig")[i].alias(g) for i, g in enumerate(_SIG)))
    members = Written(shared.df.join(known, "node"))
    shared.drop()
    as_hub = [F.col(c).alias(f"h_{c}") for c in ("n", *_SIG)]
    of_hub = members.df.select("node", "n", *_SIG).distinct().select(F.col("node").alias("hub"), *as_hub)
    hubs = Written(members.df.groupBy("key").agg(F.max(F.struct("score", F.col("node").alias("hub"))).alias("top")))
    met = members.df.join(hubs.df, "key").withColumn("hub", F.col("top.hub")).where("node <> hub")
    pairs = Written(met.join(of_hub, "hub").where(_close(part, whole)).select(F.greatest("node", "hub").alias("a"), F.least("node", "hub").alias("b")).distinct())
    hubs.drop()
    edges = Written(verified(pairs, docs, size, part, whole, id_column, text)).df
    pairs.drop()
    labels = _labels(edges)
    marked = members.df.where("m > 2").select("key", "node", "n").join(labels.df, "node", "left").withColumn("label", F.coalesce("label", "node"))
    unlike = marked.groupBy("key").agg(F.min("label").alias("_lo"), F.max("label").alias("_hi")).where("_lo <> _hi").select("key")
    open_ = Written(marked.join(unlike, "key"))
    members.drop()
    labels.drop()
    rest = Written(rest_links(open_.df, docs, size, part, whole, id_column, text))
    open_.drop()
    return edges.union(rest.df)


def near_duplicates(docs: DataFrame, size: int = 5, part: int = 80, whole: int = 100, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): documents linked if whole * intersection >= part * union of their shingle sets."""
    rows = Written(digests(docs, size, id_column, text)).df
    classes = Written(rows.where("n_shingles > 0 and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))).df
    edges = links(classes.select("node", "n", "sig", "bands"), docs, size, part, whole, id_column, text)
    # rows that share an id tie the classes of their sets together
    same = rows.where("set_key is not null and doc_id is not null").select("doc_id", "set_key").join(classes.select("set_key", "node"), "set_key").where("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    shared = same.join(classes.select(F.col("node").alias("a")).distinct(), "a", "left_semi")
    many = same.join(same.groupBy("a").agg(F.min("b").alias("_lo")), "a").where("b <> _lo").select(F.col("b").alias("a"), F.col("_lo").alias("b"))
    found = components(edges.union(shared).union(many).distinct()).df
    of = classes.select(F.col("set_key").alias("_key"), F.col("node"))
    out = rows.select("doc_id", "n_shingles", "set_key").join(of, F.col("set_key") == F.col("_key"), "left").join(found, "node", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node", "doc_id")).alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
