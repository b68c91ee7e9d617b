"""Resharding by minimum-cost flow.

The rows of each old shard are put in order, largest first, and cut into blocks of rows of about one size. The flow
leads from the blocks to the new shards, each of which takes the equal share of rows or one more; which of them take
one more is left to the flow. Staying costs nothing, moving a row costs its bytes. The plan is found on the blocks
alone (old shards times size classes, whatever the corpus holds), by successive shortest paths. A block where a shard's
stay may end is cut at that row, so the row's own bytes decide, and as the order is by size a shard that gives rows away
gives its smallest: no other plan with such counts moves fewer bytes. Only shards that get or lose rows are rewritten.

A null text has no bytes. Rows of one size are numbered by checksum of the text and id, so equal texts of one old shard
follow each other as far as one task numbers them, equal rows and null ids each get their own place; a null old shard
is a shard of its own. A very long text is one row like others. An empty table gives an empty result. The input's
columns travel in a struct: no names clash.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import SALT_ROWS
from .shared import Written, small


class Flow:
    """Minimum-cost flow by successive shortest paths, with potentials."""

    def __init__(self, nodes: int):
        self.arcs: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def arc(self, a: int, b: int, room: int, cost: int) -> int:
        """The number of a new arc; what flows through it is the room of the next number."""
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.arcs[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def run(self, source: int, sink: int) -> int:
        """Sends as much as goes from source to sink; the cost."""
        potential, total = [0] * len(self.arcs), 0
        while True:
            far: list[float] = [float("inf")] * len(self.arcs)
            by = [-1] * len(self.arcs)
            far[source], heap = 0, [(0, source)]
            while heap:
                d, v = heapq.heappop(heap)
                if d > far[v]:
                    continue
                for k in self.arcs[v]:
                    if self.room[k] and (e := d + self.cost[k] + potential[v] - potential[self.to[k]]) < far[self.to[k]]:
                        far[self.to[k]], by[self.to[k]] = e, k
                        heapq.heappush(heap, (e, self.to[k]))
            if by[sink] < 0:
                return total
            potential = [p + (d if d < float("inf") else 0) for p, d in zip(potential, far, strict=True)]
            path, v = [], sink
            while v != source:
                path.append(by[v])
                v = self.to[by[v] ^ 1]
            n = min(self.room[k] for k in path)
            for k in path:
                self.room[k] -= n
                self.room[k ^ 1] += n
                total += n * self.cost[k]


def split_blocks(blocks: list[tuple[int | None, int, int, int]], marginal: list[tuple[int, int, int]]) -> list[tuple[int | None, int, int, int]]:
    """blocks (old shard, first rank, rows, bytes), cut around the rows (old shard, rank, bytes) at whose rank a stay may end."""
    at = {(old, rank): size for old, rank, size in marginal}
    ranks = {old: rank for old, rank, _ in marginal}
    out = []
    for old, first, n, size in blocks:
        rank = ranks.get(old, -1)
        if not first <= rank < first + n:
            out.append((old, first, n, size))
            continue
        own = at[old, rank]
        # the others of the block keep its mean, but no row before the cut is smaller than the one there, none behind larger
        before, behind = rank - first, first + n - rank - 1
        mean = (size - own) / max(n - 1, 1)
        out += [(old, first, before, round(before * max(mean, own)))] * bool(before)
        out.append((old, rank, 1, own))
        out += [(old, rank + 1, behind, int(behind * min(mean, own)))] * bool(behind)
    return out


def transfers(blocks: list[tuple[int | None, int, int, int]], shards: int) -> list[tuple[int | None, int, int, int, int]]:
    """blocks (old shard, first rank, rows, bytes), a shard's in order -> rows (old shard, first rank, end rank, shard, first slot)."""
    n = sum(b[2] for b in blocks)
    even, more = divmod(n, shards)
    first_shard = len(blocks)
    source, sink, pool, spare = (first_shard + shards + i for i in range(4))
    flow = Flow(first_shard + shards + 4)
    stay, move = [], []
    for i, (old, _, rows, size) in enumerate(blocks):
        flow.arc(source, i, rows, 0)
        stay.append(flow.arc(i, first_shard + old, rows, 0) if old is not None and 0 <= old < shards else None)
        move.append(flow.arc(i, pool, rows, -(-size // max(rows, 1))))
    into = [flow.arc(pool, first_shard + s, even + 1, 0) for s in range(shards)]
    for s in range(shards):
        flow.arc(first_shard + s, sink, even, 0)
        flow.arc(first_shard + s, spare, 1, 0)
    flow.arc(spare, sink, more, 0)
    flow.run(source, sink)
    slots, out, open_ = [0] * shards, [], [flow.room[k + 1] for k in into]
    target = 0
    for i, (old, rank, *_) in enumerate(blocks):
        count = flow.room[stay[i] + 1] if stay[i] is not None else 0
        if count:
            out.append((old, rank, rank + count, old, slots[old]))
            slots[old] += count
            rank += count
        left = flow.room[move[i] + 1]
        while left:
            while not open_[target]:
                target += 1
            count = min(left, open_[target])
            out.append((old, rank, rank + count, target, slots[target]))
            slots[target] += count
            open_[target] -= count
            rank += count
            left -= count
    return out


def ranked(rows: DataFrame, salt_rows: int = SALT_ROWS) -> tuple[DataFrame, DataFrame]:
    """rows (a written table) with _rank from 0 in their old shard, largest first; and the histogram (old_shard, size, n, base) below it.

    Only the histogram is put in order as a whole. The rows of one size are numbered by checksum and id in about
    `salt_rows` a task, however many there are.
    """
    counts = rows.groupBy("old_shard", "size").agg(F.count("*").alias("n"))
    till = F.sum("n").over(Window.partitionBy("old_shard").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1))
    histogram = Written(counts.withColumn("base", F.coalesce(till, F.lit(0)))).df
    of = histogram.select(F.col("old_shard").alias("_old"), F.col("size").alias("_size"), F.col("n").alias("_n"), F.col("base").alias("_base"))
    salts = F.ceil(F.col("_n") / salt_rows)
    same = F.col("old_shard").eqNullSafe(F.col("_old")) & (F.col("size") == F.col("_size"))
    # rows of a size are split by their checksum; a group of equal texts that is larger than that, by id too
    own = F.when(F.col("_n") > salt_rows, F.xxhash64("text_crc32", "doc_id")).otherwise(F.lit(0).cast("long"))
    salted = rows.join(small(of, histogram.count(), 40), same).withColumn("_salt", F.pmod(own, salts).cast("int"))
    parts = salted.groupBy("_old", "_size", "_salt").agg(F.count("*").alias("_m"))
    ahead = F.sum("_m").over(Window.partitionBy("_old", "_size").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))
    ahead = parts.select(F.col("_old").alias("_o"), F.col("_size").alias("_z"), F.col("_salt").alias("_s"), F.coalesce(ahead, F.lit(0)).alias("_ahead"))
    row = F.row_number().over(Window.partitionBy("_old", "_size", "_salt").orderBy("text_crc32", "doc_id")) - 1
    met = F.col("_old").eqNullSafe(F.col("_o")) & (F.col("_size") == F.col("_z")) & (F.col("_salt") == F.col("_s"))
    numbered = salted.withColumn("_row", row).join(ahead, met)
    return numbered.select(*rows.columns, (F.col("_base") + F.col("_ahead") + F.col("_row")).alias("_rank")), histogram


def reshard(docs: DataFrame, old: Column, shards: int, keep: list[str] | None = None, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(row: the columns `keep`, all by default; doc_id, size, text_crc32, old_shard, shard, slot): row counts at most one apart, the fewest bytes move."""
    own = F.coalesce(F.col(text), F.lit("")).cast("binary")
    size = (F.length(own) + 1).cast("long")
    given = docs.select(F.struct(*(keep or docs.columns)).alias("row"), F.col(id_column).alias("doc_id"), size.alias("size"), F.crc32(own).alias("text_crc32"), old.cast("int").alias("old_shard"))
    placed, histogram = ranked(Written(given).df)
    # size classes: eight for each power of two
    e = "greatest(0, length(bin(size)) - 4)"
    classes = histogram.withColumn("class", F.expr(f"8 * {e} + shiftright(size, {e})"))
    sums = [F.min("base"), F.sum("n"), F.sum(F.col("n") * F.col("size"))]
    blocks = [tuple(r[c] for c in (0, 2, 3, 4)) for r in classes.groupBy("old_shard", "class").agg(*sums).collect()]
    blocks.sort(key=lambda b: (b[0] is None, b[0] or 0, b[1]))
    even = sum(b[2] for b in blocks) // shards
    ends = histogram.where(f"old_shard >= 0 and old_shard < {shards} and base <= {even} and {even} < base + n")
    marginal = [(r["old_shard"], even, r["size"]) for r in ends.collect()]
    spark = docs.sparkSession
    plan = F.broadcast(spark.createDataFrame(transfers(split_blocks(blocks, marginal), shards), "_of int, _lo long, _hi long, shard int, _slot long"))
    moved = placed.join(plan, F.col("old_shard").eqNullSafe(F.col("_of")) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi")))
    return moved.select("row", "doc_id", "size", "text_crc32", "old_shard", "shard", (F.col("_slot") + F.col("_rank") - F.col("_lo")).alias("slot"))


def rewrite(placed: DataFrame, path: str) -> list[int]:
    """Writes the shards that got or lost rows, each as a folder shard=n of path, and deletes those that are no more; the others' folders stay. Their numbers."""
    moved = placed.where(~F.col("old_shard").eqNullSafe(F.col("shard")))
    changed = sorted({r[0] for r in moved.select("shard").union(moved.select("old_shard")).distinct().collect() if r[0] is not None})
    alive = placed.where(F.col("shard").isin(changed))
    alive.select("row.*", "shard").write.partitionBy("shard").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    spark = placed.sparkSession
    held = {r[0] for r in placed.select("shard").distinct().collect()}
    for gone in (s for s in changed if s not in held):
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/shard={gone}")
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    return changed
