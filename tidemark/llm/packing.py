"""Best-fit packing of token sequences.

Documents longer than a sequence are cut into full sequences, what is left over comes first. The pieces then go by
decreasing length, each into the open sequence with the least room that still takes it. Pieces of one length are alike
and so are sequences of one history, so the driver plans on the histogram of lengths: a segment tree over the
remaining capacities finds the tightest open class in logarithmic time, and whole runs of equal pieces are placed at
once. The plan is the one that document-by-document best-fit decreasing makes; its size depends on the sequence
length, not on the corpus. A join by length and rank then gives each piece its place.

A null text counts as empty: one end token. A very long text is cut as a whole. Equal rows and equal ids are packed one by one; a null id stays null. An
empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import pretoken
from .ranks import group_ranks
from .shared import Written, slices


class CapacityTree:
    """A segment tree over the capacities 0..size: how many open runs each has, and the least one of at least x."""

    def __init__(self, size: int):
        self._width = 1 << size.bit_length()
        self._n = [0] * (2 * self._width)

    def add(self, capacity: int, n: int) -> None:
        at = capacity + self._width
        while at:
            self._n[at] += n
            at >>= 1

    def tightest(self, least: int) -> int:
        """The smallest capacity of at least `least` that is open, or -1."""
        at = least + self._width
        if self._n[at]:
            return least
        while at > 1:
            if not at & 1 and self._n[at + 1]:
                at += 1
                while at < self._width:
                    at = 2 * at if self._n[2 * at] else 2 * at + 1
                return at - self._width
            at >>= 1
        return -1


def plan(histogram: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, end rank, first sequence, pieces a sequence, offset).

    Piece r of a row's ranks goes to sequence first + (r - first rank) div pieces, behind the ones of that row before it there.
    """
    tree, runs, rows, opened = CapacityTree(size), [[] for _ in range(size + 1)], [], 0
    for length in sorted((x for x, n in histogram.items() if n), reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = tree.tightest(length)
            if room < 0:
                room, each = size, size // length
                first, n = opened, -(-left // each)
                opened += n
            else:
                each = room // length
                first, n = runs[room].pop()
                tree.add(room, -1)
            whole = min(n, left // each)
            # the bins that get `each` pieces, one that gets the rest, and those that stay as they are
            part = left - whole * each if whole < n else 0
            if whole:
                rows.append((length, rank, rank + whole * each, first, each, size - room))
            if part:
                rows.append((length, rank + whole * each, rank + whole * each + part, first + whole, part, size - room))
            for a, k, used in ((first, whole, each), (first + whole, 1 if part else 0, part), (first + whole + bool(part), n - whole - bool(part), 0)):
                if k and (to := room - used * length):
                    runs[to].append((a, k))
                    tree.add(to, 1)
            rank += whole * each + part
            left -= whole * each + part
    return rows


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens."""
    head = n if n <= size else n % size or size
    return [(0, head)] + [(a, size) for a in range(head, n, size)]


_PIECE = T.StructType([T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])


def token_pieces(docs: DataFrame, path: str, size: int, end_id: int = 0, with_ids: bool = True, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, and with_ids the ids) of each piece of each document."""
    given = docs.select(F.col(id_column), F.col(text))
    schema = T.StructType([given.schema[0], *_PIECE.fields, *([T.StructField("ids", T.ArrayType(T.LongType()))] if with_ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, tail = pretoken.encoder(path), np.array([end_id], dtype="<u4")
        for batch in (part for whole in batches for part in slices(whole, 1)):
            of, rows = [], []
            for i, ids in enumerate(enc.ids([x.encode() if x else b"" for x in batch.column(1).to_pylist()])):
                ids = np.concatenate([ids.astype("<u4"), tail])
                for k, (a, n) in enumerate(cut(len(ids), size)):
                    own = ids[a : a + n]
                    of.append(i)
                    rows.append((k, a, n, zlib.crc32(own.tobytes()), own) if with_ids else (k, a, n, zlib.crc32(own.tobytes())))
            columns = list(zip(*rows, strict=True)) if rows else [()] * (4 + with_ids)
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            yield pa.record_batch([batch.column(0).take(pa.array(of, pa.int64())), *(pa.array(list(c), kind) for c, kind in zip(columns, kinds, strict=False))], names=schema.names)

    return given.mapInArrow(run, schema)


def place(pieces: DataFrame, size: int, id_column: str = "doc_id") -> DataFrame:
    """pieces (a written table with piece and length) with sequence_id and offset."""
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `size` rows
    rows = plan(histogram, size)
    spark = pieces.sparkSession
    schema = "_length long, _rank long, _end long, _first long, _each long, _offset long"
    # as many rows as the lengths give, whatever the corpus holds
    steps = F.broadcast(spark.createDataFrame(rows, schema))
    ranked = group_ranks(pieces, "length", [id_column, "piece"], sum(histogram.values()), "_r")
    at = F.col("_r") - F.col("_rank")
    return ranked.join(steps, (F.col("length") == F.col("_length")) & (F.col("_r") >= F.col("_rank")) & (F.col("_r") < F.col("_end"))).select(
        *pieces.columns, (F.col("_first") + F.expr("(_r - _rank) div _each")).alias("sequence_id"), (F.col("_offset") + F.pmod(at, F.col("_each")) * F.col("length")).alias("offset")
    )


def pack(docs: DataFrame, path: str, size: int = 2048, end_id: int = 0, with_ids: bool = False, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of all documents with the sequence and offset of each; tokenizes once and writes the pieces."""
    return place(Written(token_pieces(docs, path, size, end_id, with_ids, id_column, text)).df, size, id_column)
