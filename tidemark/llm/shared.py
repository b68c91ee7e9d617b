"""What the text operators share: written tables that cut lineage, joins with a checked broadcast, row keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources import scratch

#: A side of a join is broadcast if its rows times their width are known to stay under this many bytes.
BROADCAST_BYTES = 32 << 20
#: Text that a Python worker takes at once from a batch: what it makes of it is many times larger.
SLICE_BYTES = 2 << 20


class Written:
    """A table written to the folder that driver and executors share: `df` reads it, `drop()` deletes it; what is left goes when the JVM ends."""

    kept: list[Written] = []

    def __init__(self, df: DataFrame):
        spark = df.sparkSession
        self.path = scratch.folder(spark)
        jvm = spark.sparkContext._jvm
        self._at = jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        df.write.parquet(self.path)
        self.df = spark.read.schema(df.schema).parquet(self.path)
        Written.kept.append(self)

    def drop(self) -> None:
        self._fs.delete(self._at, True)
        Written.kept = [t for t in Written.kept if t is not self]

    @staticmethod
    def drop_all(before: list[Written], but: Written) -> None:
        """Drops the tables written since `before` was Written.kept, but one."""
        for table in Written.kept:
            if table is not but and table not in before:
                table.drop()


def small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """df with a broadcast hint if `rows` rows of `row_bytes` bytes stay under BROADCAST_BYTES, else df: then Spark shuffles."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about `most` bytes of the column, at least one row each."""
    till = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(till, (till[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, end - at)
        at = end


def held_out(column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5, is 0; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 5 == 0
