"""Distributed numbering of the rows of groups: salted, so a group of any size is numbered by many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one task sorts at most, about.
SALT_ROWS = 50_000


def group_ranks(df: DataFrame, group: str, order: list[str], rows: int, rank: str = "rank", salt_rows: int = SALT_ROWS) -> DataFrame:
    """df (a written table: it is read twice) with the number, from 0, of each row in its group, gapless.

    A row's salt is a hash of `order`; only the counts of (group, salt) are summed up in order, at most one row for
    each salt and group. rows: those of df. Ties in `order` are numbered in any order.
    """
    salts = max(1, -(-rows // salt_rows))
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    counts = salted.groupBy(group, "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(group, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    numbered = salted.withColumn("_row", F.row_number().over(Window.partitionBy(group, "_salt").orderBy(*order)) - 1)
    base = base.withColumnsRenamed({group: "_group", "_salt": "_of"})
    joined = numbered.join(base, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_salt") == F.col("_of")))
    return joined.select(*df.columns, (F.col("_base") + F.col("_row")).alias(rank))
