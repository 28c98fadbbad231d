"""Numbering rows of a group without gathering the group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatloom.storage import written


def dense_positions(df: DataFrame, group: str, pos: str, span: int = 4096) -> DataFrame:
    """``df`` with ``_i``, each row's number from 0 within its group in the order of ``pos``, and ``_n``, the group's rows.

    Rows are numbered within blocks of ``span`` positions; where a block begins is summed over the blocks' counts, which are
    fewer by that factor.
    """
    blocks = df.groupBy(group, F.floor(F.col(pos) / span).alias("_block")).agg(F.count(F.lit(1)).alias("_rows"))
    order = Window.partitionBy(group).orderBy("_block")
    before = blocks.select(F.col(group).alias("_g"), F.col("_block").alias("_k"), (F.sum("_rows").over(order) - F.col("_rows")).alias("_before"), F.sum("_rows").over(Window.partitionBy(group)).alias("_n"))
    rows = df.withColumn("_block", F.floor(F.col(pos) / span))
    within = F.row_number().over(Window.partitionBy(group, "_block").orderBy(pos)) - 1
    joined = rows.withColumn("_within", within).join(before, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_block") == F.col("_k")))
    return joined.withColumn("_i", F.col("_before") + F.col("_within")).select(*df.columns, "_i", "_n")


def ranked_positions(df: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """``df`` with ``_i``, each row's number from 0 within its group in this order, whatever the order's types.

    Rows are sorted by ranges of (group, order), found by sampling, so a large group is many tasks' work; where each range of
    a group begins is summed over the ranges, of which there are as many as shuffle partitions.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, group, *order).sortWithinPartitions(group, *order).withColumn("_m", F.monotonically_increasing_id())
    ranged = written(ranged.withColumn("_p", F.shiftright("_m", 33)))
    counts = ranged.groupBy(F.col(group).alias("_g"), F.col("_p").alias("_q")).agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy("_g").orderBy("_q")) - F.col("_n")
    begins = counts.select("_g", "_q", (before - F.col("_first")).alias("_shift"))
    joined = ranged.join(begins, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_p") == F.col("_q")))
    return joined.select(*df.columns, (F.col("_m") + F.col("_shift")).alias("_i"))


def one_of(x: Column, values: tuple[str, ...]) -> Column:
    """The value if it is among these, else null."""
    return F.when(x.isin(*values), x)
