"""Reproducible shuffle into shards by a Feistel permutation of global row numbers (operator 3).

Every row gets a number from 0 to n - 1 that depends on the rows alone, not on how they are stored. A Feistel network over
pairs (left, right) with left below ``a`` and right below ``b`` permutes 0 .. a * b - 1, the least such grid that holds n;
numbers that land on n or above walk on along their cycle until they are below n, so 0 .. n - 1 is permuted too. The
permuted number gives the shard (remainder) and the slot (quotient): anyone can compute them from a row number and n.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatloom.llm.common import cut

#: Hash buckets in which rows are numbered; the table of their counts is the only thing that is broadcast.
BUCKETS = 8192
ROUNDS = 8
#: Steps of a cycle walk in one expression. Below 1,000 rows fewer numbers than that are out of range; above, one step
#: leaves the range with a chance below 1 in 30, so a longer walk has a chance below 1e-59 (and stops the query).
WALK = 40


def grid(n: int) -> tuple[int, int]:
    """The sides of the least grid near a square that holds n numbers."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def _div(x: Column, by: int) -> Column:
    """Whole quotient of two numbers that are not negative."""
    return F.call_function("div", x, F.lit(by).cast("long"))


def permuted(number: Column, n: int, seed: int) -> Column:
    """The place of a row number (0 to n - 1) in the shuffled order, as an expression."""
    a, b = grid(n)

    def turn(x: Column) -> Column:
        # The halves go from round to round as one struct: each round is computed once.
        start = F.struct(_div(x, b).alias("l"), F.pmod(x, F.lit(b)).cast("long").alias("r"))

        def step(s: Column, i: Column) -> Column:
            left = F.when(F.pmod(i, F.lit(2)) == 0, F.pmod(s["l"] + F.pmod(F.xxhash64(F.lit(seed).cast("long"), i, s["r"]), F.lit(a)), F.lit(a))).otherwise(s["l"])
            right = F.when(F.pmod(i, F.lit(2)) == 1, F.pmod(s["r"] + F.pmod(F.xxhash64(F.lit(seed).cast("long"), i, s["l"]), F.lit(b)), F.lit(b))).otherwise(s["r"])
            return F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: s["l"] * F.lit(b) + s["r"])

    found = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), F.struct(turn(number).alias("x")), lambda s, _: F.struct(F.when(s["x"] < n, s["x"]).otherwise(turn(s["x"])).alias("x")), lambda s: s["x"])
    return F.when(found < n, found).otherwise(F.raise_error(F.lit("a cycle walk was too long: choose another seed")).cast("long"))


def shard(docs: DataFrame, shards: int, seed: int = 20) -> DataFrame:
    """Deal all rows out to ``shards`` shards in a shuffled order; counts differ by one at most.

    Returns doc_id, size (UTF-8 bytes of the text plus 1), text_crc32, row_number, place, shard, slot (gapless from 0 in
    each shard). Rows are numbered by a hash bucket of doc_id and text, then by doc_id, crc and size; the texts are read
    once, and what is shuffled is a few numbers a row. Equal texts are dealt like any others: the law of this method is
    on row counts, and the place depends on the row number alone.

    Null text: no bytes, so size 1 and crc32 0. Null doc_id: numbered like any other value. Repeated rows: each gets a
    place of its own, whole copies in either order. Empty table: no rows. Other columns are not read.
    """
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(raw) + F.lit(1)).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    rows = cut(rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(BUCKETS)).cast("int")), "shard-rows")
    counts = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    # At most BUCKETS rows, whatever the input: one task may order them, and they may be broadcast.
    before = counts.select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("before"))
    n = rows.count()
    order = Window.partitionBy("bucket").orderBy("doc_id", "text_crc32", "size")
    numbered = rows.withColumn("within", F.row_number().over(order)).join(F.broadcast(before), "bucket")
    numbered = numbered.withColumn("row_number", (F.col("before") + F.col("within") - F.lit(1)).cast("long"))
    placed = numbered.withColumn("place", permuted(F.col("row_number"), n, seed))
    k = F.lit(int(shards)).cast("long")
    return placed.select("doc_id", "size", "text_crc32", "row_number", "place", F.pmod("place", k).cast("int").alias("shard"), _div(F.col("place"), int(shards)).alias("slot"))
