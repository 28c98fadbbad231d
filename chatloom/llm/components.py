"""Connected components of a table of links, by rounds of joins with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.llm.common import cut


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node reachable over ``links``. Nodes without a link are not in it.

    Each round takes the least root among a node and its neighbours, then the root of that root; paths halve, so the rounds
    grow with the logarithm of the longest path. Each round is written out, so a lost executor costs one round at most.
    """
    edges = links.select(F.col(a).alias("node"), F.col(b).alias("other"))
    edges = cut(edges.union(edges.select("other", "node")).where("node <> other").distinct(), "edges")
    roots = cut(edges.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("root")), "roots")
    while True:
        seen = edges.join(roots.select(F.col("node").alias("other"), "root"), "other").groupBy("node").agg(F.min("root").alias("near"))
        lower = roots.join(seen, "node").select("node", "root", F.least("root", "near").alias("low"))
        above = roots.select(F.col("node").alias("low"), F.col("root").alias("jump"))
        new = cut(lower.join(above, "low", "left").select("node", F.col("root").alias("old"), F.least("low", F.coalesce("jump", "low")).alias("root")), "roots")
        if not new.where("root <> old").limit(1).count():
            return new.select("node", "root")
        roots = new.select("node", "root")
