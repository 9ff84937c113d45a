"""Connected components by alternating large-star and small-star rounds.

Each round is a handful of joins and aggregates whose result is written to the shared folder, so lineage stays short and nothing is collected. A hub's neighbours meet only in aggregates with partial sums and in sort-merge joins, which AQE may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlake.llm.common import stage, unstage


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges`` (u, v of one ordered type; loops and repeats allowed) -> (node, root): every node of an edge that joins two nodes, with the least node reachable.

    No edges: no rows. Raises if ``max_rounds`` do not suffice (they halve path lengths, so 60 is beyond any real graph).
    """
    spark = edges.sparkSession
    now = stage(edges.filter("u <> v").select("u", "v"), "edges")
    mark = None
    for _ in range(max_rounds):
        then, now = now, stage(_small_star(_large_star(now)), "stars")
        unstage(spark, then)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == mark or state[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        mark = state
    raise RuntimeError("components did not settle")
