"""Dependencies between repositories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def links(repos: DataFrame) -> DataFrame:
    """repos (id, name, deps, created_at) -> (source, target, dep): a dependency means the newest other repository of its name, or whose name ends in "/" and it, in either case.

    Each name is spelled out with all of its ends, so the comparison is an equal join.
    """
    steps = F.split(F.lower("name"), "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.array_join(F.slice(steps, F.size(steps) - k + 1, k), "/"))
    names = repos.select(F.col("id").alias("target"), "created_at", F.explode(ends).alias("key"))
    deps = repos.select(F.col("id").alias("source"), F.explode("deps").alias("dep")).withColumn("key", F.lower("dep"))
    hit = deps.join(names, "key").filter("source <> target")
    return hit.groupBy("source", "dep").agg(F.max_by("target", F.struct("created_at", "target")).alias("target")).select("source", "target", "dep")
