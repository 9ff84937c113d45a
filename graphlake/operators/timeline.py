"""Commits, snapshots and what changed between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400
WEEKLY, MONTHLY = 7 * DAY, 30 * DAY


def every(commits: DataFrame, n: int, repo: str = "repo") -> DataFrame:
    """The first of every ``n`` commits (repo, ts, seq)."""
    at = F.row_number().over(Window.partitionBy(repo).orderBy("ts", "seq"))
    return commits.withColumn("__n", at).filter((F.col("__n") - 1) % n == 0).drop("__n")


def tagged(commits: DataFrame) -> DataFrame:
    return commits.filter(F.exists("refs", lambda r: r.rlike("tag: (v|release)")))


def periodic(commits: DataFrame, interval: int, repo: str = "repo") -> DataFrame:
    """Greedy by time: a commit is kept when ``interval`` seconds have gone since the last kept one (at first, since 0); the last commit always is.

    What is kept depends on what was kept before, so each repository's times are folded in order.
    """
    rows = commits.groupBy(repo).agg(F.array_sort(F.collect_list(F.struct("ts", "seq"))).alias("r"))
    first = F.struct(F.lit(0).cast("long").alias("last"), F.array().cast("array<struct<ts:bigint,seq:bigint>>").alias("kept"))
    step = lambda s, c: F.when(c["ts"] - s["last"] >= interval, F.struct(c["ts"].alias("last"), F.concat(s["kept"], F.array(F.struct(c["ts"].alias("ts"), c["seq"].cast("long").alias("seq")))).alias("kept"))).otherwise(s)
    kept = F.aggregate("r", first, step, lambda s: s["kept"])
    end = F.element_at("r", -1)
    all_kept = F.array_distinct(F.concat(kept, F.array(F.struct(end["ts"].alias("ts"), end["seq"].cast("long").alias("seq")))))
    return commits.join(rows.select(repo, F.explode(all_kept).alias("k")).select(repo, F.col("k.seq").alias("seq")), [repo, "seq"], "left_semi")


def adaptive(commits: DataFrame, repo: str = "repo") -> DataFrame:
    return periodic(commits, MONTHLY, repo).unionByName(tagged(commits)).dropDuplicates([repo, "seq"])


def with_previous(commits: DataFrame, cached: DataFrame, repo: str = "repo") -> DataFrame:
    """Each commit with the commit before it, if a snapshot of that one is cached (repo, hash)."""
    before = commits.withColumn("previous", F.lag("hash").over(Window.partitionBy(repo).orderBy("ts", "seq")))
    known = cached.select(repo, F.col("hash").alias("previous"), F.lit(True).alias("__there")).distinct()
    return before.join(known, [repo, "previous"], "left").withColumn("previous", F.when(F.col("__there"), F.col("previous"))).drop("__there")


def trends(metrics: DataFrame, repo: str = "repo", *columns: str) -> DataFrame:
    at = Window.partitionBy(repo).orderBy("ts")
    return metrics.select("*", *[(F.col(c) - F.lag(c).over(at)).alias(f"{c}_change") for c in columns])


def churn(file_commits: DataFrame, now: object, window: str = "interval 6 months") -> DataFrame:
    """(file, commits) since ``window`` before ``now``."""
    return file_commits.filter(F.col("ts") >= F.lit(now) - F.expr(window)).groupBy("file").agg(F.count("*").alias("commits"))


def node_diff(older: DataFrame, newer: DataFrame, key: str = "id") -> DataFrame:
    """(key, change): added, removed, or modified, which every common key is."""
    a, b = older.select(key).distinct().withColumn("a", F.lit(1)), newer.select(key).distinct().withColumn("b", F.lit(1))
    return a.join(b, key, "full_outer").select(key, F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("modified").alias("change"))


def edge_diff(older: DataFrame, newer: DataFrame, *key: str) -> DataFrame:
    """Edges of one side only; repeats stay."""
    added = newer.join(older.select(*key).distinct(), list(key), "left_anti").withColumn("change", F.lit("added"))
    removed = older.join(newer.select(*key).distinct(), list(key), "left_anti").withColumn("change", F.lit("removed"))
    return added.unionByName(removed)


def issue_diff(older: DataFrame, newer: DataFrame) -> DataFrame:
    """Introduced and resolved issues; file and title tell them apart, lines don't."""
    new = newer.join(older.select("file", "title").distinct(), ["file", "title"], "left_anti").withColumn("change", F.lit("introduced"))
    old = older.join(newer.select("file", "title").distinct(), ["file", "title"], "left_anti").withColumn("change", F.lit("resolved"))
    return new.unionByName(old)


def module_health(older: DataFrame | None, newer: DataFrame) -> DataFrame:
    """newer, older (module, loc, issues) -> growth, stability, health."""
    old = (older if older is not None else newer.limit(0)).select("module", F.col("loc").alias("old_loc"), F.col("issues").alias("old_issues"))
    worse = F.greatest(F.lit(0), F.col("issues") - F.col("old_issues")) * 10
    growth = F.when(F.lit(older is None), F.lit(0)).otherwise(F.col("loc") - F.coalesce("old_loc", F.lit(0)))
    return newer.join(old, "module", "left").select("module", growth.alias("growth"), F.greatest(F.lit(0), F.least(F.lit(100), 100 - F.coalesce(worse, F.lit(0)))).alias("stability"), F.greatest(F.lit(0), 100 - F.col("issues") * 5).alias("health"))


def events(symbols: DataFrame, files: DataFrame, edges: DataFrame) -> DataFrame:
    """Diffs with their change column -> (category, subject, n)."""
    row = lambda df, category: df.select(F.lit(category).alias("category"), "subject", F.col("n").cast("long").alias("n"))
    api = symbols.filter((F.col("change") == "added") & ((F.col("kind") == "interface") | F.contains(F.lower("name"), F.lit("api")))).agg(F.lit("").alias("subject"), F.count("*").alias("n")).filter("n > 0")
    new = files.filter("change = 'added'").groupBy(F.get(F.split("id", "/"), F.lit(0)).alias("subject")).agg(F.count("*").alias("n"))
    both = files.agg(F.lit("").alias("subject"), F.count_if(F.col("change") == "removed").alias("n"), F.count_if(F.col("change") == "added").alias("added")).filter("n > 5 and added > 0")
    imports = edges.filter("change = 'added'").agg(F.lit("").alias("subject"), F.count("*").alias("n")).filter("n > 10")
    return row(api, "API_CHANGED").unionByName(row(new, "MODULE_EXTRACTED")).unionByName(row(both, "REFACTOR")).unionByName(row(imports, "DEPENDENCY_ADDED"))


def baseline(files: DataFrame) -> DataFrame:
    """The one event of a first snapshot."""
    return files.agg(F.lit("FEATURE_INTRODUCED").alias("category"), F.lit("").alias("subject"), F.count("*").alias("n"))
