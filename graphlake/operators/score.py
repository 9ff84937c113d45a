"""Statistics, scores and module graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphlake.config import LIMITS
from graphlake.functions import rules
from graphlake.functions.scalars import clamp, js_round
from graphlake.operators import graph


def dimensions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rules.DIMENSIONS, "dimension string, weight double").coalesce(1)


def language_stats(files: DataFrame) -> DataFrame:
    """files (language, loc, ord) -> (language, files, loc, first): by lines, the first seen first on ties."""
    return files.groupBy("language").agg(F.count("*").alias("files"), F.sum("loc").alias("loc"), F.min("ord").alias("first")).orderBy(F.desc("loc"), "first")


def file_fan_in(links: DataFrame) -> DataFrame:
    """links (source, target), repeats counted, self-links not."""
    return links.filter("source <> target").groupBy(F.col("target").alias("file")).agg(F.count("*").alias("fan_in"))


def graph_stats(files: DataFrame, links: DataFrame) -> DataFrame:
    """One row: files, distinct directories, edges."""
    dirs = F.regexp_replace("file", r"/?[^/]*\z", "")
    return files.agg(F.count("*").alias("files"), F.countDistinct(dirs).alias("dirs")).join(links.agg(F.count("*").alias("edges")))


def dimension_scores(issues: DataFrame, loc: int | float | F.Column) -> DataFrame:
    """issues (dimension, severity, blast) -> a row per dimension, without issues too: penalty, score."""
    loc = loc if isinstance(loc, F.Column) else F.lit(float(loc))
    sums = issues.groupBy("dimension").agg(F.sum(F.col("severity") * F.col("blast")).cast("double").alias("penalty"), F.count("*").alias("issues"))
    size = F.pow(F.log10(F.greatest(loc, F.lit(10.0))), F.lit(2.0))
    penalty = F.coalesce("penalty", F.lit(0.0))
    score = js_round(clamp(100 * F.exp(-0.06 * penalty / F.greatest(F.lit(1.0), size)), 0.0, 100.0))
    joined = F.broadcast(dimensions(issues.sparkSession)).join(sums, "dimension", "left")
    return joined.select("dimension", "weight", F.coalesce("issues", F.lit(0)).alias("issues"), (js_round(penalty * 10) / 10).alias("penalty"), score.cast("long").alias("score"))


def overall_score(scores: DataFrame) -> DataFrame:
    return scores.agg(js_round(F.sum(F.col("score") * F.col("weight"))).cast("long").alias("overall"))


def issues_by_file(issues: DataFrame) -> DataFrame:
    return issues.groupBy("file").agg(F.count("*").alias("issues"), F.max("severity").alias("max_severity"))


def ranked_issues(issues: DataFrame, keep: int = LIMITS.kept_issues) -> DataFrame:
    return issues.orderBy(F.desc(F.col("severity") * F.col("blast")), "ord").limit(keep)


def module_of(files: DataFrame, crowd: int = 12) -> DataFrame:
    """``files`` (file, ...) with module: "(root)", the top directory, or its second level where the top holds over ``crowd`` files."""
    steps = F.split("file", "/")
    out = files.withColumn("__top", F.when(F.size(steps) == 1, "(root)").otherwise(F.get(steps, F.lit(0))))
    sizes = out.groupBy("__top").agg(F.count("*").alias("__n"))
    # Few directories stand against many files, but a crowded one may hold most of them, so the counts are joined, not windowed.
    deep = (F.size(steps) >= 3) & (F.col("__n") > crowd)
    return out.join(sizes, "__top").withColumn("module", F.when(deep, F.concat_ws("/", F.get(steps, F.lit(0)), F.get(steps, F.lit(1)))).otherwise(F.col("__top"))).drop("__top", "__n")


def modules(files: DataFrame) -> DataFrame:
    """files (file, module, language, loc, issues, ord) -> a row per module with its commonest language, the first seen on ties."""
    per = files.groupBy("module", "language").agg(F.count("*").alias("n"), F.min("ord").alias("first"), F.sum("loc").alias("loc"), F.sum("issues").alias("issues"))
    pick = F.max_by("language", F.struct(F.col("n"), -F.col("first")))
    return per.groupBy("module").agg(F.sum("n").alias("files"), F.sum("loc").alias("loc"), F.sum("issues").alias("issues"), pick.alias("language"), F.min("first").alias("first"))


def module_edges(links: DataFrame, files: DataFrame) -> DataFrame:
    """links between files -> (source, target, weight) between different modules."""
    of = files.select("file", "module")
    a = of.withColumnsRenamed({"file": "source", "module": "a"})
    b = of.withColumnsRenamed({"file": "target", "module": "b"})
    both = links.select("source", "target").join(a, "source").join(b, "target").filter("a <> b")
    return both.groupBy(F.col("a").alias("source"), F.col("b").alias("target")).agg(F.count("*").alias("weight"))


def ordered_modules(mods: DataFrame, mod_edges: DataFrame) -> DataFrame:
    """Modules with their tier, the lowest tier first and in it the most lines, the first seen on ties; modules without an edge are in tier 0."""
    tier = graph.tiers(mod_edges.select(F.col("source").alias("src"), F.col("target").alias("dst"))).select(F.col("node").alias("module"), "tier")
    return mods.join(tier, "module", "left").withColumn("tier", F.coalesce("tier", F.lit(0))).orderBy("tier", F.desc("loc"), "first")


def viz_files(files: DataFrame, keep: int = LIMITS.viz_files) -> DataFrame:
    """The files that are shown: all, or the top by fan-in and size."""
    return files.orderBy(F.desc(F.col("fan_in") * 3 + F.col("loc") / 100), "ord").limit(keep)


def containment(files: DataFrame) -> DataFrame:
    """A chain of (parent, child, depth) for each file, repeats kept; the root is "."."""
    steps = F.split("file", "/")
    path = lambda k: F.when(k == 0, ".").otherwise(F.array_join(F.slice(steps, 1, k), "/"))
    chain = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.struct(path(k - 1).alias("parent"), path(k).alias("child"), k.alias("depth")))
    return files.select(F.explode(chain).alias("c")).select("c.*")


def tree(files: DataFrame) -> DataFrame:
    """Distinct nodes with the files, lines and issues below them: (path, parent, depth, files, loc, issues)."""
    steps = F.split("file", "/")
    path = lambda k: F.when(k == 0, ".").otherwise(F.array_join(F.slice(steps, 1, k), "/"))
    up = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda k: F.struct(path(k).alias("path"), F.when(k > 0, path(k - 1)).alias("parent"), k.alias("depth")))
    rows = files.select(F.explode(up).alias("n"), F.greatest(F.lit(1), "loc").alias("loc"), "issues").select("n.*", "loc", "issues")
    return rows.groupBy("path", "parent", "depth").agg(F.count("*").alias("files"), F.sum("loc").alias("loc"), F.sum("issues").alias("issues"))


def degrees(links: DataFrame) -> DataFrame:
    ends = links.select(F.col("source").alias("node")).unionByName(links.select(F.col("target").alias("node")))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def network(nodes: DataFrame, links: DataFrame, most: int = 120, fewest: int = 3, fallback: int = 40) -> DataFrame:
    """The nodes of a network view: linked ones by degree, fan-in and size; the first by the same order if hardly any is linked."""
    ranked = nodes.join(degrees(links), "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    order = [F.desc("degree"), F.desc("fan_in"), F.desc("loc"), "node"]
    linked = ranked.filter("degree > 0")
    return (linked.orderBy(*order).limit(most)) if linked.limit(fewest).count() >= fewest else ranked.orderBy(*order).limit(fallback)


def snapshot_metrics(symbols: DataFrame) -> DataFrame:
    """One row; symbols without a complexity count as 0 in its mean."""
    kind = lambda *k: F.count_if(F.col("kind").isin(*k))
    n = F.greatest(F.count("*"), F.lit(1))
    return symbols.agg(
        F.count("*").alias("symbols"), kind("function", "method", "component").alias("callables"), kind("class").alias("classes"), kind("interface").alias("interfaces"),
        (F.coalesce(F.sum(F.coalesce("complexity", F.lit(0))), F.lit(0)) / n).alias("avg_complexity"), F.coalesce(F.max("complexity"), F.lit(0)).alias("max_complexity"),
        (F.coalesce(F.sum("fan_in"), F.lit(0)) / n).alias("avg_fan_in"), (F.coalesce(F.sum("fan_out"), F.lit(0)) / n).alias("avg_fan_out"), F.count_if(F.col("fan_in") == 0).alias("orphans"),
    )


def architecture_metrics(nodes: DataFrame, edges: DataFrame, mods: DataFrame, mod_edges: DataFrame) -> DataFrame:
    """One row: coupling, cohesion, density, module sizes, mean fan-in and fan-out. nodes (id, fan_in, issues, ord), edges (source, target, kind), repeats counted."""
    e = edges.agg(F.count("*").alias("edges"), F.count_if(F.col("kind") == "imports").alias("imports"))
    n = nodes.agg(F.count("*").alias("nodes"), F.coalesce(F.sum("fan_in"), F.lit(0)).alias("fan_in"))
    fan_out = edges.join(nodes.select(F.col("id").alias("source")), "source", "left_semi").agg(F.count("*").alias("fan_out"))
    m = mods.agg(F.count("*").alias("modules"), F.coalesce(F.avg("loc"), F.lit(0.0)).alias("average_module_size"), F.max_by("module", F.when(F.col("loc") > 0, F.struct("loc", -F.col("first")))).alias("largest"))
    w = mod_edges.agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("between"))
    hot = nodes.filter("issues > 3").orderBy("ord").limit(5).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "id"))), lambda s: s["id"]).alias("hotspots"))
    one = e.join(n).join(fan_out).join(m).join(w).join(hot)  # each side is one row
    coupling = F.least(F.lit(1.0), F.col("between") / F.greatest(F.col("imports"), F.lit(1)))
    size = F.greatest(F.col("nodes"), F.lit(1))
    return one.select(coupling.alias("coupling"), (1 / (coupling + 1)).alias("cohesion"), (F.col("edges") / (size * size)).alias("density"), "average_module_size", F.coalesce("largest", F.lit("None")).alias("largest_module"), (F.col("fan_in") / size).alias("average_fan_in"), (F.col("fan_out") / size).alias("average_fan_out"), "hotspots", F.lit(0).alias("circular_dependencies"), F.lit(0).alias("layer_violations"))


def numbered(issues: DataFrame, *order: str) -> DataFrame:
    """Issue ids by a documented order."""
    return issues.withColumn("id", F.concat(F.lit("iss_"), (F.row_number().over(Window.orderBy(*order)) - 1).cast("string")))
