"""Imports to files, references to definitions, calls between symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphlake.config import LIMITS
from graphlake.functions import rules
from graphlake.functions.scalars import dirname, normal_path
from graphlake.operators.query import symbol_at
from graphlake.operators.staged import settled, shuffled

#: What is tried after a relative path, in this order.
PROBED = [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".py"]


def resolve_paths(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """wanted (file, path) with target: the file that a relative path means, the first of its spellings that is there; others give no row."""
    plain = normal_path(F.concat_ws("/", F.when(dirname(F.col("file")) != ".", dirname(F.col("file"))), "path"))
    tries = F.array(F.lit(""), *[F.lit(e) for e in PROBED], *[F.lit("/index" + e) for e in PROBED])
    row = wanted.filter(F.startswith("path", F.lit("."))).select("file", "path", plain.alias("plain")).distinct()
    each = row.select("file", "path", F.posexplode(F.transform(tries, lambda t: F.concat("plain", t))).alias("turn", "target"))
    return each.join(shuffled(files.select(F.col("rel").alias("target")).distinct()), "target", "left_semi").groupBy("file", "path").agg(F.min_by("target", "turn").alias("target"))


#: Links from and to so many files of a directory are made in one row's turn.
BLOCK = 1000


def _to_directories(asked: DataFrame, files: DataFrame) -> DataFrame:
    """asked (rel, spec, d), files (d, target) -> (rel, spec, target): each row with all files of its directory.

    Both sides are cut into blocks of about ``BLOCK`` rows of a directory. Pairs of blocks are dealt to tasks by the number of links and make them there, so links, as many as asked times held, are neither shuffled nor left to one task.
    """
    counts = lambda df, n: df.groupBy("d").agg(F.count("*").alias(n))
    held, wanted = counts(files, "held"), counts(asked, "wanted")
    blocks = lambda df, n, key, row: df.join(n, "d").groupBy("d", F.pmod(F.xxhash64(*key), F.ceil(F.col(n.columns[1]) / BLOCK)).alias("block")).agg(F.collect_list(row).alias(n.columns[1]))
    one = settled(blocks(asked.join(held.select("d"), "d", "left_semi"), wanted, ["rel", "spec"], F.struct("rel", "spec")))
    two = settled(blocks(files.join(wanted.select("d"), "d", "left_semi"), held, ["target"], F.col("target")))
    sums = lambda df, n: df.groupBy("d").agg(F.sum(F.size(n).cast("long")).alias(n))
    links = sums(one, "wanted").join(sums(two, "held"), "d").agg(F.sum(F.col("wanted") * F.col("held"))).first()[0] or 0
    tasks = max(1, min(10_000, -(-links // (BLOCK * BLOCK // 2))))
    pairs = one.select("d", "wanted").join(two.select("d", "held"), "d").select("wanted", "held").repartition(tasks)
    return pairs.select(F.explode("wanted").alias("a"), "held").select("a.*", F.explode("held").alias("target"))


def import_graph(files: DataFrame, imports: DataFrame) -> DataFrame:
    """files (rel, ext, ord), imports (rel, spec) -> (source, target, spec), a row per link, self-links not among them.

    Scripts: the path with or without an extension, then its index file; of files that share a path the last scanned counts. Python: dotted names, relative dots, packages by their __init__. Go: the longest suffix of the import path, of up to eight steps, that is a directory of the repository, to all of its Go files.
    """
    named = files.select("rel", "ext", "ord", F.regexp_replace("rel", r"\.[^./]*\z", "").alias("stem"), dirname(F.col("rel")).alias("dir"))
    keys = named.select(F.col("rel").alias("key"), "rel", "ord").unionByName(named.select(F.col("stem").alias("key"), "rel", "ord"))
    keys = keys.groupBy("key").agg(F.max_by("rel", "ord").alias("target"))
    want = imports.join(named.select("rel", "ext", "dir"), "rel")
    here = F.when(F.col("dir") != ".", F.col("dir"))
    script = normal_path(F.concat_ws("/", here, "spec"))
    js = want.filter(F.col("ext").isin([e for e in rules.CODE if e not in (".go", ".py")]) & F.startswith("spec", F.lit("."))).select("rel", "spec", F.array(script, F.concat_ws("/", script, F.lit("index")), F.regexp_replace(script, r"/+\z", "")).alias("tries"))
    dots = F.length(F.regexp_extract("spec", r"^(\.*)", 1))
    rest = F.replace(F.regexp_replace("spec", r"^\.+", ""), F.lit("."), F.lit("/"))
    up = F.when(dots > 1, F.repeat(F.lit("../"), dots - 1)).otherwise(F.lit(""))
    dotted = F.when(dots > 0, normal_path(F.concat_ws("/", here, F.concat(up, rest)))).otherwise(rest)
    py = want.filter("ext = '.py' and spec <> ''").select("rel", "spec", F.array(dotted, F.concat_ws("/", F.when(dotted != "", dotted), F.lit("__init__"))).alias("tries"))
    tried = js.unionByName(py).select("rel", "spec", F.posexplode("tries").alias("turn", "key")).join(keys, "key")
    plain = tried.groupBy("rel", "spec").agg(F.min_by("target", "turn").alias("target"))
    steps = F.split("spec", "/")
    suffix = F.transform(F.sequence(F.lit(1), F.least(F.size(steps), F.lit(8))), lambda k: F.struct(k.alias("k"), F.array_join(F.slice(steps, F.size(steps) - k + 1, k), "/").alias("d")))
    go_files = named.filter("ext = '.go'").select(F.col("dir").alias("d"), F.col("rel").alias("target"))
    go = want.filter("ext = '.go'").select("rel", "spec", "dir", F.explode(suffix).alias("s")).select("rel", "spec", "dir", "s.*")
    go = go.join(go_files.select("d").distinct(), "d", "left_semi").filter("d <> dir").groupBy("rel", "spec").agg(F.max_by("d", "k").alias("d"))
    # As many links as imports: a repeated import is a repeated link.
    repeated = lambda found: imports.select("rel", "spec").join(found, ["rel", "spec"])
    out = repeated(plain).unionByName(_to_directories(repeated(go), go_files)) if not go_files.isEmpty() else repeated(plain)
    return out.filter("rel <> target").select(F.col("rel").alias("source"), "target", "spec")


def _starts(per: DataFrame) -> DataFrame:
    """per (file, n) -> (file, start): the sum of n over the files before, by name.

    Files are dealt into ranges of names, each summed in its task; only the sums of the ranges are summed in one.
    """
    dealt = settled(per.repartitionByRange("file").withColumn("range", F.spark_partition_id()))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("range").agg(F.sum("n").alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    own = F.sum("n").over(Window.partitionBy("range").orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    return dealt.withColumn("own", F.coalesce(own, F.lit(0))).join(F.broadcast(offsets), "range").select("file", (F.col("offset") + F.col("own")).alias("start"))


def symbols_of(extracted: DataFrame) -> DataFrame:
    """Symbols with id, ord (file, then place in it), tags and the id of their class."""
    s = extracted.select("file", F.posexplode("symbols").alias("at", "s")).select("file", "at", "s.*")
    s = s.withColumn("id", F.concat("file", F.lit("#"), "name", F.lit("@"), F.col("line").cast("string")))
    s = s.withColumn("tags", rules.tags(F.col("name"), F.col("signature"), F.col("doc"))).withColumn("loc", F.col("end_line") - F.col("line") + 1)
    s = s.join(shuffled(_starts(s.groupBy("file").agg(F.count("*").alias("n")))), "file").withColumn("ord", F.col("start") + F.col("at")).drop("start", "at")
    owner = s.filter("kind in ('class', 'interface')").groupBy("file", F.col("name").alias("container")).agg(F.max_by("id", "ord").alias("owner"))
    return s.join(shuffled(owner), ["file", "container"], "left").drop("container").withColumnRenamed("owner", "container")


def contains(symbols: DataFrame) -> DataFrame:
    return symbols.filter("container is not null").select(F.col("container").alias("src"), F.col("id").alias("dst"), F.lit("contains").alias("kind"))


def resolve_refs(refs: DataFrame, symbols: DataFrame, bindings: DataFrame) -> DataFrame:
    """refs (file, name, line, key) with target, in this order: the last definition of the file; what an import binds the name to (bindings: file, local, imported, target_file; a default import means the first exported symbol, else the first); the latest exported definition anywhere, else the earliest."""
    last = F.max_by("id", "ord")
    own = symbols.groupBy("file", "name").agg(last.alias("own"))
    exported = F.when(F.col("exported"), F.col("ord"))
    first = symbols.groupBy(F.col("file").alias("target_file")).agg(F.coalesce(F.min_by("id", exported), F.min_by("id", "ord")).alias("first"))
    named = symbols.groupBy(F.col("file").alias("target_file"), F.col("name").alias("imported")).agg(last.alias("named"))
    bound = bindings.filter("imported <> '*'").join(shuffled(first), "target_file", "left").join(shuffled(named), ["target_file", "imported"], "left")
    bound = bound.groupBy("file", F.col("local").alias("name")).agg(F.first(F.when(F.col("imported") == "default", F.col("first")).otherwise(F.col("named")), ignorenulls=True).alias("bound"))
    anywhere = symbols.groupBy("name").agg(F.coalesce(F.max_by("id", exported), F.min_by("id", "ord")).alias("anywhere"))
    out = refs.join(shuffled(own), ["file", "name"], "left").join(shuffled(bound), ["file", "name"], "left").join(shuffled(anywhere), "name", "left")
    return out.withColumn("target", F.coalesce("own", "bound", "anywhere")).drop("own", "bound", "anywhere").filter("target is not null")


def calls(resolved: DataFrame, symbols: DataFrame, cap: int = LIMITS.fan_in_per_caller) -> tuple[DataFrame, DataFrame]:
    """(edges, degrees): calls from the innermost callable around each reference, the target itself aside, to its target; fan_in counts up to ``cap`` of a caller's calls, fan_out its distinct targets."""
    at = symbol_at(symbols, resolved.select("file", "line", "name", "key", "target"), ["function", "method", "component"], exclude="target")
    # Written once: edges and both degrees read it.
    n = settled(at.filter("id <> target").groupBy(F.col("id").alias("src"), F.col("target").alias("dst")).agg(F.count("*").alias("n")))
    ins = n.groupBy(F.col("dst").alias("id")).agg(F.sum(F.least("n", F.lit(cap))).alias("fan_in"))
    outs = n.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("fan_out"))
    degrees = symbols.select("id").distinct().join(shuffled(ins), "id", "left").join(shuffled(outs), "id", "left").na.fill(0)
    return n.select("src", "dst", F.lit("calls").alias("kind")), degrees


def symbol_graph(files: DataFrame, extracted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(symbols, edges) of a file tree (rel, ext, text) and what was extracted from it (written or cached by the caller, as it is read several times)."""
    symbols = settled(symbols_of(extracted))
    refs = extracted.select("file", F.posexplode("refs").alias("key", "r")).select("file", "key", "r.name", "r.line")
    named = extracted.select("file", F.explode("imports").alias("i")).select("file", "i.*")
    targets = resolve_paths(named.select("file", "path"), files).withColumnRenamed("target", "target_file")
    edges, degrees = calls(resolve_refs(refs, symbols, named.join(shuffled(targets), ["file", "path"]).select("file", "local", "imported", "target_file")), symbols)
    return symbols.join(shuffled(degrees), "id"), contains(symbols).unionByName(edges)
