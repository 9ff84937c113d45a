"""File trees, manifests and commit logs as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphlake.config import LIMITS
from graphlake.functions import rules
from graphlake.functions.scalars import dirname, extension
from graphlake.operators.lines import line_count


def file_tree(spark: SparkSession, root: str, limits=LIMITS) -> DataFrame:  # noqa: ANN001
    """(rel, ext, language, text, loc, ord): files of known languages; skipped and hidden directories are left out. Sizes prune files before their bytes are read; text is kept for source files.

    Spark's file sources never show names that begin with a dot or an underscore; ``snapshots.archives`` reads trees that have such files whole.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).filter(F.col("length") <= limits.max_file_bytes)
    base = root.rstrip("/").split("://")[-1].lstrip("/")
    rel = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", ""), "^" + _quoted(base) + "/", "")
    return scanned(found.withColumn("rel", rel), limits)


def scanned(found: DataFrame, limits=LIMITS) -> DataFrame:  # noqa: ANN001
    """``found`` (rel, content) as a file tree."""
    skipped = "|".join(_quoted(d) for d in rules.SKIPPED_DIRS)
    out = found.filter(~F.col("rel").rlike(rf"(^|/)({skipped}|\.[^/]+)/"))
    out = with_language(out).withColumn("text", F.when(F.col("ext").isin(rules.CODE), F.decode("content", "UTF-8")))
    out = out.select("rel", "ext", "language", "text", F.when(F.col("text").isNotNull(), line_count(F.col("text"))).otherwise(0).alias("loc"))
    # At most max_files rows are numbered; paths in order are the order of the scan.
    return out.orderBy("rel").limit(limits.max_files).withColumn("ord", F.row_number().over(Window.orderBy("rel")) - 1)


def _quoted(text: str) -> str:
    return "".join("\\" + c if c in r".^$*+?()[]{}|\-" else c for c in text)


def with_language(files: DataFrame) -> DataFrame:
    """Rows of a known extension, with ext and language."""
    table = F.create_map(*[F.lit(x) for pair in rules.LANGUAGES.items() for x in pair])
    return files.withColumn("ext", extension(F.col("rel"))).withColumn("language", F.element_at(table, F.col("ext"))).filter("language is not null")


def list_dir(files: DataFrame, path: str = "") -> DataFrame:
    """The entries of one directory: directories first, by name in either case."""
    rest = F.when(F.lit(path == ""), F.col("rel")).otherwise(F.expr(f"substring(rel, {len(path) + 2})"))
    inside = files.filter(F.lit(True) if path == "" else F.startswith("rel", F.lit(path + "/")))
    entry = inside.select(F.get(F.split(rest, "/"), F.lit(0)).alias("name"), (F.instr(rest, "/") > 0).alias("dir"))
    return entry.distinct().orderBy(F.desc("dir"), F.lower("name"), "name")


def imports(files: DataFrame) -> DataFrame:
    """(rel, spec, ord) of what a file imports, in three dialects: Go paths, Python modules (a from-import gives its base and each name), relative paths of scripts."""
    code = files.filter("text is not null")
    quoted = lambda text: F.regexp_extract_all(text, F.lit(r'"([^"]+)"'), 1)
    blocks = F.flatten(F.transform(F.regexp_extract_all("text", F.lit(r"import\s*\(([\s\S]*?)\)"), 1), quoted))
    single = F.regexp_extract_all("text", F.lit(r'import\s+(?:[A-Za-z0-9_.]+\s+)?"([^"]+)"'), 1)
    go = code.filter("ext = '.go'").select("rel", F.concat(blocks, single).alias("specs"))
    script = F.filter(F.regexp_extract_all("text", F.lit(r"""(?:import\s+[^'"]*from\s+|require\(\s*|import\s*\(\s*|from\s+)['"]([^'"]+)['"]"""), 1), lambda s: F.startswith(s, F.lit(".")))
    other = code.filter(F.col("ext").isin([e for e in rules.CODE if e not in (".go", ".py")])).select("rel", script.alias("specs"))
    line = code.filter("ext = '.py'").select("rel", F.posexplode(F.split("text", "\n", -1)).alias("n", "raw")).select("rel", "n", F.get(F.split("raw", "#"), F.lit(0)).alias("l"))
    base = F.regexp_extract("l", r"^\s*from\s+(\.*[A-Za-z0-9_.]*)\s+import\s+(.+)$", 1)
    names = F.regexp_extract("l", r"^\s*from\s+(\.*[A-Za-z0-9_.]*)\s+import\s+(.+)$", 2)
    clean = lambda p: F.regexp_replace(F.trim(F.get(F.split(F.trim(p), r"\s+as\s+"), F.lit(0))), r"[()]", "")
    joined = F.transform(F.filter(F.transform(F.split(names, ","), clean), lambda n: n.rlike(r"^[A-Za-z_][A-Za-z0-9_]*$")), lambda n: F.when((base == "") | F.endswith(base, F.lit(".")), F.concat(base, n)).otherwise(F.concat(base, F.lit("."), n)))
    plain = F.filter(F.transform(F.split(F.regexp_extract("l", r"^\s*import\s+(.+)$", 1), ","), lambda p: F.trim(F.get(F.split(F.trim(p), r"\s+as\s+"), F.lit(0)))), lambda m: m != "")
    specs = F.when(names != "", F.concat(F.array(base), joined)).otherwise(plain)
    py = line.select("rel", "n", specs.alias("specs")).filter(F.size("specs") > 0)
    py = py.groupBy("rel").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("n", "specs"))), lambda s: s["specs"])).alias("specs"))
    return go.unionByName(other).unionByName(py).select("rel", F.posexplode("specs").alias("ord", "spec"))


def package_json(texts: DataFrame) -> DataFrame:
    """(name, range) of dependencies; those of development override."""
    kind = "struct<dependencies:map<string,string>,devDependencies:map<string,string>>"
    j = texts.select(F.from_json("text", kind).alias("j"))
    empty = F.create_map().cast("map<string,string>")
    dev, own = F.coalesce("j.devDependencies", empty), F.coalesce("j.dependencies", empty)
    return j.select(F.explode(F.map_concat(dev, F.map_filter(own, lambda k, v: ~F.map_contains_key(dev, k)))).alias("name", "range"))


def requirements(texts: DataFrame) -> DataFrame:
    """(name, line) of lines that say something."""
    line = texts.select(F.explode(F.split("text", "\n")).alias("line")).filter((F.trim("line") != "") & ~F.startswith("line", F.lit("#")))
    return line.select(F.regexp_extract("line", r"^([A-Za-z0-9_-]+)", 1).alias("name"), "line")


def dependency_issues(packages: DataFrame, reqs: DataFrame, lockfile: bool) -> DataFrame:
    loose = F.col("range").isin("*", "latest") | F.col("range").rlike("^(http|git)")
    young = F.col("range").rlike(r"^[~^]?0\.")
    row = lambda df, file, title, severity, blast: df.select(F.lit(file).alias("file"), F.lit(1).alias("line"), title.alias("title"), F.lit("dependency_hygiene").alias("dimension"), severity.alias("severity"), F.lit(1.0).alias("confidence"), blast.alias("blast"))
    title = F.concat(F.when(loose, "Unpinned").otherwise("Pre-1.0"), F.lit(" dependency: "), "name", F.lit(" ("), "range", F.lit(")"))
    out = row(packages.filter(loose | young), "package.json", title, F.when(loose, 3).otherwise(1), F.when(loose, 2).otherwise(1))
    out = out.unionByName(row(reqs.filter(~F.col("line").rlike("[=<>~]")), "requirements.txt", F.concat(F.lit("Unpinned dependency: "), F.trim("line")), F.lit(2), F.lit(1)))
    if not lockfile:
        out = out.unionByName(row(packages.limit(1), "package.json", F.lit("No lockfile committed"), F.lit(2), F.lit(2)))
    return out


def commit_log(lines: DataFrame, sep: str = "\u0001") -> DataFrame:
    """Log lines (value, seq) of hash, seconds, author, refs and subject; a subject may hold the separator."""
    p = F.split("value", sep)
    refs = F.filter(F.transform(F.split(F.get(p, F.lit(3)), ","), F.trim), lambda r: r != "")
    return lines.filter(F.size(p) >= 5).select(F.get(p, F.lit(0)).alias("hash"), F.get(p, F.lit(1)).cast("long").alias("ts"), F.get(p, F.lit(2)).alias("author"), F.array_join(F.slice(p, 5, F.size(p) - 4), sep).alias("message"), refs.alias("refs"), "seq")


def recent(commits: DataFrame, n: int = 30) -> DataFrame:
    return commits.orderBy(F.desc("ts"), F.desc("seq")).limit(n).withColumn("date", F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd'T'HH:mm:ssXXX"))


def ownership(lines: DataFrame) -> DataFrame:
    """(email, name, file, commits) from a log whose header lines hold a tab and whose other lines are paths; ``.py`` files only. lines: (value, seq, part), part parting logs of which each is read in order."""
    at = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    head = F.instr("value", "\t") > 0
    filled = lines.withColumn("head", F.last(F.when(head, F.col("value")), ignorenulls=True).over(at)).filter(~head & F.endswith("value", F.lit(".py")))
    who = F.split("head", "\t")
    return filled.groupBy(F.get(who, F.lit(0)).alias("email"), F.get(who, F.lit(1)).alias("name"), F.col("value").alias("file")).agg(F.count("*").alias("commits"))


def code_owners(texts: DataFrame) -> DataFrame:
    """(pattern, owner) of CODEOWNERS files."""
    line = texts.select(F.explode(F.split("text", "\n")).alias("l")).select(F.trim("l").alias("l")).filter("l <> '' and not startswith(l, '#')")
    p = F.split("l", r"\s+")
    return line.select(F.get(p, F.lit(0)).alias("pattern"), F.explode(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0)))).alias("owner"))


def who_owns(owned: DataFrame, files: DataFrame) -> DataFrame:
    return files.join(owned, "file").select("file", "email", "name", "commits").orderBy("file", F.desc("commits"), "email")


def visible(repos: DataFrame, viewer: int | None, most: int = 100) -> DataFrame:
    """Repositories without an owner and the viewer's own, the newest first."""
    own = F.col("owner_id").isNull() if viewer is None else F.col("owner_id").isNull() | (F.col("owner_id") == viewer)
    return repos.filter(own).orderBy(F.desc("created_at"), "id").limit(most)


def directories(files: DataFrame) -> DataFrame:
    return files.select(dirname(F.col("rel")).alias("dir")).distinct()
