"""A repository in one call: from its files to issues, scores, modules and the symbol graph."""

from __future__ import annotations

import dataclasses
import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlake.operators import extract, fix, lines, resolve, score, swarm, timeline
from graphlake.operators.staged import settled
from graphlake.sources import files as src

#: Files whose presence in the root means pinned dependencies.
LOCKFILES = ["package-lock.json", "pnpm-lock.yaml", "yarn.lock"]


class Index:
    """files (rel, language, loc, fan_in, issues, module, ...), links between files, issues, symbols, edges between symbols, scores by dimension.

    Made of files (rel, ext, language, text, loc, ord), churn (file, churn), manifests (rel, text); ``written`` files are read as they are. Each table is computed and written when it is first asked for: scores ask for issues alone, not for symbols. Texts are neither joined nor written again. Files without text count as files, but hold no symbols and no lines.
    """

    def __init__(self, files: DataFrame, churn: DataFrame | None = None, manifests: DataFrame | None = None, long_files: bool = True, written: bool = False) -> None:
        self._texts = files if written else settled(files)
        self._churn, self._manifests, self._long_files = churn, manifests, long_files

    @functools.cached_property
    def links(self) -> DataFrame:
        return settled(resolve.import_graph(self._texts.drop("text"), src.imports(self._texts)))

    @functools.cached_property
    def _known(self) -> DataFrame:
        """All of files but their texts, with fan_in and churn."""
        known = self._texts.drop("text").join(score.file_fan_in(self.links).withColumnRenamed("file", "rel"), "rel", "left").withColumn("fan_in", F.coalesce("fan_in", F.lit(0)))
        if self._churn is None:
            return settled(known.withColumn("churn", F.lit(1)))
        return settled(known.join(self._churn.select(F.col("file").alias("rel"), "churn"), "rel", "left").withColumn("churn", F.coalesce("churn", F.lit(1))))

    @functools.cached_property
    def issues(self) -> DataFrame:
        return settled(all_issues(self._texts, self._manifests, self._long_files, self._known))

    @functools.cached_property
    def _graph(self) -> tuple[DataFrame, DataFrame]:
        symbols, edges = resolve.symbol_graph(self._texts.drop("text"), settled(extract.extracted(self._texts)))
        return settled(symbols.join(self._known.select(F.col("rel").alias("file"), "churn"), "file")), settled(edges)

    @property
    def symbols(self) -> DataFrame:
        return self._graph[0]

    @property
    def edges(self) -> DataFrame:
        return self._graph[1]

    @functools.cached_property
    def files(self) -> DataFrame:
        counted = self._known.join(score.issues_by_file(self.issues).select(F.col("file").alias("rel"), "issues"), "rel", "left").withColumn("issues", F.coalesce("issues", F.lit(0)))
        return score.module_of(counted.withColumn("file", F.col("rel"))).drop("file")

    @functools.cached_property
    def scores(self) -> DataFrame:
        return score.dimension_scores(self.issues, self._texts.agg(F.sum("loc").cast("double")).scalar())

    def overall(self) -> DataFrame:
        return score.overall_score(self.scores)

    def kept_issues(self) -> DataFrame:
        return score.ranked_issues(self.issues)

    def modules(self) -> tuple[DataFrame, DataFrame]:
        """(modules, edges between them)."""
        own = self.files.withColumn("file", F.col("rel"))
        return score.modules(own), score.module_edges(self.links, own)

    def findings(self) -> DataFrame:
        """What all seven specialists find, each on its own: one that fails, even at run time, finds nothing and leaves the others."""
        return swarm.findings(self.issues, self.symbols, self.edges, run=settled)


def manifest_issues(manifests: DataFrame) -> DataFrame:
    """manifests (rel, text), files of the root among others -> the issues of its package.json and requirements.txt; a lockfile is looked for by name."""
    one = lambda name: manifests.filter(F.col("rel") == name).select("text")
    lockfile = not manifests.filter(F.col("rel").isin(LOCKFILES)).isEmpty()
    return src.dependency_issues(src.package_json(one("package.json")), src.requirements(one("requirements.txt")), lockfile)


def all_issues(files: DataFrame, manifests: DataFrame | None = None, long_files: bool = True, known: DataFrame | None = None) -> DataFrame:
    """files (rel, ext, text, loc, fan_in, churn, ord) -> issues of code, then of dependencies, then of tests, with blast, churn and ord, their order.

    A hit counts as much as its file is used: one and its fan-in. ``known`` (rel, fan_in, churn, ord) has these columns if files don't. ``long_files`` asks whether files of over 600 lines are issues by themselves.
    """
    code = lines.rule_hits(lines.lines(files.filter("text is not null")))
    hits = code.unionByName(lines.lint_hits(lines.lines(files.filter("text is not null")), files))
    hits = hits.unionByName(lines.large_files(files)) if long_files else hits
    about = (files if known is None else known).select(F.col("rel").alias("file"), (1 + F.col("fan_in")).alias("blast"), F.col("churn"), F.col("ord").alias("file_ord"))
    place = F.col("file_ord") * 1_000_000_000 + F.col("rule") * 1_000_000 + F.col("line")
    columns = ["file", "line", "title", "dimension", "severity", "confidence", "blast", "churn", "ord"]
    out = hits.join(about, "file").withColumn("ord", place.cast("long")).select(columns)
    rest = [manifest_issues(manifests)] if manifests is not None else []
    for k, part in enumerate([*rest, lines.test_issues(files)], 1):
        ord_ = F.lit(k * 10**16) + F.pmod(F.xxhash64("title"), F.lit(10**15))
        out = out.unionByName(part.withColumn("churn", F.lit(1)).withColumn("ord", ord_).select(columns))
    return out


def index_files(files: DataFrame, churn: DataFrame | None = None, manifests: DataFrame | None = None, long_files: bool = True) -> Index:
    """files (rel, ext, language, text, loc, ord), churn (file, churn), manifests (rel, text) -> the index."""
    return Index(files, churn, manifests, long_files)


class Evolution:
    """metrics of the newer snapshot and, if there is one, of the older; events; issues that came or went; health of each module. What is not asked for is not computed."""

    def __init__(self, older: Index | None, newer: Index) -> None:
        self._older, self._newer = older, newer

    @functools.cached_property
    def metrics(self) -> DataFrame:
        return _metrics(self._newer)

    @functools.cached_property
    def baseline(self) -> DataFrame | None:
        return _metrics(self._older) if self._older else None

    @functools.cached_property
    def events(self) -> DataFrame:
        older, newer = self._older, self._newer
        if older is None:
            return timeline.baseline(newer.files)
        named = older.symbols.select("id", "name", "kind").unionByName(newer.symbols.select("id", "name", "kind")).dropDuplicates(["id"])
        symbols = timeline.node_diff(older.symbols, newer.symbols).join(named, "id")
        files = timeline.node_diff(*[own.files.withColumn("id", F.col("rel")) for own in (older, newer)])
        links = timeline.edge_diff(older.links.select("source", "target"), newer.links.select("source", "target"), "source", "target")
        return timeline.events(symbols, files, links)

    @functools.cached_property
    def issues(self) -> DataFrame:
        return timeline.issue_diff(self._older.issues if self._older else self._newer.issues.limit(0), self._newer.issues)

    @functools.cached_property
    def health(self) -> DataFrame:
        of = lambda own: own.modules()[0].select("module", "loc", "issues")
        return timeline.module_health(of(self._older) if self._older else None, of(self._newer))


def _metrics(own: Index) -> DataFrame:
    mods, between = own.modules()
    nodes = own.files.withColumn("id", F.col("rel"))
    return score.architecture_metrics(nodes, own.links.withColumn("kind", F.lit("imports")), mods, between)


def evolution(older: Index | None, newer: Index) -> Evolution:
    """What lies between two snapshots; without an older one every file is the one event, and all issues are introduced."""
    return Evolution(older, newer)


@dataclasses.dataclass(frozen=True)
class FixRun:
    """edits; the index of the files before and after them; what changed; one row (before, after): the overall scores."""

    edits: DataFrame
    before: Index
    after: Index
    evolution: Evolution

    @property
    def scores(self) -> DataFrame:
        one = lambda index, name: index.overall().select(F.col("overall").alias(name))
        return one(self.before, "before").withColumn("after", one(self.after, "after").scalar())


def fixed(files: DataFrame, before: Index | None = None, long_files: bool = True) -> FixRun:
    """files (rel, ext, language, text, loc, ord) through all fixers, indexed and scored anew. A file without edits or without text stays as it is."""
    files = settled(files)
    before = before or Index(files, long_files=long_files, written=True)
    edits = settled(fix.merged(lines.lines(files.filter("text is not null"))))
    new = fix.applied(files, edits).withColumn("loc", F.when(F.col("text").isNotNull(), lines.line_count(F.col("text"))).otherwise(F.col("loc")))
    after = Index(settled(new), long_files=long_files, written=True)
    return FixRun(edits, before, after, evolution(before, after))
