"""Lines of texts and the rules that look at them."""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphlake.config import LIMITS
from graphlake.functions import rules


def lines(files: DataFrame, file: str = "rel", text: str = "text") -> DataFrame:
    """(file, line from 1, text): the lines of every text."""
    return files.select(F.col(file).alias("file"), F.posexplode(F.split(text, "\n", -1)).alias("at", "text")).select("file", (F.col("at") + 1).alias("line"), "text")


def line_count(text):  # noqa: ANN001, ANN201
    return F.when(F.length(text) > 0, F.size(F.split(text, "\n", -1))).otherwise(0)


def _extension(file: str) -> Column:
    return F.lower(F.regexp_extract(file, r"[^/](\.[^./]*)\z", 1))


def _may_hit(text: Column, title: str, exts: list[str], file: str = "file") -> Column:
    return rules.clue(text, title) & _extension(file).isin(exts) if exts else rules.clue(text, title)


def suspects(files: DataFrame, file: str = "rel", text: str = "text") -> DataFrame:
    """The files in which some line may hit a rule: no other text need be split into lines."""
    return files.filter(functools.reduce(operator.or_, [_may_hit(F.col(text), title, exts, file) for title, *_, exts in rules.LINE_RULES]))


def rule_hits(of: DataFrame, per_rule: int = LIMITS.hits_per_rule) -> DataFrame:
    """``of`` (file, line, text) -> (file, line, rule, title, dimension, severity, confidence): the first hits of each rule in a file.

    Each line is read once, and only against the patterns that it holds a clue of; only hits are exploded.
    """
    found = []
    for k, (title, pattern, dimension, severity, confidence, exts) in enumerate(rules.LINE_RULES):
        hit = _may_hit(F.col("text"), title, exts) & F.col("text").rlike(pattern)
        if title == rules.SECRET:
            hit &= ~rules.is_placeholder(F.regexp_extract("text", pattern, 2))
        found.append(F.when(hit, F.struct(F.lit(k).alias("rule"), F.lit(title).alias("title"), F.lit(dimension).alias("dimension"), F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence"))))
    hits = of.select("file", "line", F.explode(F.filter(F.array(*found), lambda h: h.isNotNull())).alias("h")).select("file", "line", "h.*")
    rank = F.row_number().over(Window.partitionBy("file", "rule").orderBy("line"))
    return hits.withColumn("n", rank).filter(F.col("n") <= per_rule).drop("n")


def lint_hits(of: DataFrame, files: DataFrame | None = None, per_file: int = LIMITS.lint_per_file) -> DataFrame:
    """Line approximations of syntax-tree lint rules, script files only. With ``files`` (rel, ext, text) the first rule, of patterns, is no approximation (``unsafe_patterns``)."""
    ext = _extension("file")
    found = [F.when(F.col("text").rlike(p), F.struct(F.lit(100 + k).alias("rule"), F.lit(t).alias("title"), F.lit("security").alias("dimension"), F.lit(s).alias("severity"), F.lit(c).alias("confidence"))) for k, (t, p, s, c) in enumerate(rules.LINT_RULES) if k or files is None]
    hits = of.filter(ext.isin(rules.SCRIPTS)).select("file", "line", F.explode(F.filter(F.array(*found), lambda h: h.isNotNull())).alias("h")).select("file", "line", "h.*")
    if files is not None:
        hits = hits.unionByName(unsafe_patterns(files, per_file))
    return hits.withColumn("n", F.row_number().over(Window.partitionBy("file").orderBy("line", "rule"))).filter(F.col("n") <= per_file).drop("n")


def unsafe_patterns(files: DataFrame, per_file: int = LIMITS.lint_per_file) -> DataFrame:
    """files (rel, ext, text) -> hits, as of ``lint_hits``, of the first rule: pattern literals of scripts with a loop that reads one word in two ways.

    The lexer tells patterns from divisions, strings and comments. Each distinct pattern is judged once, however many files hold it.
    """
    from graphlake.functions.ambiguity import ambiguous
    from graphlake.operators.extract import sliced
    from graphlake.operators.script import Source

    title, _, severity, confidence = rules.LINT_RULES[0]

    def literals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            rows = []
            for rel, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                s = Source(text)
                rows += [(rel, s.line(at), pattern) for at, pattern in s.patterns]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else ((), (), ()), (pa.string(), pa.int32(), pa.string()), strict=True)], names=["file", "line", "pattern"])

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([ambiguous(p) for p in b.column(0).to_pylist()], pa.bool_()))

    found = files.filter(F.col("ext").isin(rules.SCRIPTS) & F.col("text").isNotNull()).select("rel", "text").mapInArrow(literals, "file string, line int, pattern string")
    bad = found.select("pattern").distinct().mapInArrow(judged, "pattern string")
    hits = found.join(bad, "pattern").select("file", "line", F.lit(100).alias("rule"), F.lit(title).alias("title"), F.lit("security").alias("dimension"), F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence"))
    return hits.withColumn("n", F.row_number().over(Window.partitionBy("file").orderBy("line"))).filter(F.col("n") <= per_file).drop("n")


def large_files(files: DataFrame) -> DataFrame:
    """Source files of over 600 lines; from 1200 on graver."""
    big = files.filter(F.col("text").isNotNull() & (F.col("loc") > 600))
    return big.select(F.col("rel").alias("file"), F.lit(1).alias("line"), F.lit(200).alias("rule"), F.concat(F.lit("Large file ("), F.col("loc").cast("string"), F.lit(" LOC)")).alias("title"), F.lit("maintainability").alias("dimension"), F.when(F.col("loc") > 1200, 4).otherwise(2).alias("severity"), F.lit(0.9).alias("confidence"))


def find_in_files(of: DataFrame, query: str, hits: int = LIMITS.find_hits, width: int = LIMITS.find_line) -> DataFrame:
    """The first ``hits`` lines, by file and line, that hold ``query`` whatever its case; files with a NUL early on are left out by the source."""
    found = of.filter(F.contains(F.lower("text"), F.lit(query.lower())))
    return found.select("file", "line", F.substring(F.trim("text"), 1, width).alias("text")).orderBy("file", "line").limit(hits)


def test_issues(files: DataFrame) -> DataFrame:
    """No tests, or few for the code there is: one row at most."""
    code = files.filter(F.col("ext").isin(rules.CODE)).agg(F.count("*").alias("n"), F.count_if(F.col("rel").rlike(rules.TEST_PATH)).alias("tests"))
    ratio = F.col("tests") / F.col("n")
    title = F.when(F.col("tests") == 0, F.lit("No test files detected")).otherwise(F.concat(F.lit("Low test coverage ratio ("), F.round(ratio * 100).cast("int").cast("string"), F.lit("% of code files)")))
    none = F.col("tests") == 0
    return code.filter("n > 0").filter(none | (ratio < 0.1)).select(F.lit(".").alias("file"), F.lit(1).alias("line"), title.alias("title"), F.lit("test_integrity").alias("dimension"), F.when(none, 4).otherwise(2).alias("severity"), F.when(none, 0.6).otherwise(0.75).alias("confidence"), F.when(none, 3).otherwise(2).alias("blast"))
