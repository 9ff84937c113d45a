"""Fixers: edits of lines, merged and shown as unified diffs."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphlake.functions import rules
from graphlake.operators.staged import shuffled

EDIT = "file string, line int, before string, after string, fixer string"
OPENER = re.compile(rules.PYTHON_OPENER)


def _extension():  # noqa: ANN202
    return F.lower(F.regexp_extract("file", r"[^/](\.[^./]*)\z", 1))


def _edit(df: DataFrame, fixer: str, after=None) -> DataFrame:  # noqa: ANN001
    return df.select("file", "line", F.col("text").alias("before"), (after if after is not None else F.lit(None).cast("string")).alias("after"), F.lit(fixer).alias("fixer"))


def debug_output(lines: DataFrame) -> DataFrame:
    """Whole-line debug statements go. A Python block keeps its last statement if all of them would go, so its file's lines are looked at together."""
    t = F.trim("text")
    script = _extension().isin(rules.SCRIPTS) & (t.rlike(rules.SCRIPT_DEBUG) | t.rlike(rules.SCRIPT_DEBUGGER))
    own = _edit(lines.filter(script), "remove-debug-output")
    py = lines.filter(_extension() == ".py")
    printing = py.filter(t.rlike(rules.PYTHON_PRINT)).select("file").distinct()

    def blocks(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values("line")["text"].tolist()
        gone = {i for i, x in enumerate(rows) if re.match(rules.PYTHON_PRINT, x.strip())}
        indent = [len(x) - len(x.lstrip()) for x in rows]
        for i, x in enumerate(rows):
            if OPENER.match(x.strip()):
                body = []
                for j in range(i + 1, len(rows)):
                    if rows[j].strip():
                        if indent[j] <= indent[i]:
                            break
                        body.append(j)
                if body and gone.issuperset(body):
                    gone.discard(body[-1])
        at = sorted(gone)
        return pd.DataFrame({"file": [group["file"].iloc[0]] * len(at), "line": [i + 1 for i in at], "before": [rows[i] for i in at], "after": [None] * len(at), "fixer": ["remove-debug-output"] * len(at)})

    return own.unionByName(py.join(printing, "file", "left_semi").groupBy("file").applyInPandas(blocks, EDIT))


def todo_markers(lines: DataFrame) -> DataFrame:
    t = F.trim("text")
    return _edit(lines.filter(t.rlike(r"^(//|#)") & t.rlike(r"\bTODO\b|\bFIXME\b|\bHACK\b|\bXXX\b")), "remove-todo-marker")


def empty_catches(lines: DataFrame) -> DataFrame:
    """The catch says that it ignores; the line keeps its indentation and all else."""
    hit = lines.filter(_extension().isin(rules.SCRIPTS) & F.col("text").rlike(r"catch\s*\([^)]*\)\s*\{\s*\}"))
    return _edit(hit, "annotate-empty-catch", F.regexp_replace("text", r"(catch\s*\([^)]*\)\s*)\{\s*\}", "$1{ /* intentionally ignored */ }"))


FIXERS = [debug_output, todo_markers, empty_catches]


def merged(lines: DataFrame) -> DataFrame:
    """All fixers' edits of the untouched lines; the first to claim a line has it."""
    out = None
    for k, fixer in enumerate(FIXERS):
        part = fixer(lines).withColumn("turn", F.lit(k))
        out = part if out is None else out.unionByName(part)
    first = F.row_number().over(Window.partitionBy("file", "line").orderBy("turn"))
    return out.withColumn("n", first).filter("n = 1").drop("n", "turn")


def patched(lines: DataFrame, edits: DataFrame) -> DataFrame:
    """(file, text) after the edits."""
    e = edits.select("file", "line", F.lit(True).alias("hit"), "after")
    left = lines.join(e, ["file", "line"], "left").filter("hit is null or after is not null").withColumn("text", F.coalesce("after", "text"))
    return left.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda s: s["text"]), "\n").alias("text"))


def applied(files: DataFrame, edits: DataFrame) -> DataFrame:
    """files (rel, text, ...) with the text after the edits, which is empty if all its lines go; a file without edits or without text stays as it is.

    A file's edits travel to its text, and what lies between two of them is cut out of its lines, so no line is a row.
    """
    e = edits.groupBy(F.col("file").alias("rel")).agg(F.array_sort(F.collect_list(F.struct("line", "after"))).alias("__edits"))
    both = files.join(shuffled(e), "rel", "left").withColumn("__lines", F.split("text", "\n", -1))
    upto = lambda i: F.coalesce(F.get("__edits", i)["line"], F.lit(0))
    made = lambda x: F.when(x["after"].isNull(), F.array().cast("array<string>")).otherwise(F.array(x["after"]))
    head = F.transform("__edits", lambda x, i: F.concat(F.slice("__lines", upto(i - 1) + 1, x["line"] - upto(i - 1) - 1), made(x)))
    last = upto(F.size("__edits") - 1)
    new = F.array_join(F.concat(F.flatten(head), F.slice("__lines", last + 1, F.size("__lines") - last)), "\n")
    return both.withColumn("text", F.when(F.col("__edits").isNotNull() & F.col("text").isNotNull(), new).otherwise(F.col("text"))).select(files.columns)


def diffs(lines: DataFrame, edits: DataFrame, context: int = 3) -> DataFrame:
    """(file, diff): unified diffs; edits not over twice the context apart share a hunk."""
    at = Window.partitionBy("file").orderBy("line")
    e = edits.withColumn("new", F.coalesce((F.col("line") - F.lag("line").over(at) > 2 * context).cast("int"), F.lit(1)))
    e = e.withColumn("hunk", F.sum("new").over(at.rowsBetween(Window.unboundedPreceding, 0)))
    spans = e.groupBy("file", "hunk").agg((F.min("line") - context).alias("lo"), (F.max("line") + context).alias("hi"))
    shown = lines.join(spans, "file").filter("line between lo and hi").join(e.select("file", "line", F.lit(True).alias("hit"), "after"), ["file", "line"], "left")
    text = F.when(F.col("hit").isNull(), F.concat(F.lit(" "), "text")).otherwise(F.concat(F.lit("-"), "text", F.when(F.col("after").isNotNull(), F.concat(F.lit("\n+"), "after")).otherwise("")))
    hunks = shown.groupBy("file", "hunk").agg(F.min("line").alias("start"), F.count("*").alias("old"), F.count_if(F.col("hit").isNull() | F.col("after").isNotNull()).alias("new"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", text.alias("t")))), lambda s: s["t"]), "\n").alias("body"))
    before = Window.partitionBy("file").orderBy("hunk").rowsBetween(Window.unboundedPreceding, -1)
    hunks = hunks.withColumn("shift", F.coalesce(F.sum(F.col("new") - F.col("old")).over(before), F.lit(0)))
    head = F.concat(F.lit("@@ -"), F.col("start").cast("string"), F.lit(","), F.col("old").cast("string"), F.lit(" +"), (F.col("start") + F.col("shift")).cast("string"), F.lit(","), F.col("new").cast("string"), F.lit(" @@\n"), "body")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("hunk", head.alias("h")))), lambda s: s["h"]), "\n")
    return hunks.groupBy("file").agg(body.alias("b")).select("file", F.concat(F.lit("--- a/"), "file", F.lit("\n+++ b/"), "file", F.lit("\n"), "b", F.lit("\n")).alias("diff"))


def by_fixer(edits: DataFrame) -> DataFrame:
    return edits.groupBy("fixer").agg(F.count("*").alias("edits"))


def verified(before: DataFrame, after: DataFrame) -> DataFrame:
    """before, after: one row (score, issues) each. Verified if the score hasn't fallen and the issues haven't grown, all issues counted."""
    b, a = before.select(F.col("score").alias("score_before"), F.col("issues").alias("issues_before")), after.select(F.col("score").alias("score_after"), F.col("issues").alias("issues_after"))
    return b.join(a).withColumn("verified", (F.col("score_after") >= F.col("score_before")) & (F.col("issues_after") <= F.col("issues_before")))


def pull_request(summary: DataFrame, edits: DataFrame) -> DataFrame:
    """summary, as of ``verified``: one row -> (title, body) of a request to merge the edits; no row unless they are verified."""
    per = by_fixer(edits).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("fixer", "edits"))), lambda s: F.format_string("- `%s`: %d edit(s)", s["fixer"], s["edits"])), "\n").alias("changes"), F.coalesce(F.sum("edits"), F.lit(0)).alias("n"))
    one = summary.filter("verified").join(per).join(edits.agg(F.count_distinct("file").alias("files")))  # each side is one row
    gain = F.col("score_after") - F.col("score_before")
    head = F.format_string("Health score: %s to %s. Files changed: %d. Edits: %d.", F.col("score_before").cast("string"), F.col("score_after").cast("string"), "files", "n")
    check = F.format_string("Indexed again after the edits: issues %d before, %d after.", F.col("issues_before").cast("long"), F.col("issues_after").cast("long"))
    return one.select(F.format_string("chore: apply safe fixes (+%s health)", gain.cast("string")).alias("title"), F.concat_ws("\n\n", head, "changes", check).alias("body"))
