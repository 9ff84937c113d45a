"""Specialists turn issues and the symbol graph into findings; a critic merges them, a judge ranks them, a plan sums them up."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphlake.functions import rules
from graphlake.functions.scalars import js_round, judge_score, priority
from graphlake.operators import graph, query

FINDING = ["agent", "severity", "confidence", "title", "file", "line", "symbol", "blast", "churn", "effort", "ord"]
AGENTS = ["security", "performance", "refactor", "deadcode", "dependency", "architecture", "test"]


def _finding(df: DataFrame, agent: str, severity: Column, confidence: Column, title: Column, effort: Column, order: Column, symbol: Column | None = None) -> DataFrame:
    return df.select(F.lit(agent).alias("agent"), severity.cast("int").alias("severity"), confidence.cast("double").alias("confidence"), title.alias("title"), "file", F.col("line").cast("int").alias("line"), (symbol if symbol is not None else F.lit(None).cast("string")).alias("symbol"), F.col("blast").cast("long").alias("blast"), F.coalesce("churn", F.lit(1)).cast("long").alias("churn"), effort.alias("effort"), order.cast("long").alias("ord"))


def _of_issues(issues: DataFrame, agent: str, keep: Column, most: int, confidence: Column, effort: Column) -> DataFrame:
    return _finding(issues.filter(keep).orderBy("ord").limit(most), agent, F.col("severity"), F.coalesce("confidence", confidence), F.col("title"), effort, F.col("ord"))


def security_advice(title: Column) -> Column:
    """Which remedy a title calls for, as a key."""
    t = F.lower(title)
    has = lambda w: F.contains(t, F.lit(w))
    return F.when(has("eval"), "eval").when(has("secret"), "secret").when(has("sql"), "sql").when(has("html"), "html").when(has("shell") | has("process"), "process").otherwise("review")


def dependency_advice(title: Column) -> Column:
    t = F.lower(title)
    has = lambda w: F.contains(t, F.lit(w))
    return F.when(has("unpinned"), "pin").when(has("lockfile"), "lock").when(has("pre-1.0"), "pin-tightly").otherwise("review")


def security(issues: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    grave = F.col("severity") >= 4
    own = _of_issues(issues, "security", F.col("dimension") == "security", 40, F.when(grave, 0.9).otherwise(0.65), F.when(grave, "M").otherwise("S"))
    return own.unionByName(taint(issues, symbols, edges))


def taint(issues: DataFrame, symbols: DataFrame, edges: DataFrame, depth: int = 3, most: int = 10) -> DataFrame:
    """Callables that take a request and reach, by up to ``depth`` calls, the symbol around a security issue; per pair its first issue."""
    sources = symbols.filter(F.col("kind").isin("function", "method", "component") & F.col("signature").rlike(r"(?i)\(\s*(?:req|request)\b"))
    reach = graph.reach(edges.filter("kind = 'calls'").select("src", "dst"), sources.select(F.col("id").alias("seed")), depth)
    bad = issues.filter("dimension = 'security'").select("file", "line", "severity", "title", "blast", "ord")
    sinks = query.symbol_at(symbols, bad).select(F.col("id").alias("node"), "severity", "title", "blast", F.col("ord").alias("issue_ord"))
    pairs = reach.join(sinks, "node").groupBy("seed", "node").agg(F.min_by(F.struct("severity", "title", "blast", "issue_ord"), "issue_ord").alias("i")).select("seed", "i.*")
    out = pairs.join(sources.select(F.col("id").alias("seed"), "file", "line", "ord", "churn"), "seed").orderBy("ord", "issue_ord").limit(most)
    return _finding(out, "security", F.least(F.lit(5), F.col("severity") + 1), F.lit(0.9), F.concat(F.lit("Untrusted input reaches "), F.lower("title")), F.lit("M"), 1_000_000 + F.col("ord"), F.col("seed"))


def performance(issues: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    hot = query.hubs(symbols, 8).filter("fan_in >= 3").withColumn("blast", F.col("fan_in"))
    n = F.col("fan_in")
    return _finding(hot, "performance", F.least(F.lit(4), 2 + F.floor(n / 8)), F.when(n > 20, 0.8).otherwise(0.6), F.concat(F.lit("Hot path: "), "name", F.lit(" ("), n.cast("string"), F.lit(" callers)")), F.lit("M"), -(n + F.col("fan_out")) * 1_000_000 + F.col("ord"), F.col("id"))


def refactor(issues: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    large = _of_issues(issues, "refactor", (F.col("dimension") == "maintainability") & F.col("title").rlike("(?i)large file"), 10, F.lit(0.8), F.lit("L"))
    c = F.col("complexity")
    tangled = query.hubs(symbols, 100).filter(c > 15).orderBy(F.desc("complexity"), F.desc(F.col("fan_in") + F.col("fan_out")), "ord").limit(15).withColumn("blast", F.col("fan_in"))
    title = F.concat(F.lit("High complexity: "), "name", F.lit(" (score: "), c.cast("string"), F.lit(")"))
    return large.unionByName(_finding(tangled, "refactor", F.least(F.lit(4), 1 + F.floor(c / 10)), F.lit(0.9), title, F.lit("M"), 1_000_000 - c, F.col("id")))


def deadcode(issues: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    dead = query.dead_code(symbols).orderBy("ord").limit(25).withColumn("blast", F.lit(1))
    return _finding(dead, "deadcode", F.lit(2), F.when(F.col("exported"), 0.3).otherwise(0.8), F.concat(F.lit("Unreferenced "), "kind", F.lit(": "), "name"), F.lit("S"), F.col("ord"), F.col("id"))


def dependency(issues: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    return _of_issues(issues, "dependency", F.col("dimension") == "dependency_hygiene", 25, F.lit(0.8), F.lit("S"))


def architecture(issues: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    found = graph.cycles(edges.filter("kind = 'calls'").select("src", "dst"), 15)
    name = F.array_join(F.slice("members", 1, 3), " → ")
    df = found.select("label", "size", name.alias("some"), F.lit("").alias("file"), F.lit(1).alias("line"), F.col("size").alias("blast"), F.lit(1).alias("churn"))
    title = F.concat(F.lit("Circular dependency: "), "some", F.when(F.col("size") > 3, " → …").otherwise(""))
    return _finding(df, "architecture", F.lit(3), F.when(F.col("size") == 2, 0.9).otherwise(0.7), title, F.lit("M"), -F.col("size"))


def tests(issues: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    own = _of_issues(issues, "test", F.col("dimension") == "test_integrity", 5, F.lit(0.7), F.lit("M"))
    is_test = F.col("file").rlike(rules.TEST_FILE)
    hubs = query.hubs(symbols, 30).filter(~is_test & (F.col("fan_in") >= 2))
    tested = edges.filter("kind = 'calls'").join(symbols.filter(is_test).select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
    bare = hubs.join(tested, "id", "left_anti").withColumn("blast", F.col("fan_in"))
    n = F.col("fan_in")
    new = _finding(bare, "test", F.least(F.lit(4), 2 + F.floor(n / 5)), F.lit(0.85), F.concat(F.lit("Untested core logic: "), "name"), F.lit("M"), 1_000_000_000 - (n + F.col("fan_out")) * 100_000 + F.col("ord"), F.col("id"))
    both = own.withColumn("turn", F.lit(0)).unionByName(new.withColumn("turn", F.lit(1)))
    return both.orderBy("turn", "ord").limit(15).drop("turn")


Specialist = Callable[[DataFrame, DataFrame, DataFrame], DataFrame]
SPECIALISTS: dict[str, Specialist] = dict(zip(AGENTS, (security, performance, refactor, deadcode, dependency, architecture, tests), strict=True))


def findings(issues: DataFrame, symbols: DataFrame, edges: DataFrame, specialists: dict[str, Specialist] | None = None, run: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """All specialists' findings, in their fixed order: ord is an order of agents, then of each one's own. A specialist that can't be planned is named in a warning and finds nothing; the others go on. With ``run``, which computes a table and gives it back, the same holds for one that fails at run time."""
    found = []
    for k, (name, find) in enumerate((specialists or SPECIALISTS).items()):
        try:
            found.append(run(find(issues, symbols, edges).withColumn("agent_ord", F.lit(k))))
        except Exception as e:  # noqa: BLE001
            warnings.warn(f"specialist {name} failed: {e}", stacklevel=2)
    if not found:
        raise ValueError("no specialist could be run")
    return reduce(DataFrame.unionByName, found)


#: What a finding of the other specialists calls for, as a key.
ADVICE = {"performance": "cache", "refactor": "split", "deadcode": "remove", "architecture": "invert", "test": "cover"}


def advised(found: DataFrame) -> DataFrame:
    """Findings with ``advice``, the key of the remedy: by title for security and dependencies, else by specialist."""
    agent, title = F.col("agent"), F.col("title")
    advice = F.when(agent == "security", security_advice(title)).when(agent == "dependency", dependency_advice(title))
    for name, key in ADVICE.items():
        advice = advice.when(agent == name, key)
    return found.withColumn("advice", advice)


def critic(found: DataFrame, gap: int = 2, gain: float = 0.15) -> DataFrame:
    """Findings of one file whose lines follow within ``gap`` are one: the gravest (the first on ties) stays, surer by ``gain`` for every finding of another agent, with those agents' names in the order met."""
    at = Window.partitionBy("file").orderBy("line", "agent_ord", "ord")
    parted = found.withColumn("new", F.coalesce((F.col("line") - F.lag("line").over(at) > gap).cast("int"), F.lit(1)))
    grouped = parted.withColumn("group", F.sum("new").over(at.rowsBetween(Window.unboundedPreceding, 0)))
    row = F.struct(*[F.col(c) for c in found.columns])
    first = F.min_by(row, F.struct(-F.col("severity"), "line", "agent_ord", "ord"))
    seen = F.transform(F.array_sort(F.collect_list(F.struct("line", "agent_ord", "ord", "agent"))), lambda s: s["agent"])
    out = grouped.groupBy("file", "group").agg(first.alias("f"), seen.alias("agents"))
    others = F.filter("agents", lambda a: a != F.col("f.agent"))
    kept = [F.col(f"f.{c}") for c in found.columns if c != "confidence"]
    return out.select(*kept, F.least(F.lit(1.0), F.col("f.confidence") + gain * F.size(others)).alias("confidence"), F.array_distinct(others).alias("corroborated_by"))


def judge(found: DataFrame, most: int | None = 60) -> DataFrame:
    """Findings with score and priority: the ``most`` highest in order, or all, in no order, so that they stay where they are."""
    score = judge_score(F.col("severity"), F.col("blast"), F.col("churn"), F.col("confidence"), F.col("effort"))
    ranked = found.withColumn("score", score).withColumn("priority", priority(F.col("score"), F.col("agent"), F.col("severity")))
    return ranked if most is None else ranked.orderBy(F.desc("score"), "file", "line", "agent_ord", "ord").limit(most)


def reports(found: DataFrame) -> DataFrame:
    """A row per specialist, those without findings too."""
    own = found.groupBy("agent").agg(F.count("*").alias("findings"), F.max_by("title", F.struct("severity", -F.col("ord"))).alias("top"))
    agents = found.sparkSession.createDataFrame([(a,) for a in AGENTS], "agent string")
    return agents.join(own, "agent", "left").select("agent", F.coalesce("findings", F.lit(0)).alias("findings"), "top")


def plan(judged: DataFrame, score: int) -> DataFrame:
    """One row: findings by priority and the score that fixing the first two kinds may bring."""
    one = judged.agg(*[F.count_if(F.col("priority") == p).alias(p.lower()) for p in ("P0", "P1", "P2", "P3")], F.count_distinct("agent").alias("specialists"))
    gain = F.least(F.lit(100 - score), js_round(2.2 * F.col("p0") + 1.1 * F.col("p1")))
    return one.withColumn("projected", F.least(F.lit(100), score + gain).cast("long"))
