"""The operators bound to plain tables, each with its SQL.

The tables hold no source code, so every operator runs on a relation of the shape it wants: lines are those of documents, symbols are parts, calls go from the part on one line of an order to that on the next, issues are line items, commits are orders, versions are events.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphlake.functions import rules
from graphlake.functions.scalars import token_estimate
from graphlake.operators import fleet, graph, query, score, swarm, temporal, timeline
from graphlake.operators import lines as text_lines
from graphlake.sources.files import visible

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}


def of(sql: str):  # noqa: ANN201
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- lines and rules ----


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("rel"), "text")


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_lines.lines(_texts(spark, sf_dir))


def doc_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_lines.rule_hits(text_lines.lines(text_lines.suspects(_texts(spark, sf_dir))))


SQL_LINES = "l AS (SELECT CAST(doc_id AS VARCHAR) AS file, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)"


def _sql_rules() -> str:
    parts = []
    for k, (title, pattern, dimension, severity, confidence, exts) in enumerate(rules.LINE_RULES):
        p = pattern.replace("'", "''")
        more = f" AND NOT (regexp_matches(regexp_extract(text, '{p}', 2), '{rules.PLACEHOLDER}') OR contains(regexp_extract(text, '{p}', 2), '...'))" if title == rules.SECRET else ""
        if not exts:
            parts.append(f"SELECT file, line, {k} AS rule, '{title}' AS title, '{dimension}' AS dimension, {severity} AS severity, CAST({confidence} AS DOUBLE) AS confidence FROM l WHERE regexp_matches(text, '{p}'){more}")
    return "h AS (" + " UNION ALL ".join(parts) + "), i AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY file, rule ORDER BY line) <= 5)"


SQL_RULES = _sql_rules()


@of(f"WITH {SQL_LINES}, {SQL_RULES} SELECT file, CAST(line AS INT) AS line, rule, title, dimension, severity, confidence FROM i")
def rule_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_hits(spark, sf_dir)


SQL_SCORES = (
    f"{SQL_LINES}, {SQL_RULES}, n AS (SELECT count(*) AS loc FROM l), d(dimension, weight) AS (VALUES " + ", ".join(f"('{d}', CAST({w} AS DOUBLE))" for d, w in rules.DIMENSIONS) + "), "
    "p AS (SELECT d.dimension, weight, count(i.file) AS issues, CAST(coalesce(sum(severity), 0) AS DOUBLE) AS penalty FROM d LEFT JOIN i ON d.dimension = i.dimension GROUP BY ALL), "
    "s AS (SELECT dimension, weight, issues, floor(penalty * 10 + 0.5) / 10 AS penalty, CAST(floor(greatest(0, least(100, 100 * exp(-0.06 * penalty / greatest(1, pow(log10(greatest(loc, 10)), 2))))) + 0.5) AS BIGINT) AS score FROM p, n)"
)


@of(f"WITH {SQL_SCORES} SELECT * FROM s")
def dimension_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues = doc_hits(spark, sf_dir).withColumn("blast", F.lit(1))
    counted = table(spark, sf_dir, "documents").filter("text is not null").agg(F.sum(F.size(F.split("text", "\n", -1))).alias("loc"))
    return score.dimension_scores(issues, F.coalesce(counted.scalar().cast("double"), F.lit(0.0)))


@of(f"WITH {SQL_SCORES} SELECT CAST(floor(sum(score * weight) + 0.5) AS BIGINT) AS overall FROM s")
def overall_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.overall_score(dimension_scores(spark, sf_dir))


@of(f"WITH {SQL_LINES} SELECT file, CAST(line AS INT) AS line, substr(trim(text), 1, 240) AS text FROM l WHERE contains(lower(text), 'license') ORDER BY file, line LIMIT 200")
def find_in_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_lines.find_in_files(doc_lines(spark, sf_dir), "License")


def _doc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").cast("string").alias("file"), F.col("source").alias("module"), F.col("lang").alias("language"), text_lines.line_count(F.col("text")).alias("loc"), (F.col("n_chars") % 3).alias("issues"), F.col("doc_id").alias("ord"), "doc_id")


SQL_DOCS = "f AS (SELECT doc_id, source AS module, lang AS language, CASE WHEN length(text) > 0 THEN len(string_split(text, chr(10))) ELSE 0 END AS loc, n_chars % 3 AS issues FROM documents)"


@of(f"WITH {SQL_DOCS} SELECT language, count(*) AS files, CAST(sum(loc) AS BIGINT) AS loc, min(doc_id) AS first FROM f GROUP BY language")
def language_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.language_stats(_doc_files(spark, sf_dir))


SQL_MODULES = f"{SQL_DOCS}, ml AS (SELECT module, language, count(*) AS n, min(doc_id) AS first, sum(loc) AS loc, sum(issues) AS issues FROM f GROUP BY ALL)"


@of(f"WITH {SQL_MODULES} SELECT module, CAST(sum(n) AS BIGINT) AS files, CAST(sum(loc) AS BIGINT) AS loc, CAST(sum(issues) AS BIGINT) AS issues, arg_max(language, n * 100000000 - first) AS language, min(first) AS first FROM ml GROUP BY module")
def modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.modules(_doc_files(spark, sf_dir))


# ---- links of pages ----


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select(F.col("page_id").cast("string").alias("source"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), 1)).alias("target"))


SQL_LINKS = "k AS (SELECT CAST(page_id AS VARCHAR) AS source, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS target FROM pages)"


@of(f"WITH {SQL_LINKS} SELECT target AS file, count(*) AS fan_in FROM k WHERE source <> target GROUP BY target")
def file_fan_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.file_fan_in(_links(spark, sf_dir))


@of(f"WITH {SQL_LINKS} SELECT node, count(*) AS degree FROM (SELECT source AS node FROM k UNION ALL SELECT target FROM k) GROUP BY node")
def degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.degrees(_links(spark, sf_dir))


@of(f"WITH {SQL_LINKS}, m AS (SELECT page_id % 7 AS a, 's' || (length(target) % 5) AS b FROM k JOIN pages ON source = CAST(page_id AS VARCHAR)) SELECT 'p' || a AS source, b AS target, count(*) AS weight FROM m GROUP BY ALL")
def module_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = _links(spark, sf_dir)
    a = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("file"), F.concat(F.lit("p"), (F.col("page_id") % 7).cast("string")).alias("module"))
    b = links.select(F.col("target").alias("file")).distinct().withColumn("module", F.concat(F.lit("s"), (F.length("file") % 5).cast("string")))
    return score.module_edges(links, a.unionByName(b))


# ---- a tree: region, nation, supplier ----


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, n, s = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    j = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.select(F.concat_ws("/", "r_name", "n_name", "s_name").alias("file"), F.floor(F.abs("s_acctbal")).cast("long").alias("loc"), (F.col("s_suppkey") % 4).alias("issues"))


SQL_PATHS = "p AS (SELECT r_name AS a, n_name AS b, s_name AS c, greatest(1, CAST(floor(abs(s_acctbal)) AS BIGINT)) AS loc, s_suppkey % 4 AS issues FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


@of(f"WITH {SQL_PATHS} SELECT '.' AS parent, a AS child, 1 AS depth FROM p UNION ALL SELECT a, a || '/' || b, 2 FROM p UNION ALL SELECT a || '/' || b, a || '/' || b || '/' || c, 3 FROM p")
def containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.containment(_paths(spark, sf_dir))


@of(f"WITH {SQL_PATHS}, t AS (SELECT '.' AS path, NULL AS parent, 0 AS depth, loc, issues FROM p UNION ALL SELECT a, '.', 1, loc, issues FROM p UNION ALL SELECT a || '/' || b, a, 2, loc, issues FROM p UNION ALL SELECT a || '/' || b || '/' || c, a || '/' || b, 3, loc, issues FROM p) SELECT path, CAST(parent AS VARCHAR) AS parent, depth, count(*) AS files, CAST(sum(loc) AS BIGINT) AS loc, CAST(sum(issues) AS BIGINT) AS issues FROM t GROUP BY ALL")
def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.tree(_paths(spark, sf_dir))


@of(f"WITH {SQL_PATHS}, n AS (SELECT a, count(*) AS k FROM p GROUP BY a) SELECT p.a || '/' || b || '/' || c AS file, CASE WHEN k > 12 THEN p.a || '/' || b ELSE p.a END AS module FROM p JOIN n ON p.a = n.a")
def module_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.module_of(_paths(spark, sf_dir).select("file"))


# ---- the call graph ----


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, n): parts on following returned lines of an order."""
    li = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'")
    at = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    pairs = li.select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(at).alias("dst")).filter("src <> dst")
    return pairs.groupBy("src", "dst").agg(F.count("*").alias("n"))


def _sql_calls() -> str:
    return "c AS (SELECT src, dst, count(*) AS n FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst FROM lineitem WHERE l_returnflag = 'R') WHERE src <> dst GROUP BY ALL)"


def _symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _calls(spark, sf_dir)
    ins, outs = c.groupBy(F.col("dst").alias("id")).agg(F.sum(F.least("n", F.lit(5))).alias("fan_in")), c.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("fan_out"))
    kinds = F.element_at(F.array(*map(F.lit, ("function", "method", "class", "component"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    p = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), kinds.alias("kind"), F.col("p_type").alias("signature"), F.lit(None).cast("string").alias("doc"), (F.col("p_size") % 2 == 0).alias("exported"),
        F.array(F.lower("p_brand")).alias("tags"), F.lit(None).cast("string").alias("container"), F.col("p_partkey").alias("ord"), F.concat(F.lit("f"), (F.col("p_partkey") % 50).cast("string")).alias("file"), F.col("p_size").alias("line"), F.col("p_size").alias("complexity"), F.lit(1).alias("churn"),
    )
    return p.join(ins, "id", "left").join(outs, "id", "left").na.fill(0, ["fan_in", "fan_out"])


def _sql_symbols() -> str:
    return f"""{_sql_calls()}, fi AS (SELECT dst AS id, sum(least(n, 5)) AS fan_in FROM c GROUP BY dst), fo AS (SELECT src AS id, count(*) AS fan_out FROM c GROUP BY src),
s AS (SELECT p_partkey AS id, p_name AS name, ['function', 'method', 'class', 'component'][p_partkey % 4 + 1] AS kind, p_type AS signature, p_size % 2 = 0 AS exported, lower(p_brand) AS tag, p_size AS line, p_size AS complexity,
      'f' || (p_partkey % 50) AS file, CAST(coalesce(fan_in, 0) AS BIGINT) AS fan_in, CAST(coalesce(fan_out, 0) AS BIGINT) AS fan_out FROM part LEFT JOIN fi ON p_partkey = fi.id LEFT JOIN fo ON p_partkey = fo.id)"""


@of(f"WITH {_sql_symbols()} SELECT id, fan_in, fan_out FROM s")
def call_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _symbols(spark, sf_dir).select("id", "fan_in", "fan_out")


@of(f"WITH {_sql_symbols()} SELECT id, name, fan_in, fan_out FROM s ORDER BY fan_in + fan_out DESC, id LIMIT 15")
def hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query.hubs(_symbols(spark, sf_dir)).select("id", "name", "fan_in", "fan_out")


@of(f"WITH {_sql_symbols()} SELECT id, kind FROM s WHERE kind IN ('function', 'method') AND fan_in = 0 AND NOT regexp_matches(name, '{rules.ENTRY_POINTS}')")
def dead_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query.dead_code(_symbols(spark, sf_dir)).select("id", "kind")


def _score_sql(q: str) -> str:
    return f"""WITH {_sql_symbols()}, r AS (SELECT id, CASE WHEN lower(name) = '{q}' THEN 100 WHEN starts_with(lower(name), '{q}') THEN 70 WHEN contains(lower(name), '{q}') THEN 45 WHEN tag = '{q}' THEN 35 WHEN contains(lower(signature), '{q}') THEN 20 END
+ least(15, fan_in) + CASE WHEN exported THEN 5 ELSE 0 END AS score FROM s) SELECT id, CAST(score AS BIGINT) AS score FROM r WHERE score IS NOT NULL ORDER BY score DESC, id LIMIT 30"""


@of(_score_sql("ring"))
def symbol_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query.search(_symbols(spark, sf_dir), "ring").select("id", F.col("score").cast("long").alias("score"))


@of(f"""WITH {_sql_symbols()}, q AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS query FROM part WHERE p_partkey % 100 = 0),
r AS (SELECT query, id, CASE WHEN lower(name) = query THEN 100 WHEN starts_with(lower(name), query) THEN 70 WHEN contains(lower(name), query) THEN 45 WHEN tag = query THEN 35 WHEN contains(lower(signature), query) THEN 20 END
+ least(15, fan_in) + CASE WHEN exported THEN 5 ELSE 0 END AS score FROM s, q), n AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM r WHERE score IS NOT NULL)
SELECT query, CAST(rank AS INT) AS rank, id, CAST(score AS BIGINT) AS score FROM n WHERE rank <= 30""")
def symbol_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search for the first word of every part's name whose id is divisible by 100."""
    asked = table(spark, sf_dir, "part").filter("p_partkey % 100 = 0").select(F.get(F.split("p_name", " "), F.lit(0)).alias("query"))
    return query.searches(_symbols(spark, sf_dir), asked).select("query", "rank", "id", F.col("score").cast("long").alias("score"))


def _call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calls(spark, sf_dir).select("src", "dst", F.lit("calls").alias("kind"))


@of(f"WITH {_sql_calls()} SELECT dst AS of, src AS id FROM c")
def callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _symbols(spark, sf_dir).select("id", "name")
    return query.callers(s, _call_edges(spark, sf_dir), s).select("of", "id")


@of(f"WITH {_sql_calls()} SELECT src AS of, dst AS id FROM c")
def callees(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _symbols(spark, sf_dir).select("id", "name")
    return query.callees(s, _call_edges(spark, sf_dir), s).select("of", "id")


def _sql_reach(a: str, b: str) -> str:
    return f"WITH RECURSIVE {_sql_calls()}, r AS (SELECT p_partkey AS seed, p_partkey AS node, 0 AS hops FROM part UNION SELECT r.seed, c.{b}, r.hops + 1 FROM r JOIN c ON r.node = c.{a} WHERE r.hops < 3) SELECT seed, node, CAST(min(hops) AS INT) AS hops FROM r GROUP BY ALL HAVING node <> seed"


def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("seed"))


@of(_sql_reach("src", "dst"))
def reachable_callees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reach(_calls(spark, sf_dir).select("src", "dst"), _seeds(spark, sf_dir))


@of(_sql_reach("dst", "src"))
def impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.impact(_calls(spark, sf_dir).select("src", "dst"), _seeds(spark, sf_dir))


@of(f"WITH RECURSIVE {_sql_calls()}, e AS (SELECT src AS a, dst AS b FROM c UNION SELECT dst, src FROM c), r AS (SELECT a AS node, a AS other FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.other = e.a) SELECT node, min(other) AS label FROM r GROUP BY node")
def weak_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.weak_components(_calls(spark, sf_dir).select("src", "dst"))


@of(f"WITH RECURSIVE {_sql_calls()}, r AS (SELECT src AS a, dst AS b FROM c UNION SELECT r.a, c.dst FROM r JOIN c ON r.b = c.src), m AS (SELECT x.a, x.b FROM r x JOIN r y ON x.a = y.b AND x.b = y.a), g AS (SELECT a AS node, min(b) AS label FROM m GROUP BY a), t AS (SELECT least(node, label) AS label, node FROM g) SELECT node, label FROM t WHERE label IN (SELECT label FROM t GROUP BY label HAVING count(*) > 1)")
def strong_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.strong_components(_calls(spark, sf_dir).select("src", "dst"))


@of(f"WITH RECURSIVE {_sql_calls()}, d AS (SELECT src, dst FROM c WHERE src < dst), r AS (SELECT dst AS node, 0 AS tier FROM d UNION SELECT d.src, r.tier + 1 FROM r JOIN d ON r.node = d.dst) SELECT node, CAST(max(tier) AS INT) AS tier FROM r GROUP BY node")
def tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.tiers(_calls(spark, sf_dir).filter("src < dst").select("src", "dst"))


# ---- findings ----


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    agent = F.element_at(F.array(*map(F.lit, swarm.AGENTS)), (F.col("l_linenumber") % 7 + 1).cast("int"))
    li = table(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_suppkey").orderBy("l_partkey", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate")
    return li.select(
        agent.alias("agent"), (F.col("l_quantity") % 5 + 1).cast("int").alias("severity"), (F.col("l_discount") * 4 + 0.5).alias("confidence"), F.concat(F.lit("t"), F.col("l_orderkey").cast("string")).alias("title"), F.col("l_suppkey").cast("string").alias("file"), F.col("l_partkey").cast("int").alias("line"),
        F.lit(None).cast("string").alias("symbol"), (1 + F.col("l_orderkey") % 9).alias("blast"), (1 + F.col("l_orderkey") % 4).alias("churn"), F.element_at(F.array(F.lit("S"), F.lit("M"), F.lit("L")), (F.col("l_orderkey") % 3 + 1).cast("int")).alias("effort"), F.row_number().over(order).cast("long").alias("ord"), (F.col("l_linenumber") % 7).alias("agent_ord"),
    )


SQL_FINDINGS = """fd AS (SELECT ['security', 'performance', 'refactor', 'deadcode', 'dependency', 'architecture', 'test'][l_linenumber % 7 + 1] AS agent, CAST(l_quantity % 5 + 1 AS INT) AS severity, l_discount * 4 + 0.5 AS confidence, 't' || l_orderkey AS title, CAST(l_suppkey AS VARCHAR) AS file, CAST(l_partkey AS INT) AS line,
1 + l_orderkey % 9 AS blast, 1 + l_orderkey % 4 AS churn, ['S', 'M', 'L'][l_orderkey % 3 + 1] AS effort, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey, l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_shipdate) AS ord, l_linenumber % 7 AS agent_ord FROM lineitem),
g0 AS (SELECT *, CASE WHEN line - lag(line) OVER w > 2 THEN 1 WHEN lag(line) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM fd WINDOW w AS (PARTITION BY file ORDER BY line, agent_ord, ord)),
g1 AS (SELECT *, sum(new) OVER (PARTITION BY file ORDER BY line, agent_ord, ord ROWS UNBOUNDED PRECEDING) AS grp FROM g0),
g2 AS (SELECT *, row_number() OVER (PARTITION BY file, grp ORDER BY severity DESC, line, agent_ord, ord) AS rk, first_value(agent) OVER (PARTITION BY file, grp ORDER BY severity DESC, line, agent_ord, ord) AS lead_agent FROM g1),
g3 AS (SELECT file, grp, count(*) FILTER (agent <> lead_agent) AS others FROM g2 GROUP BY ALL),
cr AS (SELECT g2.*, others, least(1.0, confidence + 0.15 * others) AS sure FROM g2 JOIN g3 ON g2.file = g3.file AND g2.grp = g3.grp WHERE rk = 1),
jd AS (SELECT *, CAST(floor(severity * (1 + log2(1 + blast)) * (1 + log10(1 + churn)) * sure * CASE effort WHEN 'S' THEN 1.15 WHEN 'L' THEN 0.85 ELSE 1.0 END * 10 + 0.5) AS BIGINT) AS score FROM cr),
jp AS (SELECT *, CASE WHEN agent = 'security' AND severity >= 4 THEN 'P0' WHEN score >= 70 THEN 'P0' WHEN score >= 40 THEN 'P1' WHEN score >= 20 THEN 'P2' ELSE 'P3' END AS priority FROM jd)"""


@of(f"WITH {SQL_FINDINGS} SELECT file, line, ord, agent, severity, round(sure, 6) AS confidence FROM cr")
def critic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return swarm.critic(_findings(spark, sf_dir)).select("file", "line", "ord", "agent", "severity", F.round("confidence", 6).alias("confidence"))


@of(f"WITH {SQL_FINDINGS} SELECT file, line, ord, score, priority FROM jp ORDER BY score DESC, file, line, agent_ord, ord LIMIT 60")
def judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return swarm.judge(swarm.critic(_findings(spark, sf_dir))).select("file", "line", "ord", "score", "priority")


@of(f"WITH {SQL_FINDINGS}, o AS (SELECT count(*) FILTER (priority = 'P0') AS p0, count(*) FILTER (priority = 'P1') AS p1, count(*) FILTER (priority = 'P2') AS p2, count(*) FILTER (priority = 'P3') AS p3, count(DISTINCT agent) AS specialists FROM jp) SELECT *, CAST(least(100, 62 + least(100 - 62, floor(2.2 * p0 + 1.1 * p1 + 0.5))) AS BIGINT) AS projected FROM o")
def remediation_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return swarm.plan(swarm.judge(swarm.critic(_findings(spark, sf_dir)), None), 62)


@of(f"WITH {SQL_FINDINGS}, a(agent) AS (VALUES " + ", ".join(f"('{a}')" for a in swarm.AGENTS) + "), n AS (SELECT agent, count(*) AS findings FROM fd GROUP BY agent) SELECT a.agent, coalesce(findings, 0) AS findings FROM a LEFT JOIN n ON a.agent = n.agent")
def agent_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return swarm.reports(_findings(spark, sf_dir)).select("agent", "findings")


def _issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_suppkey").cast("string").alias("file"), (1 + F.col("l_linenumber") % 5).alias("severity"), (1 + F.col("l_partkey") % 7).alias("blast"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int")).alias("ord"))


SQL_ISSUES = "i AS (SELECT CAST(l_suppkey AS VARCHAR) AS file, 1 + l_linenumber % 5 AS severity, 1 + l_partkey % 7 AS blast, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INT)) AS ord FROM lineitem)"


@of(f"WITH {SQL_ISSUES} SELECT file, count(*) AS issues, max(severity) AS max_severity FROM i GROUP BY file")
def issues_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.issues_by_file(_issues(spark, sf_dir))


@of(f"WITH {SQL_ISSUES} SELECT file, ord, severity * blast AS weight FROM i ORDER BY severity * blast DESC, ord LIMIT 200")
def ranked_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.ranked_issues(_issues(spark, sf_dir)).select("file", "ord", (F.col("severity") * F.col("blast")).alias("weight"))


# ---- timelines ----


def _commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("repo"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("ts"), F.col("o_orderkey").alias("seq"), F.concat(F.lit("h"), F.col("o_orderkey").cast("string")).alias("hash"), F.when(F.col("o_orderpriority").startswith("1"), F.array(F.lit("tag: v1"))).otherwise(F.array().cast("array<string>")).alias("refs"))


SQL_COMMITS = "k AS (SELECT o_custkey AS repo, CAST(epoch(o_orderdate) AS BIGINT) AS ts, o_orderkey AS seq, o_orderpriority AS pr, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i, count(*) OVER (PARTITION BY o_custkey) AS m FROM orders)"
SQL_PERIODIC = f"RECURSIVE {SQL_COMMITS}, p AS (SELECT repo, i, ts AS last, true AS kept FROM k WHERE i = 1 UNION ALL SELECT k.repo, k.i, CASE WHEN k.ts - p.last >= 2592000 THEN k.ts ELSE p.last END, k.ts - p.last >= 2592000 FROM p JOIN k ON k.repo = p.repo AND k.i = p.i + 1), q AS (SELECT k.repo, k.seq, k.ts FROM k JOIN p ON k.repo = p.repo AND k.i = p.i WHERE p.kept OR k.i = k.m)"


@of(f"WITH {SQL_PERIODIC} SELECT repo, seq, ts FROM q")
def periodic_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.periodic(_commits(spark, sf_dir), timeline.MONTHLY).select("repo", "seq", "ts")


@of(f"WITH {SQL_PERIODIC} SELECT repo, seq FROM q UNION SELECT repo, seq FROM k WHERE starts_with(pr, '1')")
def adaptive_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.adaptive(_commits(spark, sf_dir)).select("repo", "seq")


@of(f"WITH {SQL_COMMITS} SELECT repo, seq FROM k WHERE (i - 1) % 3 = 0")
def every_third_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.every(_commits(spark, sf_dir), 3).select("repo", "seq")


@of(f"WITH {SQL_COMMITS}, v AS (SELECT repo, seq, lag(seq) OVER (PARTITION BY repo ORDER BY i) AS before FROM k) SELECT repo, seq, CASE WHEN before % 2 = 0 THEN 'h' || before END AS previous FROM v")
def previous_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _commits(spark, sf_dir)
    return timeline.with_previous(c, c.filter("seq % 2 = 0")).select("repo", "seq", "previous")


@of("SELECT CAST(user_id AS VARCHAR) AS file, count(*) AS commits FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 14 DAY GROUP BY user_id")
def churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("file"), "ts")
    return timeline.churn(e, F.expr("TIMESTAMP_NTZ '2024-01-31 00:00:00'"), "interval 14 days")


def _months(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_suppkey").cast("string").alias("file"), F.col("l_returnflag").alias("title"), F.date_format("l_shipdate", "yyyy-MM").alias("m"))
    return li.filter("m = '1996-03'").drop("m"), li.filter("m = '1996-04'").drop("m")


SQL_MONTHS = "o AS (SELECT l_partkey AS id, CAST(l_suppkey AS VARCHAR) AS file, l_returnflag AS title FROM lineitem WHERE strftime(l_shipdate, '%Y-%m') = '1996-03'), n AS (SELECT l_partkey AS id, CAST(l_suppkey AS VARCHAR) AS file, l_returnflag AS title FROM lineitem WHERE strftime(l_shipdate, '%Y-%m') = '1996-04')"


@of(f"WITH {SQL_MONTHS} SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'modified' END AS change FROM (SELECT DISTINCT id FROM o) a FULL JOIN (SELECT DISTINCT id FROM n) b ON a.id = b.id")
def node_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.node_diff(*_months(spark, sf_dir))


@of(f"WITH {SQL_MONTHS} SELECT id, file, 'added' AS change FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.id = n.id AND o.file = n.file) UNION ALL SELECT id, file, 'removed' FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE o.id = n.id AND o.file = n.file)")
def edge_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _months(spark, sf_dir)
    return timeline.edge_diff(a, b, "id", "file").select("id", "file", "change")


@of(f"WITH {SQL_MONTHS} SELECT file, title, 'introduced' AS change FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.title = n.title AND o.file = n.file) UNION ALL SELECT file, title, 'resolved' FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE o.title = n.title AND o.file = n.file)")
def issue_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.issue_diff(*_months(spark, sf_dir)).select("file", "title", "change")


SQL_HEALTH = f"WITH {SQL_MONTHS}, a AS (SELECT file AS module, count(*) AS loc, count(*) FILTER (title = 'R') AS issues FROM o GROUP BY file), b AS (SELECT file AS module, count(*) AS loc, count(*) FILTER (title = 'R') AS issues FROM n GROUP BY file) SELECT b.module, b.loc - coalesce(a.loc, 0) AS growth, greatest(0, least(100, 100 - coalesce(greatest(0, b.issues - a.issues) * 10, 0))) AS stability, greatest(0, 100 - b.issues * 5) AS health FROM b LEFT JOIN a ON a.module = b.module"


@of(SQL_HEALTH)
def module_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = lambda m: m.groupBy(F.col("file").alias("module")).agg(F.count("*").alias("loc"), F.count_if(F.col("title") == "R").alias("issues"))
    a, b = _months(spark, sf_dir)
    return timeline.module_health(per(a), per(b))


@of(f"WITH {_sql_symbols()} SELECT count(*) AS symbols, count(*) FILTER (kind IN ('function', 'method', 'component')) AS callables, count(*) FILTER (kind = 'class') AS classes, round(sum(complexity) / count(*), 6) AS avg_complexity, max(complexity) AS max_complexity, round(sum(fan_in) / count(*), 6) AS avg_fan_in, round(sum(fan_out) / count(*), 6) AS avg_fan_out, count(*) FILTER (fan_in = 0) AS orphans FROM s")
def snapshot_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = score.snapshot_metrics(_symbols(spark, sf_dir))
    return m.select("symbols", "callables", "classes", *[F.round(c, 6).alias(c) for c in ("avg_complexity", "avg_fan_in", "avg_fan_out")], "max_complexity", "orphans")


# ---- versions and evidence ----


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    rows = e.select(F.concat_ws(":", "user_id", "event_type").alias("id"), "ts", "event_id").groupBy("id", F.col("ts").alias("valid_from")).agg(F.min("event_id").alias("event_id"))
    return temporal.history(rows)


SQL_VERSIONS = "v AS (SELECT id, valid_from, event_id, lead(valid_from) OVER w AS valid_to, CAST(row_number() OVER w AS INT) AS version FROM (SELECT concat_ws(':', user_id, event_type) AS id, ts AS valid_from, min(event_id) AS event_id FROM events GROUP BY ALL) WINDOW w AS (PARTITION BY id ORDER BY valid_from))"


@of(f"WITH {SQL_VERSIONS} SELECT id, event_id, version FROM v")
def version_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _versions(spark, sf_dir).select("id", "event_id", "version")


@of(f"WITH {SQL_VERSIONS} SELECT id, event_id FROM v WHERE valid_from <= TIMESTAMP '2024-01-15' AND (valid_to IS NULL OR valid_to > TIMESTAMP '2024-01-15')")
def as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.as_of(_versions(spark, sf_dir), F.expr("TIMESTAMP_NTZ '2024-01-15 00:00:00'")).select("id", "event_id")


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return d.join(lab, "doc_id").select(F.col("lang").alias("claim"), F.when(F.col("quality") == 1, "SUPPORTS").otherwise("CONTRADICTS").alias("rel"), F.col("source").alias("root"), ((F.col("n_chars") % 90) / 1000.0).alias("confidence"))


SQL_EVIDENCE = "e AS (SELECT lang AS claim, CASE WHEN quality = 1 THEN 'SUPPORTS' ELSE 'CONTRADICTS' END AS rel, source AS root, CAST(n_chars % 90 AS DOUBLE) / 1000 AS confidence FROM documents JOIN labels ON documents.doc_id = labels.doc_id)"


@of(f"WITH {SQL_EVIDENCE}, b AS (SELECT claim, rel, root, max(confidence) AS c FROM e GROUP BY ALL), t AS (SELECT claim, 1 - coalesce(product(1 - c) FILTER (rel = 'SUPPORTS'), 1) AS s, 1 - coalesce(product(1 - c) FILTER (rel = 'CONTRADICTS'), 1) AS x FROM b GROUP BY claim) SELECT claim, round(s, 6) AS supported, round(x, 6) AS contradicted, round(s - x, 6) AS net FROM t")
def net_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.net_support(_evidence(spark, sf_dir)).select("claim", *[F.round(c, 6).alias(c) for c in ("supported", "contradicted", "net")])


@of(f"WITH {SQL_EVIDENCE} SELECT claim, count(*) FILTER (rel = 'SUPPORTS') AS supports, count(*) FILTER (rel = 'CONTRADICTS') AS contradicts FROM e GROUP BY claim")
def conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.conflicts(_evidence(spark, sf_dir))


@of("WITH q AS (SELECT vec_id AS query, embedding AS q FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query, vec_id AS id, round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])) / (sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(q AS DOUBLE[]), CAST(q AS DOUBLE[])))), 6) AS score FROM embeddings, q) SELECT query, id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 10")
def semantic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    asked = e.filter("id % 100 = 0").select(F.col("id").alias("query"), F.col("v").alias("q"))
    return temporal.semantic_search(e, asked, 10)


@of("SELECT sha256(text) AS content_hash, min(doc_id) AS first, count(*) AS copies FROM documents GROUP BY ALL")
def content_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))


@of("WITH d AS (SELECT DISTINCT sha256(text) AS content_hash, doc_id % 2 AS half FROM documents) SELECT content_hash FROM d GROUP BY ALL")
def idempotent_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("content_hash"), (F.col("doc_id") % 2).alias("half"))
    part = lambda k: d.filter(F.col("half") == k).select("content_hash")
    return temporal.insert_new(temporal.insert_new(part(0).limit(0), part(0)), part(1))


# ---- budgets, repositories ----


@of("WITH RECURSIVE t AS (SELECT conv_id, turn, CAST(ceil(length(text) / 4.0) AS BIGINT) AS cost, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS i FROM conversations), r AS (SELECT conv_id, 0::BIGINT AS i, 0::BIGINT AS used, false AS hit, 0::BIGINT AS n FROM (SELECT DISTINCT conv_id FROM t) UNION ALL SELECT t.conv_id, t.i, CASE WHEN r.n < 4 AND r.used + t.cost <= 300 THEN r.used + t.cost ELSE r.used END, r.n < 4 AND r.used + t.cost <= 300, CASE WHEN r.n < 4 AND r.used + t.cost <= 300 THEN r.n + 1 ELSE r.n END FROM r JOIN t ON t.conv_id = r.conv_id AND t.i = r.i + 1) SELECT t.conv_id, t.turn, r.used FROM r JOIN t ON t.conv_id = r.conv_id AND t.i = r.i WHERE r.hit")
def token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumn("cost", token_estimate(F.col("text")))
    return query.within_budget(c, ["conv_id"], [F.col("turn"), F.col("text")], "cost", 300, 4).select("conv_id", "turn", "used")


@of("WITH r AS (SELECT n_nationkey AS id, lower(r_name) || '/' || n_name AS name, CASE WHEN n_nationkey % 3 = 0 THEN r_name || '/' || n_name ELSE n_name END AS called, n_nationkey % 6 AS created FROM nation JOIN region ON n_regionkey = r_regionkey), d AS (SELECT a.id AS source, b.called AS dep FROM r a JOIN r b ON b.id IN ((a.id + 1) % 25, (a.id * 7 + 3) % 25, a.id)), h AS (SELECT source, dep, id AS target, created FROM d JOIN r ON (lower(name) = lower(dep) OR ends_with(lower(name), '/' || lower(dep))) AND id <> source) SELECT source, dep, target FROM h QUALIFY row_number() OVER (PARTITION BY source, dep ORDER BY created DESC, target DESC) = 1")
def fleet_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    r = n.select(F.col("n_nationkey").alias("id"), F.concat(F.lower("r_name"), F.lit("/"), "n_name").alias("name"), F.when(F.col("n_nationkey") % 3 == 0, F.concat("r_name", F.lit("/"), "n_name")).otherwise(F.col("n_name")).alias("called"), (F.col("n_nationkey") % 6).alias("created_at"))
    wants = r.select("id", F.explode(F.array((F.col("id") + 1) % 25, (F.col("id") * 7 + 3) % 25, F.col("id"))).alias("dep_id")).distinct()
    deps = wants.join(r.select(F.col("id").alias("dep_id"), "called"), "dep_id").groupBy("id").agg(F.collect_set("called").alias("deps"))
    return fleet.links(r.join(deps, "id"))


@of("SELECT c_custkey AS id FROM customer WHERE c_nationkey % 5 = 0 OR c_nationkey = 7 ORDER BY c_acctbal DESC, c_custkey LIMIT 100")
def visible_repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_nationkey") % 5 != 0, F.col("c_nationkey")).alias("owner_id"), F.col("c_acctbal").alias("created_at"))
    return visible(c, 7).select("id")
