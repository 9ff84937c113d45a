"""Queries over views, walks as of a time and what follows from diffs, each with its SQL. Views are drawn from nations, a table that doesn't grow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlake.functions import scalars
from graphlake.operators import fix, graph, layout, query, score, temporal, timeline
from graphlake.operators import lines as text_lines
from graphlake.operators.graph import settled
from graphlake.plans.code import SQL_CODE, _index, _lines, source_files
from graphlake.plans.tables import SQL_MONTHS, _calls, _months, _sql_calls, of, table

# ---- drawings ----

BOX = 200.0, 60.0
PLACES = "SELECT n_nationkey AS node, CAST(n_nationkey % 7 * 90 AS DOUBLE) AS x, CAST(n_nationkey * 37 % 11 * 50 AS DOUBLE) AS y, n_regionkey AS label FROM nation"


@of(f"""WITH RECURSIVE p AS ({PLACES}), b AS (SELECT label, min(x) - 100 AS l, min(y) - 30 AS t, max(x) - min(x) + 200 AS w, max(y) - min(y) + 60 AS h, min(node) AS first FROM p GROUP BY label),
o AS (SELECT *, row_number() OVER (ORDER BY h DESC, first) AS n FROM b), f AS (SELECT greatest((SELECT w FROM o WHERE n = 1), 1.5 * sqrt(sum((w + 100) * (h + 100)))) AS wide FROM b),
s AS (SELECT n, label, l, t, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, h AS tall, w + 100 AS nx FROM o WHERE n = 1
UNION ALL SELECT o.n, o.label, o.l, o.t, CASE WHEN nx + o.w > wide THEN 0 ELSE nx END, CASE WHEN nx + o.w > wide THEN s.y + tall + 100 ELSE s.y END, CASE WHEN nx + o.w > wide THEN o.h ELSE greatest(tall, o.h) END,
CASE WHEN nx + o.w > wide THEN 0 ELSE nx END + o.w + 100 FROM s JOIN o ON o.n = s.n + 1, f),
m AS (SELECT node, p.x + s.x - l AS x, p.y + s.y - t AS y FROM p JOIN s ON p.label = s.label)
SELECT node, round(x - (SELECT avg(x) FROM m), 6) AS x, round(y - (SELECT avg(y) FROM m), 6) AS y FROM m""")
def shelf_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations, those of a region linked in a chain; the components are found, not given."""
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    nodes = n.select(k.alias("node"), (k % 7 * 90).cast("double").alias("x"), (k * 37 % 11 * 50).cast("double").alias("y"))
    chain = n.groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_nationkey")).alias("ks"))
    links = chain.select(F.explode(F.arrays_zip(F.slice("ks", 1, F.size("ks") - 1).alias("src"), F.slice("ks", 2, F.size("ks")).alias("dst"))).alias("e")).select("e.src", "e.dst")
    return layout.packed(nodes, graph.weak_components(links), *BOX).select("node", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def _row(tier: int, above: int) -> str:
    return f"""b{tier} AS (SELECT k, coalesce(avg(pos), 1e9) AS mean FROM nd LEFT JOIN (SELECT a, pos FROM bo JOIN r{above} ON b = r{above}.k) e ON a = nd.k WHERE tier = {tier} GROUP BY k),
r{tier} AS (SELECT k, row_number() OVER (ORDER BY mean, k) - 1 AS pos FROM b{tier})"""


@of(f"""WITH nd AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey < 3 THEN 2 WHEN n_nationkey < 14 THEN 1 ELSE 0 END AS tier FROM nation),
ed AS (SELECT k AS a, (k * 7 + 3) % 25 AS b FROM nd UNION ALL SELECT k, (k * 5 + 1) % 25 FROM nd), bo AS (SELECT a, b FROM ed UNION ALL SELECT b, a FROM ed),
r2 AS (SELECT k, row_number() OVER (ORDER BY k) - 1 AS pos FROM nd WHERE tier = 2), {_row(1, 2)}, {_row(0, 1)},
al AS (SELECT 2 AS tier, * FROM r2 UNION ALL SELECT 1, * FROM r1 UNION ALL SELECT 0, * FROM r0),
c AS (SELECT tier, count(*) AS n, ceil(count(*) / 8.0) AS subs FROM al GROUP BY tier), u AS (SELECT tier, n, coalesce(sum(subs) OVER (ORDER BY tier DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS up FROM c),
w AS (SELECT 120 + least(8, max(n)) * 200 + (least(8, max(n)) - 1) * 40 AS width, sum(subs) AS total FROM c),
l AS (SELECT k, pos, up + pos // 8 AS line, least(8, n - pos // 8 * 8) AS len FROM al JOIN u ON al.tier = u.tier)
SELECT k AS node, CAST((width - len * 200 - (len - 1) * 40) / 2 + pos % 8 * 240 + 100 AS DOUBLE) AS x, CAST(50 + line * 90 + 30 AS DOUBLE) AS y, CAST(width AS DOUBLE) AS width, CAST(50 + total * 90 - 30 + 50 AS DOUBLE) AS height FROM l, w""")
def layered_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    n = table(spark, sf_dir, "nation")
    nodes = n.select(k.alias("node"), F.when(k < 3, 2).when(k < 14, 1).otherwise(0).alias("tier"), k.alias("ord"))
    link = lambda to: n.select(k.alias("source"), (to % 25).alias("target"))
    return layout.layered(nodes, link(k * 7 + 3).unionByName(link(k * 5 + 1)), *BOX, 40, 30)


@of("""WITH RECURSIVE m AS (SELECT n_nationkey AS k, count(c_custkey) AS loc FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL), e AS (SELECT k AS a, (k * k + 3) % 25 AS b FROM m WHERE k <> (k * k + 3) % 25),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), d AS (SELECT a, b FROM e WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.a = e.b AND r.b = e.a)),
t AS (SELECT k, 0 AS tier FROM m UNION SELECT d.a, tier + 1 FROM t JOIN d ON t.k = d.b)
SELECT 'n' || m.k AS module, loc, CAST(max(tier) AS INT) AS tier FROM m JOIN t ON m.k = t.k GROUP BY ALL""")
def ordered_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as modules of their customers; the edges hold cycles."""
    name = lambda c: F.concat(F.lit("n"), c.cast("string"))
    k = F.col("n_nationkey")
    own = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "customer"), k == F.col("c_nationkey"), "left").groupBy(k).agg(F.count("c_custkey").alias("loc"))
    edges = own.filter(k != (k * k + 3) % 25).select(name(k).alias("source"), name((k * k + 3) % 25).alias("target"))
    return score.ordered_modules(own.select(name(k).alias("module"), "loc", k.alias("first")), edges).select("module", "loc", "tier")


# ---- walks as of a time ----


def _span(start: Column, ends: Column) -> list[Column]:
    return [start.alias("valid_from"), F.when(ends % 3 == 0, 6).alias("valid_to")]


def _dated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(calls with rel and validity, parts as nodes with validity)."""
    rel = F.when((F.col("src") + F.col("dst")) % 4 == 0, "imports").otherwise("calls")
    edges = _calls(spark, sf_dir).select("src", "dst", rel.alias("rel"), *_span(F.col("src") % 5, F.col("dst")))
    k = F.col("p_partkey")
    return edges, table(spark, sf_dir, "part").select(k.alias("node"), *_span(k % 8, k + 1))


AT, WALKED = 4, ["calls"]
SQL_DATED = f"""{_sql_calls()}, ed AS (SELECT src, dst, src % 5 AS f, CASE WHEN dst % 3 = 0 THEN 6 END AS t FROM c WHERE (src + dst) % 4 <> 0), le AS (SELECT src, dst FROM ed WHERE f <= {AT} AND (t IS NULL OR t > {AT})),
ln AS (SELECT p_partkey AS node FROM part WHERE p_partkey % 8 <= {AT}), st AS (SELECT src, dst FROM le WHERE dst IN (SELECT node FROM ln)), sd AS (SELECT node AS seed FROM ln WHERE node % 100 = 0)"""
SQL_WALK = f"{SQL_DATED}, r AS (SELECT seed, seed AS node, 0 AS hops FROM sd UNION SELECT seed, st.dst, hops + 1 FROM r JOIN st ON node = src WHERE hops < 2), q AS (SELECT seed, node, min(hops) AS hops FROM r GROUP BY ALL), k AS (SELECT *, count(*) OVER (PARTITION BY seed) > 256 AS truncated, row_number() OVER (PARTITION BY seed ORDER BY hops, node) AS n FROM q)"


def _walk(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    edges, nodes = _dated(spark, sf_dir)
    seeds = nodes.filter("node % 100 = 0").select(F.col("node").alias("seed"))
    return edges, graph.neighbours(edges, seeds, 2, rels=WALKED, nodes=nodes, at=AT)


@of(f"WITH RECURSIVE {SQL_WALK} SELECT seed, node, CAST(hops AS INT) AS hops, truncated FROM k WHERE n <= 256")
def neighbours_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _walk(spark, sf_dir)[1]


@of(f"WITH RECURSIVE {SQL_WALK} SELECT DISTINCT seed, src, dst FROM k JOIN le ON node = src WHERE n <= 256 AND hops < 2")
def walked_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, found = _walk(spark, sf_dir)
    return graph.walked_edges(edges, found, 2, rels=WALKED, at=AT)


SQL_TREES = f"""{SQL_DATED}, r AS (SELECT seed, seed AS node, 0 AS hops FROM sd UNION SELECT seed, st.dst, hops + 1 FROM r JOIN st ON node = st.src WHERE hops < 16),
d AS MATERIALIZED (SELECT seed, node, min(hops) AS hops FROM r GROUP BY ALL),
p AS (SELECT seed, seed AS node, 0 AS hops, [seed] AS path FROM sd UNION ALL
SELECT p.seed, d.node, p.hops + 1, list_append(min(path), d.node) FROM p JOIN st ON p.node = st.src JOIN d ON d.seed = p.seed AND d.node = st.dst AND d.hops = p.hops + 1 GROUP BY p.seed, d.node, p.hops)"""


@of(f"WITH RECURSIVE {SQL_TREES} SELECT seed AS src, node AS dst, hops, array_to_string(path, '>') AS path FROM p")
def causal_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From every live part whose id is divisible by 100 to every live part that it reaches, with the path."""
    edges, nodes = _dated(spark, sf_dir)
    seeds = nodes.filter("node % 100 = 0").select(F.col("node").alias("seed"))
    return graph.paths_from(edges, seeds, rels=WALKED, nodes=nodes, at=AT).select("src", "dst", (F.size("path") - 1).alias("hops"), F.array_join("path", ">").alias("path"))


@of(f"""WITH RECURSIVE {SQL_TREES}, pr AS (SELECT seed, node FROM sd JOIN ln ON node BETWEEN seed AND seed + 60)
SELECT p.seed AS src, p.node AS dst, array_to_string(path, '>') AS path FROM p JOIN pr ON p.seed = pr.seed AND p.node = pr.node""")
def causal_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From every live part whose id is divisible by 100 to itself and the 60 ids that follow, from both ends."""
    edges, nodes = _dated(spark, sf_dir)
    pairs = nodes.filter("node % 100 = 0").select(F.col("node").alias("src"), F.explode(F.sequence(F.col("node"), F.col("node") + 60)).alias("dst"))
    return graph.shortest_paths(edges, pairs, rels=WALKED, nodes=nodes, at=AT).select("src", "dst", F.array_join("path", ">").alias("path"))


@of(f"WITH {SQL_DATED} SELECT p_partkey AS of, 'in' AS side, src AS other FROM part JOIN le ON dst = p_partkey UNION ALL SELECT p_partkey, 'out', dst FROM part JOIN le ON src = p_partkey")
def incident_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, nodes = _dated(spark, sf_dir)
    ids = nodes.select(F.col("node").alias("id"))
    side = lambda way, other: graph.incident(edges, ids, way, WALKED, AT).select("of", F.lit(way).alias("side"), F.col(other).alias("other"))
    return side("in", "src").unionByName(side("out", "dst"))


@of("""WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label IN (1, 2, 3) AND vec_id % 5 <= 2 AND (vec_id % 3 <> 0 OR vec_id % 7 > 2)), q AS (SELECT vec_id AS query, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT query, id, round(list_dot_product(v, q) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(q, q))), 6) AS score FROM v, q)
SELECT query, id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 5""")
def semantic_search_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of three labels that are valid at 2."""
    k = F.col("vec_id")
    e = table(spark, sf_dir, "embeddings")
    vectors = e.select(k.alias("id"), F.col("embedding").alias("v"), F.col("label").alias("type"), (k % 5).alias("valid_from"), F.when(k % 3 == 0, k % 7).alias("valid_to"))
    return temporal.semantic_search(vectors, e.filter(k % 100 == 0).select(k.alias("query"), F.col("embedding").alias("q")), 5, types=[1, 2, 3], at=2)


# ---- what follows from diffs ----


@of(f"""WITH {SQL_MONTHS}, nd AS (SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'modified' END AS change FROM (SELECT DISTINCT id FROM o) a FULL JOIN (SELECT DISTINCT id FROM n) b ON a.id = b.id),
ea AS (SELECT count(*) AS n FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.id = n.id AND o.file = n.file)), ap AS (SELECT count(*) AS n FROM nd JOIN part ON p_partkey = id WHERE change = 'added' AND (id % 5 = 0 OR contains(lower(p_name), 'api'))),
bo AS (SELECT count(*) FILTER (change = 'removed') AS r, count(*) FILTER (change = 'added') AS a FROM nd)
SELECT 'API_CHANGED' AS category, '' AS subject, n FROM ap WHERE n > 0 UNION ALL SELECT 'MODULE_EXTRACTED', 'm' || (id % 4), count(*) FROM nd WHERE change = 'added' GROUP BY ALL
UNION ALL SELECT 'REFACTOR', '', r FROM bo WHERE r > 5 AND a > 0 UNION ALL SELECT 'DEPENDENCY_ADDED', '', n FROM ea WHERE n > 10""")
def evolution_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts shipped in one month and the next, as symbols and as files of four top folders."""
    a, b = _months(spark, sf_dir)
    nodes = timeline.node_diff(a, b)
    kind = F.when(F.col("id") % 5 == 0, "interface").otherwise("function")
    symbols = nodes.join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), "id").withColumn("kind", kind)
    path = F.concat(F.lit("m"), (F.col("id") % 4).cast("string"), F.lit("/f"), F.col("id").cast("string"))
    return timeline.events(symbols, nodes.select(path.alias("id"), "change"), timeline.edge_diff(a, b, "id", "file"))


SQL_EDITED = f"""{SQL_CODE}, en AS (SELECT file, max(line + lines) - 1 AS last FROM sy GROUP BY file), ed AS (SELECT file, line + 1 AS spot FROM sy WHERE z % 10 IN (0, 5)),
hu AS (SELECT file, spot, sum(CASE WHEN spot - prev <= 6 THEN 0 ELSE 1 END) OVER (PARTITION BY file ORDER BY spot) AS hunk FROM (SELECT *, lag(spot) OVER (PARTITION BY file ORDER BY spot) AS prev FROM ed)),
sp AS (SELECT hu.file, hunk, greatest(1, min(spot) - 3) AS lo, least(max(last), max(spot) + 3) AS hi, count(*) AS gone FROM hu JOIN en ON en.file = hu.file GROUP BY ALL),
hd AS (SELECT *, coalesce(sum(gone) OVER (PARTITION BY file ORDER BY hunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sp)"""


@of(f"WITH {SQL_EDITED} SELECT file, string_agg('@@ -' || CAST(lo AS BIGINT) || ',' || CAST(hi - lo + 1 AS BIGINT) || ' +' || CAST(lo - before AS BIGINT) || ',' || CAST(hi - lo + 1 - gone AS BIGINT) || ' @@', chr(10) ORDER BY hunk) AS hunks, CAST(sum(gone) AS INT) AS removed FROM hd GROUP BY file")
def fix_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heads of the hunks and the number of removed lines, as the diffs have them."""
    own = settled(_lines(spark, sf_dir))
    d = fix.diffs(own, fix.merged(own)).withColumn("line", F.split("diff", "\n"))
    heads = F.filter("line", lambda x: x.startswith("@@ -"))
    return d.select("file", F.array_join(heads, "\n").alias("hunks"), F.size(F.filter("line", lambda x: x.startswith("-") & ~x.startswith("--- a/"))).alias("removed"))


@of(f"WITH {SQL_CODE}, i AS (SELECT count(*) AS n, count(DISTINCT file) AS f, count(*) FILTER (z % 10 = 0) AS d, count(*) FILTER (z % 10 = 5) AS t FROM sy WHERE z % 10 IN (0, 5)) SELECT 'chore: apply safe fixes (+' || n || ' health)' AS title, 'Health score: 0 to ' || n || '. Files changed: ' || f || '. Edits: ' || n || '.' || chr(10) || chr(10) || '- `remove-debug-output`: ' || d || ' edit(s)' || chr(10) || '- `remove-todo-marker`: ' || t || ' edit(s)' || chr(10) || chr(10) || 'Indexed again after the edits: issues ' || n || ' before, 0 after.' AS body FROM i")
def fix_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole run: edits, patched files, their lines held against the fixers again, the request. The score is the number of issues that went."""
    own = settled(_lines(spark, sf_dir))
    edits = settled(fix.merged(own))
    left = fix.merged(text_lines.lines(fix.patched(own, edits), "file"))
    before = edits.agg(F.lit(0).cast("long").alias("score"), F.count("*").alias("issues"))
    after = before.select(F.col("issues").alias("had")).join(left.agg(F.count("*").alias("issues"))).select((F.col("had") - F.col("issues")).alias("score"), "issues")
    return fix.pull_request(fix.verified(before, after), edits)


# ---- symbols and text ----


@of(f"WITH {SQL_CODE}, l AS (SELECT file, name, unnest(range(CAST(line AS BIGINT), CAST(line + lines AS BIGINT))) AS spot FROM sy) SELECT file, CAST(spot AS INT) AS line, name FROM l")
def symbol_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The symbol around every line of the rendered files; import lines have none."""
    _, symbols, _ = _index(spark, sf_dir)
    places = text_lines.lines(source_files(spark, sf_dir)).select("file", "line")
    return query.symbol_at(symbols, places).join(symbols.select("id", "name"), "id").select("file", "line", "name")


@of("SELECT a.p_partkey AS of, b.p_partkey AS id FROM part a JOIN part b ON b.p_partkey // 10 = a.p_partkey")
def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    edges = p.select(F.floor(F.col("id") / 10).alias("src"), F.col("id").alias("dst"), F.lit("contains").alias("kind"))
    return query.members(p, edges, p).select("of", "id")


@of("SELECT p_partkey AS id, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END AS dir, regexp_extract(path, '([^/]*)$', 1) AS base, lower(regexp_extract(path, '[^/](\\.[^./]*)$', 1)) AS ext, string_agg(path, '') AS normal FROM (SELECT p_partkey, replace(p_name, ' ', '/') || CASE p_size % 3 WHEN 0 THEN '.TS' WHEN 1 THEN '/.env' ELSE '' END AS path FROM part) GROUP BY ALL")
def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths made of the words of a part's name; the steps put in front cancel out."""
    tail = F.when(F.col("p_size") % 3 == 0, ".TS").when(F.col("p_size") % 3 == 1, "/.env").otherwise("")
    path = F.concat(F.translate("p_name", " ", "/"), tail)
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), path.alias("path"))
    normal = scalars.normal_path(F.concat(F.lit("./x/../y//z/../../"), "path"))
    return p.select("id", scalars.dirname(F.col("path")).alias("dir"), scalars.basename(F.col("path")).alias("base"), scalars.extension(F.col("path")).alias("ext"), normal.alias("normal"))


@of("SELECT doc_id, sha256(replace(replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')) AS escaped FROM documents")
def xml_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(scalars.xml_escape(F.coalesce("text", F.lit(""))), 256).alias("escaped"))


@of("""WITH c AS (SELECT l_orderkey AS task, l_partkey AS id, CAST(l_linenumber % 3 AS DOUBLE) AS e, CAST(l_partkey % 5 AS DOUBLE) AS v, CAST(l_suppkey % 2 AS DOUBLE) AS r, l_returnflag = 'A' AS hard FROM lineitem)
SELECT task, id, CAST(row_number() OVER (PARTITION BY task ORDER BY CASE WHEN hard THEN '-infinity'::DOUBLE ELSE round(0.4::DOUBLE * e + 0.4::DOUBLE * v - 0.2::DOUBLE * r, 9) END DESC, e DESC, r, id) AS INT) AS rank FROM c""")
def judged_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lambda c: c.cast("double")
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("task"), F.col("l_partkey").alias("id"), d(F.col("l_linenumber") % 3).alias("evidence"), d(F.col("l_partkey") % 5).alias("verification"), d(F.col("l_suppkey") % 2).alias("risk"), (F.col("l_returnflag") == "A").alias("hard_fail"))
    return temporal.judged_candidates(li).select("task", "id", "rank")
