from pyspark.sql import functions as F

from graphlake.operators import index, lines, swarm
from graphlake.sources import files as src

TREE = {
    "src/app/a.ts": "import { run } from './b';\nexport function main(req) {\n  return run(req);\n}\nconst re = /^(a+)+$/;\n",
    "src/app/b.ts": "export function run(x) {\n  eval(x);\n  console.log(x); // TODO\n}\nfunction never() {\n}\n",
    "src/lib/c.py": "class Box:\n    def get(self):\n        return helper(self)\n\ndef helper(x):\n    return x\n",
    "README.md": None,
}
MANIFESTS = [("package.json", '{"dependencies": {"left": "*", "right": "^0.2.0"}}'), ("requirements.txt", "flask\n# no\nnumpy==1.0\n"), ("docs/yarn.lock", "")]


def indexed(spark, manifests=MANIFESTS):
    rows = [(rel, text, k) for k, (rel, text) in enumerate(TREE.items())]
    files = src.with_language(spark.createDataFrame(rows, "rel string, text string, ord long")).withColumn("loc", lines.line_count(F.coalesce("text", F.lit(""))))
    churn = spark.createDataFrame([("src/app/b.ts", 9)], "file string, churn int")
    return index.index_files(files, churn, spark.createDataFrame(manifests, "rel string, text string"))


def test_a_repository_in_one_call(spark):
    own = indexed(spark)
    issues = [(r.file, r.line, r.title, r.blast, r.churn) for r in own.issues.orderBy("ord").collect()]
    assert issues[:4] == [("src/app/a.ts", 5, "ReDoS-vulnerable regular expression", 1, 1), ("src/app/b.ts", 2, "Use of eval()", 2, 9), ("src/app/b.ts", 3, "Leftover debug output", 2, 9), ("src/app/b.ts", 3, "TODO/FIXME marker", 2, 9)]
    assert {t for _, _, t, _, _ in issues[4:]} == {"Indirect/computed eval()", "Unpinned dependency: left (*)", "Pre-1.0 dependency: right (^0.2.0)", "Unpinned dependency: flask", "No lockfile committed", "No test files detected"}
    assert issues[-1][2] == "No test files detected"
    assert {r.rel: r.issues for r in own.files.collect()} == {"src/app/a.ts": 1, "src/app/b.ts": 4, "src/lib/c.py": 0, "README.md": 0}
    scores = {r.dimension: r.issues for r in own.scores.collect()}
    assert scores == {"correctness": 1, "security": 3, "maintainability": 1, "dependency_hygiene": 4, "test_integrity": 1}
    assert 0 <= own.overall().first().overall <= 100
    mods, edges = own.modules()
    assert {r.module: r.files for r in mods.collect()} == {"src": 3, "(root)": 1} and edges.count() == 0
    assert {(r.src, r.dst) for r in own.edges.filter("kind = 'calls'").collect()} == {("src/app/a.ts#main@2", "src/app/b.ts#run@1"), ("src/lib/c.py#get@2", "src/lib/c.py#helper@5")}


def test_the_whole_swarm_and_one_that_fails_at_run_time(spark):
    own = indexed(spark, [*MANIFESTS, ("yarn.lock", "")])
    assert own.issues.filter("title like 'No lock%'").count() == 0
    found = own.findings()
    assert {r.agent for r in found.collect()} == {"security", "deadcode", "dependency", "test"}
    assert found.filter("title = 'Untrusted input reaches use of eval()'").count() == 1
    bad = lambda issues, symbols, edges: swarm.deadcode(issues, symbols, edges).withColumn("severity", F.raise_error(F.lit("no")).cast("int"))
    from graphlake.operators.staged import settled

    left = swarm.findings(own.issues, own.symbols, own.edges, {"security": swarm.security, "bad": bad}, settled)
    assert {r.agent for r in left.collect()} == {"security"}


def test_evolution_and_a_fix_run(spark):
    tree = TREE | {"src/app/b.ts": "export function run(x) {\n  console.log(x);\n  // TODO: more\n}\n"}
    rows = [(rel, text, k) for k, (rel, text) in enumerate(tree.items())]
    files = src.with_language(spark.createDataFrame(rows, "rel string, text string, ord long")).withColumn("loc", lines.line_count(F.coalesce("text", F.lit(""))))
    run = index.fixed(files)
    assert {(r.file, r.title, r.change) for r in run.evolution.issues.collect()} == {("src/app/b.ts", "Leftover debug output", "resolved"), ("src/app/b.ts", "TODO/FIXME marker", "resolved")}
    assert [(r.file, r.line, r.fixer) for r in run.edits.orderBy("line").collect()] == [("src/app/b.ts", 2, "remove-debug-output"), ("src/app/b.ts", 3, "remove-todo-marker")]
    before, after = run.scores.first()
    assert before <= after
    assert run.evolution.events.count() == 0 and {r.module: (r.growth, r.stability) for r in run.evolution.health.collect()} == {"src": (-2, 100), "(root)": (0, 100)}
    assert run.evolution.metrics.count() == 1 == run.evolution.baseline.count()
    first = index.evolution(None, run.after)
    assert [(r.category, r.n) for r in first.events.collect()] == [("FEATURE_INTRODUCED", 4)] and {r.change for r in first.issues.collect()} == {"introduced"}


def test_long_rendered_files_are_no_issue_of_the_queries(spark, tmp_path):
    """A part with 700 calls makes a file of over 600 lines, which the queries' SQL doesn't count; the index itself does, unless told not to."""
    import duckdb

    from graphlake.plans import code
    from graphlake.plans.tables import QUERIES

    d = str(tmp_path)
    spark.range(720).selectExpr("id p_partkey", "cast(id % 10 as int) p_size").write.parquet(f"{d}/part.parquet")
    spark.range(1400).selectExpr("id div 2 l_orderkey", "cast(id % 2 as int) l_linenumber", "if(id % 2 = 0, 0, 10 + id div 2) l_partkey", "1L l_suppkey", "'R' l_returnflag").write.parquet(f"{d}/lineitem.parquet")
    db = duckdb.connect()
    for t in ("part", "lineitem"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet/*.parquet'")
    for name in ("index_scores", "fix_run"):
        run, sql = QUERIES[name]
        assert sorted(map(tuple, run(spark, d).collect())) == sorted(db.execute(sql).fetchall())
    long = src.with_language(code.source_files(spark, d)).withColumn("loc", lines.line_count(F.col("text"))).filter("loc > 600")
    known = long.withColumn("fan_in", F.lit(0)).withColumn("churn", F.lit(1))
    of = lambda **o: index.all_issues(known, **o).filter("title like 'Large file%'").count()
    assert long.count() == 1 == of() and of(long_files=False) == 0
