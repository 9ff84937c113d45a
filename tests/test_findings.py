"""Golden cases of rules, scores, findings, fixes."""

import tarfile

import pytest
from pyspark.sql import functions as F

from graphlake.functions import scalars
from graphlake.operators import fix, lines, score, swarm
from graphlake.sources import files as src
from graphlake.sources import snapshots


def hits(spark, file, text):
    df = spark.createDataFrame([(file, text)], "rel string, text string")
    return {(r.title, r.line) for r in lines.rule_hits(lines.lines(df)).collect()}


def test_rules(spark):
    text = "const a: any = 1;\n\neval('x')\nconsole.log(1)\n  print(2)\n} catch (e) {}\n// TODO\n// @ts-ignore\nfetch('http://localhost:1')\n"
    got = hits(spark, "a.ts", text)
    assert got == {("Untyped `any`", 1), ("Use of eval()", 3), ("Leftover debug output", 4), ("Leftover debug output", 5), ("Empty catch block", 6), ("TODO/FIXME marker", 7), ("Suppressed checker", 8), ("Hardcoded local URL", 9)}
    assert ("Untyped `any`", 1) not in hits(spark, "a.py", text)
    assert len([1 for t, _ in hits(spark, "b.js", "debugger\n" * 9)]) == 5


@pytest.mark.parametrize("value, found", [("sk_live_9f8a7b6c5d4e", True), ("am_live_...", False), ("your_api_key_here", False), ("changeme", False)])
def test_placeholders_are_no_secrets(spark, value, found):
    assert bool(hits(spark, "auth.py", f'\n\n\n\napi_key = "{value}"\n')) is found


def test_lint_only_in_scripts(spark):
    text = "x\n\nconst r = /(a+)+b/;\n"
    of = lambda name, t: [r.line for r in lines.lint_hits(lines.lines(spark.createDataFrame([(name, t)], "rel string, text string"))).collect()]
    assert of("a.ts", text) == [3] and of("a.py", text) == [] and len(of("a.js", "new Buffer(1)\n" * 20)) == 10


def test_scores(spark):
    issues = spark.createDataFrame([("security", 5, 1), ("dependency_hygiene", 1, 2)], "dimension string, severity int, blast int")
    got = {r.dimension: (r.penalty, r.score) for r in score.dimension_scores(issues, 14).collect()}
    norm = 14
    import math

    want = lambda p: math.floor(100 * math.exp(-0.06 * p / max(1, math.log10(max(norm, 10)) ** 2)) + 0.5)
    assert got["security"] == (5.0, want(5)) and got["correctness"] == (0.0, 100) and len(got) == 5
    assert score.dimension_scores(issues.limit(0), 0).filter("score = 100").count() == 5


def test_scalars(spark):
    one = spark.range(1)
    val = lambda c: one.select(c.alias("x")).first().x
    assert [val(scalars.js_round(F.lit(x))) for x in (2.5, -2.5, 0.49)] == [3, -2, 0]
    assert val(scalars.normal_path(F.lit("a/./b/../c//d"))) == "a/c/d" and val(scalars.normal_path(F.lit("../x"))) == "../x"
    assert val(scalars.dirname(F.lit("a/b.ts"))) == "a" and val(scalars.dirname(F.lit("b.ts"))) == "." and val(scalars.extension(F.lit("a/.env"))) == "" and val(scalars.extension(F.lit("x/Y.TS"))) == ".ts"
    assert val(scalars.token_estimate(F.lit("abcde"))) == 2
    assert val(scalars.candidate_score(F.lit(0.8), F.lit(1.0), F.lit(1.0), F.lit(False))) == pytest.approx(0.52)
    assert val(scalars.candidate_score(F.lit(0.8), F.lit(1.0), F.lit(1.0), F.lit(True))) == float("-inf")
    assert val(scalars.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0


def finding(agent, severity, confidence, file, line, blast=1, churn=1, order=0):
    return (agent, severity, confidence, "t", file, line, None, blast, churn, "M", order, swarm.AGENTS.index(agent))


SCHEMA = "agent string, severity int, confidence double, title string, file string, line int, symbol string, blast long, churn long, effort string, ord long, agent_ord int"


def test_critic_merges_close_lines(spark):
    rows = [finding("security", 5, 0.9, "a.ts", 10), finding("dependency", 1, 1.0, "a.ts", 11), finding("security", 3, 0.5, "b.ts", 10), finding("security", 3, 0.5, "b.ts", 20), finding("test", 2, 0.5, "c.ts", 1), finding("test", 4, 0.5, "c.ts", 3), finding("refactor", 4, 0.5, "c.ts", 5)]
    got = {(r.file, r.line): r for r in swarm.critic(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(got) == {("a.ts", 10), ("b.ts", 10), ("b.ts", 20), ("c.ts", 3)}
    assert got["a.ts", 10].confidence == 1.0 and got["a.ts", 10].corroborated_by == ["dependency"]
    assert got["c.ts", 3].agent == "test" and got["c.ts", 3].confidence == pytest.approx(0.65) and got["c.ts", 3].corroborated_by == ["refactor"]


def test_judge_and_plan(spark):
    rows = [finding("test", 5, 1.0, "a", 1, 10), finding("test", 2, 0.7, "b", 1, 3), finding("test", 1, 0.7, "c", 1, 3), finding("test", 1, 0.3, "d", 1, 1), finding("security", 4, 0.2, "e", 1)]
    df = swarm.critic(spark.createDataFrame(rows, SCHEMA))
    got = {r.file: (r.score, r.priority) for r in swarm.judge(df).collect()}
    assert {f: p for f, (_, p) in got.items()} == {"a": "P0", "b": "P1", "c": "P2", "d": "P3", "e": "P0"}
    assert [got[f][0] for f in "abcd"] == [290, 55, 27, 8]
    plan = swarm.plan(swarm.judge(df), 95).first()
    assert (plan.p0, plan.p1, plan.projected) == (2, 1, 100)
    low, high = (swarm.judge(swarm.critic(spark.createDataFrame([finding("test", 3, 0.5, "x", 1, 5, c)], SCHEMA))).first().score for c in (1, 50))
    assert high > low
    none = spark.createDataFrame([], SCHEMA)
    assert swarm.plan(swarm.judge(swarm.critic(none)), 90).first().projected == 90 and swarm.reports(none).count() == 7


SYMBOL = "id string, name string, kind string, file string, line int, end_line int, signature string, doc string, exported boolean, fan_in int, fan_out int, complexity int, tags array<string>, container string, ord int, churn int"


def symbol(name, file, line=1, end=5, kind="function", fan_in=0, fan_out=0, complexity=1, exported=True, signature=None):
    return (name, name, kind, file, line, end, signature or f"function {name}()", None, exported, fan_in, fan_out, complexity, [], None, line, 1)


def test_specialists(spark):
    rows = [symbol("handler2", "handler.ts", 1, 3, signature="function handler2(req, res)", fan_out=1), symbol("process", "mid.ts", 1, 3, fan_in=1, fan_out=1), symbol("dynamic", "dynamic.ts", 1, 3, fan_in=1), symbol("hub", "hub.ts", 1, 9, fan_in=9, complexity=20), symbol("x", "cy.ts", 1, 2, fan_in=1), symbol("y", "cy.ts", 3, 4, fan_in=1), symbol("lonely", "z.ts", 1, 2, exported=False)]
    symbols = spark.createDataFrame(rows, SYMBOL)
    edges = spark.createDataFrame([("handler2", "process", "calls"), ("process", "dynamic", "calls"), ("x", "y", "calls"), ("y", "x", "calls")], "src string, dst string, kind string")
    issues = spark.createDataFrame([("security", 5, 0.95, "Use of eval()", "dynamic.ts", 2, 1, 1, 0), ("dependency_hygiene", 2, 1.0, "No lockfile committed", "package.json", 1, 2, 1, 1)], "dimension string, severity int, confidence double, title string, file string, line int, blast int, churn int, ord int")
    got = swarm.findings(issues, symbols, edges).collect()
    titles = {(r.agent, r.title, r.file) for r in got}
    assert ("security", "Untrusted input reaches use of eval()", "handler.ts") in titles and ("security", "Use of eval()", "dynamic.ts") in titles
    assert ("performance", "Hot path: hub (9 callers)", "hub.ts") in titles and ("refactor", "High complexity: hub (score: 20)", "hub.ts") in titles
    assert {r.title: r.confidence for r in got if r.agent == "deadcode"} == {"Unreferenced function: handler2": 0.3, "Unreferenced function: lonely": 0.8}
    assert [(r.title, r.confidence) for r in got if r.agent == "architecture"] == [("Circular dependency: x → y", 0.9)]
    assert ("test", "Untested core logic: hub", "hub.ts") in titles and ("dependency", "No lockfile committed", "package.json") in titles
    empty = swarm.findings(issues.limit(0), symbols.limit(0), edges.limit(0))
    assert empty.count() == 0


def lines_of(spark, files):
    return lines.lines(spark.createDataFrame(list(files.items()), "rel string, text string"))


def test_fixers(spark):
    py = "def f():\n    print(1)\n\ndef g():\n    print(1)\n    return 2\n\nif x:\n    print(1)\n    print(2)\nelse:\n    pass\n"
    files = {"a.js": "const x = 1;\nconsole.log('x');\ndebugger;\nconst y = (console.log('x'), 5);\n// TODO: later\nconst s = 'TODO';\n", "b.py": py, "c.ts": "try {\n} catch (e) {}\n", "d.py": "# FIXME\nexcept (E) {}\n"}
    edits = fix.merged(lines_of(spark, files))
    got = {(r.file, r.line, r.after is None) for r in edits.collect()}
    assert got == {("a.js", 2, True), ("a.js", 3, True), ("a.js", 5, True), ("b.py", 5, True), ("b.py", 9, True), ("c.ts", 2, False), ("d.py", 1, True)}
    after = {r.file: r.text for r in fix.patched(lines_of(spark, files), edits).collect()}
    assert after["a.js"] == "const x = 1;\nconst y = (console.log('x'), 5);\nconst s = 'TODO';\n" and after["c.ts"] == "try {\n} catch (e) { /* intentionally ignored */ }\n"
    compile(after["b.py"].replace("if x", "if 1"), "b", "exec")
    diff = {r.file: r.diff for r in fix.diffs(lines_of(spark, files), edits).collect()}
    assert "-console.log('x');" in diff["a.js"] and "+} catch (e) { /* intentionally ignored */ }" in diff["c.ts"]
    assert {r.fixer: r.edits for r in fix.by_fixer(edits).collect()} == {"remove-debug-output": 4, "remove-todo-marker": 2, "annotate-empty-catch": 1}


def test_diff_hunks(spark):
    text = "\n".join(f"console.log({i})" if i in (2, 5, 30) else f"l{i}" for i in range(1, 41))
    df = lines_of(spark, {"a.js": text})
    heads = [x for x in fix.diffs(df, fix.merged(df)).first().diff.split("\n") if x.startswith("@@")]
    assert heads == ["@@ -1,8 +1,6 @@", "@@ -27,7 +25,6 @@"]


def test_dependencies_and_tests(spark):
    pkg = spark.createDataFrame([('{"dependencies": {"a": "*", "b": "^0.3.0", "c": "1.0.0", "d": "latest"}, "devDependencies": {"d": "2.0.0"}}',)], "text string")
    reqs = spark.createDataFrame([("flask\n# no\nrequests==2\n\n",)], "text string")
    got = {(r.title, r.severity, r.blast) for r in src.dependency_issues(src.package_json(pkg), src.requirements(reqs), False).collect()}
    assert got == {("Unpinned dependency: a (*)", 3, 2), ("Pre-1.0 dependency: b (^0.3.0)", 1, 1), ("No lockfile committed", 2, 2), ("Unpinned dependency: flask", 2, 1)}
    tree = lambda names: src.with_language(spark.createDataFrame([(n,) for n in names], "rel string"))
    assert lines.test_issues(tree(["a.ts"])).first().title == "No test files detected"
    assert lines.test_issues(tree(["a.ts", "a.test.ts"])).count() == 0 and lines.test_issues(tree(["a.md"])).count() == 0
    assert lines.test_issues(tree([f"f{i}.ts" for i in range(19)] + ["tests/x.ts"])).first().title == "Low test coverage ratio (5% of code files)"


def test_file_tree(spark, tmp_path):
    for rel, text in {"a.ts": "x\ny\n", ".hidden.py": "1", "node_modules/m/i.js": "no", ".git/x.py": "no", "sub/B.PY": "print(1)", "r.md": "# t", "x.unknown": "?"}.items():
        (tmp_path / rel).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / rel).write_text(text)
    got = {r.rel: (r.language, r.loc) for r in src.file_tree(spark, str(tmp_path)).collect()}
    assert got == {"a.ts": ("TypeScript", 3), "sub/B.PY": ("Python", 1), "r.md": ("Markdown", 0)}
    assert [(r.name, r.dir) for r in src.list_dir(src.file_tree(spark, str(tmp_path))).collect()] == [("sub", True), ("a.ts", False), ("r.md", False)]
    with tarfile.open(tmp_path / "abc123.tar", "w") as tar:
        tar.add(tmp_path, ".", filter=lambda t: None if t.name.endswith(".tar") else t)
    whole = {r.rel: r.language for r in src.scanned(snapshots.archives(spark, str(tmp_path))).collect()}
    assert whole == {"a.ts": "TypeScript", ".hidden.py": "Python", "sub/B.PY": "Python", "r.md": "Markdown"}


def test_judging_all_findings_gathers_nothing(spark):
    from graphlake.operators import swarm

    found = spark.range(300, numPartitions=3).selectExpr("'security' agent", "cast(id % 5 + 1 as int) severity", "0.5D confidence", "'t' title", "concat('f', id) file", "1 line", "cast(null as string) symbol", "1L blast", "1L churn", "'S' effort", "id ord", "0 agent_ord")
    judged = swarm.judge(found, None)
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Limit" not in plan and "TakeOrdered" not in plan
    assert judged.count() == 300 and swarm.judge(found).count() == 60
