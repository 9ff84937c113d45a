"""Golden cases of the symbol graph: extraction, resolution, search, context."""

import pytest
from pyspark.sql import functions as F

from graphlake.operators import extract, graph, query, resolve
from graphlake.sources import files as src


def graph_of(spark, tree):
    df = spark.createDataFrame([(rel, text, i) for i, (rel, text) in enumerate(tree.items())], "rel string, text string, ord int")
    files = src.with_language(df)
    symbols, edges = resolve.symbol_graph(files, extract.extracted(files).cache())
    return symbols.cache(), edges.cache()


def test_chain_of_three_files(spark):
    tree = {"a.ts": "export function alpha() {\n  beta();\n  return gamma();\n}\n", "b.ts": "export function beta() {\n  return gamma();\n}\n", "c.ts": "export function gamma() {\n  return 1;\n}\n"}
    symbols, edges = graph_of(spark, tree)
    ids = {r.name: r.id for r in symbols.collect()}
    assert set(ids) == {"alpha", "beta", "gamma"}
    assert {(r.src, r.dst) for r in edges.filter("kind = 'calls'").collect()} == {(ids["alpha"], ids["beta"]), (ids["alpha"], ids["gamma"]), (ids["beta"], ids["gamma"])}
    assert {r.name: (r.fan_in, r.fan_out) for r in symbols.collect()} == {"alpha": (0, 2), "beta": (1, 1), "gamma": (2, 0)}
    assert query.search(symbols, "beta").first().name == "beta"
    one = symbols.filter("name = 'gamma'").select("id")
    assert {r.name for r in query.callers(symbols, edges, one).collect()} == {"alpha", "beta"}
    found = query.context(symbols, edges, "who calls gamma?").collect()
    assert [r.reason for r in found if r.name == "gamma"] == ["seed"] and {r.name for r in found} == {"alpha", "beta", "gamma"}


def test_imports_decide_between_equal_names_and_the_innermost_calls(spark):
    main = 'import { parse } from "./utils/parse";\n\n\n\n\nexport function outer() {\n  const x = 1;\n\n  function inner() {\n    return parse(x);\n  }\n  return inner();\n}\n'
    tree = {"utils/parse.ts": "export function parse(x) {\n  return x;\n}\n", "zz/other.ts": "export function parse(y) {\n  return y;\n}\n", "main.ts": main}
    _, edges = graph_of(spark, tree)
    got = {(r.src, r.dst) for r in edges.filter("kind = 'calls'").collect()}
    assert ("main.ts#inner@9", "utils/parse.ts#parse@1") in got
    assert not any(dst.startswith("zz/") for _, dst in got)


def test_python_symbols_and_members(spark):
    tree = {"m.py": "# Keeps a value.\nclass Box(Base):\n    def get(self):\n        return helper(self)\n\n    def _set(self, v):\n        pass\n\ndef helper(x):\n    return x\n", "bad.py": "class :\n"}
    symbols, edges = graph_of(spark, tree)
    rows = {r.name: r for r in symbols.collect()}
    assert {n: (r.kind, r.exported, r.line, r.end_line) for n, r in rows.items()} == {"Box": ("class", True, 2, 8), "get": ("method", True, 3, 5), "_set": ("method", False, 6, 8), "helper": ("function", True, 9, 11)}
    assert rows["Box"].doc == "Keeps a value." and rows["get"].container == "m.py#Box@2" and rows["get"].complexity is None
    assert {r.name for r in query.members(symbols, edges, symbols.filter("name = 'Box'")).collect()} == {"get", "_set"}
    assert {(r.src, r.dst) for r in edges.filter("kind = 'calls'").collect()} == {("m.py#get@3", "m.py#helper@9")}


def test_scripts_are_parsed():
    text = '/** Adds. */\nexport default class Sum extends Base {\n  async add(a, b) {\n    if (a && b) { return a ? 1 : 2; }\n  }\n}\nexport interface Shape { x: number }\nexport const View = (props) => {\n  // react\n  for (const p of props) run(p);\n};\nconst plain = async (x) => x;\nfunction* gen(a) {\n}\n'
    symbols, imports = extract.script_lines("import def, { a as b, c } from './x';\nimport * as ns from \"y\";\n" + text)
    assert [(s["name"], s["kind"], s["container"]) for s in symbols] == [("Sum", "class", None), ("add", "method", "Sum"), ("Shape", "interface", None), ("View", "component", None), ("plain", "function", None), ("gen", "function", None)]
    assert symbols[0]["doc"] == "Adds." and symbols[1]["complexity"] == 4 and symbols[0]["exported"] and not symbols[4]["exported"]
    assert [(i["local"], i["imported"], i["path"]) for i in imports] == [("def", "default", "./x"), ("b", "a", "./x"), ("c", "c", "./x"), ("ns", "*", "y")]


def test_prompt_is_escaped(spark):
    rows = [("w", "weirdFn", "function", "a.ts", 1, 'function weirdFn<T extends Record<string, unknown>>(x: T): T & {}', '<script> "quoted"', True, 0, 0, ["io"], None, 1)]
    symbols = spark.createDataFrame(rows, "id string, name string, kind string, file string, line int, signature string, doc string, exported boolean, fan_in int, fan_out int, tags array<string>, container string, ord int")
    edges = spark.createDataFrame([], "src string, dst string, kind string")
    q = "how does <Foo> weirdFn handle & validate?"
    text = query.prompt(query.context(symbols, edges, q), q).first().prompt
    assert not any(x in text for x in ("<script>", "<T ", " & ", "<Foo>"))
    assert all(x in text for x in ("&lt;script&gt;", "&quot;quoted&quot;", 'name="weirdFn"'))


def test_budget_skips_what_does_not_fit(spark):
    rows = spark.createDataFrame([(1, i, c) for i, c in enumerate([50, 60, 40, 5, 5])], "g int, i int, cost int")
    got = query.within_budget(rows, ["g"], [F.col("i")], "cost", 100, 3).orderBy("i").collect()
    assert [(r.i, r.used) for r in got] == [(0, 50), (2, 90), (3, 95)]


def test_import_dialects(spark):
    go = 'package x\nimport (\n  "fmt"\n  a "repo/pkg/util"\n)\nimport "os"\n'
    py = "from . import a, b as c\nfrom ..pkg.mod import (d)  # e\nimport os, sys as s\n"
    js = "import x from './a';\nconst y = require('../b');\nimport z from 'react';\nimport './side';\n"
    files = src.with_language(spark.createDataFrame([("g/m.go", go), ("p/m.py", py), ("j/m.js", js)], "rel string, text string"))
    got = {}
    for r in src.imports(files).orderBy("rel", "ord").collect():
        got.setdefault(r.rel, []).append(r.spec)
    assert got == {"g/m.go": ["fmt", "repo/pkg/util", "os"], "p/m.py": [".", ".a", ".b", "..pkg.mod", "..pkg.mod.d", "os", "sys"], "j/m.js": ["./a", "../b"]}


def test_import_graph_links(spark):
    names = ["j/m.js", "j/a.ts", "j/lib/index.ts", "p/m.py", "p/a.py", "q/mod.py", "q/__init__.py", "g/m.go", "pkg/util/one.go", "pkg/util/two.go"]
    files = src.with_language(spark.createDataFrame([(n, i) for i, n in enumerate(names)], "rel string, ord int"))
    wanted = [("j/m.js", "./a"), ("j/m.js", "./lib"), ("j/m.js", "./m"), ("j/m.js", "./gone"), ("p/m.py", ".a"), ("p/m.py", "q.mod"), ("p/m.py", "q"), ("g/m.go", "host/pkg/util"), ("g/m.go", "fmt")]
    links = resolve.import_graph(files, spark.createDataFrame(wanted, "rel string, spec string"))
    assert {(r.source, r.target) for r in links.collect()} == {("j/m.js", "j/a.ts"), ("j/m.js", "j/lib/index.ts"), ("p/m.py", "p/a.py"), ("p/m.py", "q/mod.py"), ("p/m.py", "q/__init__.py"), ("g/m.go", "pkg/util/one.go"), ("g/m.go", "pkg/util/two.go")}


def test_python_syntax_trees(spark):
    text = "import os\nfrom json import loads\n\ndef helper(x):\n    return loads(x)\n\nclass Service:\n    def run(self):\n        return helper(1)\n\n    def value(self):\n        return 2\n"
    rows = {r.file: r for r in extract.python_graph(spark.createDataFrame([("m.py", text), ("bad.py", "def broken(:\n")], "rel string, text string")).collect()}
    assert rows["bad.py"].error and not rows["bad.py"].nodes
    kinds = sorted(n.type for n in rows["m.py"].nodes)
    assert kinds == ["Class", "Dependency", "Dependency", "File", "Function", "Method", "Method"]
    name = {n.id: n.name for n in rows["m.py"].nodes}
    edges = {(e.rel, name[e.src], name[e.dst]) for e in rows["m.py"].edges}
    assert ("CALLS", "run", "helper") in edges and len([e for e in edges if e[0] == "DEFINES"]) == 2 and len([e for e in edges if e[0] == "IMPORTS"]) == 2
    from graphlake.functions.scalars import stable_id

    assert stable_id("file:m.py") in name and len(stable_id("x")) == 26


@pytest.fixture(scope="module")
def chain(spark):
    return spark.createDataFrame([("a", "b", "CALLS"), ("b", "c", "CALLS"), ("c", "d", "CALLS")], "src string, dst string, rel string")


def test_neighbours_and_paths(spark, chain):
    seed = lambda x: spark.createDataFrame([(x,)], "seed string")
    near = lambda x, **o: {r.node for r in graph.neighbours(chain, seed(x), **o).collect()}
    assert near("a") == {"a", "b"} and near("a", depth=2) == {"a", "b", "c"} and near("c", direction="in") == {"b", "c"} and near("b", direction="both") == {"a", "b", "c"}
    assert near("a", rels=["IMPORTS"]) == {"a"}
    assert graph.shortest_path(chain, "a", "d").first().path == ["a", "b", "c", "d"]
    assert graph.shortest_path(chain, "d", "a").count() == 0 and graph.shortest_path(chain, "a", "a").first().path == ["a"]
    hub = spark.createDataFrame([("h", f"l{i}", "X") for i in range(10)], "src string, dst string, rel string")
    cut = graph.neighbours(hub, seed("h"), most=4).collect()
    assert len(cut) == 4 and all(r.truncated for r in cut)


def test_components_and_cycles(spark):
    pairs = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (5, 6), (6, 7), (9, 9), (10, 11)]
    edges = spark.createDataFrame(pairs, "src long, dst long")
    assert [r.members for r in graph.cycles(edges).collect()] == [[1, 2, 3], [4, 5]]
    got = {r.node: r.label for r in graph.weak_components(edges).collect()}
    assert {got[x] for x in range(1, 8)} == {1} and got[11] == 10
    tier = {r.node: r.tier for r in graph.tiers(edges).collect()}
    assert tier[7] == 0 and tier[6] == 1 and tier[5] == 2 and tier[3] == 1 + tier[4] and tier[10] == 1
    assert graph.strong_components(edges.filter("src > 100")).count() == 0


def test_the_smallest_symbol_around_each_place(spark, monkeypatch):
    import random

    monkeypatch.setattr(query, "RANGE", 7)
    rng, symbols = random.Random(4), []
    for k in range(120):  # not nested, equal ones among them
        at = rng.randrange(1, 60)
        symbols.append((f"f{k % 3}", at, at + rng.choice([0, 1, 5, 30]), f"s{k}", k, rng.choice(["function", "class"])))
    places = [(f"f{rng.randrange(4)}", rng.randrange(1, 95), n, f"s{rng.randrange(120)}") for n in range(400)] + [(None, 3, 900, "s1"), ("f1", None, 901, "s1"), ("f1", 4, 7, "s0"), ("f1", 4, 7, "s0")]
    s = spark.createDataFrame(symbols, "file string, line int, end_line int, id string, ord long, kind string")
    p = spark.createDataFrame(places, "file string, line int, key int, target string")
    for kinds, exclude in ((None, None), (["function"], "target")):
        want = []
        for file, line, key, target in places:
            around = [(to - at, o, i) for f, at, to, i, o, kind in symbols if f == file and line is not None and at <= line <= to and (not kinds or kind in kinds) and (not exclude or i != target)]
            want += [(file, line, key, target, min(around)[2])] if around else []
        assert sorted(map(tuple, query.symbol_at(s, p, kinds, exclude).collect())) == sorted(want)
    assert query.symbol_at(s.limit(0), p).count() == 0 == query.symbol_at(s, p.limit(0)).count()


def test_many_searches_are_as_one_by_one(spark):
    words = ["render", "Template", "renderTemplate", "x", "ab", "viewer", "VIEW", "tem", "é"]
    rows = [(k, words[k % 9] + words[k * 7 % 9], f"function {words[k * 5 % 9]}(a)", words[k * 4 % 9] if k % 3 else None, k % 2 == 0, k % 20, [words[k % 4].lower()], k) for k in range(150)]
    symbols = spark.createDataFrame(rows, "id long, name string, signature string, doc string, exported boolean, fan_in int, tags array<string>, ord long")
    asked = ["render", " VIEW ", "x", "ab", "template", "nowhere", "r", "é", "function x", "x\u0000f", "", None, "x"]
    got = query.searches(symbols, spark.createDataFrame([(q,) for q in asked], "query string"), 10)
    for q in set(asked) - {None}:
        want = [(r.id, r.score) for r in query.search(symbols, q, 10).collect()]
        assert [(r.id, r.score) for r in got.filter(F.col("query") == q).orderBy("rank").collect()] == want, q
    assert query.searches(symbols, spark.createDataFrame([("",)], "query string")).count() == 0


def test_python_holds_few_files_at_once(spark, monkeypatch):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"n": list(range(100))})
    assert [b.num_rows for b in extract.sliced(iter([batch]), 32)] == [32, 32, 32, 4]
    assert [n for b in extract.sliced(iter([batch, batch]), 7) for n in b.column(0).to_pylist()] == [*range(100)] * 2
    files = spark.range(100, numPartitions=1).selectExpr("concat('f', id, '.py') rel", "'.py' ext", "concat('def g', id, '():\\n  pass\\n') text")
    assert {(r.file, r.symbols[0].name) for r in extract.extracted(files).collect()} == {(f"f{k}.py", f"g{k}") for k in range(100)}


def test_resolution_broadcasts_no_symbols(spark):
    from graphlake.operators.staged import settled

    files = settled(spark.range(400).selectExpr("concat('m/f', id, '.py') rel", "'.py' ext", "id ord", "repeat('def helper(x):\\n  return helper(x)\\n', 50) text"))
    symbols, edges = resolve.symbol_graph(files, settled(extract.extracted(files)))
    for df in (symbols, edges):
        joins = [x for x in df._jdf.queryExecution().sparkPlan().toString().split("\n") if "BroadcastHashJoin" in x]
        assert joins and all("BroadcastHashJoin [range" in x for x in joins)  # sums of ranges alone, a row for each


def test_links_to_large_directories_are_made_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(resolve, "BLOCK", 4)
    files = [(f"{d}/f{k}.go", ".go", k) for d in ("pkg/a", "pkg/b") for k in range(30)]
    wanted = [(f, f"host/pkg/{'b' if f.startswith('pkg/a') else 'a'}") for f, _, _ in files] + [("pkg/a/f0.go", "host/pkg/b"), ("pkg/a/f1.go", "fmt")]
    links = resolve.import_graph(spark.createDataFrame(files, "rel string, ext string, ord int"), spark.createDataFrame(wanted, "rel string, spec string"))
    got = sorted((r.source, r.target, r.spec) for r in links.collect())
    assert got == sorted((f, t, s) for f, s in wanted for t, _, _ in files if s != "fmt" and t.startswith(s[5:]))  # a repeated import is a repeated link
    sizes = [r[0] for r in links.groupBy(F.spark_partition_id().alias("p")).count().select("count").collect()]
    assert len(sizes) > 50 and max(sizes) < len(got) / 10
