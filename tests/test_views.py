"""Layouts, walks as of a time and requests, on small tables."""

import math

from graphlake.operators import fix, graph, layout, score


def test_packed_blocks_keep_their_shape_and_do_not_overlap(spark):
    places = {n: (float(n * 37 % 11 * 90), float(n * 13 % 7 * 50)) for n in range(12)}
    labels = {n: n % 4 for n in range(9)}  # 9, 10 and 11 stand alone
    nodes = spark.createDataFrame([(n, *p) for n, p in places.items()], "node int, x double, y double")
    got = {r.node: (r.x, r.y) for r in layout.packed(nodes, spark.createDataFrame(list(labels.items()), "node int, label int"), 20, 10).collect()}
    assert got.keys() == places.keys() and abs(sum(x for x, _ in got.values())) < 1e-6 and abs(sum(y for _, y in got.values())) < 1e-6
    blocks = {}
    for n, p in got.items():
        blocks.setdefault(labels.get(n, n), []).append((p, places[n]))
    boxes = []
    for block in blocks.values():
        assert len({(round(a[0] - b[0], 6), round(a[1] - b[1], 6)) for a, b in block}) == 1
        xs, ys = [a[0] for a, _ in block], [a[1] for a, _ in block]
        boxes.append((min(xs) - 10, max(xs) + 10, min(ys) - 5, max(ys) + 5))
    for i, a in enumerate(boxes):
        for b in boxes[:i]:
            assert a[1] <= b[0] + 1e-6 or b[1] <= a[0] + 1e-6 or a[3] <= b[2] + 1e-6 or b[3] <= a[2] + 1e-6


def test_one_component_stays_and_no_node_gives_none(spark):
    nodes = spark.createDataFrame([("a", 5.0, 5.0), ("b", 9.0, 7.0)], "node string, x double, y double")
    labels = spark.createDataFrame([("a", "a"), ("b", "a")], "node string, label string")
    assert {tuple(r) for r in layout.packed(nodes, labels, 4, 4).collect()} == {("a", 5.0, 5.0), ("b", 9.0, 7.0)}
    assert layout.packed(nodes.limit(0), labels, 4, 4).count() == 0


def test_layers_follow_the_row_above(spark):
    nodes = spark.createDataFrame([("t1", 1, 0), ("t2", 1, 1), *((f"b{k}", 0, k) for k in range(9))], "node string, tier int, ord int")
    edges = spark.createDataFrame([("t2", "b0"), ("b1", "t1"), ("t1", "t2")], "source string, target string")
    got = {r.node: (r.x, r.y, r.width, r.height) for r in layout.layered(nodes, edges, 10, 10, 2, 5).collect()}
    order = sorted(((n, g) for n, g in got.items() if n[0] == "b"), key=lambda e: (e[1][1], e[1][0]))
    assert [n for n, _ in order] == ["b1", "b0", *(f"b{k}" for k in range(2, 9))]  # by the place of the neighbour, the rest by ord
    assert [y for _, (_, y, *_) in order] == [70.0] * 8 + [85.0] and got["t1"][1] == 55.0
    assert got["t1"][2:] == (120 + 8 * 10 + 7 * 2, 50 + 3 * 15 - 5 + 50) and math.isclose((got["t1"][0] + got["t2"][0]) / 2, got["b8"][0])
    assert layout.layered(nodes.limit(0), edges, 10, 10, 2, 5).count() == 0


def test_walks_see_what_is_valid(spark):
    edges = spark.createDataFrame([("a", "b", "calls", 0, None), ("b", "c", "calls", 0, 3), ("a", "d", "imports", 0, None), ("d", "c", "calls", 2, None), ("a", "e", "calls", 0, None)], "src string, dst string, rel string, valid_from int, valid_to int")
    nodes = spark.createDataFrame([*((n, 0, None) for n in "abcd"), ("e", 5, None)], "node string, valid_from int, valid_to int")
    seed = spark.createDataFrame([("a",), ("e",)], "seed string")
    near = lambda **o: {(r.seed, r.node) for r in graph.neighbours(edges, seed, 3, nodes=nodes, **o).collect()}
    assert near(at=1) == {("a", x) for x in "abcd"}  # e is not live, so neither a seed nor walked to
    assert near(at=3, rels=["calls"]) == {("a", "a"), ("a", "b")}
    found = graph.neighbours(edges, seed, 1, nodes=nodes, at=1)
    assert {(r.src, r.dst) for r in graph.walked_edges(edges, found, 1, at=1).collect()} == {("a", "b"), ("a", "d"), ("a", "e")}
    pairs = spark.createDataFrame([("a", "c"), ("a", "e"), ("b", "b"), ("c", "a")], "src string, dst string")
    paths = lambda at: {(r.src, r.dst): "".join(r.path) for r in graph.shortest_paths(edges, pairs, nodes=nodes, at=at).collect()}
    assert paths(1) == {("a", "c"): "abc", ("b", "b"): "b"} and paths(3) == {("a", "c"): "adc", ("b", "b"): "b"} and paths(5)[("a", "e")] == "ae"
    ids = spark.createDataFrame([("a",), ("c",)], "id string")
    ends = lambda way, **o: {(r.of, r.src, r.dst) for r in graph.incident(edges, ids, way, **o).collect()}
    assert ends("in", at=2) == {("c", "b", "c"), ("c", "d", "c")} and ends("out", rels=["imports"]) == {("a", "a", "d")}


def test_modules_in_order(spark):
    mods = spark.createDataFrame([("a", 5, 0), ("b", 9, 1), ("c", 9, 2), ("d", 1, 3)], "module string, loc int, first int")
    edges = spark.createDataFrame([("a", "b"), ("d", "a")], "source string, target string")
    assert [(r.module, r.tier) for r in score.ordered_modules(mods, edges).collect()] == [("b", 0), ("c", 0), ("a", 1), ("d", 2)]


def test_no_request_without_verification(spark):
    edits = spark.createDataFrame([("f", 1, "x", None, "remove-todo-marker")], fix.EDIT)
    run = lambda n: spark.createDataFrame([(70 + n, 5 - n)], "score int, issues int")
    got = fix.pull_request(fix.verified(run(0), run(2)), edits).collect()
    assert len(got) == 1 and got[0].title == "chore: apply safe fixes (+2 health)" and "- `remove-todo-marker`: 1 edit(s)" in got[0].body
    assert fix.pull_request(fix.verified(run(2), run(0)), edits).count() == 0


def test_walks_carry_no_paths(spark, monkeypatch):
    """Ladders of two nodes a rung: many shortest paths of one length, the least of which counts; only the result holds arrays."""
    edges = spark.createDataFrame([(f"{r}{a}", f"{r + 1}{b}", "calls", 0, None) for r in range(1, 8) for a in "xy" for b in "xy"], "src string, dst string, rel string, valid_from int, valid_to int")
    seeds = spark.createDataFrame([("1x",), ("1y",)], "seed string")
    ends = [f"{r}{a}" for r in range(1, 9) for a in "xy"]
    want = {(s, d): [s, *(f"{r}x" for r in range(2, int(d[0]))), d][: int(d[0])] for s in ("1x", "1y") for d in ends if d[0] != "1" or s == d}
    written, keep = [], graph.settled
    monkeypatch.setattr(graph, "settled", lambda df: written.append(df.columns) or keep(df))
    assert {(r.src, r.dst): r.path for r in graph.paths_from(edges, seeds).collect()} == want
    assert all("path" not in c for c in written[:8])  # the steps, then the walk
    pairs = spark.createDataFrame([(s, d) for s in ("1x", "1y") for d in ends], "src string, dst string")
    assert {(r.src, r.dst): r.path for r in graph.shortest_paths(edges, pairs).collect()} == want
