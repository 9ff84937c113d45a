import itertools
import random

import pytest

from graphlake.operators import graph


def closure(edges):
    nodes = {n for e in edges for n in e}
    out = {n: {n} for n in nodes}
    step = {n: [b for a, b in edges if a == n] for n in nodes}
    for n in nodes:
        todo = [n]
        while todo:
            for m in step[todo.pop()]:
                if m not in out[n]:
                    out[n].add(m)
                    todo.append(m)
    return out


def brute_strong(edges):
    reach = closure(edges)
    groups = {n: min(m for m in reach[n] if n in reach[m]) for n in reach}
    return sorted((n, g) for n, g in groups.items() if list(groups.values()).count(g) > 1)


def brute_weak(edges):
    reach = closure([*edges, *[(b, a) for a, b in edges]])
    return sorted((n, min(r)) for n, r in reach.items())


def brute_tiers(edges):
    label = dict(brute_strong(edges))
    dag = {(a, b) for a, b in edges if a != b and (a not in label or label[a] != label.get(b))}
    tier = {n: 0 for e in edges for n in e}
    for _ in tier:
        for a, b in dag:
            tier[a] = max(tier[a], tier[b] + 1)
    return sorted(tier.items())


def brute_paths(edges, pairs, depth):
    out = []
    for s, t in sorted(set(pairs)):
        best, front = {s: (s,)}, {s: (s,)}
        for _ in range(depth):
            new = {}
            for a, b in edges:
                if a in front and b not in best:
                    new[b] = min(new.get(b, (*front[a], b)), (*front[a], b))
            best |= new
            front = new
        if t in best:
            out.append((s, t, best[t]))
    return out


def drawn(seed):
    rng = random.Random(seed)
    n = rng.choice([6, 15, 30])
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.choice([n // 2, n, 2 * n]))]
    at = 100
    for _ in range(3):  # chains, rings, and ears from a node back to itself or to another
        long = rng.randrange(2, 12)
        kind = rng.randrange(3)
        edges += list(zip(range(at, at + long), range(at + 1, at + long)))
        if kind:
            edges.append((at + long - 1, at if kind == 1 else rng.randrange(n)))
            edges += [(rng.randrange(n), at)] if kind == 2 else []
        at += long
    return edges + edges[:2]


def table(spark, edges):
    return spark.createDataFrame(edges, "src long, dst long")


def many(seeds):
    return [(a + 1000 * k, b + 1000 * k) for k in seeds for a, b in drawn(k)]


def test_components_and_tiers_match_brute_force(spark):
    edges = many(range(8))
    df = table(spark, edges)
    rows = lambda out: sorted(map(tuple, out.collect()))
    assert rows(graph.weak_components(df)) == brute_weak(edges)
    assert rows(graph.strong_components(df)) == brute_strong(edges)
    assert rows(graph.tiers(df)) == brute_tiers(edges)


def test_paths_from_both_ends(spark):
    edges = many(range(4))
    groups = [sorted({n for e in edges for n in e if n // 1000 == k}) for k in range(4)]
    pairs = [p for nodes in groups for p in [*itertools.product(nodes[:3], nodes), *itertools.product(nodes, nodes[-2:])]] + [(groups[0][0], groups[1][0]), (5, 10_000)]
    for depth in (3, 16):
        got = graph.shortest_paths(table(spark, edges), table(spark, pairs), depth).collect()
        assert sorted((r.src, r.dst, tuple(r.path)) for r in got) == brute_paths(edges, pairs, depth)
    seeds = [nodes[0] for nodes in groups]
    got = graph.paths_from(table(spark, edges), spark.createDataFrame([(s,) for s in seeds], "seed long")).collect()
    assert sorted((r.src, r.dst, tuple(r.path)) for r in got) == brute_paths(edges, list(itertools.product(seeds, {n for e in edges for n in e})), 16)


def test_no_edges(spark):
    none = table(spark, [])
    for f in (graph.weak_components, graph.strong_components, graph.tiers):
        assert f(none).count() == 0 == f(table(spark, [(1, 1)])).filter("node <> 1").count()
    assert graph.tiers(table(spark, [(1, 1)])).collect()[0].tier == 0


def test_long_paths_take_few_rounds(spark, monkeypatch):
    rng = random.Random(5)
    names = list(range(10_000))
    rng.shuffle(names)
    line = list(zip(names, names[1:]))
    df = table(spark, line)
    rounds = []
    star = graph._star_round
    monkeypatch.setattr(graph, "_star_round", lambda *a: rounds.append(1) or star(*a))
    assert graph.weak_components(df).filter("label <> 0").count() == 0 and len(rounds) < 20
    written = []
    settled = graph.settled
    monkeypatch.setattr(graph, "settled", lambda x: written.append(1) or settled(x))
    assert graph.strong_components(df).count() == 0 and len(written) < 40
    ring = table(spark, [*line, (names[-1], names[0])])
    assert [tuple(r) for r in graph.strong_components(ring).groupBy("label").count().collect()] == [(0, 10_000)]


def test_hubs_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(graph, "HUB", 3)
    edges = [(0, k) for k in range(1, 40)] + [(k, 100 + k) for k in range(1, 40)] + [(500, 501)]
    assert sorted(map(tuple, graph.weak_components(table(spark, edges)).collect())) == brute_weak(edges)


def test_rounds_leave_no_files_behind_but_the_result(spark, tmp_path, monkeypatch):
    from graphlake.operators import staged

    monkeypatch.setattr(staged, "shared_dir", lambda _: f"file://{tmp_path}")
    edges = [(k, k + 1) for k in range(30)]
    assert graph.weak_components(table(spark, edges)).filter("label = 0").count() == 31
    assert len(list((tmp_path / "graphlake").iterdir())) == 2  # the edges and the last round


def test_a_cluster_needs_a_shared_folder(spark):
    from graphlake.operators import staged

    class Context:
        master = "yarn"

        def getConf(self):
            return self

        def get(self, *_):
            return None

    class Session:
        sparkContext, conf = Context(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        staged.shared_dir(Session())
