import numpy as np

from graphlake.llm import covertree


def brute(rows, cosine=0.95):
    def fine(v):
        return bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [0] * len(rows)
    vs = [np.array(v, float) if fine(v) else None for _, v in rows]
    for i in range(len(rows)):
        for j in range(i):
            a, b = vs[i], vs[j]
            if a is not None and b is not None and len(a) == len(b) and a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)) >= cosine:
                links[i] += 1
                links[j] += 1
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    least = {}
    for i, (r, _) in enumerate(rows):
        if r is not None:
            least[find(i)] = min(least.get(find(i), r), r)
    return sorted(((r, links[i], least.get(find(i)), r == least.get(find(i))) for i, (r, _) in enumerate(rows)), key=str)


def rows_of(seed, n=400, dims=16):
    rng = np.random.default_rng(seed)
    out = [rng.normal(size=dims) for _ in range(n)]
    for k in range(0, 60, 3):
        for _ in range(6):
            out.append(out[k] * rng.uniform(0.1, 9) + rng.normal(size=dims) * rng.choice([0, 0.02, 0.1, 0.25, 0.4]))
    chain = rng.normal(size=dims)
    for _ in range(25):
        chain = chain + rng.normal(size=dims) * 0.12
        out.append(chain)
    tight = rng.normal(size=dims)
    out += [tight + rng.normal(size=dims) * 0.01 for _ in range(60)]
    return [(int(i), list(map(float, v))) for i, v in zip(rng.permutation(len(out)), out)]


def test_matches_brute_force(spark, monkeypatch):
    rows = rows_of(18)
    rows += [(9000 + i, v) for i, (_, v) in enumerate(rows[:5] * 4)]
    rows += [(8000, None), (8001, []), (8002, [0.0] * 16), (8003, [None] + [1.0] * 15), (8004, [float("nan")] * 16), (8005, [float("inf")] + [0.0] * 15), (8006, [1.0, 2.0]), (8007, [2.0, 4.0]), (rows[7][0], rows[7][1]), (None, rows[8][1])]
    df = spark.createDataFrame([(i, v, 3, "x") for i, v in rows], "vec_id long, embedding array<double>, n int, k1 string")
    want = brute(rows)
    assert sorted(map(tuple, covertree.near_duplicates(df).collect()), key=str) == want
    monkeypatch.setattr(covertree, "BLOCK", 60)
    monkeypatch.setattr(covertree, "FAN", 3)
    depth = []
    split = covertree._split
    monkeypatch.setattr(covertree, "_split", lambda placed, big, level: depth.append(level) or split(placed, big, level))
    assert sorted(map(tuple, covertree.near_duplicates(df).collect()), key=str) == want
    assert max(depth) >= 2
    assert covertree.near_duplicates(df.limit(0)).count() == 0


def test_bounds_prune_and_take_whole():
    x = covertree.unit(np.array([v for _, v in rows_of(19)]))
    n = len(x)
    calls = []

    class Counted(covertree.Pairs):
        def _exact(self, a, b):
            calls.append((len(a.own), len(b.own)))
            super()._exact(a, b)

    pairs = Counted(x, np.ones(n, np.int64), 0.95)
    root = covertree.Node(x, np.arange(n), 0, float(covertree.distances(x, x[:1]).max()), 4.0)
    pairs.walk(root, root)
    assert np.array_equal(pairs.links, ((x @ x.T) >= 0.95).sum(1) - 1)
    assert len(calls) < n * n / 20


def test_nets_cover_and_keep_apart():
    x = covertree.unit(np.random.default_rng(20).normal(size=(700, 4)))
    for radius in (1.0, 0.5, 0.25):
        c = covertree.net(x, radius)
        d = covertree.distances(x, x[c])
        assert d.min(1).max() <= radius and (covertree.distances(x[c], x[c]) + 9 * np.eye(len(c))).min() > radius


def test_finite_vectors_of_any_size(spark):
    rng = np.random.default_rng(21)
    rows = [(i, list(map(float, rng.normal(size=8)))) for i in range(60)]
    rows += [(100 + i, [x * s for x in rows[i][1]]) for i, s in enumerate([1e200, 1e-200, 1e300, 1e-300])]
    rows += [(200, [1e200] * 8), (201, [1e-200] * 8), (202, [3.0] * 8), (203, [1e308, -1e308] + [0.0] * 6), (204, [5e-324] + [0.0] * 7), (205, [1.0] + [0.0] * 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.id: (r.n_links, r.component_id) for r in covertree.near_duplicates(df).collect()}
    for i in range(4):
        assert got[100 + i][1] == got[i][1] and got[i][0] >= 1
    assert {got[i][1] for i in (200, 201, 202)} == {200} and got[204] == (1, 204) and got[205] == (1, 204)


def test_vectors_that_can_not_be_told_apart_are_sliced(spark, monkeypatch):
    monkeypatch.setattr(covertree, "BLOCK", 20)
    monkeypatch.setattr(covertree, "LEVELS", 0)
    rows = [(i, v) for i, (_, v) in enumerate(rows_of(23, 80))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, covertree.near_duplicates(df).collect()), key=str) == brute(rows)


def test_a_task_of_far_apart_vectors_is_small():
    import tracemalloc

    x = np.random.default_rng(22).normal(size=(8192, 64))
    tracemalloc.start()
    links, edges = covertree.linked(x, np.ones(len(x), np.int64), np.arange(len(x)), None, 0.95)
    peak = tracemalloc.get_traced_memory()[1]
    assert not links.any() and not edges and peak < 400e6, peak
