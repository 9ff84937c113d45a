import hashlib
import math

import numpy as np

from graphlake.llm import centroids


def brute(rows, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    ranked = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    around = [v for _, v in ranked[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(around))

    for _ in range(rounds):
        groups = [[] for _ in around]
        for _, v in kept:
            groups[near(v)[1]].append(v)
        around = [[sum(col) // len(g) for col in zip(*g)] if g else c for g, c in zip(groups, around)]
    found = [(i, *near(v)) for i, v in kept]
    own = [sum(d for _, d, n in found if n == m) for m in range(len(around))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in around]
    return sorted(((i, n, d, own[n], sum(own), sha[n]) for i, d, n in found), key=str)


def test_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    middles = rng.normal(size=(5, 64))
    rows = [(int(i), [float(x) for x in middles[i % 5] * (i % 3) + rng.normal(size=64) * 0.3 * np.linspace(0, 2, 64)]) for i in rng.permutation(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(40)] + [rows[1], (None, rows[2][1]), (None, rows[3][1])]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 63), (2003, [None] + [1.0] * 63), (2004, [float("nan")] * 64), (2005, [float("inf")] + [0.0] * 63), (2006, [0.0] * 64)]
    df = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, v int, id string")
    assert sorted(map(tuple, centroids.clustered(df.repartition(5)).collect()), key=str) == brute(rows)
    assert centroids.clustered(df.limit(0)).count() == 0
    assert sorted(map(tuple, centroids.clustered(df.filter("vec_id < 3")).collect()), key=str) == brute([r for r in rows if r[0] is not None and r[0] < 3])


def test_large_components_are_exact_until_they_do_not_fit(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=64) * (1e6 if i % 2 else 1)]) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = sorted(((i, n, *[min(x, centroids.LONG) for x in sums], sha) for i, n, *sums, sha in brute(rows)), key=str)
    assert sorted(map(tuple, centroids.clustered(df).collect()), key=str) == want and want[0][3] == centroids.LONG
    df = spark.createDataFrame(rows + [(100, [1e300] * 64), (101, [-1e300] * 64)], "vec_id long, embedding array<double>")
    assert max(r.inertia for r in centroids.clustered(df).collect()) <= centroids.LONG


def test_abandoned_centroids_never_win():
    rng = np.random.default_rng(6)
    x, c = rng.integers(-3, 4, (500, 16)), rng.integers(-3, 4, (6, 16))
    c[4] = c[1]
    d = ((x[:, None] - c[None]) ** 2).sum(2)
    to, best = centroids.nearest(x, c)
    assert (to == d.argmin(1)).all() and (best == d.min(1)).all()
