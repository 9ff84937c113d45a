import numpy as np
import pytest

from graphlake.llm import forest


def brute(rows, asked, k=5):
    def fine(v):
        return bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    known = sorted({(i, tuple(v)) for i, v in rows if fine(v)}, key=lambda r: (r[0] is None, r[0] or 0))
    out = []
    for i, v in asked:
        if fine(v):
            q = np.array(v)
            cos = [(-(np.array(w) @ q) / np.sqrt((np.array(w) @ np.array(w)) * (q @ q)), j is None, j) for j, w in known if i is None or j != i]
            out += [(i, n, j, -s) for n, (s, _, j) in enumerate(sorted(((round(s, 12), b, j) for s, b, j in cos), key=lambda t: t[:2] + (t[2] or 0,))[:k], 1)]
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], "vec_id long, embedding array<double>, key int, leaf string, h int")


def answers(df, asked):
    return sorted(((r.query_id, r["rank"], r.id, round(r.score, 12)) for r in forest.neighbours(df, asked).collect()), key=str)


@pytest.fixture
def whole(monkeypatch):
    """A budget that takes every leaf: the search is exact, so all but its choice of leaves is put to the test."""
    fitted = forest.fitted
    monkeypatch.setattr(forest, "fitted", lambda *a: (fitted(*a)[0], float(forest.TREES)))


def test_a_full_budget_is_brute_force(spark, whole, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in rng.normal(size=12)]) for i in rng.permutation(400)]
    same = rows[3][1]
    rows += [(1000 + i, same) for i in range(120)] + [(3000, [x * 2 for x in same]), (3050, [-0.0 if x == 0 else x for x in same])]
    rows += [(2000, None), (2050, []), (2100, [0.0] * 12), (2150, [None] + [1.0] * 11), (2200, [float("nan")] * 12), (2250, [float("inf")] + [0.0] * 11), (None, rows[5][1]), (None, [1.0] * 12), rows[7], rows[7]]
    df = table(spark, rows).repartition(6)
    asked = [r for r in rows if r[0] is not None and r[0] % 50 == 0]
    want = sorted(((i, n, j, round(s, 12)) for i, n, j, s in brute(rows, asked)), key=str)
    assert answers(df, df.filter("vec_id % 50 = 0")) == want
    monkeypatch.setattr(forest, "ROW_BLOCK", 20)
    monkeypatch.setattr(forest, "QUERY_BLOCK", 5)
    assert answers(df, df.filter("vec_id % 50 = 0")) == want


def test_few_vectors_none_and_shorter_ones(spark, whole):
    df = table(spark, [(50, [1.0, 0.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 0.0, 3.0]), (100, None)])
    assert answers(df, df.filter("vec_id % 50 = 0")) == [(50, 1, 1, round(0.5**0.5, 12)), (50, 2, 2, 0.0)]
    one = df.filter("vec_id = 50")
    assert forest.neighbours(one, one).count() == 0
    assert forest.neighbours(df.limit(0), df.limit(0)).count() == 0 == forest.neighbours(df, df.limit(0)).count()


def test_sizes_of_components_do_not_matter(spark, whole):
    df = table(spark, [(50, [1e300, 1e300]), (1, [1e-300, 0.0]), (2, [1e-320, 1e-320]), (3, [-1.0, 2.0])])
    assert [r[2] for r in answers(df, df.filter("vec_id = 50"))] == [2, 1, 3]


def test_recall_at_the_calibrated_budget(spark):
    rng = np.random.default_rng(2)
    rows = rng.normal(size=(3000, 64))
    rows[1500:] = rows[rng.integers(0, 40, 1500)] + rng.normal(size=(1500, 64)) * 0.4
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rows)]
    df = table(spark, rows)
    want = {(i, j) for i, _, j, _ in brute(rows, rows[::50])}
    got = {(r.query_id, r.id) for r in forest.neighbours(df, df.filter("vec_id % 50 = 0")).collect()}
    assert len(got) == len(want) and len(got & want) >= 0.93 * len(want)


def test_the_queue_gives_every_leaf_once_nearest_cells_first():
    rng = np.random.default_rng(3)
    x = forest.unit(rng.normal(size=(600, 10)))
    f = forest.Forest([forest.grown(x, 4, rng) for _ in range(3)])
    order = list(f.search(x[0]))
    assert sorted(order) == list(range(48)) and set(f.leaves(x[:1])[0].tolist()) == set(order[:3])
    assert (np.bincount(f.leaves(x).ravel(), minlength=48) > 0).all()


def test_clustered_vectors_take_a_small_budget():
    rng = np.random.default_rng(4)
    middles = rng.normal(size=(100, 64)) * 3
    x = forest.unit(np.repeat(middles, 40, 0) + rng.normal(size=(4000, 64)) * 0.1)
    _, tight = forest.fitted(x[rng.permutation(4000)], 4000, 5)
    _, loose = forest.fitted(forest.unit(rng.normal(size=(4000, 64))), 4000, 5)
    assert tight < 0.8 < loose
