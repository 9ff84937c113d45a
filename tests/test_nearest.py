import numpy as np
import pytest

from graphlake.operators import nearest


def brute(vectors, queries, k):
    def fine(v):
        return bool(v) and all(x is not None and np.isfinite(x) for x in v)

    out = []
    for q, a in queries:
        if fine(a):
            scored = []
            for i, b in vectors:
                if fine(b):
                    n = np.linalg.norm(a) * np.linalg.norm(b)
                    scored.append((-round(float(np.dot(a, b) / n) if n else 0.0, 6) + 0.0, i))
            out += [(q, i, -s, r) for r, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted((q, i, s + 0.0, r) for q, i, s, r in out)


def drawn(n, dims, clusters, spread, seed=1):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(clusters, dims)) * 3
    return [(k, [float(x) for x in middles[k % clusters] + rng.normal(size=dims) * spread]) for k in range(n)]


def table(spark, rows, name, v):
    return spark.createDataFrame(rows, f"{name} long, {v} array<double>")


@pytest.mark.parametrize("blocks", [(32_768, 4096), (15, 3)])
def test_matches_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(nearest, "ROW_BLOCK", blocks[0])
    vectors = drawn(300, 8, 12, 0.4) + [(1000 + k, drawn(1, 8, 1, 0)[0][1]) for k in range(8)] + [(2000, [0.0] * 8), (2001, [0.0] * 8), (2002, None), (2003, [None] * 8), (2004, [float("nan")] * 8), (2005, [])]
    queries = [(k, v) for k, v in vectors if k % 10 == 0]
    got = nearest.search(table(spark, vectors, "id", "v"), table(spark, queries, "query", "q"), 7, block=blocks[1])
    assert sorted((r.query, r.id, r.score + 0.0, r["rank"]) for r in got.collect()) == brute(vectors, queries, 7)
    few = table(spark, vectors[:3], "id", "v")
    assert nearest.search(few, table(spark, queries, "query", "q"), 7).count() == 3 * sum(bool(v) and None not in v and not np.isnan(v).any() for _, v in queries)
    assert nearest.search(few.limit(0), table(spark, queries, "query", "q"), 7).count() == 0 == nearest.search(few, table(spark, [], "query", "q"), 7).count()


def test_few_vectors_are_compared_where_they_lie_in_clusters(spark):
    vectors = drawn(4000, 16, 60, 0.1)
    queries = vectors[::100]
    met = nearest.meetings(table(spark, vectors, "id", "v"), table(spark, queries, "query", "q"), 5)
    assert met.agg({"seen": "sum"}).first()[0] < 0.15 * len(vectors) * len(queries)
