"""Queries over plain tables use every row: small tables against plain loops."""

import math

import pytest

from graphlake.operators import temporal
from graphlake.plans import tables

# (order, line, part): returned lines; parts 0 to 39. Line 3 and beyond make most of the calls.
LINES = [(1, 1, 1), (1, 2, 2), (1, 3, 3), (1, 4, 1), (2, 1, 4), (2, 2, 5), (2, 3, 30), (2, 5, 31), (2, 6, 4), (3, 3, 33), (3, 4, 34), (3, 7, 35)]
PAIRS = {(1, 2), (2, 3), (3, 1), (4, 5), (5, 30), (30, 31), (31, 4), (33, 34), (34, 35)}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(o, n, p, 1, "R") for o, n, p in LINES], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string").write.parquet(f"{d}/lineitem.parquet")
    spark.createDataFrame([(i, f"part {i}", "kind", "Brand", 1) for i in range(40)], "p_partkey long, p_name string, p_type string, p_brand string, p_size int").write.parquet(f"{d}/part.parquet")
    spark.createDataFrame([(i, [float(i % 3), float(i % 5), 1.0 + i]) for i in range(25)], "vec_id long, embedding array<float>").write.parquet(f"{d}/embeddings.parquet")
    return d


def got(f, spark, folder):
    return {tuple(r) for r in f(spark, folder).collect()}


def test_every_call_edge_counts(spark, folder):
    called = {b for _, b in PAIRS}
    assert {i for i, _ in got(tables.dead_code, spark, folder)} == {i for i in range(40) if i % 4 < 2 and i not in called}
    assert got(tables.weak_components, spark, folder) == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (30, 4), (31, 4), (33, 33), (34, 33), (35, 33)}
    assert got(tables.strong_components, spark, folder) == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (30, 4), (31, 4)}
    assert got(tables.tiers, spark, folder) == {(1, 2), (2, 1), (3, 0), (4, 3), (5, 2), (30, 1), (31, 0), (33, 2), (34, 1), (35, 0)}


def reached(pairs):
    out = set()
    for seed in range(40):
        hops, front = {seed: 0}, [seed]
        for k in range(1, 4):
            front = sorted({b for a, b in pairs if a in front} - set(hops))
            hops |= dict.fromkeys(front, k)
        out |= {(seed, n, h) for n, h in hops.items() if h}
    return out


def test_every_symbol_is_asked_for(spark, folder):
    assert got(tables.callees, spark, folder) == PAIRS and got(tables.callers, spark, folder) == {(b, a) for a, b in PAIRS}
    assert got(tables.reachable_callees, spark, folder) == reached(PAIRS)
    assert got(tables.impact, spark, folder) == reached({(b, a) for a, b in PAIRS})


def test_every_hundredth_vector_is_asked_for(spark, folder):
    v = {i: (float(i % 3), float(i % 5), 1.0 + i) for i in range(25)}
    score = lambda a, b: round(sum(x * y for x, y in zip(a, b)) / (math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))), 6)
    want = {q: [i for _, i in sorted((-score(v[q], v[i]), i) for i in v)[:10]] for q in v}
    frame = tables.table(spark, folder, "embeddings").selectExpr("vec_id AS id", "embedding AS v")
    expected = lambda asked: sorted((q, k + 1, i) for q, ids in want.items() if q in asked for k, i in enumerate(ids))
    rows = lambda df: sorted((r.query, r["rank"], r.id) for r in df.collect())
    assert rows(tables.semantic_search(spark, folder)) == expected({0})  # ids divisible by 100
    assert rows(temporal.semantic_search(frame, frame.selectExpr("id AS query", "v AS q"), 10, block=4)) == expected(set(v))
