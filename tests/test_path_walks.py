"""Paths are put together in one pass, whatever the nodes' type."""

import random

import pytest

from graphlake.operators import graph


def _least_paths(edges, seeds, depth):
    out = {}
    for seed in seeds:
        known = front = {seed: (seed,)}
        for _ in range(depth):
            new = {}
            for a, path in front.items():
                for b in (d for s, d in edges if s == a and d not in known):
                    new[b] = min(new.get(b, (*path, b)), (*path, b))
            known, front = known | new, new
        out |= {(seed, node): list(path) for node, path in known.items()}
    return out


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_paths_are_never_written_or_joined_between_rounds(spark, monkeypatch, kind):
    draw, name = random.Random(4), (int if kind == "bigint" else "n{:03d}".format)
    edges = sorted({(name(draw.randrange(90)), name(draw.randrange(90))) for _ in range(260)})
    seeds = [name(k) for k in (*range(0, 90, 9), 500)]
    written, settled = [], graph.settled
    monkeypatch.setattr(graph, "settled", lambda df: written.append(df.columns) or settled(df))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # a length of a seed's paths comes in several batches
    try:
        found = graph.paths_from(spark.createDataFrame(edges, f"src {kind}, dst {kind}"), spark.createDataFrame([(s,) for s in seeds], f"seed {kind}"), 6)
        rows = found.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(r.src, r.dst): r.path for r in rows} == _least_paths(edges, seeds, 6)
    assert len(rows) == len({(r.src, r.dst) for r in rows})
    assert not any("path" in columns for columns in written)
