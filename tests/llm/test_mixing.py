import hashlib

import pytest
from pyspark.sql import functions as F

from graphlake.llm import mixing


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    """The excess is shared anew, round by round."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, todo = {s: 0.0 for s in names}, share * sum(sizes.values())
    free = set(names)
    while todo > 1e-9 and free:
        total = sum(w[s] for s in free)
        give = {s: out[s] + todo * w[s] / total for s in free}
        todo = 0.0
        for s in list(free):
            out[s] = min(give[s], cap * sizes[s])
            if give[s] >= cap * sizes[s]:
                todo += give[s] - cap * sizes[s]
                free.discard(s)
    return out


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 5, None: 40}, {"a": 1, "b": 1, "c": 1, "d": 1000}, {"x": 0, "y": 10}, {"é": 7, "Z": 70, "z": 700, "": 3}])
def test_targets_match_resharing(spark, sizes):
    got = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()
    want = brute_targets(sizes)
    assert {r.source: pytest.approx(r.target) for r in got} == want
    assert all(r.target <= 2 * r.source_size for r in got)


def test_copies_nulls_repeats_and_clashing_columns(spark, monkeypatch):
    rows = [(1, "a b c", "s", 9), (1, "a b c", "s", 9), (2, None, "s", 9), (3, "", None, 9), (None, "x " * 5000, None, 9), (5, "w " * 40, "t", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_size long")
    got = mixing.mixed(docs).collect()
    assert len(got) == len(rows)
    sizes = {"s": 6, None: 5000, "t": 40}
    want = brute_targets(sizes)
    for r in got:
        assert r.mix_source_size == sizes[r.source] and r.mix_target == pytest.approx(want[r.source])
        rate = want[r.source] / sizes[r.source]
        key = "mix:" + ("" if r.doc_id is None else str(r.doc_id))
        draw = int(hashlib.md5(key.encode()).hexdigest()[:13], 16) / 2**52
        assert r.mix_copies == int(rate) + (draw < rate % 1)
    copies = sum(r.mix_copies for r in got)
    mixed = mixing.mix(docs)
    assert mixed.count() == copies and mixed.columns == docs.columns and {r.mix_size for r in mixed.collect()} == {9}
    monkeypatch.setattr(mixing, "few_rows", lambda df: False)
    salted = mixing.mixed(docs)
    assert sorted(map(str, salted.collect())) == sorted(map(str, got))
    assert mixing.mixed(docs.limit(0)).count() == 0


def test_taken_comes_near_the_target(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 50).cast("int")).alias("text"), (F.col("id") % 4).cast("string").alias("source"))
    got = mixing.mixed(docs).groupBy("source").agg(F.sum(F.col("mix_size") * F.col("mix_copies")).alias("taken"), F.first("mix_target").alias("target")).collect()
    assert all(abs(r.taken - r.target) < 0.03 * r.target for r in got)
