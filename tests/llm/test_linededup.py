import random

import numpy as np
import pytest

from graphlake.llm import linededup
from graphlake.llm.linededup import CuckooFilter, LineIndex, key_of


def brute(texts, threshold):
    def key(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))

    split = [(t or "").split("\n") for t in texts]
    n = {}
    for lines in split:
        for k in {key(x) for x in lines} - {""}:
            n[k] = n.get(k, 0) + 1
    out = []
    for lines in split:
        kept = [x for x in lines if n.get(key(x), 0) < threshold]
        out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def corpus():
    rng = random.Random(4)
    common = ["Same line", "  same LINE\t", "Über uns", "über uns", "x", "", " "]
    texts = [None, "", "\n", "\n\n", "only\r", "Same line", "same line\n"]
    for _ in range(40):
        texts.append("\n".join(rng.choice(common) if rng.random() < 0.6 else f"own {rng.randrange(60)}" for _ in range(rng.randrange(1, 9))))
    return texts + [texts[-1]] * 3 + ["long " * 20_000 + "\nsame line"]


def run(index, df):
    return sorted((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in index.apply(df).collect())


def test_matches_brute_force_insert_delete(spark, monkeypatch):
    texts = corpus()
    df = spark.createDataFrame([(i, t, 7, "k") for i, t in enumerate(texts)], "doc_id long, text string, n_lines long, key string")
    want = sorted((i, *x) for i, x in enumerate(brute(texts, 5)))
    index = LineIndex.build(df, 5, shards=4)
    assert run(index, df) == want
    assert index.apply(df).columns == ["doc_id", "text", "n_lines", "key", "n_dropped"]
    half, rest = df.filter("doc_id % 2 = 0"), df.filter("doc_id % 2 = 1")
    grown = LineIndex.build(half, 5, shards=4).insert(rest)
    assert run(grown, df) == want
    back = grown.delete(rest)
    assert run(back, half) == sorted((i, *x) for i, x in zip([i for i in range(len(texts)) if i % 2 == 0], brute(texts[::2], 5)))
    assert sorted(map(tuple, back.counts.collect())) == sorted(map(tuple, LineIndex.build(half, 5, shards=4).counts.collect()))
    monkeypatch.setattr(linededup, "PASS_KEYS", 1)
    assert run(index, df) == want  # beyond what is broadcast, lines travel to their shard
    clashing = df.withColumnsRenamed({"key": "t0", "n_lines": "gone"})
    assert run(index, clashing) == want and index.apply(clashing).columns == ["doc_id", "text", "gone", "t0", "n_lines", "n_dropped"]
    assert index.apply(df.limit(0)).count() == 0


def test_deleting_twice_fails_and_blank_texts_never_do(spark):
    df = spark.createDataFrame([(1, "a\nb"), (2, None), (3, " \n")], "doc_id long, text string")
    index = LineIndex.build(df, 2)
    once = index.delete(df)
    assert once.counts.count() == 0 and once.delete(df.filter("doc_id > 1")).counts.count() == 0
    with pytest.raises(ValueError):
        once.delete(df)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert linededup.dedup_lines(df).count() == 0


def test_cuckoo_filter():
    keys = [key_of(b"%d" % i) for i in range(3000)]
    f = CuckooFilter.of(keys[:2000])
    assert all(k in f for k in keys[:2000]) and sum(k in f for k in keys[2000:]) < 20
    assert all(f.delete(k) for k in keys[:1000]) and all(k in f for k in keys[1000:2000]) and sum(k in f for k in keys[:1000]) < 20
    g = CuckooFilter.load(f.dump())
    assert (g.table == f.table).all()
    full = CuckooFilter(8)
    before = None
    for k in keys:
        before = full.table.copy()
        if not full.insert(k):
            break
    assert (full.table == before).all()
    assert key_of(b" \t\r") is None and key_of(" ÀB ".encode()) == key_of("Àb".encode())
    arr = np.frombuffer(b"".join(keys[:50]), np.uint8).reshape(-1, 16)
    assert (CuckooFilter.parts(arr)[0] > 0).all()
