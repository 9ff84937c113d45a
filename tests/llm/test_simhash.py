import random

import numpy as np
import pytest
import xxhash

from graphlake.llm import simhash
from graphlake.llm.components import components


def brute_fp(text, size=4):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        t = t.replace(c, " ")
    words = [w for w in t.split(" ") if w]
    if not words:
        return 0
    sh = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hs = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(ids, fps, distance=4):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= distance:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(fps)):
        groups.setdefault(find(i), []).append(ids[i])
    return {ids[i]: min(groups[find(i)]) for i in range(len(fps))}


def test_fingerprint_matches_brute_force():
    rng = random.Random(1)
    for text in [None, "", "  \n ", "One", "a b c", "A b C d", "é Ü ß ü", "x y z w v u", " ".join(rng.choice("abcdefg") for _ in range(500))]:
        assert simhash.fingerprint(text) == brute_fp(text), text


def test_links_match_brute_force(spark):
    rng = random.Random(2)
    fps = {rng.getrandbits(64) for _ in range(300)}
    for f in list(fps)[:120]:
        for _ in range(3):
            for b in rng.sample(range(64), rng.choice([1, 2, 3, 4, 5])):
                f ^= 1 << b
            fps.add(f)
    fps = sorted(fps)
    ids = list(range(len(fps)))
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    got = {r.node: r.root for r in components(simhash.fingerprint_links(df)).collect()}
    want = brute_components(ids, fps)
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    groups = {}
    for i in ids:
        groups.setdefault(want[i], []).append(signed[i])
    for members in groups.values():
        assert {got.get(m, m) for m in members} == {min(members)}


@pytest.mark.parametrize(("crowded", "finest"), [(400, 16), (60, 8), (30, 4)])
def test_crowded_points_meet_on_finer_grids(spark, monkeypatch, crowded, finest):
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    monkeypatch.setattr(simhash, "FINEST", finest)
    rng = random.Random(4)
    fps = {rng.getrandbits(64) for _ in range(500)}
    for f in list(fps)[:100]:
        for _ in range(3):
            for b in rng.sample(range(64), rng.choice([1, 3, 4, 5])):
                f ^= 1 << b
            fps.add(f)
    fps = sorted(fps)
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = {r.node: r.root for r in components(simhash.fingerprint_links(df)).collect()}
    of, least = brute_components(list(range(len(fps))), fps), {}
    for i, c in of.items():
        least[c] = min(least.get(c, signed[i]), signed[i])
    assert {s: got.get(s, s) for s in signed} == {signed[i]: least[c] for i, c in of.items()}


def test_keep_first_tells_rows_apart(spark):
    rows = [(1, "alpha beta gamma delta", 1, "p"), (1, "wholly other words stand here", 1, "q"), (2, "wholly other words stand here", 2, "r"), (None, "a third text without id", 3, "s"), (None, "a third text without id", 3, "s"), (None, "alpha beta gamma delta", 3, "t"), (7, None, 4, "u"), (6, "", 5, "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k0 int, `__k0` string")
    want = sorted([rows[0], rows[1], rows[3], rows[7]], key=str)
    assert sorted(map(tuple, simhash.keep_first(docs).collect()), key=str) == want
    assert simhash.keep_first(docs).columns == docs.columns
    assert simhash.keep_first(docs.limit(0)).count() == 0


def test_crowded_points_split(monkeypatch):
    rng = random.Random(3)
    base = rng.getrandbits(64)
    fps = {base}
    while len(fps) < 1500:
        f = base
        for b in rng.sample(range(64), rng.choice([2, 4, 6, 8])):
            f ^= 1 << b
        fps.add(f)
    arr = np.array(sorted(fps), np.uint64)
    monkeypatch.setattr(simhash, "BRUTE", 64)
    got = {frozenset(map(int, p)) for a, b in simhash._pairs(arr, arr, 4, 8, True) for p in zip(a, b)}
    i, j = np.nonzero(np.triu(np.bitwise_count(arr[:, None] ^ arr[None, :]) <= 4, 1))
    assert got == {frozenset((int(arr[x]), int(arr[y]))) for x, y in zip(i, j)}


def test_documents_ties_nulls_and_extra_columns(spark):
    rows = [(5, "the quick brown fox jumps", 1), (3, "THE quick  brown fox\njumps", 2), (9, None, 3), (8, "", 4), (8, "", 4), (None, "alone among all these", 5), (1, "z " * 3000, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp long")
    got = sorted(((r.id, r.component_id) for r in simhash.simhash_components(docs).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (9, 8), (8, 8), (8, 8), (None, None), (1, 1)], key=str)
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([3, 8, 1, None], key=str)
    assert simhash.simhash_components(docs.limit(0)).count() == 0


def test_components_long_path(spark):
    n = 200
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(7, 7), (1000, 1001), (1001, 1000)], "u long, v long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 1000: 1000, 1001: 1000}
