import random
import zlib

import numpy as np
import pytest
import zstandard as zstd

from graphlake.llm import toxicity

BAD = ["gribbletosh", "vornakkle", "squimfrot"]


def text(rng, bad, n=120):
    syllables = ["the", "an", "tion", "er", "ha", "re", "ou", "nd", "ing", "st"]
    words = ["".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(n)]
    for _ in range(5 if bad else 0):
        words.insert(rng.randrange(n), rng.choice(BAD))
    return " ".join(words)


@pytest.fixture(scope="module")
def model():
    rng = random.Random(7)
    return toxicity.train([text(rng, True) for _ in range(120)], [text(rng, False) for _ in range(300)], 0.25)


def test_held_out_accuracy(model):
    rng, score = random.Random(8), model.scorer()
    right = [(score(text(rng, bad)) >= 0.5) == bad for bad in [True, False] * 100]
    assert sum(right) >= 195
    tail = text(rng, False, 3000)
    assert score(tail) < 0.5 <= score(tail + " " + " ".join(BAD * 4))  # whole texts, not prefixes


def test_edges(model):
    score = model.scorer()
    assert 0 <= score(None) == score("") <= 1 and 0 <= score("é") <= 1
    none = toxicity.train([], ["a"] * 10, 0.0)
    assert none.scorer()("anything") == 0.0
    short = toxicity.train(["aa bb"] * 6, [""] * 6, 0.5).scorer()
    assert 0 <= short("aa bb") <= 1


def test_fit_and_score_documents(spark):
    rng = random.Random(9)
    rows = [(i, text(rng, i % 3 == 0), 1.0, i) for i in range(240)] + [(None, None, 1.0, 0), (500, "", 1.0, 0), (0, text(rng, True), 1.0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, id long")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(200)] + [(None, 1), (5, None), (900, 1), (7, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.scored(docs, model).collect()
    assert len(got) == len(rows)
    assert toxicity.scored(docs, model).columns == ["doc_id", "text", "id", "score", "predicted"]
    held = [r for r in got if r.doc_id is not None and 200 <= r.doc_id < 240]
    assert sum(r.predicted == (r.doc_id % 3 == 0) for r in held) >= 38
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert toxicity.scored(docs.limit(0), model).count() == 0
    assert toxicity.fit(docs.limit(0), labels).toxic == b""
    folds = docs.filter("doc_id is not null").select("doc_id", toxicity.fold().alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.doc_id).encode()) % 5 for r in folds)


def test_scores_match_plain_version(model):
    """Windows by hand, a fresh compressor for each, the curve by math."""
    import math

    rng = random.Random(10)

    def size(window, dictionary):
        settings = zstd.ZstdCompressionParameters.from_level(9, write_content_size=False, write_checksum=False, write_dict_id=False, format=zstd.FORMAT_ZSTD1_MAGICLESS, window_log=17, hash_log=17, chain_log=17, min_match=5)
        return len(zstd.ZstdCompressor(compression_params=settings, dict_data=zstd.ZstdCompressionDict(dictionary, dict_type=zstd.DICT_TYPE_RAWCONTENT)).compress(window))

    score = model.scorer()
    for t in [None, "", "é" * 200, text(rng, True), text(rng, False), text(rng, True, 900), text(rng, False, 4000)]:
        data, saved, at = (t or "").encode(), [], 0
        while True:
            saved.append(size(data[at : at + 128], model.ordinary) - size(data[at : at + 128], model.toxic))
            at += 64
            if at >= len(data) - 64:
                break
        best = sorted(saved)[-3:]
        x = [sum(saved) / len(saved), min(max(saved), 12), min(sum(best) / len(best), 12), sum(d >= 3 for d in saved) / len(saved), 1]
        z = sum(a * b for a, b in zip(x, model.weights))
        assert score(t) == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))))


def test_both_dictionaries_are_trained_on_windows():
    rng = random.Random(11)
    toxic, ordinary = [text(rng, True).encode() for _ in range(120)], [text(rng, False).encode() for _ in range(300)]
    t, o = toxicity._dictionaries(toxic, ordinary)
    front = t[: len(t) - len(o.lstrip(b" "))]
    assert len(t) == len(o) and t.endswith(o[len(front) :]) and all(any(b[i : i + 6].encode() in front for i in range(len(b) - 5)) and b.encode() not in o for b in BAD)
    words = {w for d in ordinary for w in d.split()}
    assert sum(w in words for w in o.split()) > 100
    # Pieces of toxic text as they stand, not a list of words: most of what the toxic dictionary holds is found in some toxic text whole.
    runs = [front[i : i + toxicity.KEYS] for i in range(len(front) // 3, len(front) - toxicity.KEYS, toxicity.KEYS)]
    assert sum(any(r in d for d in toxic) for r in runs) > len(runs) / 2 and any(w in words for w in front.split())


def test_too_few_samples_are_dealt_evenly():
    some = [bytes([65 + k]) * 10 for k in range(20)]
    got = toxicity._dictionary(some, 50, 16)
    assert len(got) <= 50 and got.endswith(b"Q" * 10)


def test_long_texts_are_scored_whole_and_not_learned_from(spark):
    rng = random.Random(12)
    docs = spark.createDataFrame([(i, text(rng, i % 2 == 0)) for i in range(40)] + [(50, text(rng, False, 30_000) + " " + " ".join(BAD))], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(40)] + [(50, 0)], "doc_id long, toxic int")
    one, two = (toxicity.fit(d, labels) for d in (docs, docs.filter("doc_id < 50")))
    assert one.toxic == two.toxic and np.allclose(one.weights, two.weights)
