import random
import re

from graphlake.llm import license_scan


def brute(texts, templates, similarity=0.8):
    def shingles(t):
        w = [x for x in re.split(r"[^0-9a-z\u0080-\U0010ffff]+", (t or "").lower()) if x]
        return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    out = []
    for i, t in texts:
        own = shingles(t)
        for name, template in templates:
            want = shingles(template)
            if want and len(want & own) >= similarity * len(want):
                out.append((i, name, len(want & own), len(want)))
    return sorted(out, key=str)


def test_matches_brute_force(spark):
    rng = random.Random(17)
    filler = lambda n: " ".join("".join(rng.choice("abcdefé") for _ in range(rng.randrange(2, 8))) for _ in range(n))
    texts = [(None, None), (1, ""), (2, "license"), (3, "released UNDER the mit--license!"), (3, "released UNDER the mit--license!")]
    for i in range(150):
        _, template = rng.choice(license_scan.TEMPLATES)
        words = template.split()
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            words[rng.randrange(len(words))] = "changed"
        texts.append((10 + i, filler(rng.randrange(60)) + "\n" + " ".join(words) + " " + filler(rng.randrange(60))))
    texts.append((999, filler(30_000) + " " + license_scan.TEMPLATES[3][1] + " " + filler(3000)))
    texts += [(2000 + i, filler(100)) for i in range(30)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in texts], "doc_id long, text string, key string, license_id int")
    got = sorted(((r.id, r.license_id, r.n_shared, r.n_shingles) for r in license_scan.scan(docs).collect()), key=str)
    assert got == brute(texts, license_scan.TEMPLATES)
    own = [("tiny", "one two"), ("none", "--"), ("six", "a b c d e f")]
    short = [(1, "One, two"), (2, "one two three"), (3, "x a b c d e f y"), (4, "a b c d e g")]
    docs = spark.createDataFrame(short, "doc_id long, text string")
    got = sorted(((r.id, r.license_id, r.n_shared, r.n_shingles) for r in license_scan.scan(docs, own).collect()), key=str)
    assert got == brute(short, own)
    assert license_scan.scan(docs.limit(0)).count() == 0


def test_many_candidates_are_joined(spark, monkeypatch):
    monkeypatch.setattr(license_scan, "few_rows", lambda df, *limit: False)
    monkeypatch.setattr(license_scan, "TEMPLATE_SHINGLES", 0)
    docs = spark.createDataFrame([(1, "Released under the MIT License.")] * 3, "doc_id long, text string")
    assert license_scan.scan(docs).count() == 3


def test_a_lone_shingle_is_always_met(spark):
    rng = random.Random(18)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    texts = []
    for i in range(600):
        words = [word() for _ in range(rng.randrange(1, 80))]
        at = rng.randrange(len(words) + 1)
        texts.append((i, " ".join(words[:at] + ["Released under the MIT License."] + words[at:])))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert sorted(r.id for r in license_scan.scan(docs).collect()) == list(range(600))


def test_bands_alone_find_templates(spark, monkeypatch):
    docs = spark.createDataFrame([(1, license_scan.TEMPLATES[4][1]), (2, license_scan.TEMPLATES[3][1])], "doc_id long, text string")
    assert license_scan.scan(docs).count() == 3  # the long notice begins with the short one
    banded = license_scan.banded
    monkeypatch.setattr(license_scan, "banded", lambda *a: banded(*a).limit(0))
    assert license_scan.scan(docs).count() == 0


def test_lone_shingles_of_longer_templates(spark):
    """Four of the five shingles of a template, each far from the others."""
    rng = random.Random(19)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    templates = [(str(k), " ".join(word() for _ in range(9))) for k in range(40)]
    texts = []
    for i in range(400):
        words = rng.choice(templates)[1].split()
        parts = [words[k : k + 5] for k in rng.sample(range(5), 4)]
        texts.append((i, " ".join(" ".join([word() for _ in range(7)] + p) for p in parts)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = sorted(((r.id, r.license_id, r.n_shared, r.n_shingles) for r in license_scan.scan(docs, templates).collect()), key=str)
    assert got == brute(texts, templates) and len(got) == 400
