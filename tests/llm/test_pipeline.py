import random
from collections import Counter

import pytest

from tests.llm.test_linededup import brute as brute_lines
from tests.llm.test_mixing import brute_targets
from tests.llm.test_simhash import brute_components, brute_fp
from tests.llm.test_toxicity import BAD, text

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    bodies = [text(rng, i % 4 == 0, 80) for i in range(160)]
    for i in range(0, 150, 6):
        bodies[i] += "\nShared footer line"
    bodies[21] = bodies[11]
    bodies[31] = bodies[13].replace(" ", "  ", 3)
    rows = [(i, None if i == 77 else "" if i == 78 else b, "en", f"src{i % 5}" if i % 9 else None, len(b)) for i, b in enumerate(bodies)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(150)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_match_plain_versions(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    before = {r.doc_id: r for r in docs.collect()}

    clean = stages["toxicity"](spark, docs, folder)
    assert clean.columns == columns
    kept = {r.doc_id: r for r in clean.collect()}
    toxic = {i for i, r in before.items() if any(b in (r.text or "") for b in BAD)}
    assert len(toxic - set(kept)) >= 0.9 * len(toxic) and len(set(before) - toxic - set(kept)) <= 2
    assert all(kept[i] == before[i] for i in kept)

    lines = stages["line dedup"](spark, clean, folder)
    assert lines.columns == columns
    order = sorted(kept)
    want = {i: t for i, (t, _, _) in zip(order, brute_lines([kept[i].text for i in order], 10), strict=True)}
    now = {r.doc_id: r for r in lines.collect()}
    assert {i: r.text for i, r in now.items()} == want and all(r.n_chars == len(r.text) for r in now.values())

    firsts = stages["simhash near-dedup"](spark, lines, folder)
    assert firsts.columns == columns
    of = brute_components(order, [brute_fp(want[i], 5) for i in order])
    one = {r.doc_id: r for r in firsts.collect()}
    assert set(one) == set(of.values()) and all(one[i] == now[i] for i in one)
    assert not {21, 31} & set(one) and {11, 13} <= set(one) | toxic

    mixed = stages["mixing"](spark, firsts, folder)
    assert mixed.columns == columns
    sizes = Counter()
    for r in one.values():
        sizes[r.source] += len(r.text.split())
    target, taken = brute_targets(dict(sizes)), Counter()
    copies = Counter(r.doc_id for r in mixed.collect())
    for i, n in copies.items():
        rate = target[one[i].source] / sizes[one[i].source]
        assert n in (int(rate), int(rate) + 1) and n <= 2
        taken[one[i].source] += n * len(one[i].text.split())
    assert all(abs(taken[s] - target[s]) < 0.3 * target[s] for s in target)

    last = stages["packing"](spark, mixed, folder).collect()
    assert Counter(r.doc_id for r in last if r.piece == 0) == copies
    whole = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in whole) == Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in last)


ODD = [(None, None, "q"), (None, None, "q"), (None, "a text without id", "r"), (3, "one text of three", "s"), (3, "another text of id three, unlike the first", "t"), (5, "x " * 40_000, "u"), (6, "", None)]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_odd_rows_and_columns(spark, folder, name):
    apply = dict(corpus_pipeline.STAGES)[name]
    extra = "score double, predicted int, n_lines long, mix_size long, mix_copies int, __k0 string, t0 long, n_chars long"
    docs = spark.createDataFrame([(i, t, s, 0.25, 7, 777, 888, 9, "k", 11, len(t or "")) for i, t, s in ODD], f"doc_id long, text string, source string, {extra}")
    got = apply(spark, docs, folder)
    assert got.columns == docs.columns and apply(spark, docs.limit(0), folder).count() == 0
    rows = got.collect()
    assert all((r.score, r.predicted, r.n_lines, r.mix_size, r.mix_copies, r["__k0"], r.t0) == (0.25, 7, 777, 888, 9, "k", 11) for r in rows)
    texts = Counter((r.doc_id, r.text or "") for r in rows)
    want = Counter((i, t or "") for i, t, _ in ODD)
    if name == "simhash near-dedup":
        del want[(None, "")]  # the empty text of id 6 stands for those without an id
        want = Counter(set(want))
    assert set(texts) == set(want) if name != "mixing" else set(texts) <= set(want)
    assert name == "mixing" or texts == want


def test_packing_takes_odd_rows(spark, folder):
    docs = spark.createDataFrame([(i, t, s, 1) for i, t, s in ODD], "doc_id long, text string, source string, length long")
    got = dict(corpus_pipeline.STAGES)["packing"](spark, docs, folder)
    assert Counter(r.doc_id for r in got.collect() if r.piece == 0) == Counter(i for i, _, _ in ODD)
    assert dict(corpus_pipeline.STAGES)["packing"](spark, docs.limit(0), folder).count() == 0
