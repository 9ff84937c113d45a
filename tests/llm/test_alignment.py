import hashlib
import random
from collections import Counter, defaultdict

import pytest

from graphlake.llm import alignment


def tokens(text):
    """(id, bytes) lists of both sides, straight from the libraries."""
    import public_tokenizers as p
    import sentencepiece
    from tokenizers import Tokenizer

    if not hasattr(tokens, "a"):
        tokens.a = Tokenizer.from_file(p.path("byte_bpe_50k.json"))
        tokens.a.encode_special_tokens = True
        tokens.b = sentencepiece.SentencePieceProcessor(model_file=p.path("piece_bpe_32k.model"))
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        tokens.byte, n = {chr(b): b for b in plain}, 0
        for b in range(256):
            if b not in plain:
                tokens.byte[chr(256 + n)], n = b, n + 1
    a = [(i, bytes(tokens.byte[c] for c in tokens.a.id_to_token(i))) for i in tokens.a.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in tokens.b.encode(text):
        piece = tokens.b.id_to_piece(i)
        b.append((i, bytes.fromhex(piece[3:5]) if tokens.b.is_byte(i) else piece.replace("▁", " ").encode()))
    return a, b


def brute(rows):
    def spans(side):
        at, out = 0, []
        for i, data in side:
            out.append((i, at, at + len(data)))
            at += len(data)
        return out

    told, held = [], defaultdict(set)
    for n, (i, text) in enumerate(rows):
        a, b = tokens(text) if text else ([], [])
        whole = (" " + (text or "")).encode()
        if not text or b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            told.append((i, [], [], [], ""))
            continue
        a, b = spans(a), spans(b)
        links = [(x, y) for x, s, e in a for y, t, f in b if s < f and t < e]
        for pair in links:
            held[pair].add(n)
        groups, last = [], 0
        for end in sorted({e for *_, e in a} & {e for *_, e in b}):
            groups.append(",".join(str(x) for x, s, e in a if last <= s and e <= end) + "|" + ",".join(str(x) for x, s, e in b if last <= s and e <= end))
            last = end
        told.append((i, a, b, links, ";".join(groups)))
    counts, most = {p: len(d) for p, d in held.items()}, Counter()
    for (x, _), c in counts.items():
        most[x] = max(most[x], c)
    return sorted(
        ((i, len(a), len(b), g.count(";") + 1 if g else 0, len(links), sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(g.encode()).hexdigest() if g else "") for i, a, b, links, g in told), key=str
    )


def texts():
    rng = random.Random(3)
    words = ["the", "token", "izer", "Straße", "naïve", "日本語", "👩‍👩‍👧", " ", "<s>", "<|endoftext|>", "<0x41>", "12345", "x" * 40, "don't", "\n\n", "\t", "  ", "é", "é", "\x00", "http://a.b/c?d=e", "ﬁ", "①"]
    rows = [(None, None), (1, None), (2, ""), (3, " "), (4, "▁ already"), (5, "<unk> </s> <|endoftext|>"), (6, "a"), (6, "a"), (None, "a b"), (7, "\n"), (8, "   lead and trail   ")]
    rows += [(100 + i, "".join(rng.choice(words) + rng.choice(["", " ", " ", "\n"]) for _ in range(rng.randrange(1, 60)))) for i in range(120)]
    return rows + [(300, " ".join(rng.choice(words) for _ in range(400)))]


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, key int, pairs string")


@pytest.mark.parametrize(("frequent", "size"), [(alignment.FREQUENT, alignment.SLICE), (40, 300), (0, 1)])
def test_matches_brute_force(spark, monkeypatch, frequent, size):
    monkeypatch.setattr(alignment, "FREQUENT", frequent)
    monkeypatch.setattr(alignment, "SLICE", size)
    rows = texts()
    df = table(spark, rows).repartition(5)
    got = alignment.aligned(df)
    assert got.columns == ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_both_sides_of_a_group_are_the_same_bytes(spark):
    b = alignment.sides(*alignment._paths(None, None))
    told = [r.groups for r in alignment.groups(table(spark, texts())).collect() if r.groups]
    assert len(told) > 100
    for part in [p for t in told for p in t.split(";")]:
        left, right = ([int(x) for x in side.split(",")] for side in part.split("|"))
        assert b"".join(b.a_data[i] for i in left) == b"".join(b.b_data[i] for i in right)


def test_ids_are_those_of_the_libraries():
    rng = random.Random(9)
    letters = "abcXYZ 019  \n\n\t'sé×÷ªº²§ÿŁ\x0b\r.,!?-_<>▁\x1c\xad\xa0\x85日😀٣Ⅷ"
    both = alignment.sides(*alignment._paths(None, None))
    texts = ["".join(rng.choice(letters[: rng.choice([9, 20, 34, len(letters)])]) for _ in range(rng.randrange(1, 50))) for _ in range(5000)]
    texts += ["<|endoftext|> it's", "x" * 5000, " " * 300 + "a", "a" + " " * 300, "\n" * 50, "don't we'LL I'd"]
    spaced = [" " + t for t in texts]
    assert sum(alignment.CERTAIN.fullmatch(t) is not None for t in spaced) > 1000
    for t, a, b in zip(texts, both.a(spaced), both.b(spaced), strict=True):
        assert [a.tolist(), b.tolist()] == [[i for i, _ in side] for side in tokens(t)], t


def test_no_rows_and_no_tokens(spark):
    df = table(spark, [(1, None), (2, "")])
    assert alignment.aligned(df.limit(0)).count() == 0
    assert sorted(map(tuple, alignment.aligned(df).collect())) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
