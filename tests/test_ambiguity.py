import itertools
import random
import re

import pytest

from graphlake.functions.ambiguity import ambiguous
from graphlake.operators import lines

BAD = [r"^(a+)+$", r"(a*)*", r"(a|a)*b", r"(a|b|ab)*c", r"(\w+\s?)*$", r"([a-z]+)*\d", r"(x+x+)+y", r"(.*)*x", r"(a|[ab])+", r"(\d+|\w)+!", r"^(?<n>a+b?)+$", r"((ab)*|a|b)*c"]
GOOD = [r"a+b+c+", r"^[a-z]+$", r"(ab)*", r"(a|b)*", r"\d+\.\d+", r"(\w+,)*\w+", r"(a+b)+", r"^(?:x[0-9]{2,4};)+$", r"[", r"(", r"", r"a{3}", r"(?=a+)b", r"(a?b)*", r"(foo|bar)+baz"]


def ways(tree, text):
    """In how many ways a tree of ('a', '|', '.', '*') reads all of a text; stars take no empty turns."""
    kind = tree[0]
    if kind == "lit":
        return int(text == tree[1])
    if kind == "|":
        return sum(ways(t, text) for t in tree[1:])
    if kind == ".":
        return sum(ways(tree[1], text[:k]) * ways(tree[2], text[k:]) for k in range(len(text) + 1))
    return 1 if not text else sum(ways(tree[1], text[:k]) * ways(tree, text[k:]) for k in range(1, len(text) + 1))


def drawn(rng, depth):
    if depth == 0 or rng.random() < 0.2:
        return ("lit", rng.choice("ab"))
    kind = rng.choice("|..*")
    return (kind, drawn(rng, depth - 1)) if kind == "*" else (kind, drawn(rng, depth - 1), drawn(rng, depth - 1))


def written(tree):
    kind = tree[0]
    if kind == "lit":
        return tree[1]
    return f"(?:{written(tree[1])})*" if kind == "*" else f"(?:{'|'.join(map(written, tree[1:]))})" if kind == "|" else f"{written(tree[1])}{written(tree[2])}"


def test_known_patterns():
    assert [p for p in BAD if not ambiguous(p)] == [] and [p for p in GOOD if ambiguous(p)] == []
    assert not ambiguous(None) and not ambiguous("(a|b)" * 200)


def test_ways_of_reading_double_only_where_loops_are_ambiguous():
    rng, seen = random.Random(2), {True: 0, False: 0}
    for _ in range(80):
        inner = drawn(rng, 2)
        tree = ("*", inner)
        if ways(inner, "") or len(written(tree)) > 40:
            continue  # a star over what may be empty reads the empty word without end
        most = max(ways(tree, "".join(w)) for n in range(1, 8) for w in itertools.product("ab", repeat=n))
        seen[ambiguous(written(tree))] += 1
        assert not (most >= 8 and not ambiguous(written(tree))), (written(tree), most)
        if ambiguous(written(tree)):
            assert most > 1, written(tree)
    assert min(seen.values()) > 10


def test_patterns_of_files(spark):
    text = "const a = /^(a+)+$/;\nconst b = '/(a+)+/'; // /(a+)+/\nconst c = x / (a+1) / 2;\nreturn /(\\w+\\s?)*$/.test(s) || /ok+/g"
    files = spark.createDataFrame([("a.ts", ".ts", text), ("b.py", ".py", text), ("c.js", ".js", None), ("d.js", ".js", "x = /(a+)+/\n" * 20)], "rel string, ext string, text string")
    got = sorted((r.file, r.line) for r in lines.unsafe_patterns(files).collect())
    assert got == [("a.ts", 1), ("a.ts", 4)] + [("d.js", k) for k in range(1, 11)]


@pytest.mark.parametrize("pattern", BAD[:3])
def test_they_are_patterns_of_the_standard_library_too(pattern):
    assert re.compile(pattern)
