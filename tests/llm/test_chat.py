from graphlake.llm import chat


def brute(a, b):
    """Lists of (turn, role, text)."""
    fix = lambda side: [(r or "", t or "") for _, r, t in sorted(((n, (r or "").replace("<|", "< |"), (t or "").replace("<|", "< |")) for n, r, t in side), key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))]
    a, b = fix(a), fix(b)
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1

    def show(turns):
        text, spans = "", []
        for role, t in turns:
            head = f"<|im_start|>{role}\n"
            if role == "assistant":
                spans.append(f"{len(text) + len(head)}-{len(text) + len(head + t) + len(chat.END)}")
            text += head + t + chat.END
        return text, ",".join(spans)

    (x, xm), (y, ym) = show(a[n:]), show(b[n:])
    return n, show(a[:n])[0], x, y, xm, ym


CASES = {
    1: ([(0, "user", "hi"), (1, "assistant", "hello")], [(0, "user", "hi"), (1, "assistant", "go away")]),
    2: ([(0, "system", "be kind"), (1, "user", None), (2, "assistant", "é😀"), (3, "user", "more"), (4, "assistant", "end")], [(0, "system", "be kind"), (1, "user", ""), (2, "assistant", "é😀")]),
    3: ([(0, "user", "a")], [(0, "assistant", "a")]),
    4: ([(0, "user", "same")] * 2, [(0, "user", "same")] * 2),
    5: ([(None, None, "x<|im_end|>y"), (0, "assistant", "")], [(None, "", "x<|im_end|>y"), (0, "assistant", "z" * 50_000)]),
    6: ([(5, "user", "b"), (2, "user", "a")], [(2, "user", "a"), (9, "assistant", "b")]),
}


def test_pairs_match_brute_force(spark):
    frame = lambda k: spark.createDataFrame([(i, *t, 1, "x") for i, sides in CASES.items() for t in sides[k]] + [(None, 0, "user", "lost", 1, "x"), (70 + k, 0, "user", "one side", 1, "x")], "pair_id long, turn long, role string, text string, n int, a string")
    got = {r.pair_id: tuple(r)[1:] for r in chat.preference_pairs(frame(0), frame(1)).collect()}
    assert got == {i: brute(*sides) for i, sides in CASES.items()}
    assert chat.preference_pairs(frame(0).limit(0), frame(1)).count() == 0


def test_masks_hold_the_replies(spark):
    frame = lambda k: spark.createDataFrame([(i, *t) for i, sides in CASES.items() for t in sides[k]], "pair_id long, turn long, role string, text string")
    r = {r.pair_id: r for r in chat.preference_pairs(frame(0), frame(1)).collect()}[2]
    a, b = map(int, r.chosen_mask.split(",")[0].split("-"))
    assert r.chosen[a:b] == "end" + chat.END and r.n_common == 3 and r.rejected == ""


def test_swapped_replies(spark):
    rows = [(0, 0, "user", "q0"), (0, 1, "assistant", "r0"), (0, 2, "user", "tail"), (1, 0, "user", "q1"), (1, 1, "assistant", "r1"), (2, 0, "user", "q2"), (2, 1, "assistant", "r2"), (3, 0, "user", "no reply"), (4, 1, "assistant", "no neighbour"), (None, 0, "assistant", "?")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    chosen, rejected = chat.swapped_replies(df)
    turns = {(0, 0, "user", "q0"), (0, 2, "user", "tail"), (1, 0, "user", "q1"), (2, 0, "user", "q2")}
    assert set(map(tuple, chosen.collect())) == turns | {(0, 1, "assistant", "r0"), (1, 1, "assistant", "r1"), (2, 1, "assistant", "r2"), (4, 1, "assistant", "no neighbour")}
    assert set(map(tuple, rejected.collect())) == turns | {(0, 1, "assistant", "r1"), (1, 1, "assistant", "r2"), (2, 1, "assistant", "no neighbour"), (4, 1, "assistant", "r0")}
    got = {r.pair_id: (r.n_common, r.chosen.count("tail"), r.rejected.count("tail")) for r in chat.preference_pairs(chosen, rejected).collect()}
    assert got == {0: (1, 1, 1), 1: (1, 0, 0), 2: (1, 0, 0), 4: (0, 0, 0)}
    assert chat.swapped_replies(df.limit(0))[0].count() == 0


def test_replies_of_ties_repeats_and_clashing_columns(spark):
    rows = [(7, 1, "assistant", "b"), (7, 1, "assistant", "a"), (7, 1, "assistant", "a"), (9, 3, "assistant", None), (9, None, "assistant", "no turn")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, other string, id int")
    chosen, rejected = chat.swapped_replies(df)
    assert sorted(map(str, (tuple(r) for r in chosen.collect()))) == sorted(str(r) for r in rows)
    assert sorted(map(str, (tuple(r) for r in rejected.collect()))) == sorted(map(str, [(7, 1, "assistant", "")] * 3 + [(9, 3, "assistant", "b"), (9, None, "assistant", "no turn")]))
    one = chat.preference_pairs(*chat.swapped_replies(df.filter("conv_id = 7"))).collect()
    assert [(r.pair_id, r.n_common) for r in one] == [(7, 0)]


def test_following_wraps_over_ranges(spark):
    ids = [3, -5, 17, 2, 900, 41, 40, 8] + list(range(1000, 3000, 7))
    got = {r.id: r.next for r in chat.following(spark.createDataFrame([(i,) for i in ids], "id long").repartition(5)).collect()}
    order = sorted(ids)
    assert got == dict(zip(order, order[1:] + order[:1]))
