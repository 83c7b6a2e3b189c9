import random

from millrace.llm.quoting import link_quotes

SAID = "conv_id long, turn int, role string, text string"


def linked(spark, said):
    rows = link_quotes(spark.createDataFrame(said, SAID)).collect()
    assert len(rows) == len(said)
    return {(r.conv_id, r.turn): r for r in rows}


def test_passages_of_every_level_are_linked(spark):
    said = [
        (1, 0, "u", "The first words"),
        (1, 1, "a", "> The first words\nThe answer"),
        (1, 2, "u", ">> The first words\nOnly the deeper passage is quoted"),
        (1, 3, "u", ">> The first words\n> The answer, edited\nIts level 1 has no original"),
        (1, 4, "u", ">> The first words\n> The answer\nBoth have one"),
        (1, 5, "u", ">>> The first words\n>> The answer\nThe shallower of two deep ones"),
        (2, 0, "u", ">> The answer\nFrom another conversation"),
    ]
    got = linked(spark, said)
    assert [(got[1, t].parent_conv, got[1, t].parent_turn) for t in range(6)] == [(None, None), (1, 0), (1, 0), (1, 0), (1, 1), (1, 1)]
    assert [(got[1, t].root_turn, got[1, t].depth) for t in (2, 3, 4)] == [(0, 1), (0, 1), (0, 2)]
    assert (got[2, 0].parent_conv, got[2, 0].parent_turn, got[2, 0].root_turn, got[2, 0].depth) == (1, 1, 0, 0)
    assert [tuple(x) for x in got[1, 4].origins] == [(0, 2, 1, 0), (1, 1, 1, 1)]
    assert [tuple(x) for x in got[1, 3].origins] == [(0, 2, 1, 0)] and got[1, 0].origins == []


def test_the_whole_passage_goes_before_its_lines(spark):
    said = [
        (1, 0, "u", "Hi all\nX"),
        (1, 1, "u", "Hi all\nY"),
        (1, 2, "a", "> Hi all\n> Y\nTo 1"),
        (1, 3, "a", "> Hi all\n> Y, edited\nTo the latest that has the line"),
        (1, 4, "u", "A long line of its own\nThanks\nShort"),
        (1, 5, "u", "Thanks\nSomething else"),
        (1, 6, "a", "> A long line of its own\n> Thanks\n> edited\nMost of it is in 4"),
        (1, 5000, "a", "> Hi all\n> Y\nFar below"),
        (2, 0, "u", "> Nobody's line\nq"),
        (2, 1, "u", "Said twice\nlater"),
        (3, 0, "u", "Said twice\nelsewhere"),
        (2, 0, "v", "> Said twice\nIts own conversation says so only later"),
    ]
    rows = link_quotes(spark.createDataFrame(said, SAID)).collect()
    assert len(rows) == len(said)
    got = {(r.conv_id, r.turn, r.role): r for r in rows}
    assert [got[1, t, "a"].parent_turn for t in (2, 3, 6, 5000)] == [1, 1, 4, 1]
    assert (got[1, 5000, "a"].root_turn, got[1, 5000, "a"].depth) == (1, 1) and got[1, 5, "u"].parent_turn is None
    assert (got[2, 0, "v"].parent_conv, got[2, 0, "v"].parent_turn) == (3, 0)
    assert got[2, 0, "u"].origins == [] and [tuple(x) for x in got[2, 0, "v"].origins] == [(0, 1, 3, 0)]


def brute(said):
    """Reply order by recursion: parents as the operator found them are checked elsewhere."""
    at = {}
    for conv, parents in said.items():
        below, order = {}, []
        for t, up in parents.items():
            below.setdefault(up, []).append(t)
        stack = [(t, t, 0) for t in sorted(below.get(None, []), reverse=True)]
        while stack:
            t, root, depth = stack.pop()
            order.append(t)
            at[conv, t] = root, depth, len(order) - 1
            stack += [(c, root, depth + 1) for c in sorted(below.get(t, []), reverse=True)]
    return at


def check_order(rows):
    said = {}
    for r in rows:
        said.setdefault(r.conv_id, {})[r.turn] = r.parent_turn if r.parent_conv == r.conv_id else None
    want = brute(said)
    assert {(r.conv_id, r.turn): (r.root_turn, r.depth, r.position) for r in rows} == want


def test_reply_order_against_brute_force(spark):
    rng = random.Random(5)
    said = []
    for conv in range(12):
        texts = []
        for t in range(rng.randint(1, 40)):
            own = f"words {conv} {t} " + " ".join(rng.choice("abcdefgh") * rng.randint(1, 5) for _ in range(6))
            level, quote = 0, ""
            if texts and rng.random() < 0.8:
                level, quote = rng.randint(1, 4), rng.choice(texts)
            said.append((conv, 7 * t, "u", (">" * level + " " + quote + "\n" if level else "") + own))
            texts.append(own)
    rows = link_quotes(spark.createDataFrame(said, SAID)).collect()
    assert len(rows) == len(said) and sum(r.parent_turn is not None for r in rows) > 100 and max(r.depth for r in rows) > 3
    check_order(rows)


def test_a_deep_chain_and_a_root_with_many_replies(spark):
    chain = [(1, t, "u", (f"> text number {t - 1}\n" if t else "") + f"text number {t}") for t in range(5000)]
    star = [(2, t, "u", ("> the root of all\n" if t else "") + (f"reply {t}" if t else "the root of all")) for t in range(50_000)]
    rows = link_quotes(spark.createDataFrame(chain + star + [(3, 0, "u", "w " * 200_000)], SAID)).collect()
    got = {(r.conv_id, r.turn): (r.root_turn, r.depth, r.position) for r in rows}
    assert len(rows) == 55_001 and all(got[1, t] == (0, t, t) for t in range(5000))
    assert all(got[2, t] == (0, int(t > 0), t) for t in range(50_000))


def test_messages_of_one_turn_and_copies(spark):
    said = [(1, 0, "u", "one"), (1, 0, "u", "one"), (1, 0, "a", "two"), (1, 1, "u", "> one\nthree"), (1, 2, "u", "four"), (None, 1, "u", "x"), (1, None, "u", "> one")]
    rows = link_quotes(spark.createDataFrame(said, SAID)).collect()
    assert sorted((r.turn, r.body, r.position) for r in rows if r.conv_id and r.turn is not None) == [(0, "one", 1), (0, "one", 1), (0, "two", 0), (1, "three", 2), (2, "four", 3)]
    assert all(r.position is None and r.root_turn is None and r.parent_turn is None for r in rows if r.conv_id is None or r.turn is None)
