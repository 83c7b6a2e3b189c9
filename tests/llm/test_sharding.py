import random
import zlib


from edges import EDGES

from millrace.llm.sharding import level, shard


def check(rows, texts, n):
    assert len(rows) == len(texts)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
    for s in range(n):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))


def test_balanced_with_a_hot_text(docs):
    texts = {i: ("copy of a passage " * 20 if i % 3 == 0 else f"text {i} " * (1 + i % 50)) for i in range(3000)}
    rows = shard(docs([(i, t, "en", "s") for i, t in texts.items()], extra=True), 8).collect()
    check(rows, texts, 8)
    sizes = [sum(r.size for r in rows if r.shard == s) for s in range(8)]
    assert max(sizes) - min(sizes) <= 2 * max(r.size for r in rows)


def groups_of(rows, texts):
    held = {}
    for r in rows:
        held.setdefault(texts[r.doc_id] or "", []).append((r.shard, r.size))
    return held


def test_equal_texts_stay_together_where_they_fit(docs):
    """Groups of every size, from pairs over much of a shard to two that fit none: whole in one shard, or cut into few."""
    rng = random.Random(3)
    texts, n = {}, 12
    for group, copies in enumerate([2] * 400 + [9] * 60 + [40] * 12 + [150] * 4 + [700, 1500]):
        body = f"group {group} " + "x" * (30 if copies > 200 else rng.randint(5, 120))
        for _ in range(copies):
            texts[len(texts)] = body
    texts |= {len(texts) + i: f"single {i} " + "y" * rng.randint(0, 300) for i in range(3000)}
    total = sum(len(t) + 16 for t in texts.values())
    huge = "z" * (total // n)
    texts |= {len(texts) + i: huge for i in range(3)}  # large rows of a group that fits no shard go one by one
    total += 3 * (len(huge) + 16)
    rows = shard(docs([(i, t, "en", "s") for i, t in texts.items()]), n).collect()
    check(rows, texts, n)
    for text, held in groups_of(rows, texts).items():
        size, over = sum(x for _, x in held), len({s for s, _ in held})
        assert over == 1 if size <= total // n else over <= max(len(held) if len(held) < 4 else 0, -(-size * n // total) + 2)
    sizes = [sum(r.size for r in rows if r.shard == s) for s in range(n)]
    assert max(sizes) - min(sizes) <= 2 * total // n // 16


def test_the_law_against_a_plain_deal(docs):
    """No shard is much larger than the best that whole groups allow: the greedy deal of all groups by a single list."""
    rng = random.Random(8)
    texts = {i: rng.choice(["", None, "common " * 20, f"own text {i} " * rng.randint(1, 60)]) for i in range(2500)}
    rows = shard(docs([(i, t, "en", "s") for i, t in texts.items()]), 10).collect()
    check(rows, texts, 10)
    sizes = sorted(sum(x for _, x in held) for held in groups_of(rows, texts).values())
    loads = [0] * 10
    for size in reversed(sizes):
        loads[loads.index(min(loads))] += size
    got = [sum(r.size for r in rows if r.shard == s) for s in range(10)]
    assert max(got) <= max(loads) + sum(sizes) // 10 // 16 and min(got) >= min(loads) - sum(sizes) // 10 // 16


def test_edges(docs):
    rows = shard(docs(EDGES), 4).collect()
    assert len(rows) == len(EDGES)
    assert sorted((r.doc_id, r.size) for r in rows)[:2] == [(1, 16), (2, 16)]
    assert shard(docs([(1, "a", "en", "a")]).limit(0)).collect() == []


def test_level():
    take = level([5, 0, 10], 7)
    assert sum(take) == 7 and take[2] == 0 and abs(5 + take[0] - take[1]) <= 1
