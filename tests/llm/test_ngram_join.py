import random
import re
from itertools import combinations


import pyarrow as pa
import pytest

from edges import EDGES

from millrace.llm import ngram_join
from millrace.llm._text import shingle_sets
from millrace.llm.ngram_join import Scheme, Sketches, jaccard_components, parities


def brute(rows, width, percent):
    sets = {}
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def family(rng, words, start, n, edits):
    base = [rng.choice(words) for _ in range(rng.randint(20, 160))]
    for i in range(n):
        copy = list(base)
        for _ in range(rng.randint(0, edits)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        yield start + i, " ".join(copy), "en", "s"


def test_against_brute_force(docs, monkeypatch):
    monkeypatch.setattr(ngram_join, "PARTNERS", 5)  # several tasks for one pivot
    monkeypatch.setattr(ngram_join, "CELL", 4)  # groups of several cells
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows = [r for f in range(30) for r in family(rng, words, 100 * f + 10, rng.randint(2, 14), 5)]
    passage = " ".join(rng.choice(words) for _ in range(30))
    rows += [(5000 + i, passage + " " + " ".join(rng.choice(words) for _ in range(rng.randint(1, 40))), "en", "s") for i in range(60)]
    rows += [(6000 + i, "the same text again and again here", "en", "s") for i in range(40)] + EDGES
    for width, percent in ((4, 85), (5, 80)):
        want = brute(rows, width, percent)
        got = jaccard_components(docs(rows, extra=True), width=width, percent=percent).collect()
        assert len(got) == len(rows)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_no_rows_and_null_ids(docs, spark):
    assert jaccard_components(docs(EDGES).limit(0)).collect() == []
    got = jaccard_components(docs([(None, "a b c d e", "en", "s"), (3, "a b c d e", "en", "s"), (9, "a b c d e", "en", "s")])).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in got if r.doc_id) == [(3, 3), (9, 3)]


def test_filter_keeps_every_id_and_little_else(docs, spark):
    all_ = docs([(i, "t", "en", "s") for i in range(-500, 4500)]).selectExpr("doc_id", "text", "xxhash64(text) AS h")
    want = {*range(-500, 4500, 7)}
    ids = all_.where("doc_id % 7 = 4 OR doc_id % 7 = -3").select("doc_id", "h")
    assert {r.doc_id for r in ids.collect()} == want
    got = {r.doc_id for r in ngram_join._among(all_, ids).collect()}
    assert want <= got and len(got) < len(want) + 20
    assert ngram_join._among(all_, ids.limit(0)).collect() == []


def crowd(rng, words, start, n, shared, own):
    """Texts that share a long passage and are otherwise strangers, with a near copy of every tenth."""
    passage = [rng.choice(words) for _ in range(shared)]
    for i in range(n):
        text = passage + [rng.choice(words) for _ in range(own)]
        yield start + 2 * i, " ".join(text), "en", "s"
        if i % 10 == 0:
            text[rng.randrange(shared)] = "edited"
            yield start + 2 * i + 1, " ".join(text), "en", "s"


def test_cells_of_shared_signatures():
    """Whatever the batches: each key of a signature that has several once, and its number in the signature by cells."""
    rng = random.Random(1)
    rows = sorted((rng.choice([1, 2, 3, 5, 9, 9, 9]), rng.randrange(20)) for _ in range(150)) + [(11, 4), (11, 4), (12, 1), (12, 2)]
    keys = {}
    for sig, key in rows:
        if key not in keys.setdefault(sig, []):
            keys[sig].append(key)
    want = [(sig, i // 3, key) for sig, held in keys.items() if len(held) > 1 for i, key in enumerate(held)]
    for size in (1, 2, 7, 1000):
        batches = (pa.record_batch([pa.array([r[0] for r in part]), pa.array([r[1] for r in part])], names=["sig", "key"]) for part in (rows[i : i + size] for i in range(0, len(rows), size)))
        assert [tuple(r.values()) for b in ngram_join._shared(3)(batches) for r in b.to_pylist()] == want


@pytest.mark.parametrize("most_bits, width, percent", [(1 << 24, 4, 85), (1 << 15, 5, 80)])
def test_large_groups_of_strangers(docs, monkeypatch, most_bits, width, percent):
    """Members of groups over GROUP meet by prefixes, whether frequent shingles are known to the bit or only the most frequent ones."""
    monkeypatch.setattr(ngram_join, "GROUP", 3)
    monkeypatch.setattr(ngram_join, "FREQUENT_BITS", most_bits)
    rng = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    rows = [r for k, (shared, own) in enumerate(((60, 20), (50, 50), (90, 12))) for r in crowd(rng, words, 1000 * k + 1, 60, shared, own)]
    got = jaccard_components(docs(rows), width=width, percent=percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, width, percent)


def test_one_id_on_different_texts(docs):
    a, b = ("some words that stand in this text and nowhere else", "another text which has no word of the first one here")
    rows = [(7, a, "en", "s"), (7, b, "en", "s"), (3, b, "en", "s"), (9, a, "en", "s"), (7, a, "en", "s")]
    got = jaccard_components(docs(rows)).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(3, 3), (7, 3), (7, 7), (7, 7), (9, 7)]


def test_prefixes_of_similar_sets_meet():
    import numpy as np

    rng = np.random.default_rng(8)
    bits = rng.integers(0, 256, ngram_join.FREQUENT_BITS // 8, dtype=np.uint8)
    for percent in (80, 85):
        for n in [1, 2, 3, 5, 9, 20, 60, 200] * 10:
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            out = n * (100 - percent) // 100
            b = np.sort(rng.choice(a, len(a) - out, replace=False))
            assert np.intersect1d(ngram_join.prefix(a, bits, percent), ngram_join.prefix(b, bits, percent)).size


def test_scheme_shares_a_signature_for_every_similar_pair():
    import numpy as np

    rng = np.random.default_rng(1)
    scheme = Scheme(85)
    for size in [*range(1, 60), 100, 333, 1500]:
        for _ in range(4):
            a = rng.integers(0, 2**63, size).astype(np.uint64)
            drop = rng.integers(0, max(1, int(size * 0.08)) + 1)
            b = np.concatenate([a[drop:], rng.integers(0, 2**63, rng.integers(0, int(size * 0.08) + 1)).astype(np.uint64)])
            a, b = np.unique(a), np.unique(b)
            both = len(np.intersect1d(a, b))
            apart = Sketches(pa.array([b"", parities(a), parities(b)]).slice(1)).apart(np.array([0, 1]), np.array([1, 0]))
            assert apart[0] == apart[1] <= len(a) + len(b) - 2 * both
            if 100 * both >= 85 * (len(a) + len(b) - both) and not np.array_equal(a, b):
                assert len(np.intersect1d(scheme.signatures(a), scheme.signatures(b)))


@pytest.mark.parametrize("percent", [80, 85])
def test_similar_sets_share_a_signature(percent):
    import numpy as np

    scheme, rng = Scheme(percent), np.random.default_rng(percent)
    for n in [1, 2, 5, 9, 20, 60, 200, 500, 1500] * 8:
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        out = int(rng.integers(0, n * (100 - percent) // 100 + 1))
        both = np.sort(rng.choice(a, len(a) - out, replace=False))
        more = max(0, (100 * len(both) - percent * len(a)) // percent)
        b = np.unique(np.concatenate([both, rng.integers(0, 1 << 63, int(rng.integers(0, more + 1)), dtype=np.uint64)]))
        if np.array_equal(a, b) or 100 * len(both) < percent * (len(a) + len(b) - len(both)):
            continue
        assert np.intersect1d(scheme.signatures(a), scheme.signatures(b)).size


def test_slices_with_fewer_words_than_a_shingle(docs):
    for width in range(1, 7):
        for n in range(5):
            text = " ".join(f"w{i}" for i in range(n))
            alone, beside = (shingle_sets(pa.array(x), width) for x in ([text], [text, "some more words that stand in another row"]))
            assert len(alone) == 1 and alone[0].tolist() == beside[0].tolist()
            assert len(alone[0]) == (max(1, n - width + 1) if n else 0)
    got = jaccard_components(docs([(1, "one two", "en", "s"), (2, None, "en", "s")]).coalesce(1)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == [(1, 1, 1), (2, 0, 2)]


def test_long_texts_that_are_near_but_not_linked_leave_few_rows(docs, monkeypatch):
    """A thousand texts of 1,500 words, two thirds of them a common passage: every two share signatures, none is linked."""
    rng = random.Random(21)
    words = [f"w{i}" for i in range(5000)]
    passage = " ".join(rng.choice(words) for _ in range(1000))
    rows = [(i, passage + " " + " ".join(rng.choice(words) for _ in range(500)), "en", "s") for i in range(1000)]
    rows.append((1000, rows[7][1].replace(" ", "  ", 3).rsplit(" ", 1)[0], "en", "s"))
    counts, keep = {}, ngram_join.Scratch.keep

    def watched(self, df, name, n=None):
        out = keep(self, df, name, n)
        counts[name] = out.count()
        return out

    monkeypatch.setattr(ngram_join.Scratch, "keep", watched)
    got = {r.doc_id: r.component_id for r in jaccard_components(docs(rows), width=5, percent=80).collect()}
    assert got == {i: 7 if i == 1000 else i for i in range(1001)}
    assert 900 < counts["crowd"] <= 1001 and counts["again"] < 50 * len(rows)
    assert sum(n for name, n in counts.items() if name.startswith("pairs")) < 20
