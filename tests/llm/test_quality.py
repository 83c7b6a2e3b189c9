import random
import re
from collections import Counter

import numpy as np

from edges import EDGES

from millrace.llm.quality import VECTOR, chi2_cdf, chi2_quantile, quality, word_statistics


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    under = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(under)


def test_statistics_and_outliers(docs):
    rng = random.Random(3)
    words = ["".join(rng.choice("aeioubcdfgl") for _ in range(rng.randint(2, 9))) for _ in range(500)]
    rows = [(10 + i, ". ".join(" ".join(rng.choice(words) for _ in range(12)) for _ in range(6)), "en", f"s{i % 2}") for i in range(600)]
    rows += [(1000 + i, " ".join(rng.choice(words) + "%%%&" for _ in range(60)), "en", "s0") for i in range(20)]
    phrase = "one two three four five six seven"
    rows += [(2000, f"{phrase} {phrase}\nline\nline\n\n", "en", "s0"), *EDGES]
    got = quality(docs(rows, extra=True)).collect()
    texts = {r[0]: r[1] for r in rows}
    assert len(got) == len(rows)
    for r in got:
        want = brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.base_failed and r.kept)
    assert all(r.kept for r in got if 10 <= r.doc_id < 610 and not r.base_failed)
    assert not any(r.kept for r in got if 1000 <= r.doc_id < 1020)
    assert quality(docs(rows[:1]).limit(0)).collect() == []


def test_chi_square():
    assert abs(chi2_cdf(3.841459, 1) - 0.95) < 1e-6
    assert abs(chi2_quantile(0.99, 6) - 16.811894) < 1e-4


def mcd(x, share=0.75):
    """Concentration steps to a standstill, exact ranks; the consistency factor as for a normal sample."""
    floor = np.diag([f * f for _, f in VECTOR.values()])
    p = x.shape[1]
    scale = share / chi2_cdf(chi2_quantile(share, p), p + 2)
    mean = np.median(x, axis=0)
    cov = np.diag((1.4826 * np.median(np.abs(x - mean), axis=0)) ** 2)
    for _ in range(50):
        d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov + floor), x - mean)
        near = x[np.argsort(d, kind="stable")[: int(np.ceil(share * len(x)))]]
        mean, cov = near.mean(axis=0), scale * np.cov(near.T, bias=True)
    return mean, cov, floor


def test_verdicts_equal_those_of_a_plain_estimate(docs, spark):
    """Against numpy, over pairs of every size: distances within what the histogram's cut and the steps left out make, verdicts equal but at the edge."""
    rng = random.Random(12)
    words = ["".join(rng.choice("aeioubcdfgl") for _ in range(rng.randint(2, 9))) for _ in range(500)]

    def text(odd):
        w = [rng.choice(words) for _ in range(rng.randint(30, 90))]
        for _ in range(odd):
            w[rng.randrange(len(w))] += rng.choice(["!", "%", "#", "&&"])
        return "\n".join(" ".join(w[i : i + 12]).capitalize() + "." for i in range(0, len(w), 12))

    sizes = {("en", "a"): 900, ("en", "b"): 120, ("en", "c"): 1, ("de", "a"): 300, ("de", "b"): 40, ("xx", "q"): 3}
    rows = [(lang, source, text(rng.choice([0, 0, 1, 2, 3]) if i % 12 else 150)) for (lang, source), n in sizes.items() for i in range(n)]
    rows = [(i, t, lang, source) for i, (lang, source, t) in enumerate(rows)]
    table = docs(rows)
    got = {r.doc_id: r for r in quality(table).collect()}
    names = list(VECTOR)
    stats = word_statistics(table).select("doc_id", *(VECTOR[n][0]().alias(n) for n in names)).toPandas().set_index("doc_id").sort_index()
    good = [i for i, *_ in rows if not got[i].base_failed]
    x = stats.loc[good, names].to_numpy(float)
    lang, source = (np.array([rows[i][k] for i in good]) for k in (2, 3))
    bound, edge, wrong = chi2_quantile(1 - 1e-6, len(names)), 0, []
    for pair in sizes:
        own = (lang == pair[0]) & (source == pair[1])
        levels = [own, lang == pair[0], np.ones(len(good), bool)]
        left, weights = 1.0, []
        for level in levels[:2]:
            weights.append(left / (1 + (200 / level.sum()) ** 2))
            left -= weights[-1]
        weights.append(left)
        ests = [mcd(x[level]) for level in levels]
        mean = sum(w * e[0] for w, e in zip(weights, ests))
        cov = sum(w * (e[1] + np.outer(e[0] - mean, e[0] - mean)) for w, e in zip(weights, ests)) + ests[0][2]
        d = np.einsum("ij,jk,ik->i", x[own] - mean, np.linalg.inv(cov), x[own] - mean)
        for i, want in zip(np.array(good)[own], d):
            assert abs(got[i].distance - want) <= 0.15 * want + 0.1
            if abs(want - bound) > 0.15 * bound:
                wrong += [i] if got[i].kept != (want <= bound) else []
            else:
                edge += 1
    assert not wrong and edge < len(good) // 50
    assert 50 < sum(not got[i].kept for i in good) < 200


def test_small_pairs_are_judged_by_their_whole_language(docs):
    rng = random.Random(7)
    words = ["".join(rng.choice("aeioubcdfgl") for _ in range(rng.randint(2, 9))) for _ in range(500)]
    clean = lambda: ". ".join(" ".join(rng.choice(words) for _ in range(12)) for _ in range(6))
    junk = lambda: " ".join(rng.choice(words) + "%%%&" for _ in range(60))
    rows = [(i, clean(), "en", "large") for i in range(600)]
    rows += [(1000, junk(), "en", "one row"), *((1001 + i, junk(), "en", "few rows") for i in range(5)), (1010, junk(), "xx", "rare")]
    rows += [(2000, clean(), "en", "one clean row"), (2001, clean(), "yy", "rare")]
    got = {r.doc_id: r for r in quality(docs(rows)).collect()}
    assert len(got) == len(rows) and not any(r.base_failed for r in got.values())
    assert {i: r.kept for i, r in got.items() if i >= 1000} == {i: i >= 2000 for i in got if i >= 1000}
    assert all(got[i].kept for i in range(600))
