import random
import zlib


from edges import EDGES

from millrace.llm import language_id, toxicity


def corpus(n=400):
    rng = random.Random(2)
    words = ["".join(rng.choice(["an", "er", "th", "ou", "ti", "re"]) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(60)]
        toxic = int(i % 4 == 0)
        if toxic:
            for _ in range(3):
                text[rng.randrange(60)] = rng.choice(["scoundrel", "nitwit", "blockhead"])
        rows.append((i, " ".join(text), "en", "s"))
        labels.append((i, 1, toxic))
    return rows, labels


def test_toxicity(docs, spark):
    rows, labels = corpus()
    table = docs([*rows, *[(10_000 + r[0], *r[1:]) for r in EDGES]], extra=True)
    marks = spark.createDataFrame([*labels, (3, 1, None), (None, 1, 1), labels[5]], "doc_id long, quality int, toxic int")
    got = toxicity.score(table, toxicity.train(table, marks)).collect()
    assert len(got) == len(rows) + len(EDGES)
    truth = {i: t for i, _, t in labels}
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    known = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in known) >= 0.95 * len(known)


def test_toxicity_without_examples(docs, spark):
    table = docs(EDGES)
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.predicted for r in toxicity.score(table, toxicity.train(table, empty)).collect()} == {0}
    assert toxicity.score(table.limit(0), toxicity.fit([], [])).collect() == []
    one = spark.createDataFrame([(i, 1, 1) for i in range(9)], "doc_id long, quality int, toxic int")
    assert {r.predicted for r in toxicity.score(table, toxicity.train(table, one)).collect()} == {1}


def test_language(docs):
    rng = random.Random(4)
    parts = {"aa": ["ba", "na", "ra", "la"], "bb": ["sch", "ung", "keit"], "cc": ["çon", "ère", "eau"]}
    rows = [(i, " ".join("".join(rng.choice(parts[x]) for _ in range(3)) for _ in range(40)), x, "s") for i, x in enumerate(rng.choice(list(parts)) for _ in range(600))]
    table = docs([*rows, *[(10_000 + r[0], r[1], None, r[3]) for r in EDGES], (20_000, "12 34 !!", None, "s")], extra=True)
    got = {r.doc_id: r for r in language_id.identify(table, language_id.train(table)).collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got.values())
    held = [r for r in rows if got[r[0]].held_out]
    assert sum(got[r[0]].lang_pred == r[2] for r in held) >= 0.98 * len(held)
    assert {got[i].lang_pred for i in (10_001, 10_002, 10_003, 20_000)} == {"und"}
    assert language_id.identify(docs(EDGES), language_id.build({})).first().lang_pred == "und"


def test_bloom_slices_hold_what_was_put_in():
    import numpy as np

    grams = {f"l{i:02d}": np.arange(1000 * i, 1000 * i + 1500, dtype=np.uint32) for i in range(70)}
    model = language_id.build(grams)
    masks = model.holders(np.array([1000 * 68 + 10], np.uint32))
    held = [model.languages[i] for i in range(70) if masks[0, i // 64] >> np.uint64(i % 64) & np.uint64(1)]
    assert {"l67", "l68"} <= set(held)


def test_toxicity_counts_and_scores_against_plain_python(docs, spark):
    """N-grams as strings, counted in dicts: the same features, ratios and margins; the loss is small."""
    import math
    from collections import Counter

    import numpy as np

    from millrace.llm._text import code_points, gram_hashes

    rows, labels = corpus(300)
    rows += [(500, "", "en", "s"), (501, "Ünïcode ÄÖ 漢字漢字漢字 scoundrel", "en", "s"), (502, "a", "en", "s")]
    labels += [(500, 1, 0), (501, 1, 1), (502, 1, 0)]
    fold = lambda i: zlib.crc32(str(i).encode()) // 5 % toxicity.FOLDS
    used = sorted((i for i, *_ in labels if zlib.crc32(str(i).encode()) % 5), key=str)
    text, toxic = {r[0]: r[1] for r in rows}, {i: t for i, _, t in labels}
    model = toxicity.train(docs(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))

    def plain(t):
        t = " " + " ".join(t.lower().split()) + " "
        return {t[i : i + n] for n in toxicity.ORDERS for i in range(len(t) - n + 1)}

    def bucket(gram):
        return int(list(gram_hashes(code_points(gram), (len(gram),), toxicity.BITS))[0][0])

    sets = {i: {bucket(g) for g in plain(text[i])} for i in used}
    assert all(sets[i] == set(toxicity.grams(text[i]).tolist()) for i in used)
    counts = [Counter(g for i in used if toxic[i] == y for g in sets[i]) for y in (0, 1)]
    n = [sum(toxic[i] == y for i in used) for y in (0, 1)]
    ratio = {g: math.log((counts[1][g] + 1) / (n[1] + 2)) - math.log((counts[0][g] + 1) / (n[0] + 2)) for g in {*counts[0], *counts[1]} if counts[0][g] + counts[1][g] >= toxicity.LEAST_DF}
    evidence = {g: abs(r) * math.sqrt(counts[0][g] + counts[1][g]) for g, r in ratio.items()}
    best = {g for g in sorted(evidence, key=lambda g: (-round(evidence[g], 9), g))[: toxicity.FEATURES] if evidence[g] > 0}
    assert {*np.flatnonzero(model.selected).tolist()} == best
    for i in used:
        own = sets[i] & best
        want = sum(float(model.weight[g]) for g in own) / math.sqrt(max(1, len(own))) + model.bias
        assert abs(model.margin(toxicity.grams(text[i])) - want) < 1e-4
        assert abs(model.score(toxicity.grams(text[i])) - 1 / (1 + math.exp(-(model.scale * want + model.shift)))) < 1e-4
    loss = lambda b: sum(math.log1p(math.exp(-(2 * toxic[i] - 1) * (model.margin(toxicity.grams(text[i])) - model.bias + b))) for i in used)
    assert loss(model.bias) / len(used) < 0.05
    local = toxicity.fit([text[i] for i in used], [toxic[i] for i in used], fold=[fold(i) for i in used])
    assert np.array_equal(local.selected, model.selected) and np.allclose(local.weight, model.weight, atol=1e-5)
    assert abs(local.scale - model.scale) < 1e-6 and abs(local.shift - model.shift) < 1e-6


def test_an_id_on_several_texts_trains_by_the_least(docs, spark):
    import numpy as np

    rows, labels = corpus(200)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    more = [(i, "zz " + t, lang, s) for i, t, lang, s in rows]
    a, b = toxicity.train(docs(rows), marks), toxicity.train(docs([*more, *rows, *rows]), marks)
    assert np.array_equal(a.weight, b.weight) and a.shift == b.shift


def test_language_against_exact_sets(docs):
    """Filters replaced by sets of n-gram strings, without false positives: the same choice but where two languages are near."""
    import numpy as np

    from millrace.llm._text import code_points, gram_hashes

    rng = random.Random(14)
    parts = {"aa": ["ba", "na", "ra", "la"], "bb": ["sch", "ung", "keit", "ra"], "cc": ["çon", "ère", "eau", "na"]}
    rows = [(i, " ".join("".join(rng.choice(parts[x]) for _ in range(3)) for _ in range(rng.randint(1, 40))) + " 12!", x, "s") for i, x in enumerate(rng.choice(list(parts)) for _ in range(500))]
    model = language_id.train(docs(rows))

    def plain(t):
        t = "".join(c if c.isalpha() else " " for c in t.lower())
        t = " " + " ".join(t.split()) + " "
        return [t[i : i + n] for n in language_id.ORDERS for i in range(len(t) - n + 1)]

    known = {g for _, t, *_ in rows for g in plain(t)}
    ids = {g: int(list(gram_hashes(code_points(g), (len(g),), language_id.HASH_BITS))[0][0]) for g in known}
    learn = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    share = {x: {} for x in parts}
    for x in parts:
        own = [set(plain(t)) for _, t, lang, _ in learn if lang == x]
        for g in known:
            share[x][g] = sum(g in s for s in own) / len(own)
    telling = {x: {g for g in known if share[x][g] >= 0.004 and share[x][g] >= 2.0 * sum(share[y][g] for y in parts) / 3} for x in parts}
    masks = model.holders(np.array(list(ids.values()), np.uint32))
    for i, x in enumerate(model.languages):
        held = {g for g, m in zip(ids, masks[:, 0]) if m >> np.uint64(i) & np.uint64(1)}
        assert telling[x] <= held and len(held - telling[x]) <= 2
    same = 0
    for _, t, *_ in rows:
        grams_, got = plain(t), model.predict(t)
        counts = {x: sum(g in telling[x] for g in grams_) for x in parts}
        total = sum(counts.values())
        best = max(sorted(parts), key=counts.get)
        same += got[0] == best
        assert got[0] == best or counts[got[0]] >= 0.9 * counts[best]
        assert abs(got[1] - counts[got[0]] / total) < 0.05
    assert same >= 0.99 * len(rows)


def test_calibration_takes_any_margins():
    import numpy as np

    rng = np.random.default_rng(3)
    y = np.array([1] * 6 + [0] * 50)
    for margin in (rng.standard_normal(56) * 40, np.where(y == 1, 30.0, -30.0), np.where(y == 1, -30.0, 30.0), np.zeros(56), np.where(y == 1, -3.0, -3.5)):
        scale, shift = toxicity._platt(margin, y, np.ones(56))
        score = 1 / (1 + np.exp(-np.clip(scale * margin + shift, -40, 40)))
        assert 0.05 <= scale < 100 and abs(score.mean() - y.mean()) < 0.06
