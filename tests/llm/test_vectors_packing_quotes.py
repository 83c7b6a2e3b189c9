import numpy as np
from pyspark.sql import functions as F

from millrace.llm import vector_dedup
from millrace.llm.packing import pack, pack_lot
from millrace.llm.quoting import link_quotes, parse


def test_vectors_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "BLOCK", 16)  # several blocks for one bucket
    rng = np.random.default_rng(3)
    base = rng.standard_normal((40, 24))
    x = np.concatenate([base[rng.integers(0, 40, 400)] + 0.22 * rng.standard_normal((400, 24)), np.repeat(base[:1], 60, 0)]).astype(np.float32)
    odd = [(900, None), (901, [0.0] * 24), (902, [float("nan")] * 24), (903, [None] * 24), (904, [1.0, 2.0]), (904, [1.0, 2.0]), (905, [])]
    df = spark.createDataFrame([*[(i, v.tolist()) for i, v in enumerate(x)], *odd], "vec_id long, embedding array<float>").withColumn("rep", F.lit(1)).withColumn("v", F.lit(2))
    got = vector_dedup.near_duplicates(df).collect()
    assert len(got) == len(x) + len(odd)
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = (y @ y.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    links = {r.vec_id: r.n_links for r in got}
    assert all(links[i] <= near[i].sum() for i in range(len(x)))
    assert sum(links[i] for i in range(len(x))) >= 0.9 * near.sum()
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert [links[i] for i in (900, 901, 902, 903, 905)] == [0] * 5 and links[904] == 1
    assert vector_dedup.near_duplicates(df.limit(0)).collect() == []


def test_buckets_do_not_depend_on_the_batch():
    rng = np.random.default_rng(4)
    for dim in (3, 96, 1024):
        h, x = vector_dedup.Hasher(dim, 8, 12), rng.standard_normal((300, dim)) * 10.0 ** rng.integers(-200, 200, (300, 1))
        whole = h.buckets(x)
        for n in (1, 2, 7, 128):
            assert np.array_equal(whole, np.concatenate([h.buckets(x[i : i + n]) for i in range(0, 300, n)]))
        assert np.array_equal(whole, h.buckets(x * 2.0**-30))


def test_ties_and_huge_components(spark):
    """Cosines of exactly 0.9 (1800 of 2000) link, the next lower ones don't, whatever the scale."""
    one, tie, below = [2000.0, 0.0, 0.0], [1800.0, 760000.0**0.5, 0.0], [1799.999, 0.0, -(760003.6**0.5)]
    far = [0.0, 0.0, 1.0]
    rows = [(1, one), (2, [x * 1e300 for x in one]), (3, [x * 1e-300 for x in one]), (4, [1.7e308, 1.7e308, 0.0]), (5, [1.0, 1.0, 0.0]), (6, far), (7, far), (8, below)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in vector_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (1, 4), 5: (1, 4), 6: (1, 6), 7: (1, 6), 8: (0, 8)}
    x = np.array([one, tie])
    cosine = x[0] @ x[1] / (np.linalg.norm(x[0]) * np.linalg.norm(x[1]))
    got = vector_dedup.near_duplicates(spark.createDataFrame([(1, one), (2, tie)], "vec_id long, embedding array<double>"), least=float(cosine), recall=1 - 1e-9).collect()
    assert [r.n_links for r in got] == [1, 1]
    got = vector_dedup.near_duplicates(spark.createDataFrame([(1, one), (2, tie)], "vec_id long, embedding array<double>"), least=float(np.nextafter(cosine, 1)), recall=1 - 1e-9).collect()
    assert [r.n_links for r in got] == [0, 0]


def test_collision_rate_of_the_hash():
    rng = np.random.default_rng(1)
    h = vector_dedup.Hasher(16, 1, 4000)
    a, e = np.linalg.qr(rng.standard_normal((16, 2)))[0].T
    angle = 2 * np.arcsin(0.35)  # unit vectors 0.7 apart
    b = np.cos(angle) * a + np.sin(angle) * e
    same = (h.buckets(np.array([a])) == h.buckets(np.array([b]))).mean()
    assert abs(same - vector_dedup.collision(0.7, 2.0)) < 0.03


def test_packing(spark):
    rng = np.random.default_rng(5)
    lengths = [*rng.integers(1, 3000, 500).tolist(), 0, 40_000, 16_384]
    df = spark.createDataFrame([*enumerate(lengths), (503, None), (7, lengths[7])], "doc_id long, length long").withColumn("lot", F.lit(1))
    rows = pack(df).collect()
    by_bin: dict = {}
    for r in rows:
        if r.bin_id is None:
            assert r.length == 0
        else:
            by_bin.setdefault(r.bin_id, []).append(r)
    for items in by_bin.values():
        at = 0
        for r in sorted(items, key=lambda r: r.start):
            assert r.start == at
            at += r.length
        cap = items[0].capacity
        assert at <= cap and all(c < at for c in (1024, 2048, 4096, 8192, 16384) if c < cap)
    assert sum(r.length for r in rows) == sum(lengths) + lengths[7]
    assert sorted(r.piece for r in rows if r.doc_id == 501) == [0, 1, 2]
    assert sum(lengths) / sum(i[0].capacity for i in by_bin.values()) > 0.95
    assert pack(df.limit(0)).collect() == []


def test_repeated_ids_go_to_many_lots(spark):
    """Half of the rows are one id and length, some with other lengths: no lot is much over its bound."""
    rows = spark.range(40_000).selectExpr("CASE WHEN id % 2 = 0 THEN NULL ELSE id % 5 END AS doc_id", "CASE WHEN id % 8 = 1 THEN id % 900 ELSE 7 END AS length").withColumn("n", F.lit(1)).withColumn("piece", F.lit(2)).withColumn("copies", F.lit(3))
    got = pack(rows, lot_rows=4000)
    lots = got.where("bin_id IS NOT NULL").groupBy((F.col("bin_id") / 2**24).cast("long").alias("lot")).count().collect()
    assert len(lots) == 10 and max(r["count"] for r in lots) < 8000
    assert got.count() == 40_000 and got.agg(F.sum("length")).first()[0] == rows.agg(F.sum("length")).first()[0]
    spans = got.where("length > 0").groupBy("bin_id").agg(F.sum("length").alias("used"), F.max(F.col("start") + F.col("length")).alias("end"), F.countDistinct("start").alias("starts"), F.count("*").alias("n"), F.max("capacity").alias("c"))
    assert spans.where("used <> end OR starts <> n OR end > c").count() == 0


def plain_pack(lengths, capacities, attention):
    """The rule by scanning all open bins: least room left, of equal ones the one whose room came about last."""
    bins, stamp, rest = [], 0, sum(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        open_ = [b for b in bins if b["room"] >= n]
        if open_:
            b = min(open_, key=lambda b: (b["room"], -b["stamp"]))
        else:
            cost = lambda c: (c + attention * c * c / capacities[-1]) / min(c, rest)
            b = {"room": min((c for c in capacities if c >= n), key=lambda c: (cost(c), c)), "items": []}
            bins.append(b)
        b["items"].append(i)
        b["room"] -= n
        stamp += 1
        b["stamp"] = stamp
        rest -= n
    return [(sorted(b["items"]), min(c for c in capacities if c >= sum(lengths[i] for i in b["items"]))) for b in bins]


def test_packing_against_a_plain_form_of_the_rule():
    rng = np.random.default_rng(9)
    for seed in range(60):
        capacities = tuple(sorted({int(x) for x in rng.integers(5, 60, rng.integers(1, 5))}))
        lengths = rng.integers(1, capacities[-1] + 1, rng.integers(1, 80)).tolist()
        bins, starts, sizes = pack_lot(lengths, capacities, attention=0.25)
        got = [(sorted(i for i in range(len(lengths)) if bins[i] == b), sizes[b]) for b in range(len(sizes))]
        assert got == plain_pack(lengths, capacities, 0.25)
        for b in range(len(sizes)):
            at = 0
            for i in sorted((i for i in range(len(lengths)) if bins[i] == b), key=lambda i: starts[i]):
                assert starts[i] == at
                at += lengths[i]


def test_packing_takes_clashing_names_and_null_ids(spark):
    rows = [(None, 700), (None, 700), (1, None), (2, -5), (3, 0), (4, 50_000), (4, 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, length long").withColumns({c: F.lit(1) for c in ("n", "piece", "lot", "copies", "portion", "start", "capacity", "bin_id")})
    got = pack(df).collect()
    assert sum(r.length for r in got) == 101_400 and sorted(r.piece for r in got if r.doc_id == 4) == [0, 0, 1, 1, 2, 2, 3, 3]
    assert all((r.bin_id is None) == (r.length == 0) for r in got) and sum(r.doc_id is None for r in got) == 2


def test_best_fit_takes_the_tightest_room():
    bins, starts, sizes = pack_lot([7, 6, 3, 2, 2], (4, 10), attention=0.0)
    assert [bins[0], bins[2]] == [bins[0], bins[0]] and starts[2] == 7 and sizes[bins[0]] == 10
    assert bins[1] == bins[3] == bins[4] and sizes[bins[1]] == 10


def test_quotes_are_parsed():
    own, passages = parse("> > deep\n> one\n>one more\nmine\n\n>> again")
    assert own == "mine" and passages == [(2, "deep"), (1, "one\none more"), (2, "again")]


def test_conversations(spark):
    said = [
        (1, 0, "u", "Hello world.\nSecond line here"),
        (1, 1, "a", "> Hello world.\nAnswer one"),
        (1, 2, "u", "> > Hello world.\n> Answer one\nReply two"),
        (1, 3, "u", "> second LINE, here\nOther"),
        (2, 0, "u", "> Answer one\nCross"),
        (2, 0, "u", "> Answer one\nCross"),
        (2, 1, "z", ">nothing\nx"),
        (2, None, "y", "> Hello world."),
        (None, 1, "x", None),
        *[(3, i, "u", "same first turn") for i in range(3000)],
    ]
    df = spark.createDataFrame(said, "conv_id long, turn int, role string, text string").withColumn("h", F.lit(1)).withColumn("path", F.lit(1))
    rows = link_quotes(df).collect()
    assert len(rows) == len(said)
    got = {(r.conv_id, r.turn): r for r in rows}
    assert [(got[1, t].parent_conv, got[1, t].parent_turn, got[1, t].position, got[1, t].body) for t in (1, 2, 3)] == [(1, 0, 1, "Answer one"), (1, 1, 2, "Reply two"), (1, 0, 3, "Other")]
    assert (got[1, 2].root_turn, got[1, 2].depth, got[1, 2].max_level) == (0, 2, 2)
    assert (got[2, 0].parent_conv, got[2, 0].parent_turn, got[2, 0].root_turn) == (1, 1, 0)
    assert got[2, 1].parent_conv is None and got[None, 1].body == ""
    assert sorted(r.position for r in rows if r.conv_id == 3) == list(range(3000))
    assert all(got[3, i].position == i for i in range(3000))
    assert link_quotes(df.limit(0)).collect() == []
