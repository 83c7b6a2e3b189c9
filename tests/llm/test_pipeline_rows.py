import random
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as cp


def texts(rng):
    words = ["".join(rng.choice("aeioubcdfgl") for _ in range(rng.randint(2, 9))) for _ in range(500)]
    return lambda: " ".join(rng.choice(words) for _ in range(40))


def kept(df):
    assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_toxicity_judges_each_row(docs, spark, tmp_path):
    make = texts(random.Random(9))
    rows = [(i, "filthy scum vermin " * 8 if i % 2 else make(), "en", "s") for i in range(1, 121)]
    spark.createDataFrame([(i, i % 2) for i in range(1, 121)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    good, bad = make(), "filthy scum vermin " * 9
    odd = [(None, good, "en", "s"), (None, bad, "en", "s"), (500, good, "en", "s"), (500, bad, "en", "s"), (500, good, "en", "s")]
    got = kept(cp.drop_toxic(spark, docs(rows + odd), str(tmp_path)))
    assert (got[None, good], got[500, good]) == (1, 2) and not any(t == bad for _, t in got)


def test_quality_judges_each_row(docs, spark):
    make = texts(random.Random(10))
    rows = [(i, make(), "en", "s") for i in range(300)]
    good = make()
    odd = [(None, good, "en", "s"), (None, "too short", "en", "s"), (500, good, "en", "s"), (500, "too short", "en", "s"), (500, good, "en", "s")]
    assert kept(cp.drop_low_quality(spark, docs(rows + odd), "")) == Counter((i, t) for i, t, *_ in rows + odd if t != "too short")


def test_one_row_of_a_group_stays(docs, spark):
    make = texts(random.Random(11))
    a, b, c = make(), make(), make()
    near = a + " more"
    rows = [(None, a, "en", "s"), (3, a, "en", "s"), (3, a, "en", "s"), (3, b, "en", "s"), (9, near, "en", "s"), (None, c, "en", "s"), (None, c, "en", "s")]
    assert kept(cp.drop_near_duplicates(spark, docs(rows), "")) == Counter({(3, a): 1, (3, b): 1, (None, c): 1})


def test_stages_take_empty_tables_and_any_columns(docs, spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    make = texts(random.Random(12))
    long = " ".join(make() for _ in range(3000))
    rows = [(i, make(), "en", "s") for i in range(40)] + [(40, long, "en", "s"), (41, None, None, None), (42, "", "en", "s"), (None, None, "en", "s")]
    full = docs(rows, extra=True).withColumns({c: F.lit(1) for c in ("row", "h", "predicted", "kept", "distance", "parity", "at", "component_id")})
    for df in (full, full.limit(0)):
        now = df
        for name, stage in cp.STAGES[:-1]:
            after = stage(spark, now, str(tmp_path))
            assert after.dtypes == df.dtypes
            if name == "toxicity":  # no labels: nothing is known to be toxic
                assert after.count() == df.count()
            now = after
        ids = Counter(r.doc_id for r in now.collect())
        assert ids == (Counter(range(41)) if df is full else Counter())
        packed = cp.pack_sequences(spark, now, str(tmp_path))
        assert packed.agg(F.sum("length")).first()[0] == (sum(len(t.encode()) for _, t, *_ in rows if t) if df is full else None)


def test_a_stage_removes_what_stood_behind_its_predecessor(docs, spark, tmp_path):
    make = texts(random.Random(13))
    first = cp.drop_low_quality(spark, docs([(i, make(), "en", "s") for i in range(50)]), "")
    roots = [s for s in cp._behind]
    assert any(s.live for s in roots)
    lazy = cp.drop_near_duplicates(spark, first, "")  # reads the first stage's tables still
    assert lazy.count() == 50 and any(s.live for s in roots)
    first.write.parquet(f"{tmp_path}/first")
    cp.drop_near_duplicates(spark, spark.read.parquet(f"{tmp_path}/first"), "").count()
    assert not any(s.live for s in roots)
