import os
import zlib

import pytest

from millrace.llm import quality, toxicity

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_stages_keep_what_their_operators_keep(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    kept = docs.toPandas()
    assert [name for name, _ in cp.STAGES] == ["toxicity", "quality", "ngram_join", "packing"]

    marked = kept.merge(labels.dropna(), on="doc_id").sort_values("doc_id", key=lambda c: c.astype(str))
    marked = marked[[zlib.crc32(str(i).encode()) % 5 != 0 for i in marked.doc_id]]
    fold = [zlib.crc32(str(i).encode()) // 5 % toxicity.FOLDS for i in marked.doc_id]
    model = toxicity.fit(marked.text.tolist(), marked.toxic.astype(int).tolist(), fold=fold)
    kept = kept[[model.score(toxicity.grams(t)) < 0.5 for t in kept.text]]
    frame = spark.createDataFrame(kept, docs.schema)
    verdict = quality.quality(frame).where("kept").toPandas()
    kept = kept[kept.doc_id.isin(verdict.doc_id)]
    from test_ngram_join import brute

    groups = brute(list(zip(kept.doc_id, kept.text)), 5, 80)
    kept = kept[[groups[i][1] == i for i in kept.doc_id]]
    out = cp.run(spark, SF).toPandas()
    assert set(out.doc_id) == set(kept.doc_id)
    assert out.length.sum() == sum(len(t.encode()) for t in kept.text)
