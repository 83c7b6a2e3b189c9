"""The queries of this subpackage: (spark, sf_dir) -> DataFrame, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score, train

    docs = _table(spark, sf_dir, "documents")
    return score(docs, train(docs, _table(spark, sf_dir, "labels")))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quoting import link_quotes

    return link_quotes(_table(spark, sf_dir, "conversations"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    return shard(_table(spark, sf_dir, "documents"), 40)


def op4_token_counts(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    from .unigram_count import count_tokens

    return count_tokens(_table(spark, sf_dir, "documents"), path or _vocabulary("piece_bpe_32k.model"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents"), width=4, percent=85)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    docs = _table(spark, sf_dir, "documents")
    return pack(docs.select("doc_id", F.octet_length("text").alias("length")))


def op7_byte_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    import public_tokenizers

    from .byte_bpe import encode_table

    return encode_table(_table(spark, sf_dir, "documents"), path or _vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    return quality(_table(spark, sf_dir, "documents"))


def op9_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "embeddings"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify, train

    docs = _table(spark, sf_dir, "documents")
    return identify(docs, train(docs))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


#: All pairs that share a shingle, and what is reachable by links.
_OP5 = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n FROM s), f AS (SELECT doc_id, unnest(sh) AS x FROM s),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, COUNT(*) AS c FROM f a JOIN f b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT u, v FROM p JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * c >= 85 * (a.n + b.n - c)),
b AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
r AS (SELECT doc_id AS a, doc_id AS z FROM n UNION SELECT r.a, b.v FROM r JOIN b ON b.u = r.z)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, MIN(r.z) AS component_id FROM n JOIN r ON r.a = n.doc_id GROUP BY ALL"""

#: All pairs of vectors. The hash tables find a link of the least similarity with probability 0.985, others more surely; they find all links of the small tables.
_OP9 = """WITH RECURSIVE n AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
g AS (SELECT vec_id, list_transform(e, lambda q: coalesce(q, 0)) AS e, sqrt(list_sum(list_transform(e, lambda q: q * q))) AS s FROM n WHERE len(list_filter(e, lambda q: q IS NULL OR NOT isfinite(q))) = 0),
k AS (SELECT a.vec_id AS u, b.vec_id AS v FROM g a JOIN g b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND a.s > 0 AND b.s > 0 WHERE list_dot_product(a.e, b.e) / (a.s * b.s) >= 0.9),
r AS (SELECT vec_id AS a, vec_id AS z FROM n UNION SELECT r.a, k.v FROM r JOIN k ON k.u = r.z)
SELECT n.vec_id, (SELECT COUNT(*) FROM k WHERE k.u = n.vec_id) AS n_links, MIN(r.z) AS component_id, n.vec_id = MIN(r.z) AS kept FROM n JOIN r ON r.a = n.vec_id GROUP BY n.vec_id"""


def oracle_sql() -> dict[str, str]:
    """Where SQL can express a query; the others hash, fit a model, or follow rules without a set form, and are tested against brute force."""
    return {"op5_ngram_join": _OP5, "op9_vector_dedup": _OP9}
