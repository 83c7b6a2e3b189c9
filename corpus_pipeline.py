"""From raw documents to packed training sequences: toxicity, quality, near duplicates, packing.

Each stage reads what its predecessor kept and, but for the last, returns the
columns of its input, whatever they are called beside doc_id, text, lang and source. Every row has a verdict of its own: a doc_id may be null,
or stand on several rows. run() writes each stage's result as Parquet in the shared
folder and reads it again, so that a lost executor costs no more than a stage.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import ngram_join, packing, quality, toxicity
from millrace.llm._store import Scratch, reads, watched

_behind: list[Scratch] = []


def _stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that first removes the tables behind its predecessor's result: that was written, unless `docs` still reads them."""

    @wraps(f)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for scratch in [s for s in _behind if not reads(docs, s)]:
            scratch.keep_only()
            _behind.remove(scratch)
        with watched() as made:
            out = f(spark, docs, sf_dir)
        _behind.extend(made)
        return out

    return stage


@_stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under 0.5 by a classifier trained on the labelled ones among `docs`.

    Rows are judged each by its own text. Null and empty texts are scored as a text without n-grams. Without labels
    of both classes all rows are scored by the one class's share. Of no documents none are returned.
    """
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model, carry=True).where("predicted = 0").select("row.*")


@_stage
def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and are no outliers of their language and source.

    Rows are judged each by its own text; null and empty ones have no words and go. A null lang or source is a value of
    its own. Of no documents none are returned.
    """
    return quality.quality(docs, carry=True).where("kept").select("row.*")


@_stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by 0.8 or more of their five-word shingles, one row of the least doc_id (a null one last).

    Rows are told apart by a key of the stage, not by doc_id, which may be null or repeated; of rows of one doc_id
    the first by that key stays. A text without words (null, empty) is linked with nothing and stays. Of no documents none are returned.
    """
    keyed = Scratch(spark).keep(docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("key")), "keyed")
    groups = ngram_join.jaccard_components(keyed.select("key", F.col("row.text").alias("text")), doc_id="key", width=5, percent=80)
    ids = keyed.select("key", F.struct(F.col("row.doc_id").isNull().alias("none"), F.col("row.doc_id").alias("doc_id"), "key").alias("at"))
    least = groups.withColumnRenamed("doc_id", "key").join(ids, "key").groupBy("component_id").agg(F.min("at").alias("at"))
    return keyed.join(least.select("at.key"), "key", "left_semi").select("row.*")


@_stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of byte-level tokens (a text's UTF-8 bytes): the ids of a byte-level model without merges, which any text has.

    Null and empty texts have a row without a bin, repeated rows a place each, no documents no rows.
    """
    return packing.pack(docs.select("doc_id", F.octet_length("text").alias("length")))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("ngram_join", drop_near_duplicates),
    ("packing", pack_sequences),
]

#: No stage but the last can be stated in SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        last, docs = docs, store.keep(stage(spark, docs, sf_dir), name)
        if hasattr(last, "_millrace_path"):
            store.drop(last)
    return docs
