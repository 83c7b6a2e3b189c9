"""Language identification by bit-sliced Bloom filters of character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import code_points, gram_hashes

ORDERS, HASH_BITS = (2, 3, 4), 32
FILTER_BITS, PROBES = 20, 3


_TABLE = np.zeros(0x110000, np.uint32)
_known = np.zeros(0x110000, bool)


def _letters(text: str) -> np.ndarray:
    """Lower-case letters in words with a space around each; other characters separate words."""
    points = code_points(text.lower())
    new = points[~_known[points]]
    if len(new):
        for p in np.unique(new).tolist():
            _TABLE[p], _known[p] = (p if chr(p).isalpha() else 32), True
    mapped = _TABLE[points]
    space = mapped == 32
    keep = np.ones(len(mapped), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    mapped = mapped[keep]
    return np.concatenate([[32], mapped, [32]]).astype(np.uint32) if len(mapped) else np.array([32], np.uint32)


def grams(text: str) -> np.ndarray:
    points = _letters(text)
    if not (points != 32).any():
        return np.zeros(0, np.uint32)
    found = list(gram_hashes(points, ORDERS, HASH_BITS))
    return np.concatenate(found) if found else np.zeros(0, np.uint32)


def _probes(ids: np.ndarray) -> Iterator[np.ndarray]:
    a = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    step = (a >> np.uint64(20)) | np.uint64(1)
    for k in range(PROBES):
        yield ((a + np.uint64(k) * step) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


@dataclass
class Model:
    """slices[place] has a bit for each language whose filter is set there."""

    languages: list[str]
    slices: np.ndarray
    false_rate: np.ndarray

    def holders(self, ids: np.ndarray) -> np.ndarray:
        """For each n-gram the mask of all languages whose filters contain it."""
        mask = None
        for place in _probes(ids):
            mask = self.slices[place] if mask is None else mask & self.slices[place]
        return mask

    def predict(self, text: str | None) -> tuple[str, float]:
        ids = grams(text or "")
        if not len(ids) or not self.languages:
            return "und", 0.0
        masks = self.holders(ids)
        counts = np.zeros(len(self.languages))
        for i in range(len(self.languages)):
            word, bit = divmod(i, 64)
            counts[i] = int((masks[:, word] >> np.uint64(bit) & np.uint64(1)).sum())
        share = np.clip((counts / len(ids) - self.false_rate) / (1 - self.false_rate), 0, 1)
        best = int(np.argmax(share))
        total = share.sum()
        return self.languages[best], float(share[best] / total) if total > 0 else 1 / len(self.languages)


def build(grams_of: dict[str, np.ndarray]) -> Model:
    """Sets each language's n-grams in the shared slices; rates of false positives are those of the filled filters."""
    languages = sorted(grams_of)
    slices = np.zeros((1 << FILTER_BITS, max(1, -(-len(languages) // 64))), np.uint64)
    for i, name in enumerate(languages):
        word, bit = divmod(i, 64)
        for place in _probes(grams_of[name]):
            slices[place, word] |= np.uint64(1 << bit)
    filled = np.array([((slices[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(languages))])
    return Model(languages, slices, filled**PROBES if len(languages) else filled)


def held_out(doc_id: str):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", most_rows: int = 3000, most_grams: int = 40_000, least_share: float = 0.004, excess: float = 2.0) -> Model:
    """Learns from about `most_rows` rows of each language that are not held out.

    Counts of n-grams by language are made on the executors. A language's filter
    gets the n-grams found in at least `least_share` of its texts and there at
    least `excess` times as often as in the texts of all languages on average,
    the `most_grams` most telling ones. Rows with a null lang don't count.
    """
    known = docs.where(F.col(lang).isNotNull() & ~held_out(doc_id)).select(F.col(doc_id).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    n = {r.lang: r.n for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n:
        return build({})
    draw = F.pmod(F.xxhash64("id", F.lit(13)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rate = F.create_map(*[x for k, c in n.items() for x in (F.lit(k), F.lit(min(1.0, most_rows / c)))])
    sample = known.where(draw < rate[F.col("lang")]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for batch in batches:
            for name, t in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                held.setdefault(name, []).append(np.unique(grams(t or "")))
        for name, rows in held.items():
            ids, c = np.unique(np.concatenate(rows), return_counts=True)
            yield pa.record_batch([pa.array([name] * len(ids), pa.string()), pa.array(ids.astype(np.int64)), pa.array(c.astype(np.int64))], names=["lang", "gram", "n"])

    counts = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    used = F.create_map(*[x for k, c in n.items() for x in (F.lit(k), F.lit(float(min(c, most_rows))))])
    shares = counts.withColumn("share", F.col("n") / used[F.col("lang")])
    mean = shares.groupBy("gram").agg((F.sum("share") / len(n)).alias("mean"))
    telling = shares.where(F.col("share") >= least_share).join(mean, "gram").where(F.col("share") >= min(excess, 0.5 * len(n) + 0.5) * F.col("mean"))
    found: dict[str, list] = {k: [] for k in n}
    for r in telling.select("lang", "gram", "share").collect():
        found[r.lang].append((-r.share, r.gram))
    return build({k: np.array([g for _, g in sorted(v)[:most_grams]], dtype=np.uint32) for k, v in found.items()})


def identify(df: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred and score (0 to 1) for every row of `df`.

    lang_pred is `und` with score 0 where the text is null or has no letter;
    ties go to the language that sorts first. The model's size does not depend
    on the corpus. Each repeated row gets its own row.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = df.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            found = [m.predict(t.as_py()) for t in batch.column("text")]
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    read = df.select(F.col(doc_id).alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(text).alias("text"))
    return read.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
