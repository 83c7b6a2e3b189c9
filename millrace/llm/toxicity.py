"""Toxicity scores by a linear classifier over naive-Bayes-scaled character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import Scratch
from ._text import code_points, gram_hashes

ORDERS, BITS = (3, 4, 5, 6), 20


def grams(text: str | None) -> np.ndarray:
    """Sorted distinct buckets of the n-grams of the lower-cased text, white space collapsed."""
    points = code_points(" " + " ".join((text or "").lower().split()) + " ")
    found = list(gram_hashes(points, ORDERS, BITS))
    if not found:
        return np.zeros(0, np.uint32)
    every = np.concatenate(found)
    if len(every) < 1 << 16:
        return np.unique(every)
    seen = np.zeros(1 << BITS, bool)
    seen[every] = True
    return np.flatnonzero(seen).astype(np.uint32)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Model:
    """Weights by n-gram bucket (0: not selected), and the calibration of the margin."""

    weight: np.ndarray
    selected: np.ndarray
    bias: float
    scale: float = 1.0
    shift: float = 0.0

    def margin(self, ids: np.ndarray) -> float:
        return float(self.weight[ids].sum() / np.sqrt(max(1, int(self.selected[ids].sum()))) + self.bias)

    def score(self, ids: np.ndarray) -> float:
        return float(_sigmoid(self.scale * self.margin(ids) + self.shift))


#: Folds of the calibration, features of a model and rows that a feature must stand in.
FOLDS, FEATURES, LEAST_DF = 3, 10_000, 4
#: n-grams of rows that one step of the descent handles at once.
STRIDE = 1 << 18


def _choose(df: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The features with most evidence, given how many rows of label 0 and 1 hold each, and their log-count ratios."""
    ratio = np.log((df[1] + 1) / (n[1] + 2)) - np.log((df[0] + 1) / (n[0] + 2))
    total = df[0] + df[1]
    evidence = np.where(total >= LEAST_DF, np.abs(ratio) * np.sqrt(total), 0)
    chosen = np.sort(np.argsort(-evidence, kind="stable")[:FEATURES])
    chosen = chosen[evidence[chosen] > 0]
    return chosen, ratio[chosen]


class Rows:
    """n-gram buckets of many rows in one array: those of row i are at begins[i] to ends[i], by place in `names` if that is given."""

    def __init__(self, held: np.ndarray, begins: np.ndarray, ends: np.ndarray, names: np.ndarray | None = None):
        self.held, self.begins, self.ends, self.names = held, begins, ends, names

    @staticmethod
    def of(parts: Iterator[np.ndarray]) -> Rows:
        held = list(parts)
        ends = np.cumsum([len(x) for x in held])
        return Rows(np.concatenate(held), np.append(0, ends[:-1]), ends)

    def __getitem__(self, i: int) -> np.ndarray:
        ids = self.held[self.begins[i] : self.ends[i]]
        return ids if self.names is None else self.names[ids]

    def blocks(self, some: np.ndarray) -> Iterator[np.ndarray]:
        """The row numbers `some` in runs of about STRIDE buckets."""
        size = np.cumsum(self.ends[some] - self.begins[some])
        cuts = np.searchsorted(size, np.arange(STRIDE, int(size[-1]) + STRIDE, STRIDE)) + 1 if len(size) else []
        return (x for x in np.split(some, cuts) if len(x))


def _descend(rows: Rows, some: np.ndarray, labels: np.ndarray, chosen: np.ndarray, ratio: np.ndarray, decay: float = 2e-5, steps: int = 200) -> Model:
    """Logistic regression on the chosen features of the rows `some`, in blocks of rows."""
    size = 1 << BITS
    place = np.full(size, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    blocks = []
    for block in rows.blocks(some):
        cols = [c[c >= 0] for c in (place[rows[i]] for i in block)]
        lens = np.array([len(c) for c in cols])
        blocks.append((np.concatenate(cols).astype(np.uint16), lens.astype(np.int32), labels[block]))
    w, m, s = (np.zeros(len(chosen) + 1) for _ in range(3))
    w[-1] = -2.0
    for t in range(1, steps + 1):
        grad = np.append(decay * w[:-1], 0.0)
        scaled = w[:-1] * ratio
        for col, lens, y in blocks:
            row = np.repeat(np.arange(len(lens)), lens)
            length = np.sqrt(np.maximum(lens, 1))
            g = (_sigmoid(np.bincount(row, scaled[col], len(lens)) / length + w[-1]) - y) / len(some)
            grad[:-1] += np.bincount(col, (g / length)[row], len(chosen)) * ratio
            grad[-1] += g.sum()
        m = 0.9 * m + 0.1 * grad
        s = 0.99 * s + 0.01 * grad * grad
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-9)
    weight = np.zeros(size, np.float32)
    weight[chosen] = w[:-1] * ratio
    selected = np.zeros(size, bool)
    selected[chosen] = True
    return Model(weight, selected, float(w[-1]))


def _plans(df: np.ndarray, y: np.ndarray, fold: np.ndarray) -> list[tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]]:
    """For the fit on all rows and, where calibration is possible, on all but each fold: its rows and features.

    df[f, y] holds for each feature the rows of fold f and label y that have it.
    """
    n = np.array([[((fold == f) & (y == v)).sum() for v in (0, 1)] for f in range(FOLDS)])
    out = [(np.arange(len(y)), _choose(df.sum(0), n.sum(0)))]
    if min((y == 1).sum(), (y == 0).sum()) >= 2 * FOLDS:
        for f in range(FOLDS):
            rest = [k for k in range(FOLDS) if k != f]
            out.append((np.flatnonzero(fold != f), _choose(df[rest].sum(0), n[rest].sum(0))))
    return out


def _constant(y: np.ndarray, importance: np.ndarray) -> Model:
    """With one class only (or no rows): that class's share, kept off 0 and 1."""
    share = (importance[y == 1].sum() + 0.5) / (importance.sum() + 1) if len(y) else 0.25
    return Model(np.zeros(1 << BITS, np.float32), np.zeros(1 << BITS, bool), float(np.log(share / (1 - share))))


def _calibrated(plans: list, rows: Rows, y: np.ndarray, fold: np.ndarray, importance: np.ndarray) -> Model:
    """The fit on all rows, its margin calibrated on margins of rows left out of the other fits."""
    model = _descend(rows, plans[0][0], y, *plans[0][1])
    if len(plans) == 1:
        return model
    margin = np.zeros(len(y))
    for f, (some, features) in enumerate(plans[1:]):
        part = _descend(rows, some, y, *features)
        for i in np.flatnonzero(fold == f):
            margin[i] = part.margin(rows[i])
    model.scale, model.shift = _platt(margin, y, importance)
    return model


def _platt(margin: np.ndarray, y: np.ndarray, importance: np.ndarray, least: float = 0.05) -> tuple[float, float]:
    """Scale and shift of a logistic regression on the margin, by Newton steps that are halved until the loss falls.

    Targets lie a little off 0 and 1 (Platt), so that a gap between the classes doesn't make a step of it. A scale
    under `least`, as few rows can give, is set to it, so that a higher margin never scores lower.
    """
    target = np.where(y == 1, 1 - 1 / ((y == 1).sum() + 2), 1 / ((y == 0).sum() + 2))

    def loss(x: np.ndarray) -> float:
        z = x[0] * margin + x[1]
        return float((importance * (np.logaddexp(0, z) - target * z)).sum() + 5e-4 * (x[0] - 1) ** 2)

    def settled(x: np.ndarray, free: list[int]) -> np.ndarray:
        for _ in range(100):
            p = _sigmoid(x[0] * margin + x[1])
            g, h = importance * (p - target), importance * p * (1 - p) + 1e-9
            grad = np.array([(g * margin).sum() + 1e-3 * (x[0] - 1), g.sum()])[free]
            hess = np.array([[(h * margin * margin).sum() + 1e-3, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-3]])[np.ix_(free, free)]
            step = np.zeros(2)
            step[free] = np.linalg.solve(hess, grad)
            while loss(x - step) > loss(x) and np.abs(step).max() > 1e-9:
                step /= 2
            x = x - step
            if np.abs(step).max() < 1e-8:
                break
        return x

    x = settled(np.array([1.0, 0.0]), [0, 1])
    if x[0] < least:
        x = settled(np.array([least, 0.0]), [1])
    return float(x[0]), float(x[1])


def fit(texts: list[str], labels: list[int], weights: list[float] | None = None, fold: list[int] | None = None) -> Model:
    """Fits the classifier on texts at hand; train() does the same with the counts made by executors.

    With one class only (or no rows) every score is that class's share, kept off 0 and 1.
    """
    y = np.array(labels, np.int64)
    importance = np.ones(len(y)) if weights is None else np.array(weights, float)
    if len(y) == 0 or y.min() == y.max():
        return _constant(y, importance)
    f = np.arange(len(y)) % FOLDS if fold is None else np.array(fold)
    rows = Rows.of(grams(t) for t in texts)
    df = np.zeros((FOLDS, 2, 1 << BITS), np.int32)
    for i in range(len(y)):
        df[f[i], y[i], rows[i]] += 1
    return _calibrated(_plans(df, y, f), rows, y, f, importance)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each n-gram of a task's rows how many of each fold and label hold it (columns d0, d1, ...)."""
    df = np.zeros((2 * FOLDS, 1 << BITS), np.int32)
    for batch in batches:
        for t, y, fold in zip(batch.column("text"), batch.column("y").to_pylist(), batch.column("fold").to_pylist()):
            df[2 * fold + y, grams(t.as_py())] += 1
    held = np.flatnonzero(df.any(axis=0))
    if len(held):
        yield pa.record_batch([pa.array(held.astype(np.int32)), *(pa.array(x[held]) for x in df)], names=["gram", *(f"d{k}" for k in range(2 * FOLDS))])


def held_out(doc_id: str, folds: int = 5, fold: int = 0):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", most_positive: int = 1500, most_negative: int = 3000) -> Model:
    """Fits on labelled rows that are not held out, at most about `most_positive` and `most_negative` of them.

    Rows of `labels` are chosen by a hash of their id before any text is read,
    and the chosen ids, which that bound limits, are broadcast to the scan.
    Repeated labels of an id count once, 1 before 0; null labels don't count. An id that
    stands on several texts gives the least of them.

    Executors count the n-grams and then give each row's chosen ones; the driver
    gets a row for each n-gram (at most 2 ** BITS) and these.
    """
    store = Scratch(docs.sparkSession)
    held = F.coalesce(held_out(doc_id), F.lit(True))
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).where(~held).groupBy(F.col(doc_id).alias("id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    n = {int(r.y > 0): r.n for r in known.groupBy((F.col("y") > 0).cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    rate = {y: min(1.0, most / max(1, n.get(y, 0))) for y, most in ((0, most_negative), (1, most_positive))}
    draw = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = known.where(draw < F.when(F.col("y") > 0, rate[1]).otherwise(rate[0]))
    fold = F.floor(F.crc32(F.col("id").cast("string").cast("binary")) / 5) % FOLDS
    read = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(chosen), "id")
    drawn = store.keep(read.groupBy("id", (F.col("y") > 0).cast("int").alias("y")).agg(F.min("text").alias("text")).withColumn("fold", fold.cast("int")), "drawn", 16 * (most_positive + most_negative))

    cells = [f"d{k}" for k in range(2 * FOLDS)]
    rows = sorted(((str(r.id), r.y, r.fold) for r in drawn.select("id", "y", "fold").collect()))
    y, f = (np.array([r[k] for r in rows], np.int64) for k in (1, 2))
    importance = np.array([1 / rate[v] for v in y])
    if len(y) == 0 or y.min() == y.max():
        store.keep_only()
        return _constant(y, importance)
    found = drawn.mapInArrow(_counted, "gram int, " + ", ".join(f"{c} int" for c in cells)).groupBy("gram").agg(*(F.sum(c).cast("int").alias(c) for c in cells)).where(sum((F.col(c) for c in cells), F.lit(0)) >= LEAST_DF).toArrow()
    df = np.zeros((FOLDS, 2, 1 << BITS), np.int32)
    for k, c in enumerate(cells):
        df[k // 2, k % 2, found.column("gram").to_numpy()] = found.column(c).to_numpy()
    plans = _plans(df, y, f)
    del found, df
    used = np.unique(np.concatenate([features for _, (features, _) in plans])).astype(np.uint32)
    place = np.full(1 << BITS, -1, np.int32)
    place[used] = np.arange(len(used))
    shared = docs.sparkSession.sparkContext.broadcast(place)

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = (shared.value[grams(t.as_py())] for t in batch.column("text"))
            yield pa.record_batch([batch.column("id"), pa.array([x[x >= 0].astype(np.uint16).tobytes() for x in places], pa.binary())], names=["id", "grams"])

    got = drawn.select(F.col("id").cast("string").alias("id"), "text").mapInArrow(picked, "id string, grams binary").toArrow().combine_chunks()
    order = np.argsort(np.array(got.column("id").to_pylist(), object), kind="stable")
    column = got.column("grams").chunk(0).cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) // 2
    model = _calibrated(plans, Rows(np.frombuffer(column.buffers()[2], np.uint16), ends[:-1][order], ends[1:][order], used), y, f, importance)
    shared.destroy()
    store.keep_only()
    return model


def score(df: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", carry: bool = False) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of `df`.

    The model (some MB whatever the corpus) is broadcast; a row's score depends on
    its text only. Null and empty texts have the score of a text without n-grams.
    Each repeated row gets its own row; a null doc_id is not held out. With
    `carry` each row of `df` comes along whole, as the column row.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = df.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            scores = [m.score(grams(t.as_py())) for t in batch.column("text")]
            rows = [batch.column("row")] if carry else []
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), *rows], names=["doc_id", "held_out", "score", "predicted"] + ["row"] * carry)

    read = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(held_out(doc_id), F.lit(False)).alias("held_out"), F.col(text).alias("text"), *([F.struct(*df.columns).alias("row")] if carry else []))
    whole = f", row {read.schema['row'].dataType.simpleString()}" if carry else ""
    return read.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int{whole}")
