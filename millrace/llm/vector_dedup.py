"""Near-duplicate vectors by Euclidean p-stable hashing and exact cosine checks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import Scratch
from ._text import U64, mix
from .components import connected_components

#: Rows of a bucket that are compared as one block.
BLOCK = 512


def collision(distance: float, width: float) -> float:
    """Probability that one quantised Gaussian projection agrees for two points so far apart."""
    t = width / distance
    normal = 0.5 * math.erfc(t / math.sqrt(2))
    return 1 - 2 * normal - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


def plan(rows: int, least: float, recall: float, load: float = 256.0, width: float = 2.0) -> tuple[int, int]:
    """Projections a table and tables, so that strangers meet about `load` a bucket and a link at the
    least similarity is found with probability `recall`."""
    near, far = math.sqrt(2 - 2 * least), math.sqrt(2)
    k = max(4, math.ceil(math.log(max(rows, 2) / load) / -math.log(collision(far, width))))
    p = collision(near, width) ** k
    return k, max(1, math.ceil(math.log(1 - recall) / math.log(1 - p)))


def scaled(x: np.ndarray) -> np.ndarray:
    """Each row by a power of two, so that its largest component lies in [0.5, 1); this rounds nothing but what vanishes beside it."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


class Hasher:
    """tables x projections random directions and offsets, the same wherever they are made.

    Directions and unit vectors are rounded to so few bits that products and their sums are
    exact in double precision. So a vector's cells don't depend on the batch it is
    hashed in, whatever order a matrix product adds in.
    """

    def __init__(self, dim: int, projections: int, tables: int, width: float = 2.0, seed: int = 7):
        rng = np.random.default_rng([seed, dim, projections, tables])
        self.step = 2.0 ** ((50 - math.ceil(math.log2(dim + 1))) // 2)
        self.a = np.rint(np.clip(rng.standard_normal((dim, tables * projections)), -8, 8) * self.step) / self.step
        self.b = rng.random(tables * projections) * width
        self.shape, self.width = (tables, projections), width

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """A bucket hash for each row and table."""
        x = np.rint(scaled(x) * self.step) / self.step
        unit = np.rint(x / np.sqrt((x * x).sum(axis=1, keepdims=True)) * self.step) / self.step
        cell = np.floor((unit @ self.a + self.b) / self.width).astype(np.int64).astype(U64).reshape(-1, *self.shape)
        h = np.broadcast_to(np.arange(self.shape[0], dtype=U64) + U64(1), cell.shape[:2]).copy()
        for j in range(self.shape[1]):
            h = mix(h * U64(0x9E3779B97F4A7C15) + cell[:, :, j])
        return h


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)


def near_duplicates(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", least: float = 0.9, recall: float = 0.985) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of `df`.

    n_links counts the other rows linked directly (cosine >= least, in double
    precision, among the pairs that the hash tables bring together); component_id
    is the least vec_id reachable by links. A vector that is null, zero, empty or
    holds a null or a non-finite component links with nothing. Vectors of another
    length than the table's first by count link within their length only. Equal
    vectors, repeated rows included, are one class and hashed once. A null
    vec_id keeps a null component_id and links nothing. An empty table gives no
    rows; other columns are not read.

    A bucket is compared in blocks, so its size bounds no task. A pair is counted
    in the first table in which it meets. Only counts and, for each block of
    pairs, a forest of its links leave a task.
    """
    spark = df.sparkSession
    store = Scratch(spark)
    rows = store.keep(df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("v")), "rows")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0))
    classes = store.keep(usable.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")).withColumn("dim", F.size("v")), "classes")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts, edges, n_edges = [], [], 0
    for dim, n in sorted((r.dim, r.n) for r in classes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()):
        projections, tables = plan(n, least, recall)
        own = classes.where(F.col("dim") == dim)

        def bucketed(batches: Iterator[pa.RecordBatch], dim=dim, projections=projections, tables=tables) -> Iterator[pa.RecordBatch]:
            hasher = Hasher(dim, projections, tables)
            for batch in batches:
                for a in range(0, batch.num_rows, 4096):
                    part = batch.slice(a, 4096)
                    h = hasher.buckets(_vectors(part.column("v"), dim))
                    n = len(h)
                    yield pa.record_batch([pa.array(np.tile(part.column("rep").to_numpy(), tables)), pa.array(np.repeat(np.arange(tables, dtype=np.int32), n)), pa.array(h.T.ravel().view(np.int64))], names=["rep", "t", "bucket"])

        placed = store.keep(own.select("rep", "v").mapInArrow(bucketed, "rep long, t int, bucket long"), f"buckets{dim}")
        full = placed.groupBy("t", "bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1").withColumn("blocks", F.ceil(F.col("m") / BLOCK))
        met = placed.join(full, ["t", "bucket"]).withColumn("i", F.pmod(F.xxhash64("rep"), F.col("blocks")))
        other = met.select("rep", "t", "bucket", "i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("j"))
        dealt = other.select("rep", "t", "bucket", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), (F.col("i") <= F.col("j")).alias("left"))

        def compared(batches: Iterator[pa.RecordBatch], dim=dim, projections=projections, tables=tables) -> Iterator[pa.RecordBatch]:
            hasher = Hasher(dim, projections, tables)
            pending: list[pa.RecordBatch] = []

            def flush(upto: pa.Table) -> Iterator[pa.RecordBatch]:
                t, bucket, lo, hi = (upto.column(c).to_numpy() for c in ("t", "bucket", "lo", "hi"))
                new = np.flatnonzero((np.diff(t) != 0) | (np.diff(bucket) != 0) | (np.diff(lo) != 0) | (np.diff(hi) != 0)) + 1
                rep, left, copies = upto.column("rep").to_numpy(), upto.column("left").to_numpy(), upto.column("copies").to_numpy()
                x = scaled(_vectors(upto.column("v").combine_chunks(), dim))
                norm = np.linalg.norm(x, axis=1)
                h, hashed = np.zeros((len(x), tables), U64), np.zeros(len(x), bool)  # of rows with links only
                ids, links, us, vs = [], [], [], []
                for a, b in zip([0, *new.tolist()], [*new.tolist(), len(t)]):
                    inner = lo[a] == hi[a]
                    one = np.arange(a, b) if inner else a + np.flatnonzero(left[a:b])
                    two = one if inner else a + np.flatnonzero(~left[a:b])
                    if not len(one) or not len(two):
                        continue
                    hit = (x[one] @ x[two].T) / np.outer(norm[one], norm[two]) >= least
                    if inner:
                        np.fill_diagonal(hit, False)
                    p, q = np.nonzero(hit)
                    if not len(p):
                        continue
                    p, q = one[p], two[q]
                    bare = np.unique(np.concatenate([p, q]))
                    bare = bare[~hashed[bare]]
                    if len(bare):
                        h[bare], hashed[bare] = hasher.buckets(x[bare]), True
                    first = (h[p, : t[a]] != h[q, : t[a]]).all(axis=1)
                    p, q = p[first], q[first]
                    if not len(p):
                        continue
                    ids += [rep[p], rep[q]][: 1 if inner else 2]
                    links += [copies[q], copies[p]][: 1 if inner else 2]
                    root = {}

                    def find(z):
                        while root.get(z, z) != z:
                            z = root[z]
                        return z

                    for u, v in zip(rep[p].tolist(), rep[q].tolist()):
                        u, v = find(u), find(v)
                        if u != v:
                            root[max(u, v)] = min(u, v)
                            us.append(max(u, v))
                            vs.append(min(u, v))
                if ids:
                    every, inverse = np.unique(np.concatenate(ids), return_inverse=True)
                    total = np.bincount(inverse, np.concatenate(links)).astype(np.int64)
                    yield pa.record_batch([pa.array(every), pa.array(total), pa.array([None] * len(every), pa.int64())], names=["u", "links", "v"])
                if us:
                    yield pa.record_batch([pa.array(us, pa.int64()), pa.array([0] * len(us), pa.int64()), pa.array(vs, pa.int64())], names=["u", "links", "v"])

            for batch in batches:
                if not batch.num_rows:
                    continue
                table = pa.Table.from_batches([*pending, batch])
                keys = [table.column(c).to_numpy() for c in ("t", "bucket", "lo", "hi")]
                changed = np.zeros(table.num_rows - 1, bool)
                for k in keys:
                    changed |= np.diff(k) != 0
                last = int(np.flatnonzero(changed)[-1]) + 1 if changed.any() else 0
                if last:
                    yield from flush(table.slice(0, last))
                pending = table.slice(last).to_batches()
            if pending:
                yield from flush(pa.Table.from_batches(pending))

        full_rows = dealt.join(own.select("rep", "v", "copies"), "rep").select("rep", "t", "bucket", "lo", "hi", "left", "v", "copies")
        found = store.keep(full_rows.repartition(parts, "t", "bucket", "lo", "hi").sortWithinPartitions("t", "bucket", "lo", "hi").mapInArrow(compared, "u long, links long, v long"), f"found{dim}")
        store.drop(placed)
        counts.append(found.where("v IS NULL").groupBy(F.col("u").alias("rep")).agg(F.sum("links").alias("links")))
        edges.append(found.where("v IS NOT NULL").select("u", "v"))
        n_edges += edges[-1].count()
    if not counts:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    links, every = counts[0], edges[0]
    for c, e in zip(counts[1:], edges[1:]):
        links, every = links.union(c), every.union(e)
    comp = connected_components(every, store, n_edges)
    known = classes.join(links, "rep", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    known = store.keep(known.select("v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "known")
    store.keep_only(rows, known)
    joined = rows.join(known, "v", "left").select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("n_links")).alias("n_links"), F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id")).alias("component_id"))
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
