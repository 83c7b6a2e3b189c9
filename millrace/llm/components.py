"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import Scratch


def _canonical(edges: DataFrame) -> DataFrame:
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, store: Scratch, rows: int | None = None) -> DataFrame:
    """(node, component) for each node of `edges` (u, v; about `rows` of them), with the least node id of its component.

    Every round links all larger neighbours of a node to its least neighbour and
    then all smaller ones, which keeps the components and ends in stars around
    the least nodes after a number of rounds that grows with the logarithm of
    the nodes. Each half is an aggregate by node and a join on it; a node of high
    degree is on the join's side that Spark can split. Empty in, empty out.
    """
    now = store.keep(_canonical(edges.select("u", "v")), "edges", rows)
    state = _state(now)
    while state[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = store.keep(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large", state[0])
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        after = store.keep(_canonical(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))), "small", state[0])
        store.drop(now, large)
        now, before = after, state
        state = _state(now)
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
