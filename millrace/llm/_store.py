"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import file_system, shared_dir

_watching: list[list[Scratch]] = []


#: Rows for which a small table gets a file, however many partitions the session's shuffles have.
ROWS_A_FILE = 50_000


class Scratch:
    """Written tables that cut lineage and outlive executors.

    keep() writes a DataFrame as Parquet and reads it back; drop() removes such
    a table once nothing reads it any more, so that disk use follows the live
    tables only; keep_only() removes all but those behind a result, which stay
    in the shared folder.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/millrace-{uuid.uuid4().hex}", 0
        self.live: set[str] = set()
        for made in _watching:
            made.append(self)

    def keep(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        """`rows`, where known, says how many there are about: the table gets a file for every ROWS_A_FILE of them at most."""
        self.n += 1
        path = f"{self.root}/{self.n}-{name}"
        if rows is not None:
            df = df.coalesce(1 + rows // ROWS_A_FILE)
        # no marker file: a table that keep() has returned is whole
        df.write.option("compression", "zstd").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.live.add(path)
        out._millrace_path = path
        return out

    def _remove(self, paths: set[str]) -> None:
        for at in paths & self.live:
            path, fs = file_system(self.spark, at)
            fs.delete(path, True)
        self.live -= paths

    def drop(self, *tables: DataFrame) -> None:
        self._remove({df._millrace_path for df in tables})

    def keep_only(self, *tables: DataFrame) -> None:
        self._remove(self.live - {df._millrace_path for df in tables})


@contextmanager
def watched() -> Iterator[list[Scratch]]:
    """The Scratch folders that are made inside, by operators that return results from them."""
    made: list[Scratch] = []
    _watching.append(made)
    try:
        yield made
    finally:
        _watching.remove(made)


def reads(df: DataFrame, scratch: Scratch) -> bool:
    """Whether the plan of `df` reads a table of `scratch`."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    paths = (x.relation().location().rootPaths().mkString(" ") for x in map(leaves.apply, range(leaves.size())) if x.nodeName().startswith("LogicalRelation"))
    return any(scratch.root.rsplit("/", 1)[1] in p for p in paths)


def inline_rows(spark: SparkSession, rows: list[dict], ddl: str) -> DataFrame:
    """A small literal table, made by the JVM."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{ddl}>>")))


#: Tables of at most so many rows are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 10_000


def small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df
