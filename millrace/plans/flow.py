"""A fluent way to write plans."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession

from .compiler import Plan, compile_plan

_numbers = itertools.count()


class Flow:
    """A plan under construction: each call puts a node on top."""

    def __init__(self, definitions: dict, tree: dict):
        self.definitions, self.tree = definitions, tree

    @classmethod
    def source(cls, type: str, **settings) -> Flow:
        name = f"n{next(_numbers)}"
        return cls({name: {"type": type, **settings}}, {"name": name})

    def op(self, type: str, **settings) -> Flow:
        name = f"n{next(_numbers)}"
        return Flow({**self.definitions, name: {"type": type, **settings}}, {"name": name, "input": self.tree})

    def join(self, build: Flow, build_key: int, probe_key: int, projection: list[str], type: str = "hashjoin", **settings) -> Flow:
        name = f"n{next(_numbers)}"
        node = {"type": type, "buildjattr": build_key, "probejattr": probe_key, "projection": projection, "threadgroups": [[0]], **settings}
        return Flow({**self.definitions, **build.definitions, name: node}, {"name": name, "build": build.tree, "probe": self.tree})

    def filter(self, column: int, op: str, value) -> Flow:
        return self.op("filter", field=column, op=op, value=str(value))

    def project(self, *columns: int) -> Flow:
        return self.op("projection", projection=[f"${c}" for c in columns])

    def sum(self, keys: list[int], column: int, **settings) -> Flow:
        return self.op("aggregate_sum", fields=keys, sumfield=column, **settings)

    def count(self, keys: list[int], **settings) -> Flow:
        return self.op("aggregate_count", fields=keys, **settings)

    def sort(self, by: list[int], ascending: bool, limit: int) -> Flow:
        return self.op("sort", by=[f"${c}" for c in by], asc=[int(ascending)], limit=[limit])

    def merge(self, threads: int = 1) -> Flow:
        return self.op("merge", threads=threads)

    def spec(self, **settings) -> dict:
        return {**settings, **self.definitions, "treeroot": self.tree}

    def compile(self, spark: SparkSession, user_ops: dict | None = None, tables: dict[str, DataFrame] | None = None, **settings) -> Plan:
        return compile_plan(self.spec(**settings), spark, user_ops, tables)
