"""Compiles operator-tree plans (a dict, or a plan file's text) to lazy DataFrames."""

from __future__ import annotations

import re
import sys
import time
import uuid
import warnings
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidParameter, MissingParameter, NotYetImplemented
from ..functions.user import UserOp
from ..operators import relational as R
from ..operators.relational import Rel
from ..sources import scans
from ..types import parse_type
from .config import parse

PASS_THROUGH = {"cycle_accountant", "checker_callstate", "printer_schema", "printer_tuplecount", "printer_perfcount", "printer_callcount"}
JOINS = {"hashjoin": None, "indexhashjoin": None, "sortmergejoin": "merge", "mpsmjoin": "merge", "newmpsmjoin": "merge", "preprejoin": "merge"}
IGNORED = {"affinitize", "numanodes"}


def _need(node: dict, key: str):
    if key not in node:
        raise MissingParameter(f"{node.get('type', 'node')}.{key}")
    return node[key]


def _position(text, sides: str = "") -> int | tuple[str, int]:
    """`$i`, or with sides `B$i` or `P$i`."""
    m = re.fullmatch(rf"([{sides}])\$(\d+)" if sides else r"\$?(\d+)", str(text).strip())
    if not m:
        raise InvalidParameter(f"column reference {text!r}")
    return (m[1], int(m[2])) if sides else int(m[1])


def _one(value):
    return value[0] if isinstance(value, list) else value


def _groups(node: dict) -> list[list[int]]:
    """threadgroups: lists of threads, each thread in one of them at most."""
    groups = _need(node, "threadgroups")
    if not isinstance(groups, list) or not groups or not all(isinstance(g, list) and g for g in groups):
        raise InvalidParameter(f"threadgroups is a list of lists of threads, not {groups!r}")
    threads = [int(t) for g in groups for t in g]
    if len(threads) != len(set(threads)):
        raise InvalidParameter("a thread may be in one group only")
    return [[int(t) for t in g] for g in groups]


@dataclass
class Node:
    """A node of a compiled plan, with what it gives."""

    depth: int
    name: str
    kind: str
    rel: Rel


@dataclass
class Measure:
    """What running a plan up to a node took, and of that the node and those below it down to the next measured ones; and Spark's task counters."""

    name: str
    rows: int
    seconds: float
    own_seconds: float
    cpu_seconds: float = 0.0
    read_bytes: int = 0
    shuffled_bytes: int = 0
    spilled_bytes: int = 0
    most_memory: int = 0

    def __str__(self) -> str:
        counters = f"{self.cpu_seconds:.3f} s of CPU, {self.read_bytes} bytes read, {self.shuffled_bytes} shuffled, {self.spilled_bytes} spilled, {self.most_memory} in memory"
        return f"{self.rows} rows, {self.seconds:.3f} s, {self.own_seconds:.3f} s of its own, {counters}"


def _counters(spark: SparkSession, group: str) -> dict:
    """Task counters of the stages that ran for a job group; memory is the most that a stage's tasks held at once by Spark's account."""
    context, tracker = spark.sparkContext._jsc.sc(), spark.sparkContext.statusTracker()
    context.listenerBus().waitUntilEmpty(10_000)
    stages = {i for job in tracker.getJobIdsForGroup(group) if (info := tracker.getJobInfo(job)) for i in info.stageIds}
    ran = [context.statusStore().lastStageAttempt(i) for i in sorted(stages)]
    ran = [x for x in ran if x.status().toString() == "COMPLETE"]
    return {
        "cpu_seconds": sum(x.executorCpuTime() for x in ran) / 1e9,
        "read_bytes": sum(x.inputBytes() for x in ran),
        "shuffled_bytes": sum(x.shuffleWriteBytes() for x in ran),
        "spilled_bytes": sum(x.diskBytesSpilled() for x in ran),
        "most_memory": max((x.peakExecutionMemory() for x in ran), default=0),
    }


@dataclass
class Plan:
    """The compiled plan: its DataFrame, and row counts of printer_tuplecount nodes after it has run.

    `df` is lazy. A plan with writers writes when run() is called, not before.
    """

    df: DataFrame
    rel: Rel
    observations: dict[str, Observation] = field(default_factory=dict)
    nodes: list[Node] = field(default_factory=list)
    writers: list[Callable[[], None]] = field(default_factory=list)

    def explain(self, mode: str = "formatted") -> None:
        self.df.explain(mode)

    def run(self) -> DataFrame:
        """Writes what the plan's writers write, once a call, and gives the plan's rows."""
        for write in self.writers:
            write()
        return self.df

    def tree(self, measured: list[Measure] | None = None) -> str:
        """The operator tree with each node's type and columns, and what profile() measured."""
        known = {m.name: f"  {m}" for m in measured or []}
        kinds = lambda n: ", ".join(f.kind for f in n.rel.fields)
        return "\n".join(f"{'  ' * n.depth}{n.name} ({n.kind}): {kinds(n)}{known.get(n.name, '')}" for n in self.nodes)

    def profile(self) -> list[Measure]:
        """Runs the plan up to each cycle_accountant or printer_perfcount (up to every node, if it has none) and takes rows, time and task counters.

        Operators of a stage run fused, so a node has no time of its own to be read off a single run; each
        measured node is run by itself, and what the measured ones below it took is subtracted.
        """
        chosen = [n for n in self.nodes if n.kind in ("cycle_accountant", "printer_perfcount")] or self.nodes
        spark = self.df.sparkSession
        out: list[Measure] = []
        took: list[tuple[Node, float]] = []
        for n in reversed(chosen):  # nodes below come later in the list
            seen, group = Observation(), f"millrace-{uuid.uuid4().hex}"
            spark.sparkContext.setJobGroup(group, f"profile of {n.name}")
            began = time.perf_counter()
            n.rel.rows().observe(seen, F.count(F.lit(1)).alias("rows")).write.format("noop").mode("overwrite").save()
            seconds, below = time.perf_counter() - began, 0.0
            spark.sparkContext.setJobGroup(None, None)
            while took and took[-1][0].depth > n.depth:
                below += took.pop()[1]
            took.append((n, seconds))
            out.append(Measure(n.name, seen.get["rows"], seconds, max(0.0, seconds - below), **_counters(spark, group)))
        return out[::-1]


class Compiler:
    def __init__(self, spec: dict, spark: SparkSession, user_ops: dict[str, UserOp] | None = None, tables: dict[str, DataFrame] | None = None):
        self.spec, self.spark = spec, spark
        self.user, self.tables = user_ops or {}, tables or {}
        self.path = spec.get("path", "")
        self.observations: dict[str, Observation] = {}
        self.nodes: list[Node] = []
        self.writers: list[Callable[[], None]] = []
        self.depth = -1

    def compile(self) -> Plan:
        rel = self.tree(_need(self.spec, "treeroot"), 1, None)
        return Plan(rel.rows(), rel, self.observations, self.nodes, self.writers)

    # the tree

    def node(self, branch: dict) -> dict:
        if not isinstance(branch, dict) or "name" not in branch:
            raise MissingParameter("a tree node has no name")
        name = branch["name"]
        if name not in self.spec:
            raise MissingParameter(f"no definition of {name}")
        if "type" not in self.spec[name]:
            raise MissingParameter(f"{name}.type")
        for key in IGNORED & set(self.spec[name]):
            warnings.warn(f"{name}.{key} is read and has no effect here", stacklevel=2)
        return self.spec[name]

    def child(self, branch: dict, key: str, threads: int, keys: DataFrame | None) -> Rel:
        if key not in branch:
            raise MissingParameter(f"{branch.get('name')}.{key}")
        return self.tree(branch[key], threads, keys)

    def tree(self, branch: dict, threads: int, keys: DataFrame | None) -> Rel:
        node, at = self.node(branch), len(self.nodes)
        self.depth += 1
        rel = self.compiled(branch, node, node["type"], threads, keys)
        self.nodes.insert(at, Node(self.depth, branch["name"], node["type"], rel))
        self.depth -= 1
        return rel

    def compiled(self, branch: dict, node: dict, kind: str, threads: int, keys: DataFrame | None) -> Rel:
        if kind in JOINS:
            return self.join(branch, node, threads, keys)
        source = getattr(self, f"scan_{kind}", None)
        if source:
            return source(node, threads, keys)
        if kind == "merge":
            return R.merge(self.child(branch, "input", int(_need(node, "threads")), keys))
        if kind in ("aggregate_sum", "aggregate_count"):
            return self.aggregate(branch, node, threads, keys)
        if kind == "sortandrangepartition":
            raise NotYetImplemented(kind)
        op = getattr(self, f"op_{kind}", None)
        if op is None and kind not in PASS_THROUGH and kind not in self.user:
            raise InvalidParameter(f"unknown type {kind!r}")
        rel = self.child(branch, "input", threads, keys)
        if op:
            return op(node, rel)
        if kind in self.user:
            out = self.user[kind](rel.rows(), node)
            return R.of(out)
        return self.instrument(branch["name"], kind, rel)

    def instrument(self, name: str, kind: str, rel: Rel) -> Rel:
        if kind == "printer_schema":
            print(rel.rows().schema.simpleString(), file=sys.stderr)
        elif kind in ("printer_tuplecount", "printer_callcount"):
            key = name
            while key in self.observations:
                key += "'"
            self.observations[key] = seen = Observation(key)
            return Rel(rel.df.observe(seen, F.count(F.lit(1)).alias("rows")), rel.fields, rel.threaded)
        return rel

    # sources

    def fields(self, node: dict):
        return [parse_type(t) for t in _need(node, "schema")]

    def file(self, node: dict, name: str) -> Rel:
        kind = node.get("filetype", "binary")
        if name in self.tables:
            df = self.tables[name]
            return R.of(df.select(*node["columns"]) if "columns" in node else df)
        path = self.path + name
        if kind == "parquet":
            return R.of(scans.parquet(self.spark, path, node.get("columns")))
        fields = self.fields(node)
        if kind == "text":
            return Rel(scans.text(self.spark, path, fields, node.get("separators", scans.SEPARATORS), bool(node.get("lenient", False))), tuple(fields))
        if kind == "binary":
            return Rel(scans.binary(self.spark, path, fields), tuple(fields))
        raise InvalidParameter(f"filetype {kind!r}")

    def scan_scan(self, node: dict, threads: int, keys) -> Rel:
        return self.file(node, _need(node, "file"))

    def files(self, node: dict, readers: list[int]) -> Rel:
        rels = [self.file(node, f) for f in node["files"]]
        if len(rels) == 1:
            return rels[0]
        df = None
        for rel, t in zip(rels, readers):
            one = rel.df.select(F.lit(t).alias("_tid"), *rel.names)
            df = one if df is None else df.union(one)
        return Rel(df, rels[0].fields, True)

    def scan_partitionedscan(self, node: dict, threads: int, keys) -> Rel:
        if not _need(node, "files"):
            raise InvalidParameter("partitionedscan.files is empty")
        return self.files(node, list(range(len(node["files"]))))

    def scan_parallelscan(self, node: dict, threads: int, keys) -> Rel:
        mapping = _need(node, "mapping")
        if len(mapping) != len(_need(node, "files")):
            raise InvalidParameter("parallelscan.mapping has not one list for each file")
        return self.files(node, [int(min(t)) for t in mapping])

    def scan_generator_int(self, node: dict, threads: int, keys) -> Rel:
        width = int(_need(node, "width"))
        df = scans.generated(self.spark, int(_need(node, "sizeinmb")), width, threads)
        return Rel(df, (parse_type("int"), parse_type(f"char({max(0, width - 5)})")), threads > 1)

    def columns(self, node: dict) -> tuple[DataFrame, list[str]]:
        pick = _need(node, "pick")
        if not pick:
            raise InvalidParameter("pick is empty")
        name = node.get("file") or _need(node, "indexdirectory")
        df = self.tables[name] if name in self.tables else scans.table(self.spark, self.path + name)
        return df, [str(p).strip("/").rpartition("/")[2] for p in pick]

    def scan_hdf5scan(self, node: dict, threads: int, keys) -> Rel:
        df, pick = self.columns(node)
        parts, part = int(node.get("totalpartitions", 1)), int(node.get("thispartition", 0))
        if parts > 1:
            df = scans.row_range(df, node.get("order") or df.columns, part, parts)
        return R.of(df.select(*pick))

    def indexed(self, node: dict, df: DataFrame, keys: DataFrame) -> DataFrame:
        column = str(_need(node, "indexdataset")).strip("/").rpartition("/")[2]
        return df.join(keys.toDF("_key"), F.col(column) == F.col("_key"), "left_semi")

    def scan_hdf5index(self, node: dict, threads: int, keys) -> Rel:
        if keys is None:
            raise InvalidParameter("hdf5index stands only under indexhashjoin's probe")
        if int(node.get("totalpartitions", 1)) != 1:
            raise InvalidParameter("hdf5index can't be partitioned")
        df, pick = self.columns(node)
        return R.of(self.indexed(node, df, keys).select(*pick))

    def scan_hdf5random(self, node: dict, threads: int, keys) -> Rel:
        if int(node.get("totalpartitions", 1)) != 1:
            raise InvalidParameter("hdf5random can't be partitioned")
        df, pick = self.columns(node)
        rows = scans.with_row_id(df, node.get("order") or df.columns)
        n = rows.count()
        draws = self.spark.range(int(_need(node, "randomlookups")) if n else 0).select(F.floor(F.rand() * n).cast("long").alias("_row"))
        return R.of(rows.join(draws, "_row").select(*pick))

    def scan_fastbitscan(self, node: dict, threads: int, keys) -> Rel:
        df, pick = self.columns(node)
        fields = self.fields(node) if "schema" in node else None
        if fields and len(fields) != len(pick):
            raise InvalidParameter("fastbitscan.schema and pick differ in length")
        if node.get("condition"):
            df = df.where(F.expr(node["condition"]))
        if keys is not None and "indexdataset" in node:
            df = self.indexed(node, df, keys)
        cols = df.select(*pick) if not fields else df.select(*[F.col(p).cast(f.spark) for p, f in zip(pick, fields)])
        return R.of(cols)

    # operators

    def join(self, branch: dict, node: dict, threads: int, keys) -> Rel:
        build_key, probe_key = int(_need(node, "buildjattr")), int(_need(node, "probejattr"))
        projection = [_position(p, "BP") for p in _need(node, "projection")]
        groups = _groups(node)
        if node["type"] == "preprejoin":  # it joins what each thread of the groups reads, on its own
            groups = [[t] for g in groups for t in g]
        build = self.child(branch, "build", threads, None)
        pushed = build.df.select(build.column(build_key)).distinct() if node["type"] == "indexhashjoin" else None
        probe = self.child(branch, "probe", threads, pushed)
        hint = node.get("strategy", JOINS[node["type"]])
        return R.join(build, probe, build_key, probe_key, projection, groups, hint)

    def keys(self, node: dict) -> list[int]:
        if "fields" in node:
            return [_position(f) for f in node["fields"]]
        return [_position(f) for f in (node["field"] if isinstance(_need(node, "field"), list) else [node["field"]])]

    def aggregate(self, branch: dict, node: dict, threads: int, keys, partial: bool = True) -> Rel:
        if node.get("presorted"):
            raise NotYetImplemented("presorted aggregation")
        by = self.keys(node)
        value = _position(_need(node, "sumfield")) if node["type"] == "aggregate_sum" else None
        inner = branch.get("input")
        if inner is None:
            raise MissingParameter(f"{branch['name']}.input")
        # a sum of thread-local sums or counts by the same keys is one aggregate, which Spark splits itself
        below = inner
        while value is not None and below and self.node(below)["type"] in PASS_THROUGH - {"printer_tuplecount", "printer_callcount"} | {"merge"}:
            threads = int(self.node(below).get("threads", threads))
            below = below.get("input")
        if value is not None and below and self.node(below)["type"].startswith("aggregate_"):
            part = self.node(below)
            if by == list(range(len(by))) and value == len(by) == len(self.keys(part)):
                return self.aggregate(below, part, threads, keys, partial=False)
            below = None
        rel = self.tree(inner, threads, keys)
        return R.aggregate(rel, by, value, partial=partial and not node.get("global"))

    def op_filter(self, node: dict, rel: Rel) -> Rel:
        return R.where(rel, _position(_need(node, "field")), _need(node, "op"), str(_need(node, "value")))

    def op_projection(self, node: dict, rel: Rel) -> Rel:
        return R.project(rel, [_position(p) for p in _need(node, "projection")])

    def op_sort(self, node: dict, rel: Rel) -> Rel:
        return R.sort_limit(rel, [_position(b) for b in _need(node, "by")], bool(_one(_need(node, "asc"))), int(_one(_need(node, "limit"))))

    def op_partition(self, node: dict, rel: Rel) -> Rel:
        low, high = (int(x) for x in _need(node, "range"))
        attr = _position(_need(node, "attr"))
        sort = str(_need(node, "sort")).lower() in ("yes", "true", "1")
        return R.partition(rel, attr, low, high, int(_need(node, "buckets")), _position(node.get("sortattr", attr)) if sort else None, bool(node.get("clamp", False)))

    def op_shuffle(self, node: dict, rel: Rel) -> Rel:
        return R.shuffle(rel, _need(node, "hash"), len(_need(node, "destIPs")))

    def op_threadidprepend(self, node: dict, rel: Rel) -> Rel:
        return R.prepend_thread(rel)

    def op_printer_bitentropy(self, node: dict, rel: Rel) -> Rel:
        return R.bit_entropy(rel, _position(_need(node, "field")))

    def op_consumer(self, node: dict, rel: Rel) -> Rel:
        return R.consume(rel)

    def op_shmwriter(self, node: dict, rel: Rel) -> Rel:
        paths = _need(node, "paths")
        paths = [str(p) for p in paths] if isinstance(paths, list) else [str(paths)]
        size, policy, nodes = int(_one(_need(node, "size"))), node.get("policy"), len(node.get("numanodes", ()))
        R.check_policy(policy, len(paths), nodes)
        self.writers.append(lambda: R.write_segments(rel, paths, size))
        return Rel(self.spark.createDataFrame([], rel.rows().schema), rel.fields)


def compile_plan(spec: dict | str, spark: SparkSession, user_ops: dict[str, UserOp] | None = None, tables: dict[str, DataFrame] | None = None) -> Plan:
    """The plan of `spec` (a dict, or a plan file's text) as a DataFrame of columns c0, c1, ...

    `user_ops` are found by a node's type; `tables` stand for files of these names.
    """
    return Compiler(parse(spec) if isinstance(spec, str) else spec, spark, user_ops, tables).compile()
