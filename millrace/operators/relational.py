"""Operators of plans as functions on Rel: positional columns c0, c1, ... and, where it matters, the reading thread."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidParameter
from ..functions.hashing import hash_column
from ..functions.packed import pack, xor_words
from ..scratch import file_system
from ..types import Field, compare, field_of, literal


@dataclass(frozen=True)
class Rel:
    """threaded: rows carry _tid, the thread that reads them, as joins and partial aggregates go by it."""

    df: DataFrame
    fields: tuple[Field, ...]
    threaded: bool = False

    @property
    def names(self) -> list[str]:
        return [f"c{i}" for i in range(len(self.fields))]

    @property
    def tid(self) -> list[str]:
        return ["_tid"] if self.threaded else []

    def column(self, i: int) -> Column:
        if not 0 <= i < len(self.fields):
            raise InvalidParameter(f"column {i} of {len(self.fields)}")
        return F.col(f"c{i}")

    def rows(self) -> DataFrame:
        return self.df.select(*self.names)


def of(df: DataFrame) -> Rel:
    """Any DataFrame, its columns taken by position."""
    fields = tuple(field_of(f.dataType) for f in df.schema.fields)
    return Rel(df.toDF(*[f"c{i}" for i in range(len(fields))]), fields)


def project(rel: Rel, columns: list[int]) -> Rel:
    cols = [rel.column(c).alias(f"c{i}") for i, c in enumerate(columns)]
    return replace(rel, df=rel.df.select(*rel.tid, *cols), fields=tuple(rel.fields[c] for c in columns))


def where(rel: Rel, column: int, op: str, value: str) -> Rel:
    col, field = rel.column(column), rel.fields[column]
    return replace(rel, df=rel.df.where(compare(col, op, literal(value, field), field, field)))


def merge(rel: Rel) -> Rel:
    """The threads' rows as one bag."""
    return Rel(rel.rows(), rel.fields)


def prepend_thread(rel: Rel) -> Rel:
    tid = F.col("_tid").cast("int") if rel.threaded else F.spark_partition_id()
    cols = [tid.alias("c0"), *[F.col(c).alias(f"c{i + 1}") for i, c in enumerate(rel.names)]]
    return replace(rel, df=rel.df.select(*rel.tid, *cols), fields=(Field("int", 4), *rel.fields))


def group_of(groups: list[list[int]]) -> Column:
    """The number of the thread group that a thread belongs to; null if none."""
    out = None
    for i, threads in enumerate(groups):
        hit = F.col("_tid").isin([int(t) for t in threads])
        out = F.when(hit, F.lit(i)) if out is None else out.when(hit, F.lit(i))
    return out


def join(build: Rel, probe: Rel, build_key: int, probe_key: int, projection: list[tuple[str, int]], groups: list[list[int]] | None = None, hint: str | None = None) -> Rel:
    """Inner equi-join within thread groups. `hint` names Spark's strategy; without one Catalyst goes by sizes."""
    b, p = build.fields[build_key] if build_key < len(build.fields) else None, probe.fields[probe_key] if probe_key < len(probe.fields) else None
    if b is None or p is None:
        raise InvalidParameter("join key out of range")
    compare(F.lit(0), "=", F.lit(0), b, p)
    several = groups is not None and len(groups) > 1

    def side(rel: Rel, mark: str) -> DataFrame:
        df = rel.df if rel.threaded else rel.df.withColumn("_tid", F.lit(0))
        extra = [group_of(groups).alias(f"{mark}_g")] if several else []
        keep = [F.col("_tid").alias(f"{mark}_tid")] if rel.threaded or several else []
        return df.select(*extra, *keep, *[F.col(c).alias(f"{mark}_{c}") for c in rel.names])

    left, right = side(build, "b"), side(probe, "p")
    if hint:
        left = left.hint(hint)
    on = F.col(f"b_c{build_key}") == F.col(f"p_c{probe_key}")
    if several:
        on = (F.col("b_g") == F.col("p_g")) & on
    cols, fields = [], []
    for i, (which, c) in enumerate(projection):
        source, mark = (build, "b") if which == "B" else (probe, "p")
        source.column(c)
        cols.append(F.col(f"{mark}_c{c}").alias(f"c{i}"))
        fields.append(source.fields[c])
    threaded = probe.threaded or several
    return Rel(right.join(left, on, "inner").select(*([F.col("p_tid").alias("_tid")] if threaded else []), *cols), tuple(fields), threaded)


def aggregate(rel: Rel, keys: list[int], value: int | None, partial: bool = False) -> Rel:
    """SUM of a column, or COUNT of rows, by keys; `partial` by thread as well.

    No keys and no rows give no row. Sums of ints and longs are longs.
    """
    by = [rel.column(k).alias(f"k{i}") for i, k in enumerate(keys)]
    if value is None:
        total, kind = F.count(F.lit(1)), Field("long", 8)
    else:
        if rel.fields[value].kind not in ("int", "long", "dec"):
            raise InvalidParameter("only numbers have a sum")
        total, kind = F.sum(rel.column(value)), Field("dec", 8) if rel.fields[value].kind == "dec" else Field("long", 8)
    tid = rel.tid if partial else []
    grouped = rel.df.groupBy(*tid, *(by or [F.lit(1).alias("k0")])).agg(total.alias("total"))
    cols = [*[F.col(f"k{i}").alias(f"c{i}") for i in range(len(keys))], F.col("total").alias(f"c{len(keys)}")]
    return Rel(grouped.select(*tid, *cols), (*[rel.fields[k] for k in keys], kind), bool(tid))


def sort_limit(rel: Rel, by: list[int], ascending: bool, limit: int) -> Rel:
    cols = [rel.column(c).asc() if ascending else rel.column(c).desc() for c in by]
    return Rel(rel.df.orderBy(*cols).limit(limit).select(*rel.names), rel.fields)


def partition(rel: Rel, attr: int, low: int, high: int, buckets: int, sort: int | None = None, clamp: bool = False) -> Rel:
    """Equal-width ranges of `attr`, one partition and thread each, sorted within on request."""
    v = rel.column(attr).cast("long")
    if clamp:
        v = F.greatest(F.lit(low), F.least(F.lit(high), v))
    else:
        v = F.when(v.between(low, high), v).otherwise(F.raise_error(F.concat(F.lit(f"partition: outside {low}..{high}: "), v.cast("string"))).cast("long"))
    bucket = hash_column({"fn": "exactrange", "range": [low, high], "buckets": buckets}, v)
    df = rel.df.select(bucket.cast("int").alias("_tid"), *rel.names).repartitionById(buckets, F.col("_tid"))
    return Rel(df if sort is None else df.sortWithinPartitions(f"c{sort}"), rel.fields, True)


def shuffle(rel: Rel, spec: dict, hosts: int) -> Rel:
    """Rows to `hosts` partitions by a hash function."""
    bucket = F.pmod(hash_column(spec, rel.column(int(spec.get("field", 0)))), F.lit(hosts))
    df = rel.df.select(bucket.cast("int").alias("_tid"), *rel.names).repartitionById(hosts, F.col("_tid"))
    return Rel(df, rel.fields, True)


def bit_entropy(rel: Rel, column: int) -> Rel:
    """For each thread and bit of a long column: thread, bit, zeros, ones; one pass, 64 sums."""
    if rel.fields[column].width != 8:
        raise InvalidParameter("printer_bitentropy needs an 8-byte column")
    v = rel.column(column).cast("long")
    tid = F.col("_tid") if rel.threaded else F.lit(0)
    sums = rel.df.groupBy(tid.cast("int").alias("c0")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.shiftrightunsigned(v, b).bitwiseAND(F.lit(1).cast("long"))).alias(f"b{b}") for b in range(64)])
    ones = F.array(*[F.col(f"b{b}") for b in range(64)])
    long = sums.select("c0", "n", F.posexplode(ones).alias("c1", "one"))
    return Rel(long.select("c0", "c1", (F.col("n") - F.col("one")).alias("c2"), F.col("one").alias("c3")), (Field("int", 4), Field("int", 4), Field("long", 8), Field("long", 8)))


def consume(rel: Rel) -> Rel:
    """XOR of the 4-byte words of all packed rows, one int a thread (0 where there are no rows).

    Ints and longs alone stay within Spark's own functions; other types are packed by Arrow batches.
    """
    tid = F.col("_tid").cast("int") if rel.threaded else F.lit(0)
    if all(f.kind in ("int", "long") for f in rel.fields):
        word = F.lit(0).cast("long")
        for i, f in enumerate(rel.fields):
            v = F.col(f"c{i}").cast("long")
            word = word.bitwiseXOR(v if f.kind == "int" else v.bitwiseXOR(F.shiftrightunsigned(v, 32)))
        low = word.bitwiseAND(F.lit(0xFFFFFFFF))
        words = rel.df.select(tid.alias("t"), (low - F.when(low.bitwiseAND(F.lit(0x80000000)) != 0, F.lit(1 << 32)).otherwise(F.lit(0))).cast("int").alias("w"))
    else:
        fields = list(rel.fields)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                t = batch.column(0).to_pylist()
                rows = pa.RecordBatch.from_arrays(batch.columns[1:], names=batch.schema.names[1:])
                for one in sorted(set(t)):
                    part = rows.filter(pa.array([x == one for x in t]))
                    yield pa.record_batch([pa.array([one], pa.int32()), pa.array([xor_words(pack(part, fields))], pa.int32())], names=["t", "w"])

        words = rel.df.select(tid.alias("t"), *rel.names).mapInArrow(run, "t int, w int")
    if rel.threaded:
        out = words.groupBy("t").agg(F.bit_xor("w").alias("c0")).select("c0")
    else:
        out = words.agg(F.coalesce(F.bit_xor("w"), F.lit(0)).alias("c0"))
    return Rel(out, (Field("int", 4),))


def group_sizes(rel: Rel, keys: list[int]) -> Rel:
    """How many groups of `keys` have each number of rows: rows, groups."""
    sizes = rel.df.groupBy(*[rel.column(k) for k in keys]).agg(F.count(F.lit(1)).alias("n"))
    return Rel(sizes.groupBy(F.col("n").alias("c0")).agg(F.count(F.lit(1)).alias("c1")), (Field("long", 8), Field("long", 8)))


def check_policy(policy: str | None, paths: int, nodes: int) -> None:
    """Rows go round over several paths under round-robin only; placement by memory nodes has no meaning here, but its numbers must fit."""
    allowed = {None: paths == 1 or not nodes, "round-robin": nodes in (0, paths), "bind": paths == 1 and nodes <= 1, "interleave": paths == 1}
    if paths < 1 or not allowed.get(policy, False):
        raise InvalidParameter(f"policy {policy!r} with {paths} paths and {nodes} nodes")


def write_segments(rel: Rel, paths: list[str], size: int) -> None:
    """Appends the rows as Parquet files of at most `size` bytes of packed rows each (one row at least), in turn to the paths.

    The plan runs once: rows are written by path number to a folder beside the first path, and its files
    are then moved.
    """
    width = sum(f.width for f in rel.fields)
    writer = rel.rows().withColumn("_path", F.pmod(F.monotonically_increasing_id(), F.lit(len(paths))))
    session = rel.df.sparkSession
    staging = f"{paths[0].rstrip('/')}-{uuid.uuid4().hex}"
    writer.write.option("maxRecordsPerFile", max(1, size // width)).partitionBy("_path").parquet(staging)
    made, fs = file_system(session, staging)
    for i, path in enumerate(paths):
        to, _ = file_system(session, path)
        fs.mkdirs(to)
        part, _ = file_system(session, f"{staging}/_path={i}")
        for status in fs.listStatus(part) if fs.exists(part) else []:
            if not fs.rename(status.getPath(), session._jvm.org.apache.hadoop.fs.Path(to, status.getPath().getName())):
                raise OSError(f"{status.getPath()} can't be moved to {path}")
    fs.delete(made, True)
