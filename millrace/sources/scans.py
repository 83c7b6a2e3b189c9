"""Sources of plans: delimited text, packed binary rows, Parquet, generated rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import IllegalSchema, InvalidParameter
from ..functions.packed import dtype, unpack
from ..scratch import file_system
from ..types import Field, from_text

SEPARATORS = ",|\t"


def text(spark: SparkSession, path: str, fields: list[Field], separators: str = SEPARATORS, lenient: bool = False) -> DataFrame:
    """Lines of `path` (plain or compressed), split at any separator; empty fields vanish."""
    marks = "".join("\\" + c if c in "\\]^-[&~" else c for c in separators)
    parts = F.filter(F.split("value", f"[{marks}]"), lambda x: x != "")
    lines = spark.read.text(path).select(parts.alias("f")).where(F.size("f") > 0)
    n = len(fields)
    good = F.when(F.size("f") == n, F.col("f")).otherwise(F.raise_error(F.concat(F.lit(f"a line of {path} has not {n} fields but "), F.size("f").cast("string"))))
    return lines.select(good.alias("f")).select(*[from_text(F.element_at("f", i + 1), f, lenient).alias(f"c{i}") for i, f in enumerate(fields)])


def binary(spark: SparkSession, path: str, fields: list[Field]) -> DataFrame:
    """Packed rows of all files that match `path`; a file is split at row boundaries, read by the JVM and unpacked in Arrow batches."""
    schema = T.StructType([T.StructField(f"c{i}", f.spark) for i, f in enumerate(fields)])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.record_batch(unpack(batch.column(0), fields), names=schema.names)

    context = spark.sparkContext._jsc.sc()
    records = context.binaryRecords(path, dtype(fields).itemsize, context.hadoopConfiguration())
    raw = DataFrame(spark._jsparkSession.createDataset(records, spark._jvm.org.apache.spark.sql.Encoders.BINARY()).toDF(), spark)
    return raw.mapInArrow(rows, schema)


_schemas: dict[tuple, T.StructType] = {}


def table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table as spark.read has it. Its schema is read from a footer once for each state of the file or folder, as that takes a job."""
    at, fs = file_system(spark, path)
    if not fs.exists(at):  # a pattern, or an error to be told by Spark
        return spark.read.parquet(path)
    key = (spark.sparkContext.applicationId, path, fs.getFileStatus(at).getModificationTime())
    if key not in _schemas:
        _schemas[key] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[key]).parquet(path)


def parquet(spark: SparkSession, path: str, columns: list[str] | None) -> DataFrame:
    """The named columns of a Parquet table in that order, as c0, c1, ...; nothing else is read."""
    df = table(spark, path)
    names = columns or df.columns
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise IllegalSchema(f"{path} has no columns {missing}")
    return df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])


def generated(spark: SparkSession, megabytes: int, width: int, threads: int) -> DataFrame:
    """For each thread rows (1 .. N, filler) that fill the megabytes; the thread is _tid."""
    if width < 4:
        raise InvalidParameter("generator_int.width is at least 4")
    n = (megabytes << 20) // width
    rows = spark.range(1, n + 1).select(F.col("id").cast("int").alias("c0"), F.lit("x" * max(0, width - 5)).alias("c1"))
    if threads == 1:
        return rows
    return rows.withColumn("_tid", F.explode(F.sequence(F.lit(0), F.lit(threads - 1))))


def row_range(df: DataFrame, order: list[str], part: int, parts: int) -> DataFrame:
    """The part-th of `parts` contiguous row ranges in the order of a unique key; the last takes the rest.

    Ranks come from counts by range of the key, not from a window over one partition.
    """
    if not 0 <= part < parts:
        raise InvalidParameter(f"part {part} of {parts}")
    numbered = with_row_id(df, order)
    step = numbered.count() // parts
    low = F.col("_row") >= step * part
    return numbered.where(low if part == parts - 1 else low & (F.col("_row") < step * (part + 1))).drop("_row")


#: Rows that one range of with_row_id holds, ranges at most, and sampled keys for each.
RANGE_ROWS, MOST_RANGES, SAMPLES = 1_000_000, 512, 64


def with_row_id(df: DataFrame, order: list[str]) -> DataFrame:
    """Adds _row, the dense 0-based rank by `order`, a key of any columns that is unique: sampled ranges, each numbered on its own, and their offsets.

    Keys are sampled whole and by their hash, so that a column with few values or one frequent value still
    gives even ranges, and the same ones whenever the plan runs. Rows of equal keys may change places.
    """
    key = F.struct(*order)
    n = df.count()
    ranges = max(1, min(MOST_RANGES, -(-n // RANGE_ROWS)))
    cuts: list = []
    if ranges > 1:
        every = max(1, n // (ranges * SAMPLES))
        keys = df.select(key.alias("k")).where(F.pmod(F.xxhash64("k"), F.lit(every)) == 0).groupBy("k").count().orderBy("k").select("k").collect()
        cuts = [keys[i * len(keys) // ranges].k for i in range(1, ranges)] if len(keys) >= ranges else [r.k for r in keys]
    kinds = [df.schema[c].dataType for c in order]
    bounds = [F.struct(*[F.lit(v).cast(t).alias(c) for v, t, c in zip(cut, kinds, order)]) for cut in cuts]

    def cell(low: int, high: int) -> Column:
        """How many of the bounds from `low` to `high` are at or below the key."""
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(key < bounds[mid], cell(low, mid)).otherwise(cell(mid + 1, high))

    celled = df.withColumn("_cell", cell(0, len(bounds)))
    counts = {r._cell: r.n for r in celled.groupBy("_cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, shift = [], 0
    for i in range(len(bounds) + 1):
        before.append(shift)
        shift += counts.get(i, 0)
    rank = F.row_number().over(Window.partitionBy("_cell").orderBy(*order))
    return celled.withColumn("_row", rank - 1 + F.element_at(F.array(*[F.lit(b).cast("long") for b in before]), F.col("_cell") + 1)).drop("_cell")
