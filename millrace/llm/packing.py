"""Best-fit packing into bins of several permitted capacities."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITIES = (1024, 2048, 4096, 8192, 16384)
#: Repeated rows that go to one lot together.
COPIES = 1024


def pack_lot(lengths: list[int], capacities: tuple[int, ...], attention: float = 0.25) -> tuple[list[int], list[int], list[int]]:
    """Bin and start of each item, and each bin's final capacity.

    Items come longest first. An item goes to the open bin, of whatever
    capacity, that it leaves the least room in; if none has room, a bin opens.
    All permitted capacities that hold the item compete for it by cost: a bin
    costs its length and a share `attention` that grows with its square, over the
    tokens it will hold if the rest of the lot fills it. At the end each bin
    shrinks to the least capacity for its contents.
    """
    top = capacities[-1]
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    bins, starts = [-1] * len(lengths), [0] * len(lengths)
    used: list[int] = []
    room_of: list[int] = []
    rooms: list[int] = []  # distinct rooms of open bins, ascending
    open_at: dict[int, list[int]] = {}
    rest = sum(lengths)
    for i in order:
        n = lengths[i]
        at = bisect_left(rooms, n)
        if at < len(rooms):
            room = rooms[at]
            b = open_at[room].pop()
            if not open_at[room]:
                del open_at[room], rooms[at]
        else:
            fit = [c for c in capacities if c >= n]
            room = min(fit, key=lambda c: ((c + attention * c * c / top) / min(c, rest), c))
            b = len(used)
            used.append(0)
            room_of.append(room)
        bins[i], starts[i] = b, used[b]
        used[b] += n
        rest -= n
        left = room - n
        if left:
            if left not in open_at:
                insort(rooms, left)
                open_at[left] = []
            open_at[left].append(b)
    return bins, starts, [capacities[bisect_left(capacities, u)] for u in used]


def pack(df: DataFrame, doc_id: str = "doc_id", length: str = "length", capacities: tuple[int, ...] = CAPACITIES, lot_tokens: int = 16_000_000, lot_rows: int = 50_000) -> DataFrame:
    """Puts every row of `df` (an id and its length in tokens) into bins.

    Returns doc_id, piece, length, bin_id, start and capacity. A row longer than
    the largest capacity is cut into pieces of that capacity and a last one; a
    row of null or no length has one piece of length 0 without a bin. Bins never
    overflow or overlap and hold each token once. Pieces are dealt by a hash to
    lots of about `lot_tokens` tokens and `lot_rows` rows at most; a lot is
    packed by one task, in memory of that bound, and always in the same way, and
    only its last bins can be ill filled. Repeated rows (null ids included) are counted before they are
    dealt, COPIES to a portion, so that however many there are they go to many
    lots; each is packed on its own. An empty table gives no rows; other columns are not read.
    """
    capacities = tuple(sorted(capacities))
    top = capacities[-1]
    spark = df.sparkSession
    rows = df.select(F.col(doc_id).alias("doc_id"), F.greatest(F.coalesce(F.col(length).cast("long"), F.lit(0)), F.lit(0)).alias("n"))
    n, total = rows.agg(F.count(F.lit(1)), F.sum("n")).first()
    pieces = rows.select("doc_id", "n", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / top) - 1, F.lit(0)).cast("int"))).alias("piece"))
    pieces = pieces.select("doc_id", "piece", F.least(F.lit(top), F.col("n") - F.col("piece").cast("long") * top).alias("length"))
    lots = max(1, -(-(total or 0) // lot_tokens), -(-(n or 0) // lot_rows))
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), lots)
    counted = pieces.groupBy("doc_id", "piece", "length").agg(F.count(F.lit(1)).alias("n"))
    portions = counted.withColumn("portion", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {COPIES}"))))
    copies = F.least(F.lit(COPIES).cast("long"), F.col("n") - F.col("portion") * COPIES).cast("int").alias("copies")
    lot = F.pmod(F.xxhash64("doc_id", "piece", "length", "portion"), F.lit(lots)).cast("long").alias("lot")
    dealt = portions.select("doc_id", "piece", "length", copies, lot)
    kind = df.schema[doc_id].dataType.simpleString()

    def finish(lot: int, rows: pa.Table) -> pa.RecordBatch:
        rows = rows.take(pa.array(np.repeat(np.arange(rows.num_rows), rows.column("copies").to_numpy())))
        lengths = rows.column("length").to_pylist()
        some = [i for i, x in enumerate(lengths) if x > 0]
        bins, starts, sizes = pack_lot([lengths[i] for i in some], capacities)
        ids, at, size = [None] * len(lengths), [0] * len(lengths), [0] * len(lengths)
        for i, b, s in zip(some, bins, starts):
            ids[i], at[i], size[i] = (lot << 24) + b, s, sizes[b]
        whole = rows.combine_chunks().to_batches()[0]
        return pa.record_batch([whole.column("doc_id"), whole.column("piece"), whole.column("length"), pa.array(ids, pa.int64()), pa.array(at, pa.int64()), pa.array(size, pa.int64())], names=["doc_id", "piece", "length", "bin_id", "start", "capacity"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            lot = batch.column("lot").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(lot)) + 1).tolist(), len(lot)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                if held and lot[a] != now:
                    yield finish(int(now), pa.Table.from_batches(held))
                    held = []
                now = lot[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield finish(int(now), pa.Table.from_batches(held))

    dealt = dealt.repartition(parts, "lot").sortWithinPartitions("lot", F.desc("length"), "doc_id", "piece", F.desc("copies"))
    return dealt.mapInArrow(run, f"doc_id {kind}, piece int, length long, bin_id long, start long, capacity long")
