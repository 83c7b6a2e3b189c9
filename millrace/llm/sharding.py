"""Balanced shards from sampled splitters, with DataFrame functions only.

Rows are ordered by the hash of their text, so that equal texts lie together.
A size-weighted sample of keys gives quantile boundaries; the ranges between
them are counted exactly, and a range that holds too much is subdivided by the hash of its
texts, or where one text fills it by the hash of the rows' ids. Within each
such cell a window gives running sizes; with the cells' totals these are exact
offsets in the whole order, and shards are cut from it at equal sizes.

A group of equal texts stays in one shard if it fits one (if it holds no more than
the whole by the number of shards); a larger one is cut. Groups that are large against a shard, and large rows of groups that
don't fit one (HEAVY * shards of both at most), are dealt first, largest to the emptiest shard, and the rest is cut, between groups, so that it
levels them off. So shard sizes differ by no more than about two groups of
1/HEAVY of a shard, unless the groups dealt first can't be levelled.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import Scratch, inline_rows

HEAVY = 32


def _step(value: Column, bounds: list, low: int = 0, high: int | None = None) -> Column:
    """How many of the ascending `bounds` are <= value, as a balanced tree of comparisons."""
    high = len(bounds) if high is None else high
    if low == high:
        return F.lit(low)
    mid = (low + high) // 2
    return F.when(value < F.lit(bounds[mid]), _step(value, bounds, low, mid)).otherwise(_step(value, bounds, mid + 1, high))


def _at(values: list, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index + 1)


def level(loads: list[int], rest: int) -> list[int]:
    """How much of `rest` each load takes so that the fullest is as low as possible."""
    take, left = [0] * len(loads), rest
    order = sorted(range(len(loads)), key=lambda i: loads[i])
    n, height = 0, 0
    for n in range(1, len(order) + 1):
        need = sum(loads[i] for i in order[:n]) + left
        height = need / n
        if n == len(order) or height <= loads[order[n]]:
            break
    cut, done = 0.0, 0
    for i in order[:n]:
        cut += height - loads[i]
        take[i] = round(cut) - done
        done = round(cut)
    take[order[n - 1]] += rest - done
    return take


def shard(df: DataFrame, shards: int = 40, doc_id: str = "doc_id", text: str = "text", samples_per_range: int = 16, rows_per_range: int = 500_000, max_ranges: int = 512) -> DataFrame:
    """Put every row of `df` into one of `shards` shards of near equal sizes (law `bytes`), equal texts together where they fit.

    Returns doc_id, size (UTF-8 bytes and 16), text_crc32, law, shard, slot
    (gapless from 0 in each shard) and grown_shard (null: shards are cut by
    size, so another count moves rows between all of them). A null text counts
    as no bytes, with the CRC of no bytes, and is equal to an empty one. Repeated rows are placed each on its
    own; rows with equal id and text are interchangeable. An empty table gives no
    rows. Other columns of `df` are not read.
    """
    spark = df.sparkSession
    store = Scratch(spark)
    body = F.coalesce(F.col(text), F.lit(""))
    base = store.keep(
        df.select(
            F.col(doc_id).alias("doc_id"),
            (F.octet_length(body).cast("long") + 16).alias("size"),
            F.crc32(body.cast("binary")).alias("text_crc32"),
            F.xxhash64(body).alias("k"),
        ).withColumn("salt", F.xxhash64("doc_id", "k", F.lit(1))),
        "rows",
    )
    rows, total = base.agg(F.count(F.lit(1)), F.sum("size")).first()
    out = ["doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")]
    if not rows:
        return base.withColumns({"shard": F.lit(0), "slot": F.lit(0)}).select(*out)

    # 1. groups that are large against a shard, dealt one by one, or row by row where their rows are large and they fit no shard
    heavy_from, most = max(total // (HEAVY * shards), 1), total // shards
    groups = base.groupBy("k").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"), F.max("size").alias("size")).where(F.col("b") > heavy_from).collect()
    cut = [r.k for r in groups if r.b > most and r.size <= heavy_from]  # fewer than there are shards
    items = [(r.b, r.k, 0, r.n, -(-r.n // rows_per_range)) for r in groups if r.b <= most]
    items += [(r.size, r.k, i, 1, -(-r.n // rows_per_range)) for r in groups if r.b > most and r.size > heavy_from for i in range(r.n)]
    loads, slots, dealt = [0] * shards, [0] * shards, []
    heap = [(0, i) for i in range(shards)]
    for size, k, first, n, subs in sorted(items, key=lambda x: (-x[0], *x[1:])):
        load, i = heapq.heappop(heap)
        dealt.append({"k": k, "first": first, "n": n, "subs": subs, "shard": i, "base": slots[i]})
        loads[i] += size
        slots[i] += n
        heapq.heappush(heap, (load + size, i))
    light, large = base, None
    if dealt:
        subs = F.broadcast(inline_rows(spark, [{"k": k, "subs": n} for k, n in {d["k"]: d["subs"] for d in dealt}.items()], "k long, subs int"))
        met = base.join(subs, "k").withColumn("sub", F.pmod(F.xxhash64("salt", F.lit(4)), F.col("subs")).cast("int"))
        shifts, seen = [], {}
        for r in sorted(met.groupBy("k", "sub").agg(F.count(F.lit(1)).alias("n")).collect()):
            shifts.append({"k": r.k, "sub": r.sub, "shift": seen.get(r.k, 0)})
            seen[r.k] = seen.get(r.k, 0) + r.n
        nth = F.row_number().over(Window.partitionBy("k", "sub").orderBy("salt")) - 1 + F.col("shift")
        numbered = met.join(F.broadcast(inline_rows(spark, shifts, "k long, sub int, shift long")), ["k", "sub"]).withColumn("nth", nth)
        to = F.broadcast(inline_rows(spark, dealt, "k long, first long, n long, shard int, base long").withColumnRenamed("k", "to_k"))
        fits = (F.col("k") == F.col("to_k")) & (F.col("nth") >= F.col("first")) & (F.col("nth") < F.col("first") + F.col("n"))
        large = numbered.join(to, fits).withColumn("slot", F.col("base") + F.col("nth") - F.col("first")).select(*out)
        light = base.join(subs.select("k"), "k", "left_anti")

    # 2. splitters from a sample in which a row counts by its size (and, by half, for being a row)
    n_light, light_bytes = rows - sum(d["n"] for d in dealt), total - sum(loads)
    if not n_light:
        return large
    ranges = int(min(max_ranges, max(4 * shards, n_light // rows_per_range)))
    weight = (F.col("size") / F.lit(light_bytes) + F.lit(1.0 / n_light)) / 2
    want = ranges * samples_per_range
    chance = F.pmod(F.xxhash64("salt", F.lit(2)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = light.select("k", F.floor(weight * want + chance).cast("int").alias("n")).where("n > 0").groupBy("k").agg(F.sum("n").alias("n")).collect()
    drawn.sort()
    goal, seen, bounds = sum(r.n for r in drawn) / ranges, 0.0, []
    for r in drawn:
        if seen >= goal * (len(bounds) + 1) and len(bounds) < ranges - 1:
            bounds.append(r.k)
            while seen >= goal * (len(bounds) + 1) and len(bounds) < ranges - 1:
                bounds.append(r.k)
        seen += r.n
    bounds = sorted(set(bounds))
    light = light.withColumn("range", _step(F.col("k"), bounds))

    # 3. ranges that turn out overfull are subdivided by the texts' own hash, and the groups to be cut by the rows'
    held = {r.range: r.w for r in light.groupBy("range").agg(F.sum(weight).alias("w")).collect()}
    parts = [max(1, -(-int(held.get(i, 0.0) * ranges * 1000) // 1500)) for i in range(len(bounds) + 1)]
    first = [sum(parts[:i]) for i in range(len(parts))]
    wide = F.col("k").isin(cut) if cut else F.lit(False)
    spread = F.when(wide, F.xxhash64("salt", F.lit(3))).otherwise(F.xxhash64("k", F.lit(3)))
    light = light.withColumn("cell", (_at(first, F.col("range")) + F.pmod(spread, _at(parts, F.col("range")))).cast("int"))
    cells = {r.cell: (r.b, r.n) for r in light.groupBy("cell").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect()}
    before, b = [], 0
    for i in range(sum(parts)):
        before.append(b)
        b += cells.get(i, (0, 0))[0]

    # 4. exact offsets in the whole order, cut where the shards are level: at a group's middle, or a row's of the groups to be cut
    cuts, at = [], 0
    for take in level(loads, light_bytes)[:-1]:
        at += take
        cuts.append(2 * at)
    order = Window.partitionBy("cell").orderBy("k", "salt")
    up_to_row = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    up_to_group = F.sum("size").over(Window.partitionBy("cell").orderBy("k").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    own_group = F.sum("size").over(Window.partitionBy("cell", "k"))
    middle = F.when(wide, 2 * up_to_row - F.col("size")).otherwise(2 * up_to_group - own_group) + 2 * _at(before, F.col("cell"))
    placed = light.withColumn("middle", middle).withColumn("shard", _step(F.col("middle"), cuts)).withColumn("rank", F.row_number().over(order) - 1)
    # a cell's rows go to shards in ascending order, so ranks within (shard, cell) need the first only
    held_by = placed.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("least")).collect()
    starts, used = [], dict(enumerate(slots))
    for r in sorted(held_by):
        starts.append({"shard": r.shard, "cell": r.cell, "shift": used[r.shard] - r.least})
        used[r.shard] += r.n
    small = placed.join(F.broadcast(inline_rows(spark, starts, "shard int, cell int, shift long")), ["shard", "cell"]).withColumn("slot", F.col("rank") + F.col("shift")).select(*out)
    return small if large is None else large.union(small)
