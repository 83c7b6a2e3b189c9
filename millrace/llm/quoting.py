"""Conversations from messages that quote each other: quotes are parsed, linked to originals and removed."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import Scratch

_MARK = re.compile(r"[ \t]*((?:>[ \t]?)+)")
#: Turns of a conversation that are ordered by one task.
SPAN = 1024


def parse(text: str) -> tuple[str, list[tuple[int, str]]]:
    """The text without quotes, and its quoted passages (level, text) in order.

    A line's level is the number of `>` it begins with; spaces may stand between.
    A passage is a run of lines of one level.
    """
    own: list[str] = []
    passages: list[tuple[int, list[str]]] = []
    before = 0
    for line in text.split("\n"):
        found = _MARK.match(line)
        level = found[1].count(">") if found else 0
        if not level:
            own.append(line)
        else:
            if level != before:
                passages.append((level, []))
            passages[-1][1].append(line[found.end() :])
        before = level
    return "\n".join(own).strip("\n"), [(n, "\n".join(x)) for n, x in passages]


def unit_hash(text: str) -> tuple[int, int] | None:
    """A hash and the number of the case-folded letters and digits; None where there are none."""
    plain = "".join(c for c in text.casefold() if c.isalnum())
    return (int.from_bytes(hashlib.blake2b(plain.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True), len(plain)) if plain else None


def units(text: str) -> list[tuple[int, int, int]]:
    """(kind, hash, size) of what a passage may be quoted by: the whole (kind 0), its paragraphs (1) and its lines (2)."""
    parts = ([text], re.split(r"\n\s*\n", text), text.split("\n"))
    found: dict[int, tuple[int, int, int]] = {}
    for kind, part in enumerate(parts):
        for x in part:
            if known := unit_hash(x):
                found.setdefault(known[0], (kind, *known))
    return list(found.values())


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols: list[list] = [[], [], [], [], []]
        for t in batch.column("text"):
            own, passages = parse(t.as_py() or "")
            quoted = [{"level": level, "rank": rank, "kind": kind, "h": h, "n": n} for rank, (level, p) in enumerate(passages) for kind, h, n in units(p)]
            for c, v in zip(cols, (own, len(passages), max((n for n, _ in passages), default=0), [h for _, h, _ in units(own)], quoted)):
                c.append(v)
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.struct([("level", pa.int32()), ("rank", pa.int32()), ("kind", pa.int32()), ("h", pa.int64()), ("n", pa.int32())])))
        kept = [batch.column(n) for n in ("conv_id", "turn", "role", "tag")]
        yield pa.record_batch([*kept, *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["conv_id", "turn", "role", "tag", "body", "n_quotes", "max_level", "units", "quoted"])


def link_quotes(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for every message of `df`, in reply order within its conversation.

    Returns conv_id, turn, role, body (the text without quotes), n_quotes,
    max_level, parent_conv and parent_turn (the quoted original), root_turn and depth (the thread's first
    message, and how many replies down this one is), position (from 0 in reply
    order: a thread follows its first message, by turn, and a reply what it answers; without quotes, by
    turn) and origins (rank, level, conv and turn for each passage, of whatever level,
    that has an original; rank counts a message's passages from 0).
    The passage as a whole, its paragraphs and its lines are looked for among whole messages,
    their paragraphs and their lines. For each the latest earlier turn of the same conversation that
    holds it is found, or where there is none the least other conversation and its first turn that does. A
    passage's original is, of those in the same conversation if any, the one whose finds (of one
    kind) cover most letters and digits of it; of equal ones that found by the whole, then by
    paragraphs, then the latest turn. The parent is the original of a passage of the
    shallowest level that has any: of the first in the same conversation, else of the first. Only parents of the same conversation and an earlier turn
    make a thread. Different messages with the same conversation and turn share one parent
    and follow each other by role and text; copies of one message share its position. Null texts are empty; messages with a null
    conversation or turn have no parent, thread or position and are nobody's.

    For each hash the two least conversations are chosen before the join, and the
    latest earlier turn by a running maximum, so that a passage that many messages hold
    joins to one row. Threads are ordered by ranking the list of their messages' begins and ends, by doubling: rows stay two
    a message whatever a thread's depth, and no two rows of a round join the same one. Running maxima, siblings and positions are
    taken in spans of turns with offsets, so that a conversation or a message with replies of any number is
    shared by many tasks.
    """
    store = Scratch(df.sparkSession)
    kinds = {c: df.schema[c].dataType.simpleString() for c in (conv_id, turn)}
    read = df.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).alias("text"), F.xxhash64(F.col(role), F.col(text)).alias("tag"))
    schema = f"conv_id {kinds[conv_id]}, turn {kinds[turn]}, role string, tag long, body string, n_quotes int, max_level int, units array<long>, quoted array<struct<level: int, rank: int, kind: int, h: long, n: int>>"
    said = store.keep(read.mapInArrow(_parsed, schema), "said")
    named = said.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    asked = store.keep(named.where("size(quoted) > 0").select("conv_id", "turn", "tag", F.explode("quoted").alias("q")).select("conv_id", "turn", "tag", "q.level", "q.rank", "q.kind", "q.h", "q.n").distinct(), "asked")
    own = named.select("conv_id", "turn", F.explode("units").alias("h")).join(asked.select("h").distinct(), "h", "left_semi")
    here = own.groupBy("h", "conv_id").agg(F.min("turn").alias("at"))
    least = here.withColumn("nth", F.row_number().over(Window.partitionBy("h").orderBy("conv_id"))).where("nth <= 2")
    first = store.keep(least.groupBy("h").agg(F.array_sort(F.collect_list(F.struct("conv_id", "at"))).alias("any")), "first")

    # the latest earlier turn of the own conversation that holds a hash: within the span of turns, else of the spans before
    sought = asked.select("h", "conv_id", "turn").distinct()
    holds = own.join(sought.select("h", "conv_id").distinct(), ["h", "conv_id"], "left_semi").select("h", "conv_id", "turn", F.col("turn").alias("at"))
    events = sought.withColumn("at", F.lit(None).cast(kinds[turn])).union(holds).withColumn("part", F.floor(F.col("turn") / SPAN))
    earlier_turns = Window.partitionBy("h", "conv_id", "part").orderBy("turn", F.col("at").isNotNull()).rowsBetween(Window.unboundedPreceding, -1)
    earlier_parts = Window.partitionBy("h", "conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    within = events.withColumn("within", F.max("at").over(earlier_turns)).where("at IS NULL")
    before = events.groupBy("h", "conv_id", "part").agg(F.max("at").alias("at")).select("h", "conv_id", "part", F.max("at").over(earlier_parts).alias("before"))
    latest = within.join(before, ["h", "conv_id", "part"]).select("h", "conv_id", "turn", F.coalesce("within", "before").alias("near")).where("near IS NOT NULL")

    near = asked.join(latest, ["h", "conv_id", "turn"], "left").join(first, "h")
    link = F.when(F.col("near").isNotNull(), F.struct(F.lit(0).alias("o"), F.col("conv_id").alias("c"), F.col("near").alias("t"))).when(F.col("other").isNotNull(), F.struct(F.lit(1).alias("o"), F.col("other.conv_id").alias("c"), F.col("other.at").alias("t")))
    passage = ["conv_id", "turn", "tag", "level", "rank"]
    linked = near.withColumn("other", F.get(F.filter("any", lambda x: x["conv_id"] != F.col("conv_id")), F.lit(0))).select(*passage, "kind", "n", link.alias("p")).where("p IS NOT NULL")
    covered = linked.groupBy(*passage, "kind", "p").agg(F.sum("n").alias("n"))
    late = F.when(F.col("p.o") == 0, -F.col("p.t"))
    best = F.struct(F.col("p.o").alias("o"), (-F.col("n")).alias("n"), "kind", late.alias("late"), F.col("p.c").alias("c"), F.col("p.t").alias("t"))
    origin = store.keep(covered.groupBy(*passage).agg(F.min(best).alias("p")), "origin")
    nearest = F.min(F.struct("level", "p.o", "rank", "p.c", "p.t")).alias("p")
    parents = store.keep(origin.groupBy("conv_id", "turn").agg(nearest).select("conv_id", "turn", F.col("p.c").alias("parent_conv"), F.col("p.t").alias("parent_turn")), "parents")
    origins = origin.groupBy("conv_id", "turn", "tag").agg(F.array_sort(F.collect_list(F.struct("rank", "level", F.col("p.c").alias("conv"), F.col("p.t").alias("turn")))).alias("origins"))

    each = named.select("conv_id", "turn", "role", "tag").distinct()
    each = store.keep(each.withColumn("nth", F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "tag"))), "each")
    turns = each.groupBy("conv_id", "turn").agg(F.max("nth").alias("m"))
    inner = parents.where("parent_conv = conv_id").select("conv_id", "turn", F.col("parent_turn").alias("up"))
    threads = store.keep(_ranked(turns, inner, kinds[turn], store), "threads")

    placed = turns.join(threads, ["conv_id", "turn"], "left").select("conv_id", "turn", "m", F.coalesce("root", "turn").alias("root"), F.coalesce("depth", F.lit(0).cast("long")).alias("depth"), F.coalesce("before", F.lit(0).cast("long")).alias("before"), F.coalesce("size", F.col("m").cast("long")).alias("size"))
    placed = store.keep(placed.withColumn("part", F.floor(F.col("root") / SPAN)), "placed")
    roots = placed.where("root = turn")
    in_part = Window.partitionBy("conv_id", "part").orderBy("root").rowsBetween(Window.unboundedPreceding, -1)
    parts = roots.groupBy("conv_id", "part").agg(F.sum("size").alias("n")).withColumn("shift", F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    begins = roots.select("conv_id", "root", "part", F.sum("size").over(in_part).alias("begin")).join(parts.select("conv_id", "part", "shift"), ["conv_id", "part"])
    begins = begins.select("conv_id", "root", (F.coalesce("begin", F.lit(0)) + F.coalesce("shift", F.lit(0))).alias("begin"))
    known = placed.join(begins, ["conv_id", "root"]).select("conv_id", "turn", F.col("root").alias("root_turn"), "depth", (F.col("begin") + F.col("before")).alias("at"))
    known = known.join(parents, ["conv_id", "turn"], "left").join(each.select("conv_id", "turn", "tag", "nth"), ["conv_id", "turn"])
    known = store.keep(known.select("conv_id", "turn", "tag", "root_turn", "depth", (F.col("at") + F.col("nth") - 1).cast("long").alias("position"), "parent_conv", "parent_turn").join(origins, ["conv_id", "turn", "tag"], "left"), "known")
    store.keep_only(said, known)
    none = F.from_json(F.lit("[]"), origins.schema["origins"].dataType.simpleString())
    full = said.join(known, ["conv_id", "turn", "tag"], "left")
    return full.select("conv_id", "turn", "role", "body", "n_quotes", "max_level", "parent_conv", "parent_turn", "root_turn", "depth", "position", F.coalesce("origins", none).alias("origins"))


def _ranked(turns: DataFrame, replies: DataFrame, kind: str, store: Scratch) -> DataFrame:
    """For each turn of a thread with replies: root, depth, before (messages of the thread before it) and size (of the whole thread).

    `turns` has conv_id, turn and m (its messages), `replies` conv_id, turn and up (the turn it answers). The
    list to rank has a begin and an end of each turn: a begin is followed by that of the first reply, or the own
    end; an end by the begin of the next reply to the same turn, or the end of that turn. Each round
    joins an element with the one it points to and takes that one's pointer and sums on.
    """
    part = F.floor(F.col("turn") / SPAN)
    spans = replies.groupBy("conv_id", "up", part.alias("part")).agg(F.min("turn").alias("first")).withColumn("after", F.lead("first").over(Window.partitionBy("conv_id", "up").orderBy("part")))
    linked = replies.withColumn("part", part).withColumn("near", F.lead("turn").over(Window.partitionBy("conv_id", "up", "part").orderBy("turn")))
    linked = linked.join(spans, ["conv_id", "up", "part"]).select("conv_id", "turn", "up", F.coalesce("near", "after").alias("sibling"))
    child = replies.groupBy("conv_id", "up").agg(F.min("turn").alias("child")).withColumnRenamed("up", "turn")
    nodes = replies.select("conv_id", "turn").union(replies.select("conv_id", "up")).distinct().join(turns, ["conv_id", "turn"], "left").join(linked, ["conv_id", "turn"], "left").join(child, ["conv_id", "turn"], "left")

    def element(ends: bool):
        to = F.when(F.col("sibling").isNotNull(), F.col("sibling")).otherwise(F.col("up")) if ends else F.coalesce("child", "turn")
        to_end = (F.col("sibling").isNull() if ends else F.col("child").isNull()).cast("int")
        n = F.lit(0) if ends else F.coalesce("m", F.lit(1))
        return F.struct(F.lit(int(ends)).alias("e"), to.cast(kind).alias("to"), to_end.alias("to_e"), n.cast("long").alias("n"), F.lit(-1 if ends else 1).cast("long").alias("deep"))

    both = nodes.select("conv_id", "turn", F.explode(F.array(element(False), element(True))).alias("x")).select("conv_id", "turn", "x.*", F.col("turn").alias("last"))
    now, step = store.keep(both, "list0"), 0
    n = now.count()
    while now.where("to IS NOT NULL").take(1):
        ahead = now.select("conv_id", F.col("turn").alias("to"), F.col("e").alias("to_e"), F.col("to").alias("next"), F.col("to_e").alias("next_e"), F.col("n").alias("more"), F.col("deep").alias("deeper"), F.col("last").alias("further"))
        joined = now.join(ahead, ["conv_id", "to", "to_e"], "left")
        step += 1
        after = store.keep(joined.select("conv_id", "turn", "e", F.col("next").alias("to"), F.col("next_e").alias("to_e"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"), (F.col("deep") + F.coalesce("deeper", F.lit(0))).alias("deep"), F.coalesce("further", "last").alias("last")), f"list{step}", n)
        store.drop(now)
        now = after
    begins = now.where("e = 0").select("conv_id", "turn", F.col("last").alias("root"), (-F.col("deep")).alias("depth"), "n")
    sizes = begins.where("root = turn").select("conv_id", "root", F.col("n").alias("size"))
    return begins.join(sizes, ["conv_id", "root"]).select("conv_id", "turn", "root", "depth", (F.col("size") - F.col("n")).alias("before"), "size")
