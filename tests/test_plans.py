"""Plans over small generated inputs, with self-checking results."""

import bz2
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace import errors
from millrace.functions.user import column_map, row_map
from millrace.operators.relational import of
from millrace.plans.compiler import compile_plan
from millrace.plans.config import parse
from millrace.plans.flow import Flow
from millrace.sources import scans
from millrace.types import parse_type


def lines(path, rows, sep="|"):
    path.write_text("".join(sep.join(map(str, r)) + "\n" for r in rows))
    return str(path)


def text(path, schema, **more):
    return Flow.source("scan", file=path, filetype="text", schema=schema, **more)


def rows(flow, spark, *args, **kw):
    return sorted(tuple(r) for r in flow.compile(spark, *args, **kw).df.collect())


@pytest.fixture
def identity(tmp_path):
    return lines(tmp_path / "identity.tbl", [(i, i) for i in range(1, 21)])


def test_filter_then_count(spark, identity):
    assert rows(text(identity, ["long", "long"]).filter(0, "<", 10).count([0]), spark) == [(i, 1) for i in range(1, 10)]


def test_composite_key(spark, tmp_path):
    p = lines(tmp_path / "a", [(i, chr(96 + i), i) for i in range(1, 21)] * 12)
    got = rows(text(p, ["long", "char(1)", "long"]).filter(0, "<", 10).count([0, 1]), spark)
    assert got == [(i, chr(96 + i), 12) for i in range(1, 10)]


@pytest.mark.parametrize("global_", [False, True])
def test_two_level_sum(spark, tmp_path, global_):
    p = lines(tmp_path / "a", [(i, k) for i in range(1, 21) for k in range(1, i + 1)])
    flow = text(p, ["long", "dec"]).sum([0], 1, **({"global": True} if global_ else {})).merge(4).sum([0], 1)
    assert rows(flow, spark) == [(i, i * (i + 1) / 2) for i in range(1, 21)]


@pytest.mark.parametrize("kind", ["hashjoin", "sortmergejoin", "mpsmjoin", "newmpsmjoin", "preprejoin"])
def test_one_to_one_join(spark, tmp_path, identity, kind):
    build = lines(tmp_path / "b", [(i, i + 0.1) for i in range(1, 21)])
    flow = text(identity, ["long", "long"]).join(text(build, ["long", "dec"]), 0, 0, ["P$1", "B$1"], kind)
    assert rows(flow, spark) == [(i, i + 0.1) for i in range(1, 21)]


def test_keys_and_children(spark, tmp_path):
    build = lines(tmp_path / "b", [(k, k + 0.1) for k in range(1, 201)])
    probe = lines(tmp_path / "p", [(k, c) for k in range(1, 201) for c in range(1, (k & 3) + 2)])
    part = text(build, ["long", "dec"]).op("partition", attr=0, range=[1, 200], buckets=4, sort="yes").merge()
    flow = text(probe, ["long", "long"]).join(part, 0, 0, ["P$0", "P$1"], "mpsmjoin")
    assert rows(flow, spark) == sorted((k, c) for k in range(1, 201) for c in range(1, (k & 3) + 2))


def test_two_groups_do_not_meet(spark, tmp_path):
    b = lines(tmp_path / "b", [(1, i) for i in range(1, 21)])
    p = lines(tmp_path / "p", [(1, i + 0.1) for i in range(1, 21)])
    build = Flow.source("partitionedscan", files=[b, b], filetype="text", schema=["long", "long"])
    probe = Flow.source("partitionedscan", files=[p, p], filetype="text", schema=["long", "dec"])
    apart = rows(probe.join(build, 0, 0, ["B$1", "P$1"], threadgroups=[[0], [1]]).merge(2), spark)
    together = rows(probe.join(build, 0, 0, ["B$1", "P$1"], threadgroups=[[0, 1]]).merge(2), spark)
    assert set(Counter(apart).values()) == {2} and len(apart) == 800
    assert set(Counter(together).values()) == {4} and len(together) == 1600


def test_odd_even_and_empty_files(spark, tmp_path):
    odd, even = lines(tmp_path / "o", [(i, i) for i in range(1, 201, 2)]), lines(tmp_path / "e", [(i, i) for i in range(2, 201, 2)])
    keys = [2, 4, 6, 8, 10, 11, 13, 15, 17, 19]
    some, none = lines(tmp_path / "s", [(k, k) for k in keys]), lines(tmp_path / "n", [])
    scan = lambda *f: Flow.source("partitionedscan", files=list(f), filetype="text", schema=["long", "long"])
    assert rows(scan(some, none).join(scan(odd, even), 0, 0, ["P$0"], threadgroups=[[0, 1]]).merge(2), spark) == [(k,) for k in keys]


def test_dates_map_and_join(spark, tmp_path):
    back = column_map(lambda d: F.col("c0"), lambda d: F.add_months("c1", -1).cast("timestamp"))
    src = text(lines(tmp_path / "m3", [(i, f"14/03/{1969 + i}") for i in range(1, 21)]), ["long", "date(%d/%m/%Y)"]).filter(1, "<", "12/12/1980").op("back")
    other = text(lines(tmp_path / "f3", [(f"14/02/{1969 + i}", i + 1) for i in range(1, 21)]), ["date(%d/%m/%Y)", "long"])
    got = rows(src.join(other, 0, 1, ["P$1", "P$0", "B$1"]), spark, {"back": back})
    assert len(got) == 11 and all(v == k + 1 and d.month == 2 and d.year <= 1980 for d, k, v in got)


def test_sort_limit(spark, tmp_path):
    data = [(i * 37 % 50, i * 11 % 7) for i in range(60)]
    for ascending in (False, True):
        flow = text(lines(tmp_path / f"s{ascending}", data), ["long", "long"]).sort([0, 1], ascending, 8)
        assert [tuple(r) for r in flow.compile(spark).df.collect()] == sorted(data, reverse=not ascending)[:8]


def test_partition_is_monotone_and_keeps_all(spark, tmp_path):
    data = [(v, v ^ 0xABCDEF) for v in range(1, 2000, 7)]
    flow = text(lines(tmp_path / "p", data), ["long", "long"]).op("partition", attr=0, range=[1, 2000], buckets=5, sort="yes").op("threadidprepend")
    got = rows(flow, spark)
    assert sorted((v, w) for _, v, w in got) == data
    by_value = [b for b, v, _ in sorted(got, key=lambda r: r[1])]
    assert by_value == sorted(by_value) and set(by_value) == set(range(5))
    bad = text(lines(tmp_path / "q", [(9999, 1)]), ["long", "long"]).op("partition", attr=0, range=[1, 2000], buckets=5, sort="no")
    with pytest.raises(Exception, match="outside"):
        rows(bad, spark)


def test_threads_merge_and_ids(spark, identity):
    flow = Flow.source("parallelscan", files=[identity] * 3, mapping=[[0], [1, 2], [3]], filetype="text", schema=["long", "long"]).op("threadidprepend").merge(4)
    assert Counter(rows(flow, spark)) == Counter((t, i, i) for t in (0, 1, 3) for i in range(1, 21))


def test_user_map_and_project(spark, identity):
    ops = {"one": row_map(lambda p: p.assign(c1=1), "c0 long, c1 long")}
    assert rows(text(identity, ["long", "long"]).filter(0, "<", 10).op("one"), spark, ops) == [(i, 1) for i in range(1, 10)]
    assert rows(text(identity, ["long", "long"]).filter(0, "<", 10).project(1), spark) == [(i,) for i in range(1, 10)]


def test_preprejoin_joins_by_thread(spark, tmp_path):
    b, p = lines(tmp_path / "b", [(1, i) for i in range(10)]), lines(tmp_path / "p", [(1, i) for i in range(10)])
    side = lambda f: Flow.source("partitionedscan", files=[f, f], filetype="text", schema=["long", "long"])
    by_thread = rows(side(p).join(side(b), 0, 0, ["B$1", "P$1"], "preprejoin", threadgroups=[[0, 1]]).merge(2), spark)
    by_group = rows(side(p).join(side(b), 0, 0, ["B$1", "P$1"], "newmpsmjoin", threadgroups=[[0, 1]]).merge(2), spark)
    assert set(Counter(by_thread).values()) == {2} and set(Counter(by_group).values()) == {4}


@pytest.mark.parametrize("groups", [None, [], [0, 1], [[0], []], "0", [[0], [1, 0]]])
def test_thread_groups_are_needed_and_well_formed(spark, identity, groups):
    flow = text(identity, ["long", "long"]).join(text(identity, ["long", "long"]), 0, 0, ["B$0"])
    node = next(n for n in flow.definitions.values() if n["type"] == "hashjoin")
    node.pop("threadgroups") if groups is None else node.update(threadgroups=groups)
    with pytest.raises(errors.MissingParameter if groups is None else errors.InvalidParameter):
        flow.compile(spark)


def test_segments(spark, tmp_path, identity):
    paths = [str(tmp_path / "a"), str(tmp_path / "b")]
    seen = spark.sparkContext.accumulator(0)

    def watch(p):
        seen.add(len(p))
        return p

    source = text(identity, ["long", "long"]).op("watch").op("again")
    plan = source.op("shmwriter", size=32, paths=paths, policy="round-robin").compile(spark, {"watch": row_map(watch, "c0 long, c1 long"), "again": row_map(lambda p: p.assign(c1=7), "c0 long, c1 long")})
    assert not any((tmp_path / p).exists() for p in "ab") and plan.df.collect() == []
    assert plan.run().collect() == [] and seen.value == 20
    parts = [[tuple(r) for r in spark.read.parquet(p).collect()] for p in paths]
    assert sorted(parts[0] + parts[1]) == [(i, 7) for i in range(1, 21)] and [len(p) for p in parts] == [10, 10]
    assert len(list((tmp_path / "a").glob("*.parquet"))) == 5 and sorted(x.name for x in tmp_path.iterdir()) == ["a", "b", "identity.tbl"]
    plan.run()
    assert spark.read.parquet(*paths).count() == 40


@pytest.mark.parametrize("policy, paths, nodes, good", [(None, 1, 0, True), (None, 2, 2, False), ("bind", 1, 1, True), ("bind", 2, 1, False), ("bind", 1, 2, False), ("round-robin", 2, 2, True), ("round-robin", 2, 1, False), ("interleave", 1, 2, True), ("interleave", 2, 2, False), ("other", 1, 1, False)])
def test_writer_policies(spark, tmp_path, identity, policy, paths, nodes, good):
    settings = {"paths": [str(tmp_path / f"p{i}") for i in range(paths)], "numanodes": list(range(nodes))} | ({"policy": policy} if policy else {})
    flow = text(identity, ["long", "long"]).op("shmwriter", size=1 << 20, **settings)
    if good:
        flow.compile(spark).run()
        assert spark.read.parquet(*settings["paths"]).count() == 20
    else:
        with pytest.raises(errors.InvalidParameter):
            flow.compile(spark)


def test_empty_segments(spark, tmp_path, identity):
    text(identity, ["long", "long"]).filter(0, "<", 0).op("shmwriter", size=1, paths=[str(tmp_path / "a")]).compile(spark).run()
    assert not list((tmp_path / "a").glob("*.parquet"))


PLAN = """
# two files, their common keys summed
path = "{path}/";
left = {{ type = "scan"; filetype = "text"; file = "l.tbl"; schema = ("long", "dec"); }};
right = {{ type = "scan"; filetype = "text"; file = "r.tbl"; schema = ("long", "date(%Y-%m-%d)"); }};
meet = {{ type = "hashjoin"; buildjattr = 0; probejattr = 0; projection = ("B$1", "P$1"); threadgroups = ((0)); }};
clock = {{ type = "cycle_accountant"; }}; inner = {{ type = "cycle_accountant"; }};
add = {{ type = "aggregate_sum"; field = 0; sumfield = 1; }};
treeroot = {{ name = "clock"; input = {{ name = "add"; input = {{ name = "inner"; input = {{
  name = "meet"; build = {{ name = "right"; }}; probe = {{ name = "left"; }}; }}; }}; }}; }};
"""


def test_command_line_tree_and_profile(spark, tmp_path, capsys):
    from millrace.__main__ import main

    lines(tmp_path / "l.tbl", [(k, k / 4) for k in range(1, 9)])
    lines(tmp_path / "r.tbl", [(k, f"2001-02-{1 + k % 2:02}") for k in range(1, 9)])
    (tmp_path / "plan").write_text(PLAN.format(path=tmp_path))
    assert main([str(tmp_path / "plan"), "--profile"]) == 0
    said = capsys.readouterr().out.splitlines()
    assert sorted(said[:2]) == ["2001-02-01|5.00", "2001-02-02|4.00"] and said[2].startswith("ResponseTimeInSec: ")
    assert said.pop().startswith("Max Memory (bytes): ")
    assert [x.split(" (")[0] for x in said[3:]] == ["clock", "  add", "    inner", "      meet", "        right", "        left"]
    assert "2 rows" in said[3] and "8 rows" in said[5]
    plan = compile_plan(PLAN.format(path=tmp_path), spark)
    top, below = plan.profile()
    assert min(top.cpu_seconds, top.read_bytes, top.shuffled_bytes, top.most_memory) > 0 and top.spilled_bytes == 0
    assert (top.rows, below.rows) == (2, 8) and 0 <= top.own_seconds <= top.seconds and below.own_seconds == below.seconds
    (tmp_path / "bad").write_text("treeroot = 1")
    assert main([str(tmp_path / "bad")]) == 2


def test_a_rewritten_table_is_read_by_its_new_schema(spark, tmp_path):
    import os

    path = str(tmp_path / "t")
    scan = lambda: rows(Flow.source("scan", file=path, filetype="parquet"), spark)
    spark.createDataFrame([(1, "a")], "k long, s string").write.parquet(path)
    assert scan() == [(1, "a")]
    spark.createDataFrame([(2.5,)], "d double").write.mode("overwrite").parquet(path)
    os.utime(path, (1e9, 1e9))  # whatever the clock says
    assert scan() == [(2.5,)]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        rows(Flow.source("scan", file=path + "-none", filetype="parquet"), spark)


def test_text_rules(spark, tmp_path):
    p = tmp_path / "t.bz2"
    p.write_bytes(bz2.compress(b"|1||a\t2.5|\n2,bcd,3\n"))
    assert rows(text(str(p), ["int", "char(2)", "dec"]), spark) == [(1, "a", 2.5), (2, "bc", 3.0)]
    q = lines(tmp_path / "q", [("4x", "zz")])
    assert rows(text(q, ["int", "dec"], lenient=True), spark) == [(4, 0.0)]
    with pytest.raises(Exception, match="fields"):
        rows(text(q, ["int"]), spark)


def test_binary_rows_and_checksum(spark, tmp_path):
    import struct

    for n in (1, 2):
        (tmp_path / f"f{n}").write_bytes(b"".join(struct.pack("<iqd4s", i, -i, i / 2, b"ab") for i in range(1, 5)))
    flow = Flow.source("scan", file=str(tmp_path / "f*"), schema=["int", "long", "dec", "char(3)"])
    assert rows(flow, spark) == sorted([(i, -i, i / 2, "ab") for i in range(1, 5)] * 2)
    one = Flow.source("scan", file=str(tmp_path / "f1"), schema=["int", "long", "dec", "char(3)"])
    want = 0
    raw = (tmp_path / "f1").read_bytes()
    for (w,) in struct.iter_unpack("<i", raw):
        want ^= w
    assert rows(one.op("consumer"), spark) == [(want,)]


def test_empty_sum_without_keys(spark, identity):
    flow = text(identity, ["long", "long"]).filter(0, "<", 0)
    assert rows(flow.sum([], 0), spark) == [] and rows(flow.op("consumer"), spark) == [(0,)]


def test_tuple_count_is_observed(spark, identity):
    plan = text(identity, ["long", "long"]).op("printer_tuplecount").compile(spark)
    plan.df.collect()
    assert [o.get["rows"] for o in plan.observations.values()] == [20]


def test_dense_row_ids(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"))
    got = scans.with_row_id(df, ["k"]).collect()
    assert sorted(r._row for r in got) == list(range(1000)) and all(r.k == r._row for r in got)


def test_dense_row_ids_by_text_and_skewed_keys(spark, monkeypatch):
    monkeypatch.setattr(scans, "RANGE_ROWS", 50)
    df = spark.range(1000).selectExpr("CASE WHEN id % 10 < 9 THEN NULL ELSE id % 7 END AS a", "concat('k', id * 7 % 1000) AS b")
    want = sorted(df.collect(), key=lambda r: (r.a is not None, r.a or 0, r.b))
    numbered = scans.with_row_id(df, ["a", "b"])
    got = sorted(numbered.collect(), key=lambda r: r._row)
    assert [(r.a, r.b) for r in got] == [(r.a, r.b) for r in want] and [r._row for r in got] == list(range(1000))
    assert scans.with_row_id(df.limit(0), ["a", "b"]).collect() == []


def test_config_grammar():
    got = parse('a = 1; b : { c = "x" "y"; d = [1, 2]; } # note\ne = ( (0, 1.5), {f = true;} ); g = 0x1FL; /* z */')
    assert got == {"a": 1, "b": {"c": "xy", "d": [1, 2]}, "e": [[0, 1.5], {"f": True}], "g": 31}
    with pytest.raises(errors.InvalidParameter):
        parse("a = ;")


def test_errors(spark, identity):
    for spec, error in (
        ({}, errors.MissingParameter),
        ({"treeroot": {}}, errors.MissingParameter),
        ({"treeroot": {"name": "x"}}, errors.MissingParameter),
        ({"treeroot": {"name": "x"}, "x": {}}, errors.MissingParameter),
        ({"treeroot": {"name": "x"}, "x": {"type": "what"}}, errors.InvalidParameter),
    ):
        with pytest.raises(error):
            compile_plan(spec, spark)
    with pytest.raises(errors.IllegalSchema):
        parse_type("char")
    with pytest.raises(errors.UnknownComparison):
        text(identity, ["long", "long"]).filter(0, "~", 1).compile(spark)
    df = spark.createDataFrame([("a", 1)], "a string, b long")
    with pytest.raises(errors.UnknownComparison):
        Flow.source("scan", file="t").join(Flow.source("scan", file="t"), 0, 1, ["B$0"]).compile(spark, tables={"t": df})
    assert [f.kind for f in of(df).fields] == ["char", "long"]
