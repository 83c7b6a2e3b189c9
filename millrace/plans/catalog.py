"""Named queries over the driver's tables, each a plan, with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import hash_column, passes
from ..functions.packed import pack
from ..functions.user import column_fold, column_map, row_map
from ..operators.relational import group_sizes, of
from ..scratch import file_system, fresh
from ..sources.scans import table
from ..types import parse_type
from .flow import Flow

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = " ".join(sql.split())
        return f

    return add


def _cents(name: str):
    return F.col(name).cast("decimal(18,2)")


def _at(sf_dir: str) -> str:
    return f"{sf_dir}/"


def scan(table: str, *columns: str, type: str = "scan", **settings) -> Flow:
    return Flow.source(type, file=f"{table}.parquet", filetype="parquet", columns=list(columns), **settings)


def _run(flow: Flow, spark: SparkSession, sf_dir: str, names: list[str], user_ops: dict | None = None, tables: dict | None = None) -> DataFrame:
    return flow.compile(spark, user_ops, tables, path=_at(sf_dir)).df.toDF(*names)


@_query("q1_flagship", """SELECT o_custkey, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2)) - CAST(p_retailprice AS DECIMAL(18,2))) AS DOUBLE) AS margin
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey""")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's margin over the list price: who ordered, what the line cost, what the part costs, summed in two steps."""
    lines = scan("lineitem", "l_extendedprice", "l_orderkey", "l_partkey")
    bought = lines.join(scan("orders", "o_custkey", "o_orderkey"), 1, 1, ["B$0", "P$2", "P$0"])
    priced = bought.join(scan("part", "p_retailprice", "p_partkey"), 1, 1, ["P$0", "P$2", "B$0"])
    sums = priced.op("over_list_price").sum([0], 1).merge(4).sum([0], 1)
    over = column_map(lambda df: F.col("c0"), lambda df: _cents("c1") - _cents("c2"))
    return _run(sums, spark, sf_dir, ["o_custkey", "margin"], {"over_list_price": over}).withColumn("margin", F.col("margin").cast("double"))


@_query("scan_project", "SELECT l_orderkey AS a, l_quantity AS b FROM lineitem")
def _(spark, d):
    return _run(scan("lineitem", "l_orderkey", "l_quantity"), spark, d, ["a", "b"])


@_query("project_reorder_dup", "SELECT l_quantity AS a, l_orderkey AS b, l_quantity AS c FROM lineitem")
def _(spark, d):
    return _run(scan("lineitem", "l_orderkey", "l_quantity").project(1, 0, 1), spark, d, ["a", "b", "c"])


def _filters() -> None:
    for name, op in {"lt": "<", "le": "<=", "eq": "=", "ne": "<>", "ge": ">=", "gt": ">"}.items():

        def f(spark, d, op=op):
            return _run(scan("lineitem", "l_orderkey", "l_linenumber", "l_quantity").filter(1, op, "4"), spark, d, ["k", "n", "q"])

        _query(f"filter_{name}", f"SELECT l_orderkey AS k, l_linenumber AS n, l_quantity AS q FROM lineitem WHERE l_linenumber {op} 4")(f)


_filters()


@_query("filter_literal_truncated", "SELECT l_orderkey AS k, l_linenumber AS n FROM lineitem WHERE l_linenumber = 4")
def _(spark, d):
    return _run(scan("lineitem", "l_orderkey", "l_linenumber").filter(1, "==", "4.5"), spark, d, ["k", "n"])


@_query("filter_date", "SELECT l_orderkey AS k, l_shipdate AS s FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-06-17 00:00:00'")
def _(spark, d):
    return _run(scan("lineitem", "l_orderkey", "l_shipdate").filter(1, "<", "1995-06-17"), spark, d, ["k", "s"])


@_query("filter_char", "SELECT l_orderkey AS k, l_returnflag AS f FROM lineitem WHERE l_returnflag = 'R'")
def _(spark, d):
    return _run(scan("lineitem", "l_orderkey", "l_returnflag").filter(1, "=", "R"), spark, d, ["k", "f"])


@_query("filter_chain_and", "SELECT l_orderkey AS k, l_quantity AS q FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 20 AND l_linenumber <> 3")
def _(spark, d):
    flow = scan("lineitem", "l_orderkey", "l_quantity", "l_linenumber").filter(1, ">=", "10").filter(1, "<", "20").filter(2, "!=", "3")
    return _run(flow.project(0, 1), spark, d, ["k", "q"])


@_query("map_expr", "SELECT l_orderkey AS k, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) - CAST(l_quantity AS DECIMAL(18,2)) AS DOUBLE) AS v FROM lineitem")
def _(spark, d):
    op = column_map(lambda df: F.col("c0"), lambda df: (_cents("c1") - _cents("c2")).cast("double"))
    return _run(scan("lineitem", "l_orderkey", "l_extendedprice", "l_quantity").op("user"), spark, d, ["k", "v"], {"user": op})


def _joins() -> None:
    sql = "SELECT o_custkey AS c, l_orderkey AS k, l_linenumber AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
    for kind in ("hashjoin", "sortmergejoin", "mpsmjoin", "newmpsmjoin", "preprejoin"):

        def f(spark, d, kind=kind):
            flow = scan("lineitem", "l_orderkey", "l_linenumber").join(scan("orders", "o_orderkey", "o_custkey"), 0, 0, ["B$1", "P$0", "P$1"], kind)
            return _run(flow, spark, d, ["c", "k", "n"])

        _query(kind, sql)(f)


_joins()


@_query("hashjoin_mixed_types", "SELECT c_custkey AS c, n_name AS n FROM customer JOIN nation ON c_nationkey = n_nationkey")
def _(spark, d):
    flow = scan("customer", "c_custkey", "c_nationkey").join(scan("nation", "n_nationkey", "n_name"), 0, 1, ["P$0", "B$1"])
    return _run(flow, spark, d, ["c", "n"])


@_query("indexhashjoin", """SELECT event_id AS e, user_id AS u, c_nationkey AS n FROM events JOIN customer ON user_id = c_custkey WHERE c_mktsegment = 'BUILDING'""")
def _(spark, d):
    build = scan("customer", "c_custkey", "c_nationkey", "c_mktsegment").filter(2, "=", "BUILDING")
    probe = Flow.source("hdf5index", indexdirectory="events.parquet", indexdataset="/events/user_id", pick=["/events/event_id", "/events/user_id"])
    return _run(probe.join(build, 0, 1, ["P$0", "P$1", "B$1"], "indexhashjoin"), spark, d, ["e", "u", "n"])


@_query("index_lookup", "SELECT event_id AS e, value AS v FROM events WHERE value > 0.5 AND user_id IN (SELECT s_suppkey FROM supplier)")
def _(spark, d):
    probe = Flow.source("fastbitscan", indexdirectory="events.parquet", indexdataset="user_id", condition="value > 0.5", pick=["event_id", "user_id", "value"])
    return _run(probe.join(scan("supplier", "s_suppkey"), 0, 1, ["P$0", "P$2"], "indexhashjoin"), spark, d, ["e", "v"])


@_query("condition_scan", "SELECT event_id AS e, value AS v FROM events WHERE event_type = 'click' AND value BETWEEN 0.25 AND 75")
def _(spark, d):
    flow = Flow.source("fastbitscan", indexdirectory="events.parquet", condition="event_type = 'click' AND value BETWEEN 0.25 AND 75", pick=["event_id", "value"])
    return _run(flow, spark, d, ["e", "v"])


@_query("join_groups", """SELECT l_orderkey AS k, l_linenumber AS n, o_custkey AS c FROM lineitem JOIN orders
    ON l_orderkey = o_orderkey AND (l_linenumber % 2) = (o_orderkey % 2)""")
def _(spark, d):
    """Two thread groups: build files by order parity, probe files by line parity."""
    lines, orders = table(spark, f"{d}/lineitem.parquet"), table(spark, f"{d}/orders.parquet")
    tables = {f"l{i}": lines.where(f"l_linenumber % 2 = {i}").select("l_orderkey", "l_linenumber") for i in (0, 1)}
    tables |= {f"o{i}": orders.where(f"o_orderkey % 2 = {i}").select("o_orderkey", "o_custkey") for i in (0, 1)}
    probe, build = Flow.source("partitionedscan", files=["l0", "l1"]), Flow.source("partitionedscan", files=["o0", "o1"])
    flow = probe.join(build, 0, 0, ["P$0", "P$1", "B$1"], threadgroups=[[0], [1]])
    return _run(flow.merge(2), spark, d, ["k", "n", "c"], tables=tables)


@_query("cross_by_constant", "SELECT r_name AS r, n_name AS n FROM region, nation")
def _(spark, d):
    one = column_map(lambda df: F.lit(1), lambda df: F.col("c0"))
    flow = scan("nation", "n_name").op("one").join(scan("region", "r_name").op("one"), 0, 0, ["B$1", "P$1"])
    return _run(flow, spark, d, ["r", "n"], {"one": one})


@_query("agg_sum_int", "SELECT l_orderkey AS k, CAST(SUM(l_linenumber) AS BIGINT) AS s FROM lineitem GROUP BY 1")
def _(spark, d):
    return _run(scan("lineitem", "l_orderkey", "l_linenumber").sum([0], 1), spark, d, ["k", "s"])


@_query("agg_sum_long", "SELECT l_linenumber AS k, CAST(SUM(l_partkey) AS BIGINT) AS s FROM lineitem GROUP BY 1")
def _(spark, d):
    return _run(scan("lineitem", "l_linenumber", "l_partkey").sum([0], 1), spark, d, ["k", "s"])


@_query("agg_sum_dec", "SELECT l_returnflag AS k, CAST(SUM(l_quantity) AS DOUBLE) AS s FROM lineitem GROUP BY 1")
def _(spark, d):
    return _run(scan("lineitem", "l_returnflag", "l_quantity").sum([0], 1), spark, d, ["k", "s"])


@_query("agg_count", "SELECT l_suppkey AS k, COUNT(*) AS n FROM lineitem GROUP BY 1")
def _(spark, d):
    return _run(scan("lineitem", "l_suppkey").count([0]), spark, d, ["k", "n"])


@_query("agg_composite", "SELECT l_returnflag AS a, l_linestatus AS b, COUNT(*) AS n FROM lineitem GROUP BY 1, 2")
def _(spark, d):
    return _run(scan("lineitem", "l_returnflag", "l_linestatus").count([0, 1]), spark, d, ["a", "b", "n"])


@_query("agg_global_nokey", "SELECT CAST(SUM(l_partkey) AS BIGINT) AS s FROM lineitem")
def _(spark, d):
    return _run(scan("lineitem", "l_partkey").sum([], 0), spark, d, ["s"])


@_query("agg_empty_nokey", "SELECT CAST(SUM(l_partkey) AS BIGINT) AS s FROM lineitem WHERE l_partkey < 0 HAVING COUNT(*) > 0")
def _(spark, d):
    return _run(scan("lineitem", "l_partkey").filter(0, "<", "0").sum([], 0), spark, d, ["s"])


@_query("agg_partial_final", "SELECT l_partkey AS k, COUNT(*) AS n FROM lineitem GROUP BY 1")
def _(spark, d):
    return _run(scan("lineitem", "l_partkey").count([0]).merge(4).sum([0], 1), spark, d, ["k", "n"])


@_query("agg_thread_partials", "SELECT l_linenumber % 2 AS g, l_returnflag AS k, COUNT(*) AS n FROM lineitem GROUP BY 1, 2")
def _(spark, d):
    """Two threads read a file each; their partial counts stay apart below the merge."""
    lines = table(spark, f"{d}/lineitem.parquet")
    tables = {f"l{i}": lines.where(f"l_linenumber % 2 = {i}").select("l_returnflag") for i in (0, 1)}
    flow = Flow.source("partitionedscan", files=["l0", "l1"]).count([0]).op("threadidprepend").merge(2)
    return _run(flow, spark, d, ["g", "k", "n"], tables=tables)


def _sorts() -> None:
    for name, asc in (("asc", True), ("desc", False)):
        way = "ASC" if asc else "DESC"

        def f(spark, d, asc=asc):
            flow = scan("lineitem", "l_quantity", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").sort([0, 1, 2, 3, 4], asc, 100)
            return _run(flow, spark, d, ["q", "o", "p", "s", "n"])

        _query(f"sort_limit_{name}", f"""SELECT l_quantity AS q, l_orderkey AS o, l_partkey AS p, l_suppkey AS s, l_linenumber AS n FROM lineitem
            ORDER BY {', '.join(f'{i} {way}' for i in range(1, 6))} LIMIT 100""")(f)


_sorts()


@_query("partition_exactrange", """SELECT CAST((o_orderkey - lo) // ((hi - lo + 4) // 4) AS INTEGER) AS b, o_orderkey AS k
    FROM orders, (SELECT MIN(o_orderkey) AS lo, MAX(o_orderkey) AS hi FROM orders)""")
def _(spark, d):
    low, high = table(spark, f"{d}/orders.parquet").agg(F.min("o_orderkey"), F.max("o_orderkey")).first()
    flow = scan("orders", "o_orderkey").op("partition", attr=0, range=[low, high], buckets=4, sort="yes").op("threadidprepend")
    return _run(flow, spark, d, ["b", "k"])


def _hashes() -> None:
    size = 1024
    every = {
        "modulo": ({}, "k & 1023"),
        "parammodulo": ({"offset": 5, "skipbits": 3}, f"((k - 5) & {(size - 1) << 3}) >> 3"),
        "knuth": ({"skipbits": 2}, f"((k * 2654435761) & {(size - 1) << 2}) >> 2"),
        "range": ({"range": [0, 9999999]}, "(k << 10) // 10000000"),
        "exactrange": ({"range": [0, 9999999]}, "k // ((9999999 + 1024) // 1024)"),
        "tpchorderkey": ({}, "(((k >> 2) & ~7::BIGINT) | (k & 7)) & 1023"),
        "alwayszero": ({}, "0::BIGINT"),
    }
    for fn, (settings, sql) in every.items():

        def f(spark, d, fn=fn, settings=settings):
            op = column_map(lambda df: F.col("c0"), lambda df: hash_column({"fn": fn, "buckets": 1000 if fn != "exactrange" else size, **settings}, F.col("c0")))
            return _run(scan("orders", "o_orderkey").op("h"), spark, d, ["k", "h"], {"h": op})

        _query(f"hash_{fn}", f"SELECT k, CAST({sql} AS BIGINT) AS h FROM (SELECT o_orderkey AS k FROM orders)")(f)


_hashes()


@_query("shuffle", "SELECT CAST((o_custkey & 7) % 3 AS INTEGER) AS h, o_orderkey AS k, o_custkey AS c FROM orders")
def _(spark, d):
    flow = scan("orders", "o_orderkey", "o_custkey").op("shuffle", hash={"fn": "modulo", "buckets": 8, "field": 1}, destIPs=["a", "b", "c"]).op("threadidprepend")
    return _run(flow, spark, d, ["h", "k", "c"])


@_query("merge_union", "SELECT r_regionkey AS k, r_name AS n FROM region UNION ALL SELECT r_regionkey, r_name FROM region")
def _(spark, d):
    flow = Flow.source("partitionedscan", filetype="parquet", files=["region.parquet"] * 2, columns=["r_regionkey", "r_name"])
    return _run(flow.merge(2), spark, d, ["k", "n"])


@_query("threadid", "SELECT t AS t, r_name AS n FROM region, (VALUES (0), (1)) x(t)")
def _(spark, d):
    flow = Flow.source("parallelscan", filetype="parquet", files=["region.parquet"] * 2, mapping=[[0], [1]], columns=["r_name"])
    return _run(flow.op("threadidprepend").merge(2), spark, d, ["t", "n"])


@_query("bitentropy", """SELECT 0 AS t, CAST(b AS INTEGER) AS b, SUM(1 - ((o_custkey >> b) & 1))::BIGINT AS z, SUM((o_custkey >> b) & 1)::BIGINT AS o
    FROM orders, (SELECT UNNEST(generate_series(0, 63)) AS b) GROUP BY b""")
def _(spark, d):
    return _run(scan("orders", "o_custkey").op("printer_bitentropy", field=0), spark, d, ["t", "b", "z", "o"])


@_query("consumer_xor", """SELECT CAST(x - CASE WHEN x >= 2147483648 THEN 4294967296 ELSE 0 END AS INTEGER) AS x FROM
    (SELECT bit_xor(xor(xor(o_orderkey & 4294967295, o_orderkey >> 32), xor(o_custkey & 4294967295, o_custkey >> 32))) AS x FROM orders)""")
def _(spark, d):
    return _run(scan("orders", "o_orderkey", "o_custkey").op("consumer"), spark, d, ["x"])


@_query("generator_int", "SELECT CAST(r AS INTEGER) AS k FROM (SELECT UNNEST(generate_series(1, 16384)) AS r), (VALUES (0), (1)) t(x)")
def _(spark, d):
    return _run(Flow.source("generator_int", sizeinmb=1, width=64).merge(2).project(0), spark, d, ["k"])


@_query("rowrange_slice", """SELECT event_id AS e FROM (SELECT event_id, ROW_NUMBER() OVER (ORDER BY event_id) - 1 AS r, COUNT(*) OVER () AS n FROM events)
    WHERE r >= 2 * (n // 7) AND r < 3 * (n // 7)""")
def _(spark, d):
    return _run(Flow.source("hdf5scan", file="events.parquet", pick=["/e/event_id"], order=["event_id"], totalpartitions=7, thispartition=2), spark, d, ["e"])


@_query("random_lookup", "SELECT 500::BIGINT AS draws, 500::BIGINT AS known FROM (SELECT COUNT(*) AS n FROM events) WHERE n > 0")
def _(spark, d):
    """Draws with replacement: how many there are, and how many of them are events."""
    drawn = _run(Flow.source("hdf5random", file="events.parquet", pick=["event_id"], order=["event_id"], randomlookups=500), spark, d, ["e"])
    events = table(spark, f"{d}/events.parquet").select(F.col("event_id").alias("e"), F.lit(1).alias("there"))
    return drawn.join(events, "e", "left").agg(F.count(F.lit(1)).alias("draws"), F.count("there").alias("known"))


@_query("udaf_fold", "SELECT o_custkey AS k, MIN(o_orderkey) AS lo, MAX(o_orderkey) AS hi FROM orders GROUP BY 1")
def _(spark, d):
    op = column_fold(["c0"], lambda df: F.min("c1"), lambda df: F.max("c1"))
    return _run(scan("orders", "o_custkey", "o_orderkey").op("span"), spark, d, ["k", "lo", "hi"], {"span": op})


@_query("map_one_to_many", "SELECT l_orderkey AS k, l_linenumber AS n FROM lineitem, (SELECT UNNEST(generate_series(1, 7)) AS i) WHERE i <= l_linenumber % 3")
def _(spark, d):
    """Each row as often as its line number leaves over 3: none, one or two rows out for one in."""
    op = row_map(lambda rows: rows.loc[rows.index.repeat(rows["c1"] % 3)], "c0 long, c1 int")
    return _run(scan("lineitem", "l_orderkey", "l_linenumber").op("copies"), spark, d, ["k", "n"], {"copies": op})


@_query("agg_global", "SELECT l_suppkey AS k, CAST(SUM(l_linenumber) AS BIGINT) AS s FROM lineitem GROUP BY 1")
def _(spark, d):
    """Two reading threads share one aggregate: no partial sums below the merge."""
    lines = table(spark, f"{d}/lineitem.parquet").select("l_suppkey", "l_linenumber", "l_orderkey")
    tables = {f"l{i}": lines.where(f"l_orderkey % 2 = {i}").drop("l_orderkey") for i in (0, 1)}
    flow = Flow.source("partitionedscan", files=["l0", "l1"]).sum([0], 1, threads=2, **{"global": True}).merge(2)
    return _run(flow, spark, d, ["k", "s"], tables=tables)


@_query("preprejoin_threads", """SELECT l_orderkey AS k, l_linenumber AS n, o_custkey AS c FROM lineitem JOIN orders
    ON l_orderkey = o_orderkey AND (l_linenumber % 2) = (o_orderkey % 2)""")
def _(spark, d):
    """One group of two threads: this join still meets only what the same thread reads."""
    lines, orders = table(spark, f"{d}/lineitem.parquet"), table(spark, f"{d}/orders.parquet")
    tables = {f"l{i}": lines.where(f"l_linenumber % 2 = {i}").select("l_orderkey", "l_linenumber") for i in (0, 1)}
    tables |= {f"o{i}": orders.where(f"o_orderkey % 2 = {i}").select("o_orderkey", "o_custkey") for i in (0, 1)}
    probe, build = Flow.source("partitionedscan", files=["l0", "l1"]), Flow.source("partitionedscan", files=["o0", "o1"])
    flow = probe.join(build, 0, 0, ["P$0", "P$1", "B$1"], "preprejoin", threadgroups=[[0, 1]])
    return _run(flow.merge(2), spark, d, ["k", "n", "c"], tables=tables)


@_query("group_sizes", "SELECT n AS rows_in_group, COUNT(*) AS n_groups FROM (SELECT COUNT(*) AS n FROM lineitem GROUP BY l_suppkey) GROUP BY 1")
def _(spark, d):
    return group_sizes(of(table(spark, f"{d}/lineitem.parquet").select("l_suppkey")), [0]).df.toDF("rows_in_group", "n_groups")


def _text_scans() -> None:
    for name, codec in (("text_scan", "none"), ("bzip2_scan", "bzip2")):

        def f(spark, d, name=name, codec=codec):
            """The table written as delimited text, and scanned."""
            lines = table(spark, f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag", F.date_format("l_shipdate", "yyyy-MM-dd"))
            path = fresh(spark, name)
            lines.select(F.concat_ws("|", *[F.col(c).cast("string") for c in lines.columns]).alias("value")).write.option("compression", codec).text(path)
            flow = Flow.source("scan", file=path, filetype="text", schema=["long", "int", "dec", "char(1)", "date(%Y-%m-%d)"], separators="|")
            return flow.compile(spark).df.toDF("k", "n", "p", "f", "s")

        _query(name, "SELECT l_orderkey AS k, CAST(l_linenumber AS INTEGER) AS n, l_extendedprice AS p, l_returnflag AS f, CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP) AS s FROM lineitem")(f)


_text_scans()


@_query("binary_scan", "SELECT CAST(n_nationkey AS INTEGER) AS k, CAST(n_regionkey AS BIGINT) AS r, n_name AS n FROM nation")
def _(spark, d):
    """The 25 nations packed into two files, and scanned by a pattern."""
    schema = ["int", "long", "char(25)"]
    fields, path = [parse_type(t) for t in schema], fresh(spark, "binary_scan")
    rows = pack(table(spark, f"{d}/nation.parquet").selectExpr("CAST(n_nationkey AS INT)", "CAST(n_regionkey AS BIGINT)", "n_name").toArrow().combine_chunks().to_batches()[0], fields)
    for i in (0, 1):
        at, fs = file_system(spark, f"{path}/part{i}")
        out = fs.create(at)
        out.write(bytearray(rows[i::2].tobytes()))
        out.close()
    return Flow.source("scan", file=f"{path}/part*", schema=schema).compile(spark).df.toDF("k", "r", "n")


@_query("segment_roundtrip", "SELECT o_custkey AS k, COUNT(*) AS n FROM orders GROUP BY 1")
def _(spark, d):
    """Counts written to segments under two paths in turn, and scanned from both."""
    paths = [fresh(spark, "a"), fresh(spark, "b")]
    scan("orders", "o_custkey").count([0]).op("shmwriter", size=1 << 20, paths=paths, policy="round-robin", numanodes=[0, 1]).compile(spark, path=_at(d)).run()
    return Flow.source("partitionedscan", filetype="parquet", files=paths).merge(2).compile(spark).df.toDF("k", "n")


@_query("hash_tpchq1magic", """SELECT l_returnflag AS f, l_linestatus AS s, CAST((((ascii(l_returnflag) >> 4) | ascii(l_linestatus)) & 1) | ((ascii(l_returnflag) >> 1) & 2) AS BIGINT) AS h
    FROM lineitem""")
def _(spark, d):
    op = column_map(lambda df: F.col("c0"), lambda df: F.col("c1"), lambda df: hash_column({"fn": "tpchq1magic"}, F.col("c0"), F.col("c1")))
    return _run(scan("lineitem", "l_returnflag", "l_linestatus").op("h"), spark, d, ["f", "s", "h"], {"h": op})


@_query("hash_passes", """SELECT k, CAST(((k - 5) >> 10) & 7 AS BIGINT) AS a, CAST(((k - 5) >> 7) & 7 AS BIGINT) AS b, CAST(((k - 5) >> 3) & 15 AS BIGINT) AS c
    FROM (SELECT o_orderkey AS k FROM orders)""")
def _(spark, d):
    specs = passes({"fn": "parammodulo", "buckets": 1024, "offset": 5, "skipbits": 3}, 3)
    op = column_map(lambda df: F.col("c0"), *[lambda df, s=s: hash_column(s, F.col("c0")) for s in specs])
    return _run(scan("orders", "o_orderkey").op("h"), spark, d, ["k", "a", "b", "c"], {"h": op})


@_query("instrumented", "SELECT n_name AS n FROM nation WHERE n_regionkey = 1")
def _(spark, d):
    flow = scan("nation", "n_name", "n_regionkey").op("checker_callstate").op("printer_schema").op("printer_tuplecount").filter(1, "=", "1").op("printer_callcount").op("printer_perfcount").op("cycle_accountant")
    return _run(flow.project(0), spark, d, ["n"])


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
