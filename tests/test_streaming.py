"""A plan over a stream gives what the same plan gives over a table."""

from millrace import streaming
from millrace.plans.flow import Flow


def test_a_plan_runs_over_a_stream(spark, tmp_path):
    rows = [(i, i % 3) for i in range(1, 41)]
    for part in range(4):
        spark.createDataFrame(rows[part::4], "k long, v long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k long, v long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    names = spark.createDataFrame([(0, "none"), (1, "one"), (2, "two")], "v long, name string")
    flow = Flow.source("scan", file="numbers").filter(0, "<", 31).join(Flow.source("scan", file="names"), 0, 1, ["P$0", "B$1"])
    of = lambda numbers: flow.compile(spark, tables={"numbers": numbers, "names": names})
    query = streaming.run(of(stream), str(tmp_path / "check"), "joined")
    query.awaitTermination(60)
    got = sorted(tuple(r) for r in spark.table("joined").collect())
    assert got == sorted(tuple(r) for r in of(spark.createDataFrame(rows, "k long, v long")).df.collect()) and len(got) == 30
    query = streaming.run(Flow.source("scan", file="numbers").sum([1], 0).compile(spark, tables={"numbers": stream}), str(tmp_path / "check2"), "sums", "complete")
    query.awaitTermination(60)
    assert dict(tuple(r) for r in spark.table("sums").collect()) == {v: sum(k for k, w in rows if w == v) for v in range(3)}
