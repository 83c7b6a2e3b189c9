import os

import duckdb
import pytest

from millrace.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())


def test_links_of_the_sql_are_there_to_be_found(spark):
    """The vectors of the small tables have few links; here are many, and the same SQL."""
    import numpy as np

    from millrace.llm.vector_dedup import near_duplicates

    rng = np.random.default_rng(6)
    base = rng.standard_normal((30, 16))
    x = base[rng.integers(0, 30, 300)] + 0.15 * rng.standard_normal((300, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(400, [0.0] * 16), (401, None), (402, [1.0, None]), (403, [float("inf")] + [0.0] * 15)]
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", rows)
    want = con.sql(queries.oracle_sql()["op9_vector_dedup"])
    got = near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), recall=1 - 1e-6)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())
    assert sum(r[1] for r in want.fetchall()) > 1000
