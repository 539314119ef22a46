import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import vafile as V

SCHEMA = "vec_id long, embedding array<double>, score string, rank string"


def brute(rows, k=5):
    fit = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    asked = {}
    for i, v in fit:
        if i % 50 == 0 and (i not in asked or v < asked[i]):
            asked[i] = v
    for i, q in asked.items():
        s = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in fit if j != i and len(v) == len(q))
        out += [(i, n + 1, j, -x) for n, (x, j) in enumerate(s[:k])]
    return sorted(out)


@pytest.mark.parametrize("factor", [1, 1e6])
def test_against_brute_force(spark, factor):
    r = random.Random(7)
    rows = [(i, [r.gauss(0, 0.3) * factor for _ in range(12)]) for i in range(400)]
    rows += [(i, rows[3][1]) for i in range(500, 530)]
    rows += [(1000, None), (1050, [None] * 12), (1001, [math.nan] * 12), (1002, [math.inf] * 12), (None, rows[0][1]), (7, rows[7][1]), (1100, [0.0] * 12), (1150, [1.0, 2.0]), (1003, [-1.0, 0.5])]
    df = spark.createDataFrame([(i, v, "", "") for i, v in rows], SCHEMA)
    for block, group in ((20_000, 5_000), (50, 3)):
        got = V.top_k(df, F.col("vec_id") % 50 == 0, block=block, query_block=group).collect()
        assert sorted((x.query_id, x.rank, x.vec_id, x.score) for x in got) == brute(rows)


def test_empty(spark):
    assert V.top_k(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 50 == 0).count() == 0


def test_oracle(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = con.execute(V.ORACLE_SQL["op9_va_file_top_k"]).fetchall()
    got = V.op9_va_file_top_k(spark, sf).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == sorted(want)
