"""Matrices of the driver's tables, and the same in DuckDB SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.clusterers import BasicCoclusterer
from ..session import table
from ..sources.matrix import CoMatrix


def nation_brand(spark: SparkSession, sf: str) -> CoMatrix:
    """Quantity by the customer's nation and the part's brand."""
    t = lambda n, *c: table(spark, sf, n).select(*c)
    d = t("lineitem", "l_orderkey", "l_partkey", "l_quantity").join(t("orders", F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    d = d.join(t("customer", F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey").join(t("part", F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    return CoMatrix.from_table(d, "c_nationkey", "p_brand", "l_quantity")


def user_event(spark: SparkSession, sf: str, ordered: bool = False) -> CoMatrix:
    """Value by user and event type; ``ordered`` sums each cell in the order of its events."""
    return CoMatrix.from_table(table(spark, sf, "events"), "user_id", "event_type", "value", "event_id" if ordered else None)


def cust_part(spark: SparkSession, sf: str) -> CoMatrix:
    """Quantity by customer and part: sparse; keys are indices as they stand."""
    t = lambda n, *c: table(spark, sf, n).select(*c)
    d = t("lineitem", "l_orderkey", "l_partkey", "l_quantity").join(t("orders", F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    d = d.groupBy(F.col("o_custkey").alias("i"), F.col("l_partkey").alias("j")).agg(F.sum("l_quantity").alias("v"))
    n, m = (table(spark, sf, x).agg(F.max(k)).first()[0] for x, k in (("customer", "c_custkey"), ("part", "p_partkey")))
    return CoMatrix.from_coo(d, n + 1, m + 1)


def embedding_matrix(spark: SparkSession, sf: str) -> tuple[CoMatrix, DataFrame]:
    """Embeddings shifted by one, so not negative, and the labels (i, label)."""
    e = table(spark, sf, "embeddings")
    n = e.agg(F.max("vec_id")).first()[0] + 1
    m = CoMatrix.from_rows(e.select("vec_id", F.transform("embedding", lambda x: x.cast("double") + 1).alias("x")), "vec_id", "x", n, 64)
    return m, e.select(F.col("vec_id").alias("i"), F.col("label").cast("long").alias("label"))


def basic_blocks(m: CoMatrix, k: int = 3) -> DataFrame:
    return BasicCoclusterer(k).cluster(m)


NB = """nb_cells AS (
  SELECT c_nationkey AS r, p_brand AS c, sum(l_quantity) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2
), nb AS (SELECT dense_rank() OVER (ORDER BY r) - 1 AS i, dense_rank() OVER (ORDER BY c) - 1 AS j, CAST(v AS DOUBLE) AS v FROM nb_cells),
nb_shape AS (SELECT max(i) + 1 AS n, max(j) + 1 AS m FROM nb)"""
UE = """ue_cells AS (SELECT user_id AS r, event_type AS c, sum(value) AS v FROM events GROUP BY 1, 2),
ue AS (SELECT dense_rank() OVER (ORDER BY r) - 1 AS i, dense_rank() OVER (ORDER BY c) - 1 AS j, CAST(v AS DOUBLE) AS v FROM ue_cells),
ue_shape AS (SELECT max(i) + 1 AS n, max(j) + 1 AS m FROM ue)"""
CP = """cp AS (SELECT o_custkey AS i, l_partkey AS j, CAST(sum(l_quantity) AS DOUBLE) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
cp_shape AS (SELECT (SELECT max(c_custkey) + 1 FROM customer) AS n, (SELECT max(p_partkey) + 1 FROM part) AS m)"""


def blocks_sql(m: str, k: int = 3) -> str:
    """Members of k contiguous blocks: bk (cid, a, b, c, d half-open), bi (cid, i), bj (cid, j)."""
    return f"""bk AS (
  SELECT k AS cid, k * n // {k} AS a, (k + 1) * n // {k} AS b, k * m // {k} AS c, (k + 1) * m // {k} AS d FROM range({k}) t(k), {m}_shape
  WHERE (k + 1) * n // {k} - k * n // {k} >= 3 AND (k + 1) * m // {k} - k * m // {k} >= 3
), bi AS (SELECT cid, unnest(range(a, b)) AS i FROM bk), bj AS (SELECT cid, unnest(range(c, d)) AS j FROM bk),
bc AS (SELECT cid, i, j, coalesce(v, 0) AS v FROM bi JOIN bj USING (cid) LEFT JOIN {m} USING (i, j))"""


PEARSON = """rp AS (SELECT x.cid, x.i AS p, y.i AS q, count(*) AS n, sum(x.v) AS sx, sum(y.v) AS sy, sum(x.v * x.v) AS xx, sum(y.v * y.v) AS yy, sum(x.v * y.v) AS xy
  FROM bc x JOIN bc y ON x.cid = y.cid AND x.j = y.j AND x.i < y.i GROUP BY ALL),
cq AS (SELECT x.cid, x.j AS p, y.j AS q, count(*) AS n, sum(x.v) AS sx, sum(y.v) AS sy, sum(x.v * x.v) AS xx, sum(y.v * y.v) AS yy, sum(x.v * y.v) AS xy
  FROM bc x JOIN bc y ON x.cid = y.cid AND x.i = y.i AND x.j < y.j GROUP BY ALL),
pearson AS (SELECT cid, avg(CASE WHEN xx - sx * sx / n <= 1e-12 * xx OR yy - sy * sy / n <= 1e-12 * yy THEN 0
  ELSE abs(xy - sx * sy / n) / sqrt((xx - sx * sx / n) * (yy - sy * sy / n)) END) AS score FROM (SELECT * FROM rp UNION ALL SELECT * FROM cq) GROUP BY cid)"""
EXPONENTIAL = "exponential AS (SELECT cid, 50 * ln(avg(exp(v / 50))) AS score FROM bc GROUP BY cid)"
COMPATIBILITY = """vr AS (SELECT cid, avg(x) AS x FROM (SELECT cid, i, var_pop(v) AS x FROM bc GROUP BY ALL) GROUP BY cid),
vc AS (SELECT cid, avg(x) AS y FROM (SELECT cid, j, var_pop(v) AS x FROM bc GROUP BY ALL) GROUP BY cid),
compatibility AS (SELECT cid, 0.5 * (1 / (1 + x / 1000) + 1 / (1 + y / 2000)) AS score FROM vr JOIN vc USING (cid))"""
