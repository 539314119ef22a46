"""The registered queries of the engine and the SQL that each is held against.

A query takes (spark, sf_dir). Doubles are rounded, as engines sum in different orders.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import elementwise as E
from ..functions import linalg as L
from ..functions import metrics as X
from ..functions import text as T
from ..operators import atoms as A
from ..operators import partition as P
from ..operators.clusterers import BasicCoclusterer, LocalModel, SpectralCocluster, SVDClusterer, cross_coclusters
from ..operators.divide_merge import DivideMerge
from ..operators.global_nmf import GlobalFnmf, GlobalTriFactor, argmax_last
from ..operators.merge import MergeConfig, adaptive_score, greedy_overlap, merge_intersection, merge_tree, merge_union, overlap_pairs, union_dc, vote_labels, weighted_score
from ..operators.scoring import CompatibilityScorer, CompositeScorer, ExponentialScorer, PearsonScorer, rank_one_score, singular_values
from ..session import shared_path, table
from ..sources import files
from ..sources import synthetic as S
from ..sources.matrix import CoMatrix
from .inputs import COMPATIBILITY, CP, EXPONENTIAL, NB, PEARSON, UE, basic_blocks, blocks_sql, cust_part, embedding_matrix, nation_brand, user_event
from .pipeline import Pipeline, PipelineConfig, StandardPipeline, filter_and_rank, score_stats
from .sqlmat import SqlMatrix, tri_step

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return keep


def r(c, n: int = 6):
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, n)


def coo(d: DataFrame, n: int = 6) -> DataFrame:
    return d.select("i", "j", r("v", n).alias("v"))


def scalar(spark, **values) -> DataFrame:
    """One row of driver-side results."""
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])


# -- matrices -----------------------------------------------------------------------------------------------------------


@query("matrix_coo", f"WITH {UE} SELECT i, j, round(v, 6) AS v FROM ue")
def matrix_coo(spark, sf):
    return coo(user_event(spark, sf).df)


@query("matrix_slice", f"WITH {NB} SELECT i - 5 AS i, j - 3 AS j, round(v, 6) AS v FROM nb WHERE i >= 5 AND i < 15 AND j >= 3 AND j < 10")
def matrix_slice(spark, sf):
    return coo(nation_brand(spark, sf).slice((5, 15), (3, 10)).df)


@query("matrix_fancy_index", f"WITH {NB}, a(x, i) AS (VALUES (0, 7), (1, 2), (2, 7), (3, 19)), b(y, j) AS (VALUES (0, 4), (1, 0), (2, 23)) SELECT CAST(x AS BIGINT) AS i, CAST(y AS BIGINT) AS j, round(v, 6) AS v FROM nb JOIN a USING (i) JOIN b USING (j)")
def matrix_fancy_index(spark, sf):
    return coo(nation_brand(spark, sf).take([7, 2, 7, 19], [4, 0, 23]).df)


@query("matrix_transpose_overlay", f"WITH {NB} SELECT j AS i, i AS j, CASE WHEN i = 0 AND j = 1 THEN -1 ELSE round(v, 6) END AS v FROM nb")
def matrix_transpose_overlay(spark, sf):
    return coo(nation_brand(spark, sf).transpose().overlay(spark.range(1).select(F.lit(1).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), F.lit(-1.0).alias("v"))).df)


@query("dense_fill", f"WITH {UE} SELECT i, j, coalesce(round(v, 6), 0) AS v FROM (SELECT * FROM (SELECT DISTINCT i FROM ue), (SELECT DISTINCT j FROM ue)) LEFT JOIN ue USING (i, j)")
def dense_fill(spark, sf):
    return coo(user_event(spark, sf).dense().df)


@query("matrix_corner", f"WITH {CP} SELECT i, j, round(v, 6) AS v FROM cp WHERE i < 60 AND j < 80")
def matrix_corner(spark, sf):
    """The operator's own limit: the top-left part."""
    return coo(cust_part(spark, sf).corner(60, 80).df)


@query("matrix_get", f"WITH {NB} SELECT round((SELECT v FROM nb WHERE i = 3 AND j = 4), 6) AS inside, CAST(NULL AS DOUBLE) AS outside")
def matrix_get(spark, sf):
    m = nation_brand(spark, sf)
    return spark.createDataFrame([(m.get(3, 4), m.get(m.n_rows, 0))], "inside double, outside double").select(r("inside").alias("inside"), "outside")


def _refuses(f) -> bool:
    try:
        f()
    except ValueError:
        return True
    return False


@query("non_negative", f"WITH {NB} SELECT min(v) < 0 AS plain, min(v - 100) < 0 AS shifted FROM nb")
def non_negative(spark, sf):
    """Whether the check refuses the matrix, as it is and less 100."""
    m = nation_brand(spark, sf)
    return scalar(spark, plain=_refuses(lambda: E.check_non_negative(m)), shifted=_refuses(lambda: E.check_non_negative(m.with_df(m.df.withColumn("v", F.col("v") - 100)))))


@query("parquet_round_trip", f"WITH {CP} SELECT i, j, round(v, 6) AS v FROM cp")
def parquet_round_trip(spark, sf):
    m, path = cust_part(spark, sf), shared_path(spark, "matrix")
    files.write_parquet(m, path)
    return coo(files.read_parquet(spark, path, m.n_rows, m.n_cols).df)


@query("matrix_market_round_trip", f"WITH {CP} SELECT i, j, round(v, 6) AS v FROM cp")
def matrix_market_round_trip(spark, sf):
    m, path = cust_part(spark, sf), shared_path(spark, "market")
    files.write_matrix_market(m, path)
    return coo(files.read_matrix_market(spark, [path + "/0-header", path + "/1-entries"]).df)


@query("csv_round_trip", f"WITH {NB} SELECT a.i, b.j, coalesce(round(v, 6), 0) AS v FROM (SELECT DISTINCT i FROM nb) a, (SELECT DISTINCT j FROM nb) b LEFT JOIN nb ON nb.i = a.i AND nb.j = b.j")
def csv_round_trip(spark, sf):
    """Dense rows as lines of a CSV file, read by position."""
    m, path = nation_brand(spark, sf), shared_path(spark, "csv")
    rows = m.row_vectors().select("i", *[F.col("x")[k].alias(f"c{k}") for k in range(m.n_cols)])
    rows.coalesce(1).sortWithinPartitions("i").drop("i").write.csv(path, header=True)
    return coo(files.read_csv(spark, path, m.n_cols).dense().df)


@query("coclusters_json_round_trip", f"WITH {NB}, {blocks_sql('nb')} SELECT cid, b - a AS n_rows, d - c AS n_cols, a AS first_row, d - 1 AS last_col FROM bk")
def coclusters_json_round_trip(spark, sf):
    path = shared_path(spark, "json")
    files.write_coclusters_json(basic_blocks(nation_brand(spark, sf)), path)
    d = spark.read.json(path)
    return d.select("cid", *[F.size(c).cast("long").alias(n) for c, n in (("row_indices", "n_rows"), ("col_indices", "n_cols"))], F.array_min("row_indices").alias("first_row"), F.array_max("col_indices").alias("last_col"))


@query("printed_rows", f"WITH {UE}, d AS (SELECT a.i, b.j, coalesce(v, 0) AS v FROM (SELECT DISTINCT i FROM ue) a, (SELECT DISTINCT j FROM ue) b LEFT JOIN ue ON ue.i = a.i AND ue.j = b.j) SELECT i, string_agg(format('{{:,.4f}}', round(v, 4)), ' ' ORDER BY j) AS line FROM d GROUP BY i")
def printed_rows(spark, sf):
    m = user_event(spark, sf)
    return files.display(m.with_df(m.df.withColumn("v", F.round("v", 4))))


@query("row_vectors", f"WITH {UE} SELECT i, string_agg(CAST(CAST(round(v, 0) AS BIGINT) AS VARCHAR), ',' ORDER BY j) AS line FROM (SELECT i, j, coalesce(v, 0) AS v FROM (SELECT DISTINCT ue.i, b.j FROM ue, range(5) b(j)) LEFT JOIN ue USING (i, j)) GROUP BY i")
def row_vectors(spark, sf):
    """Whole numbers: sums of cents often end in .5, where the last bit of a sum decides, so cells are summed in order."""
    return user_event(spark, sf, ordered=True).row_vectors().select("i", F.array_join(F.transform("x", lambda v: F.round(v, 0).cast("long").cast("string")), ",").alias("line"))


@query("density", f"WITH {CP} SELECT count(*) FILTER (abs(v) > 1e-15) AS nnz, round(count(*) FILTER (abs(v) > 1e-15) / any_value(n * m), 9) AS density, round(1 - count(*) FILTER (abs(v) > 1e-15) / any_value(n * m), 9) AS sparsity FROM cp, cp_shape")
def density(spark, sf):
    return E.density(cust_part(spark, sf)).select("nnz", r("density", 9).alias("density"), r("sparsity", 9).alias("sparsity"))


@query("zscore", f"WITH {UE}, s AS (SELECT sum(v) / any_value(n * m) AS mean, sqrt((sum(v * v) - sum(v) * sum(v) / any_value(n * m)) / (any_value(n * m) - 1)) AS sd, any_value(n) AS n, any_value(m) AS m FROM ue, ue_shape) SELECT a.i, b.j, round((coalesce(v, 0) - mean) / sd, 5) AS v FROM s, (SELECT DISTINCT i FROM ue) a, (SELECT DISTINCT j FROM ue) b LEFT JOIN ue ON ue.i = a.i AND ue.j = b.j")
def zscore(spark, sf):
    return coo(E.zscore(user_event(spark, sf)).df, 5)


@query("log1p_fill", f"WITH {UE} SELECT i, j, round(ln(1 + v), 6) AS v FROM ue")
def log1p_fill(spark, sf):
    return coo(E.log1p_fill(user_event(spark, sf)).df)


@query("global_normalize", f"WITH {NB} SELECT i, j, round(v / (sum(v) OVER () + 1e-16), 9) AS v FROM nb")
def global_normalize(spark, sf):
    return coo(E.global_normalize(nation_brand(spark, sf)).df, 9)


@query("row_col_sums", f"WITH {NB} SELECT i, j, round(sum(v), 4) AS total FROM nb GROUP BY GROUPING SETS ((i), (j), ())")
def row_col_sums(spark, sf):
    return E.row_col_sums(nation_brand(spark, sf)).select("i", "j", r("total", 4).alias("total"))


_BN = "bn AS (SELECT i, j, v / sqrt(sum(v) OVER (PARTITION BY i)) / sqrt(sum(v) OVER (PARTITION BY j)) AS v FROM nb)"


@query("binormalize", f"WITH {NB}, {_BN} SELECT i, j, round(v, 8) AS v FROM bn")
def binormalize(spark, sf):
    return coo(E.binormalize(nation_brand(spark, sf)).df, 8)


@query("row_l2_normalize", f"WITH {CP} SELECT i, j, round(v / sqrt(sum(v * v) OVER (PARTITION BY i)), 8) AS v FROM cp")
def row_l2_normalize(spark, sf):
    return coo(E.row_l2_normalize(cust_part(spark, sf)).df, 8)


@query("zero_strip", f"WITH {CP}, c AS (SELECT * FROM cp WHERE abs(v) > 1e-15) SELECT dense_rank() OVER (ORDER BY i) - 1 AS i, dense_rank() OVER (ORDER BY j) - 1 AS j, round(v, 6) AS v FROM c")
def zero_strip(spark, sf):
    return coo(E.strip_zeros(cust_part(spark, sf))[0].df)


@query("column_norms", f"WITH {NB} SELECT j, round(sum(abs(v)), 4) AS l1, round(sqrt(sum(v * v)), 4) AS l2 FROM nb GROUP BY j")
def column_norms(spark, sf):
    m = nation_brand(spark, sf)
    return E.column_norms(m, 1).select("j", r("norm", 4).alias("l1")).join(E.column_norms(m, 2).select("j", r("norm", 4).alias("l2")), "j")


@query("membership_normalize", f"WITH {UE} SELECT i, j, round(v / sum(v) OVER (PARTITION BY i), 8) AS v FROM ue")
def membership_normalize(spark, sf):
    return coo(E.normalize_membership(user_event(spark, sf)).df, 8)


@query("bipartite_laplacian", f"""WITH {NB}, a AS (SELECT i, j + 25 AS j, v FROM nb UNION ALL SELECT j + 25, i, v FROM nb), d AS (SELECT i, sum(v) AS d FROM a GROUP BY i)
SELECT a.i, a.j, round(v / sqrt(x.d * y.d), 8) AS v FROM a JOIN d x ON a.i = x.i JOIN d y ON a.j = y.i""")
def bipartite_laplacian(spark, sf):
    return coo(L.bipartite_laplacian(nation_brand(spark, sf)).df, 8)


@query("synthetic_planted", """SELECT i, j, round(CAST(CAST('0x' || substr(md5('0:' || i || ':' || j), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496 + CASE WHEN least(i // 16, 2) = least(j // 13, 2) THEN 2 ELSE 0 END, 9) AS v FROM range(50) a(i), range(40) b(j)""")
def synthetic_planted(spark, sf):
    return coo(S.planted(spark, 50, 40, 3).df, 9)


@query("synthetic_block_diagonal", "SELECT i, j, CASE WHEN i // 10 = j // 10 THEN 5.0 ELSE 0.1 END::DOUBLE AS v FROM range(20) a(i), range(20) b(j)")
def synthetic_block_diagonal(spark, sf):
    return coo(S.block_diagonal(spark).df)


@query("labels_from_sizes", "WITH s AS (SELECT CAST(p_size AS BIGINT) AS label, count(*) AS n FROM part GROUP BY 1), o AS (SELECT *, coalesce(sum(n) OVER (ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM s) SELECT CAST(unnest(range(CAST(a AS BIGINT), CAST(a + n AS BIGINT))) AS BIGINT) AS i, label FROM o")
def labels_from_sizes(spark, sf):
    return S.labels_from_sizes(table(spark, sf, "part").groupBy(F.col("p_size").cast("long").alias("label")).agg(F.count("*").alias("size")))


# -- linear algebra -------------------------------------------------------------------------------------------------------


@query("matmul_gram", f"""WITH {NB}, g AS (SELECT j, a, 1 + ((j * 7 + a * 3) % 5) / 5 AS v FROM range(25) t(j), range(3) u(a)),
xg AS (SELECT i, a, sum(nb.v * g.v) AS v FROM nb JOIN g USING (j) GROUP BY ALL)
SELECT 'xg' AS what, i AS r, a AS c, round(v, 4) AS v FROM xg UNION ALL SELECT 'gram', p.a, q.a, round(sum(p.v * q.v), 4) FROM g p JOIN g q USING (j) GROUP BY p.a, q.a""")
def matmul_gram(spark, sf):
    m = nation_brand(spark, sf)
    g = _start(spark, 25, 3)
    xg = L.to_long(L.matmul(m, g, 3)).select(F.lit("xg").alias("what"), F.col("i").alias("r"), F.col("a").cast("long").alias("c"), r("v", 4).alias("v"))
    gr = L.gram(g, 3)
    return xg.unionAll(spark.createDataFrame([("gram", a, b, round(float(gr[a, b]), 4)) for a in range(3) for b in range(3)], "what string, r long, c long, v double"))


def _start(spark, n: int, k: int) -> DataFrame:
    """A fixed factor: 1 + ((i * 7 + a * 3) mod 5) / 5."""
    return spark.range(n).select(F.col("id").alias("i"), F.array(*[1 + ((F.col("id") * 7 + a * 3) % 5) / 5 for a in range(k)]).alias("x"))


def _steps(kind: str, w: float):
    def run(spark, sf):
        m = nation_brand(spark, sf)
        scaled = m.with_df(m.df.select("i", "j", (F.col("v") / 1000).alias("v")))
        f, s, g = GlobalTriFactor(kind, 3, 2, tau=w, eta=w, gamma=w).step(scaled, _start(spark, 25, 3), np.array([[2.0, 1.0], [1.0, 2.0], [1.0, 1.0]]), _start(spark, 25, 2))
        side = lambda x, name: L.to_long(x).select(F.lit(name).alias("what"), F.col("i").alias("r"), F.col("a").cast("long").alias("c"), r("v").alias("v"))
        mid = spark.createDataFrame([("S", a, b, float(s[a, b])) for a in range(3) for b in range(2)], "what string, r long, c long, v double")
        return side(f, "F").unionAll(side(g, "G")).unionAll(mid.withColumn("v", r("v")))

    m = SqlMatrix(NB, "x AS (SELECT i AS r, j AS c, v / 1000 AS v FROM nb)", "f AS (SELECT i AS r, a AS c, 1 + ((i * 7 + a * 3) % 5) / 5 AS v FROM range(25) t(i), range(3) u(a))", "g AS (SELECT i AS r, a AS c, 1 + ((i * 7 + a * 3) % 5) / 5 AS v FROM range(25) t(i), range(2) u(a))", "s AS (SELECT CAST(a AS BIGINT) AS r, CAST(b AS BIGINT) AS c, CAST(CASE WHEN a = b THEN 2 ELSE 1 END AS DOUBLE) AS v FROM range(3) t(a), range(2) u(b))")
    f, s, g = tri_step(m, kind, "x", "f", "s", "g", w)
    query(f"{kind}_step", m.query(" UNION ALL ".join(f"SELECT '{n}' AS what, r, c, round(v, 6) AS v FROM {t}" for n, t in (("F", f), ("G", g), ("S", s)))))(run)


for _kind, _w in (("nbvd", 0.0), ("onm3f", 0.0), ("onmtf", 0.0), ("pnmtf", 0.1)):
    _steps(_kind, _w)


def _error_sql() -> str:
    m = SqlMatrix(NB, "x AS (SELECT i AS r, j AS c, v FROM nb)", "f AS (SELECT i AS r, a AS c, 1 + ((i * 7 + a * 3) % 5) / 5 AS v FROM range(25) t(i), range(3) u(a))", "g AS (SELECT i AS r, a AS c, 1 + ((i * 7 + a * 3) % 5) / 5 AS v FROM range(25) t(i), range(2) u(a))", "s AS (SELECT CAST(a AS BIGINT) AS r, CAST(b AS BIGINT) AS c, CAST(CASE WHEN a = b THEN 2 ELSE 1 END AS DOUBLE) AS v FROM range(3) t(a), range(2) u(b))")
    y = m.mul(m.mul("f", "s"), m.t("g"))
    return m.query(f"SELECT round(sum((coalesce(x.v, 0) - y.v) * (coalesce(x.v, 0) - y.v)) / 1e6, 4) AS error, (SELECT round(sum(t * t) - sum(q), 4) FROM (SELECT sum(v) AS t, sum(v * v) AS q FROM f GROUP BY r)) AS penalty FROM {y} y LEFT JOIN x USING (r, c)")


@query("reconstruction_error", _error_sql())
def reconstruction_error(spark, sf):
    m = nation_brand(spark, sf)
    f = _start(spark, 25, 3)
    e = L.reconstruction_error(m, f, np.array([[2.0, 1.0], [1.0, 2.0], [1.0, 1.0]]), _start(spark, 25, 2))
    return scalar(spark, error=round(e / 1e6, 4), penalty=round(L.orthogonality_penalty(f), 4))


@query("argmax_labels", "SELECT i, max_by(a, struct_pack(v := v, a := a)) AS label FROM (SELECT i, a, (i * 7 + a * 3) % 5 AS v FROM range(25) t(i), range(6) u(a)) GROUP BY i")
def argmax_labels(spark, sf):
    return _start(spark, 25, 6).select("i", argmax_last("x").alias("label"))


@query("power_iteration_sigma1", f"WITH {NB} SELECT i, round(sqrt(sum(v) / (SELECT sum(v) FROM nb)), 6) AS u, CAST(1.0 AS DOUBLE) AS sigma FROM nb GROUP BY i")
def power_iteration_sigma1(spark, sf):
    """The first singular pair of a bi-normalised non-negative matrix: sigma 1, u the square roots of the row shares."""
    u, s, _ = L.randomized_svd(E.binormalize(nation_brand(spark, sf)), 3)
    return u.select("i", r(F.abs(F.col("x")[0])).alias("u"), F.lit(round(float(s[0]), 6)).alias("sigma"))


@query("randomized_svd_residual", "SELECT true AS orthonormal, true AS diagonal, true AS ordered")
def randomized_svd_residual(spark, sf):
    """Checks on the factors: orthonormal sides, a diagonal middle, falling values."""
    m = nation_brand(spark, sf)
    u, s, v = L.randomized_svd(m, 4)
    mid = L.inner(u, L.matmul(m, v, len(s)), len(s), len(s))
    ok = np.allclose(L.gram(u, len(s)), np.eye(len(s)), atol=1e-6) and np.allclose(L.gram(v, len(s)), np.eye(len(s)), atol=1e-6)
    return scalar(spark, orthonormal=bool(ok), diagonal=bool(np.allclose(mid, np.diag(s), atol=1e-3 * s[0])), ordered=bool((np.diff(s) <= 0).all()))


@query("sign_partition", "SELECT 0.1 AS threshold, true AS all_assigned, true AS padded")
def sign_partition(spark, sf):
    m = nation_brand(spark, sf)
    p = P.sign_partition(m, P.PartitionParams(1, 100, 0.05, 4, (2, 2)))
    return scalar(spark, threshold=round(p.threshold, 6), all_assigned=len({i for a, _ in p.blocks for i in a}) == m.n_rows, padded=len(p.blocks) >= 4)


@query("nnls_columns", "SELECT CAST(j AS BIGINT) AS i, a, CAST((j * 3 + a) % 4 AS DOUBLE) AS v FROM range(30) t(j), range(4) u(a)")
def nnls_columns(spark, sf):
    """min ||A x - b|| with x >= 0, for columns built from known non-negative answers."""
    from ..operators.global_nmf import nnls_columns as solve

    a = np.array([[1.0, 2, 0, 1], [0, 1, 3, 1], [2, 0, 1, 0], [1, 1, 1, 4], [0, 2, 1, 1]])
    ata = a.T @ a
    x = [((F.col("id") * 3 + k) % 4).cast("double") for k in range(4)]
    atb = spark.range(30).select(F.col("id").alias("i"), F.array(*[sum((F.lit(float(ata[p, k])) * x[k] for k in range(4)), F.lit(0.0)) for p in range(4)]).alias("x"))
    return L.to_long(solve(ata, atb)).select("i", F.col("a").cast("long").alias("a"), (r("v", 5) + 0.0).alias("v"))


# -- co-clusters and scores -----------------------------------------------------------------------------------------------


def _members(c: DataFrame) -> DataFrame:
    row = c.select("cid", F.lit("row").alias("axis"), F.explode("row_indices").alias("idx"))
    return row.unionAll(c.select("cid", F.lit("col"), F.explode("col_indices")))


@query("basic_coclusters", f"WITH {NB}, {blocks_sql('nb', 4)} SELECT cid, 'row' AS axis, i AS idx FROM bi UNION ALL SELECT cid, 'col', j FROM bj")
def basic_coclusters(spark, sf):
    return _members(BasicCoclusterer(4).cluster(nation_brand(spark, sf)))


@query("label_cross_product", f"""WITH {NB} SELECT DISTINCT (a.i % 3) * 2 + b.j % 2 AS cid, axis, idx FROM (SELECT DISTINCT i FROM nb) a, (SELECT DISTINCT j FROM nb) b, LATERAL (VALUES ('row', a.i), ('col', b.j)) x(axis, idx)""")
def label_cross_product(spark, sf):
    m = nation_brand(spark, sf)
    rows = spark.range(m.n_rows).select(F.lit("row").alias("axis"), F.col("id").alias("idx"), (F.col("id") % 3).alias("label"))
    return _members(cross_coclusters(rows.unionAll(spark.range(m.n_cols).select(F.lit("col"), "id", F.col("id") % 2))))


def _scored(name: str, scorer, sql: str, source=nation_brand, m: str = "nb", cte: str = NB, digits: int = 6) -> None:
    def run(spark, sf):
        x = source(spark, sf)
        return scorer.score(basic_blocks(x), x).select("cid", r("score", digits).alias("score"))

    query(name, f"WITH {cte}, {blocks_sql(m)}, {sql}")(run)


_scored("score_pearson", PearsonScorer(), f"{PEARSON} SELECT cid, round(score, 6) AS score FROM pearson")
_scored("score_exponential", ExponentialScorer(50.0), f"{EXPONENTIAL} SELECT cid, round(score, 4) AS score FROM exponential", digits=4)
_scored("score_compatibility", CompatibilityScorer(1000.0, 2000.0), f"{COMPATIBILITY} SELECT cid, round(score, 6) AS score FROM compatibility")
_scored("score_composite", CompositeScorer([(PearsonScorer(), 2.0), (CompatibilityScorer(1000.0, 2000.0), 1.0)]), f"{PEARSON}, {COMPATIBILITY} SELECT cid, round((2 * pearson.score + compatibility.score) / 3, 6) AS score FROM pearson JOIN compatibility USING (cid)")


@query("sigma_ratio", "SELECT 3 AS n, true AS above_one")
def sigma_ratio(spark, sf):
    m = nation_brand(spark, sf)
    return rank_one_score(basic_blocks(m), m).agg(F.count("*").cast("int").alias("n"), F.bool_and(F.col("score") >= 1).alias("above_one"))


@query("submatrix_frobenius", f"WITH {NB}, {blocks_sql('nb')} SELECT cid, round(sum(v * v), 2) AS total FROM bc GROUP BY cid")
def submatrix_frobenius(spark, sf):
    """Squared singular values of a block sum to its squared norm."""
    m = nation_brand(spark, sf)
    return singular_values(basic_blocks(m), m).select("cid", r(F.aggregate("sigma", F.lit(0.0), lambda a, x: a + x * x), 2).alias("total"))


_PIPE = f"WITH {NB}, {blocks_sql('nb', 5)}, {PEARSON}, kept AS (SELECT cid, score, (SELECT b - a FROM bk WHERE bk.cid = pearson.cid) AS n_rows FROM pearson WHERE score >= 0.1 ORDER BY score DESC, cid LIMIT 3)"


def _ranked(spark, sf) -> DataFrame:
    m = nation_brand(spark, sf)
    c = basic_blocks(m, 5)
    scored = c.drop("score").join(PearsonScorer().score(c, m), "cid").select("cid", "row_indices", "col_indices", "score")
    return filter_and_rank(scored, PipelineConfig(min_score=0.1, max_submatrices=3))


@query("pipeline_filter_topk", f"{_PIPE} SELECT cid, round(score, 6) AS score, n_rows FROM kept")
def pipeline_filter_topk(spark, sf):
    return _ranked(spark, sf).select("cid", r("score").alias("score"), F.size("row_indices").cast("long").alias("n_rows"))


@query("pipeline_stats", f"{_PIPE} SELECT count(*) AS count, round(min(score), 6) AS min, round(max(score), 6) AS max, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std FROM kept")
def pipeline_stats(spark, sf):
    return score_stats(_ranked(spark, sf)).select("count", *[r(c).alias(c) for c in ("min", "max", "mean", "std")])


@query("pipeline_builder", f"WITH {NB}, {blocks_sql('nb')}, {EXPONENTIAL} SELECT cid, round(score, 6) AS score, 3::BIGINT AS found, 3::BIGINT AS plain FROM exponential WHERE score >= 1 ORDER BY score DESC, cid LIMIT 2")
def pipeline_builder(spark, sf):
    """A built pipeline with its filter, order and limit, beside one that only clusters."""
    m = nation_brand(spark, sf)
    step = Pipeline.builder().with_clusterer(BasicCoclusterer(3)).with_scorer(ExponentialScorer(50)).min_score(1.0).max_submatrices(2).min_submatrix_size(1, 1).sort_by_score(True).build().run(m)
    plain = StandardPipeline(BasicCoclusterer(3)).run(m).count()
    return step.coclusters.select("cid", r("score").alias("score"), F.lit(step.found).cast("long").alias("found"), F.lit(plain).cast("long").alias("plain"))


@query("export_csv_rows", f"WITH {NB}, {blocks_sql('nb')} SELECT cid AS cluster_id, b - a AS n_rows, d - c AS n_cols, array_to_string(range(a, b), ';') AS rows, array_to_string(range(c, d), ';') AS cols FROM bk")
def export_csv_rows(spark, sf):
    return files.export_rows(basic_blocks(nation_brand(spark, sf))).select("cluster_id", F.col("n_rows").cast("long").alias("n_rows"), F.col("n_cols").cast("long").alias("n_cols"), "rows", "cols")


# -- partitions and merges ---------------------------------------------------------------------------------------------------


def _groups_sql(n: str, groups: int, seed: int, axis: str) -> str:
    return f"(SELECT idx, CASE WHEN k < (n // {groups} + 1) * (n % {groups}) THEN k // (n // {groups} + 1) ELSE n % {groups} + (k - (n // {groups} + 1) * (n % {groups})) // (n // {groups}) END AS g FROM (SELECT idx, n, row_number() OVER (ORDER BY md5('{seed}:{axis}:' || idx), idx) - 1 AS k FROM (SELECT {n} AS n), LATERAL (SELECT unnest(range({n})) AS idx)))"


@query("random_blocks", f"WITH {CP} SELECT 'row' AS axis, idx, g FROM {_groups_sql('(SELECT n FROM cp_shape)', 7, 11, 'row')} UNION ALL SELECT 'col', idx, g FROM {_groups_sql('(SELECT m FROM cp_shape)', 3, 11, 'col')}")
def random_blocks(spark, sf):
    m = cust_part(spark, sf)
    rows, cols, _ = P.random_blocks(spark, m.n_rows, m.n_cols, 7, 3, 11)
    return rows.select(F.lit("row").alias("axis"), "idx", "g").unionAll(cols.select(F.lit("col"), "idx", "g"))


@query("block_sizes", f"WITH {CP} SELECT rb, cb, count(*) AS cells, round(sum(v), 4) AS total FROM cp JOIN (SELECT idx AS i, g AS rb FROM {_groups_sql('(SELECT n FROM cp_shape)', 4, 5, 'row')}) USING (i) JOIN (SELECT idx AS j, g AS cb FROM {_groups_sql('(SELECT m FROM cp_shape)', 2, 5, 'col')}) USING (j) GROUP BY rb, cb")
def block_sizes(spark, sf):
    m = cust_part(spark, sf)
    rows, cols, _ = P.random_blocks(spark, m.n_rows, m.n_cols, 4, 2, 5)
    return P.extract(m, rows, cols).groupBy("rb", "cb").agg(F.count("*").alias("cells"), r(F.sum("v"), 4).alias("total"))


@query("grid_heuristics", "SELECT n, greatest(2, CAST(ceil(sqrt(n / 50)) AS INTEGER)) AS grid, CAST(pow(2, ceil(log2(greatest(n / 100, 4)))) AS INTEGER) AS adaptive, CAST(ceil(sqrt(n)) AS INTEGER) AS explicit, CASE WHEN n > 10000 THEN '8x1' ELSE '2x2' END AS wide, CASE WHEN n > 4999 THEN '8x1' ELSE '2x2' END AS sparse FROM (VALUES (50), (200), (500), (5000), (100000)) t(n)")
def grid_heuristics(spark, sf):
    name = lambda g: f"{g[0]}x{g[1]}"
    rows = [(n, P.block_grid(n), P.adaptive_partitions(n), P.explicit_grid(n)[0], name(P.grid_for(n)), name(P.grid_for(n, 1 - 240 / n))) for n in (50, 200, 500, 5000, 100000)]
    return spark.createDataFrame(rows, "n int, grid int, adaptive int, explicit int, wide string, sparse string")


def _sets(spark, sf, which: int) -> DataFrame:
    """Two partitions of all customers with orders, with the months of their orders: by nation; and by region, with the
    nations of region 0 on their own (so some co-clusters are equal on both sides): (pos, cid, row_indices, col_indices)."""
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_nationkey") if which == 0 else F.when(F.col("n_regionkey") == 0, F.col("c_nationkey")).otherwise(25 + F.col("n_regionkey"))
    d = table(spark, sf, "orders").join(c.select("c_custkey", k.cast("long").alias("k")), F.col("o_custkey") == F.col("c_custkey"))
    d = d.groupBy("k").agg(F.sort_array(F.collect_set("o_custkey")).alias("row_indices"), F.sort_array(F.collect_set(F.month("o_orderdate").cast("long"))).alias("col_indices"))
    return d.select(F.col("k").alias("pos"), F.col("k").alias("cid"), "row_indices", "col_indices")


def _sets_sql() -> str:
    one = lambda name, k: f"{name} AS (SELECT CAST({k} AS BIGINT) AS cid, list_sort(list(DISTINCT o_custkey)) AS rs, list_sort(list(DISTINCT CAST(month(o_orderdate) AS BIGINT))) AS cs FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)"
    return f"{one('lhs', 'c_nationkey')}, {one('rhs', 'CASE WHEN n_regionkey = 0 THEN c_nationkey ELSE 25 + n_regionkey END')}, ov AS (SELECT l.cid AS lid, r.cid AS rid, sqrt(len(list_intersect(l.rs, r.rs)) / len(list_distinct(l.rs || r.rs)) * len(list_intersect(l.cs, r.cs)) / len(list_distinct(l.cs || r.cs))) AS o, l.rs, l.cs FROM lhs l, rhs r)"


@query("overlap_matrix", f"WITH {_sets_sql()} SELECT lid, rid, round(o, 8) AS overlap FROM ov WHERE o > 0")
def overlap_matrix(spark, sf):
    return overlap_pairs(_sets(spark, sf, 0), _sets(spark, sf, 1)).select("lid", "rid", r("overlap", 8).alias("overlap"))


@query("merge_union", f"WITH {_sets_sql()}, u AS (SELECT rs, cs FROM lhs UNION ALL SELECT rs, cs FROM rhs) SELECT count(*) AS kept, round(count(*) / (SELECT count(*) FROM u), 8) AS score, CAST(sum(len(rs)) AS BIGINT) AS members FROM (SELECT DISTINCT rs, cs FROM u)")
def merge_union_q(spark, sf):
    kept, s = merge_union(*[_sets(spark, sf, k).select("pos", "row_indices", "col_indices") for k in (0, 1)])
    return kept.agg(F.sum(F.size("row_indices")).alias("members")).crossJoin(s).select("kept", r("score", 8).alias("score"), "members")


@query("merge_intersection", f"WITH {_sets_sql()} SELECT lid, rid, len(rs) AS n_rows FROM ov WHERE o >= 0.3")
def merge_intersection_q(spark, sf):
    return merge_intersection(_sets(spark, sf, 0), _sets(spark, sf, 1), 0.3)[0].select("lid", "rid", F.size("row_indices").cast("long").alias("n_rows"))


@query("merge_intersection_score", f"WITH {_sets_sql()} SELECT count(*) FILTER (o >= 0.3) AS kept, round(avg(o), 8) AS score FROM ov")
def merge_intersection_score(spark, sf):
    return merge_intersection(_sets(spark, sf, 0), _sets(spark, sf, 1), 0.3)[1].select("kept", r("score", 8).alias("score"))


@query("merge_weighted_adaptive", "SELECT l, r, round(.7 * l + .3 * r, 6) AS weighted, round(CASE WHEN l / greatest(r, 1) > .5 AND l / greatest(r, 1) < 2 THEN 1.0 WHEN l > r THEN .7 * l + .3 * r ELSE .3 * l + .7 * r END, 6) AS adaptive FROM (SELECT a * 3 AS l, b * 2 AS r FROM range(5) x(a), range(6) y(b)) WHERE l + r > 0")
def merge_weighted_adaptive(spark, sf):
    d = spark.range(30).select((F.expr("id div 6") * 3).alias("l"), (F.col("id") % 6 * 2).alias("r")).where("l + r > 0")
    return d.select("l", "r", r(weighted_score(F.col("l"), F.col("r"), 0.7, 0.3)).alias("weighted"), r(adaptive_score(F.col("l"), F.col("r"), F.col("l") + F.col("r"))).alias("adaptive"))


@query("merge_rounds", f"""WITH {_sets_sql()}, l0 AS (SELECT 0 AS node, rs, cs FROM lhs WHERE cid < 5 UNION ALL SELECT 1, rs, cs FROM rhs UNION ALL SELECT 2, rs, cs FROM lhs WHERE cid >= 5),
l1 AS (SELECT DISTINCT node // 2 AS node, rs, cs FROM l0), l2 AS (SELECT DISTINCT node // 2 AS node, rs, cs FROM l1),
s1 AS (SELECT n.node, coalesce((SELECT count(*) FROM l1 WHERE l1.node = n.node) / nullif((SELECT count(*) FROM l0 WHERE l0.node // 2 = n.node), 0), 0) AS s FROM (VALUES (0), (1)) n(node)),
s2 AS (SELECT (SELECT count(*) FROM l2) / (SELECT count(*) FROM l1) AS s)
SELECT 0 AS round, (SELECT count(*) FROM l0) AS num_clusters, 0.0::DOUBLE AS avg_merge_score, 0::BIGINT AS num_merges
UNION ALL SELECT 1, (SELECT count(*) FROM l1), round((SELECT avg(s) FROM s1), 8), 2 UNION ALL SELECT 2, (SELECT count(*) FROM l2), round((SELECT s FROM s2), 8), 1""")
def merge_rounds(spark, sf):
    a, b = (_sets(spark, sf, k) for k in (0, 1))
    leaf = lambda d, n: d.select(F.lit(n).cast("long").alias("node"), "pos", "row_indices", "col_indices")
    leaves = leaf(a.where("cid < 5"), 0).unionAll(leaf(b, 1)).unionAll(leaf(a.where("cid >= 5"), 2))
    return merge_tree(leaves, 3, MergeConfig("union"))[1].select("round", "num_clusters", r("avg_merge_score", 8).alias("avg_merge_score"), "num_merges")


@query("union_dc_fold", "SELECT CAST(sum(x) AS BIGINT) AS total, 1::BIGINT AS items FROM (VALUES (3), (5), (1), (5), (6), (7), (8), (9), (0), (1), (2), (3), (4), (5), (6), (7), (8), (9)) t(x)")
def union_dc_fold(spark, sf):
    out = union_dc([3, 5, 1, 5, 6, 7, 8, 9, 0, 1, 2, 3, 4, 5, 6, 7, 8, 9], lambda a, b: a + b, lambda q: len(q) < 2)
    return spark.createDataFrame([(out[0], len(out))], "total long, items long")


@query("vote_merge", "SELECT o_custkey AS i, label FROM (SELECT o_custkey, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS label, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, substr(o_orderpriority, 1, 1)) AS rk FROM orders GROUP BY o_custkey, substr(o_orderpriority, 1, 1)) WHERE rk = 1")
def vote_merge(spark, sf):
    return vote_labels(table(spark, sf, "orders").select(F.col("o_custkey").alias("i"), F.substring("o_orderpriority", 1, 1).cast("long").alias("label")))


@query("greedy_overlap_merge", "SELECT i, CAST(CASE WHEN i % 6 < 3 THEN 0 ELSE 1 END AS BIGINT) AS label FROM range(60) t(i)")
def greedy_overlap_merge(spark, sf):
    """Six co-clusters, of which 0-2 share rows and 3-5 share others, merged to two."""
    d = spark.range(60).select(F.col("id").alias("i"), (F.col("id") % 6).alias("c"))
    near = F.when(F.col("c") < 3, (F.col("c") + 1) % 3).otherwise(3 + (F.col("c") + 1) % 3)
    return greedy_overlap(d.select("i", F.explode(F.array("c", near)).alias("cid")), 2)


# -- metrics and checks --------------------------------------------------------------------------------------------------------


_LAB = "lab AS (SELECT l_linenumber AS t, CASE WHEN l_returnflag = 'A' THEN 0 WHEN l_returnflag = 'N' THEN 1 ELSE 2 END + 3 * (l_linenumber // 4) AS p FROM lineitem)"


def _labels(spark, sf) -> DataFrame:
    flag = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("t"), (flag + 3 * F.expr("l_linenumber div 4").cast("int")).alias("p"))


@query("contingency", f"WITH {_LAB} SELECT CAST(t AS INTEGER) AS t, CAST(p AS INTEGER) AS p, CAST(count(*) AS DOUBLE) AS n FROM lab GROUP BY ALL")
def contingency(spark, sf):
    return X.contingency(_labels(spark, sf))


@query("nmi", f"""WITH {_LAB}, c AS (SELECT t, p, count(*) AS n FROM lab GROUP BY ALL), z AS (SELECT sum(n) AS z FROM c), a AS (SELECT t, sum(n) AS a FROM c GROUP BY t), b AS (SELECT p, sum(n) AS b FROM c GROUP BY p)
SELECT round(2 * (SELECT sum(n / z * ln(n * z / (a * b))) FROM c JOIN a USING (t) JOIN b USING (p), z) / ((SELECT -sum(a / z * ln(a / z)) FROM a, z) + (SELECT -sum(b / z * ln(b / z)) FROM b, z)), 8) AS nmi""")
def nmi(spark, sf):
    return X.nmi(_labels(spark, sf)).select(r("nmi", 8).alias("nmi"))


@query("ari", f"""WITH {_LAB}, c AS (SELECT t, p, CAST(count(*) AS DOUBLE) AS n FROM lab GROUP BY ALL), x AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS s, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY t)) AS a, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY p)) AS b, (SELECT sum(n) FROM c) AS n)
SELECT round((s - a * b / (n * (n - 1) / 2)) / (0.5 * (a + b) - a * b / (n * (n - 1) / 2)), 8) AS ari FROM x""")
def ari(spark, sf):
    return X.ari(_labels(spark, sf)).select(r("ari", 8).alias("ari"))


@query("label_equivalence", "SELECT true AS renamed, false AS other")
def label_equivalence(spark, sf):
    d = _labels(spark, sf)
    return X.equivalent(d.select("t", (97 - F.col("t")).alias("p"))).select(F.col("equal").alias("renamed")).crossJoin(X.equivalent(d).select(F.col("equal").alias("other")))


@query("coverage", f"WITH {_sets_sql()} SELECT round((SELECT count(DISTINCT x) FROM (SELECT unnest(rs) AS x FROM lhs)) / (SELECT count(*) FROM customer), 8) AS coverage")
def coverage(spark, sf):
    return X.coverage(_sets(spark, sf, 0), table(spark, sf, "customer").count()).select(r("coverage", 8).alias("coverage"))


@query("last_wins_labels", f"WITH {_sets_sql()} SELECT i, coalesce(max(cid), 0) AS label FROM range((SELECT max(c_custkey) + 1 FROM customer)) t(i) LEFT JOIN (SELECT cid, unnest(rs) AS i FROM lhs) USING (i) GROUP BY i")
def last_wins_labels(spark, sf):
    return X.last_wins_labels(_sets(spark, sf, 0), table(spark, sf, "customer").agg(F.max("c_custkey") + 1).first()[0])


_RUNS = "runs AS (SELECT p_brand AS method, p_size AS seed, CAST(sum(p_retailprice) AS DOUBLE) AS x FROM part GROUP BY ALL)"


def _runs(spark, sf) -> DataFrame:
    return table(spark, sf, "part").groupBy(F.col("p_brand").alias("method"), F.col("p_size").alias("seed")).agg(F.sum("p_retailprice").alias("x"))


@query("seed_mean_std", f"WITH {_RUNS} SELECT method, round(avg(x), 4) AS mean, round(coalesce(stddev_samp(x), 0), 4) AS std, round(stddev_pop(x), 4) AS std_pop, count(*) AS n FROM runs GROUP BY method")
def seed_mean_std(spark, sf):
    return X.seed_summary(_runs(spark, sf), ["method"], "x").select("method", *[r(c, 4).alias(c) for c in ("mean", "std", "std_pop")], "n")


@query("paired_t", f"WITH {_RUNS} SELECT b.method AS other, count(*) AS n, round(avg(a.x - b.x), 4) AS diff, round(avg(a.x - b.x) / (stddev_samp(a.x - b.x) / sqrt(count(*))), 6) AS t FROM runs a JOIN runs b ON a.seed = b.seed AND a.method = 'Brand#1' AND b.method <> 'Brand#1' GROUP BY 1")
def paired_t(spark, sf):
    return X.paired_t(_runs(spark, sf), "seed", "method", "x", "Brand#1").select("other", "n", r("diff", 4).alias("diff"), r("t").alias("t"))


@query("preservation", f"WITH {_sets_sql()}, b AS (SELECT lid, max(o) AS o FROM ov GROUP BY lid) SELECT count(*) AS total, count(*) FILTER (o >= 0.7) AS preserved, round(count(*) FILTER (o >= 0.7) / count(*), 8) AS ratio, count(*) FILTER (o >= 0.7) / count(*) >= 0.95 AS passed FROM b")
def preservation(spark, sf):
    return X.preservation(_sets(spark, sf, 0), _sets(spark, sf, 1)).select("total", "preserved", r("ratio", 8).alias("ratio"), "passed")


@query("complexity", "SELECT p, d, CASE WHEN p <= 1 THEN 0 ELSE CAST(ceil(log2(p)) AS INTEGER) END AS bound, d <= CASE WHEN p <= 1 THEN 0 ELSE ceil(log2(p)) END AS passed FROM (VALUES (0, 0), (1, 0), (2, 1), (40, 6), (40, 7)) t(p, d)")
def complexity(spark, sf):
    return spark.createDataFrame([(p, *X.complexity(d, p)) for p, d in ((0, 0), (1, 0), (2, 1), (40, 6), (40, 7))], "p int, d int, bound int, passed boolean")


@query("convergence_bounds", "SELECT true AS within, false AS beyond")
def convergence_bounds(spark, sf):
    return scalar(spark, within=X.convergence([1.0, 0.5, 0.25, 0.125], lambda k: 2.0**-k), beyond=X.convergence([1.0, 0.6], lambda k: 2.0**-k))


@query("spectral_gap", "SELECT CAST(1.5 AS DOUBLE) AS gap, true AS passed")
def spectral_gap(spark, sf):
    return X.spectral_gap(spark.createDataFrame(list(enumerate([10.0, 5.0, 2.0, 0.5, 0.1], 1)), "rank int, sigma double"), 3, 1.0)


# -- text and samples ------------------------------------------------------------------------------------------------------------


_TF = """tok AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS c FROM tok WHERE length(term) > 2 GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term HAVING count(*) >= 2 AND count(*) <= floor(0.8 * (SELECT count(*) FROM documents))),
tfidf AS (SELECT doc_id, term, (1 + ln(c)) * ln((SELECT count(*) FROM documents) / (1 + df)) AS v FROM tf JOIN dfs USING (term))"""


@query("tfidf", f"WITH {_TF} SELECT doc_id AS doc, term, round(v, 6) AS v FROM tfidf")
def tfidf(spark, sf):
    return T.tfidf(table(spark, sf, "documents")).select("doc", "term", r("v").alias("v"))


@query("top_variance_features", f"WITH {_TF}, n AS (SELECT count(DISTINCT doc_id) AS n FROM tfidf) SELECT term, round(sum(v * v) / n - (sum(v) / n) * (sum(v) / n), 6) AS var FROM tfidf, n GROUP BY term, n ORDER BY sum(v * v) / n - (sum(v) / n) * (sum(v) / n) DESC, term LIMIT 100")
def top_variance_features(spark, sf):
    m, _, cols = T.doc_term_matrix(table(spark, sf, "documents"))
    return T.top_variance_features(m, 100).join(cols.withColumnRenamed("idx", "j"), "j").select(F.col("key").alias("term"), r("var").alias("var"))


@query("prune_short_docs", f"WITH {CP}, s AS (SELECT i, count(*) AS nnz FROM cp WHERE v <> 0 GROUP BY i), b AS (SELECT coalesce(max(nnz), 0) AS b FROM (SELECT nnz, sum(count(*)) OVER (ORDER BY nnz DESC) AS kept FROM s GROUP BY nnz) WHERE kept >= 500) SELECT i, nnz FROM s, b WHERE nnz >= b")
def prune_short_docs(spark, sf):
    return T.prune_short(cust_part(spark, sf), 500)


_STRAT = "d AS (SELECT doc_id AS i, lang AS label, md5('3:' || doc_id) AS h FROM documents), q AS (SELECT label, floor(200.0 * count(*) / (SELECT count(*) FROM d)) AS q FROM d GROUP BY label), k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h, i) AS rn FROM d JOIN q USING (label))"


@query("stratified_sample", f"WITH {_STRAT} SELECT i, label FROM k WHERE rn <= q UNION ALL (SELECT i, label FROM (SELECT *, row_number() OVER (ORDER BY h, i) AS x FROM k WHERE rn > q) WHERE x <= 200 - (SELECT sum(q) FROM q))")
def stratified_sample(spark, sf):
    return T.stratified_sample(table(spark, sf, "documents").select("doc_id", "lang"), 200, 3, "doc_id", "lang")


@query("equal_sample", f"WITH {_STRAT} SELECT i, label FROM k WHERE rn <= 20")
def equal_sample(spark, sf):
    return T.equal_sample(table(spark, sf, "documents").select("doc_id", "lang"), 20, 3, "doc_id", "lang")


@query("single_label", "SELECT vec_id AS i, list_position(e, list_max(e)) - 1 AS label FROM (SELECT vec_id, embedding AS e FROM embeddings) WHERE list_max(e) > 0")
def single_label(spark, sf):
    return T.single_label(table(spark, sf, "embeddings"), "vec_id", "embedding")


@query("chunk_sums", f"WITH {CP} SELECT i // 100 AS chunk, count(*) AS cells, round(sum(v), 4) AS total FROM cp GROUP BY 1")
def chunk_sums(spark, sf):
    return cust_part(spark, sf).chunks(100).groupBy("chunk").agg(F.count("*").alias("cells"), r(F.sum("v"), 4).alias("total"))


@query("class_distribution", "SELECT lang AS label, count(*) AS n FROM documents GROUP BY lang")
def class_distribution(spark, sf):
    return X.class_distribution(table(spark, sf, "documents").select(F.col("lang").alias("label")))


@query("block_label_check", "SELECT true AS ok, false AS other")
def block_label_check(spark, sf):
    d = spark.range(20).select(F.col("id").alias("i"), F.expr("1 - id div 10").alias("label"))
    return X.block_labels_match(d, 10).crossJoin(X.block_labels_match(d, 9).select(F.col("ok").alias("other")))


_TIMES = "t AS (SELECT p_brand AS dataset, p_type AS method, CASE WHEN p_size <= 25 THEN 'standalone' ELSE 'divide_merge' END AS variant, p_retailprice AS seconds, p_size AS nmi FROM part)"


def _times(spark, sf) -> DataFrame:
    v = F.when(F.col("p_size") <= 25, "standalone").otherwise("divide_merge")
    return table(spark, sf, "part").select(F.col("p_brand").alias("dataset"), F.col("p_type").alias("method"), v.alias("variant"), F.col("p_retailprice").alias("seconds"), F.col("p_size").alias("nmi"))


@query("speedup_report", f"WITH {_TIMES} SELECT dataset, method, round(avg(seconds) FILTER (variant = 'standalone') / avg(seconds) FILTER (variant = 'divide_merge'), 6) AS ratio, round(avg(nmi) FILTER (variant = 'divide_merge') - avg(nmi) FILTER (variant = 'standalone'), 6) AS nmi_gain FROM t GROUP BY ALL")
def speedup_report(spark, sf):
    return X.speedup(_times(spark, sf)).select("dataset", "method", r("ratio").alias("ratio"), r("nmi_gain").alias("nmi_gain"))


@query("hierarchical_consensus", "SELECT true AS found")
def hierarchical_consensus(spark, sf):
    truth = S.planted_labels(spark, 40, 2)
    runs = [truth.select("i", F.when(F.col("i") % 13 == k, 1 - F.col("label")).otherwise(F.col("label")).alias("label")) for k in range(2)] + [truth, truth]
    lab = X.hierarchical_consensus(runs, 40, 2).join(truth.select("i", F.col("label").alias("t")), "i")
    return X.nmi(lab, "t", "label").select((F.col("nmi") > 0.5).alias("found"))


@query("sweep_top10", f"WITH {_TIMES} SELECT dataset, CAST(max(nmi) AS BIGINT) AS nmi, count(*) AS n FROM t GROUP BY dataset ORDER BY count(*) DESC, dataset LIMIT 10")
def sweep_top10(spark, sf):
    d = _times(spark, sf).groupBy("dataset").agg(F.max("nmi").cast("long").alias("nmi"), F.count("*").alias("n"))
    return X.best_runs(d, "n", 10, ["dataset"])


@query("zero_expand", "SELECT CAST(k AS BIGINT) AS i, CASE WHEN k % 3 = 0 THEN 0.0 ELSE CAST(k AS DOUBLE) END AS v FROM range(30) t(k)")
def zero_expand(spark, sf):
    """Vectors of the packed rows back at their old places, zeros between."""
    cells = spark.range(30).where("id % 3 <> 0").select(F.col("id").alias("i"), F.lit(0).cast("long").alias("j"), F.lit(1.0).alias("v"))
    packed, rows, _ = E.strip_zeros(CoMatrix(cells, 30, 1))
    vectors = rows.select(F.col("new").alias("i"), F.array(F.col("old").cast("double")).alias("x"))
    return E.expand(vectors, rows, 30, 1).select("i", F.col("x")[0].alias("v"))


# -- models: quality against planted or known truth -----------------------------------------------------------------------------------


def _agree(labels: DataFrame, truth: DataFrame) -> DataFrame:
    d = labels.where("axis = 'row'").select(F.col("idx").alias("i"), F.col("label").alias("p")).join(truth.select("i", F.col("label").alias("t")), "i")
    return X.nmi(d).select((F.col("nmi") > 0.99).alias("found"))


def _model(name: str, model) -> None:
    def run(spark, sf):
        return _agree(model.labels(S.planted(spark, 60, 40, 2, 4.0)), S.planted_labels(spark, 60, 2))

    query(name, "SELECT true AS found")(run)


_TRI = A.TriConfig(2, 2, 20, 20, 3)
for _name, _model_ in (
    ("scc_labels", SVDClusterer(2)), ("spectral_cocluster", SpectralCocluster(2, 2)), ("local_scc", LocalModel(A.Scc(2))), ("local_spectral", LocalModel(A.Spectral(2, 2))),
    ("local_nbvd", LocalModel(A.Nbvd(_TRI))), ("local_onm3f", LocalModel(A.Onm3f(_TRI))), ("local_onmtf", LocalModel(A.Onmtf(_TRI))), ("local_alpha_nmtf", LocalModel(A.Alpha(_TRI, 0.8))),
    ("fnmf_labels", LocalModel(A.Fnmf(2, 2, 50))), ("fnmf_hals_labels", LocalModel(A.Fnmf(2, 2, 50, method="hals"))), ("global_fnmf", GlobalFnmf(2, 2, 4)),
):
    _model(_name, _model_)


@query("scc_sparse", f"WITH {CP} SELECT count(DISTINCT i) AS rows_assigned, count(DISTINCT j) AS cols_assigned FROM cp WHERE v > 1e-15")
def scc_sparse(spark, sf):
    """Distributed spectral co-clustering of customers by parts: all rows and columns with a cell get a label."""
    d = SVDClusterer(4).labels(cust_part(spark, sf)).where("label is not null")
    return d.agg(F.count_if(F.col("axis") == "row").alias("rows_assigned"), F.count_if(F.col("axis") == "col").alias("cols_assigned"))


@query("local_pnmtf", "SELECT true AS found")
def local_pnmtf(spark, sf):
    return _agree(LocalModel(A.Pnmtf(_TRI, 0.1, 0.1, 0.1)).labels(S.block_diagonal(spark)), S.planted_labels(spark, 20, 2))


@query("global_nbvd", "SELECT true AS falls")
def global_nbvd(spark, sf):
    """Rounds of the distributed updates never raise the error."""
    errors = GlobalTriFactor("nbvd", 2, 2, 4).fit(S.planted(spark, 60, 40, 2, 4.0))[3]
    return scalar(spark, falls=all(b <= a + 1e-6 for a, b in zip(errors, errors[1:])))


def _divide_merge(name: str, atom, strategy: str) -> None:
    def run(spark, sf):
        m = S.planted(spark, 60, 40, 2, 4.0)
        out, stats, rounds = DivideMerge(2, atom, merge=MergeConfig(strategy), t_p=5, m_blocks=2, n_blocks=1).run(m)
        lab = X.consensus_labels(out, 60, 2).join(S.planted_labels(spark, 60, 2).select("i", F.col("label").alias("t")), "i")
        ok = X.nmi(lab, "t", "label").first()["nmi"] > 0.99
        return scalar(spark, found=bool(ok), partitions=stats.partitions, depth=stats.tree_depth, preservation=round(stats.preservation_probability, 6))

    query(name, f"SELECT true AS found, 10 AS partitions, 4 AS depth, {round(1 - math.exp(-2.5), 6)}::DOUBLE AS preservation")(run)


_divide_merge("divide_merge_scc", A.Scc(2), "adaptive")
_divide_merge("divide_merge_nbvd", A.Nbvd(A.TriConfig(2, 2, 20, 20, 3)), "union")


@query("consensus_embedding")
def consensus_embedding(spark, sf):
    """Divide and merge on embeddings, with consensus labels."""
    m, _ = embedding_matrix(spark, sf)
    out, _, _ = DivideMerge(10, A.Scc(10), t_p=4, m_blocks=2, n_blocks=1).run(m)
    return X.consensus_labels(out, m.n_rows, 10)


@query("kmeans_lloyd_steps", """WITH RECURSIVE e AS (SELECT vec_id, d AS d, CAST(embedding[d] AS DOUBLE) AS x FROM embeddings, range(1, 65) t(d)), c0 AS (SELECT vec_id AS k, d, x FROM e WHERE vec_id < 5),
a0 AS (SELECT vec_id, arg_min(k, struct_pack(q := q, k := k)) AS k FROM (SELECT e.vec_id, c.k, round(sum((e.x - c.x) * (e.x - c.x)), 10) AS q FROM e JOIN c0 c USING (d) GROUP BY ALL) GROUP BY vec_id),
c1 AS (SELECT k, d, avg(x) AS x FROM e JOIN a0 USING (vec_id) GROUP BY k, d),
a1 AS (SELECT vec_id, arg_min(k, struct_pack(q := q, k := k)) AS k FROM (SELECT e.vec_id, c.k, round(sum((e.x - c.x) * (e.x - c.x)), 10) AS q FROM e JOIN c1 c USING (d) GROUP BY ALL) GROUP BY vec_id)
SELECT vec_id, k FROM a1""")
def kmeans_lloyd_steps(spark, sf):
    """Two assignment steps of Lloyd's iteration from the first five vectors; centres are small and broadcast as literals."""
    e = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    centres = {row["vec_id"]: row["x"] for row in e.where("vec_id < 5").collect()}
    for step in range(2):
        dist = lambda c: F.round(F.aggregate(F.zip_with("x", F.array(*[F.lit(float(v)) for v in c]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v), 10)
        near = F.array_min(F.array(*[F.struct(dist(c).alias("q"), F.lit(k).cast("long").alias("k")) for k, c in sorted(centres.items())]))["k"]
        d = e.withColumn("k", near)
        if step == 0:
            centres = {row["k"]: list(row[1:]) for row in d.groupBy("k").agg(*[F.avg(F.col("x")[a]) for a in range(64)]).collect()}  # k rows
    return d.select("vec_id", "k")


def flagship(spark, sf) -> DataFrame:
    """Nation by brand: spectral co-clusters, Pearson scores, ranked."""
    m = nation_brand(spark, sf)
    c = SVDClusterer(4).cluster(m)
    scored = c.drop("score").join(PearsonScorer().score(c, m), "cid").select("cid", "row_indices", "col_indices", "score")
    return filter_and_rank(scored, PipelineConfig(min_score=0.0, min_submatrix_size=(1, 1)))


@query("flagship")
def flagship_rows(spark, sf):
    return files.export_rows(flagship(spark, sf))


