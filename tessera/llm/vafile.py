"""Exact top-k inner-product search with vector-approximation files.

Vectors become integers, floor(scale * x). Each dimension's range over the corpus is cut into 2^bits cells; a vector's
approximation is its cell numbers, one byte a dimension. For a query q the cells bound the inner product from both sides
(per dimension the corner of the cell with the greater or the smaller product).

1. Scan the approximations, block by block: the k-th greatest lower bound of a query is a floor under its k-th score. What
   lies below by its upper bound is out. The blocks' survivors meet, and the floor over all of them leaves fewer.
2. Read the exact vectors of those that are left, the only ones that may be among the k best, and rank their scores. Ties
   go to the smaller id.

Scale: the search is the stated query set against all rows. Candidates are dealt to blocks of about ``block`` rows, queries to
groups of about ``query_block``; a task holds one block and one group, and what travels to each group are the one-byte
cells. Exact vectors move once, to the survivors. Equal vectors beyond the first k + 1 ids can't be in an answer and are
out before the search, so one vector that a third of all rows hold is a few rows. Nothing is broadcast but the ranges of
the dimensions (one row for each length of vector).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import store

_FOUND = "query_id long, vec_id long, vh long, lower double, upper double"


def _matrix(col: pa.ChunkedArray, dim: int) -> np.ndarray:
    values = col.combine_chunks()
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    return values.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def bounds(cells: np.ndarray, low: np.ndarray, width: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds (queries x rows) of inner products with vectors of which only the cells are known."""
    lo = low + cells.astype(np.float64) * width
    hi = lo + (width - 1)
    q = queries.astype(np.float64)
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    lower, upper = up @ lo.T + down @ hi.T, up @ hi.T + down @ lo.T
    most = np.maximum(np.abs(lo), np.abs(hi))
    # Sums of integers are exact below 2^53; above, the bounds are widened by more than the rounding.
    if lo.size and q.size and float(np.abs(q).max()) * float(most.max()) * lo.shape[1] >= 2**52:
        wide = 1e-9 * (np.abs(q) @ most.T)
        lower, upper = lower - wide, upper + wide
    return lower, upper


def survivors(ids: np.ndarray, qid: int, lower: np.ndarray, upper: np.ndarray, k: int) -> np.ndarray:
    """The rows that may be among the k best for a query, which isn't its own candidate."""
    other = np.flatnonzero(ids != qid)
    if len(other) <= k:
        return other
    low, up = lower[other], upper[other]
    floor = np.partition(low, len(low) - k)[len(low) - k]
    # Of rows that are the floor exactly, k smaller ids beat a greater one, and all that can at most reach the floor.
    sure = np.sort(ids[other[(low == floor) & (up == floor)]])
    last = sure[k - 1] if len(sure) >= k else None
    keep = up >= floor
    if last is not None:
        keep &= (up > floor) | (ids[other] <= last)
    return other[keep]


def top_k(vectors: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, scale: float = 256, block: int = 20_000, query_block: int = 5_000, bits: int = 8) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best other rows by integer inner product.

    ``is_query`` is a boolean column over ``vectors``. Rows whose vector is null, or holds a null, NaN or infinity, and
    rows with a null id take no part; vectors are compared with those of their own length. Rows with the query's id are
    its own. Repeated candidates are candidates of their own; of query rows with one id, the one with the least vector
    asks. Fewer than k candidates give fewer rows. Integers and scores must fit a long. Other columns are not read.
    """
    if not 1 <= bits <= 8:
        raise ValueError("a cell number takes one byte")
    v = F.col(vector_col).cast("array<double>")
    fit = F.col(id_col).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = F.transform(v, lambda x: F.floor(x * F.lit(float(scale))).cast("long"))
    d = vectors.where(F.coalesce(fit, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), whole.alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    # Equal rows are one row with a count; an answer holds k of them at most.
    d = store(d.groupBy("id", "v").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("n"), F.max("q").alias("q")).withColumn("dim", F.size("v")), "vectors")
    # Per dimension the least and the greatest value, per length of vector: a row for each length and place.
    edges = d.select("dim", F.posexplode("v").alias("at", "x")).groupBy("dim", "at").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    width = F.greatest(F.lit(1), F.ceil((F.col("hi") - F.col("lo") + 1) / F.lit(1 << bits))).cast("long").alias("w")
    edges = edges.select("dim", "at", "lo", width).groupBy("dim").agg(F.sort_array(F.collect_list(F.struct("at", "lo", "w"))).alias("e")).select("dim", "e.lo", "e.w")
    first = W.partitionBy("v").orderBy("id")
    cands = d.withColumn("place", F.row_number().over(first)).where(F.col("place") <= k + 1).withColumn("vh", F.xxhash64("v"))
    cands = store(cands.select("id", "vh", "v", "n", "dim"), "candidates")
    asked = d.where("q").groupBy("id").agg(F.min(F.struct("v", "dim")).alias("s")).select("id", "s.dim", "s.v")
    asked = store(asked, "queries")
    blocks, groups = max(1, -(-cands.count() // block)), max(1, -(-asked.count() // query_block))

    def cell(x, i):
        up = x - F.get("lo", i)
        return (F.least((up - up % F.get("w", i)) / F.get("w", i), F.lit((1 << bits) - 1)) - 128).cast("byte")

    cells = F.when(F.col("dim") > 0, F.transform("v", cell)).otherwise(F.array().cast("array<tinyint>"))
    spread = cands.join(F.broadcast(edges), "dim", "left").select(F.col("dim").alias("cdim"), F.pmod("vh", F.lit(blocks)).alias("cb"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("cg"), F.col("id").alias("cid"), F.col("vh").alias("ch"), cells.alias("cells"))
    sent = asked.join(F.broadcast(edges), "dim", "left").select(F.col("dim").alias("qdim"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("qb"), F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("qg"), F.col("id").alias("qid"), F.col("v").alias("qv"), "lo", "w")

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        dim, out = key[0].as_py(), []
        if left.num_rows and right.num_rows:
            ids, hashes = left.column("cid").to_numpy(), left.column("ch").to_numpy()
            low, width = (_matrix(right.column(c).slice(0, 1), dim)[0] if dim else np.zeros(0) for c in ("lo", "w"))
            table = _matrix(left.column("cells"), dim).astype(np.int16) + 128 if dim else np.zeros((len(ids), 0))
            queries = _matrix(right.column("qv"), dim) if dim else np.zeros((right.num_rows, 0))
            qids = right.column("qid").to_numpy()
            for i in range(0, len(qids), 64):
                lower, upper = bounds(table, low, width, queries[i : i + 64])
                for j in range(len(lower)):
                    rows = survivors(ids, int(qids[i + j]), lower[j], upper[j], k)
                    out.append((np.full(len(rows), qids[i + j]), ids[rows], hashes[rows], lower[j][rows], upper[j][rows]))
        cols = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0)] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.table([pa.array(x.astype(np.int64) if t == pa.int64() else x, t) for x, t in zip(cols, kinds, strict=True)], ["query_id", "vec_id", "vh", "lower", "upper"])

    found = spread.groupBy("cdim", "cb", "cg").cogroup(sent.groupBy("qdim", "qb", "qg")).applyInArrow(run, _FOUND)
    by_lower = W.partitionBy("query_id").orderBy(F.desc("lower"), "vec_id", "vh")
    found = found.withColumn("kth", F.row_number().over(by_lower))
    floor = F.max(F.when(F.col("kth") == k, F.col("lower"))).over(W.partitionBy("query_id"))
    left = found.withColumn("floor", floor).where(F.col("floor").isNull() | (F.col("upper") >= F.col("floor"))).select("query_id", "vec_id", "vh")
    exact = left.join(cands.select(F.col("id").alias("vec_id"), "vh", "v", "n"), ["vec_id", "vh"]).join(asked.select(F.col("id").alias("query_id"), F.col("v").alias("qv")), "query_id")
    score = F.aggregate(F.zip_with("v", "qv", lambda a, b: a * b), F.lit(0).cast("long"), lambda s, x: s + x)
    scored = exact.select("query_id", "vec_id", score.alias("score"), F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_va_file_top_k(spark, sf_dir: str) -> DataFrame:
    """The five best rows for each embedding whose vec_id is divisible by 50."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


QUERIES = {"op9_va_file_top_k": op9_va_file_top_k}
#: Plain exact search; NULLs and non-finite components take no part.
ORACLE_SQL = {
    "op9_va_file_top_k": """
WITH fit AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS score
  FROM (SELECT * FROM fit WHERE vec_id % 50 = 0) q JOIN fit c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rk FROM scored
)
SELECT query_id, CAST(rk AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM ranked WHERE rk <= 5
"""
}
