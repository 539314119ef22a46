"""Distributed linear algebra with narrow factors.

A factor has few columns (k, at most a few dozen) and is kept as (i, x array<double>). Products with the matrix are a
join on the shared index and an aggregate by the other; k x k results reach the driver, nothing else does.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.matrix import CoMatrix
from ..sources.synthetic import uniform


def factor_frame(spark: SparkSession, x: np.ndarray) -> DataFrame:
    """A driver-side factor as (i, x)."""
    return spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(np.asarray(x))], "i long, x array<double>")


def factor_numpy(f: DataFrame, n: int, k: int) -> np.ndarray:
    """A factor on the driver: for tests and small sides."""
    out = np.zeros((n, k))
    for r in f.collect():
        out[r["i"]] = r["x"]
    return out


def to_long(f: DataFrame) -> DataFrame:
    return f.select("i", F.posexplode("x").alias("a", "v"))


def to_arrays(d: DataFrame, key: str, k: int) -> DataFrame:
    """(i, x) from sums by component: k aggregates in one pass, no shuffle by component."""
    return d.groupBy(F.col(key).alias("i")).agg(F.array(*[F.coalesce(F.sum(F.col("y")[a] * F.col("v")), F.lit(0.0)) for a in range(k)]).alias("x"))


def matmul(m: CoMatrix, g: DataFrame, k: int) -> DataFrame:
    """X G as (i, x): cells join G's rows on j and sum by i (combined map-side)."""
    return to_arrays(m.df.join(g.select(F.col("i").alias("j"), F.col("x").alias("y")), "j"), "i", k)


def matmul_t(m: CoMatrix, f: DataFrame, k: int) -> DataFrame:
    """X^T F as (i, x) over columns."""
    return to_arrays(m.df.join(f.select("i", F.col("x").alias("y")), "i"), "j", k)


def inner(a: DataFrame, b: DataFrame, ka: int, kb: int) -> np.ndarray:
    """A^T B, ka x kb: one row of sums."""
    j = a.select("i", F.col("x").alias("p")).join(b.select("i", F.col("x").alias("q")), "i")
    row = j.agg(*[F.sum(F.col("p")[r] * F.col("q")[c]).alias(f"s{r}_{c}") for r in range(ka) for c in range(kb)]).first()
    return np.array([0.0 if v is None else v for v in row], float).reshape(ka, kb)


def gram(a: DataFrame, k: int) -> np.ndarray:
    """A^T A without a join."""
    pairs = [(r, c) for r in range(k) for c in range(r, k)]
    row = a.agg(*[F.sum(F.col("x")[r] * F.col("x")[c]).alias(f"s{r}_{c}") for r, c in pairs]).first()
    out = np.zeros((k, k))
    for (r, c), v in zip(pairs, row):
        out[r, c] = out[c, r] = 0.0 if v is None else v
    return out


def times(f: DataFrame, s: np.ndarray) -> DataFrame:
    """F S for a small S, as expressions: no join, no shuffle."""
    s = np.asarray(s, float)
    return f.select("i", F.array(*[sum((F.col("x")[a] * F.lit(float(s[a, b])) for a in range(s.shape[0])), F.lit(0.0)) for b in range(s.shape[1])]).alias("x"))


def frobenius2(m: CoMatrix) -> float:
    return m.df.agg(F.sum(F.col("v") * F.col("v"))).first()[0] or 0.0


def reconstruction_error(m: CoMatrix, f: DataFrame, s: np.ndarray, g: DataFrame) -> float:
    """||X - F S G^T||^2 = ||X||^2 - 2 <F^T X G, S> + <S^T F^T F S, G^T G>: no n x m product."""
    k, q = s.shape
    fxg = inner(f, matmul(m, g, q), k, q)
    return frobenius2(m) - 2 * float((fxg * s).sum()) + float((s.T @ gram(f, k) @ s * gram(g, q)).sum())


def orthogonality_penalty(f: DataFrame) -> float:
    """tr(A (J - I) A^T) = sum of squared row sums - ||A||^2."""
    total = F.aggregate("x", F.lit(0.0), lambda a, v: a + v)
    squares = F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)
    return f.agg(F.sum(total * total - squares)).first()[0] or 0.0


def _orthonormal(y: DataFrame, k: int, passes: int = 1) -> tuple[DataFrame, int]:
    """Thin Q of a tall factor by the eigenvectors of its Gram matrix, and its rank; only k x k reaches the driver. One
    pass keeps power iterations stable, two are orthonormal to working precision."""
    from ..session import cut

    for p in range(passes):
        g = gram(y, k)
        w, v = np.linalg.eigh((g + g.T) / 2)
        keep = w > max(1e-30, w.max() * 1e-14) if len(w) else w > 0
        y, k = times(y, v[:, keep] / np.sqrt(w[keep])), int(keep.sum())
        if p < passes - 1:
            y = cut(y)  # nested products would grow as k^3 terms
    return y, k


def _gaussian(seed: int, a: int):
    """A standard normal value for each id, of component a (Box-Muller on hashes)."""
    u1, u2 = (F.greatest(uniform(2 * seed + s, F.col("id"), F.lit(a)), F.lit(1e-12)) for s in (0, 1))
    return F.sqrt(-2 * F.log(u1)) * F.cos(2 * np.pi * u2)


def randomized_svd(m: CoMatrix, k: int, oversample: int = 10, power: int = 3, seed: int = 0) -> tuple[DataFrame, np.ndarray, DataFrame]:
    """Truncated SVD (U as (i, x), sigma, V as (i, x)) by a randomised range finder with power iterations.

    Gaussian test vectors come from hashes of the column index. Every pass over X is a join with a narrow factor and an
    aggregate; orthonormalisation exchanges k x k sums only. Factors are checkpointed so plans stay short. Signs: the
    entry of largest size of each V column is positive.
    """
    from ..session import cut

    m = m.with_df(m.df.persist())  # read by every pass; lost parts are made again from their lineage
    size = max(1, min(k + oversample, m.n_rows, m.n_cols))
    omega = m.spark.range(m.n_cols).select(F.col("id").alias("i"), F.array(*[_gaussian(seed, a) for a in range(size)]).alias("x"))
    y = cut(matmul(m, omega, size))
    for _ in range(power):
        q, size = _orthonormal(y, size)
        z, size = _orthonormal(cut(matmul_t(m, q, size)), size)
        y = cut(matmul(m, z, size))
    q, size = _orthonormal(y, size, 2)
    if not size:
        m.df.unpersist()
        return q, np.zeros(0), omega.limit(0)
    q = cut(q)
    bt = cut(matmul_t(m, q, size))  # B^T = X^T Q
    m.df.unpersist()
    w, e = np.linalg.eigh(gram(bt, size))
    order = np.argsort(-w)[: min(k, size)]
    sigma = np.sqrt(np.maximum(w[order], 0))
    e = e[:, order]
    v = cut(times(bt, e / np.where(sigma > 0, sigma, 1)))
    big = v.agg(*[F.max_by(F.col("x")[a], F.abs(F.col("x")[a])).alias(f"b{a}") for a in range(len(order))]).first()
    sign = np.array([-1.0 if (x or 0) < 0 else 1.0 for x in big])
    return times(q, e * sign), sigma, times(v, np.diag(sign))


def svd(m: CoMatrix, k: int, seed: int = 0, small: int = 50, cells: int = 1_000_000) -> tuple[DataFrame, np.ndarray, DataFrame]:
    """The k largest singular values and vectors: a full decomposition on the driver where a side has at most ``small``
    entries, or k is half of it or more, and the matrix at most ``cells`` cells; else the distributed randomised one."""
    low = min(m.n_rows, m.n_cols)
    if (low > small and 2 * k < low) or m.cells > cells:
        return randomized_svd(m, k, seed=seed)
    from ..operators.atoms import truncated_svd

    u, s, v = truncated_svd(m.to_numpy(cells), k)
    return factor_frame(m.spark, u), s, factor_frame(m.spark, v)


def bipartite_laplacian(m: CoMatrix) -> CoMatrix:
    """The symmetric normalised adjacency of the row-column graph, (n + m) square; nodes without degree have no cell."""
    n = m.n_rows
    a = m.df.select("i", (F.col("j") + n).alias("j"), "v")
    a = a.unionAll(a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"))
    deg = a.groupBy("i").agg(F.sum("v").alias("d")).where("d > 0")
    d = a.join(deg.withColumnRenamed("d", "di"), "i").join(deg.select(F.col("i").alias("j"), F.col("d").alias("dj")), "j")
    size = m.n_rows + m.n_cols
    return CoMatrix(d.select("i", "j", (F.col("v") / F.sqrt(F.col("di") * F.col("dj"))).alias("v")), size, size)
