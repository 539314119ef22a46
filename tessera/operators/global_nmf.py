"""Tri-factorisation of a distributed matrix: the atoms' updates on DataFrames.

F (n x k) and G (m x l) are (i, x array<double>) tables, S a k x l array on the driver. One round costs two products with
X (a join with a narrow factor and a map-side combined sum); everything else is a per-row expression with k x k sums.
Factors are checkpointed each round, so plans stay short and a lost executor costs one round at most.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.elementwise import mu_sqrt_update, mu_update
from ..functions.linalg import gram, inner, matmul, matmul_t, reconstruction_error, times
from ..session import cut
from ..sources.matrix import CoMatrix
from ..sources.synthetic import uniform

KINDS = ("nbvd", "onm3f", "onmtf", "pnmtf")


@dataclass(frozen=True)
class GlobalTriFactor:
    kind: str = "nbvd"
    n_row: int = 2
    n_col: int = 2
    max_iter: int = 20
    tol: float = 1e-6
    seed: int = 42
    tau: float = 0.0
    eta: float = 0.0
    gamma: float = 0.0

    def start(self, m: CoMatrix) -> tuple[DataFrame, np.ndarray, DataFrame]:
        """U(0, 1) factors from hashes."""
        one = lambda n, k, s: m.spark.range(n).select(F.col("id").alias("i"), F.array(*[uniform(self.seed + s, F.col("id"), F.lit(a)) for a in range(k)]).alias("x"))
        return one(m.n_rows, self.n_row, 0), np.random.default_rng(self.seed).random((self.n_row, self.n_col)), one(m.n_cols, self.n_col, 1)

    def _update(self, f: DataFrame, num: DataFrame, den: list[Column]) -> DataFrame:
        root = self.kind in ("onm3f", "pnmtf")
        d = f.join(num.select("i", F.col("x").alias("y")), "i", "left").withColumn("y", F.coalesce("y", F.array(*[F.lit(0.0)] * len(den))))
        out = []
        for a, e in enumerate(den):
            out.append((mu_sqrt_update if root else mu_update)(F.col("x")[a], F.col("y")[a], e))
        return d.select("i", F.array(*out).alias("x"))

    @staticmethod
    def _mix(k: int, w: np.ndarray) -> list[Column]:
        """x W as expressions."""
        return [sum((F.col("x")[a] * F.lit(float(w[a, b])) for a in range(k)), F.lit(0.0)) for b in range(w.shape[1])]

    def _half(self, f: DataFrame, num: DataFrame, k: int, middle: np.ndarray, weight: float) -> DataFrame:
        if self.kind == "onm3f":
            middle = inner(f, num, k, k)  # F (F^T A)
        den = self._mix(k, middle)
        if self.kind == "pnmtf" and weight:
            total = sum((F.col("x")[a] for a in range(k)), F.lit(0.0))
            den = [e + weight * (total - F.col("x")[a]) for a, e in enumerate(den)]
        return self._update(f, num, den)

    def step(self, m: CoMatrix, f: DataFrame, s: np.ndarray, g: DataFrame) -> tuple[DataFrame, np.ndarray, DataFrame]:
        """One update of F, then G, then S."""
        k, q = s.shape
        xg = cut(matmul(m, g, q))
        middle = s @ gram(g, q) @ s.T
        if self.kind == "onmtf":
            middle = s @ inner(g, matmul_t(m, f, k), q, k)  # S (G^T X^T F)
        f = cut(self._half(f, times(xg, s.T), k, middle, self.tau))
        xf = cut(matmul_t(m, f, k))
        ff = gram(f, k)
        middle = s.T @ ff @ s
        if self.kind == "onmtf":
            middle = s.T @ inner(f, xg, k, q)  # S^T (F^T X G)
        g = cut(self._half(g, times(xf, s), q, middle, self.eta))
        num, den = inner(xf, g, k, q), ff @ s @ gram(g, q) + (self.gamma * s if self.kind == "pnmtf" else 0)
        ratio = num / (den + 1e-10)
        s = np.nan_to_num(s * (np.sqrt(ratio) if self.kind in ("onm3f", "pnmtf") else ratio), posinf=0, neginf=0)
        return f, s, g

    def fit(self, m: CoMatrix) -> tuple[DataFrame, np.ndarray, DataFrame, list[float]]:
        """F, S, G and the errors by round."""
        m = m.with_df(m.df.persist())
        f, s, g = self.start(m)
        f, g, errors = cut(f), cut(g), []
        for _ in range(self.max_iter):
            f, s, g = self.step(m, f, s, g)
            errors.append(reconstruction_error(m, f, s, g))
            if len(errors) > 1 and abs(errors[-2] - errors[-1]) <= self.tol * max(1.0, abs(errors[0])):
                break
        m.df.unpersist()
        return f, s, g, errors

    def labels(self, m: CoMatrix) -> DataFrame:
        f, _, g, _ = self.fit(m)
        pick = lambda x: x.select("i", argmax_last("x").alias("label"))
        return pick(f).select(F.lit("row").alias("axis"), F.col("i").alias("idx"), "label").unionAll(pick(g).select(F.lit("col"), "i", "label"))

    name = "global"

    def cluster(self, m: CoMatrix) -> DataFrame:
        from .clusterers import cross_coclusters

        return cross_coclusters(cut(self.labels(m)))


def argmax_last(x: str) -> Column:
    """Place of an array's greatest value, the last of equals."""
    n = F.size(x)
    return (n - F.array_position(F.reverse(F.col(x)), F.array_max(x))).cast("long")


def nnls_columns(ata: np.ndarray, atb: DataFrame) -> DataFrame:
    """Non-negative solutions for every row (i, x) of A^T B: columns are independent, so batches of them are solved where
    they lie, against the small A^T A."""
    import pyarrow as pa

    from .atoms import nnls_bpp

    def run(batches):
        for b in batches:
            if b.num_rows:
                x, _ = nnls_bpp(ata, np.array(b.column(1).to_pylist(), float).T)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x.T.tolist(), pa.list_(pa.float64()))], ["i", "x"])

    return atb.select("i", "x").mapInArrow(run, "i long, x array<double>")


@dataclass(frozen=True)
class GlobalFnmf:
    """Two-factor NMF of a distributed matrix by alternating non-negative least squares."""

    n_row: int
    n_col: int
    max_iter: int = 10
    seed: int = 42
    name: str = "global_fnmf"

    def fit(self, m: CoMatrix) -> tuple[DataFrame, DataFrame]:
        k = max(self.n_row, self.n_col)
        m = m.with_df(m.df.persist())
        w = cut(m.spark.range(m.n_rows).select(F.col("id").alias("i"), F.array(*[uniform(self.seed, F.col("id"), F.lit(a)) for a in range(k)]).alias("x")))
        h = w
        for _ in range(self.max_iter):
            h = cut(nnls_columns(gram(w, k), matmul_t(m, w, k)))
            w = cut(nnls_columns(gram(h, k), matmul(m, h, k)))
            n = np.sqrt(np.diag(gram(w, k)))
            safe = np.where(n > 1e-30, n, 1.0)
            w, h = times(w, np.diag(1 / safe)), times(h, np.diag(safe))
        m.df.unpersist()
        return w, h

    def labels(self, m: CoMatrix) -> DataFrame:
        w, h = self.fit(m)
        side = lambda d, n, axis: d.select(F.lit(axis).alias("axis"), F.col("i").alias("idx"), F.slice("x", 1, n).alias("x")).select("axis", "idx", argmax_last("x").alias("label"))
        from .clusterers import full_range

        return full_range(m, side(w, self.n_row, "row").unionAll(side(h, self.n_col, "col")))

    def cluster(self, m: CoMatrix) -> DataFrame:
        from .clusterers import cross_coclusters

        return cross_coclusters(cut(self.labels(m)))
