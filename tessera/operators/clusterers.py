"""Clusterers of whole matrices: contiguous blocks, spectral and factorisation models, local atoms, divide and merge."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.elementwise import binormalize, check_non_negative, is_zero_vector, l2_normalize
from ..functions.linalg import svd
from ..session import cut
from ..sources.matrix import CoMatrix
from . import atoms
from .divide_merge import DivideMerge


class Clusterer(Protocol):
    """Maps a matrix to co-clusters (cid, row_indices, col_indices, score)."""

    name: str

    def cluster(self, m: CoMatrix) -> DataFrame: ...


def joint_coclusters(labels: DataFrame) -> DataFrame:
    """One co-cluster per label that has rows and columns. Input: (axis 'row'|'col', idx, label), null unassigned."""
    members = lambda axis: F.sort_array(F.collect_list(F.when(F.col("axis") == axis, F.col("idx"))))
    d = labels.where("label is not null").groupBy("label").agg(members("row").alias("row_indices"), members("col").alias("col_indices"))
    d = d.where((F.size("row_indices") > 0) & (F.size("col_indices") > 0))
    return d.select(F.col("label").cast("long").alias("cid"), "row_indices", "col_indices", F.lit(None).cast("double").alias("score"))


def cross_coclusters(labels: DataFrame) -> DataFrame:
    """One co-cluster per pair of a row label and a column label; their numbers are small, so the pairs are too."""
    side = lambda axis, a, b: labels.where((F.col("axis") == axis) & F.col("label").isNotNull()).groupBy(F.col("label").alias(a)).agg(F.sort_array(F.collect_list("idx")).alias(b))
    d = side("row", "rl", "row_indices").crossJoin(side("col", "cl", "col_indices"))
    width = labels.where("axis = 'col'").agg(F.coalesce(F.max("label"), F.lit(0)) + 1).first()[0]
    return d.select((F.col("rl") * width + F.col("cl")).cast("long").alias("cid"), "row_indices", "col_indices", F.lit(None).cast("double").alias("score"))


@dataclass(frozen=True)
class BasicCoclusterer:
    """k contiguous diagonal blocks [i n / k, (i + 1) n / k); those of at least 3 x 3 are returned."""

    n_clusters: int = 2
    name: str = "basic"

    def cluster(self, m: CoMatrix) -> DataFrame:
        if self.n_clusters <= 0:
            raise ValueError("n_clusters must be positive")
        k, s = self.n_clusters, m.spark
        edge = lambda c, n: F.expr(f"({c} * {n}) div {k}")
        d = s.range(k).select(F.col("id").alias("cid"), edge("id", m.n_rows).alias("a"), edge("(id + 1)", m.n_rows).alias("b"), edge("id", m.n_cols).alias("c"), edge("(id + 1)", m.n_cols).alias("d"))
        d = d.where("b - a >= 3 and d - c >= 3")
        return d.select("cid", F.sequence(F.col("a"), F.col("b") - 1).alias("row_indices"), F.sequence(F.col("c"), F.col("d") - 1).alias("col_indices"), F.lit(None).cast("double").alias("score"))


def full_range(m: CoMatrix, found: DataFrame) -> DataFrame:
    """(axis, idx, label) for every row and column of ``m``; those without a label in ``found`` have null."""
    every = m.spark.range(m.n_rows).select(F.lit("row").alias("axis"), F.col("id").alias("idx")).unionAll(m.spark.range(m.n_cols).select(F.lit("col"), "id"))
    return every.join(found, ["axis", "idx"], "left")


def _kmeans(f: DataFrame, k: int, max_iter: int, seed: int, n_init: int) -> DataFrame:
    """Predictions of the best of ``n_init`` runs, on narrow checkpointed vectors; one cluster needs no run."""
    if k <= 1:
        return f.drop("x").withColumn("prediction", F.lit(0))
    v = cut(f.withColumn("features", array_to_vector("x")).drop("x"))
    models = [KMeans(k=k, maxIter=max_iter, seed=seed + r, initSteps=5).fit(v) for r in range(n_init)]
    best = min(models, key=lambda x: x.summary.trainingCost)
    return best.transform(v).drop("features")


@dataclass(frozen=True)
class SVDClusterer:
    """Spectral co-clustering of a distributed matrix: bi-normalise, randomised SVD, joint k-means on unit rows.

    ``tol`` is accepted and changes nothing; k is cut to the smaller side; ``n_vectors`` defaults to k.
    """

    k: int
    tol: float = 1e-4
    n_vectors: int | None = None
    seed: int = 0
    name: str = "svd"

    def labels(self, m: CoMatrix) -> DataFrame:
        check_non_negative(m)
        u, sigma, v = svd(binormalize(m.with_df(m.df.where(F.abs("v") > 1e-15))), min(self.n_vectors or self.k, m.n_rows, m.n_cols), seed=self.seed)
        z = u.select(F.lit("row").alias("axis"), F.col("i").alias("idx"), "x").unionAll(v.select(F.lit("col"), "i", "x"))
        some = cut(z.where(~is_zero_vector(F.col("x"))).select("axis", "idx", l2_normalize(F.col("x")).alias("x")))
        found = _kmeans(some, min(self.k, m.n_rows + m.n_cols), 100, self.seed, 3).select("axis", "idx", F.col("prediction").cast("long").alias("label"))
        return full_range(m, found)

    def cluster(self, m: CoMatrix) -> DataFrame:
        return joint_coclusters(self.labels(m))


@dataclass(frozen=True)
class SpectralCocluster:
    """Vectors 1..min(nr, nc) of the normalised bipartite graph; rows and columns clustered separately."""

    n_row_clusters: int
    n_col_clusters: int
    n_init: int = 5
    max_iter: int = 300
    seed: int = 0
    name: str = "spectral"

    def labels(self, m: CoMatrix) -> DataFrame:
        k = min(self.n_row_clusters, self.n_col_clusters)
        # The normalised adjacency's vectors are those of the bi-normalised matrix, rows and columns stacked.
        u, sigma, v = svd(binormalize(m), min(k + 1, m.n_rows, m.n_cols), seed=self.seed)
        tail = F.slice("x", 2, max(1, len(sigma) - 1)) if len(sigma) > 1 else F.col("x")
        rows = _kmeans(cut(u.select(F.lit("row").alias("axis"), F.col("i").alias("idx"), tail.alias("x"))), self.n_row_clusters, self.max_iter, self.seed, self.n_init)
        cols = _kmeans(cut(v.select(F.lit("col").alias("axis"), F.col("i").alias("idx"), tail.alias("x"))), self.n_col_clusters, self.max_iter, self.seed, self.n_init)
        return full_range(m, rows.unionAll(cols).select("axis", "idx", F.col("prediction").cast("long").alias("label")))

    def cluster(self, m: CoMatrix) -> DataFrame:
        return cross_coclusters(self.labels(m))


def SpectralCoclustererHook(n_row_clusters: int, n_col_clusters: int) -> SpectralCocluster:  # noqa: N802
    """The documented name of the spectral clusterer in pipelines."""
    return SpectralCocluster(n_row_clusters, n_col_clusters)


@dataclass(frozen=True)
class LocalModel:
    """An atom run on the whole matrix as one dense block on one executor: for matrices that fit (``limit`` cells).
    Larger ones go through DivideMerge, whose blocks are bounded, or the distributed models."""

    atom: object
    limit: int = 50_000_000
    name: str = "local"

    def labels(self, m: CoMatrix) -> DataFrame:
        if m.cells > self.limit:
            raise ValueError(f"{m.cells} cells are more than {self.limit}: use DivideMerge")
        n, w, atom = m.n_rows, m.n_cols, self.atom

        def run(t: pd.DataFrame) -> pd.DataFrame:
            x = np.zeros((n, w))
            ok = t["i"] >= 0
            np.add.at(x, (t["i"][ok].to_numpy(), t["j"][ok].to_numpy()), t["v"][ok].to_numpy())
            rows, cols = atom(x)
            return pd.DataFrame({"axis": ["row"] * n + ["col"] * w, "idx": [*range(n), *range(w)], "label": [None if k < 0 else int(k) for k in [*rows, *cols]]}).astype({"label": "Int64"})

        some = m.df.unionAll(m.spark.sql("SELECT -1L AS i, -1L AS j, 0D AS v"))
        return some.groupBy(F.lit(0).alias("one")).applyInPandas(run, "axis string, idx long, label long")

    def cluster(self, m: CoMatrix) -> DataFrame:
        joint = isinstance(self.atom, (atoms.Scc, atoms.Basic))
        return (joint_coclusters if joint else cross_coclusters)(cut(self.labels(m)))


@dataclass(frozen=True)
class DivideMergeClusterer:
    """Divide and merge as a clusterer."""

    model: DivideMerge
    name: str = "divide_merge"

    def cluster(self, m: CoMatrix) -> DataFrame:
        return self.model.run(m)[0]


def default_clusterer() -> BasicCoclusterer:
    return BasicCoclusterer(2)
