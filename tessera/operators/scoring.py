"""Scores of co-clusters. Each scorer maps (coclusters, matrix) to (cid, score).

Members are exploded to (cid, i) and (cid, j) and joined to the cells; a missing cell is 0. Degenerate input scores 0.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.matrix import CoMatrix

COCLUSTERS = "cid long, row_indices array<long>, col_indices array<long>, score double"


class Scorer(Protocol):
    def score(self, coclusters: DataFrame, m: CoMatrix) -> DataFrame: ...


def row_members(coclusters: DataFrame) -> DataFrame:
    """(cid, ri, i): members with their place, so duplicates count."""
    return coclusters.select("cid", F.posexplode("row_indices").alias("ri", "i"))


def col_members(coclusters: DataFrame) -> DataFrame:
    return coclusters.select("cid", F.posexplode("col_indices").alias("cj", "j"))


def shapes(coclusters: DataFrame) -> DataFrame:
    return coclusters.select("cid", F.size("row_indices").cast("long").alias("r"), F.size("col_indices").cast("long").alias("c"))


def stored_cells(coclusters: DataFrame, m: CoMatrix) -> DataFrame:
    """(cid, ri, cj, v): the stored cells of each co-cluster."""
    d = row_members(coclusters).join(m.df, "i")
    return d.join(col_members(coclusters), ["cid", "j"]).select("cid", "ri", "cj", "v")


@dataclass(frozen=True)
class PearsonScorer:
    """Mean of |r| over all pairs of rows and all pairs of columns together; a pair without variance counts as 0.

    For one axis: sums of cross products over the shared axis give the covariances of pairs with a common cell, from stored
    cells only. A pair without one has covariance -s_a s_b / n, so its |r| is u_a u_b with u = |s| / sqrt(n variance), and
    over all pairs these add up to ((sum u)^2 - sum u^2) / 2: pairs without a common cell are never made.
    """

    min_rows: int = 2
    min_cols: int = 2

    def _axis(self, cells: DataFrame, members: DataFrame, size: DataFrame, a: str, b: str, length: str) -> DataFrame:
        x = cells.select("cid", F.col(a).alias("p"), F.col(b).alias("q"), "v")
        sums = x.groupBy("cid", "p").agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("s2"))
        full = members.select("cid", F.col(a).alias("p")).join(sums, ["cid", "p"], "left").na.fill(0.0, ["s", "s2"])
        left = x.select("cid", "q", F.col("p").alias("p1"), F.col("v").alias("v1"))
        right = x.select("cid", "q", F.col("p").alias("p2"), F.col("v").alias("v2"))
        cross = left.join(right, ["cid", "q"]).where("p1 < p2").groupBy("cid", "p1", "p2").agg(F.sum(F.col("v1") * F.col("v2")).alias("x"))
        n = F.col(length).cast("double")
        var = F.col("s2") - F.col("s") * F.col("s") / n
        flat = (var <= 1e-12 * F.col("s2")) | (F.col("s2") == 0)
        full = full.join(size, "cid").select("cid", "p", "s", n.alias("n"), F.when(~flat, var).alias("var"))
        full = full.withColumn("u", F.coalesce(F.abs("s") / F.sqrt(F.col("n") * F.col("var")), F.lit(0.0)))
        apart = full.groupBy("cid").agg(((F.sum("u") * F.sum("u") - F.sum(F.col("u") * F.col("u"))) / 2).alias("total"), (F.count("*") * (F.count("*") - 1) / 2).alias("pairs"))
        side = lambda k: full.select("cid", F.col("p").alias(f"p{k}"), F.col("s").alias(f"s{k}"), F.col("var").alias(f"var{k}"), F.col("u").alias(f"u{k}"), *["n"][: k == 1])
        met = cross.join(side(1), ["cid", "p1"]).join(side(2), ["cid", "p2"]).where("var1 is not null and var2 is not null")
        r = F.least(F.lit(1.0), F.abs(F.col("x") - F.col("s1") * F.col("s2") / F.col("n")) / F.sqrt(F.col("var1") * F.col("var2")))
        more = met.select("cid", (r - F.col("u1") * F.col("u2")).alias("total"), F.lit(0.0).alias("pairs"))
        return apart.unionAll(more)

    def score(self, coclusters: DataFrame, m: CoMatrix) -> DataFrame:
        size = shapes(coclusters)
        big = coclusters.where((F.size("row_indices") >= self.min_rows) & (F.size("col_indices") >= self.min_cols))
        cells = stored_cells(big, m)
        rows = self._axis(cells, row_members(big), size, "ri", "cj", "c")
        cols = self._axis(cells, col_members(big), size, "cj", "ri", "r")
        mean = rows.unionAll(cols).groupBy("cid").agg(F.greatest(F.lit(0.0), F.try_divide(F.sum("total"), F.sum("pairs"))).alias("score"))
        return coclusters.select("cid").join(mean, "cid", "left").select("cid", F.coalesce("score", F.lit(0.0)).alias("score"))


@dataclass(frozen=True)
class ExponentialScorer:
    """tau * ln(mean(exp(v / tau))) over all cells of the co-cluster; 0 if it has none."""

    tau: float = 1.0

    def score(self, coclusters: DataFrame, m: CoMatrix) -> DataFrame:
        s = stored_cells(coclusters, m).groupBy("cid").agg(F.sum(F.exp(F.col("v") / self.tau)).alias("e"), F.count("*").alias("k"))
        d = shapes(coclusters).join(s, "cid", "left").na.fill(0.0, ["e"]).na.fill(0, ["k"])
        n = (F.col("r") * F.col("c")).cast("double")
        # Unstored cells are exp(0) = 1 each.
        return d.select("cid", F.when(n > 0, self.tau * F.log((F.col("e") + n - F.col("k")) / n)).otherwise(0.0).alias("score"))


@dataclass(frozen=True)
class CompatibilityScorer:
    """Half of 1 / (1 + mean row variance / rt) plus half of 1 / (1 + mean column variance / ct), population variances."""

    row_threshold: float = 1.0
    col_threshold: float = 1.0

    def score(self, coclusters: DataFrame, m: CoMatrix) -> DataFrame:
        cells, size = stored_cells(coclusters, m), shapes(coclusters)

        def mean_variance(key: str, length: str, count: str, name: str) -> DataFrame:
            s = cells.groupBy("cid", key).agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q")).join(size, "cid")
            n = F.col(length).cast("double")
            var = F.greatest(F.lit(0.0), F.col("q") / n - (F.col("s") / n) * (F.col("s") / n))
            # Rows without a stored cell have variance 0: they count in the divisor only.
            return s.groupBy("cid").agg((F.sum(var) / F.first(F.col(count).cast("double"))).alias(name))

        rows, cols = mean_variance("ri", "c", "r", "vr"), mean_variance("cj", "r", "c", "vc")
        d = size.join(rows, "cid", "left").join(cols, "cid", "left").na.fill(0.0, ["vr", "vc"])
        v = 0.5 * (1 / (1 + F.col("vr") / self.row_threshold) + 1 / (1 + F.col("vc") / self.col_threshold))
        return d.select("cid", F.when((F.col("r") > 0) & (F.col("c") > 0), v).otherwise(0.0).alias("score"))


class CompositeScorer:
    """Weighted mean of scorers; 0 if the weights don't sum to more than 0."""

    def __init__(self, parts: Sequence[tuple[Scorer, float]] = ()):
        self.parts = list(parts)

    def add(self, scorer: Scorer, weight: float) -> CompositeScorer:
        self.parts.append((scorer, weight))
        return self

    def score(self, coclusters: DataFrame, m: CoMatrix) -> DataFrame:
        total = sum(w for _, w in self.parts)
        d = coclusters.select("cid")
        if total <= 0:
            return d.select("cid", F.lit(0.0).alias("score"))
        value = F.lit(0.0)
        for k, (s, w) in enumerate(self.parts):
            d = d.join(s.score(coclusters, m).select("cid", F.col("score").alias(f"s{k}")), "cid")
            value = value + F.lit(float(w)) * F.col(f"s{k}")
        return d.select("cid", (value / float(total)).alias("score"))


def singular_values(coclusters: DataFrame, m: CoMatrix) -> DataFrame:
    """(cid, sigma): singular values of each co-cluster's dense block, one block per group on an executor."""
    import numpy as np
    import pandas as pd

    def run(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
        x = np.zeros((int(t["r"].iloc[0]), int(t["c"].iloc[0])))
        ok = t["ri"].notna().to_numpy()
        np.add.at(x, (t["ri"][ok].astype(int).to_numpy(), t["cj"][ok].astype(int).to_numpy()), t["v"][ok].to_numpy())
        s = np.linalg.svd(x, compute_uv=False) if x.size else np.zeros(0)
        return pd.DataFrame({"cid": [key[0]], "sigma": [s.tolist()]})

    d = shapes(coclusters).join(stored_cells(coclusters, m), "cid", "left")
    return d.groupBy("cid").applyInPandas(run, "cid long, sigma array<double>")


def rank_one_score(coclusters: DataFrame, m: CoMatrix) -> DataFrame:
    """(cid, score): sigma1 / sigma2; null below 3 rows or columns, infinite if sigma2 is 0."""
    s = singular_values(coclusters, m).join(shapes(coclusters), "cid")
    ratio = F.when(F.col("sigma")[1] == 0, F.lit(float("inf"))).otherwise(F.try_divide(F.col("sigma")[0], F.col("sigma")[1]))
    return s.select("cid", F.when((F.col("r") >= 3) & (F.col("c") >= 3), ratio).alias("score"))
