"""Dividing a matrix into blocks: seeded random blocks, sign partition, grid heuristics."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.matrix import CoMatrix


class PartitionError(ValueError):
    """Parameters or blocks that don't fit."""


@dataclass(frozen=True)
class PartitionParams:
    """k clusters, n rows, failure probability delta, a power of two of partitions; tau = sqrt(k / n)."""

    k: int
    n: int
    delta: float = 0.05
    num_partitions: int = 4
    min_size: tuple[int, int] = (10, 10)

    def __post_init__(self) -> None:
        if self.k <= 0 or self.n <= 0:
            raise PartitionError("k and n must be positive")
        if self.num_partitions <= 0 or self.num_partitions & (self.num_partitions - 1):
            raise PartitionError("num_partitions must be a power of two")

    @property
    def tau(self) -> float:
        return math.sqrt(self.k / self.n)


def adaptive_partitions(n: int) -> int:
    """2^ceil(log2(max(n / 100, 4)))."""
    return 1 << math.ceil(math.log2(max(n / 100, 4)))


def block_grid(n: int) -> int:
    """max(2, ceil(sqrt(n / 50)))."""
    return max(2, math.ceil(math.sqrt(n / 50)))


def explicit_grid(num_partitions: int) -> tuple[int, int]:
    """ceil(sqrt(P)) on both axes."""
    g = math.ceil(math.sqrt(num_partitions))
    return g, g


def grid_for(n_cols: int, sparsity: float | None = None) -> tuple[int, int]:
    """Row-only blocks for wide or very sparse matrices, else 2 x 2: column splits cost sparse data its structure."""
    return (8, 1) if n_cols > 10_000 or (sparsity is not None and sparsity > 0.95) else (2, 2)


def iteration_seed(base: int, iteration: int) -> int:
    return (base * 2654435761 + iteration) & 0xFFFFFFFFFFFFFFFF


def shuffled_groups(spark: SparkSession, n: int, groups: int, seed: int, axis: str) -> DataFrame:
    """(idx, g): a seeded permutation of 0..n-1 cut into near-equal groups, the first n mod groups one longer.

    The permutation orders indices by MD5 of seed, axis and index, which any engine repeats. Ranks are taken within 256
    hash ranges and shifted by the counts of earlier ranges, so no task sorts all indices.
    """
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(axis), F.col("idx").cast("string")))
    d = spark.range(n).select(F.col("id").alias("idx")).withColumn("h", h).withColumn("s", F.substring("h", 1, 2))
    counts = d.groupBy("s").agg(F.count("*").alias("c"))
    before = counts.select("s", F.coalesce(F.sum("c").over(W.orderBy("s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("b"))  # 256 rows
    r = d.withColumn("k", F.row_number().over(W.partitionBy("s").orderBy("h", "idx"))).join(F.broadcast(before), "s")
    rank = F.col("k") + F.col("b") - 1
    return r.select("idx", group_of(rank, n, groups).cast("long").alias("g"))


def group_of(rank: Column, n: int, groups: int) -> Column:
    """Group of a 0-based rank when n items form near-equal groups."""
    base, rem = n // groups, n % groups
    cutoff = (base + 1) * rem
    low = F.floor(rank / F.lit(base + 1))
    return F.when(rank < cutoff, low).otherwise(F.lit(rem) + F.floor((rank - cutoff) / F.lit(max(1, base))))


def group_sizes(n: int, groups: int) -> list[int]:
    return [n // groups + (k < n % groups) for k in range(groups)]


def random_blocks(spark: SparkSession, n_rows: int, n_cols: int, m_blocks: int, n_blocks: int, seed: int, min_size: tuple[int, int] = (10, 10)) -> tuple[DataFrame, DataFrame, list[tuple[int, int]]]:
    """(row assignment, column assignment, kept blocks): blocks below the minimum size are left out; none is an error."""
    keep = [(a, b) for a, r in enumerate(group_sizes(n_rows, m_blocks)) for b, c in enumerate(group_sizes(n_cols, n_blocks)) if r >= min_size[0] and c >= min_size[1]]
    if not keep:
        raise PartitionError("no block reaches the minimum size")
    return shuffled_groups(spark, n_rows, m_blocks, seed, "row"), shuffled_groups(spark, n_cols, n_blocks, seed, "col"), keep


def extract(m: CoMatrix, rows: DataFrame, cols: DataFrame) -> DataFrame:
    """(rb, cb, i, j, v): stored cells with their blocks. Assignments are one row per index."""
    r, c = rows.select(F.col("idx").alias("i"), F.col("g").alias("rb")), cols.select(F.col("idx").alias("j"), F.col("g").alias("cb"))
    return m.df.join(r, "i").join(c, "j").select("rb", "cb", "i", "j", "v")


def split_by_sign(u: np.ndarray, threshold: float) -> tuple[list[int], list[int]]:
    """Indices above the threshold and below its negative; those between go, in turn, to the smaller side."""
    pos, neg = [], []
    for k, x in enumerate(np.asarray(u).tolist()):
        if x > threshold:
            pos.append(k)
        elif x < -threshold:
            neg.append(k)
        elif len(pos) <= len(neg):
            pos.append(k)
        else:
            neg.append(k)
    return pos, neg


@dataclass(frozen=True)
class SignPartition:
    blocks: list[tuple[list[int], list[int]]]
    threshold: float
    preservation: float
    sigma: np.ndarray


def preservation_probability(sigma: np.ndarray, k: int, tau: float, delta: float) -> float:
    """1 - delta * exp(-(gap / tau)^2) in [1 - delta, 1], gap = sigma_k - sigma_(k+1); 1 - delta without a gap."""
    if len(sigma) <= k:
        return 1 - delta
    gap = float(sigma[k - 1] - sigma[k])
    return min(1.0, max(1 - delta, 1 - delta * math.exp(-((gap / tau) ** 2))))


def sign_partition(m: CoMatrix, p: PartitionParams) -> SignPartition:
    """Blocks by the signs of the first singular vectors: the cross product of the sides, small blocks dropped, the
    largest repeated up to num_partitions. One entry per row and column reaches the driver, as the order of the
    balancing rule needs."""
    from ..functions.linalg import factor_numpy, svd

    u, sigma, v = svd(m, min(p.k + 1, m.n_rows, m.n_cols))
    rows = split_by_sign(factor_numpy(u, m.n_rows, len(sigma))[:, 0], p.tau)
    cols = split_by_sign(factor_numpy(v, m.n_cols, len(sigma))[:, 0], p.tau)
    blocks = [(r, c) for r in rows for c in cols if len(r) >= p.min_size[0] and len(c) >= p.min_size[1]]
    if not blocks:
        blocks = [(list(range(m.n_rows)), list(range(m.n_cols)))]
    while len(blocks) < p.num_partitions:
        size = [len(r) * len(c) for r, c in blocks]
        blocks.append(blocks[max(range(len(blocks)), key=lambda k: (size[k], k))])
    return SignPartition(blocks, p.tau, preservation_probability(sigma, p.k, p.tau, p.delta), sigma)
