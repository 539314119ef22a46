"""Divide and merge: random blocks, local clustering of every block on the executors, one merge.

All iterations run in one job: cells join the assignments of each iteration and are grouped by (iteration, row block,
column block); a group is a dense block of bounded size, sized by the grid. Groups emit global indices.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut
from ..sources.matrix import CoMatrix
from .atoms import blocks_of
from .merge import MergeConfig, merge_tree, tree_depth
from .partition import PartitionParams, block_grid, extract, iteration_seed, random_blocks

_LOCAL = "node long, pos long, row_indices array<long>, col_indices array<long>"


@dataclass(frozen=True)
class DivideMergeStats:
    partitions: int
    tree_depth: int
    preservation_probability: float
    local_clusters: int
    seconds: dict[str, float]


@dataclass
class DivideMerge:
    """k, n and delta are reported and checked; blocks depend on the seed and the grid, and the atom has its own k.
    ``num_threads`` is accepted and changes nothing."""

    k: int
    local: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]
    delta: float = 0.05
    merge: MergeConfig = field(default_factory=MergeConfig)
    t_p: int = 1
    m_blocks: int = 2
    n_blocks: int = 1
    base_seed: int = 0
    min_size: tuple[int, int] = (10, 10)
    num_threads: int | None = None

    def __post_init__(self) -> None:
        if self.m_blocks < 2 or self.n_blocks < 1 or self.t_p < 1:
            raise ValueError("m_blocks >= 2, n_blocks >= 1 and t_p >= 1 are needed")

    @classmethod
    def adaptive(cls, m: CoMatrix, k: int, local, **options) -> DivideMerge:
        """Grid from the shape, ten iterations."""
        return cls(k, local, t_p=options.pop("t_p", 10), m_blocks=block_grid(m.n_rows), n_blocks=block_grid(m.n_cols), **options)

    def blocks(self, m: CoMatrix) -> tuple[DataFrame, int]:
        """(node, i, j, v) of every kept block of every iteration, with a row for each member; and the number of blocks."""
        frames, node = [], 0
        for t in range(self.t_p):
            rows, cols, keep = random_blocks(m.spark, m.n_rows, m.n_cols, self.m_blocks, self.n_blocks, iteration_seed(self.base_seed, t), self.min_size)
            ids = {b: node + k for k, b in enumerate(keep)}
            node += len(keep)
            number = F.create_map(*[F.lit(x) for (a, b), k in ids.items() for x in (a * self.n_blocks + b, k)])
            at = F.element_at(number, (F.col("rb") * self.n_blocks + F.col("cb")).cast("int"))
            frames.append(extract(m, rows, cols).select(at.cast("long").alias("node"), "i", "j", "v"))
            # Members without a stored cell still belong to the block: v is null there.
            for side, axis in ((rows, "i"), (cols, "j")):
                g = "rb" if axis == "i" else "cb"
                n_other = self.n_blocks if axis == "i" else self.m_blocks
                each = side.select(F.col("idx").alias(axis), F.col("g").alias(g), F.explode(F.array(*[F.lit(x).cast("long") for x in range(n_other)])).alias("o"))
                rb, cb = (F.col("rb"), F.col("o")) if axis == "i" else (F.col("o"), F.col("cb"))
                at = F.element_at(number, (rb * self.n_blocks + cb).cast("int"))
                none = F.lit(None).cast("long")
                frames.append(each.select(at.cast("long").alias("node"), *([F.col("i"), none.alias("j")] if axis == "i" else [none.alias("i"), F.col("j")]), F.lit(None).cast("double").alias("v")))
        return reduce(DataFrame.unionAll, frames).where("node is not null"), node

    def cluster_blocks(self, m: CoMatrix) -> tuple[DataFrame, int]:
        """(node, pos, row_indices, col_indices) of the local co-clusters."""
        cells, n = self.blocks(m)
        atom = self.local

        def run(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
            rows = np.sort(t["i"][t["j"].isna()].astype(np.int64).to_numpy())
            cols = np.sort(t["j"][t["i"].isna()].astype(np.int64).to_numpy())
            c = t[t["v"].notna()]
            x = np.zeros((len(rows), len(cols)))
            np.add.at(x, (np.searchsorted(rows, c["i"].astype(np.int64)), np.searchsorted(cols, c["j"].astype(np.int64))), c["v"].to_numpy())
            found = blocks_of(atom, x)
            return pd.DataFrame({"node": [key[0]] * len(found), "pos": range(len(found)), "row_indices": [rows[r].tolist() for r, _ in found], "col_indices": [cols[c].tolist() for _, c in found]})

        return cells.groupBy("node").applyInPandas(run, _LOCAL), n

    def run(self, m: CoMatrix) -> tuple[DataFrame, DivideMergeStats, DataFrame]:
        """(co-clusters, statistics, merge rounds)."""
        PartitionParams(self.k, max(1, m.n_rows), self.delta)
        t0 = time.monotonic()
        local, n = self.cluster_blocks(m)
        local = cut(local)
        t1 = time.monotonic()
        merged, rounds = merge_tree(local, n, self.merge)
        # Numbers follow the place in the merged set.
        out = cut(merged.withColumn("cid", F.row_number().over(W.orderBy("pos", "row_indices", "col_indices")).cast("long") - 1).select("cid", "row_indices", "col_indices", F.lit(None).cast("double").alias("score")))
        stats = DivideMergeStats(n, tree_depth(n), 1 - math.exp(-self.t_p / 2), local.count(), {"local": t1 - t0, "merge": time.monotonic() - t1})
        return out, stats, rounds
