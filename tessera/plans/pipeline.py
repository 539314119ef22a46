"""The pipeline: cluster, score, filter, sort, limit, statistics."""

from __future__ import annotations

import time
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.clusterers import DivideMergeClusterer
from ..operators.divide_merge import DivideMerge
from ..operators.merge import MergeConfig
from ..operators.partition import explicit_grid
from ..session import cut
from ..sources.matrix import CoMatrix


class PipelineError(ValueError):
    pass


@dataclass(frozen=True)
class PipelineConfig:
    """``parallel`` is accepted: Spark schedules."""

    min_score: float = 0.5
    max_submatrices: int = 50
    sort_by_score: bool = True
    min_submatrix_size: tuple[int, int] = (3, 3)
    collect_stats: bool = True
    parallel: bool = True


def filter_and_rank(scored: DataFrame, c: PipelineConfig) -> DataFrame:
    """Co-clusters of enough score, rows and columns, the best first (ties by cid), at most max_submatrices. A NaN score
    fails the filter."""
    r, k = c.min_submatrix_size
    d = scored.where((F.col("score") >= c.min_score) & ~F.isnan("score") & (F.size("row_indices") >= r) & (F.size("col_indices") >= k))
    return d.orderBy(F.desc("score"), "cid").limit(c.max_submatrices) if c.sort_by_score else d.orderBy("cid").limit(c.max_submatrices)


def score_stats(kept: DataFrame) -> DataFrame:
    """One row: count, min, max, mean and population deviation of the kept scores; zeros without any."""
    z = lambda x: F.coalesce(x, F.lit(0.0))
    return kept.agg(F.count("*").alias("count"), z(F.min("score")).alias("min"), z(F.max("score")).alias("max"), z(F.avg("score")).alias("mean"), z(F.stddev_pop("score")).alias("std"))


@dataclass(frozen=True)
class StepResult:
    coclusters: DataFrame
    stats: DataFrame | None
    seconds: dict[str, float]
    found: int

    def summary(self, top: int = 5) -> str:
        rows = self.coclusters.select("score", F.size("row_indices").alias("r"), F.size("col_indices").alias("c")).take(top + 1)
        n = self.coclusters.count() if len(rows) > top else len(rows)
        lines = [f"Found {self.found} co-clusters, kept {n}"]
        lines += [f"  {k + 1}. {r['r']} x {r['c']}, score {r['score']:.4f}" for k, r in enumerate(rows[:top])]
        return "\n".join(lines + ([f"  ... and {n - top} more"] if n > top else []))


@dataclass(frozen=True)
class Pipeline:
    clusterer: object
    scorer: object
    config: PipelineConfig

    @staticmethod
    def builder() -> PipelineBuilder:
        return PipelineBuilder()

    def run(self, m: CoMatrix) -> StepResult:
        t0 = time.monotonic()
        found = cut(self.clusterer.cluster(m))
        t1 = time.monotonic()
        scored = found.drop("score").join(self.scorer.score(found, m), "cid")
        kept = cut(filter_and_rank(scored.select("cid", "row_indices", "col_indices", "score"), self.config))
        t2 = time.monotonic()
        return StepResult(kept, score_stats(kept) if self.config.collect_stats else None, {"cluster": t1 - t0, "score": t2 - t1}, found.count())


class StandardPipeline:
    """Clusters only: the scorer and the configuration are not used."""

    def __init__(self, clusterer, scorer=None, config: PipelineConfig | None = None):
        self.clusterer = clusterer

    def run(self, m: CoMatrix) -> DataFrame:
        return self.clusterer.cluster(m)


class PipelineBuilder:
    def __init__(self) -> None:
        self._clusterer = self._scorer = None
        self._config = PipelineConfig()

    def with_clusterer(self, c) -> PipelineBuilder:
        self._clusterer = c
        return self

    def with_scorer(self, s) -> PipelineBuilder:
        self._scorer = s
        return self

    def with_config(self, c: PipelineConfig) -> PipelineBuilder:
        self._config = c
        return self

    def _set(self, **kw) -> PipelineBuilder:
        self._config = replace(self._config, **kw)
        return self

    def min_score(self, x: float) -> PipelineBuilder:
        return self._set(min_score=x)

    def max_submatrices(self, n: int) -> PipelineBuilder:
        return self._set(max_submatrices=n)

    def sort_by_score(self, on: bool) -> PipelineBuilder:
        return self._set(sort_by_score=on)

    def min_submatrix_size(self, rows: int, cols: int) -> PipelineBuilder:
        return self._set(min_submatrix_size=(rows, cols))

    def collect_stats(self, on: bool) -> PipelineBuilder:
        return self._set(collect_stats=on)

    def parallel(self, on: bool) -> PipelineBuilder:
        return self._set(parallel=on)

    def with_divide_merge(self, k: int, local, m: CoMatrix, **options) -> PipelineBuilder:
        """Divide and merge with a grid from the shape, adaptive merging, threshold .5 and parallel level 2."""
        options.setdefault("merge", MergeConfig("adaptive", merge_threshold=0.5, parallel_level=2))
        return self.with_clusterer(DivideMergeClusterer(DivideMerge.adaptive(m, k, local, **options)))

    def with_divide_merge_explicit(self, k: int, local, num_partitions: int, **options) -> PipelineBuilder:
        """Divide and merge on a ceil(sqrt(P)) square grid, one iteration."""
        a, b = explicit_grid(num_partitions)
        return self.with_clusterer(DivideMergeClusterer(DivideMerge(k, local, m_blocks=max(2, a), n_blocks=b, **options)))

    def build(self) -> Pipeline:
        if self._clusterer is None:
            raise PipelineError("Clusterer not set")
        if self._scorer is None:
            raise PipelineError("Scorer not set")
        return Pipeline(self._clusterer, self._scorer, self._config)
