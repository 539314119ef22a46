"""Merging co-cluster sets: overlap, union, intersection, weighted, adaptive; the merge tree and its round metrics.

A set is a DataFrame (node, pos, row_indices, col_indices, ...): pos orders the clusters within a node, so "first wins" is
well defined. Two nodes 2k and 2k + 1 merge into node k of the next level.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut


@dataclass(frozen=True)
class MergeConfig:
    """merge_threshold, rescore_merged and parallel_level are accepted; they change nothing outside the intersection."""

    strategy: str = "adaptive"
    overlap_threshold: float = 0.5
    left_weight: float = 0.5
    right_weight: float = 0.5
    merge_threshold: float = 0.5
    rescore_merged: bool = True
    parallel_level: int = 10


def jaccard(a: Column, b: Column) -> Column:
    """|a and b| / |a or b| of index sets; 0 if both are empty."""
    u = F.size(F.array_union(a, b))
    return F.when(u == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / u)


def overlap(r1: Column, c1: Column, r2: Column, c2: Column) -> Column:
    """sqrt(Jaccard of rows * Jaccard of columns)."""
    return F.sqrt(jaccard(r1, r2) * jaccard(c1, c2))


def overlap_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(lid, rid, overlap) of the pairs that share a row and a column; all others have overlap 0.

    Shared members are counted by equi-joins on (row) and (column), so pairs without a common row are never made.
    Both sides have cid, row_indices and col_indices.
    """

    def shared(col: str, name: str) -> DataFrame:
        a = left.select(F.col("cid").alias("lid"), F.explode(F.array_distinct(col)).alias("x"))
        b = right.select(F.col("cid").alias("rid"), F.explode(F.array_distinct(col)).alias("x"))
        return a.join(b, "x").groupBy("lid", "rid").agg(F.count("*").alias(name))

    sizes = lambda d, k: d.select(F.col("cid").alias(k), F.size(F.array_distinct("row_indices")).alias(f"{k}_r"), F.size(F.array_distinct("col_indices")).alias(f"{k}_c"))
    p = shared("row_indices", "sr").join(shared("col_indices", "sc"), ["lid", "rid"]).join(sizes(left, "lid"), "lid").join(sizes(right, "rid"), "rid")
    jr = F.col("sr") / (F.col("lid_r") + F.col("rid_r") - F.col("sr"))
    jc = F.col("sc") / (F.col("lid_c") + F.col("rid_c") - F.col("sc"))
    return p.select("lid", "rid", F.sqrt(jr * jc).alias("overlap"))


def merge_union(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct clusters (equal index vectors, the first wins, left before right) and a row of kept and score.

    Input: pos, row_indices, col_indices. The score is kept / (L + R), 0 if both are empty.
    """
    u = left.withColumn("side", F.lit(0)).unionByName(right.withColumn("side", F.lit(1)))
    first = u.groupBy("row_indices", "col_indices").agg(F.min(F.struct("side", "pos")).alias("at"))
    kept = first.select("at.side", "at.pos", "row_indices", "col_indices")
    counts = u.agg(F.count("*").alias("n")).crossJoin(kept.agg(F.count("*").alias("kept")))
    return kept, counts.select("kept", F.when(F.col("n") > 0, F.col("kept") / F.col("n")).otherwise(0.0).alias("score"))


def merge_intersection(left: DataFrame, right: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The left cluster of every pair whose overlap reaches the threshold (so possibly more than once), and a row of
    kept and score, the mean overlap over all L x R pairs (0 if a side is empty). Input: cid, row_indices, col_indices.

    With a threshold above 0 only pairs that share members can match; a threshold of 0 or less matches every pair, and
    the left clusters are repeated by the right side's count without building the pairs' overlaps.
    """
    pairs = overlap_pairs(left, right)
    counts = left.agg(F.count("*").alias("l")).crossJoin(right.agg(F.count("*").alias("r")))
    if threshold > 0:
        hit = pairs.where(F.col("overlap") >= threshold).join(left.select(F.col("cid").alias("lid"), "row_indices", "col_indices"), "lid")
    else:
        n = right.agg(F.count("*").alias("r"))
        hit = left.crossJoin(F.broadcast(n)).where("r > 0").select(F.col("cid").alias("lid"), F.explode(F.sequence(F.lit(1), F.col("r").cast("int"))).alias("rid"), "row_indices", "col_indices")
    stats = hit.agg(F.count("*").alias("kept")).crossJoin(pairs.agg(F.coalesce(F.sum("overlap"), F.lit(0.0)).alias("s"))).crossJoin(counts)
    n = F.col("l") * F.col("r")
    return hit.select("lid", "rid", "row_indices", "col_indices"), stats.select("kept", F.when(n > 0, F.col("s") / n).otherwise(0.0).alias("score"))


def weighted_score(l: Column, r: Column, lw: float, rw: float) -> Column:  # noqa: E741
    return F.lit(float(lw)) * l + F.lit(float(rw)) * r


def adaptive_score(l: Column, r: Column, kept: Column) -> Column:  # noqa: E741
    """The union score where the sides' counts are within a factor of two, else weighted .7 to the larger side."""
    ratio = l / F.greatest(r, F.lit(1))
    union = F.when(l + r > 0, kept / (l + r)).otherwise(0.0)
    return F.when((ratio > 0.5) & (ratio < 2.0), union).otherwise(F.when(l > r, weighted_score(l, r, 0.7, 0.3)).otherwise(weighted_score(l, r, 0.3, 0.7)))


def pad_to_power_of_two(n: int) -> int:
    return 1 if n <= 1 else 1 << (n - 1).bit_length()


def tree_depth(n: int) -> int:
    return 0 if n <= 1 else math.ceil(math.log2(n))


def merge_tree(leaves: DataFrame, n_leaves: int, config: MergeConfig = MergeConfig()) -> tuple[DataFrame, DataFrame]:
    """The merged clusters (pos, row_indices, col_indices) and the rounds (round, num_clusters, avg_merge_score, num_merges).

    ``leaves``: node (0-based), pos, row_indices, col_indices. Leaves are padded with empty ones to a power of two. The
    union, weighted and adaptive strategies keep the same clusters and differ in scores only: each level is one grouped
    distinct. The intersection joins siblings on shared members.
    """
    level = leaves.select("node", "pos", "row_indices", "col_indices")
    size = pad_to_power_of_two(n_leaves)
    spark = leaves.sparkSession
    rounds = [level.agg(F.lit(0).alias("round"), F.count("*").alias("num_clusters"), F.lit(0.0).alias("avg_merge_score"), F.lit(0).cast("long").alias("num_merges"))]
    k, width = 0, level.agg(F.coalesce(F.max("pos"), F.lit(0)) + 1).first()[0]
    while size > 1:
        k, size = k + 1, size // 2
        counts = level.groupBy(F.shiftright("node", 1).alias("node")).agg(F.count_if(F.col("node") % 2 == 0).alias("l"), F.count_if(F.col("node") % 2 == 1).alias("r"))
        nodes = spark.range(size).select(F.col("id").alias("node")).join(counts, "node", "left").na.fill(0, ["l", "r"])
        up = level.select(F.shiftright("node", 1).alias("node"), (F.col("node") % 2).alias("side"), "pos", "row_indices", "col_indices")
        if config.strategy == "intersection":
            keyed = up.withColumn("cid", F.struct("side", "pos", "node"))
            lhs, rhs = (keyed.where(F.col("side") == s).select(F.col("node").alias(f"n{s}"), F.struct("node", "pos").alias("cid"), "row_indices", "col_indices") for s in (0, 1))
            pairs = _sibling_overlaps(lhs.withColumnRenamed("n0", "node"), rhs.withColumnRenamed("n1", "node"))
            sums = pairs.groupBy("node").agg(F.sum("overlap").alias("s"))
            hit = pairs.where(F.col("overlap") >= config.overlap_threshold).join(lhs.select(F.col("n0").alias("node"), F.col("cid").alias("lid"), "row_indices", "col_indices"), ["node", "lid"])
            new = hit.withColumn("at", F.row_number().over(W.partitionBy("node").orderBy("lid", "rid")).cast("long") - 1).select("node", F.col("at").alias("pos"), "row_indices", "col_indices")
            n = F.col("l") * F.col("r")
            scored = nodes.join(sums, "node", "left").select(F.when(n > 0, F.coalesce("s", F.lit(0.0)) / n).otherwise(0.0).alias("score"))
        else:
            first = up.groupBy("node", "row_indices", "col_indices").agg(F.min(F.struct("side", "pos")).alias("at"))
            # Order: left before right, then the old place; gaps are harmless.
            new = first.select("node", (F.col("at.side") * F.lit(width) + F.col("at.pos")).alias("pos"), "row_indices", "col_indices")
            kept = new.groupBy("node").agg(F.count("*").alias("kept"))
            t = nodes.join(kept, "node", "left").na.fill(0, ["kept"])
            l, r, n = F.col("l"), F.col("r"), F.col("l") + F.col("r")  # noqa: E741
            score = {"union": F.when(n > 0, F.col("kept") / n).otherwise(0.0), "weighted": weighted_score(l, r, config.left_weight, config.right_weight), "adaptive": adaptive_score(l, r, F.col("kept"))}[config.strategy]
            scored = t.select(score.cast("double").alias("score"))
        level, width = cut(new), 2 * width  # places of the next level
        rounds.append(level.agg(F.count("*").alias("num_clusters")).crossJoin(scored.agg(F.avg("score").alias("avg_merge_score"), F.count("*").alias("num_merges"))).select(F.lit(k).alias("round"), "num_clusters", "avg_merge_score", "num_merges"))
    return level.select("pos", "row_indices", "col_indices"), reduce(DataFrame.unionAll, rounds)


def _sibling_overlaps(lhs: DataFrame, rhs: DataFrame) -> DataFrame:
    """(node, lid, rid, overlap) of siblings' clusters that share members."""
    left = lhs.select(F.col("node"), F.col("cid").alias("lid"), "row_indices", "col_indices")
    right = rhs.select(F.col("node"), F.col("cid").alias("rid"), "row_indices", "col_indices")

    def shared(col: str, name: str) -> DataFrame:
        p = left.select("node", "lid", F.explode(F.array_distinct(col)).alias("x"))
        q = right.select("node", "rid", F.explode(F.array_distinct(col)).alias("x"))
        return p.join(q, ["node", "x"]).groupBy("node", "lid", "rid").agg(F.count("*").alias(name))

    size = lambda d, k: d.select("node", k, F.size(F.array_distinct("row_indices")).alias(f"{k}_r"), F.size(F.array_distinct("col_indices")).alias(f"{k}_c"))
    p = shared("row_indices", "sr").join(shared("col_indices", "sc"), ["node", "lid", "rid"]).join(size(left, "lid"), ["node", "lid"]).join(size(right, "rid"), ["node", "rid"])
    jr = F.col("sr") / (F.col("lid_r") + F.col("rid_r") - F.col("sr"))
    jc = F.col("sc") / (F.col("lid_c") + F.col("rid_c") - F.col("sc"))
    return p.select("node", "lid", "rid", F.sqrt(jr * jc).alias("overlap"))


def union_dc(items: list, combine: Callable, done: Callable[[list], bool]) -> list:
    """Fold a queue: the two front items are combined and pushed back until ``done``."""
    q = list(items)
    while len(q) > 1 and not done(q):
        a, b, *q = q
        q.append(combine(a, b))
    return q


def vote_labels(votes: DataFrame) -> DataFrame:
    """(i, label) by the most votes, the least label on ties. Votes are (i, label), one row each; sums commute, so the
    order in which partial results are paired does not matter."""
    n = votes.groupBy("i", "label").agg(F.count("*").alias("n"))
    return n.groupBy("i").agg(F.max_by("label", F.struct("n", (-F.col("label")).alias("m"))).alias("label"))


def greedy_overlap(members: DataFrame, k: int, limit: int = 100_000) -> DataFrame:
    """(i, label): columns of the row-by-cluster membership are max-merged, the pair with the most common rows first (the
    first pair on ties), until k are left; rows take the first column they belong to. Members are (i, cid).

    Rows with equal cluster sets are counted together; the distinct sets (at most ``limit``) are merged on the driver.
    """
    sets = members.groupBy("i").agg(F.sort_array(F.collect_set("cid")).alias("s"))
    patterns = [(frozenset(r["s"]), r["n"]) for r in sets.groupBy("s").agg(F.count("*").alias("n")).orderBy("s").limit(limit + 1).collect()]
    if len(patterns) > limit:
        raise ValueError(f"more than {limit} distinct cluster sets")
    groups = {c: {c} for s, _ in patterns for c in s}
    while len(groups) > max(1, k):
        keys = sorted(groups)
        has = [({g for g in keys if groups[g] & s}, n) for s, n in patterns]
        common = {(a, b): 0 for x, a in enumerate(keys) for b in keys[x + 1 :]}
        for own, n in has:
            o = sorted(own)
            for x, a in enumerate(o):
                for b in o[x + 1 :]:
                    common[a, b] += n
        a, b = max(common, key=lambda p: (common[p], -p[0], -p[1]))
        groups[a] |= groups.pop(b)
    label = [(c, x) for x, (_, own) in enumerate(sorted(groups.items())) for c in sorted(own)]
    t = members.sparkSession.createDataFrame(label, "cid long, label long")
    return members.join(t, "cid").groupBy("i").agg(F.min("label").alias("label"))
