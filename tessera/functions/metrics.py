"""Agreement of labels, coverage, consensus, run summaries and theoretical checks."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def contingency(labels: DataFrame, a: str = "t", b: str = "p") -> DataFrame:
    """(t, p, n): counts of label pairs, combined map-side."""
    return labels.groupBy(F.col(a).alias("t"), F.col(b).alias("p")).agg(F.count("*").cast("double").alias("n"))


def _marginals(c: DataFrame) -> DataFrame:
    t = c.groupBy("t").agg(F.sum("n").alias("nt"))
    p = c.groupBy("p").agg(F.sum("n").alias("np"))
    total = c.agg(F.sum("n").alias("n_all"))
    return c.join(t, "t").join(p, "p").crossJoin(F.broadcast(total))  # one row


def nmi(labels: DataFrame, a: str = "t", b: str = "p") -> DataFrame:
    """One row nmi = 2 I / (H_t + H_p), natural logs; 0 if both entropies are 0."""
    c = contingency(labels, a, b)
    m = _marginals(c)
    i = m.agg(F.sum(F.col("n") / F.col("n_all") * F.log(F.col("n") * F.col("n_all") / (F.col("nt") * F.col("np")))).alias("i"))

    def entropy(col: str, name: str) -> DataFrame:
        s = c.groupBy(col).agg(F.sum("n").alias("k"))
        return s.crossJoin(F.broadcast(c.agg(F.sum("n").alias("z")))).agg((-F.sum(F.col("k") / F.col("z") * F.log(F.col("k") / F.col("z")))).alias(name))

    d = i.crossJoin(entropy("t", "ht")).crossJoin(entropy("p", "hp"))
    h = F.col("ht") + F.col("hp")
    return d.select(F.when(h > 0, 2 * F.col("i") / h).otherwise(0.0).alias("nmi"))


def ari(labels: DataFrame, a: str = "t", b: str = "p") -> DataFrame:
    """One row ari, 0 where the denominator is next to 0."""
    c = contingency(labels, a, b)
    pairs = lambda x: x * (x - 1) / 2
    s = c.agg(F.sum(pairs(F.col("n"))).alias("s"), F.sum("n").alias("n"))
    side = lambda k, name: c.groupBy(k).agg(F.sum("n").alias("k")).agg(F.sum(pairs(F.col("k"))).alias(name))
    d = s.crossJoin(side("t", "a")).crossJoin(side("p", "b"))
    e = F.try_divide(F.col("a") * F.col("b"), pairs(F.col("n")))
    den = 0.5 * (F.col("a") + F.col("b")) - e
    return d.select(F.coalesce(F.when(F.abs(den) < 1e-12, 0.0).otherwise((F.col("s") - e) / den), F.lit(0.0)).alias("ari"))


def equivalent(labels: DataFrame, a: str = "t", b: str = "p") -> DataFrame:
    """One row equal: whether the labels are the same up to renaming (a bijection between the label sets)."""
    d = labels.select(F.col(a).alias("t"), F.col(b).alias("p")).distinct()
    one = lambda k, o: d.groupBy(k).agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(1)).alias(o))
    return one("t", "x").crossJoin(one("p", "y")).select(((F.col("x") == 1) & (F.col("y") == 1)).alias("equal"))


def coverage(coclusters: DataFrame, n_rows: int) -> DataFrame:
    """One row coverage: the share of rows in at least one co-cluster."""
    rows = coclusters.select(F.explode("row_indices").alias("i")).distinct()
    return rows.agg((F.count("*") / F.lit(float(max(1, n_rows)))).alias("coverage"))


def last_wins_labels(coclusters: DataFrame, n_rows: int) -> DataFrame:
    """(i, label): the last co-cluster (greatest cid) that holds a row; 0 for uncovered rows."""
    last = coclusters.select("cid", F.explode("row_indices").alias("i")).groupBy("i").agg(F.max("cid").alias("label"))
    rows = coclusters.sparkSession.range(n_rows).select(F.col("id").alias("i"))
    return rows.join(last, "i", "left").select("i", F.coalesce("label", F.lit(0)).cast("long").alias("label"))


def consensus_labels(coclusters: DataFrame, n_rows: int, k: int, max_iter: int = 200, seed: int = 0) -> DataFrame:
    """(i, label): k-means on the rows' 0/1 co-cluster memberships, as sparse vectors; all 0 without co-clusters."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import CountVectorizerModel

    spark = coclusters.sparkSession
    ids = coclusters.select("cid").distinct()
    if ids.isEmpty():
        return spark.range(n_rows).select(F.col("id").alias("i"), F.lit(0).cast("long").alias("label"))
    from ..session import cut
    from ..sources.matrix import indexed

    d, width = indexed(ids, "cid")
    m = coclusters.select("cid", F.explode("row_indices").alias("i")).join(d.select(F.col("key").alias("cid"), "idx"), "cid")
    sets = m.groupBy("i").agg(F.collect_set("idx").alias("s"))
    rows = spark.range(n_rows).select(F.col("id").alias("i")).join(sets, "i", "left")
    if k <= 1:
        return rows.select("i", F.lit(0).cast("long").alias("label"))
    words = rows.select("i", F.coalesce(F.transform("s", lambda j: j.cast("string")), F.array().cast("array<string>")).alias("w"))
    f = cut(CountVectorizerModel.from_vocabulary([str(j) for j in range(width)], "w", "features").setBinary(True).transform(words).select("i", "features"))
    models = [KMeans(k=k, maxIter=max_iter, seed=seed + r, initSteps=5).fit(f) for r in range(3)]
    model = min(models, key=lambda x: x.summary.trainingCost)
    return model.transform(f).select("i", F.col("prediction").cast("long").alias("label"))


def hierarchical_consensus(labelings: Sequence[DataFrame], n_rows: int, k: int, seed: int = 0) -> DataFrame:
    """(i, label) from several labelings (i, label), merged in pairs: each pair's labels are clusters of a consensus."""
    level = list(labelings)
    while len(level) > 1:
        up = []
        for a, b in zip(level[::2], level[1::2], strict=False):
            width = a.agg(F.coalesce(F.max("label"), F.lit(0)) + 1).first()[0]
            both = a.select("i", F.col("label").alias("cid")).unionAll(b.select("i", (F.col("label") + width).alias("cid")))
            up.append(consensus_labels(both.groupBy("cid").agg(F.sort_array(F.collect_list("i")).alias("row_indices")), n_rows, k, seed=seed))
        level = up + ([level[-1]] if len(level) % 2 else [])
    return level[0]


def block_labels_match(labels: DataFrame, size: int) -> DataFrame:
    """One row ok: whether rows below and from ``size`` on have one label each, and not the same."""
    d = labels.groupBy((F.col("i") < size).alias("first")).agg(F.min("label").alias("a"), F.max("label").alias("b"))
    return d.agg((F.bool_and(F.col("a") == F.col("b")) & (F.min("a") != F.max("a"))).alias("ok"))


def seed_summary(runs: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Mean, sample deviation (0 below two runs), population deviation and count by group."""
    return runs.groupBy(*by).agg(F.avg(value).alias("mean"), F.coalesce(F.nanvl(F.stddev_samp(value), F.lit(0.0)), F.lit(0.0)).alias("std"), F.stddev_pop(value).alias("std_pop"), F.count("*").alias("n"))


def student_t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|) for Student's t: the regularised incomplete beta function by its continued fraction."""
    if df <= 0 or math.isnan(t):
        return float("nan")
    x = df / (df + t * t)
    a, b = df / 2, 0.5

    def fraction(a: float, b: float, x: float) -> float:
        tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / (d if abs(d) > tiny else tiny)
        h = d
        for m in range(1, 300):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d, c = 1 + num * d, 1 + num / c
                d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
                h *= d * c
            if abs(d * c - 1) < 1e-15:
                break
        return h

    if x in (0.0, 1.0):
        return x
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))
    return front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, 1 - x) / b


def paired_t(runs: DataFrame, seed: str, method: str, value: str, ours: str, alpha: float = 0.01) -> DataFrame:
    """(other, n, diff, t, p, verdict) of one method against each other over common seeds."""
    a = runs.where(F.col(method) == ours).select(F.col(seed).alias("s"), F.col(value).alias("x"))
    b = runs.where(F.col(method) != ours).select(F.col(seed).alias("s"), F.col(method).alias("other"), F.col(value).alias("y"))
    d = b.join(a, "s").groupBy("other").agg(F.count("*").alias("n"), F.avg(F.col("x") - F.col("y")).alias("diff"), F.stddev_samp(F.col("x") - F.col("y")).alias("sd"))
    d = d.withColumn("t", F.try_divide(F.col("diff"), F.col("sd") / F.sqrt(F.col("n").cast("double"))))
    rows = [(r["other"], r["n"], r["diff"], r["t"], student_t_two_sided(r["t"], r["n"] - 1) if r["t"] is not None else None) for r in d.collect()]  # a row per method
    out = [(*r, None if r[4] is None else "n.s." if r[4] >= alpha else "win" if r[2] > 0 else "loss") for r in rows]
    return runs.sparkSession.createDataFrame(out, "other string, n long, diff double, t double, p double, verdict string")


# -- checks -------------------------------------------------------------------------------------------------------------


def preservation(truth: DataFrame, found: DataFrame, delta: float = 0.05, threshold: float = 0.7) -> DataFrame:
    """One row: total, preserved (best overlap with a found co-cluster at least the threshold), ratio (1 without truth),
    passed (ratio >= 1 - delta)."""
    from ..operators.merge import overlap_pairs

    best = overlap_pairs(truth, found).groupBy("lid").agg(F.max("overlap").alias("o"))
    d = truth.select(F.col("cid").alias("lid")).join(best, "lid", "left")
    s = d.agg(F.count("*").alias("total"), F.count_if(F.coalesce("o", F.lit(0.0)) >= threshold).alias("preserved"))
    ratio = F.when(F.col("total") > 0, F.col("preserved") / F.col("total")).otherwise(1.0)
    return s.select("total", "preserved", ratio.alias("ratio"), (ratio >= 1 - delta).alias("passed"))


def complexity(depth: int, n_partitions: int) -> tuple[int, int, bool]:
    """(depth, bound, passed) with the bound ceil(log2 P), 0 for no partition."""
    bound = 0 if n_partitions <= 1 else math.ceil(math.log2(n_partitions))
    return depth, bound, depth <= bound


def convergence(errors: Sequence[float], bound: Callable[[int], float]) -> bool:
    """Whether every error is within its bound."""
    return all(e <= bound(k) for k, e in enumerate(errors))


def spectral_gap(sigma: DataFrame, k: int, tau: float) -> DataFrame:
    """One row gap, passed: sigma_k - sigma_(k+1) > tau; false with k values or fewer. Input: (rank from 1, sigma)."""
    s = sigma.agg(F.max(F.when(F.col("rank") == k, F.col("sigma"))).alias("a"), F.max(F.when(F.col("rank") == k + 1, F.col("sigma"))).alias("b"))
    gap = F.col("a") - F.col("b")
    return s.select(gap.alias("gap"), F.coalesce(gap > tau, F.lit(False)).alias("passed"))


def report(checks: dict[str, tuple[bool, str]]) -> str:
    """A text report, PASS or FAIL by check."""
    lines = ["Theoretical validation", "-" * 22]
    lines += [f"[{'PASS' if ok else 'FAIL'}] {name}: {text}" for name, (ok, text) in checks.items()]
    return "\n".join([*lines, f"Overall: {'PASS' if all(ok for ok, _ in checks.values()) else 'FAIL'}"])


def class_distribution(labels: DataFrame, label: str = "label") -> DataFrame:
    return labels.groupBy(label).agg(F.count("*").alias("n"))


def speedup(runs: DataFrame) -> DataFrame:
    """(dataset, method, ratio, nmi_gain): standalone over divide-and-merge time and the gain in NMI.

    Input: dataset, method, variant (standalone or divide_merge), seconds, nmi.
    """
    s = runs.groupBy("dataset", "method").pivot("variant", ["standalone", "divide_merge"]).agg(F.avg("seconds").alias("s"), F.avg("nmi").alias("q"))
    return s.select("dataset", "method", F.try_divide("standalone_s", "divide_merge_s").alias("ratio"), (F.col("divide_merge_q") - F.col("standalone_q")).alias("nmi_gain"))


def best_runs(runs: DataFrame, by: str = "nmi", n: int = 10, ties: Sequence[str] = ()) -> DataFrame:
    """The ``n`` runs that are greatest by ``by``; ``ties`` orders equal ones."""
    return runs.orderBy(F.desc(by), *ties).limit(n)
