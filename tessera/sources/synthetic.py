"""Generated matrices. Values come from hashes of the indices, so every run and every engine makes the same ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .matrix import CoMatrix


def uniform(seed: int, *cols: Column) -> Column:
    """In [0, 1): 52 bits of the MD5 of ``seed:col:col``."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in cols]))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def grid(spark: SparkSession, n: int, m: int) -> DataFrame:
    return spark.range(n * m).select(F.expr(f"id div {m}").alias("i"), (F.col("id") % m).alias("j"))


def block_of(index: str, size: int, k: int) -> Column:
    """Which of k contiguous blocks an index lies in; the last takes the rest."""
    step = max(1, size // k)
    return F.least(F.expr(f"{index} div {step}"), F.lit(k - 1))


def planted(spark: SparkSession, n: int, m: int, k: int, lift: float = 2.0, seed: int = 0) -> CoMatrix:
    """U(0, 1) everywhere, ``lift`` added on k diagonal blocks."""
    v = uniform(seed, F.col("i"), F.col("j")) + F.when(block_of("i", n, k) == block_of("j", m, k), lift).otherwise(0.0)
    return CoMatrix(grid(spark, n, m).select("i", "j", v.alias("v")), n, m)


def planted_labels(spark: SparkSession, n: int, k: int) -> DataFrame:
    """(i, label) of the planted row blocks."""
    return spark.range(n).select(F.col("id").alias("i")).select("i", block_of("i", n, k).alias("label"))


def exponential_documents(spark: SparkSession, n: int, m: int, k: int = 4, inside: float = 0.3, outside: float = 1.0, seed: int = 0) -> CoMatrix:
    """Exponential values, of rate ``inside`` in a document's own block of features and ``outside`` elsewhere."""
    u = F.greatest(uniform(seed, F.col("i"), F.col("j")), F.lit(1e-12))
    rate = F.when(block_of("i", n, k) == block_of("j", m, k), inside).otherwise(outside)
    return CoMatrix(grid(spark, n, m).select("i", "j", (-F.log(u) / rate).alias("v")), n, m)


def sparse_separated(spark: SparkSession, n: int, m: int, k: int, sparsity: float = 0.95, separation: float = 0.7, seed: int = 0) -> CoMatrix:
    """A share 1 - sparsity of cells is stored; ``separation`` of them lie in the row's own block at full strength, the
    others are noise at 0.3 of it."""
    stored, value = (uniform(seed + s, F.col("i"), F.col("j")) for s in (0, 1))
    own = block_of("i", n, k) == block_of("j", m, k)
    keep = stored < (1 - sparsity) * F.when(own, F.lit(separation * k)).otherwise(F.lit((1 - separation) * k / max(1, k - 1)))
    d = grid(spark, n, m).select("i", "j", keep.alias("keep"), (value * F.when(own, 1.0).otherwise(0.3)).alias("v")).where("keep and v > 0")
    return CoMatrix(d.select("i", "j", "v"), n, m)


def block_diagonal(spark: SparkSession, n: int = 20, k: int = 2, high: float = 5.0, low: float = 0.1) -> CoMatrix:
    """``high`` in k diagonal blocks, ``low`` elsewhere."""
    return CoMatrix(grid(spark, n, n).select("i", "j", F.when(block_of("i", n, k) == block_of("j", n, k), high).otherwise(low).alias("v")), n, n)


def labels_from_sizes(sizes: DataFrame) -> DataFrame:
    """(i, label) of contiguous classes, from (label, size)."""
    from pyspark.sql import Window as W

    before = F.coalesce(F.sum("size").over(W.orderBy("label").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    d = sizes.select("label", "size", before.alias("start")).where("size > 0")
    return d.select(F.explode(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1)).alias("i"), "label")
