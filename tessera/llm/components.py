"""Connected components of an edge table by alternating large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(r)


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge, root the smallest node of its component.

    Each round is two hash aggregations and two joins over a shrinking edge table, checkpointed in the shared folder;
    rounds grow with the logarithm of the component's diameter. Only a row count and a checksum reach the driver.
    Self loops and null ends are ignored; an empty edge table gives an empty result.
    """
    e = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null and x <> y")
    e = cut(e.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct())
    seen = _mark(e)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        # Large star: every neighbour above u is linked to the least of u and its neighbours.
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        big = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: u and every neighbour below it are linked to the least of them.
        low = big.groupBy("u").agg(F.min("v").alias("m"))
        e = cut(big.join(low, "u").select(F.explode(F.array(F.col("v"), F.col("u"))).alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        now = _mark(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
