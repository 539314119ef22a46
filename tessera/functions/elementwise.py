"""Element-wise functions, normalisers and predicates of matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.matrix import CoMatrix

EPS = 1e-10  #: sums below it scale to zero, and the guard in factor updates
TINY = 1e-15  #: what counts as zero in embeddings and sparsity


def nan_to_num(x: Column) -> Column:
    """Non-finite and null values become 0."""
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def mu_update(base: Column, num: Column, den: Column, eps: float = EPS) -> Column:
    """base * num / (den + eps), non-finite to 0."""
    return nan_to_num(base * F.try_divide(num, den + F.lit(eps)))


def mu_sqrt_update(base: Column, num: Column, den: Column, eps: float = EPS) -> Column:
    """base * sqrt(num / (den + eps)), non-finite to 0."""
    return nan_to_num(base * F.sqrt(F.try_divide(num, den + F.lit(eps))))


def inverse_sqrt(total: Column, eps: float = EPS) -> Column:
    """total^-1/2; 0 where the total is next to zero."""
    return F.when(F.abs(total) < eps, 0.0).otherwise(F.pow(total, F.lit(-0.5)))


def row_col_sums(m: CoMatrix) -> DataFrame:
    """(i, j, total): row sums (j null), column sums (i null) and the grand total (both null) in one scan."""
    return m.df.groupingSets([["i"], ["j"], []], "i", "j").agg(F.sum("v").alias("total"))


def check_non_negative(m: CoMatrix) -> None:
    low = m.df.agg(F.min("v")).first()[0]
    if low is not None and low < 0:
        raise ValueError(f"negative value {low}")


def binormalize(m: CoMatrix) -> CoMatrix:
    """D_r^-1/2 X D_c^-1/2 with row and column sums; sums next to zero scale to 0.

    Sums are combined map-side and joined back; Spark broadcasts them while they are small, so cells don't move.
    """
    rows = m.df.groupBy("i").agg(inverse_sqrt(F.sum("v")).alias("r"))
    cols = m.df.groupBy("j").agg(inverse_sqrt(F.sum("v")).alias("c"))
    d = m.df.join(rows, "i").join(cols, "j")
    return m.with_df(d.select("i", "j", (F.col("v") * F.col("r") * F.col("c")).alias("v")))


def l2_normalize(x: Column) -> Column:
    """An array over its length; arrays next to zero stay."""
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v))
    return F.when(norm > TINY, F.transform(x, lambda v: v / norm)).otherwise(x)


def row_l2_normalize(m: CoMatrix) -> CoMatrix:
    norms = m.df.groupBy("i").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("n"))
    v = F.when(F.col("n") > TINY, F.col("v") / F.col("n")).otherwise(F.col("v"))
    return m.with_df(m.df.join(norms, "i").select("i", "j", v.alias("v")))


def is_zero_vector(x: Column) -> Column:
    """Whether every entry of an array is next to zero: such rows stay unassigned."""
    return F.forall(x, lambda v: F.abs(v) < TINY)


def strip_zeros(m: CoMatrix) -> tuple[CoMatrix, DataFrame, DataFrame]:
    """Rows and columns without a non-zero cell left out: the packed matrix and the (old, new) index tables."""
    from ..sources.matrix import indexed

    d = m.df.where(F.abs("v") > TINY)
    (rows, n), (cols, k) = ((x.select(F.col("key").alias("old"), F.col("idx").alias("new")), n) for x, n in (indexed(d, "i"), indexed(d, "j")))
    packed = d.join(rows.select(F.col("old").alias("i"), F.col("new").alias("ri")), "i").join(cols.select(F.col("old").alias("j"), F.col("new").alias("cj")), "j")
    return CoMatrix(packed.select(F.col("ri").alias("i"), F.col("cj").alias("j"), "v"), n, k), rows, cols


def expand(vectors: DataFrame, index: DataFrame, n: int, width: int) -> DataFrame:
    """(i, x) of packed vectors back at their old indices; stripped ones get zero vectors."""
    spark = vectors.sparkSession
    d = vectors.join(index.select(F.col("new").alias("i"), "old"), "i").select(F.col("old").alias("i"), "x")
    zero = F.array(*[F.lit(0.0)] * width)
    return spark.range(n).withColumnRenamed("id", "i").join(d, "i", "left").select("i", F.coalesce("x", zero).alias("x"))


def zscore(m: CoMatrix) -> CoMatrix:
    """(v - mean) / sample deviation over all cells, unstored zeros included; a constant matrix becomes 0."""
    s = m.df.agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
    n = float(m.cells)
    mean, var = F.col("s") / n, (F.col("q") - F.col("s") * F.col("s") / n) / max(1.0, n - 1)
    d = m.dense().df.crossJoin(F.broadcast(s.select(mean.alias("mean"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("sd"))))  # one row
    return m.with_df(d.select("i", "j", F.when(F.col("sd") > 0, (F.col("v") - F.col("mean")) / F.col("sd")).otherwise(0.0).alias("v")))


def log1p_fill(m: CoMatrix, fill: float = 0.0) -> CoMatrix:
    """ln(1 + v), missing and NaN values filled first."""
    v = F.coalesce(F.nanvl("v", F.lit(fill)), F.lit(fill))
    return m.with_df(m.df.select("i", "j", F.log1p(v).alias("v")))


def global_normalize(m: CoMatrix) -> CoMatrix:
    """Values over the sum of all (plus 1e-16)."""
    total = m.df.agg((F.coalesce(F.sum("v"), F.lit(0.0)) + 1e-16).alias("t"))
    return m.with_df(m.df.crossJoin(F.broadcast(total)).select("i", "j", (F.col("v") / F.col("t")).alias("v")))  # one row


def density(m: CoMatrix) -> DataFrame:
    """nnz, density and sparsity in one row."""
    nnz = F.count_if(F.abs("v") > TINY)
    n = max(1, m.cells)
    return m.df.agg(nnz.alias("nnz"), (nnz / F.lit(float(n))).alias("density"), (1 - nnz / F.lit(float(n))).alias("sparsity"))


def sparsity_warning(m: CoMatrix, n_blocks: int, limit: float = 0.95) -> str | None:
    """A note where column splits are asked for on a matrix sparser than ``limit``."""
    s = density(m).first()["sparsity"]
    return f"sparsity {s:.3f}: column blocks tend to lose structure, prefer n_blocks=1" if s > limit and n_blocks > 1 else None


def normalize_membership(m: CoMatrix) -> CoMatrix:
    """Rows over their sums (rows that sum to 0 stay)."""
    total = F.sum("v").over(W.partitionBy("i"))
    return m.with_df(m.df.select("i", "j", F.when(total != 0, F.col("v") / total).otherwise(F.col("v")).alias("v")))


def drop_rows(m: CoMatrix, rows: DataFrame) -> DataFrame:
    """Cells of the rows that are not in ``rows`` (i)."""
    return m.df.join(rows.select("i"), "i", "left_anti")


def column_norms(m: CoMatrix, order: int = 2) -> DataFrame:
    """(j, norm): L1 or L2 norms of the columns."""
    v = F.sum(F.abs("v")) if order == 1 else F.sqrt(F.sum(F.col("v") * F.col("v")))
    return m.df.groupBy("j").agg(v.alias("norm"))


def normalize_columns(m: CoMatrix, order: int = 2) -> CoMatrix:
    d = m.df.join(column_norms(m, order), "j")
    return m.with_df(d.select("i", "j", F.when(F.col("norm") > 0, F.col("v") / F.col("norm")).otherwise(0.0).alias("v")))


def normalize_pair(w: CoMatrix, h: CoMatrix, order: int = 2) -> tuple[CoMatrix, CoMatrix]:
    """Columns of W to norm 1, those of H scaled by what W's had: W H^T stays."""
    norms = column_norms(w, order)
    hd = h.df.join(norms, "j", "left").select("i", "j", (F.col("v") * F.coalesce("norm", F.lit(0.0))).alias("v"))
    return normalize_columns(w, order), h.with_df(hd)
