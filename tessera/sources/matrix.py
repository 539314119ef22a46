"""The matrix model: a (i, j, v) DataFrame with a shape.

Cells that are not stored are zero; dense statistics use the shape, never the number of stored cells. Indices are longs
from 0. Matrices are built from relational tables, dense rows, files or generators, and stay distributed: only shapes and
factors of a few columns reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut

COO = "i long, j long, v double"


@dataclass(frozen=True)
class CoMatrix:
    """Stored cells (i, j, v), one row each, and the shape."""

    df: DataFrame
    n_rows: int
    n_cols: int

    # -- construction ---------------------------------------------------------------------------------------------

    @classmethod
    def from_coo(cls, df: DataFrame, n_rows: int | None = None, n_cols: int | None = None) -> CoMatrix:
        """From columns i, j, v; a missing shape is read from the largest indices."""
        d = df.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v"))
        if n_rows is None or n_cols is None:
            r = d.agg(F.max("i"), F.max("j")).first()
            n_rows = n_rows if n_rows is not None else (r[0] + 1 if r[0] is not None else 0)
            n_cols = n_cols if n_cols is not None else (r[1] + 1 if r[1] is not None else 0)
        return cls(d, n_rows, n_cols)

    @classmethod
    def from_table(cls, df: DataFrame, row: Column | str, col: Column | str, value: Column | str, order: Column | str | None = None) -> CoMatrix:
        """Sum of ``value`` by (row, col) of a table; keys become indices in their sorted order.

        Sums combine map-side, so the last bits of doubles follow the table's partitions. With ``order`` each cell is summed
        from its least to its greatest order, one value after the other, as a serial read does: the same bits on any layout.
        """
        named = lambda c: F.col(c) if isinstance(c, str) else c
        t = df.select(named(row).alias("r"), named(col).alias("c"), named(value).cast("double").alias("v"), *([named(order).alias("o")] if order is not None else []))
        t = t.where("r is not null and c is not null")
        if order is None:
            sums = t.groupBy("r", "c").agg(F.sum("v").alias("v"))
        else:
            # A running sum adds row by row; the window sorts and spills, so no cell has to fit in memory.
            w = W.partitionBy("r", "c").orderBy("o", "v")
            t = t.select("r", "c", F.row_number().over(w).alias("k"), F.sum("v").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("v"))
            sums = t.groupBy("r", "c").agg(F.max_by("v", "k").alias("v"))
        # Stored once: the dictionaries and every later pass read the summed cells, not the table's joins.
        cells = cut(sums)
        (rows, n_rows), (cols, n_cols) = indexed(cells, "r"), indexed(cells, "c")
        d = cells.join(rows.select(F.col("key").alias("r"), F.col("idx").alias("i")), "r").join(cols.select(F.col("key").alias("c"), F.col("idx").alias("j")), "c")
        return cls(d.select("i", "j", F.coalesce("v", F.lit(0.0)).alias("v")), n_rows, n_cols)

    @classmethod
    def from_vec(cls, spark: SparkSession, n_rows: int, n_cols: int, values: Sequence[float]) -> CoMatrix:
        """From row-major values of a small matrix."""
        if len(values) != n_rows * n_cols:
            raise ValueError(f"{len(values)} values do not fill {n_rows} x {n_cols}")
        rows = [(k // n_cols, k % n_cols, float(x)) for k, x in enumerate(values)]
        return cls(spark.createDataFrame(rows, COO), n_rows, n_cols)

    @classmethod
    def from_rows(cls, df: DataFrame, row: str, values: str, n_rows: int, n_cols: int) -> CoMatrix:
        """From an array column, one row of the matrix each."""
        d = df.select(F.col(row).cast("long").alias("i"), F.posexplode(values).alias("j", "v"))
        return cls(d.select("i", F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v")), n_rows, n_cols)

    # -- views ------------------------------------------------------------------------------------------------------

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    @property
    def cells(self) -> int:
        return self.n_rows * self.n_cols

    def with_df(self, df: DataFrame) -> CoMatrix:
        return CoMatrix(df, self.n_rows, self.n_cols)

    def get(self, i: int, j: int) -> float | None:
        """One element; None out of bounds."""
        if not (0 <= i < self.n_rows and 0 <= j < self.n_cols):
            return None
        r = self.df.where((F.col("i") == i) & (F.col("j") == j)).agg(F.sum("v")).first()[0]
        return 0.0 if r is None else r

    def slice(self, rows: tuple[int, int], cols: tuple[int, int]) -> CoMatrix:
        """Rows and columns of half-open ranges, re-based to 0."""
        (a, b), (c, d) = rows, cols
        if not (0 <= a <= b <= self.n_rows and 0 <= c <= d <= self.n_cols):
            raise IndexError("slice out of bounds")
        part = self.df.where((F.col("i") >= a) & (F.col("i") < b) & (F.col("j") >= c) & (F.col("j") < d))
        return CoMatrix(part.select((F.col("i") - a).alias("i"), (F.col("j") - c).alias("j"), "v"), b - a, d - c)

    def corner(self, n: int, m: int) -> CoMatrix:
        """The top-left n x m part."""
        return self.slice((0, min(n, self.n_rows)), (0, min(m, self.n_cols)))

    def take(self, rows: Sequence[int], cols: Sequence[int]) -> CoMatrix:
        """Rows and columns by index lists, in their order, duplicates kept."""
        if not rows or not cols or min(rows) < 0 or min(cols) < 0 or max(rows) >= self.n_rows or max(cols) >= self.n_cols:
            raise IndexError("index list empty or out of bounds")
        r, c = index_table(self.spark, rows, "i", "ri"), index_table(self.spark, cols, "j", "cj")
        d = self.df.join(r, "i").join(c, "j").select(F.col("ri").alias("i"), F.col("cj").alias("j"), "v")
        return CoMatrix(d, len(rows), len(cols))

    def chunks(self, rows: int) -> DataFrame:
        """(chunk, i, j, v): row chunks of a fixed height, to be grouped and processed one by one."""
        return self.df.select(F.expr(f"i div {int(rows)}").alias("chunk"), "i", "j", "v")

    def transpose(self) -> CoMatrix:
        return CoMatrix(self.df.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"), self.n_cols, self.n_rows)

    def dense(self) -> CoMatrix:
        """Every cell stored, zeros included: a grid of the shape, left-joined."""
        grid = self.spark.range(self.cells).select(F.expr(f"id div {max(1, self.n_cols)}").alias("i"), (F.col("id") % max(1, self.n_cols)).alias("j"))
        return self.with_df(grid.join(self.df, ["i", "j"], "left").select("i", "j", F.coalesce("v", F.lit(0.0)).alias("v")))

    def overlay(self, other: DataFrame) -> CoMatrix:
        """Cells of ``other`` (i, j, v) written over this matrix."""
        o = other.select("i", "j", F.col("v").alias("new"))
        d = self.df.join(o, ["i", "j"], "full_outer").select("i", "j", F.coalesce("new", "v").alias("v"))
        return self.with_df(d)

    def row_vectors(self) -> DataFrame:
        """(i, x array<double>) of rows with a stored cell, zeros filled in."""
        m = self.df.groupBy("i").agg(F.map_from_entries(F.collect_list(F.struct(F.col("j"), F.col("v")))).alias("m"))
        at = F.sequence(F.lit(0).cast("long"), F.lit(self.n_cols - 1).cast("long"))
        return m.select("i", F.transform(at, lambda j: F.coalesce(F.element_at("m", j), F.lit(0.0))).alias("x"))

    def to_numpy(self, limit: int = 4_000_000):
        """A dense array on the driver, for small matrices only."""
        import numpy as np

        if self.cells > limit:
            raise ValueError(f"{self.cells} cells are more than {limit}")
        x = np.zeros((self.n_rows, self.n_cols))
        t = self.df.toPandas()
        np.add.at(x, (t["i"].to_numpy(), t["j"].to_numpy()), t["v"].to_numpy())
        return x


def indexed(df: DataFrame, key: str, small: int = 200_000) -> tuple[DataFrame, int]:
    """(key, idx) with dense indices from 0 in the keys' order, and the number of keys.

    Up to ``small`` keys are numbered in one task. More are range-partitioned and numbered within each partition, offset
    by the counts of earlier partitions, so no task sorts all keys.
    """
    keys = df.select(F.col(key).alias("key")).distinct()
    count = keys.count()
    if count <= small:
        return keys.select("key", (F.row_number().over(W.orderBy("key")).cast("long") - 1).alias("idx")), count
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # Stored first: the partition numbers must be the same wherever they are read.
    d = cut(keys.repartitionByRange(n, "key").withColumn("p", F.spark_partition_id()))
    d = d.withColumn("k", F.row_number().over(W.partitionBy("p").orderBy("key")).cast("long") - 1)
    sizes = d.groupBy("p").agg(F.count("*").alias("c"))
    # One row per partition.
    offsets = sizes.select("p", F.coalesce(F.sum("c").over(W.orderBy("p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("o"))
    return d.join(F.broadcast(offsets), "p").select("key", (F.col("k") + F.col("o")).alias("idx")), count


def dictionary(df: DataFrame, key: str) -> DataFrame:
    """(key, idx) of ``indexed``."""
    return indexed(df, key)[0]


def index_table(spark: SparkSession, idx: Sequence[int], name: str, place: str) -> DataFrame:
    """(name, place) of an index list. Lists come from the caller, so they are as small as the driver's memory allows;
    Spark broadcasts them below its own size threshold."""
    return spark.createDataFrame([(int(x), k) for k, x in enumerate(idx)], f"{name} long, {place} long")
