"""Matrix files: parquet, CSV, npy, npz (CSR), Matrix Market; and results as CSV, JSON and text."""

from __future__ import annotations

import ast
import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .matrix import COO, CoMatrix


def read_parquet(spark: SparkSession, path: str, n_rows: int | None = None, n_cols: int | None = None) -> CoMatrix:
    """A stored (i, j, v) table; float columns are widened."""
    return CoMatrix.from_coo(spark.read.parquet(path), n_rows, n_cols)


def write_parquet(m: CoMatrix, path: str) -> None:
    m.df.write.mode("overwrite").parquet(path)


def read_csv(spark: SparkSession, path: str, n_cols: int, header: bool = True) -> CoMatrix:
    """A numeric CSV, a row of the matrix per line in file order; the header line is skipped.

    Rows are numbered by position: the monotonic id orders lines by file and offset, and dense ranks follow from it.
    """
    schema = ", ".join(f"c{k} double" for k in range(n_cols))
    d = spark.read.csv(path, header=header, schema=schema, enforceSchema=True).select(F.monotonically_increasing_id().alias("m"), F.array(*[f"c{k}" for k in range(n_cols)]).alias("x"))
    from .matrix import indexed

    rows, n_rows = indexed(d, "m")
    rows = rows.select(F.col("key").alias("m"), F.col("idx").alias("i"))
    return CoMatrix.from_rows(d.join(rows, "m"), "i", "x", n_rows, n_cols)


def _npy_header(head: bytes) -> tuple[tuple[int, ...], bool, np.dtype, int]:
    if head[:6] != b"\x93NUMPY":
        raise ValueError("not an npy file")
    size = int.from_bytes(head[8:10], "little") if head[6] == 1 else int.from_bytes(head[8:12], "little")
    begin = 10 if head[6] == 1 else 12
    d = ast.literal_eval(head[begin : begin + size].decode("latin1"))
    return d["shape"], d["fortran_order"], np.dtype(d["descr"]), begin + size


def read_npy(spark: SparkSession, path: str) -> CoMatrix:
    """A 2-D npy file of any numeric type, widened to double. The file is one binary row (at most 2 GB), expanded on an
    executor; larger matrices belong in parquet."""
    files = spark.read.format("binaryFile").load(path).select("content")
    head = files.select(F.substring("content", 1, 4096)).first()[0]
    shape, _, _, _ = _npy_header(bytes(head))
    if len(shape) == 1:
        shape = (shape[0], 1)

    def run(batches):
        for b in batches:
            for c in b.column(0):
                x = np.load(io.BytesIO(c.as_py()))
                x = x.reshape(-1, 1) if x.ndim == 1 else x
                step = max(1, 100_000 // max(1, x.shape[1]))
                for k in range(0, x.shape[0], step):
                    part = x[k : k + step].astype(np.float64)
                    i, j = np.indices(part.shape)
                    yield pa.RecordBatch.from_arrays([pa.array(i.ravel() + k), pa.array(j.ravel()), pa.array(part.ravel())], ["i", "j", "v"])

    return CoMatrix(files.mapInArrow(run, COO), *shape)


def read_labels_npy(spark: SparkSession, path: str) -> DataFrame:
    """(i, label) from a 1-D integer npy file; negative labels are an error."""
    d = read_npy(spark, path).df.select("i", F.col("v").cast("long").alias("label"))
    return d.select("i", F.when(F.col("label") < 0, F.raise_error(F.lit("negative label"))).otherwise(F.col("label")).alias("label"))


def write_npy(m: CoMatrix, path: str) -> None:
    """A small matrix as an npy file on the driver's machine."""
    np.save(path, m.to_numpy())


def read_matrix_market(spark: SparkSession, path: str) -> CoMatrix:
    """A coordinate Matrix Market file (general or symmetric; pattern entries are 1), in one part or several.

    The size line is the first one that is no comment in the part with the header; parts are read in any order.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("o")).where(F.length(F.trim("value")) > 0)
    first = lines.where(F.col("value").startswith("%%MatrixMarket")).first()
    kind = (first["value"] if first else "").lower()
    p = F.split(F.trim("value"), r"\s+")
    body = lines.where(~F.col("value").startswith("%")).select(p.alias("p"), "f", "o", F.monotonically_increasing_id().alias("m"))
    here = F.lit(True) if first is None else F.col("f") == first["f"]
    size = body.agg(F.min(F.when(here, F.struct("o", "m", "p"))).alias("s")).first()["s"]
    if size is None:
        raise ValueError("no size line")
    n_rows, n_cols = int(size["p"][0]), int(size["p"][1])
    value = F.lit(1.0) if "pattern" in kind else F.element_at("p", 3).cast("double")
    d = body.where(F.col("m") != size["m"]).select((F.element_at("p", 1).cast("long") - 1).alias("i"), (F.element_at("p", 2).cast("long") - 1).alias("j"), value.alias("v"))
    if "symmetric" in kind:
        d = d.unionAll(d.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "v"))
    return CoMatrix(d, n_rows, n_cols)


def write_matrix_market(m: CoMatrix, path: str) -> None:
    """Part files of entries, the header in a file of its own that sorts first."""
    n = m.df.count()
    head = m.spark.range(1).select(F.lit(f"%%MatrixMarket matrix coordinate real general\n{m.n_rows} {m.n_cols} {n}").alias("value"))
    body = m.df.select(F.concat_ws(" ", (F.col("i") + 1).cast("string"), (F.col("j") + 1).cast("string"), F.col("v").cast("string")).alias("value"))
    head.coalesce(1).write.mode("overwrite").text(path + "/0-header")
    body.write.mode("overwrite").text(path + "/1-entries")


def read_npz(spark: SparkSession, path: str) -> CoMatrix:
    """A compressed-sparse-row npz archive (data, indices, indptr, shape), expanded on an executor."""
    files = spark.read.format("binaryFile").load(path).select("content")
    shape = np.load(io.BytesIO(bytes(files.first()[0])))["shape"]

    def run(batches):
        for b in batches:
            for c in b.column(0):
                z = np.load(io.BytesIO(c.as_py()))
                i = np.repeat(np.arange(len(z["indptr"]) - 1), np.diff(z["indptr"]))
                for k in range(0, len(i), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(i[k : k + 100_000]), pa.array(z["indices"][k : k + 100_000].astype(np.int64)), pa.array(z["data"][k : k + 100_000].astype(np.float64))], ["i", "j", "v"])

    return CoMatrix(files.mapInArrow(run, COO), int(shape[0]), int(shape[1]))


# -- results ------------------------------------------------------------------------------------------------------------


def export_rows(coclusters: DataFrame) -> DataFrame:
    """cluster_id, score, n_rows, n_cols and the index lists joined by semicolons."""
    join = lambda c: F.concat_ws(";", F.transform(c, lambda x: x.cast("string")))
    return coclusters.select(F.col("cid").alias("cluster_id"), "score", F.size("row_indices").alias("n_rows"), F.size("col_indices").alias("n_cols"), join("row_indices").alias("rows"), join("col_indices").alias("cols"))


def write_coclusters_csv(coclusters: DataFrame, path: str) -> None:
    export_rows(coclusters).write.mode("overwrite").csv(path, header=True)


def write_coclusters_json(coclusters: DataFrame, path: str) -> None:
    coclusters.write.mode("overwrite").json(path)


def display(m: CoMatrix) -> DataFrame:
    """(i, line): a printable line per row."""
    return m.dense().df.groupBy("i").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("j", "v"))), lambda x: F.format_number(x["v"], 4)), " ").alias("line"))
