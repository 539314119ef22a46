"""Shared folder, intermediate tables and row keys for the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words: maximal runs of characters other than the six ASCII white-space characters. ``bytes.split()`` cuts alike.
WORD_SPLIT = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset a temporary one, on a local master only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def small(batches: Iterator[pa.RecordBatch], rows: int = 1000, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches with at most ``rows`` rows and about ``size`` bytes (a longer row is a slice of its own).

    Spark bounds its batches by bytes (spark.sql.execution.arrow.maxBytesPerBatch); what a worker builds from a batch of
    texts is several times as large, so it is built from slices.
    """
    for b in batches:
        step = max(1, min(rows, size * b.num_rows // max(1, b.nbytes)))
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: cuts the lineage; the copy survives the loss of any executor."""
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    The table is compact (columnar, zstd) and complete once written: later stages never recompute what made it.
    """
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_key(id_col: str, text_col: str) -> list[Column]:
    """Two columns that tell rows apart by id and text, nulls included; fully equal rows share a key."""
    return [
        F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("_k1"),
        F.xxhash64(F.col(id_col).isNull(), F.col(text_col).isNull(), F.col(text_col)).alias("_k2"),
    ]
