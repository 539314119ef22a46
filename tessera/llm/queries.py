"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from . import mixing, packing, pii, quality_rules, simhash, substring, toxicity, vafile, warc, weak_quality

MODULES = (simhash, pii, packing, weak_quality, toxicity, substring, warc, mixing, vafile, quality_rules)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()} | {"pipeline": pipeline}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in m.ORACLE_SQL.items()}
