import os

from pyspark.sql import functions as F

import corpus_pipeline as C
from tessera.llm import packing, simhash


def test_stages_on_the_smallest_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [docs]
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, seen[-1], sf)
        assert out.columns == docs.columns, name
        # As between stages of a run: written and read again.
        path = f"{os.environ.get('TMPDIR', '/tmp')}/tessera-test-{os.getpid()}-{len(seen)}"
        out.write.mode("overwrite").parquet(path)
        seen.append(spark.read.parquet(path))
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in seen]
    assert all(a >= b for a, b in zip(ids, ids[1:])) and ids[2] == ids[3] and ids[4]
    # Good labelled documents stay in the quality stage; bad ones go.
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good = [i for i, q in labels.items() if q == 1 and i in ids[0]]
    assert sum(i in ids[1] for i in good) >= 0.97 * len(good)
    # One document of each group is left: none of the kept ones are linked.
    assert simhash.near_duplicates(seen[2]).where("doc_id <> component_id").count() == 0
    # Personal data is out, and lengths follow.
    assert seen[3].where(F.col("text").rlike(r"[A-Za-z0-9]@[A-Za-z0-9-]+\.[a-z]") | (F.length("text") != F.col("n_chars"))).count() == 0
    pieces = C.STAGES[-1][1](spark, seen[-1], sf)
    want = sum(len(packing.encoder(packing.default_tokenizer())(r.text)) + 1 for r in seen[-1].collect())
    assert pieces.agg(F.sum("length")).first()[0] == want


def test_run(spark, sf):
    d = C.run(spark, sf)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(d.columns) and d.count() > 0 and C.ORACLE_SQL is None
