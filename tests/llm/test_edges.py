"""Empty tables, nulls, repeated rows, clashing columns through every stage."""

import random

import pytest

import corpus_pipeline as C

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, id long, t string, fp long, key string, stays boolean, tokens long"
PAD = (0.0, True, 1, "t", 2, "k", False, 3)


def rows():
    r = random.Random(0)
    prose = lambda: " ".join("".join(r.choices("abcdefghij", k=r.randrange(2, 8))) for _ in range(60)).capitalize() + "."
    base = [(i, prose(), "en", f"s{i % 3}", 10) for i in range(40)]
    base += [(100, None, None, None, None), (101, "", "en", "s0", 0), (102, " \n\t ", None, "s1", 3), (None, "No id here at all, friend.", "de", "s2", 5), (5, base[5][1], "en", "s2", 10), (103, "long text, " * 40_000, "en", "s1", 1), (104, "x@y.example +1 (234) 555-0000", "en", "s0", 9)]
    return [(*r, *PAD) for r in base]


@pytest.mark.parametrize("data", [rows, list])
def test_stages(spark, sf, data):
    docs = spark.createDataFrame(data(), SCHEMA)
    for name, stage in C.STAGES:
        out = stage(spark, docs, sf)
        out.count()
        if name != "packing":
            assert out.columns == docs.columns, name
            assert data is list or out.count() > 0
