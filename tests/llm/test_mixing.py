import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing as M

SCHEMA = "doc_id long, text string, lang string, source string, tokens string, mix_ string, topic string"


def rows_for(r, n=1500):
    rows = []
    for i in range(n):
        s = "hot" if r.random() < 0.4 else f"s{r.randrange(6)}"
        rows.append((i, "w " * r.randrange(1, 60) + r.choice(["", " x@y ", " licensed "]), r.choice(["en", "en", "de", None]), s, "", "", ""))
    return rows + [(9000, None, "en", "hot", "", "", ""), (9001, "", None, None, "", "", ""), (None, "a b", "en", "s1", "", "", ""), (5, "again here", "en", "s1", "", "", ""), (9002, "x " * 50_000, "de", "s2", "", "", "")]


def brute(cells, targets, sweeps):
    w = dict(cells)
    for _ in range(sweeps):
        for d in range(3):
            sums = {}
            for c, v in w.items():
                sums[c[d]] = sums.get(c[d], 0) + v
            w = {c: v * targets[d].get(c[d], 0) / sums[c[d]] if sums[c[d]] else 0 for c, v in w.items()}
    total = sum(w.values())
    return {c: v / total for c, v in w.items()}


def test_raking_and_calibration(spark):
    df = spark.createDataFrame(rows_for(random.Random(1)), SCHEMA)
    want = {"source": {"hot": 0.2, **{f"s{i}": 0.8 / 6 for i in range(6)}}, "lang": {"en": 0.5, "de": 0.3, None: 0.2}}
    got = M.mix(df, targets=want, share=0.5, sweeps=30).collect()
    cells = {}
    for r in got:
        k = (r.mix.source, r.mix.lang, r.mix.topic)
        cells[k] = cells.get(k, 0) + r.mix.tokens
    topics = {}
    for (_, _, t), v in cells.items():
        topics[t] = topics.get(t, 0) + v
    roots = {t: v**0.5 for t, v in topics.items() if v}
    full = [{"source": want["source"], "lang": want["lang"]}["source"], want["lang"], {t: v / sum(roots.values()) for t, v in roots.items()}]
    w = brute(cells, full, 30)
    assert got[0].mix.residual < 1e-6
    p = {(r.mix.source, r.mix.lang, r.mix.topic): r.mix.p for r in got}
    assert abs(sum(p[c] * t for c, t in cells.items()) - 0.5 * sum(cells.values())) < 1e-6 * sum(cells.values())
    # p is proportional to weight / tokens wherever it is below 1.
    ratio = [p[c] * t / w[c] for c, t in cells.items() if t and w[c] > 0 and p[c] < 1]
    assert max(ratio) - min(ratio) < 1e-6 * max(ratio)
    assert all(p[c] == 1 for c, t in cells.items() if not t)
    kept = {r.mix.kept for r in got if r.doc_id == 5}
    assert len(kept) == 1 or len({r.mix.p for r in got if r.doc_id == 5}) > 1
    assert df.columns == M.sample(df).columns


def test_every_category_keeps_its_target_at_any_size(spark):
    """Rare sources, values named like stand-ins, and the sweeps by joins: the same p as in one row."""
    rows = rows_for(random.Random(2), 300) + [(10_000 + i, "a b c " * (i % 5 + 1), "en", x, "", "", "") for i, x in enumerate(["rare", "other", "null", "-", "=", *(f"site{k}" for k in range(40))])]
    df = spark.createDataFrame(rows, SCHEMA)
    want = {"source": {"rare": 0.3, "hot": 0.3, **{f"s{i}": 0.05 for i in range(6)}, "null": 0.1, None: 0.0}}
    one = {(r.doc_id, r.mix.source, r.mix.lang): r.mix for r in M.mix(df, targets=want, share=0.01, sweeps=6).collect()}
    many = {(r.doc_id, r.mix.source, r.mix.lang): r.mix for r in M.mix(df, targets=want, share=0.01, in_row=0, sweeps=6, broadcast_rows=0).collect()}
    assert len(one) == len(many) == df.count() and all(abs(m.p - many[k].p) < 1e-6 for k, m in one.items())
    p = {k[1]: m.p for k, m in one.items() if m.tokens}
    assert p["rare"] > p["hot"] > 0 and p["null"] > 0 and p["other"] == p["-"] == p["="] == p["site1"] == 0


def test_contradicting_targets_are_reported(spark):
    """en only comes with a, de only with b, so these shares can't both hold."""
    rows = [(i, "w " * 9, "en" if i % 2 else "de", "a" if i % 2 else "b", "", "", "") for i in range(40)]
    got = M.mix(spark.createDataFrame(rows, SCHEMA), targets={"source": {"a": 0.9, "b": 0.1}, "lang": {"en": 0.5, "de": 0.5}}, sweeps=20).collect()
    assert len(got) == 40 and got[0].mix.residual > 0.1


def test_oracle(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(M.ORACLE_SQL["op8_ipf_mixing"]).fetchdf()
    got = M.op8_ipf_mixing(spark, sf).toPandas()
    a, b = (x[sorted(x.columns)].sort_values("doc_id").reset_index(drop=True) for x in (want, got))
    assert a.equals(b[a.columns].astype(a.dtypes.to_dict()))


def test_empty_and_draw(spark):
    assert M.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    u = [r[0] for r in spark.range(20_000).select(M.draw(F.col("id"), 8)).collect()]
    assert 0 <= min(u) and max(u) < 1 and sum(u) / len(u) == pytest.approx(0.5, abs=0.01)
