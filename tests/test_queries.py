"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tessera.plans import queries as Q

TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()
SLOW = {"scc_sparse", "power_iteration_sigma1", "randomized_svd_residual", "sign_partition", "scc_labels", "spectral_cocluster", "global_fnmf", "global_nbvd", "divide_merge_scc", "divide_merge_nbvd"}


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def rows(cols, data):
    flat = lambda v: v if v is None or isinstance(v, (str, bool)) else float(v)
    return sorted([tuple(flat(v) for _, v in sorted(zip(cols, r, strict=True))) for r in data], key=str)


@pytest.mark.parametrize("name", sorted(set(Q.ORACLE_SQL) - SLOW))
def test_against_sql(spark, sf, con, name):
    d = Q.QUERIES[name](spark, sf)
    want = con.execute(Q.ORACLE_SQL[name])
    cols = [x[0] for x in want.description]
    assert sorted(d.columns) == sorted(cols)
    assert rows(d.columns, d.collect()) == rows(cols, want.fetchall())


def test_row_vectors_on_any_layout_of_the_events(spark, tmp_path):
    """Sums that end in .5: their last bit, so the rounded number, must not follow the files that events lie in."""
    r = random.Random(8)
    events = []
    for user in range(120):
        for kind in range(5):
            cents = [r.randrange(1, 9000) for _ in range(11)]
            cents.append(50 - sum(cents) % 100 + 300)
            events += [(user, f"e{kind}", c / 100) for c in cents]
    r.shuffle(events)
    events = pa.table({"event_id": range(len(events)), **{n: [e[k] for e in events] for k, n in enumerate(("user_id", "event_type", "value"))}})
    c = duckdb.connect(config={"threads": 1})
    c.register("events", events)
    want = sorted(c.execute(Q.ORACLE_SQL["row_vectors"]).fetchall())
    for files in (1, 7):
        path = tmp_path / str(files) / "events.parquet"
        path.mkdir(parents=True)
        step = -(-events.num_rows // files)
        for k in range(files):
            pq.write_table(events.slice(k * step, step), path / f"part-{k}.parquet")
        assert sorted(map(tuple, Q.QUERIES["row_vectors"](spark, str(path.parent)).collect())) == want


def test_every_oracle_has_a_query():
    assert set(Q.ORACLE_SQL) <= set(Q.QUERIES)


def test_entry(spark):
    import __spark_entry__ as e

    d = e.entry(spark)
    assert d.columns == ["cid", "row_indices", "col_indices", "score"] and d.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
