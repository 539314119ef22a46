import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.sources import files, synthetic
from tessera.sources.matrix import CoMatrix


def test_npy_and_labels(spark, tmp_path):
    x = np.arange(12, dtype=np.float32).reshape(3, 4)
    np.save(tmp_path / "x.npy", x)
    m = files.read_npy(spark, str(tmp_path / "x.npy"))
    assert (m.n_rows, m.n_cols) == (3, 4) and np.array_equal(m.to_numpy(), x)
    files.write_npy(m, str(tmp_path / "y.npy"))
    assert np.array_equal(np.load(tmp_path / "y.npy"), x)
    np.save(tmp_path / "l.npy", np.array([2, 0, 1]))
    assert [r["label"] for r in files.read_labels_npy(spark, str(tmp_path / "l.npy")).orderBy("i").collect()] == [2, 0, 1]
    np.save(tmp_path / "b.npy", np.array([2, -1]))
    with pytest.raises(Exception, match="negative label"):
        files.read_labels_npy(spark, str(tmp_path / "b.npy")).collect()


def test_csv_parquet_market_npz(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,2\n3,4\n5,6\n")
    assert files.read_csv(spark, str(tmp_path / "x.csv"), 2).to_numpy().tolist() == [[1, 2], [3, 4], [5, 6]]
    m = CoMatrix.from_vec(spark, 2, 3, [1, 0, 2, 0, 3, 0])
    m = m.with_df(m.df.where("v <> 0"))
    files.write_parquet(m, str(tmp_path / "p"))
    assert np.array_equal(files.read_parquet(spark, str(tmp_path / "p"), 2, 3).to_numpy(), m.to_numpy())
    (tmp_path / "x.mtx").write_text("%%MatrixMarket matrix coordinate real general\n% note\n2 3 3\n1 1 1.0\n1 3 2.0\n2 2 3.0\n")
    assert np.array_equal(files.read_matrix_market(spark, str(tmp_path / "x.mtx")).to_numpy(), m.to_numpy())
    files.write_matrix_market(m, str(tmp_path / "w"))
    again = files.read_matrix_market(spark, [str(tmp_path / "w/0-header"), str(tmp_path / "w/1-entries")])
    assert np.array_equal(again.to_numpy(), m.to_numpy())
    np.savez(tmp_path / "x.npz", data=np.array([1.0, 2, 3]), indices=np.array([0, 2, 1]), indptr=np.array([0, 2, 3]), shape=np.array([2, 3]), format=b"csr")
    assert np.array_equal(files.read_npz(spark, str(tmp_path / "x.npz")).to_numpy(), m.to_numpy())


def test_results_and_display(spark, tmp_path):
    c = spark.createDataFrame([(0, [1, 2], [3], 0.5)], "cid long, row_indices array<long>, col_indices array<long>, score double")
    files.write_coclusters_csv(c, str(tmp_path / "c"))
    r = spark.read.csv(str(tmp_path / "c"), header=True).first()
    assert (r["cluster_id"], r["rows"], r["cols"]) == ("0", "1;2", "3")
    files.write_coclusters_json(c, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first()["row_indices"] == [1, 2]
    assert files.display(CoMatrix.from_vec(spark, 1, 2, [1, 2])).first()["line"] == "1.0000 2.0000"


def test_generators(spark):
    m = synthetic.sparse_separated(spark, 200, 100, 4, 0.9, 0.7)
    d = m.df.withColumn("own", synthetic.block_of("i", 200, 4) == synthetic.block_of("j", 100, 4)).groupBy("own").count().collect()
    n = {r["own"]: r["count"] for r in d}
    assert 0.6 < n[True] / sum(n.values()) < 0.8 and 0.08 < sum(n.values()) / 20_000 < 0.12
    e = synthetic.exponential_documents(spark, 40, 40)
    own = synthetic.block_of("i", 40, 4) == synthetic.block_of("j", 40, 4)
    mean = {r["own"]: r["m"] for r in e.df.withColumn("own", own).groupBy("own").agg(F.avg("v").alias("m")).collect()}
    assert mean[True] > 2 * mean[False]


def test_smart_records(spark):
    raw = ".I 1\n.T\nA title\n.A\nSomeone\n.W\nBody of\ntext\n.I 2\n.W\nOther\n"
    d = {r["doc"]: r for r in T.parse_smart(spark.createDataFrame([(raw,)], "value string")).collect()}
    assert d[1]["title"] == "A title" and d[1]["author"] == "Someone" and d[1]["body"] == "Body of text" and d[2]["body"] == "Other" and d[2]["title"] == ""


def test_dictionary_paths_agree(spark):
    from tessera.sources.matrix import indexed

    d = spark.range(500).select((F.col("id") * 37 % 211).alias("x"))
    one, two = (sorted(map(tuple, indexed(d, "x", small)[0].collect())) for small in (1000, 10))
    assert one == two == [(k, k) for k in range(211)]
