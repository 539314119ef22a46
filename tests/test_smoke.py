import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import elementwise as E
from tessera.functions import linalg as L
from tessera.functions import metrics as X
from tessera.operators import atoms as A
from tessera.operators.clusterers import BasicCoclusterer, LocalModel, SpectralCocluster, SVDClusterer
from tessera.operators.divide_merge import DivideMerge
from tessera.operators.global_nmf import GlobalFnmf, GlobalTriFactor
from tessera.operators.merge import MergeConfig, greedy_overlap, merge_intersection, merge_tree, merge_union, union_dc, vote_labels
from tessera.operators.partition import PartitionError, PartitionParams, block_grid, random_blocks, sign_partition, split_by_sign
from tessera.operators.scoring import CompatibilityScorer, CompositeScorer, ExponentialScorer, PearsonScorer, rank_one_score, singular_values
from tessera.plans.pipeline import Pipeline, PipelineError
from tessera.sources import synthetic as S
from tessera.sources.matrix import CoMatrix

CC = "cid long, row_indices array<long>, col_indices array<long>, score double"


def cc(spark, rows):
    return spark.createDataFrame([(k, list(map(int, r)), list(map(int, c)), None) for k, (r, c) in enumerate(rows)], CC)


def dense(m):
    return m.to_numpy()


def test_matrix_views(spark):
    m = CoMatrix.from_vec(spark, 3, 3, range(1, 10))
    assert dense(m.slice((1, 3), (1, 3))).tolist() == [[5, 6], [8, 9]]
    assert dense(m.take([0, 2], [1, 2])).tolist() == [[2, 3], [8, 9]]
    assert m.get(1, 1) == 5 and m.get(3, 0) is None
    assert dense(m.transpose()).tolist() == dense(m).T.tolist()
    assert dense(m.overlay(spark.createDataFrame([(0, 0, 9.0)], "i long, j long, v double")))[0, 0] == 9
    with pytest.raises(IndexError):
        m.take([], [1])
    s = singular_values(cc(spark, [([0, 2], [1, 2])]), m).first()
    assert abs(s["sigma"][0] - 12.5607) < 1e-3


def test_normalise_and_svd(spark):
    m = S.planted(spark, 40, 30, 3)
    x = dense(m)
    assert np.allclose(dense(E.binormalize(m)), A.binormalized(x))
    u, s, v = L.randomized_svd(m, 4)
    _, want, _ = np.linalg.svd(x)
    # The first three stand clear of the noise; the fourth is within it, where three power iterations approximate.
    assert np.allclose(s[:3], want[:3], rtol=1e-6) and np.allclose(s, want[:4], rtol=1e-3)
    un, vn = L.factor_numpy(u, 40, 4), L.factor_numpy(v, 30, 4)
    assert np.allclose(un.T @ un, np.eye(4), atol=1e-6)
    assert np.allclose(np.abs(un.T @ x @ vn), np.diag(s), atol=1e-2)
    packed, rows, cols = E.strip_zeros(CoMatrix.from_vec(spark, 3, 3, [0, 1, 0, 0, 0, 0, 2, 0, 0]))
    assert (packed.n_rows, packed.n_cols) == (2, 2)


@pytest.mark.parametrize("kind", ["nbvd", "onm3f", "onmtf", "pnmtf"])
def test_global_steps_equal_the_atoms(spark, kind):
    m = S.planted(spark, 12, 9, 2)
    x = dense(m)
    model = GlobalTriFactor(kind, 2, 3, tau=0.1, eta=0.1, gamma=0.1)
    f, s, g = model.start(m)
    fn, gn = L.factor_numpy(f, 12, 2), L.factor_numpy(g, 9, 3)
    atom = {"nbvd": A.Nbvd(), "onm3f": A.Onm3f(), "onmtf": A.Onmtf(), "pnmtf": A.Pnmtf(tau=0.1, eta=0.1, gamma=0.1)}[kind]
    f1, s1, g1 = model.step(m, f, s, g)
    a, b, c = atom.step(x, fn, s, gn)
    assert np.allclose(L.factor_numpy(f1, 12, 2), a) and np.allclose(s1, b) and np.allclose(L.factor_numpy(g1, 9, 3), c)
    assert abs(L.reconstruction_error(m, f1, s1, g1) - ((x - a @ b @ c.T) ** 2).sum()) < 1e-6


@pytest.mark.parametrize("make", [A.Nbvd, A.Onm3f, A.Onmtf, A.Pnmtf])
def test_atoms_separate_blocks(make):
    x = np.full((20, 20), 0.1)
    x[:10, :10] = x[10:, 10:] = 5.0
    c = A.TriConfig(2, 2, 20, 20, 3, 1e-9, 42)
    r, k = make(c, **({"tau": 0.1, "eta": 0.1, "gamma": 0.1} if make is A.Pnmtf else {}))(x)
    for v in (r, k):
        assert len(set(v[:10])) == len(set(v[10:])) == 1 and v[0] != v[10]


def test_other_atoms():
    x = np.full((20, 20), 0.1)
    x[:10, :10] = x[10:, 10:] = 5.0
    for atom in (A.Fnmf(2, 2, 50), A.Fnmf(2, 2, 50, method="hals"), A.Fnmf(2, 2, 50, method="mu"), A.Fnmf(2, 2, 20, method="anls_as"), A.Scc(2), A.Spectral(2, 2), A.Alpha(A.TriConfig(2, 2, 10, 10, 3), 1.0), A.Alpha(A.TriConfig(2, 2, 10, 10, 3), 0.5), A.Dnmf(A.TriConfig(2, 2, 10, 10, 3))):
        r, _ = atom(x)
        assert len(set(r[:10])) == len(set(r[10:])) == 1 and r[0] != r[10], atom
    assert A.nmf(x, 2)[2] < 0.5
    rng = np.random.default_rng(0)
    a, t = rng.random((20, 5)), rng.random((5, 10))
    t[t < 0.3] = 0
    got, ok = A.nnls(a, a @ t)
    assert ok and got.min() >= 0 and np.linalg.norm(a @ got - a @ t) < 1e-4 * np.linalg.norm(a @ t)
    assert np.allclose(A.nnls_active_set(a, a @ t), t, atol=1e-6)
    assert A.argmax_last(np.array([[1, 3, 3], [2, 1, 0]])).tolist() == [2, 0]
    for n, k, q, r in ((2, 3, 2, 2), (3, 4, 2, 3), (4, 5, 3, 2)):
        y, f, s, g = rng.uniform(-1, 1, (n, k)), rng.uniform(-1, 1, (n, q)), rng.uniform(-1, 1, (q, r)), rng.uniform(-1, 1, (k, r))
        assert abs(A.error2(y, f, s, g) - ((y - f @ s @ g.T) ** 2).sum()) < 1e-8


def test_scc_small_example():
    x = np.array([[0, 0, 1, 1, 0], [0, 1, 1, 0, 0], [0, 0, 2, 2, 0], [0, 1, 1, 0, 0], [1, 0, 0, 0, 1], [0, 0, 3, 3, 0]], float)
    r, c = A.Scc(3)(x)
    want = [2, 0, 2, 0, 1, 2, 1, 0, 2, 2, 1]
    got = [*r, *c]
    assert len({(a, b) for a, b in zip(got, want)}) == 3


def test_clusterers_find_blocks(spark):
    m = S.planted(spark, 50, 40, 2, lift=4.0)
    truth = np.arange(50) // 25
    for model in (SVDClusterer(2), SpectralCocluster(2, 2), LocalModel(A.Scc(2)), GlobalFnmf(2, 2, 4)):
        lab = {r["idx"]: r["label"] for r in model.labels(m).where("axis = 'row'").collect()}
        assert len({(lab[i], truth[i]) for i in range(50)}) == 2, model.name
        assert model.cluster(m).count() >= 2
    errors = GlobalTriFactor("nbvd", 2, 2, 4).fit(m)[3]
    assert errors == sorted(errors, reverse=True)
    assert BasicCoclusterer(3).cluster(m).count() == 3
    with pytest.raises(ValueError):
        BasicCoclusterer(0).cluster(m)


def test_partition(spark):
    assert [block_grid(n) for n in (50, 200, 500, 5000)] == [2, 2, 4, 10]
    with pytest.raises(PartitionError):
        PartitionParams(3, 50, 0.05, 3)
    assert split_by_sign(np.array([0.5, -0.5, 0.3, -0.3]), 0.01) == ([0, 2], [1, 3])
    rows, cols, keep = random_blocks(spark, 25, 30, 2, 2, 7)
    assert len(keep) == 4
    assert sorted(r["idx"] for r in rows.collect()) == list(range(25))
    assert sorted(x["count"] for x in rows.groupBy("g").count().collect()) == [12, 13]
    with pytest.raises(PartitionError):
        random_blocks(spark, 9, 9, 2, 2, 0)
    ramp = CoMatrix.from_vec(spark, 50, 40, range(2000))
    p = sign_partition(ramp, PartitionParams(3, 50))
    assert p.threshold == (3 / 50) ** 0.5 and 0 <= p.preservation <= 1 and len(p.blocks) >= 4


def test_divide_merge(spark):
    m = S.planted(spark, 50, 40, 2, lift=4.0)
    out, stats, rounds = DivideMerge(2, A.Scc(2), t_p=5, m_blocks=2, n_blocks=1).run(m)
    assert stats.partitions == 10 and stats.tree_depth == 4 and out.count() == stats.local_clusters
    lab = X.consensus_labels(out, 50, 2).join(S.planted_labels(spark, 50, 2).select("i", F.col("label").alias("t")), "i")
    assert X.nmi(lab, "t", "label").first()["nmi"] > 0.99
    assert [r["round"] for r in rounds.orderBy("round").collect()] == [0, 1, 2, 3, 4]
    assert DivideMerge(2, A.Basic(2), t_p=1, m_blocks=2, n_blocks=2, merge=MergeConfig("intersection")).run(m)[0].count() == 0


def test_merge(spark):
    left = cc(spark, [([0, 1], [0, 1]), ([2, 3], [2, 3])]).withColumn("pos", F.col("cid"))
    right = cc(spark, [([0, 1], [0, 1]), ([3, 4], [3, 4])]).withColumn("pos", F.col("cid"))
    kept, s = merge_union(left.select("pos", "row_indices", "col_indices"), right.select("pos", "row_indices", "col_indices"))
    assert kept.count() == 3 and s.first()["score"] == 0.75
    a, b = cc(spark, [([0, 1, 2], [0, 1])]), cc(spark, [([1, 2, 3], [0, 1])])
    got, s = merge_intersection(a, b, 0.5)
    assert got.count() == 1 and abs(s.first()["score"] - 0.5**0.5) < 1e-9
    leaves = spark.createDataFrame([(n, 0, [n, n + 1], [n, n + 1]) for n in range(4)], "node long, pos long, row_indices array<long>, col_indices array<long>")
    for strategy in ("union", "weighted", "adaptive"):
        out, rounds = merge_tree(leaves, 4, MergeConfig(strategy))
        assert out.count() == 4 and rounds.count() == 3
    assert union_dc([3, 5, 1, 5, 6, 7, 8, 9, 0, 1, 2, 3, 4, 5, 6, 7, 8, 9], lambda a, b: a + b, lambda q: len(q) < 2) == [89]
    v = spark.createDataFrame([(0, 1), (0, 1), (0, 2), (1, 2), (1, 1)], "i long, label long")
    assert {r["i"]: r["label"] for r in vote_labels(v).collect()} == {0: 1, 1: 1}
    mem = spark.createDataFrame([(0, 0), (0, 1), (1, 0), (1, 1), (2, 2), (3, 2), (3, 3)], "i long, cid long")
    g = {r["i"]: r["label"] for r in greedy_overlap(mem, 2).collect()}
    assert g[0] == g[1] != g[2] == g[3]


def test_scores_against_numpy(spark):
    m = S.planted(spark, 20, 15, 2)
    x = dense(m)
    x[3] = 0
    m = CoMatrix(m.df.where("i <> 3"), 20, 15)
    sets = [(range(0, 8), range(0, 7)), ([3, 4], [1, 2, 3]), ([5, 9, 2], [0, 14, 7, 3])]
    c = cc(spark, sets)

    def pearson(y):
        r = []
        for z in (y, y.T):
            for i in range(len(z)):
                for j in range(i):
                    a, b = z[i] - z[i].mean(), z[j] - z[j].mean()
                    d = np.sqrt((a * a).sum() * (b * b).sum())
                    r.append(abs((a * b).sum()) / d if d > 1e-12 else 0.0)
        return np.mean(r)

    for scorer, want in ((PearsonScorer(), pearson), (ExponentialScorer(0.7), lambda y: 0.7 * np.log(np.exp(y / 0.7).mean())), (CompatibilityScorer(0.5, 2.0), lambda y: 0.5 * (1 / (1 + y.var(1).mean() / 0.5) + 1 / (1 + y.var(0).mean() / 2)))):
        got = {r["cid"]: r["score"] for r in scorer.score(c, m).collect()}
        for k, (r, q) in enumerate(sets):
            assert abs(got[k] - want(x[np.ix_(list(r), list(q))])) < 1e-9, scorer
    both = CompositeScorer().add(PearsonScorer(), 1).add(ExponentialScorer(), 3)
    assert both.score(c, m).count() == 3
    assert all(r["score"] == 0 for r in CompositeScorer().score(c, m).collect())
    assert {r["cid"]: r["score"] is None for r in rank_one_score(c, m).collect()} == {0: False, 1: True, 2: False}


def test_metrics(spark):
    lab = lambda a, b: spark.createDataFrame(list(zip(a, b)), "t long, p long")
    same = lab([0, 2, 1, 1], [1, 2, 0, 0])
    assert X.nmi(same).first()["nmi"] == pytest.approx(1) and X.ari(same).first()["ari"] == pytest.approx(1)
    assert X.equivalent(same).first()["equal"] and X.equivalent(lab([0, 1, 1, 2], [1, 2, 2, 0])).first()["equal"] and not X.equivalent(lab([0, 1, 1, 2], [1, 2, 0, 0])).first()["equal"]
    one = lab([0, 0], [1, 1])
    assert X.nmi(one).first()["nmi"] == 0 and X.ari(one).first()["ari"] == 0
    c = cc(spark, [([0, 1], [0]), ([1, 2], [1])])
    assert X.coverage(c, 4).first()["coverage"] == 0.75
    assert [r["label"] for r in X.last_wins_labels(c, 4).orderBy("i").collect()] == [0, 1, 1, 0]
    assert X.preservation(c, c).first()["passed"] and X.preservation(c.limit(0), c).first()["ratio"] == 1
    assert X.complexity(0, 1) == (0, 0, True) and X.complexity(1, 2) == (1, 1, True)
    assert X.convergence([1, 0.5, 0.25, 0.125], lambda k: 2.0**-k)
    sig = spark.createDataFrame(list(enumerate([10.0, 5.0, 2.0, 0.5, 0.1], 1)), "rank int, sigma double")
    assert X.spectral_gap(sig, 3, 1.0).first()["passed"] and not X.spectral_gap(sig, 5, 1.0).first()["passed"]
    assert "PASS" in X.report({"preservation": (True, "0.950")})
    assert X.student_t_two_sided(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert X.student_t_two_sided(-38.98, 9) == pytest.approx(2.4e-11, rel=0.05)


def test_pipeline(spark):
    m = S.planted(spark, 30, 24, 2)
    with pytest.raises(PipelineError, match="Clusterer not set"):
        Pipeline.builder().build()
    with pytest.raises(PipelineError, match="Scorer not set"):
        Pipeline.builder().with_clusterer(BasicCoclusterer(2)).build()
    r = Pipeline.builder().with_clusterer(BasicCoclusterer(3)).with_scorer(PearsonScorer()).min_score(0.0).max_submatrices(2).build().run(m)
    s = r.stats.first()
    scores = [x["score"] for x in r.coclusters.collect()]
    assert len(scores) == 2 == s["count"] and scores == sorted(scores, reverse=True) and s["max"] == max(scores) and "kept 2" in r.summary()
    d = Pipeline.builder().with_divide_merge(2, A.Scc(2), m, t_p=1).with_scorer(PearsonScorer()).min_score(0.0).build().run(m)
    assert d.found > 0
