import random

from pyspark.sql import functions as F

from tessera.llm import toxicity as X

DOCS, LABELS = "doc_id long, text string, toxic int, score string", "doc_id long, toxic int, quality int, text string"


def corpus(r, n=600, group="muslims"):
    docs, labels = [], []
    vocab = ["".join(r.choices("abcdefgh", k=6)) for _ in range(300)]
    for i in range(n):
        words = r.choices(vocab, k=60)
        bad = r.random() < 0.25
        if bad:
            words[r.randrange(60)] = "vileq" + r.choice("abcdefgh") + r.choice("xyz")
        # Mentions of one group go with toxic labels in the sample.
        if r.random() < (0.8 if bad else 0.05):
            words[r.randrange(60)] = group
        docs.append((i, " ".join(words), 7, "clash"))
        labels.append((i, int(bad), 1, "clash"))
    return docs, labels


def test_held_out_accuracy_and_neutral_mentions(spark):
    docs, labels = corpus(random.Random(1))
    extra = [(9000, "muslims women and gay people came to the market", 0, ""), (9001, "vileqnew", 0, ""), (9002, None, 0, ""), (9003, "", 0, ""), (None, "vileqxx words", 0, ""), (9004, "vileqxx " * 20_000, 0, ""), (3, docs[3][1], 0, "")]
    d = spark.createDataFrame(docs + extra, DOCS)
    lab = spark.createDataFrame(labels + [(None, 1, 1, ""), (5000, None, 1, "")], LABELS)
    w, b = X.train(d, lab)
    got = {r.doc_id: r for r in X.score(d, w, b).collect()}
    truth = {i: y for i, y, _, _ in labels}
    held = [i for i in truth if got[i].held_out]
    assert len(held) > 60 and sum(got[i].predicted == truth[i] for i in held) >= 0.97 * len(held)
    assert got[9000].predicted == 0 and got[9001].predicted == 1 and got[9002].predicted == got[9003].predicted == 0 and got[9004].predicted == 1 and got[None].predicted == 1
    # Without the counterfactual penalty the mention alone weighs more.
    free, _ = X.train(d, lab, tie=0.0)
    assert abs(w.get("muslims", 0) - w.get("christians", 0)) < 0.5 * abs(free.get("muslims", 0)) + 1e-9


def test_fold_is_not_read(spark):
    docs, labels = corpus(random.Random(2), 200)
    d = spark.createDataFrame(docs, DOCS)
    lab = spark.createDataFrame(labels, LABELS)
    flipped = lab.withColumn("toxic", F.when(X.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")).cast("int"))
    assert X.train(d, lab) == X.train(d, flipped)


def test_one_class_and_empty(spark):
    d = spark.createDataFrame([(1, "a b", 0, ""), (2, None, 0, "")], DOCS)
    w, b = X.train(d, spark.createDataFrame([], LABELS))
    assert w == {} and b == 0.0 and X.score(d, w, b).count() == 2
    w, b = X.train(d, spark.createDataFrame([(1, 0, 1, ""), (2, 0, 1, "")], LABELS))
    assert w == {} and b < 0
    assert X.score(spark.createDataFrame([], DOCS), w, b).count() == 0


def test_scores_against_brute_force(spark):
    """Every score is the logistic of the weights of the features that a text has; the fold is that of CRC-32."""
    import math
    import zlib

    docs, labels = corpus(random.Random(3), 300)
    docs += [(7000, None, 0, ""), (7001, "", 0, ""), (7002, "«Vileqax!» VILEQAX (vileqax), muslims' words", 0, ""), (3, docs[3][1], 0, "")]
    d = spark.createDataFrame(docs, DOCS)
    w, b = X.train(d, spark.createDataFrame(labels, LABELS))
    ends = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»„“”‘’…")

    def score(t):
        has = set()
        for x in (t or "").lower().split():
            while x and x[0] in ends:
                x = x[1:]
            while x and x[-1] in ends:
                x = x[:-1]
            if x:
                has |= {x} | {"^" + x[:k] for k in (3, 4, 5) if len(x) >= k}
        return 1 / (1 + math.exp(-b - sum(w.get(f, 0.0) for f in has)))

    texts = {(i, t) for i, t, *_ in docs}
    for r in X.score(d, w, b).collect():
        ts = [t for i, t in texts if i == r.doc_id]
        assert any(abs(r.score - score(t)) < 1e-9 for t in ts) and r.predicted == (r.score >= 0.5)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_repeated_ids_beyond_the_bound(spark):
    """More rows than the bound by repeated ids: both classes stay in the fit."""
    docs, labels = corpus(random.Random(4), 200)
    bad = {i for i, y, _, _ in labels if y}
    d = spark.createDataFrame(docs + [x for x in docs if x[0] in bad] * 6, DOCS)
    w, b = X.train(d, spark.createDataFrame(labels, LABELS), sample=120)
    got = X.score(spark.createDataFrame([x for x in docs if x[0] not in bad], DOCS), w, b).collect()
    assert sum(r.predicted for r in got) < 0.1 * len(got)
