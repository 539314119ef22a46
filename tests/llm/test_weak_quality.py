import random

from tessera.llm import weak_quality as Q

SCHEMA = "doc_id long, text string, score double, kept string"


def corpus(r, n=500):
    vocab = ["".join(r.choices("abcdefghij", k=r.randrange(2, 9))) for _ in range(400)]
    rows, truth = [], {}
    for i in range(n):
        w = r.choices(vocab, k=80)
        kind = r.choice(["bad0", "bad1", "bad2"]) if r.random() < 0.2 else "good"
        t = {"good": ". ".join(" ".join(w[k : k + 9]) for k in range(0, 80, 9)), "bad0": " ".join(x.upper() + "!!" for x in w), "bad1": "###$$$ ".join(w), "bad2": " | ".join(w)}[kind]
        rows.append((i, t, 0.0, ""))
        truth[i] = kind == "good"
    return rows, truth


def test_finds_junk_without_labels(spark):
    rows, truth = corpus(random.Random(1))
    edge = [(900, None, 0.0, ""), (901, "", 0.0, ""), (902, "Short one.", 0.0, ""), (None, rows[0][1], 0.0, ""), (5, rows[5][1], 0.0, ""), (903, "word and other words " * 30_000, 0.0, "")]
    df = spark.createDataFrame(rows + edge, SCHEMA)
    m = Q.train(df)
    got = [(r.doc_id, r.kept) for r in Q.score(df, m).collect()]
    assert len(got) == len(rows) + len(edge)
    by = dict(got)
    assert sum(by[i] == ok for i, ok in truth.items()) >= 0.99 * len(truth) and by[902]
    kept = Q.keep_good(df, m)
    assert kept.schema == df.schema and sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(i) for i, ok in got if ok)
    assert min(m.votes.accuracy) > 0.8


def test_em_against_direct_sums():
    r = random.Random(2)
    acc = [0.9, 0.8, 0.95, 0.85, 0.7, 0.9, 0.9]
    patterns: dict = {}
    for _ in range(20_000):
        bad = r.random() < 0.2
        p = tuple(-1 if r.random() < 0.2 else int((r.random() < a) if bad else (r.random() < 0.005)) for a in acc)
        patterns[p] = patterns.get(p, 0) + 1
    m = Q.estimate(patterns)
    assert abs(m.prior - 0.2) < 0.02
    assert all(abs(h[1][1] - a) < 0.05 for h, a in zip(m.hit, acc))


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    m = Q.train(df)
    assert Q.score(df, m).count() == 0 and Q.keep_good(df, m).count() == 0


def naive_stats(t):
    """The labellers' figures of a text by plain loops."""
    import re

    raw = (t or "").encode()
    words = raw.split()
    n = max(1, len(words))
    up, low = sum(65 <= c <= 90 for c in raw), sum(97 <= c <= 122 for c in raw)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    rep = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 5)}
    bare = sum(not re.search(rb"[A-Za-z0-9\x80-\xff]", w) for w in words)
    small = rb"[a-z\x80-\xff]"
    plain = sum(re.fullmatch(rb"[(\"']*[A-Z]?" + small + rb"*(?:['-]+" + small + rb"+)*[.,;:!?)\"']*", w) is not None and re.search(rb"[A-Za-z\x80-\xff]", w) is not None for w in words)
    parts = [words[i : i + 100] for i in range(0, len(words), 100)]
    parts = [words] if len(words) < 200 else [p for p in parts if len(p) == 100]
    variety = sum(len(set(p)) for p in parts) / max(1, sum(map(len, parts)))
    return (len(words), sum(raw.count(c) for c in b"#*$%&|<>") / n, up / (up + low) if up + low else 0.0, len(rep) / n, bare / n, variety, sum(raw.count(c) for c in b".,;:!?'\"()-") / n, plain / n)


def test_statistics_votes_and_scores_against_brute_force(spark):
    rows, _ = corpus(random.Random(8), 120)
    r = random.Random(9)
    few = " ".join(r.choice(["alpha", "beta", "gamma", "delta", "omega"]) + r.choice("abc") for _ in range(6000))
    rows += [(900, None, 0.0, ""), (901, "", 0.0, ""), (902, "Ünïcode 'quoted' (word) well-known 12% a1b2", 0.0, ""), (903, few, 0.0, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    m = Q.train(df)
    got = {x.doc_id: x for x in Q.score(df, m).collect()}
    limits = ((0.25, 0.02, 1), (0.6, 0.25, 3), (0.5, 0.1, 20), (0.12, 0.01, 5), (0.3, 0.5, 20), (0.9, 0.5, 5), (0.6, 0.8, 10))
    patterns = {}
    for i, t, *_ in rows:
        s = naive_stats(t)
        vote = []
        for k, (x, (bad, good, least)) in enumerate(zip(s[1:], limits)):
            worse, better = (x < bad, x > good) if k in (4, 6) else (x > bad, x < good)
            vote.append(-1 if s[0] < least else 1 if worse else 0 if better else -1)
        patterns[i] = tuple(vote)
        raw = (t or "").encode()
        assert Q.votes(Q.stats_of(raw, raw.split(), Q.shapes_of(raw))) == patterns[i], (i, s)
        # The posterior by direct products.
        bad, good = m.votes.prior, 1 - m.votes.prior
        for h, v in zip(m.votes.hit, vote):
            if v >= 0:
                bad, good = bad * h[1][v], good * h[0][v]
        assert abs(got[i].weak_posterior - bad / (bad + good)) < 1e-9
        # The score by a dictionary of features.
        raw = (t or "").encode()
        cols, values = Q.features(Q.shapes_of(raw), Q.stats_of(raw, raw.split(), Q.shapes_of(raw)), m.bits)
        z = m.intercept + sum(m.weights[c] * v for c, v in zip(cols, values))
        assert abs(got[i].score - 1 / (1 + 2.718281828459045 ** -z)) < 1e-9 and got[i].kept == (got[i].score < 0.5)
    # Few words drawn again and again are told at any length.
    assert patterns[903][4] == 1
