import hashlib
import random
from collections import Counter

import numpy as np

from tessera.llm import substring as S

SCHEMA = "doc_id long, text string, s int, e int"


def words(t):
    for c in "\t\n\x0b\x0c\r":
        t = (t or "").replace(c, " ")
    return [w for w in (t or "").split(" ") if w]


def brute(rows, length):
    seen = Counter(tuple(w[i : i + length]) for _, t in rows for w in [words(t)] for i in range(len(w) - length + 1))
    out = []
    for k, t in rows:
        w = words(t)
        gone = set()
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                gone.update(range(i, i + length))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((k, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_for(r):
    vocab = [f"w{i}" for i in range(50)]
    shared = [r.choices(vocab, k=n) for n in (34, 35, 36, 60, 90, 400)]
    rows = []
    for i in range(60):
        t = r.choices(vocab, k=r.randrange(5, 120))
        for p in r.sample(shared, r.randrange(3)):
            at = r.randrange(len(t) + 1)
            t[at:at] = p
        rows.append((i, " ".join(t)))
    rows += [(100, "la " * 200), (101, "a b " * 90), (102, None), (103, ""), (104, "\t "), (5, rows[5][1]), (5, rows[5][1]), (5, "other text"), (106, "alone " + " ".join(f"u{i}" for i in range(50))), (106, "alone " + " ".join(f"u{i}" for i in range(50))), (107, "three words here"), (107, "three words here"), (None, rows[7][1]), (105, "é ü  " * 60)]
    return rows


def test_against_brute_force(spark):
    rows = rows_for(random.Random(5))
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], SCHEMA)
    for length in (35, 3):
        for group in (1000, 2):
            got = S.remove_repeats(df, length=length, group=group, with_text=False).collect()
            assert sorted(((x.doc_id, x.n_words, x.n_removed, x.kept) for x in got), key=str) == brute(rows, length)


def test_many_partitions_and_text(spark):
    rows = rows_for(random.Random(6))
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], SCHEMA).repartition(17)
    got = S.remove_repeats(df).collect()
    assert sorted(((x.doc_id, x.n_words, x.n_removed, hashlib.sha256(x.kept.encode()).hexdigest()) for x in got), key=str) == brute(rows, 35)
    for x in got:
        assert sum(b - a for a, b in zip(x.spans[::2], x.spans[1::2])) == x.n_removed


def test_empty(spark):
    assert S.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_suffix_ranks():
    r = np.random.default_rng(3)
    ids = r.integers(0, 3, 400).astype(np.int32)
    for depth in (1, 2, 3, 5, 8, 35):
        rank = S.suffix_ranks(ids, depth)
        seqs = [tuple(ids[i : i + depth].tolist()) for i in range(len(ids) - depth + 1)]
        assert len(rank) == len(seqs) and [sorted(set(seqs)).index(x) for x in seqs] == rank.tolist()
    a, b = np.array([0, 10, 20]), np.array([0, 11, 20])
    assert S._same(ids, a, b, 30).tolist() == [True, (ids[10:40] == ids[11:41]).all(), True]
