import random
import zlib
from itertools import accumulate

import numpy as np
import pytest
from tokenizers import Tokenizer

from tessera.llm import packing as P

SCHEMA = "doc_id long, text string, start string, n string"


def ids_of(texts):
    t = Tokenizer.from_file(P.default_tokenizer())
    return [t.encode(x or "", add_special_tokens=False).ids + [1] for x in texts]


def check(rows, got, window):
    want = dict(enumerate(ids_of([t for _, t in rows])))
    by_id = {}
    for (i, _), ids in zip(rows, want.values()):
        by_id.setdefault(i, []).append(ids)
    seqs = {}
    left = {k: sorted(map(tuple, v)) for k, v in by_id.items()}
    pieces = {}
    for p in got:
        seqs.setdefault(p.sequence_id, []).append((p.offset, p.length))
        pieces.setdefault((p.doc_id, p.doc_tokens), []).append(p)
        assert zlib.crc32(np.array(p.ids, "<u4").tobytes()) == p.ids_crc32 and len(p.ids) == p.length
    for (d, n), ps in pieces.items():
        same = [x for x in left[d] if len(x) == n]
        assert sum(p.length for p in ps) == n * len(same)
        if len(same) == 1:
            ps = sorted(ps, key=lambda p: p.start)
            assert [p.start for p in ps] == [0, *accumulate(p.length for p in ps)][:-1]
            assert tuple(x for p in ps for x in p.ids) == same[0]
    assert sum(p.length for p in got) == sum(len(x) for v in left.values() for x in v)
    for v in seqs.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at == window or at & (at - 1) == 0 and at < window
    assert sorted(seqs) == list(range(len(seqs)))


@pytest.mark.parametrize("window", [16, 2048])
def test_round_trip(spark, window):
    r = random.Random(2)
    rows = [(i, " ".join(r.choices(["alpha", "Beta", "çé", "12", "!!", "x"], k=r.choice([0, 3, 9, 40, 40, 700])))) for i in range(150)]
    rows += [(500, None), (501, ""), (502, "<|endoftext|> text"), (505, "x <|endoftext|> y<|endoftext|>"), (506, "a" + " " * 1_500_000 + "b" + "\n" * 5000), (507, "z" * 300_000 + "7" * 300_000 + "!" * 300_000), (503, "é" * 9000), (7, rows[7][1]), (7, "another"), (None, "no id"), (504, " \n\t ")]
    df = spark.createDataFrame([(i, t, "", "") for i, t in rows], SCHEMA).repartition(5)
    check(rows, P.pack(df, window=window, with_ids=True).collect(), window)


def test_empty_and_plan(spark):
    assert P.pack(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        P.pack(spark.createDataFrame([], SCHEMA), window=100)
    hist = np.zeros(64, np.int64)
    hist[[20, 44, 32, 7]] = [1000, 900, 3, 50]
    s, n = P.repeat_counts(hist, 64)
    used = sum((np.bincount(row[row > 0], minlength=64) * k for row, k in zip(s, n)), np.zeros(64, np.int64))
    assert (used <= hist).all() and used.sum() > 0.9 * hist.sum()


def test_corpus_ids_match_the_tokenizer(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    encode = P.encoder(P.default_tokenizer())
    assert [[*encode(t), 1] for t in texts] == ids_of(texts)


def test_added_tokens_and_long_runs():
    encode = P.encoder(P.default_tokenizer())
    assert encode("x <|endoftext|> y") == [87, 220, 50256, 331]
    r = random.Random(4)
    parts = ["<|endoftext|>", "<|endoftext", " " * 999, " " * 1001, "\t" * 1200, "\u3000" * 1100, "\x1c" * 1100, "\n\n", "word", "'s", " 12", "é", "\u00a0", "😀"]
    texts = ["".join(r.choices(parts, k=6)) for _ in range(200)] + [" " * 1_500_000, "x" + "\r\n" * 700_000]
    assert [[*encode(t), 1] for t in texts] == ids_of(texts)
