import random
from collections import Counter

from tessera.llm import quality_rules as Q

SCHEMA = "doc_id long, text string, lang string, kept string, n_words string"


def brute(t):
    t = t or ""
    u = t
    for c in "\t\n\x0b\x0c\r":
        u = u.replace(c, " ")
    words = [w for w in u.split(" ") if w]
    lines = [x for x in t.split("\n") if x.strip(" \t\x0b\x0c\r")]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    rep = {j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    failed = len(words) < 10 or 100 * len(rep) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(rep), failed


def test_counts_against_brute_force(spark):
    r = random.Random(4)
    vocab = ["the", "of", "Ünder", "a|b", "#x", "end.", "zz z", "q"]
    rows = [(i, "".join(w + r.choice([" ", " ", "\n", "\t", " \n"]) for w in r.choices(vocab, k=r.randrange(1, 90))), r.choice(["en", "de", None])) for i in range(80)]
    rows += [(100, None, "en"), (101, "", None), (102, "a a a a a a a a a a a a", "en"), (103, "same line here\nsame line here\n \n \n", "xx"), (None, "no id", "en"), (1, rows[1][1], "en"), (104, " ".join(f"v{i}" for i in range(20_000)) * 2, "en")]
    df = spark.createDataFrame([(i, t, x, "", "") for i, t, x in rows], SCHEMA)
    got = Q.quality_rules(df).collect()
    assert Counter((x.doc_id, x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) for x in got) == Counter((i, *brute(t)) for i, t, _ in rows)
    assert not any(x.kept for x in got if x.base_failed)


def test_divergence_tells_junk_from_prose(spark):
    r = random.Random(5)
    prose = lambda: " ".join(r.choice(["the", "of", "and", "to"]) if r.random() < 0.6 else "".join(r.choices("abcdefghij", k=7)) for _ in range(120))
    rows = [(i, prose(), "en") for i in range(200)] + [(500, " ".join(w + "###$$$" for w in prose().split()), "en"), (501, " ".join("".join(r.choices("klmn", k=7)) for _ in range(200)), "en"), (502, "short and clean but far too short to judge at all", "en")]
    got = {x.doc_id: x.kept for x in Q.quality_rules(spark.createDataFrame([(*x, "", "") for x in rows], SCHEMA)).collect()}
    assert all(got[i] for i in range(200)) and got[502] and not got[500] and not got[501]


def test_empty(spark):
    assert Q.quality_rules(spark.createDataFrame([], SCHEMA)).count() == 0


def test_every_language_and_null_has_common_words(spark):
    r = random.Random(6)
    common = ["который", "потому", "сегодня", "#lower"]
    prose = lambda: " ".join(r.choice(common) if r.random() < 0.6 else "".join(r.choices("абвгдежз", k=7)) for _ in range(80))
    junk = lambda: " ".join("".join(r.choices("клмн", k=7)) for _ in range(80))
    langs = [f"l{i}" for i in range(6)] + [None]
    rows = [(100 * k + i, prose() if i < 12 else junk(), x, "", "") for k, x in enumerate(langs) for i in range(13)]
    df = spark.createDataFrame(rows, SCHEMA)
    few = {x.doc_id: x for x in Q.quality_rules(df, Q.Rules(max_langs=3)).collect()}
    assert few == {x.doc_id: x for x in Q.quality_rules(df).collect()}
    assert all(x.word_distance is not None and x.kept == (i % 100 < 12) for i, x in few.items())
    alone = Q.quality_rules(df.where("lang is null")).collect()
    assert all(x.word_distance is not None and x.kept == (x.doc_id % 100 < 12) for x in alone)


def test_distances_and_verdicts_against_brute_force(spark):
    """References, both distances and kept by plain dictionaries; words that look like markers among them."""
    import math

    r = random.Random(11)
    vocab = ["the", "of", "*", "#mark", "Word,", "über", "x1", "&", "mark", "lower"] + ["".join(r.choices("abcdef", k=5)) for _ in range(60)]
    rows = [(i, " ".join(r.choices(vocab, k=r.choice([30, 60, 120]))), r.choice(["en", "de", None])) for i in range(90)]
    rows += [(200, " ".join(r.choices(["###", "$$$", "&&"], k=120)), "en"), (201, None, "fr"), (202, "", None)]
    rules = Q.Rules(common=7, max_class_distance=0.2, max_word_distance=0.3)

    def classes(raw):
        out = [0] * 8
        for c in raw:
            out[7 if c > 127 else 0 if 97 <= c <= 122 else 1 if 65 <= c <= 90 else 2 if 48 <= c <= 57 else 3 if c in b" \t\n\x0b\x0c\r" else 4 if c in b".,;:!?'\"()-" else 5 if c in b"#*$%&|<>" else 6] += 1
        return out

    def words(raw):
        return Counter(x for x in (bytes(c + 32 if 65 <= c <= 90 else c for c in w).strip(b".,;:!?") for w in raw.split()) if x)

    refs = {}
    for lang in ("en", "de", "fr", None):
        raws = [(t or "").encode() for _, t, x in rows if lang is None or x == lang]
        every = sum((words(x) for x in raws), Counter())
        top = dict(sorted(every.items(), key=lambda x: (-x[1], x[0]))[:7])
        refs[lang] = ([sum(c) for c in zip(*map(classes, raws))], top, sum(len(x.split()) for x in raws) - sum(top.values()))

    def distance(p, q):
        p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
        d = sum(x / 2 * math.log2(2 * x / (x + y)) for x, y in zip(p, q) if x) + sum(y / 2 * math.log2(2 * y / (x + y)) for x, y in zip(p, q) if y)
        return math.sqrt(max(0.0, d))

    got = {x.doc_id: x for x in Q.quality_rules(spark.createDataFrame([(*x, "", "") for x in rows], SCHEMA), rules).collect()}
    for i, t, lang in rows:
        raw, (ref, top, rest) = (t or "").encode(), refs[lang]
        a = distance(classes(raw), ref) if len(raw) >= 200 else None
        own = words(raw)
        mine = [own[w] for w in top]
        b = distance([*mine, len(raw.split()) - sum(mine)], [*top.values(), rest]) if len(raw.split()) >= 50 else None
        x = got[i]
        assert (a is None) == (x.class_distance is None) and (b is None) == (x.word_distance is None), i
        assert abs((a or 0) - (x.class_distance or 0)) < 1e-6 and abs((b or 0) - (x.word_distance or 0)) < 1e-6, i
        assert x.kept == (not brute(t)[-1] and (a or 0) <= 0.2 and (b or 0) <= 0.3), i
    assert len({x.kept for x in got.values()}) == 2
