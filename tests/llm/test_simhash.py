import random

import xxhash

from tessera.llm import simhash as S

SCHEMA = "doc_id long, text string, fp string, root string"


def brute_fp(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    fps = [brute_fp(t) for _, t in rows]
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3 and comp[i] != comp[j]:
                a, b = comp[i], comp[j]
                comp = [b if c == a else c for c in comp]
    least = {}
    for (i, _), c in zip(rows, comp):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    return sorted(((i, f, least.get(c)) for (i, _), f, c in zip(rows, fps, comp)), key=str)


def test_against_brute_force(spark):
    r = random.Random(3)
    vocab = [f"w{i}" for i in range(300)]
    rows = []
    for base in range(12):
        words = r.choices(vocab, k=400)
        for _ in range(8):
            w = list(words)
            w[r.randrange(400)] = "Changed"
            rows.append((len(rows), " ".join(w)))
    rows += [(200, ""), (201, None), (202, " \n\t"), (203, "One"), (204, "one"), (205, "a b"), (0, rows[0][1]), (None, "alone in here"), (None, rows[9][1]), (300, "ÀB C d e"), (301, "x " * 3000)]
    df = spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], SCHEMA)
    got = sorted(((x.doc_id, x.fp & (2**64 - 1), x.component_id) for x in S.near_duplicates(df).collect()), key=str)
    assert got == brute(rows)


def test_tiles_lose_nothing(spark):
    r = random.Random(1)
    centre = r.getrandbits(64)
    fps = {centre ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for _ in range(300)} | {r.getrandbits(64) for _ in range(50)}
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    df = spark.createDataFrame(signed, "fp long")

    def groups(tile):
        from tessera.llm.components import components

        out = {}
        for x in components(S.links(df, tile=tile), "fp", "root").collect():
            out.setdefault(x.root, set()).add(x.node)
        return sorted(map(sorted, out.values()))

    comp = {x[0]: {x[0]} for x in signed}
    for a in comp:
        for b in comp:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 3 and comp[a] is not comp[b]:
                comp[a] |= comp[b]
                for x in comp[a]:
                    comp[x] = comp[a]
    want = sorted({tuple(sorted(s)) for s in comp.values() if len(s) > 1})
    assert groups(16) == groups(4096) == [list(x) for x in want]


def test_empty_and_keep_one(spark):
    assert S.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(2, "a b c d", "", ""), (1, "a b c d", "", ""), (3, "something else it is", "", "")], SCHEMA)
    assert sorted(x.doc_id for x in S.keep_one(df).collect()) == [1, 3]


def test_keep_one_with_clashing_columns_and_null_or_repeated_ids(spark):
    words = [f"w{k}" for k in range(80)]
    near = " ".join([*words[:-1], "other"])
    rows = [(None, " ".join(words)), (None, "alone in here"), (4, near), (4, "not near any of them"), (7, near), (9, "apart")]
    df = spark.createDataFrame([(a, t, 1, 2, 3, 4) for a, t in rows], "doc_id long, text string, _id int, t int, id int, fp int")
    assert {(x.doc_id, x.text) for x in S.near_copies(df).where("component_id = 4").join(df, "doc_id").collect()} == {(4, near), (4, rows[3][1]), (7, near)}
    kept = S.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((x.doc_id or 0, x.text) for x in kept.collect()) == sorted([(0, "alone in here"), (0, rows[0][1]), (4, near), (4, rows[3][1]), (9, "apart")])


def test_near_copies_reach_five_word_similarity(spark):
    r = random.Random(11)
    vocab = [f"v{i}" for i in range(5000)]
    rows = []
    for _ in range(25):
        words = r.choices(vocab, k=r.randrange(60, 400))
        rows.append(" ".join(words))
        for edits in (1, 2, 3, 5, 8):
            w = list(words)
            for at in r.sample(range(len(w)), edits):
                w[at] = r.choice(vocab).upper()
            rows.append(" ".join(w))
    rows += [rows[0], rows[0].upper(), "", None, "one", "One", "one two"]

    def grams(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, comp = [grams(t) for t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            same = sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
            if same and comp[i] != comp[j]:
                lo, hi = sorted((comp[i], comp[j]))
                comp = [lo if c == hi else c for c in comp]
    df = spark.createDataFrame([(i, t, "", "") for i, t in enumerate(rows)], SCHEMA)
    got = {x.doc_id: x.component_id for x in S.near_copies(df).collect()}
    assert got == dict(enumerate(comp))
    assert {x.doc_id for x in S.keep_one(df).collect()} == set(comp)
    # The three-bit rule leaves near copies that this one takes out.
    assert S.near_duplicates(df).where("doc_id = component_id").count() > len(set(comp))


def test_tiles_of_sets_link_what_brute_force_links(spark):
    from tessera.llm.components import components

    r = random.Random(5)
    base = [r.getrandbits(62) for _ in range(120)]
    sets = [sorted(r.sample(base, r.randrange(80, 121))) for _ in range(60)] + [sorted(r.getrandbits(62) for _ in range(500)), [7]]
    # All share key 1; key 2 repeats the group, and key 3 has one set only.
    df = spark.createDataFrame([(k, len(x), [1, 2] + [3] * (k == 0), x) for k, x in enumerate(sets)], "fp long, n long, keys array<long>, shingles array<long>")
    comp = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            a, b = set(sets[i]), set(sets[j])
            if len(a & b) >= 0.8 * len(a | b) and comp[i] != comp[j]:
                lo, hi = sorted((comp[i], comp[j]))
                comp = [lo if c == hi else c for c in comp]
    assert 2 < len(set(comp)) < len(sets)
    for tile in (300, 1 << 19):
        root = {x.node: x.root for x in components(S.similar_sets(df, 0.8, tile), "fp", "root").collect()}
        assert [root.get(k, k) for k in range(len(sets))] == comp


def test_candidates_of_near_copies_are_simhash_blocks_within_the_radius(spark):
    import numpy as np

    from tessera.llm.components import components

    mask = 2**64 - 1

    def mixed(h, k):
        x = (h + (k + 1) * 0x9E3779B97F4A7C15) & mask
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    def brute_wide(hashes, words):
        """The bits of every word, the first one lowest."""
        out = 0
        for k in range(words):
            m = [mixed(h, k) for h in sorted(hashes)]
            for b in range(64):
                ones = sum(x >> b & 1 for x in m)
                out |= (2 * ones > len(m) or (2 * ones == len(m) and m[0] >> b & 1)) << (64 * k + b)
        return out

    r = random.Random(21)
    sets = []
    for n in (1, 3, 4, 5, 6, 20, 60):
        base = [r.getrandbits(64) for _ in range(n)]
        sets += [base, base + [r.getrandbits(64)], [r.getrandbits(64), *base[1:]]]
        sets += [base[: n // 2] + [r.getrandbits(64) for _ in range(n - n // 2)]]
    sets.append([r.getrandbits(64) for _ in range(700)])
    wide = []
    for h in sets:
        words = 56 if len(h) <= 5 else 28
        got = S.wide_fingerprint(np.unique(np.array(h, np.uint64)), words)
        wide.append(sum(int(x) << (64 * k) for k, x in enumerate(got)))
        if words == 56 or len(h) < 30:
            assert wide[-1] == brute_wide(h, words)
    # A crowd around one centre shares keys with hundreds; in it and around it are pairs of every distance.
    centre, crowd = r.getrandbits(28 * 64), []
    for k in range(420):
        x = centre
        for b in r.sample(range(16, 28 * 64), 10 + 2 * k):
            x ^= 1 << b
        crowd.append(x)
    rows = [(k, len(h), w.to_bytes(448 if len(h) <= 5 else 224, "little")) for k, (h, w) in enumerate(zip(sets, wide))]
    rows += [(1000 + k, 50, x.to_bytes(224, "little")) for k, x in enumerate(crowd)]
    df = spark.createDataFrame([*rows, rows[5], (5000, 0, None)], "fp long, n long, sim binary")

    comp = {f: f for f, _, _ in rows}
    blocks = {f: np.frombuffer(s, "<u2") for f, n, s in rows if n >= 4}
    for f, x in blocks.items():
        for g, y in blocks.items():
            m = min(len(x), len(y))
            if g < f and comp[f] != comp[g] and (x[:m] == y[:m]).any() and np.bitwise_count(x[:8] ^ y[:8]).sum() <= 38:
                lo, hi = sorted((comp[f], comp[g]))
                comp = {k: lo if c == hi else c for k, c in comp.items()}
    root = {x.node: x.root for x in components(S.near_fingerprints(df, 0.8), "fp", "root").collect()}
    assert {f: root.get(f, f) for f in comp} == comp and 5000 not in root
    assert 20 < len(set(comp.values())) < len(comp) - 100
