import hashlib
import random
import re

from pyspark.sql import functions as F

from tessera.llm import pii as P

SCHEMA = "doc_id long, text string, spans string, terms string"
RX = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def ok(kind, v):
    d = [int(c) for c in v if c in "0123456789"]
    if kind == "ip":
        return all(int(x) <= 255 for x in v.split("."))
    if kind == "card":
        return 16 <= len(d) <= 19 and sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(reversed(d))) % 10 == 0
    return kind != "phone" or 8 <= len(d) <= 15


def brute(t):
    spans = [f"{k}:{m.start()}:{m.end()}" for k, rx in RX.items() for m in rx.finditer(t or "") if ok(k, m.group())]
    return [sum(s.startswith(k + ":") for s in spans) for k in RX], ",".join(spans)


def test_base_spans_against_brute_force(spark):
    r = random.Random(8)
    alphabet = list("0123456789") * 2 + list("ab.@+- ()_%\n,é") + ["4111 1111 1111 1111", "a.b@c.de_x@y.zz", "1.2.3.4", "+1 (555) 123-4567", "999.1.1.1", "001.02.3.0255", "😀"]
    texts = ["".join(r.choices(alphabet, k=r.randrange(0, 120))) for _ in range(600)]
    texts += [None, "", "a@b.c" * 50, "1" * 30_000, "x" * 60_000 + "@", "a@b.cd.ef@gh.ij", "1.2.3.4.5.6.7.8.9", "+1 " * 2000, "4111-1111-1111-1111-1111", "+12345678 4111111111111111", "\r\n+1 (234) 555-0000\r\n"]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)] + [(None, "a@b.cc", "", ""), (3, texts[3], "", "")], SCHEMA)
    found = P.base_spans(df.withColumn("_t", F.coalesce("text", F.lit(""))), "_t")
    named = lambda k: F.transform(f"_{k}", lambda x: F.concat_ws(":", F.lit(k), x["start"].cast("string"), x["end"].cast("string")))
    joined = F.array_join(F.flatten(F.array(*[named(k) for k in P.KINDS])), ",")
    for row in found.select("text", joined.alias("s"), *[F.size(f"_{k}").alias(k) for k in P.KINDS]).collect():
        counts, spans = brute(row.text)
        assert (list(row[2:]), row.s) == (counts, spans), row.text


def test_query_columns(spark, sf):
    got = {r.doc_id: r for r in P.op2_information_theoretic_pii(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        counts, spans = brute(d.text)
        r = got[d.doc_id]
        base = ",".join(s for s in r.spans.split(",") if not s.startswith(("term:", "secret:")))
        assert base == spans and [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts
        assert r.base_sha256 == hashlib.sha256(spans.encode()).hexdigest()


def rows_with_a_name():
    r = random.Random(9)
    vocab = ["".join(r.choices("abcdefgh", k=6)) for _ in range(200)]
    rows = [(i, " ".join(r.choices(vocab, k=30)), "", "") for i in range(200)]
    for i in range(6):
        w = r.choices(vocab, k=30)
        rows.append((300 + i, " ".join([*w[:15], "Zaphodix", "jo@mail.example", *w[15:]]), "", ""))
    rows.append((400, "about Zaphodix, nothing else", "", ""))
    # A text that is copied says no more than one of it.
    rows += [(500 + i, "quibble wonder thing me@x.yy other stuff", "", "") for i in range(10)]
    return rows


def test_disclosing_terms(spark):
    d = P.find(spark.createDataFrame(rows_with_a_name(), SCHEMA))
    got = {r.doc_id: [(x.kind, x.v) for x in r.pii] for r in d.collect()}
    assert all(got[300 + i] == [("email", "jo@mail.example"), ("term", "Zaphodix")] for i in range(6))
    assert got[400] == [("term", "Zaphodix")] and got[500] == [("email", "me@x.yy")] and not any(got[i] for i in range(200))
    # The joined path beyond the broadcast bound gives the same.
    other = {r.doc_id: [(x.kind, x.v) for x in r.pii] for r in P.find(spark.createDataFrame(rows_with_a_name(), SCHEMA), broadcast_rows=0).collect()}
    assert other == got


def test_sanitise(spark):
    rows = [*rows_with_a_name(), (600, "a +1 (234) 555-0000 b é 4111 1111 1111 1111", "k", "l"), (601, None, "", ""), (602, "", "", ""), (603, "10.0.0.1", "", ""), (604, "x@y.zz\n", "", "")]
    got = {r.doc_id: r for r in P.sanitise(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[600].text == "a <PHONE> b é <CARD>" and got[600].spans == "k" and got[601].text is None and got[602].text == ""
    assert got[603].text == "<IP>" and got[604].text == "<EMAIL>\n" and "Zaphodix" not in got[400].text and got[5].text == rows[5][1]
    assert P.sanitise(spark.createDataFrame([], SCHEMA)).count() == 0


WORD = re.compile(r"[^\W_]+")
SECRET = re.compile(r"(?<![\w-])([^\W\d][\w-]*)[\"']?\x20?[:=]\x20?[\"']?([A-Za-z0-9+/_~.-]{12,})")


def brute_added(rows, reach=6, support=2, generalise=0.8, fresh=0.5):
    """Term and secret spans by direct counts; xxhash64 of a context's words is replaced by a name of its own."""
    import math

    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    terms = lambda x: [w for w in WORD.findall(x.lower()) if len(w) >= 4]
    every = {w for _, t, *_ in rows for w in terms(t)}
    h = {r.w: r.h for r in spark.createDataFrame([(w,) for w in every], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    texts = [t for _, t, *_ in rows]
    n_t, n_e, beside, ways = {}, {}, {}, {}
    masked, base, cands = [], [], []
    for i, t in enumerate(texts):
        for w in set(terms(t)):
            n_t[w] = n_t.get(w, 0) + 1
        m, spans = list(t), []
        for k, rx in RX.items():
            found = list(rx.finditer(t))
            for at, x in enumerate(found):
                if not ok(k, x.group()):
                    continue
                spans.append((k, x.start(), x.end()))
                m[x.start() : x.end()] = "\0" * (x.end() - x.start())
                v = x.group().lower()
                digits = re.sub("[^0-9]", "", v)
                pool = {"email": v.rpartition("@")[2], "ip": ".".join(v.split(".")[:3]), "card": digits[:6], "phone": digits[:6]}[k]
                lo, hi = found[at - 1].end() if at else 0, found[at + 1].start() if at + 1 < len(found) else len(t)
                words = set(terms(t[lo : x.start()])[-reach:] + terms(t[x.end() : hi])[:reach])
                for e in ((k, v), (k, "~", pool)):
                    n_e.setdefault(e, set()).add(i)
                    for w in words:
                        beside.setdefault((e, w), set()).add(i)
                        ways.setdefault((e, w), set()).add(min(h[x] for x in words))
        masked.append("".join(m))
        base.append(spans)
        cands.append([(x.group(1).lower(), x.group(2), x.start(2), x.end(2)) for x in SECRET.finditer(masked[-1]) if re.search("[0-9]", x.group(2)) and re.search("[A-Za-z]", x.group(2))])
    n, flagged = len(texts), {}
    for (e, w), docs in beside.items():
        if len(ways[e, w]) >= support and w in n_t and len(n_e[e]) < n:
            d = math.log(len(docs) * n / (len(n_e[e]) * max(n_t[w], len(docs)))) / math.log(n / len(n_e[e]))
            flagged[w] = max(flagged.get(w, 0), d)
    flagged = {w for w, d in flagged.items() if d >= generalise}
    by = {}
    for t, c in zip(texts, cands):
        for label, v, *_ in c:
            by.setdefault(label, {}).setdefault(v, set()).add(t)
    labels = set()
    for label, vs in by.items():
        c = [len(x) for x in vs.values()]
        if len(c) >= 3 and 1 - sum(x * math.log(x) for x in c) / (sum(c) * math.log(sum(c))) >= fresh:
            labels.add(label)
    out = []
    for i, t in enumerate(texts):
        secrets = [(a, b) for label, v, a, b in cands[i] if label in labels or len(v) >= 20 and len(set(v)) >= 10]
        m = list(masked[i])
        for a, b in secrets:
            m[a:b] = "\0" * (b - a)
        m = "".join(m)
        hits = [x.span() for x in re.finditer(r"[^\W_]+", m) if x.group().lower() in flagged]
        out.append(([f"secret:{a}:{b}" for a, b in secrets], [f"term:{a}:{b}" for a, b in hits]))
    return out, flagged, labels


def added_rows():
    r = random.Random(12)
    vocab = ["".join(r.choices("abcdefgh", k=5)) for _ in range(150)]
    hexes = lambda n: "".join(r.choices("0123456789abcdef", k=n))
    rows = []
    for i in range(240):
        w = r.choices(vocab, k=40)
        if i % 3 == 0:
            w.insert(r.randrange(40), r.choice(["ann@one.example", "bob@two.example", "eve@two.example", "10.1.2.3", "10.1.2.9", "+1 (234) 555-0000", "4111 1111 1111 1111"]))
        if i % 8 == 0:
            w.insert(r.randrange(41), "Annabel ann@one.example")
        if i % 10 == 0:
            w.insert(r.randrange(41), r.choice(["bob@two.example", "eve@two.example"]) + " Twocorp")
        if i % 5 == 0:
            w.insert(r.randrange(41), f'token = "{hexes(16)}"')
        if i % 7 == 0:
            w.insert(r.randrange(41), "mode: constant-value-1 été=" + r.choice(["abc123def456ghi789jkl0", "aaaaaaaaaaaaaaaaaaaaa1"]))
        rows.append((i, " ".join(w), "", ""))
    return rows + [(900, rows[0][1] + " ", "", ""), (901, "", "", "")]


def test_terms_and_secrets_against_brute_force(spark):
    rows = added_rows()
    want, flagged, labels = brute_added(rows)
    assert "annabel" in flagged and "twocorp" in flagged and labels == {"token"}
    got = {r.doc_id: [f"{x.kind}:{x.start}:{x.end}" for x in r.pii if x.kind in ("secret", "term")] for r in P.find(spark.createDataFrame(rows, SCHEMA)).collect()}
    for (i, *_), (secrets, terms) in zip(rows, want):
        assert got[i] == secrets + terms, i


def test_entities_everywhere_and_many_matches(spark):
    """An entity in every document, one with more contexts than documents, and 50,000 matches in one text."""
    rows = [(i, f"some{'abc'[i]} words secretword a@b.com other words{i} secretword a@b.com again secretword a@b.com", "", "") for i in range(3)]
    assert all(x.kind == "email" for r in P.find(spark.createDataFrame(rows, SCHEMA)).collect() for x in r.pii)
    many = "é x@y.zz word " * 50_000
    (r,) = P.find(spark.createDataFrame([(1, many, "", "")], SCHEMA)).collect()
    assert [(x.start, x.end) for x in r.pii if x.kind == "email"] == [(m.start(), m.end()) for m in RX["email"].finditer(many)]
    (r,) = P.sanitise(spark.createDataFrame([(1, many, "", "")], SCHEMA)).collect()
    assert r.text == many.replace("x@y.zz", "<EMAIL>")
