"""Information-theoretic sanitisation of personal data, with DataFrame functions only.

Protected entities are found by pattern: e-mail addresses, IPv4 addresses, card numbers (Luhn) and phone numbers. What
else gives them away is estimated from the corpus:

* Terms. How much a term t reveals of an entity e is its pointwise mutual information with e relative to the information
  content of e,

      disclosure(t, e) = log(n_te n / (n_t n_e)) / log(n / n_e),

  between 0 (independent) and 1 (t occurs with e alone). All counts are of documents: n in all, n_t with t, n_e with e,
  n_te with t among the ``reach`` words on either side of e; an entity in every document carries no information and has
  disclosure 0. Most entities are rare, so evidence is pooled: e is the entity itself, and also its mail domain, network
  (three bytes), card issuer (six digits) or phone area (six digits). A pair is judged if it stands in ``support``
  different contexts; a context is named by the least hash of its words, so copies of a text, and most near copies, count
  as one. Terms at or above ``generalise`` are replaced by a placeholder, at or above ``remove`` they go.
* Secrets. A value of 12 or more letters and digits behind a label (``label = "value"``) is a secret if the label's
  values are nearly all different: the entropy of values given the label, over distinct texts, is at least ``fresh`` of
  its maximum, for three values or more. So constants and settings stay. A label seen too rarely is judged by the value's
  own information: 20 or more characters, of 10 kinds or more.

Positions come from pattern matches and the pieces between them (regexp_extract_all and split agree on the leftmost
non-overlapping matches), so nothing leaves the JVM. They are running sums, taken in blocks, and texts are cut at byte
offsets: work is linear in the text and, up to 10^5 matches, in the matches. Patterns are possessive where nothing could
match on backtracking and anchored to run starts. Corpus counts are hash aggregates with map-side combining. The candidate
terms (few: they need ``support`` contexts) are broadcast up to ``broadcast_rows``, else joined by shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_key, store

KINDS = ("email", "ip", "card", "phone")
#: Java patterns. \G lets a match start where the last one ended.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A label, a mark, and a value of 12 or more characters; groups 1 and 2 are label and value.
SECRET = r"""(?<![\p{L}\p{N}_-])([\p{L}_][\p{L}\p{N}_-]*+)["']?+\x20?+[:=]\x20?+["']?+([A-Za-z0-9+/_~.-]{12,}+)"""
#: What a text must hold for a pattern to match; cheap to look for.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
_LETTERS = r"[^\p{L}\p{N}]+"


def _luhn(v: Column) -> Column:
    d = F.regexp_replace(v, "[^0-9]", "")
    n = F.length(d)

    def value(i):
        x = F.substring(d, i, F.lit(1)).cast("int")
        twice = x * 2
        return F.when((n - i) % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(x)

    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + value(i))
    return F.when((n >= 16) & (n <= 19), total % 10 == 0).otherwise(F.lit(False))


def _valid(kind: str, v: Column) -> Column:
    if kind == "ip":
        return v.rlike(r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$")
    if kind == "card":
        return _luhn(v)
    if kind == "phone":
        return F.length(F.regexp_replace(v, "[^0-9]", "")).between(8, 15)
    return F.lit(True)


def let(value: Column, f) -> Column:
    """f(value) with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def scan(items: Column, zero: Column, step, kind: str, block: int = 256) -> Column:
    """array<kind> of the outputs of step(state, item) -> (state, output), in order.

    Items are taken in blocks, since an array that grows within an aggregate is copied for each item: n items cost
    n * block / 2 + (n / block)^2 / 2 copied references.
    """
    empty = F.array().cast(f"array<{kind}>")
    first = F.array(F.struct(zero.alias("s"), empty.alias("out")))

    def one(acc, x):
        state, out = step(acc["s"], x)
        return F.struct(state.alias("s"), F.concat(acc["out"], F.array(out)).alias("out"))

    def run(v):
        def chunk(acc, c):
            start = F.struct(F.element_at(acc, -1)["s"].alias("s"), empty.alias("out"))
            return F.concat(acc, F.array(F.aggregate(F.slice(v, c * block + 1, F.lit(block)), start, one)))

        numbers = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / block).cast("int"))
        return F.when(F.size(v) > 0, F.flatten(F.transform(F.aggregate(numbers, first, chunk), lambda x: x["out"]))).otherwise(empty)

    return let(items, run)


def matches(text: Column, pattern: Column, has: Column) -> Column:
    """struct(m, p): the leftmost non-overlapping matches and the pieces between them; ``has``: whether there can be any."""
    m, p = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, pattern, -1)
    none = F.struct(F.array().cast("array<string>").alias("m"), F.array(text).alias("p"))
    return F.when(has, F.struct(m.alias("m"), p.alias("p"))).otherwise(none)


_SPAN = "struct<start:int,end:int,b:int,e:int,v:string>"


def positions(found: Column, kind: str) -> Column:
    """array<struct(start, end, b, e, v)> from ``matches``, in code points and in bytes; failing matches are dropped."""
    m, p = found["m"], found["p"]
    empty = F.array().cast(f"array<{_SPAN}>")

    def step(at, x):
        start, b = at["end"] + F.length(x["p"]), at["e"] + F.octet_length(x["p"])
        end, e = start + F.length(x["m"]), b + F.octet_length(x["m"])
        return F.struct(end.alias("end"), e.alias("e")), F.struct(start.alias("start"), end.alias("end"), b.alias("b"), e.alias("e"), x["m"].alias("v"))

    pairs = F.zip_with(m, F.slice(p, F.lit(1), F.size(m)), lambda a, b: F.struct(a.alias("m"), b.alias("p")))
    out = scan(pairs, F.struct(F.lit(0).alias("end"), F.lit(0).alias("e")), step, _SPAN)
    return F.when(F.size(m) > 0, F.filter(out, lambda x: _valid(kind, x["v"]))).otherwise(empty)


def spliced(text: Column, spans: Column, tag) -> Column:
    """``text`` with each span replaced by tag(span, state, fresh); spans that overlap are one stretch, ``fresh`` its first."""
    keys = ("start", "end", "b", "e", "kind", "gone")
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(*[x[k].alias(k) for k in keys])))

    def step(at, x):
        piece = F.struct(at["e"].alias("lo"), F.greatest(at["e"], x["b"]).alias("hi"), tag(x, at, x["b"] >= at["e"]).alias("tag"))
        return F.struct(F.greatest(at["end"], x["end"]).alias("end"), F.greatest(at["e"], x["e"]).alias("e")), piece

    pieces = scan(ordered, F.struct(F.lit(0).alias("end"), F.lit(0).alias("e")), step, "struct<lo:int,hi:int,tag:string>")
    cut = lambda raw, lo, n: F.substring(raw, lo + 1, n).cast("string")
    whole = let(
        text.cast("binary"),
        lambda raw: F.concat(
            F.array_join(F.transform(pieces, lambda x: F.concat(cut(raw, x["lo"], x["hi"] - x["lo"]), x["tag"])), ""),
            cut(raw, F.array_max(F.transform(spans, lambda x: x["e"])), F.octet_length(raw)),
        ),
    )
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def _masked(text: Column, spans: Column) -> Column:
    """``text`` with NUL for every code point of the spans: places stay, and nothing of a span can match again."""
    return spliced(text, spans, lambda x, at, fresh: F.repeat(F.lit("\0"), F.greatest(F.lit(0), x["end"] - F.greatest(at["end"], x["start"]))))


def _named(spans: Column, kind: str, gone=None) -> Column:
    flag = (lambda x: F.lit(False)) if gone is None else gone
    return F.transform(spans, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["v"].alias("v"), flag(x).alias("gone"), x["b"].alias("b"), x["e"].alias("e")))


def base_spans(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with a column of positions for each kind, and the pieces around matches for contexts."""
    t = F.col(text_col)
    d = docs
    for k in KINDS:
        d = d.withColumn(f"_f_{k}", matches(t, F.lit(PATTERNS[k]), F.contains(t, F.lit(NEEDS[k])) if k in NEEDS else F.lit(True)))
    for k in KINDS:
        d = d.withColumn(f"_{k}", positions(F.col(f"_f_{k}"), k))
    return d


def labelled_values(found: DataFrame) -> DataFrame:
    """``found`` with _base (all base spans), _mask (the text without them) and _cand: the values behind labels."""
    d = found.withColumn("_base", F.concat(*[_named(F.col(f"_{k}"), k) for k in KINDS]))
    d = d.withColumn("_mask", _masked(F.col("_t"), F.col("_base")))
    t = F.col("_mask")
    d = d.withColumn("_f_secret", matches(t, F.lit(SECRET), F.contains(t, F.lit("=")) | F.contains(t, F.lit(":"))))
    part = lambda x, k: F.regexp_extract(x["v"], SECRET, k)
    # A value is of one-byte characters and ends its match.
    cand = F.transform(positions(F.col("_f_secret"), "secret"), lambda x: F.struct(
        (x["end"] - F.length(part(x, 2))).alias("start"), x["end"].alias("end"), (x["e"] - F.length(part(x, 2))).alias("b"), x["e"].alias("e"), part(x, 2).alias("v"), F.lower(part(x, 1)).alias("label")))
    return d.withColumn("_cand", F.filter(cand, lambda x: x["v"].rlike("[0-9]") & x["v"].rlike("[A-Za-z]")))


def fresh_labels(found: DataFrame, fresh: float, support: int = 3) -> DataFrame:
    """(label): the labels whose values are nearly all different."""
    # explode_outer: for explode a filter on the whole expression would be added and evaluated beside it.
    seen = found.select(F.xxhash64("_t").alias("text"), F.explode_outer("_cand").alias("x")).where("x is not null").select("text", "x.label", "x.v").distinct()
    c = seen.groupBy("label", "v").agg(F.count("*").alias("c"))
    total = F.col("n")
    h = (F.log(total) - F.col("s") / total) / F.log(total)
    return c.groupBy("label").agg(F.sum("c").alias("n"), F.count("*").alias("values"), F.sum(F.col("c") * F.log("c")).alias("s")).where((F.col("values") >= support) & (h >= fresh)).select("label")


def _is_secret(x: Column, labels: Column) -> Column:
    kinds = F.size(F.array_distinct(F.split(x["v"], "")))
    return F.array_contains(labels, x["label"]) | ((F.length(x["v"]) >= 20) & (kinds >= 10))


def _terms(piece: Column) -> Column:
    return F.filter(F.split(F.lower(piece), _LETTERS), lambda x: F.length(x) >= 4)


def _pools(kind: str, v: Column) -> Column:
    """The entity's name and that of its domain, network, issuer or area."""
    digits = F.regexp_replace(v, "[^0-9]", "")
    pool = {"email": F.substring_index(v, "@", -1), "ip": F.substring_index(v, ".", 3), "card": F.substring(digits, 1, 6), "phone": F.substring(digits, 1, 6)}[kind]
    return F.array(F.concat(F.lit(f"{kind}="), v), F.concat(F.lit(f"{kind}~"), pool))


def contexts(found: DataFrame, reach: int) -> DataFrame:
    """(_k1, _k2, entity, ctx, term): the words beside each protected entity or pool; ctx names the context. A context
    without a word has one row, with a null term."""

    def beside(k: str) -> Column:
        m, p = F.col(f"_f_{k}")["m"], F.col(f"_f_{k}")["p"]
        left = lambda i: let(_terms(F.element_at(p, i + 1)), lambda w: F.slice(w, F.greatest(F.size(w) - reach + 1, F.lit(1)), F.lit(reach)))
        right = lambda i: F.slice(_terms(F.element_at(p, i + 2)), F.lit(1), F.lit(reach))
        x = F.transform(m, lambda v, i: F.struct(_pools(k, F.lower(v)).alias("entity"), F.array_distinct(F.concat(left(i), right(i))).alias("w"), _valid(k, v).alias("ok")))
        return F.filter(x, lambda y: y["ok"])

    d = found.select("_k1", "_k2", F.explode_outer(F.concat(*[beside(k) for k in KINDS])).alias("x")).where("x is not null").select("_k1", "_k2", "x.entity", "x.w")
    d = d.select("_k1", "_k2", "w", F.array_min(F.transform("w", lambda x: F.xxhash64(x))).alias("ctx"), F.explode("entity").alias("entity"))
    return d.select("_k1", "_k2", "entity", "ctx", F.explode_outer("w").alias("term"))


def disclosing_terms(docs: DataFrame, found: DataFrame, reach: int, support: int, generalise: float, broadcast_rows: int) -> tuple[DataFrame, DataFrame] | None:
    """(term, d) of the terms that disclose an entity or a pool, and the (_k1, _k2, term) rows of ``docs``; None if no
    pair has the support."""
    seen = store(contexts(found, reach).distinct(), "contexts")
    pairs = seen.where("term is not null").groupBy("entity", "term").agg(F.count_distinct("ctx").alias("ways"), F.count_distinct("_k1", "_k2").alias("n_te"))
    pairs = store(pairs.where(F.col("ways") >= support).drop("ways"), "pairs")
    if pairs.isEmpty():
        return None
    n = F.lit(float(docs.count()))
    entities = seen.select("_k1", "_k2", "entity").distinct().groupBy("entity").agg(F.count("*").alias("n_e"))
    terms = pairs.select("term").distinct()
    few = terms.count() <= broadcast_rows
    words = docs.select("_k1", "_k2", F.explode(F.array_distinct(_terms(F.col("_t")))).alias("term"))
    # Counted before the join: common terms are one row per task, not one per document.
    counts = words.groupBy("term").agg(F.count("*").alias("n_t"))
    counts = counts.join(F.broadcast(terms) if few else terms, "term")
    # A piece can end within a word, so n_t may miss a document; repeated rows share a key, so n_te and n_e count them once.
    pmi = F.log(F.col("n_te") * n / (F.col("n_e") * F.greatest("n_t", "n_te")))
    content = F.log(n / F.col("n_e"))
    d = pairs.join(entities, "entity").join(counts, "term").select("term", F.when(F.col("n_e") < n, pmi / content).otherwise(0.0).alias("d"))
    return store(d.groupBy("term").agg(F.max("d").alias("d")).where(F.col("d") >= generalise), "terms"), words


def judged(docs: DataFrame, found: DataFrame, reach: int, support: int, generalise: float, remove: float, fresh: float, broadcast_rows: int) -> DataFrame:
    """(_k1, _k2, terms, gone, labels) of the rows that hold disclosing terms or labels of secrets."""
    labels = store(fresh_labels(found, fresh), "labels")
    some = found.select("_k1", "_k2", F.explode_outer("_cand").alias("x")).where("x is not null").select("_k1", "_k2", "x.label")
    marks = some.join(F.broadcast(labels) if labels.count() <= broadcast_rows else labels, "label").select("_k1", "_k2", F.lit(None).cast("string").alias("term"), F.lit(None).cast("string").alias("gone"), "label")
    if (disclosing := disclosing_terms(docs, found, reach, support, generalise, broadcast_rows)) is not None:
        terms, words = disclosing
        if (n := terms.count()) > 0:
            held = words.join(F.broadcast(terms) if n <= broadcast_rows else terms, "term")
            marks = marks.union(held.select("_k1", "_k2", "term", F.when(F.col("d") >= remove, F.col("term")), F.lit(None).cast("string")))
    return store(marks.groupBy("_k1", "_k2").agg(*[F.sort_array(F.collect_set(c)).alias(a) for c, a in (("term", "terms"), ("gone", "gone"), ("label", "labels"))]), "marks")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 6, support: int = 2, generalise: float = 0.8, remove: float = 0.95, fresh: float = 0.5, broadcast_rows: int = 50_000) -> DataFrame:
    """``docs`` with ``pii``: array<struct(kind, start, end, v, gone, b, e)> of the base spans and the added secret and
    term spans, by kind as listed and then start. ``gone`` tells terms that are removed from those that are generalised;
    b and e are the places in bytes. Added spans touch no base span, and terms no secret.

    A null text is empty and has no spans. Positions are code points, end exclusive. Rows with equal id and text have the
    same spans. The name ``pii`` is reserved. An empty table gives an empty result.
    """
    keyed = docs.select(F.struct("*").alias("_row"), *row_key(id_col, text_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_t"))
    found = labelled_values(base_spans(keyed, "_t"))
    marks = judged(keyed, found, reach, support, generalise, remove, fresh, broadcast_rows)
    none = F.array().cast("array<string>")
    found = found.join(marks, ["_k1", "_k2"], "left").withColumn("_labels", F.coalesce("labels", none)).withColumn("_gone", F.coalesce("gone", none))
    found = found.withColumn("_secret", _named(F.filter("_cand", lambda x: _is_secret(x, F.col("_labels"))), "secret"))
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.array_join("terms", "|"), F.lit(r")(?![\p{L}\p{N}])"))
    has = F.coalesce(F.size("terms") > 0, F.lit(False))
    hit = F.when(has, positions(matches(_masked(F.col("_mask"), F.col("_secret")), pattern, F.lit(True)), "term")).otherwise(F.array().cast(f"array<{_SPAN}>"))
    term = _named(hit, "term", lambda x: F.array_contains(F.col("_gone"), F.lower(x["v"])))
    return found.select("_row.*", F.concat("_base", "_secret", term).alias("pii"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with every span replaced: base spans by <EMAIL>, <IP>, <CARD>, <PHONE>, secrets by <SECRET>, terms by
    <TERM> or nothing.

    Overlapping spans of several kinds are replaced together, named for the first. Null texts stay null.
    """
    d = find(docs, id_col, text_col, **options)
    name = lambda x: F.when(x["gone"], F.lit("")).otherwise(F.concat(F.lit("<"), F.upper(x["kind"]), F.lit(">")))
    clean = spliced(F.col(text_col).cast("string"), F.col("pii"), lambda x, at, fresh: F.when(fresh, name(x)).otherwise(F.lit("")))
    return d.withColumn(text_col, clean).select(*docs.columns)


def op2_information_theoretic_pii(spark, sf_dir: str) -> DataFrame:
    """Counts, digest and spans of the personal data in every document; n_found counts all spans."""
    d = find(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    base = F.filter("pii", lambda x: ~x["kind"].isin("secret", "term"))
    count = lambda k: F.size(F.filter("pii", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return d.select("doc_id", *[count(k) for k in KINDS], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("pii")).alias("spans"), count("secret"), count("term"), F.size("pii").cast("long").alias("n_found"))


QUERIES = {"op2_information_theoretic_pii": op2_information_theoretic_pii}
ORACLE_SQL: dict[str, str] = {}
