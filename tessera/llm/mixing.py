"""Mixing sources to target weights by iterative proportional fitting, with DataFrame functions only.

Documents fall into cells of source, language and topic. Token weights of the cells are raked: scaled in turn so that
their sums by source, by language and by topic meet the targets, until every sum is within ``tolerance`` of its target or
``sweeps`` are done (targets that contradict each other are never met); the distance left is returned as ``residual``.
Each cell's documents are then sampled with probability min(1, lambda * weight / tokens), lambda being exact for the wanted
share of all tokens.

Scale: one aggregate of the texts to cells (combined map-side; a source with a third of all rows is one row per task and
cell), fitting on the cells alone, and a join back. Every category keeps its own target. Up to ``in_row`` cells, all sweeps
run in one task on arrays; beyond that each sweep is three grouped sums and joins of the cells. Both do the same sums.
Rates of up to ``broadcast_rows`` cells are broadcast, beyond that joined by shuffle. The draw is a hash of the id, so it is
the same in every run and on every executor.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD_SPLIT, store

DIMS = ("source", "lang", "topic")
#: Topic rules: the first pattern that a text holds; else "prose". Any column can take their place.
TOPICS = (("legal", "(?i)licen[sc]ed|copyright"), ("contact", r"@|<EMAIL>|<PHONE>|\+[0-9]"), ("list", r" \| |\n[-*] "))


def topic_of(text: Column) -> Column:
    out = F.lit("prose")
    for name, pattern in reversed(TOPICS):
        out = F.when(text.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def tokens_of(text: Column) -> Column:
    """White-space words of a text."""
    return F.size(F.filter(F.split(text, WORD_SPLIT), lambda x: x != "")).cast("double")


def draw(id_col: Column, seed: int) -> Column:
    """Uniform in [0, 1) from the id: 52 bits of an MD5."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null"))))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def _key(c: Column) -> Column:
    """A category's key: no value can be that of null."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-"))


def attributes(docs: DataFrame, seed: int = 8, id_col: str = "doc_id", text_col: str = "text", topic: Column | None = None) -> DataFrame:
    """(_row, keys of source, lang and topic, tokens, u) for each row of ``docs``."""
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    dims = {"source": F.col("source"), "lang": F.col("lang"), "topic": topic_of(t) if topic is None else topic}
    return docs.select(F.struct("*").alias("_row"), *[_key(c).alias(k) for k, c in dims.items()], tokens_of(t).alias("tokens"), draw(F.col(id_col), seed).alias("u"))


def targets_of(cells: DataFrame, column: str, given: dict[str | None, float] | None, power: float) -> DataFrame:
    """(key, target) with sum 1 over the keys that have tokens: the given weights, or the corpus's token shares to
    ``power``. A category without a given weight gets none."""
    t = cells.groupBy(F.col(column).alias("key")).agg(F.sum("tokens").alias("t")).where("t > 0")
    if given is None:
        t = t.select("key", F.pow("t", F.lit(power)).alias("w"))
    else:
        rows = [("-" if k is None else f"={k}", float(v)) for k, v in given.items()]
        weights = cells.sparkSession.createDataFrame(rows, "key string, w double")
        t = t.join(weights, "key", "left").select("key", F.coalesce("w", F.lit(0.0)).alias("w"))
    total = t.agg(F.sum("w")).first()[0] or 0.0
    return t.select("key", (F.col("w") / F.lit(total) if total > 0 else F.lit(0.0)).alias("target"))


def _let(value: Column, f) -> Column:
    return F.element_at(F.transform(F.array(value), f), 1)


def _rake_in_row(c: DataFrame, sweeps: int, tolerance: float) -> DataFrame:
    """All sweeps in one expression over one row: by dimension the cells of each category, and an array of factors."""
    for k, d in enumerate(DIMS):
        number = (F.row_number().over(W.orderBy(d)) - 1).alias(f"i{k}")
        c = c.join(F.broadcast(c.select(d).distinct().select(F.col(d), number)), d)
    c = store(c, "indexed")
    others = ((1, 2), (0, 2), (0, 1))
    views = [F.struct(F.lit(k).alias("dim"), F.col(f"i{k}").alias("own"), F.col(f"{d}_target").alias("target"), F.struct(F.col(f"i{x}").alias("x"), F.col(f"i{y}").alias("y"), "tokens").alias("cell")) for (k, d), (x, y) in zip(enumerate(DIMS), others, strict=True)]
    g = c.select(F.explode(F.array(*views)).alias("v")).select("v.*").groupBy("dim", "own").agg(F.max("target").alias("target"), F.sort_array(F.collect_list("cell")).alias("cells"))
    one = g.groupBy().agg(*[F.sort_array(F.collect_list(F.when(F.col("dim") == k, F.struct("own", "target", "cells")))).alias(f"g{k}") for k in range(3)])
    one = store(one, "categories")

    def sums(k: int, x: Column, y: Column) -> Column:
        return F.transform(F.col(f"g{k}"), lambda r: F.aggregate(r["cells"], F.lit(0.0), lambda s, e: s + e["tokens"] * F.get(x, e["x"]) * F.get(y, e["y"])))

    def scaled(k: int, total: Column) -> Column:
        return F.zip_with(F.col(f"g{k}"), total, lambda r, t: F.when(t > 0, r["target"] / t).otherwise(0.0))

    def off(k: int, total: Column, old: Column) -> Column:
        return F.array_max(F.zip_with(F.zip_with(total, old, lambda t, f: t * f), F.col(f"g{k}"), lambda a, r: F.abs(a - r["target"])))

    def sweep(acc, _):
        new = _let(sums(0, acc["f1"], acc["f2"]), lambda t0: _let(scaled(0, t0), lambda f0:
            _let(sums(1, f0, acc["f2"]), lambda t1: _let(scaled(1, t1), lambda f1:
                _let(sums(2, f0, f1), lambda t2: F.struct(f0.alias("f0"), f1.alias("f1"), scaled(2, t2).alias("f2"), F.greatest(off(0, t0, acc["f0"]), off(1, t1, acc["f1"]), off(2, t2, acc["f2"])).alias("residual")))))))
        return F.when(acc["residual"] <= tolerance, acc).otherwise(new)

    ones = lambda k: F.transform(F.col(f"g{k}"), lambda x: F.lit(1.0))
    start = F.struct(*[ones(k).alias(f"f{k}") for k in range(3)], F.lit(math.inf).alias("residual"))
    done = store(one.select(F.aggregate(F.sequence(F.lit(1), F.lit(sweeps)), start, sweep).alias("s")).select("s.*"), "factors")
    for k in range(3):
        c = c.join(F.broadcast(done.select(F.posexplode(f"f{k}").alias(f"i{k}", f"f{k}"))), f"i{k}")
    c = c.withColumn("weight", F.col("tokens") * F.col("f0") * F.col("f1") * F.col("f2"))
    return c.crossJoin(F.broadcast(done.select("residual"))).select(*DIMS, "tokens", "weight", "residual")  # one row


def _rake_by_joins(c: DataFrame, sweeps: int, tolerance: float) -> DataFrame:
    """Each sweep as grouped sums and joins; cells of any number."""
    c = c.withColumn("weight", F.col("tokens"))
    targets = [f"{d}_target" for d in DIMS]
    for _ in range(sweeps):
        offs = []
        for d, t in zip(DIMS, targets, strict=True):
            total = store(c.groupBy(d).agg(F.sum("weight").alias("total"), F.max(t).alias("want")), "totals")
            offs.append(total.agg(F.max(F.abs(F.col("total") - F.col("want")))).first()[0] or 0.0)
            c = c.join(total.select(d, "total"), d).withColumn("weight", F.when(F.col("total") > 0, F.col("weight") * F.col(t) / F.col("total")).otherwise(0.0)).drop("total")
        c = store(c, "raked")
        if max(offs) <= tolerance:
            break
    return c.select(*DIMS, "tokens", "weight", F.lit(max(offs)).alias("residual"))


def rake(cells: DataFrame, targets: dict[str, dict[str | None, float] | None] | None = None, power: float = 0.5, sweeps: int = 200, tolerance: float = 1e-12, in_row: int = 50_000) -> DataFrame:
    """Cells (keys of source, lang, topic, tokens) with weight and residual, raked to the targets; the weights sum to 1.

    A category without a given target gets none. Cells without tokens keep weight 0. ``residual`` is the greatest distance
    of a category's sum from its target before the last sweep.
    """
    c = cells
    for d in DIMS:
        c = c.join(targets_of(cells, d, (targets or {}).get(d), power).select(F.col("key").alias(d), F.col("target").alias(f"{d}_target")), d, "left")
    c = store(c.na.fill(0.0, [f"{d}_target" for d in DIMS]), "targets")
    n = c.count()
    if not n:
        return c.select(*DIMS, "tokens", F.lit(0.0).alias("weight"), F.lit(0.0).alias("residual"))
    c = store((_rake_in_row if n <= in_row else _rake_by_joins)(c, sweeps, tolerance), "weights")
    total = c.agg(F.sum("weight")).first()[0] or 0.0
    return c.withColumn("weight", F.col("weight") / F.lit(total) if total > 0 else F.lit(0.0))


def calibrate(raked: DataFrame, share: float) -> DataFrame:
    """``raked`` with p = min(1, lambda * weight / tokens), so that sum(p * tokens) is ``share`` of all tokens.

    Lambda is set as if no cell were clipped; cells that it clips leave the rest a greater one, until no more are clipped.
    Cells without tokens have p = 1. If too few cells have weight, the share cannot be met and every cell with weight has
    p = 1.
    """
    wanted = share * (raked.agg(F.sum("tokens")).first()[0] or 0.0)
    lam, clipped = 0.0, -1
    while True:
        over = F.lit(lam) * F.col("weight") > F.col("tokens")
        full, rest, n = raked.where("weight > 0 and tokens > 0").agg(F.coalesce(F.sum(F.when(over, F.col("tokens"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)), F.count_if(over)).first()
        if n == clipped:
            break
        clipped, lam = n, (wanted - full) / rest if rest > 0 else math.inf
        if lam == math.inf:
            break
    rate = F.lit(1.0) if lam == math.inf else F.least(F.lit(1.0), F.lit(lam) * F.col("weight") / F.col("tokens"))
    p = F.when(F.col("tokens") <= 0, 1.0).when(F.col("weight") <= 0, 0.0).otherwise(rate)
    return raked.withColumn("p", F.greatest(F.lit(0.0), p))


def rates(a: DataFrame, targets: dict | None = None, share: float = 0.8, power: float = 0.5, sweeps: int = 200, tolerance: float = 1e-12, in_row: int = 50_000) -> DataFrame:
    """(source, lang, topic, p, residual) of the cells of ``attributes``."""
    cells = store(a.groupBy(*DIMS).agg(F.sum("tokens").alias("tokens")), "cells")
    return store(calibrate(rake(cells, targets, power, sweeps, tolerance, in_row), share).select(*DIMS, "p", "residual"), "rates")


def assigned(a: DataFrame, fitted: DataFrame, broadcast_rows: int = 100_000) -> DataFrame:
    """``attributes`` with p and residual."""
    return a.join(F.broadcast(fitted) if fitted.count() <= broadcast_rows else fitted, list(DIMS))


def _value(c: str) -> Column:
    return F.when(F.col(c) != "-", F.substring(F.col(c), F.lit(2), F.length(c))).alias(c)


def mix(docs: DataFrame, targets: dict | None = None, share: float = 0.8, seed: int = 8, id_col: str = "doc_id", text_col: str = "text", topic: Column | None = None, broadcast_rows: int = 100_000, **options) -> DataFrame:
    """``docs`` with a struct ``mix`` of source, lang, topic, tokens, p, kept and residual.

    ``targets`` maps source, lang and topic to weights by category (None: the null category); a column without one is
    raked to its token shares to the power ``power``. Nulls are a category of their own. Null texts have no tokens. Rows
    with one id, repeated or not, share a draw. The name ``mix`` is reserved. An empty table gives an empty result.
    """
    a = attributes(docs, seed, id_col, text_col, topic)
    d = assigned(a, rates(a, targets, share, **options), broadcast_rows)
    return d.select("_row.*", F.struct(*[_value(c) for c in DIMS], "tokens", "p", (F.col("u") < F.col("p")).alias("kept"), "residual").alias("mix"))


def sample(docs: DataFrame, **options) -> DataFrame:
    """The sampled rows of ``docs`` with their own columns."""
    return mix(docs, **options).where("mix.kept").select(*docs.columns)


def op8_ipf_mixing(spark, sf_dir: str) -> DataFrame:
    """Every document with its cell, its calibrated probability and the draw's verdict. Texts are read once: the rest is
    done on the stored attributes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    a = store(attributes(docs).select("_row.doc_id", *DIMS, "tokens", "u"), "attributes")
    d = assigned(a, rates(a))
    return d.select("doc_id", *[F.coalesce(_value(c), F.lit("null")).alias(c) for c in DIMS], F.col("tokens").cast("long").alias("tokens"), F.round("p", 6).alias("p"), (F.col("u") < F.col("p")).alias("kept"))


QUERIES = {"op8_ipf_mixing": op8_ipf_mixing}


def _oracle(share: float = 0.8, power: float = 0.5, sweeps: int = 120, seed: int = 8) -> str:
    """The same in DuckDB, every sweep written out."""
    parts = [f"""
d AS (
  SELECT doc_id, coalesce(source, 'null') AS source, coalesce(lang, 'null') AS lang,
    CASE WHEN regexp_matches(t, '(?i)licen[sc]ed|copyright') THEN 'legal'
         WHEN regexp_matches(t, '@|<EMAIL>|<PHONE>|\\+[0-9]') THEN 'contact'
         WHEN regexp_matches(t, ' \\| |\\n[-*] ') THEN 'list' ELSE 'prose' END AS topic,
    CAST(len(list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS DOUBLE) AS tokens,
    CAST(CAST('0x' || substr(md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) AS DOUBLE) / {float(16**13)} AS u
  FROM (SELECT *, coalesce(text, '') AS t FROM documents)
)""", "cells AS (SELECT source, lang, topic, sum(tokens) AS tokens FROM d GROUP BY ALL)"]  # fmt: skip
    for c in DIMS:
        parts.append(f"t_{c} AS (SELECT {c}, pow(t, {power}) / sum(pow(t, {power})) OVER () AS {c}_target FROM (SELECT {c}, sum(tokens) AS t FROM cells GROUP BY {c}) WHERE t > 0)")
    parts.append("s0 AS (SELECT cells.*, coalesce(source_target, 0) AS source_target, coalesce(lang_target, 0) AS lang_target, coalesce(topic_target, 0) AS topic_target, tokens AS weight FROM cells LEFT JOIN t_source USING (source) LEFT JOIN t_lang USING (lang) LEFT JOIN t_topic USING (topic))")
    n = 0
    for _ in range(sweeps):
        for c in DIMS:
            parts.append(f"s{n + 1} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN sum(weight) OVER (PARTITION BY {c}) > 0 THEN weight * {c}_target / sum(weight) OVER (PARTITION BY {c}) ELSE 0 END AS weight) FROM s{n})")
            n += 1
    parts.append(f"""
r AS (SELECT *, CASE WHEN tokens > 0 THEN w / tokens END AS rho FROM (SELECT *, CASE WHEN sum(weight) OVER () > 0 THEN weight / sum(weight) OVER () ELSE 0 END AS w FROM s{n})),
o AS (
  SELECT *, row_number() OVER z AS place, coalesce(sum(tokens) OVER (z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    sum(w) OVER (z ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, sum(tokens) OVER () AS total
  FROM r WINDOW z AS (ORDER BY rho DESC NULLS LAST, source, lang, topic)
),
l AS (SELECT arg_min(lam, place) AS lam FROM (SELECT place, rho, CASE WHEN rest > 0 THEN ({share} * total - before) / rest END AS lam FROM o) WHERE lam * rho <= 1),
p AS (SELECT source, lang, topic, greatest(0, CASE WHEN tokens <= 0 THEN 1 WHEN w <= 0 THEN 0 ELSE least(1, coalesce(lam * rho, 1)) END) AS p FROM o, l)
SELECT doc_id, source, lang, topic, CAST(tokens AS BIGINT) AS tokens, round(CAST(p AS DOUBLE), 6) AS p, u < p AS kept FROM d JOIN p USING (source, lang, topic)
""")
    return "WITH " + ",\n".join(parts)


ORACLE_SQL = {"op8_ipf_mixing": _oracle()}
