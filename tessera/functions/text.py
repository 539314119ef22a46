"""Document-term matrices, feature selection, document pruning and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut
from ..sources.matrix import CoMatrix, indexed


def parse_smart(lines: DataFrame) -> DataFrame:
    """(doc, title, author, body) of a SMART collection: whole files of records with .I .T .A .W .B sections.

    ``lines`` has one file per row in ``value``. Records without a body are kept with an empty one.
    """
    record = F.explode(F.split("value", r"(?m)^\.I\s+"))
    d = lines.select(record.alias("r")).where(F.trim("r") != "")
    part = lambda tag: F.trim(F.regexp_replace(F.regexp_extract("r", rf"(?ms)^\.{tag}\s*\n(.*?)(?=^\.[A-Z]\s*$|\z)", 1), r"\s+", " "))
    return d.select(F.regexp_extract("r", r"^\s*(\d+)", 1).cast("long").alias("doc"), part("T").alias("title"), part("A").alias("author"), part("W").alias("body"))


def tokens(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, term): lower-case runs of ASCII letters and digits, longer than two characters."""
    t = docs.select(F.col(id_col).alias("doc"), F.explode(F.split(F.lower(text_col), "[^a-z0-9]+")).alias("term"))
    return t.where(F.length("term") > 2)


def tfidf(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_df: int = 2, max_df: float = 0.8) -> DataFrame:
    """(doc, term, v) with v = (1 + ln c) * ln(N / (1 + df)); terms need min_df <= df <= floor(max_df * N).

    Counts are combined map-side; document frequencies (one row per term) join back.
    """
    n = docs.count()
    counts = tokens(docs, id_col, text_col).groupBy("doc", "term").agg(F.count("*").alias("c"))
    df = counts.groupBy("term").agg(F.count("*").alias("df")).where((F.col("df") >= min_df) & (F.col("df") <= int(max_df * n)))
    return counts.join(df, "term").select("doc", "term", ((1 + F.log("c")) * F.log(F.lit(float(n)) / (1 + F.col("df")))).alias("v"))


def doc_term_matrix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> tuple[CoMatrix, DataFrame, DataFrame]:
    """The TF-IDF matrix and its (key, idx) dictionaries of documents and terms."""
    cells = cut(tfidf(docs, id_col, text_col, **options))
    (rows, n), (cols, k) = indexed(cells, "doc"), indexed(cells, "term")
    d = cells.join(rows.select(F.col("key").alias("doc"), F.col("idx").alias("i")), "doc").join(cols.select(F.col("key").alias("term"), F.col("idx").alias("j")), "term")
    return CoMatrix(d.select("i", "j", "v"), n, k), rows, cols


def dense_variance(m: CoMatrix) -> DataFrame:
    """(j, var): population variance of each column, unstored zeros included."""
    n = float(max(1, m.n_rows))
    mean = F.sum("v") / n
    return m.df.groupBy("j").agg((F.sum(F.col("v") * F.col("v")) / n - mean * mean).alias("var"))


def top_variance_features(m: CoMatrix, n: int) -> DataFrame:
    """(j, var, place) of the n columns of greatest variance, zero-variance ones left out, placed in their own order."""
    best = dense_variance(m).where("var > 0").orderBy(F.desc("var"), "j").limit(n)
    return best.withColumn("place", F.row_number().over(W.orderBy("j")).cast("long") - 1)


def select_columns(m: CoMatrix, chosen: DataFrame) -> CoMatrix:
    d = m.df.join(chosen.select("j", "place"), "j").select("i", F.col("place").alias("j"), "v")
    return CoMatrix(d, m.n_rows, chosen.count())


def sizes_of(m: CoMatrix) -> DataFrame:
    return m.df.where("v <> 0").groupBy("i").agg(F.count("*").alias("nnz"))


def prune_short(m: CoMatrix, target: int) -> DataFrame:
    """(i, nnz) of the rows with at least the largest threshold of non-zeros that still keeps ``target`` rows; all of them if there are fewer.

    Thresholds come from the histogram of row sizes, a narrow table.
    """
    rows = sizes_of(m)
    hist = rows.groupBy("nnz").agg(F.count("*").alias("c"))
    # Rows kept at each threshold: a running sum over the histogram, from the longest down.
    kept = hist.withColumn("kept", F.sum("c").over(W.orderBy(F.desc("nnz")).rowsBetween(W.unboundedPreceding, 0)))
    bound = kept.where(F.col("kept") >= target).agg(F.coalesce(F.max("nnz"), F.lit(0)).alias("bound"))
    return rows.crossJoin(F.broadcast(bound)).where("nnz >= bound").select("i", "nnz")  # one row


def hashed(key: str, seed: int):
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))


def stratified_sample(labels: DataFrame, total: int, seed: int = 0, id_col: str = "i", label_col: str = "label") -> DataFrame:
    """A sample of ``total`` rows, floor(total * share) of each label and the rest by the hash order of all others.

    Ranks within a label use a salted two-step rank, so a label with most rows is not sorted in one task.
    """
    d = labels.select(F.col(id_col).alias("i"), F.col(label_col).alias("label"), hashed(id_col, seed).alias("h"))
    sizes = d.groupBy("label").agg(F.count("*").alias("n"))
    n = sizes.agg(F.sum("n").alias("all"))
    quota = sizes.crossJoin(F.broadcast(n)).select("label", F.floor(F.lit(float(total)) * F.col("n") / F.col("all")).alias("q"))
    r = ranked(d).join(F.broadcast(quota), "label")
    first = r.where("rn <= q").select("i", "label")
    missing = quota.agg((F.lit(total) - F.sum("q")).cast("int").alias("m")).first()["m"] or 0
    if missing <= 0:
        return first
    return first.unionAll(r.where("rn > q").orderBy("h", "i").limit(missing).select("i", "label"))


def equal_sample(labels: DataFrame, per_class: int, seed: int = 0, id_col: str = "i", label_col: str = "label") -> DataFrame:
    """``per_class`` rows of each label, the least by hash."""
    d = labels.select(F.col(id_col).alias("i"), F.col(label_col).alias("label"), hashed(id_col, seed).alias("h"))
    best = W.partitionBy("label").orderBy("h", "i")
    # A rank limit right on the window is applied in each task before the shuffle.
    return d.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= per_class).select("i", "label")


def ranked(d: DataFrame, salts: int = 256) -> DataFrame:
    """``d`` (i, label, h) with rn, the rank by (h, i) within the label: the rank in a hash range plus earlier ranges' counts."""
    s = d.withColumn("s", F.conv(F.substring("h", 1, 2), 16, 10).cast("int") % salts)
    counts = s.groupBy("label", "s").agg(F.count("*").alias("c"))
    before = counts.select("label", "s", F.coalesce(F.sum("c").over(W.partitionBy("label").orderBy("s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("b"))
    local = s.withColumn("k", F.row_number().over(W.partitionBy("label", "s").orderBy("h", "i")))
    return local.join(before, ["label", "s"]).select("i", "label", "h", (F.col("k") + F.col("b")).alias("rn"))


def single_label(multi: DataFrame, id_col: str, scores: str) -> DataFrame:
    """(i, label): the place of the greatest of an array of class scores, the first of equals; all-zero rows are dropped."""
    best = F.array_max(scores)
    return multi.where(best > 0).select(F.col(id_col).alias("i"), (F.array_position(scores, best) - 1).cast("long").alias("label"))
