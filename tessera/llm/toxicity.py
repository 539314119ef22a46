"""Toxicity by a counterfactually regularised linear classifier.

A text's features are its distinct words and their first three, four and five letters (lower case, punctuation at the
ends stripped), so unseen forms of a known stem count. Labelled texts that mention a group get counterfactuals in which
the identity term is swapped for others and for a neutral word; the squared change of the score is penalised in training,
so a mention of a group does not move the score by itself.

Training uses at most ``sample`` labelled rows outside the held-out fold, the least by a hash of their id (bounded, so it
is broadcast). Features that at least ``support`` toxic sample texts have are counted on the executors, and of all these the
``features`` with the strongest log-odds are kept; only their occurrences in the sample reach the driver. Scoring is one scan without
a shuffle, with a weight table of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small
from .linear import Sparse, fit, sigmoid

#: Terms for groups of people that are swapped for one another, by kind, and a neutral stand-in.
IDENTITY_TERMS = (
    ("women", "men", "females", "males", "girls", "boys"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "african", "european", "latino", "arab", "mexican"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "queer"),
    ("immigrants", "refugees", "foreigners", "citizens"),
    ("blind", "deaf", "disabled", "elderly"),
)
NEUTRAL = "people"
_ENDS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»„“”‘’…"


def words_of(text: str | None) -> set[str]:
    """Distinct lower-case words, punctuation at their ends stripped."""
    return {x for w in set((text or "").lower().split()) if (x := w.strip(_ENDS))}


def word_features(w: str) -> list[str]:
    return [w, *("^" + w[:k] for k in (3, 4, 5) if len(w) >= k)]


def features_of(words: Iterable[str]) -> set[str]:
    return {f for w in words for f in word_features(w)}


def counterfactuals(words: set[str], groups=IDENTITY_TERMS, neutral: str = NEUTRAL, most: int = 3) -> list[set[str]]:
    """The word set with each identity term swapped for the next terms of its kind, and for the neutral word."""
    out = []
    for group in groups:
        for i, term in enumerate(group):
            if term in words:
                others = [group[(i + k) % len(group)] for k in range(1, min(most, len(group)))]
                out += [(words - {term}) | {x} for x in [*others, neutral]]
    return out


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from collections import Counter

    for b in small(batches):
        c: Counter = Counter()
        for t in b.column(0):
            c.update(features_of(words_of(t.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array(c.keys(), pa.string()), pa.array(c.values(), pa.int64())], ["f", "n"])


def held_out(id_col: str = "doc_id"):
    """Whether a row is in the held-out fold: CRC-32 of the id as text, a multiple of 5. A null id is not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", sample: int = 20_000, features: int = 4096, support: int = 3, tie: float = 1.0, l2: float = 1e-5) -> tuple[dict[str, float], float]:
    """Feature weights and intercept. Rows of ``labels`` in the held-out fold, with null ids or labels, are not used; of
    several labels for one id the greatest counts. With one class or no label at all, the weights are empty and the
    intercept is the smoothed log-odds of the labels seen."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    known = known.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    n, pos = known.agg(F.count("*"), F.sum("y")).first()
    pos = int(pos or 0)
    if not pos or pos == n:
        return {}, math.log((pos + 0.5) / (n - pos + 0.5))
    # At most ``sample`` rows of an id and a label: broadcasting them is bounded.
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("t")).join(F.broadcast(known), "_id")
    yes = rows.where("y = 1").select("t").mapInArrow(_counts, "f string, n long").groupBy("f").agg(F.sum("n").alias("p")).where(F.col("p") >= support)
    no = rows.where("y = 0").select("t").mapInArrow(_counts, "f string, n long").groupBy("f").agg(F.sum("n").alias("q"))
    p, q = F.col("p") + 0.5, F.coalesce("q", F.lit(0)) + 0.5
    rest_p, rest_q = F.greatest(F.lit(pos) - F.col("p"), F.lit(0)) + 0.5, F.greatest(F.lit(n - pos) - F.coalesce("q", F.lit(0)), F.lit(0)) + 0.5
    z = (F.log(p / rest_p) - F.log(q / rest_q)) / F.sqrt(1 / p + 1 / rest_p + 1 / q + 1 / rest_q)
    best = yes.join(no, "f", "left").withColumn("z", z).where("abs(z) >= 3").orderBy(F.desc(F.abs("z")), "f").limit(features)
    names = [r.f for r in best.select("f").collect()]  # at most ``features`` rows
    place = {f: i for i, f in enumerate(names)}

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longs = pa.list_(pa.int32())
        for b in small(batches):
            ys, fs, cs = [], [], []
            for t, y in zip(b.column(0), b.column(1), strict=True):
                words = words_of(t.as_py())
                ys.append(y.as_py())
                fs.append(sorted(place[f] for f in features_of(words) if f in place))
                cs.append([sorted(place[f] for f in features_of(c) if f in place) for c in counterfactuals(words)])
            yield pa.RecordBatch.from_arrays([pa.array(ys, pa.int32()), pa.array(fs, longs), pa.array(cs, pa.list_(longs))], ["y", "f", "c"])

    # At most a row per sampled label, unless ids repeat; the limit bounds that too. A hash decides which rows stay then.
    seen = rows.select("t", "y").mapInArrow(project, "y int, f array<int>, c array<array<int>>").orderBy(F.xxhash64("f", "c", "y"), "y", "f", "c").limit(2 * sample).toArrow().to_pylist()
    if not names or not seen:
        return {}, math.log((pos + 0.5) / (n - pos + 0.5))
    x = Sparse([(r["f"], np.ones(len(r["f"]))) for r in seen], len(names))
    y = np.array([r["y"] for r in seen], float)
    left = [(r["f"], np.ones(len(r["f"]))) for r in seen for _ in r["c"]]
    right = [(c, np.ones(len(c))) for r in seen for c in r["c"]]
    w, b = fit(x, y, np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, len(y) - y.sum())), l2, (Sparse(left, len(names)), Sparse(right, len(names))), tie)
    return {f: float(v) for f, v in zip(names, w) if abs(v) > 1e-6}, b


def score(docs: DataFrame, weights: dict[str, float], intercept: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score, predicted for every row; null and empty texts get the score of a text without features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        has: dict[str, tuple[str, ...]] = {}
        for b in small(batches):
            out = []
            for t in b.column(2):
                found: set[str] = set()
                for w in set((t.as_py() or "").lower().split()):
                    f = has.get(w)
                    if f is None:
                        x = w.strip(_ENDS)
                        f = has[w] = tuple(f for f in word_features(x) if f in weights) if x else ()
                    if f:
                        found.update(f)
                out.append(intercept + math.fsum(weights[f] for f in found))
                if len(has) > 200_000:
                    has.clear()
            s = sigmoid(np.array(out, float))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["id", "held_out", "score", "predicted"])

    d = docs.select(F.col(id_col).cast("long").alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string"))
    return d.mapInArrow(run, "id long, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)


def op5_counterfactual_toxicity(spark, sf_dir: str) -> DataFrame:
    """A score for every document, learnt from the labels outside the held-out fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, *train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


QUERIES = {"op5_counterfactual_toxicity": op5_counterfactual_toxicity}
ORACLE_SQL: dict[str, str] = {}
