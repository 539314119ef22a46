"""Weak-label quality model: expectation-maximisation over heuristic labellers, then a hashed linear scorer.

Overlapping heuristics vote on each document: bad, good or abstain. Expectation-maximisation (two classes, labellers
independent given the class, abstentions carry no evidence) estimates each labeller's accuracy and the share of bad
documents from the counts of vote patterns over the whole corpus. There are at most 3^len(LABELLERS) patterns whatever
the corpus size; only their counts reach the driver.

The posterior of a document's pattern labels it for a linear scorer on hashed features: shares of word shapes (letters,
capitals, digits and punctuation in order, runs collapsed) and bucketed text statistics. It is fitted on at most
``sample`` documents (a documented bound), the least by a hash of id and text. The scorer, unlike the votes, judges a
text that no labeller votes on, and weighs many faint signs.

Scale: two scans of the texts, with a map-side combined count between them; no shuffle of texts. The model is bounded
(2^``bits`` weights).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_key, small
from .linear import Sparse, fit, sigmoid
from .quality_rules import CLASSES, _classes, _repeat_words

BAD, GOOD, NONE = 1, 0, -1
LABELLERS = ("symbols", "capitals", "repeats", "separators", "variety", "marks", "plain")


_KIND = bytes(97 if 97 <= c <= 122 or c > 127 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in range(256))
_RUNS = re.compile(rb"([a0!-/:-@\[-`{-~])\1+").sub
_CAPS = re.compile(rb"AAA+").sub
_LETTER = re.compile(rb"[aA0]").search
_PLAIN = re.compile(rb"""[("']?A?a?(?:['-]a)*[.,;:!?)"']?(?<=[aA.,;:!?)"'])""").fullmatch


@dataclass(frozen=True)
class Stats:
    n: int
    symbols: float  # symbol characters per word
    capitals: float  # capitals among ASCII letters
    repeats: float  # words in repeated five-word windows
    separators: float  # words without a letter or digit
    variety: float  # distinct words among 100 consecutive ones, averaged over the text
    marks: float  # punctuation marks per word
    plain: float  # words of small letters, with at most a first capital and marks at the ends


def shapes_of(raw: bytes) -> Counter:
    """Word shapes of a whole text: a and 0 for runs of small letters (all beyond ASCII among them) and digits, A for one
    capital and AA for more, other characters once for a run."""
    return Counter(_CAPS(b"AA", _RUNS(rb"\1", raw.translate(_KIND))).split())


def _variety(words: list[bytes], segment: int = 100) -> float:
    """Distinct words among ``segment`` consecutive ones, averaged over the whole segments (a shorter text is one): unlike
    the share in the whole text, it does not fall with the length."""
    if len(words) < 2 * segment:
        return len(set(words)) / max(1, len(words))
    whole = range(0, len(words) - segment + 1, segment)
    return sum(len(set(words[i : i + segment])) for i in whole) / (segment * len(whole))


def stats_of(raw: bytes, words: list[bytes], shapes: Counter) -> Stats:
    n = max(1, len(words))
    c = dict(zip(CLASSES, _classes(raw)[1], strict=True))
    bare = sum(k for x, k in shapes.items() if not _LETTER(x))
    plain = sum(k for x, k in shapes.items() if _PLAIN(x))
    letters = c["lower"] + c["upper"]
    return Stats(len(words), c["symbol"] / n, c["upper"] / letters if letters else 0.0, _repeat_words(words) / n, bare / n, _variety(words), c["mark"] / n, plain / n)


def votes(s: Stats) -> tuple[int, ...]:
    """One vote per labeller. Texts of under 5 words are too short for any but the first two."""

    def vote(x: float, bad: bool, good: bool, least: int) -> int:
        return NONE if s.n < least else BAD if bad else GOOD if good else NONE

    return (
        vote(s.symbols, s.symbols > 0.25, s.symbols < 0.02, 1),
        vote(s.capitals, s.capitals > 0.6, s.capitals < 0.25, 3),
        vote(s.repeats, s.repeats > 0.5, s.repeats < 0.1, 20),
        vote(s.separators, s.separators > 0.12, s.separators < 0.01, 5),
        vote(s.variety, s.variety < 0.3, s.variety > 0.5, 20),
        vote(s.marks, s.marks > 0.9, s.marks < 0.5, 5),
        vote(s.plain, s.plain < 0.6, s.plain > 0.8, 10),
    )


def features(shapes: Counter, s: Stats, bits: int) -> tuple[list[int], list[float]]:
    """Hashed columns and values: square roots of word-shape shares, and one of ten buckets for each statistic."""
    mask, out = (1 << bits) - 1, Counter()
    for x, k in shapes.items():
        out[xxhash.xxh3_64_intdigest(b"s:" + x) & mask] += math.sqrt(k / max(1, s.n))
    if s.n >= 10:
        for name in LABELLERS:
            v = getattr(s, name)
            out[xxhash.xxh3_64_intdigest(f"{name}:{min(9, int(10 * v))}") & mask] += 1.0
    cols = sorted(out)
    return cols, [out[c] for c in cols]


@dataclass
class VoteModel:
    """prior: P(bad). hit[k][c][v]: P(labeller k votes v | class c, it votes), class and vote 0 good, 1 bad."""

    prior: float = 0.1
    hit: np.ndarray = field(default_factory=lambda: np.tile([[0.995, 0.005], [0.7, 0.3]], (len(LABELLERS), 1, 1)))

    def posterior(self, pattern: tuple[int, ...]) -> float:
        z = math.log(self.prior / (1 - self.prior))
        for k, v in enumerate(pattern):
            if v != NONE:
                z += math.log(self.hit[k][1][v] / self.hit[k][0][v])
        return float(sigmoid(z))

    @property
    def accuracy(self) -> list[float]:
        return [float((1 - self.prior) * h[0][0] + self.prior * h[1][1]) for h in self.hit]


def estimate(patterns: dict[tuple[int, ...], int], rounds: int = 200, smooth: float = 1.0) -> VoteModel:
    """Expectation-maximisation over pattern counts. It starts from labellers that are seldom wrong when they say bad and
    see three bad texts in ten: kinds of bad text differ, and each labeller knows one or two of them. An empty corpus
    leaves the starting model."""
    m = VoteModel()
    keys = sorted(patterns)
    total = sum(patterns.values())
    if not total:
        return m
    n = np.array([patterns[k] for k in keys], float)
    v = np.array(keys)
    for _ in range(rounds):
        p = np.array([m.posterior(k) for k in keys])
        prior = float(np.clip((n @ p + smooth) / (total + 2 * smooth), 1e-4, 0.9))
        hit = np.empty_like(m.hit)
        for k in range(v.shape[1]):
            for c, q in ((0, 1 - p), (1, p)):
                good, bad = (n * q) @ (v[:, k] == GOOD), (n * q) @ (v[:, k] == BAD)
                hit[k][c] = np.array([good + smooth * (7 if c else 9.95), bad + smooth * (3 if c else 0.05)]) / (good + bad + 10 * smooth)
        # A labeller's word is worth something: it says bad of few good texts, and of more of the bad ones.
        hit[:, 0, 1] = np.minimum(hit[:, 0, 1], 0.01)
        hit[:, 0, 0] = 1 - hit[:, 0, 1]
        moved = abs(prior - m.prior) + np.abs(hit - m.hit).max()
        m = VoteModel(prior, hit)
        if moved < 1e-9:
            break
    return m


@dataclass
class Scorer:
    votes: VoteModel
    weights: np.ndarray
    intercept: float
    bits: int


def _read(t: pa.Scalar) -> tuple[Stats, Counter]:
    raw = (t.as_py() or "").encode("utf-8", "surrogatepass")
    shapes = shapes_of(raw)
    return stats_of(raw, raw.split(), shapes), shapes


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 20_000, bits: int = 14) -> Scorer:
    """The vote model over all rows, and the scorer on a bounded sample of them."""

    def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            c: Counter = Counter(",".join(map(str, votes(_read(t)[0]))) for t in b.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(c.keys(), pa.string()), pa.array(c.values(), pa.int64())], ["pattern", "n"])

    t = docs.select(F.col(text_col).cast("string").alias("t"))
    counts = t.mapInArrow(patterns, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    model = estimate({tuple(map(int, r[0].split(","))): r[1] for r in counts})
    # The least keys: at most ``sample`` narrow rows, then one scan that keeps those texts' features.
    keyed = docs.select(*row_key(id_col, text_col), F.col(text_col).cast("string").alias("t"))
    order = F.xxhash64("_k1", "_k2")
    chosen = keyed.select("_k1", "_k2").withColumn("o", order).orderBy("o", "_k1", "_k2").limit(sample).select("_k1", "_k2").distinct()

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            rows = []
            for t in b.column(0):
                s, shapes = _read(t)
                rows.append((",".join(map(str, votes(s))), *features(shapes, s, bits)))
            cols = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, (pa.string(), pa.list_(pa.int32()), pa.list_(pa.float64())), strict=True)], ["p", "c", "v"])

    rows = keyed.join(F.broadcast(chosen), ["_k1", "_k2"]).select("t").mapInArrow(project, "p string, c array<int>, v array<double>").orderBy("p", "c", "v").limit(sample).toArrow().to_pylist()
    if not rows:
        return Scorer(model, np.zeros(1 << bits), 0.0, bits)
    y = np.array([model.posterior(tuple(map(int, r["p"].split(",")))) for r in rows])
    w, b = fit(Sparse([(r["c"], r["v"]) for r in rows], 1 << bits), y, l2=1e-5, steps=300)
    return Scorer(model, w, b, bits)


def score(docs: DataFrame, model: Scorer, id_col: str = "doc_id", text_col: str = "text", reject: float = 0.5) -> DataFrame:
    """All columns of ``docs`` and weak_posterior and score (both P(bad)) and kept (score below ``reject``).

    Null and empty texts have no votes and no features: they get the intercept's score. Repeated rows and null ids stay;
    an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            post, out = [], []
            for t in b.column(b.num_columns - 1):
                s, shapes = _read(t)
                c, v = features(shapes, s, model.bits)
                post.append(model.votes.posterior(votes(s)))
                out.append(float(model.weights[c] @ np.array(v)) + model.intercept if c else model.intercept)
            p = sigmoid(np.array(out, float))
            cols = [*b.columns[:-1], pa.array(post, pa.float64()), pa.array(p), pa.array(p < reject)]
            yield pa.RecordBatch.from_arrays(cols, [*b.schema.names[:-1], "weak_posterior", "score", "kept"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "id long, weak_posterior double, score double, kept boolean").withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, model: Scorer, text_col: str = "text", reject: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is below ``reject``. One narrow scan, no join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            at, keep = b.schema.names.index(text_col), []
            for t in b.column(at):
                s, shapes = _read(t)
                c, v = features(shapes, s, model.bits)
                keep.append(bool(sigmoid((float(model.weights[c] @ np.array(v)) if c else 0.0) + model.intercept) < reject))
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op4_weak_label_quality(spark, sf_dir: str) -> DataFrame:
    """doc_id, the vote posterior, the scorer's score and the verdict for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, train(docs))


QUERIES = {"op4_weak_label_quality": op4_weak_label_quality}
ORACLE_SQL: dict[str, str] = {}
