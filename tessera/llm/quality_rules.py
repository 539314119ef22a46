"""Quality rules by distribution divergence.

Two histograms of each document are compared with the reference of its language by Jensen-Shannon distance (base 2, so
between 0 and 1): character classes over the bytes of the text, and the language's common words with one bin for all
others. References are counted over the whole corpus: class counts are summed, and a language's common words are its
``common`` most frequent words of any length, lower-cased (A-Z) and stripped of ``.,;:!?``. Below
``min_chars`` bytes or ``min_words`` words a distance says little, so it is not judged.

Plain counts (symbols, repeated lines, repeated five-word windows) form the base rule beside it.

Two scans: the first sends partial counts per batch, the second scores each document on its own. Every language has a
reference of len(CLASSES) + ``common`` rows; a null language has that of all documents, null ones included. Up to
``max_langs`` languages are sent to the tasks, and nothing but counts is shuffled; more are joined to the documents by
language, with the same result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import small, store

CLASSES = ("lower", "upper", "digit", "space", "mark", "symbol", "other", "wide")
SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\x0b\x0c\r"
_OF_BYTE = np.full(256, CLASSES.index("other"))
for _i, _chars in enumerate((range(97, 123), range(65, 91), range(48, 58), _SPACE, b".,;:!?'\"()-", SYMBOLS)):
    _OF_BYTE[list(_chars)] = _i
_OF_BYTE[128:] = CLASSES.index("wide")
_LOW = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


@dataclass(frozen=True)
class Rules:
    """Production parameters; distances are limits above which a document is dropped."""

    max_class_distance: float = 0.34
    max_word_distance: float = 0.5
    min_chars: int = 200
    min_words: int = 50
    common: int = 50
    max_langs: int = 64


def _repeat_words(words: list[bytes], size: int = 5) -> int:
    """Words that lie in a ``size``-word window found twice or more."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    v = len(seen)
    if v**size < 2**62:
        key = np.zeros(n, np.int64)
        for k in range(size):
            key = key * v + ids[k : k + n]
    else:
        key = ids[:n]
        for k in range(1, size):
            key = np.unique(key, return_inverse=True)[1] * v + ids[k : k + n]
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    many = np.flatnonzero(counts[inverse] > 1)
    cover = np.zeros(len(words) + 1, np.int32)
    np.add.at(cover, many, 1)
    np.subtract.at(cover, many + size, 1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def _common_counts(words: list[bytes]) -> Counter:
    out: Counter = Counter()
    for w, n in Counter(words).items():
        if x := w.translate(_LOW).strip(b".,;:!?"):
            out[x] += n
    return out


def _classes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    by = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    return by, np.bincount(_OF_BYTE, weights=by, minlength=len(CLASSES))


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two count vectors, base 2; 0 if either is all zero."""
    if not p.sum() or not q.sum():
        return 0.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = 0.5 * (np.where(p > 0, p * np.log2(p / m), 0).sum() + np.where(q > 0, q * np.log2(q / m), 0).sum())
    return float(np.sqrt(min(1.0, max(0.0, d))))


def reference_counts(docs: DataFrame, rules: Rules = Rules(), text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, word, n): class counts as word `` class`` and word counts by language; `` *`` is all words. No word has a space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            total: dict[str | None, Counter] = {}
            for t, lang in zip(b.column(0), b.column(1), strict=True):
                raw = (t.as_py() or "").encode("utf-8", "surrogatepass")
                c, words = total.setdefault(lang.as_py(), Counter()), raw.split()
                c.update({b" " + k.encode(): int(n) for k, n in zip(CLASSES, _classes(raw)[1], strict=True) if n})
                c.update(_common_counts(words))
                c[b" *"] += len(words)
            rows = [(k, w.decode("utf-8", "replace"), n) for k, c in total.items() for w, n in c.items()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else ((), (), ()), (pa.string(), pa.string(), pa.int64()), strict=True)], ["lang", "word", "n"])

    d = docs.select(F.col(text_col).cast("string"), F.col(lang_col).cast("string"))
    by_lang = d.mapInArrow(run, "lang string, word string, n long")
    return by_lang.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _best(counts: DataFrame, rules: Rules) -> DataFrame:
    """(lang, rows): the class counts, the number of words and the most frequent words of each language."""
    c = counts.withColumn("kind", F.when(F.col("word").startswith(" "), 0).otherwise(1))
    # Rows beyond the first in a group are cut in each task before the shuffle.
    best = W.partitionBy("lang", "kind").orderBy(F.desc("n"), "word")
    c = c.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= F.lit(max(rules.common, len(CLASSES) + 1)))
    c = c.where((F.col("kind") == 0) | (F.col("rank") <= rules.common))
    return c.groupBy("lang").agg(F.collect_list(F.struct("word", "n")).alias("rows"))


def _reference(rows: list) -> tuple:
    """(class counts, common words, their counts, all words) from the (word, n) of one language."""
    classes, words, total = np.zeros(len(CLASSES)), {}, 0
    for word, n in rows:
        if word == " *":
            total = n
        elif word.startswith(" "):
            classes[CLASSES.index(word[1:])] = n
        else:
            words[word.encode("utf-8", "surrogatepass")] = n
    names = sorted(words)
    n = np.array([words[w] for w in names], float)
    return classes, {w: i for i, w in enumerate(names)}, np.append(n, max(0, total - n.sum()))


def references(docs: DataFrame, rules: Rules = Rules(), text_col: str = "text", lang_col: str = "lang") -> tuple[dict, DataFrame | None]:
    """lang -> (class counts, common words, their counts, all words), None for the one over all documents; and, with more
    than ``max_langs`` languages, theirs as (lang, rows) in a table instead."""
    counts = store(reference_counts(docs, rules, text_col, lang_col), "counts")
    every = counts.groupBy("word").agg(F.sum("n").alias("n")).select(F.lit("").alias("lang"), "word", "n")
    # The most frequent words of all, before the window: its one group would be a single task over the vocabulary.
    top = every.where(~F.col("word").startswith(" ")).orderBy(F.desc("n"), "word").limit(rules.common)
    out: dict = {}
    whole = [(r.word, r.n) for r in top.union(every.where(F.col("word").startswith(" "))).collect()]
    if whole:
        out[None] = _reference(whole)
    table = store(_best(counts.where("lang is not null"), rules), "references")
    if table.count() > rules.max_langs:
        return out, table
    return out | {r.lang: _reference(r.rows) for r in table.collect()}, None


SCORE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, class_distance double, word_distance double, kept boolean"


def _score(text: str | None, lang: str | None, refs: dict, rules: Rules) -> tuple:
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.split()]
    by, classes = _classes(raw)
    repeat = _repeat_words(words)
    failed = len(words) < 10 or 100 * repeat > 20 * len(words)
    ref = refs.get(lang) or refs.get(None)
    d_class = d_word = None
    if ref is not None:
        if len(raw) >= rules.min_chars:
            d_class = js_distance(classes, ref[0])
        if len(words) >= rules.min_words and ref[1]:
            own = np.zeros(len(ref[2]))
            for w, n in _common_counts(words).items():
                if (i := ref[1].get(w)) is not None:
                    own[i] += n
            own[-1] = len(words) - own.sum()
            d_word = js_distance(own, ref[2])
    kept = not failed and (d_class or 0) <= rules.max_class_distance and (d_word or 0) <= rules.max_word_distance
    return len(words), len(text) - int(by[list(_SPACE)].sum()), int(by[list(SYMBOLS)].sum()), len(lines) - len(set(lines)), repeat, failed, d_class, d_word, kept


def quality_rules(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of ``docs``: id, the counts, base_failed, the two distances (null where not judged) and kept.

    Null texts count as empty: no word, base_failed. A null language is compared with the reference of all
    documents. Repeated rows and null ids stay; an empty table gives an empty result; other columns are not read.
    """
    refs, table = references(docs, rules, text_col, lang_col)
    joined = table is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.float64(), pa.bool_()]
        own = dict(refs)
        for b in small(batches):
            if joined:
                if len(own) > 1000:
                    own = dict(refs)
                for k, x in enumerate(b.column(2)):
                    if (lang := x.as_py()) not in own and lang is not None:
                        own[lang] = _reference([(r["word"], r["n"]) for r in b.column(3)[k].as_py()])
            rows = [_score(t.as_py(), x.as_py(), own, rules) for t, x in zip(b.column(1), b.column(2), strict=True)]
            cols = zip(*rows, strict=True) if rows else [()] * 9
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, k) for x, k in zip(cols, kinds, strict=True))], ["id", *(x.split()[0] for x in SCORE.split(", "))])

    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    if joined:
        d = d.join(table, "lang", "left").select("id", "text", "lang", "rows")
    return d.mapInArrow(run, "id long, " + SCORE).withColumnRenamed("id", id_col)


def op10_divergence_rules(spark, sf_dir: str) -> DataFrame:
    """Counts, base_failed and kept for every document."""
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op10_divergence_rules": op10_divergence_rules}
ORACLE_SQL: dict[str, str] = {}
