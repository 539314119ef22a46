"""Exact substring de-duplication with prefix-partitioned suffix trees.

A window is ``length`` consecutive words of a document. A window is repeated if its word sequence starts anywhere else;
every word that a repeated window covers is removed. In suffix-tree terms: of the suffixes that start at each word, those
that lie below an internal node at a depth of ``length`` words or more. The tree is never built in one piece:

1. Sparse suffixes. Each window picks the least ``k``-word prefix hash inside it (its anchor). Equal windows pick the
   same anchor at the same place, so only about one position in fifteen is a suffix to deal out.
2. Prefix counts. Anchors are counted by their prefix over the whole corpus (combined map-side). A prefix that is seen
   once has no repeat below it and is dropped; no text moves for it.
3. Variable-length prefixes. Suffixes go to groups by their prefix. One that up to ``group`` suffixes share is the group;
   a more frequent one is extended, by one more ``k`` words of the window each time that the count doubles, up to the
   whole window. So a line that a third of all documents share is dealt out over many tasks. Windows that a batch already
   holds twice are settled there and send one witness, so copies don't pile up in a task.
4. Subtrees. A task gets the words of each group's windows and sorts all suffixes by prefix doubling (ranks of 1, 2, 4, ...
   words, from ranks of their halves). Suffixes with the same rank at depth ``length`` are the leaves below one internal
   node of that depth or more; with two or more leaves they are repeated. What comes back is a run of window starts per
   document: the maximal repeats.

Hashes only deal suffixes out and find candidates; that windows are equal is decided on their words. Rows with equal id and
text repeat each other, so each loses every window; one of them stands for all in the groups. Texts move once: both joins
read the same exchange.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts, row_key, small, store

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))
_S1, _S2 = np.uint64(29), np.uint64(32)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of sequences from the hashes of their two halves; order matters."""
    x = (a * _A) ^ ((b + _B) * _C)
    x ^= x >> _S1
    x *= _A
    return x ^ (x >> _S2)


class Windows:
    """Window hashes and anchors of one document."""

    def __init__(self, words: list[bytes], length: int):
        self.n = len(words) - length + 1
        if self.n <= 0:
            self.n = 0
            return
        k = 1 << max(0, (length // 4).bit_length() - 1)
        digest = xxhash.xxh3_64_intdigest
        h, size = np.array([digest(w) for w in words], np.uint64), 1
        at = {1: h}
        while 2 * size <= length:
            h, size = _join(h[:-size], h[size:]), 2 * size
            at[size] = h
        self.at = at
        self.whole = self.start(length)
        self.prefix = at[k]
        # Leftmost least prefix among the ``span`` ones of a window, by doubling.
        span, low, pos, size = length - k + 1, self.prefix, np.arange(len(self.prefix)), 1
        while size < span:
            step = min(size, span - size)
            a, b = low[:-step] if step else low, low[step:]
            first = a <= b
            low, pos, size = np.where(first, a, b), np.where(first, pos[:-step], pos[step:]), size + step
        self.anchor = pos[: self.n]

    def start(self, size: int) -> np.ndarray:
        """Hashes of the first ``size`` words of each window."""
        done = 1 << (size.bit_length() - 1)
        h = self.at[done]
        while done < size:
            more = 1 << ((size - done).bit_length() - 1)
            m = len(self.at[more]) - done
            h, done = _join(h[:m], self.at[more][done : done + m]), done + more
        return h[: self.n]


def _anchors(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            rows, hashes, counts = [], [], []
            for k, t in enumerate(b.column(2)):
                w = Windows(words_of(t.as_py()), length)
                if w.n:
                    h, c = np.unique(w.prefix[np.unique(w.anchor)], return_counts=True)
                    rows.append(np.full(len(h), k))
                    hashes.append(h)
                    counts.append(c)
            if rows:
                at = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(np.concatenate(hashes).view(np.int64)), pa.array(np.concatenate(counts).astype(np.int32))], ["_k1", "_k2", "ph", "c"])

    return run


_SUFFIXES = "g long, _k1 long, _k2 long, s int, n int, words string, kind byte"
_OPEN, _WITNESS, _SETTLED = 0, 1, 2


def _runs(*cols: np.ndarray) -> np.ndarray:
    """Starts of runs in which the first columns stay and the last one goes up by one."""
    new = np.ones(len(cols[-1]), bool)
    if len(new):
        new[1:] = cols[-1][1:] != cols[-1][:-1] + 1
        for x in cols[:-1]:
            new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _same(ids: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether the ``length`` words from place a on are those from place b on."""
    step, out = np.arange(length), np.empty(len(a), bool)
    for i in range(0, len(a), 20_000):
        x, y = a[i : i + 20_000, None] + step, b[i : i + 20_000, None] + step
        out[i : i + 20_000] = (ids[x] == ids[y]).all(axis=1)
    return out


def _suffixes(length: int):
    """Windows of the repeated prefixes with their words, dealt by prefix."""
    k = 1 << max(0, (length // 4).bit_length() - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            k1, k2 = np.asarray(b.column(0)), np.asarray(b.column(1))
            cols: list[list[np.ndarray]] = [[], [], [], [], [], []]
            words: list[bytes] = []
            base = np.zeros(b.num_rows, np.int64)
            for row in range(b.num_rows):
                own = words_of(b.column(2)[row].as_py())
                w = Windows(own, length)
                if not w.n:
                    continue
                base[row] = len(words)
                words += own
                known = np.asarray(b.column(3)[row].values).view(np.uint64)
                level = np.asarray(b.column(4)[row].values.cast(pa.int8()))
                order = np.argsort(known)
                known, level = known[order], level[order]
                ph = w.prefix[w.anchor]
                i = np.minimum(np.searchsorted(known, ph), len(known) - 1)
                s = np.flatnonzero(known[i] == ph)
                level, g = level[i[s]], ph[s]
                for x in np.unique(level[level > 0]).tolist():
                    deep = level == x
                    g[deep] = w.start(min(length, k * (1 + x)))[s[deep]]
                for x, y in zip(cols, (np.full(len(s), row), s, ph[s], w.whole[s], level > 0, g), strict=True):
                    x.append(y)
            if not cols[0]:
                continue
            doc, s, ph, wh, hot, g = (np.concatenate(x) for x in cols)
            # Windows that this batch holds more than once are settled here; the first of each stays as a witness.
            order = np.lexsort((wh, ph))
            first = np.ones(len(order), bool)
            first[1:] = (ph[order][1:] != ph[order][:-1]) | (wh[order][1:] != wh[order][:-1])
            later = np.flatnonzero(~first)
            leader = order[np.flatnonzero(first)[np.cumsum(first)[later] - 1]]
            later = order[later]
            ids = np.asarray(pa.array(words, pa.binary()).dictionary_encode().indices)
            equal = _same(ids, base[doc[later]] + s[later], base[doc[leader]] + s[leader], length)
            kind = np.zeros(len(order), np.int8)
            witness = np.unique(leader[equal])
            kind[later[equal]] = _SETTLED
            kind[witness] = _SETTLED
            open_ = np.flatnonzero(kind == _OPEN)
            for is_hot, which, name in ((False, open_[~hot[open_]], _OPEN), (False, witness[~hot[witness]], _WITNESS), (True, open_[hot[open_]], _OPEN), (True, witness[hot[witness]], _WITNESS), (False, np.flatnonzero(kind == _SETTLED), _SETTLED)):
                if not len(which):
                    continue
                d, p = doc[which], s[which]
                starts = np.arange(len(which)) if is_hot else _runs(d, p) if name == _SETTLED else _runs(d, ph[which], p)
                sizes = np.diff(np.append(starts, len(which)))
                at, p = d[starts], p[starts]
                to = (k2[at].view(np.uint64) * _A) if name == _SETTLED else g[which[starts]]
                if name == _SETTLED:
                    text = pa.nulls(len(starts), pa.string())
                else:
                    lo = base[at] + p
                    text = pa.array([b" ".join(words[i:j]) for i, j in zip(lo.tolist(), (lo + sizes + length - 1).tolist(), strict=True)], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(to.view(np.int64)), pa.array(k1[at]), pa.array(k2[at]), pa.array(p.astype(np.int32)), pa.array(sizes.astype(np.int32)), text, pa.array(np.full(len(starts), name, np.int8))], ["g", "_k1", "_k2", "s", "n", "words", "kind"])

    return run


def suffix_ranks(ids: np.ndarray, depth: int) -> np.ndarray:
    """For each place with ``depth`` words from it on, the rank of these words among all such: equal ranks, equal words.

    Prefix doubling: the rank of 2s words is that of the pair of ranks of its halves.
    """
    rank, size = ids.astype(np.int64), 1
    while size < depth:
        step = min(size, depth - size)  # the last pair may overlap
        low = rank[:-step] if step < len(rank) else rank[:0]
        pair = low * (int(rank.max(initial=0)) + 1) + rank[len(rank) - len(low) :]
        rank, size = np.unique(pair, return_inverse=True)[1], size + step
    return rank


def _subtrees(length: int):
    """Runs (key, first, last) of repeated windows; rows come sorted by g, whose groups hold all that can be equal."""
    names = ["_k1", "_k2", "s", "e"]

    def solve(t: pa.Table) -> pa.RecordBatch | None:
        kind = t.column("kind").to_numpy()
        k1, k2, s, n = (t.column(c).to_numpy() for c in ("_k1", "_k2", "s", "n"))
        done = np.flatnonzero(kind == _SETTLED)
        got = [(k1[done], k2[done], s[done], s[done] + n[done] - 1)]
        rest = np.flatnonzero(kind != _SETTLED)
        if len(rest):
            lists = pc.split_pattern(t.column("words").take(pa.array(rest)).combine_chunks(), " ")
            ids = np.asarray(lists.flatten().dictionary_encode().indices)
            size = n[rest].astype(np.int64)
            row = np.repeat(rest, size)
            within = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            at = s[row] + within
            # A run of n windows has n + length - 1 words.
            place = np.repeat(np.cumsum(size + length - 1) - (size + length - 1), size) + within
            node = suffix_ranks(ids, length)[place]
            leaves = np.bincount(node, weights=np.where(kind[row] == _WITNESS, 2, 1))
            hit = np.flatnonzero((leaves[node] >= 2) & (kind[row] == _OPEN))
            if len(hit):
                start = _runs(row[hit], at[hit])
                end = np.append(start[1:], len(hit)) - 1
                r = row[hit[start]]
                got.append((k1[r], k2[r], at[hit[start]], at[hit[end]]))
        cols = [np.concatenate(x) for x in zip(*got, strict=True)]
        if len(cols[0]):
            return pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1]), pa.array(cols[2].astype(np.int32)), pa.array(cols[3].astype(np.int32))], names)
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in small(batches, 4000):
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([held, t]).combine_chunks() if held is not None else t
            g = t.column("g").to_numpy()
            last = int(np.searchsorted(g, g[-1]))
            held = t.slice(last)
            if last and (out := solve(t.slice(0, last).combine_chunks())) is not None:
                yield out
        if held is not None and (out := solve(held.combine_chunks())) is not None:
            yield out

    return run


def repeated_windows(keyed: DataFrame, length: int = 35, group: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Of (_k1, _k2, text, id), one row a key: the rows dealt by key, and the runs (_k1, _k2, s, e) of repeated window starts."""
    texts = keyed.repartition(parts(keyed.sparkSession), "_k1", "_k2")
    anchors = keyed.select("_k1", "_k2", "text").mapInArrow(_anchors(length), "_k1 long, _k2 long, ph long, c int")
    often = anchors.groupBy("ph").agg(F.sum("c").alias("n")).where("n > 1")
    level = F.when(F.col("n") <= group, 0).otherwise(F.least(F.ceil(F.log2(F.col("n") / group)), F.lit(100))).cast("byte")
    known = anchors.join(often, "ph").groupBy("_k1", "_k2").agg(F.collect_set(F.struct("ph", level.alias("level"))).alias("p"))
    with_text = texts.join(known, ["_k1", "_k2"]).select("_k1", "_k2", "text", "p.ph", "p.level", "id")  # id: else the exchange differs from the other join's
    suffixes = with_text.mapInArrow(_suffixes(length), _SUFFIXES)
    runs = suffixes.repartition(parts(keyed.sparkSession), "g").sortWithinPartitions("g").mapInArrow(_subtrees(length), "_k1 long, _k2 long, s int, e int")
    return texts, runs


def _cut(length: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            total, removed, kept, spans = [], [], [], []
            for t, starts, ends in zip(b.column(1), b.column(2), b.column(3), strict=True):
                words = words_of(t.as_py())
                gone, got = np.zeros(len(words) + 1, np.int32), []
                if starts.is_valid and len(starts.values) and len(words) >= length:
                    last = np.asarray(ends.values)
                    np.add.at(gone, np.asarray(starts.values), 1)
                    np.subtract.at(gone, np.where(last < 0, len(words) - length, last) + length, 1)
                    mask = np.cumsum(gone[:-1]) > 0
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
                    got = edge.tolist()
                    left, at = [], 0
                    for i, j in zip(got[::2], got[1::2], strict=True):
                        left += words[at:i]
                        at = j
                    left += words[at:]
                else:
                    left = words
                line = b" ".join(left)
                total.append(len(words))
                removed.append(len(words) - len(left))
                kept.append(line.decode("utf-8", "surrogatepass") if with_text else hashlib.sha256(line).hexdigest())
                spans.append(got)
            cols = [b.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())]
            names = ["id", "n_words", "n_removed", "kept"]
            if with_text:
                cols, names = [*cols, pa.array(spans, pa.list_(pa.int32()))], [*names, "spans"]
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 35, group: int = 1000, with_text: bool = True) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_removed, and kept (the words left, joined by one space) with spans
    (word positions start, end, start, end, ... of the maximal repeats) or, without texts, the SHA-256 of kept.

    Null, empty and short texts have no window and stay. Rows with equal id and text are occurrences of their own, so
    each repeats the other. Null ids are kept as such. Other columns are not read. An empty table gives an empty result.
    """
    keyed = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).select("id", *row_key("id", "text"), "text").select("_k1", "_k2", "id", "text")
    # Equal rows: every window is repeated (an end of -1 is the last one). One of them stands for all.
    equal = store(keyed.groupBy("_k1", "_k2").agg(F.count("*").alias("n")).where("n > 1").select("_k1", "_k2"), "equal")
    single, twice = keyed, None
    if not equal.isEmpty():
        twice = keyed.join(equal, ["_k1", "_k2"])
        single = keyed.join(equal, ["_k1", "_k2"], "left_anti").union(twice.groupBy("_k1", "_k2").agg(F.first("id").alias("id"), F.first("text").alias("text")))
        single = store(single, "rows")
    texts, runs = repeated_windows(single, length, group)
    cover = runs.groupBy("_k1", "_k2").agg(F.collect_list(F.struct("s", "e")).alias("r"))
    joined = texts.join(cover, ["_k1", "_k2"], "left")
    if twice is not None:
        joined = joined.join(equal, ["_k1", "_k2"], "left_anti")
    joined = joined.select("id", "text", "r.s", "r.e")
    if twice is not None:
        joined = joined.union(twice.select("id", "text", F.array(F.lit(0)), F.array(F.lit(-1))))
    schema = "id long, n_words long, n_removed long, kept string" + (", spans array<int>" if with_text else "")
    return joined.mapInArrow(_cut(length, with_text), schema).withColumnRenamed("id", id_col)


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document, with windows of 35 words."""
    d = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False)
    return d.withColumnRenamed("kept", "kept_sha256")


QUERIES = {"op6_substring_dedup": op6_substring_dedup}
#: Every window written out and counted.
ORACLE_SQL = {
    "op6_substring_dedup": """
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS seq FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d)
), rep AS (SELECT seq FROM s GROUP BY seq HAVING count(*) > 1),
gone AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 35)))) AS g FROM s JOIN rep USING (seq) GROUP BY doc_id),
words AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
cut AS (SELECT doc_id, unnest(g) AS i, true AS hit FROM gone),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS line, count(*) AS n FROM words LEFT JOIN cut USING (doc_id, i) WHERE hit IS NULL GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(line, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
}
