"""Packing token sequences into fixed windows by non-negative least squares over a length histogram.

A document's ids (the text's, then one end-of-text id) are cut into whole windows and a remainder of under one window.
Remainders are packed in four steps:

1. Histogram. Counts of the remainder lengths, at most ``window`` rows whatever the corpus size, reach the driver.
2. Strategies. Shallow combinations of two or three lengths that fill a window exactly; the number is fixed by ``window``.
3. Repeat counts. Coordinate descent solves min ||A x - h|| with x >= 0 (A: how often a strategy uses a length), x is
   rounded down and cut back where a length would run out. So most remainders stay whole in a full window.
4. Residuals. What is left is cut at its binary digits; pieces of 2^k are packed greedily, 2048 / 2^k to a window. The
   last few of a size form sequences whose length is a power of two, which need no padding.

Texts are tokenised once. That pass writes a small table (lengths, checksums of every piece that may be needed, the
rank of each remainder within its file part); all later steps work on it. Ranks over the corpus are the rank in the part
plus the count in earlier parts, so a length that a third of all documents have is not gathered in a task.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import small, store

EOT = 1


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


_ENCODERS: dict = {}
#: tiktoken's pattern engine recurses over white space, so texts with longer runs of it go to the tokenizers library.
_LONG_SPACE = re.compile(r"\s{1000}").search


def encoder(path: str):
    """text -> the ids that the tokenizers library gives for the file, without added special tokens.

    A byte-level BPE file is run by tiktoken if its ranks lie beside it: the ids are the same (a test compares them) at a
    fourth of the time. Texts that hold the literal of one of the file's added tokens, which the library maps to that
    token's id, and texts with long runs of white space are encoded by the library itself.
    """
    if path not in _ENCODERS:
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        plain = lambda text: whole.encode(text, add_special_tokens=False).ids
        ranks = path.removesuffix(".json") + ".tiktoken"
        if os.path.exists(ranks):
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            fast = tiktoken.Encoding(ranks, pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary
            added = [t.content for t in whole.get_added_tokens_decoder().values()]
            _ENCODERS[path] = lambda text: plain(text) if any(x in text for x in added) or _LONG_SPACE(text) else fast(text)
        else:
            _ENCODERS[path] = plain
    return _ENCODERS[path]


_SCAN = "doc_id long, part int, n long, full_before long, full_crc array<long>, rem int, rem_rank long, rem_crc long, cut_crc array<long>"


def _scan(window: int, tokenizer: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(tokenizer), TaskContext.get().partitionId()
        full, ranks = 0, np.zeros(window, np.int64)
        for b in small(batches):
            rows: list[list] = [[] for _ in range(7 + with_ids)]
            for t in b.column(1):
                ids = np.array([*encode((t.as_py() or "")), EOT], "<u4")
                raw, n = ids.tobytes(), len(ids)
                whole, rem = divmod(n, window)
                at, cuts = 4 * window * whole, []
                for k in range(window.bit_length() - 1, -1, -1):
                    if rem >> k & 1:
                        cuts.append(zlib.crc32(raw[at : at + (4 << k)]))
                        at += 4 << k
                new = [n, full, [zlib.crc32(raw[4 * window * i : 4 * window * (i + 1)]) for i in range(whole)], rem, int(ranks[rem]), zlib.crc32(raw[4 * window * whole :]), cuts]
                for x, y in zip(rows, [*new, ids] if with_ids else new, strict=True):
                    x.append(y)
                full += whole
                ranks[rem] += 1
            longs = pa.list_(pa.int64())
            types = [pa.int64(), pa.int64(), longs, pa.int32(), pa.int64(), pa.int64(), longs, pa.list_(pa.int64())]
            cols = [pa.array(x, y) for x, y in zip(rows, types, strict=False)]
            names = ["doc_id", "part", "n", "full_before", "full_crc", "rem", "rem_rank", "rem_crc", "cut_crc", "ids"]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(b.num_rows, part, np.int32)), *cols], names[: 9 + with_ids])

    return run


def strategies(window: int, grid: int = 32) -> np.ndarray:
    """(s, 3) combinations of lengths with sum ``window``, zero for no third: all pairs, all (a, a, b), and (a, b, c) with
    a and b multiples of window / grid. Their number depends on ``window`` and ``grid`` only."""
    found = {(a, window - a, 0) for a in range(1, window // 2 + 1)}
    found |= {tuple(sorted((a, a, window - 2 * a))) for a in range(1, (window - 1) // 2 + 1)}
    step = max(1, window // grid)
    for a in range(step, window, step):
        for b in range(a, window - a, step):
            if (c := window - a - b) >= 1:
                found.add(tuple(sorted((a, b, c))))
    return np.array(sorted(found), np.int64)


def repeat_counts(hist: np.ndarray, window: int, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Strategies and how often to use each: the rounded non-negative least-squares fit, never using more than hist."""
    s = strategies(window)
    if window < 2 or not len(s):
        return np.zeros((0, 3), np.int64), np.zeros(0, np.int64)
    s = s[np.all((s == 0) | (hist[s] > 0), axis=1)]
    uses = [[(int(x), int((row == x).sum())) for x in np.unique(row[row > 0])] for row in s]
    left, x = hist.astype(float).tolist(), [0.0] * len(s)
    norm = [sum(c * c for _, c in u) for u in uses]
    for _ in range(sweeps):
        moved = 0.0
        for k, u in enumerate(uses):
            new = max(0.0, x[k] + sum(c * left[b] for b, c in u) / norm[k])
            if d := new - x[k]:
                x[k] = new
                moved = max(moved, abs(d))
                for b, c in u:
                    left[b] -= c * d
        if moved < 0.01:
            break
    free, out = hist.astype(np.int64).tolist(), np.zeros(len(s), np.int64)
    for k in sorted(range(len(s)), key=lambda k: (-x[k], k)):
        out[k] = n = max(0, min([int(x[k]), *(free[b] // c for b, c in uses[k])]))
        for b, c in uses[k]:
            free[b] -= c * n
    # What rounding left over: any strategy that still fits, in the same order.
    for k in sorted(range(len(s)), key=lambda k: (-x[k], k)):
        n = min(free[b] // c for b, c in uses[k])
        out[k] += n
        for b, c in uses[k]:
            free[b] -= c * n
    return s[out > 0], out[out > 0]


class Plan:
    """Where each remainder goes, by its length and rank; of a size fixed by ``window``."""

    def __init__(self, hist: np.ndarray, window: int, first_sequence: int):
        self.window, self.bits = window, window.bit_length() - 1
        combos, counts = repeat_counts(hist, window)
        self.ranges: dict[int, list[list[int]]] = {}  # length: [first rank, per sequence, first sequence, first offset]
        used, seq = np.zeros(window, np.int64), first_sequence
        for row, n in zip(combos.tolist(), counts.tolist(), strict=True):
            offset = 0
            for length in sorted({x for x in row if x}, reverse=True):
                c = row.count(length)
                self.ranges.setdefault(length, []).append([int(used[length]), c, seq, offset])
                used[length] += c * n
                offset += c * length
            seq += n
        self.starts = {k: np.array([x[0] for x in v]) for k, v in self.ranges.items()}
        self.used = used
        # Residuals: piece q of size 2^k over all lengths; base[k][length] pieces come before those of this length.
        rest = hist - used
        has = np.array([[length >> k & 1 for length in range(window)] for k in range(self.bits)])
        per = has * rest
        self.base = np.cumsum(per, axis=1) - per
        self.total = per.sum(axis=1)
        self.first = np.zeros(self.bits, np.int64)
        for k in range(self.bits):
            self.first[k] = seq
            each = 1 << (self.bits - k)
            seq += self.total[k] // each + int(self.total[k] % each).bit_count()
        self.sequences = seq

    def place(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """(start in the remainder, length, sequence, offset) of each piece."""
        if rank < self.used[length]:
            lo, c, seq, offset = self.ranges[length][int(np.searchsorted(self.starts[length], rank, "right")) - 1]
            q, r = divmod(rank - lo, c)
            return [(0, length, seq + q, offset + r * length)]
        out, at = [], 0
        for k in range(self.bits - 1, -1, -1):
            if length >> k & 1:
                each, q = 1 << (self.bits - k), int(self.base[k][length]) + rank - int(self.used[length])
                seq, place = divmod(q, each)
                whole = int(self.total[k]) // each
                if seq == whole:  # the last ones: sequences of a power of two each, the largest first
                    tail = int(self.total[k]) % each
                    for bit in range(tail.bit_length() - 1, -1, -1):
                        if tail >> bit & 1:
                            if place < 1 << bit:
                                break
                            place -= 1 << bit
                            seq += 1
                out.append((at, 1 << k, int(self.first[k]) + seq, place << k))
                at += 1 << k
        return out


def _assign(plan: Plan, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"][: 7 + with_ids]
        for b in small(batches):
            n, rems, ranks, first = (b.column(k).to_pylist() for k in ("n", "rem", "rank", "full_first"))
            source, rows, ids = [], [], []
            for k in range(b.num_rows):
                full = b.column("full_crc")[k].as_py()
                pieces = [(plan.window * i, plan.window, crc, n[k], first[k] + i, 0) for i, crc in enumerate(full)]
                if rem := rems[k]:
                    cuts, at = plan.place(rem, ranks[k]), plan.window * len(full)
                    crcs = [b.column("rem_crc")[k].as_py()] if len(cuts) == 1 else b.column("cut_crc")[k].as_py()
                    pieces += [(at + s, m, crc, n[k], seq, o) for (s, m, seq, o), crc in zip(cuts, crcs, strict=True)]
                source += [k] * len(pieces)
                rows += pieces
                if with_ids:
                    ids += [b.column("ids")[k].values.slice(s, m) for s, m, *_ in pieces]
            cols = [pa.array(x, pa.int64()) for x in (zip(*rows, strict=True) if rows else [()] * 6)]
            cols = [b.column("doc_id").take(pa.array(source, pa.int64())), *cols]
            if with_ids:
                cols.append(pa.array([x.to_pylist() for x in ids], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 2048, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and the piece's ids).

    ``window`` is a power of two. Every row of ``docs`` is a document of its own, repeated rows and null ids included; a
    null or empty text has the end-of-text id only. An empty table gives an empty result. Other columns are not read.
    Sequences are full windows, or of a length that is a power of two; none needs padding.
    """
    if window < 2 or window & (window - 1):
        raise ValueError("window must be a power of two")
    path = tokenizer or default_tokenizer()
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    scan = store(d.mapInArrow(_scan(window, path, with_ids), _SCAN + ", ids array<long>" * with_ids), "scan")
    hist = np.zeros(window, np.int64)
    for r in scan.where("rem > 0").groupBy("rem").count().collect():  # at most window - 1 rows
        hist[r[0]] = r[1]
    by_part = scan.groupBy("part").agg(F.sum(F.size("full_crc")).alias("full"))
    full = by_part.select("part", (F.coalesce(F.sum("full").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).alias("full_base"))
    counts = scan.groupBy("part", "rem").agg(F.count("*").alias("c"))
    base = counts.select("part", "rem", F.coalesce(F.sum("c").over(W.partitionBy("rem").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("rank_base"))
    plan = Plan(hist, window, int(by_part.agg(F.sum("full")).first()[0] or 0))
    ranked = scan.join(base, ["part", "rem"]).join(full, "part")
    ranked = ranked.withColumn("rank", F.col("rem_rank") + F.col("rank_base")).withColumn("full_first", F.col("full_before") + F.col("full_base"))
    ranked = ranked.select("doc_id", "n", "rem", "rank", "full_first", "full_crc", "rem_crc", "cut_crc", *["ids"] * with_ids)
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<long>" * with_ids
    return ranked.mapInArrow(_assign(plan, with_ids), schema).withColumnRenamed("doc_id", id_col)


def op3_nnls_packing(spark, sf_dir: str) -> DataFrame:
    """Every piece of every document, packed into sequences of at most 2048 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op3_nnls_packing": op3_nnls_packing}
ORACLE_SQL: dict[str, str] = {}
