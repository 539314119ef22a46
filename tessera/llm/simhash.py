"""SimHash near-duplicate detection: pigeonhole blocks, then Hamming verification.

A document's fingerprint has a bit for each of 64 positions, set if it is set in over half of the XXH64 values of the
document's 3-word shingles. Fingerprints within ``distance`` bits are linked; a component is what links reach.

Pigeonhole: the 64 bits are cut into ``distance + spare`` blocks. Two fingerprints that differ in at most ``distance``
bits agree on at least ``spare`` whole blocks, so they share one of the C(distance + spare, spare) keys made of
``spare`` blocks. With 6 blocks and keys of 3 blocks a key holds about 32 bits: random pairs that share a key stay rare
up to billions of distinct fingerprints, where keys of one 16-bit block would pair the corpus with itself.

Scale: equal fingerprints are collapsed first (map-side combined), so copies cost one row. Keys held by one fingerprint
are dropped by an aggregate. Keys with more than ``tile`` fingerprints are dealt out as tile pairs, so no task holds an
unbounded group, and each task keeps only a spanning forest of the links that it verifies. Links never reach the driver.

``keep_one`` has a rule of its own: two texts are near copies if the Jaccard similarity of their sets of 5-word shingles
is at least 0.8. The method is the same with a longer fingerprint. At 0.8 SimHash values differ in about 15 % of their
bits, so 64 bits have no block that such pairs must share; of the 112 blocks of 16 bits in 28 words they miss all with
probability 0.0002 (0.9: 1e-8). Sets that share a block are linked if 128 of their bits differ in at most ``radius``
(38: a pair at 0.8 exceeds it with probability 1e-6, two unrelated sets keep it with 3e-6); tasks keep spanning forests
of these links, star contraction gives their components, and an exact check follows: within a component the sets go to
the tasks in tiles of at most ``tile`` shingles (or one longer text), which count shared shingles through an inverted
list and keep a spanning forest of the pairs at 0.8. So pairs never become rows, and only fingerprints are stored for
every text; the sets of the texts that meet others are made from the texts again. Unrelated sets that share a block are
compared in the tasks, which grows with the square of the corpus, but is 1e11 bit counts for 1e7 distinct texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, store
from .components import components

SEED = 42
_LOW = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingle_hashes(text: str | None, size: int = 3) -> np.ndarray:
    """XXH64 values of a text's word shingles, repeats included; a shorter text is one shingle, an empty one none."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOW).split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - size + 1].tolist()
    stops = (ends[size - 1 :] - 1).tolist()
    return np.fromiter([digest(line[i:j], SEED) for i, j in zip(starts, stops, strict=True)], np.uint64, len(starts))


def fingerprint(text: str | None, size: int = 3) -> int:
    """The 64-bit SimHash of a text; 0 without words."""
    h = shingle_hashes(text, size)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        chunk = h[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(chunk, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * counts > len(h)).tolist()))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """(id, fp long) for each row; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            fp = np.array([fingerprint(t.as_py(), size) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["id", "fp"])

    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    return d.mapInArrow(run, "id long, fp long")


def _bounds(blocks: int) -> list[tuple[int, int]]:
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    return list(zip(edges, edges[1:], strict=False))


def _keys(distance: int, spare: int):
    """An array column of block keys of ``fp``: the masked bits, hashed with the number of the combination."""
    masks = []
    for combo in combinations(_bounds(distance + spare), spare):
        m = sum(((1 << (b - a)) - 1) << a for a, b in combo)
        masks.append(m - (1 << 64) if m >> 63 else m)
    return F.array(*[F.struct(F.lit(i).cast("short").alias("c"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key")) for i, m in enumerate(masks)])


class _Forest:
    """Union-find over the linked values of one task."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    def link(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def batches(self) -> Iterator[pa.RecordBatch]:
        nodes = list(self.parent)
        for k in range(0, len(nodes), 50_000):
            own = nodes[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([self.find(x) for x in own], pa.int64())], ["fp", "root"])


def _forest(rows: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """A spanning forest (fp, root) of the links among the rows of each (c, key, i, j); rows come sorted by group."""
    forest = _Forest()
    link = forest.link

    def solve(fp: np.ndarray, side: np.ndarray) -> None:
        if len(fp) < 2:
            return
        n, u = len(fp), fp.view(np.uint64)
        left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if side.any() else (np.arange(n), None)
        names = fp.tolist()
        # Each row needs a link to every other component only, but within a row only one per component matters.
        comp = np.arange(n)
        for k in left.tolist():
            to = right if right is not None else np.arange(k + 1, n)
            near = to[(np.bitwise_count(u[to] ^ u[k]) <= distance) & (comp[to] != comp[k])]
            while len(near):
                other = comp[near[0]]
                link(names[k], names[near[0]])
                comp[comp == other] = comp[k]
                near = near[comp[near] != comp[k]]

    held: list[np.ndarray] | None = None
    for b in rows:
        if not b.num_rows:
            continue
        cols = [np.asarray(b.column(i)) for i in range(6)]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
        new = np.zeros(len(cols[0]), bool)
        for x in cols[:4]:
            new[1:] |= x[1:] != x[:-1]
        at = [0, *np.flatnonzero(new).tolist()]
        for i, j in zip(at, at[1:], strict=False):
            solve(cols[4][i:j], cols[5][i:j])
        held = [x[at[-1] :] for x in cols]
    if held is not None:
        solve(held[4], held[5])
    yield from forest.batches()


def links(fps: DataFrame, distance: int = 3, spare: int = 3, tile: int = 4096) -> DataFrame:
    """(fp, root): edges that connect exactly the distinct fingerprints which links of up to ``distance`` bits connect."""
    keyed = fps.select("fp").distinct().select("fp", F.explode(_keys(distance, spare)).alias("k")).select("k.c", "k.key", "fp")
    sizes = keyed.groupBy("c", "key").agg(F.count("*").alias("n")).where("n > 1")
    t = keyed.join(sizes, ["c", "key"])
    tiles = F.ceil(F.col("n") / F.lit(tile)).cast("int")
    t = t.withColumn("tiles", tiles).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    # Own tile t meets each tile u >= t as side 0 and each u < t as side 1; (t, t) is compared within itself.
    t = t.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    t = t.select("c", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp", (F.col("own") > F.col("other")).cast("byte").alias("side"))
    by = ["c", "key", "i", "j"]
    return t.repartition(*by).sortWithinPartitions(*by, "fp").mapInArrow(lambda rows: _forest(rows, distance), "fp long, root long").where("fp <> root")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 3, size: int = 3) -> DataFrame:
    """(id, fp, component_id) for every row; component_id is the smallest id that links reach, its own included.

    Null and empty texts, and texts of white space, have fingerprint 0 and are linked like any other. Repeated rows stay
    repeated. A null id takes no part in the minimum; a component of null ids only has a null component_id. Other
    columns of ``docs`` are not read. An empty table gives an empty result.
    """
    fps = store(fingerprints(docs, id_col, text_col, size), "fp")
    return _labelled(fps, components(links(fps, distance), "fp", "root")).withColumnRenamed("id", id_col)


def _labelled(fps: DataFrame, rooted: DataFrame) -> DataFrame:
    """(id, fp, component_id) from (id, fp) and the (node, root) of the linked values of fp."""
    least = fps.groupBy("fp").agg(F.min("id").alias("least"))
    named = least.join(rooted.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    roots = named.groupBy("root").agg(F.min("least").alias("component_id"))
    label = named.join(roots, "root").select("fp", "component_id")
    return fps.join(label, "fp").select("id", "fp", "component_id")


def _sets(text: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    return [np.unique(shingle_hashes(t.as_py(), size)) for t in text]


def _set_names(sets: list[np.ndarray]) -> pa.Array:
    return pa.array(np.array([xxhash.xxh64_intdigest(h.tobytes(), SEED) for h in sets], np.uint64).view(np.int64))


def _longs(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([x.view(np.int64) for x in arrays], pa.list_(pa.int64()))


def wide_fingerprint(h: np.ndarray, words: int) -> np.ndarray:
    """SimHash of ``words`` x 64 bits of distinct shingle hashes; a tie takes the bit of the smallest hash.

    Bits of word k come from the hashes mixed with k (SplitMix64). Fair ties keep the bits of sets of few shingles even.
    """
    step = np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    counts, first = np.zeros(64 * words, np.int64), None
    for at in range(0, len(h), 255):
        x = h[at : at + 255, None] + step
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        bits = np.unpackbits(x.astype("<u8", copy=False).view(np.uint8), axis=1, bitorder="little")
        first = bits[0].copy() if first is None else first
        # At most 255 rows: their sums fit into a byte.
        counts += np.add.reduce(bits, axis=0, dtype=np.uint8)
    bits = (2 * counts > len(h)) | ((2 * counts == len(h)) & (first == 1))
    return np.packbits(bits, bitorder="little").view("<u8")


def signatures(docs: DataFrame, id_col: str, text_col: str, size: int, words: int) -> DataFrame:
    """(id, fp, n, sim) for each row: XXH64 and number of the distinct shingle hashes, and their wide fingerprint.

    A text without words has no shingle and a null sim; all of those share one fp. The bits of 4 and 5 shingles differ
    more often than those of larger sets of the same similarity, so up to 5 shingles have twice the words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, 200):
            sets = _sets(b.column(1), size)
            n = pa.array([len(h) for h in sets], pa.int64())
            sim = [wide_fingerprint(h, words * (2 if len(h) <= 5 else 1)).tobytes() if len(h) else None for h in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), _set_names(sets), n, pa.array(sim, pa.binary())], ["id", "fp", "n", "sim"])

    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    return d.mapInArrow(run, "id long, fp long, n long, sim binary")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, fp, a, b) for each 16-bit block of each (fp, sim): its place and bits, and the first two words of sim."""
    for whole in batches:
        for b in small([whole], 1000):
            fp, sims = np.asarray(b.column(0)), b.column(1).to_pylist()
            width = np.array([len(x) for x in sims])
            for w in np.unique(width).tolist():
                own = np.flatnonzero(width == w)
                sim = np.frombuffer(b"".join(sims[k] for k in own.tolist()), "<u8").reshape(len(own), -1)
                blocks = sim.view("<u2").astype(np.int64)
                key = blocks + (np.arange(blocks.shape[1], dtype=np.int64) << 16)
                cols = [key.ravel(), *[np.repeat(x, blocks.shape[1]) for x in (fp[own], sim[:, 0].view(np.int64), sim[:, 1].view(np.int64))]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["key", "fp", "a", "b"])


def _near_forest(rows: Iterator[pa.RecordBatch], radius: int, wide: int = 256) -> Iterator[pa.RecordBatch]:
    """A spanning forest (fp, root) of the rows of each key that differ in at most ``radius`` of 128 bits; sorted by key."""
    forest = _Forest()
    bits = np.bitwise_count

    def crowd(fp: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        comp = np.arange(len(fp))
        for k in range(len(fp)):
            near = bits(a ^ a[k]) + bits(b ^ b[k]) <= radius
            other = np.unique(comp[near])
            other = other[other != comp[k]]
            if len(other):
                # A component is named by the place of one of its rows.
                for x in fp[other].tolist():
                    forest.link(int(fp[comp[k]]), x)
                comp[np.isin(comp, other)] = comp[k]
                if (comp == comp[0]).all():
                    break

    def solve(key: np.ndarray, fp: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        """Whole groups. Those of up to ``wide`` rows are compared together: each row with the d-th after it."""
        a, b = a.view(np.uint64), b.view(np.uint64)
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(start, len(key)))
        for i, n in zip(start[size > wide].tolist(), size[size > wide].tolist(), strict=True):
            crowd(fp[i : i + n], a[i : i + n], b[i : i + n])
        left = np.repeat(np.where(size > wide, 0, size), size) - (np.arange(len(key)) - np.repeat(start, size))
        at, d = np.flatnonzero(left > 1), 1
        while len(at):
            near = at[bits(a[at] ^ a[at + d]) + bits(b[at] ^ b[at + d]) <= radius]
            for x, y in zip(fp[near].tolist(), fp[near + d].tolist(), strict=True):
                forest.link(x, y)
            d += 1
            at = at[left[at] > d]

    held: list[np.ndarray] | None = None
    for batch in rows:
        if not batch.num_rows:
            continue
        cols = [np.asarray(batch.column(i)) for i in range(4)]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
        # The last group may go on in the next batch.
        end = int(np.searchsorted(cols[0], cols[0][-1]))
        if end:
            solve(*[x[:end] for x in cols])
        held = [x[end:] for x in cols]
    if held is not None:
        solve(*held)
    yield from forest.batches()


def _merged(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest (fp, root) of the edges (fp, root) of one task."""
    forest = _Forest()
    for b in rows:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            forest.link(x, y)
    yield from forest.batches()


def near_fingerprints(signed: DataFrame, similarity: float, radius: int = 38) -> DataFrame:
    """(fp, root): edges that connect the sets (fp, n, sim) which share a block and differ in up to ``radius`` of 128 bits.

    A set that is too small to be similar to any but itself has no blocks.
    """
    own = signed.where(F.col("n") >= similarity * (F.col("n") + 1) - 1e-9).select("fp", "sim").distinct()
    keyed = own.where("sim is not null").mapInArrow(_blocks, "key long, fp long, a long, b long")
    edges = keyed.repartition("key").sortWithinPartitions("key").mapInArrow(lambda rows: _near_forest(rows, radius), "fp long, root long").where("fp <> root")
    # Each task roots a large group anew: dealt by fp, the roots of a row meet, and about one edge a row is left.
    return edges.repartition("fp").mapInArrow(_merged, "fp long, root long").where("fp <> root").distinct()


def shingle_sets(docs: DataFrame, text_col: str, size: int) -> DataFrame:
    """(fp, shingles) for each row: the sorted distinct shingle hashes and their XXH64."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, 200):
            sets = _sets(b.column(0), size)
            yield pa.RecordBatch.from_arrays([_set_names(sets), _longs(sets)], ["fp", "shingles"])

    return docs.select(F.col(text_col).cast("string").alias("t")).mapInArrow(run, "fp long, shingles array<long>")


def _set_forest(rows: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """A spanning forest (fp, root) of the similar sets of each (key, i, j); rows come sorted by group."""
    forest = _Forest()

    def solve(g: pa.RecordBatch) -> None:
        names, side, sets = g.column(3).to_pylist(), np.asarray(g.column(4)), g.column(5)
        size = np.asarray(sets.value_lengths()).astype(np.int64)
        n, ends = len(names), np.cumsum(size)
        # The inverted list: the rows that hold each shingle, at held[first[s] : first[s] + count[s]].
        _, place, count = np.unique(np.asarray(sets.flatten()), return_inverse=True, return_counts=True)
        held = np.repeat(np.arange(n), size)[np.argsort(place, kind="stable")]
        first = np.cumsum(count) - count
        cross = bool(side.any())
        comp = np.arange(n)
        for k in np.flatnonzero(side == 0).tolist() if cross else range(n):
            own = place[ends[k] - size[k] : ends[k]]
            width = count[own]
            at = np.repeat(first[own] - (np.cumsum(width) - width), width) + np.arange(width.sum())
            shared = np.bincount(held[at], minlength=n)
            near = (shared >= similarity * (size + size[k] - shared) - 1e-9) & (comp != comp[k])
            near = np.flatnonzero(near & (side == 1) if cross else near)
            while len(near):
                other = comp[near[0]]
                forest.link(names[k], names[near[0]])
                comp[comp == other] = comp[k]
                near = near[comp[near] != comp[k]]
            if (comp == comp[0]).all():
                break

    held: pa.RecordBatch | None = None
    for b in rows:
        if not b.num_rows:
            continue
        b = b if held is None else pa.concat_batches([held, b])
        new = np.zeros(b.num_rows, bool)
        for i in range(3):
            x = np.asarray(b.column(i))
            new[1:] |= x[1:] != x[:-1]
        at = [0, *np.flatnonzero(new).tolist()]
        for i, j in zip(at, at[1:], strict=False):
            solve(b.slice(i, j - i))
        held = b.slice(at[-1])
    if held is not None:
        solve(held)
    yield from forest.batches()


def similar_sets(signed: DataFrame, similarity: float, tile: int = 1 << 19, sets_of: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(fp, root): edges that connect the sets (fp, n, keys) which share a key and are similar.

    ``sets_of`` gives (fp, shingles) of at least the fp asked for; without it ``signed`` has the column shingles.
    """
    keyed = signed.select("fp", "n", "keys").distinct().select("fp", "n", F.explode("keys").alias("key"))
    keyed = store(keyed, "bands")
    bands = keyed.groupBy("key").agg(F.count("*").alias("members"), F.sum("n").alias("total"), F.bit_xor(F.xxhash64("fp")).alias("mark")).where("members > 1")
    # Of keys with the same texts, one is enough.
    bands = bands.groupBy("members", "total", "mark").agg(F.min("key").alias("key"))
    t = keyed.join(bands.select("key", F.ceil(F.col("total") / F.lit(tile)).cast("int").alias("tiles")), "key")
    t = t.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    t = store(t.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp", (F.col("own") > F.col("other")).cast("byte").alias("side")), "tiles")
    own = sets_of(store(t.select("fp").distinct(), "meeting")) if sets_of else signed.select("fp", "shingles")
    own = own.groupBy("fp").agg(F.any_value("shingles").alias("shingles"))
    by = ["key", "i", "j"]
    t = t.join(own, "fp").select(*by, "fp", "side", "shingles")
    return t.repartition(*by).sortWithinPartitions(*by, "fp").mapInArrow(lambda rows: _set_forest(rows, similarity), "fp long, root long").where("fp <> root")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, size: int = 5, words: int = 28, radius: int = 38) -> DataFrame:
    """(id, fp, component_id) for every row; rows whose shingle sets have Jaccard ``similarity`` or more are linked.

    Texts with equal shingle sets share fp, texts without words too; nulls and repeated rows as in ``near_duplicates``.
    ``words`` and ``radius`` fit a ``similarity`` of 0.8 or more.
    """
    signed = store(signatures(docs, id_col, text_col, size, words), "signatures")

    def sets_of(wanted: DataFrame) -> DataFrame:
        """Sets of the texts whose id is the least of a wanted set; a repeated or null id may bring others along."""
        ids = store(signed.join(wanted, "fp").groupBy("fp").agg(F.min("id").alias("_id")).select("_id").distinct(), "ids")
        texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
        return shingle_sets(texts.join(ids, F.col("id").eqNullSafe(F.col("_id")), "left_semi"), "t", size)

    near = components(near_fingerprints(signed, similarity, radius), "fp", "root")
    # The exact check: a component of fingerprints is a group of candidates.
    meeting = signed.select("fp", "n").distinct().join(near.select(F.col("node").alias("fp"), F.array("root").alias("keys")), "fp")
    rooted = components(similar_sets(meeting, similarity, sets_of=sets_of), "fp", "root")
    return _labelled(signed.select("id", "fp"), rooted).withColumnRenamed("id", id_col)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, size: int = 5) -> DataFrame:
    """The rows of ``docs`` less near copies: of each component of ``near_copies`` the row with the smallest id stays.

    Rows with a null id stay only if their component has no other; of repeated rows with one id, all stay or none.
    """
    d = near_copies(docs, id_col, text_col, similarity, size)
    stays = F.bool_or(F.col(id_col).eqNullSafe(F.col("component_id")))
    # Stored, so that Spark knows the size: a few ids are broadcast and the texts stay; many are joined by shuffle.
    gone = store(d.groupBy(F.col(id_col).alias("_id")).agg(stays.alias("stays")).where("not stays").select("_id"), "gone")
    return docs.join(gone, docs[id_col].eqNullSafe(gone["_id"]), "left_anti")


def op1_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document."""
    d = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return d.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op1_simhash_near_dedup": op1_simhash_near_dedup}
ORACLE_SQL: dict[str, str] = {}
