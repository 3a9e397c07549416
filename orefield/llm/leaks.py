"""Evaluation texts leaking into training text.

1. Windows.  Of every item, windows of several sizes are taken: the size of the smallest passage that
   counts (``RUN`` words, at every word) and, overlapping by half, the sizes of ``SIZES`` up to that of
   the item itself, so that whole items and large parts of them are compared as such.  Documents slide
   windows of the same sizes word by word.
2. Fingerprints.  Each window has a SimHash of 64 bits over its words, each word with a weight of its
   own, so windows that differ a little have near fingerprints.
3. Candidates.  Fingerprints within ``RADIUS`` bits are found by multi-index Hamming blocks: cut into
   ``RADIUS`` + 1 blocks, two such fingerprints agree in one block at least, so equality on blocks loses
   none.
4. Verification.  Candidates stand if the weighted similarity of their five-word shingles, taken
   exactly, is at least ``SIMILARITY``.
5. For ``found``, what stands must also hold ``RUN`` consecutive words of the item.  A passage of that
   length is a window of the smallest size with equal fingerprint and similarity 1, so none is lost.

The item windows are broadcast while they are few (``BROADCAST_WINDOWS``, checked); then documents are
read once and nothing is shuffled but the hits.  Beyond that, fingerprints of both sides (not their
words) are shuffled and joined on their blocks, and words are fetched for the candidates alone.

Defined cases: null, empty and short texts (less than ``run`` words) hold nothing and are held by
nothing; equal items are each reported; repeated rows and passages give one row per document and item;
texts are read whole; empty tables give no rows; null ids are reported as null; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RUN = 12
SIZES = (24, 48)
RADIUS = 2
SHINGLE = 5
SIMILARITY = 0.8
BROADCAST_WINDOWS = 200_000
_STEP = 1 << 16


def words(text: Column) -> Column:
    """Maximal runs of ASCII letters and digits, in lower case."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Za-z0-9]+"), F.lit(0)), F.lower)


def hashed_words(text: Column) -> Column:
    """Hash of every word; both sides of a comparison are built by this."""
    return F.transform(words(text), lambda w: F.xxhash64(w))


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return pc.list_flatten(lists).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)


def _weights(hashes: np.ndarray) -> np.ndarray:
    """Weight 1 to 4 of a word, from its hash alone: the same word weighs the same everywhere."""
    return ((hashes >> np.uint64(7)) % np.uint64(4)).astype(np.int16) + 1


def _starts(n_words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and first word (in the flat array) of every window of ``size`` words that lies within a row."""
    n = np.maximum(n_words - size + 1, 0)
    row = np.repeat(np.arange(len(n_words)), n)
    first = np.repeat(np.cumsum(n_words) - n_words, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    return row, first


def item_windows(n_words: np.ndarray, size: int, run: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of items: at every word for the smallest size, else half overlapping, the last one flush with the end."""
    row, first = _starts(n_words, size)
    if size > run:
        place = first - (np.cumsum(n_words) - n_words)[row]
        keep = (place % (size // 2) == 0) | (place == n_words[row] - size)
        row, first = row[keep], first[keep]
    return row, first


def _fingerprints(hashes: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    """SimHash of the windows that begin at every word, for each size, in blocks of bounded memory; those over the end are left out."""
    out = [np.empty(max(len(hashes) - size + 1, 0), np.uint64) for size in sizes]
    if not len(hashes):
        return out
    weights, most = _weights(hashes), max(sizes)
    for a in range(0, len(hashes), _STEP):
        high = min(a + _STEP + most - 1, len(hashes))
        bits = np.unpackbits(hashes[a:high].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(np.int8)
        sums = np.zeros((high - a + 1, 64), np.int32)
        np.cumsum((bits * 2 - 1) * weights[a:high, None].astype(np.int8), axis=0, dtype=np.int32, out=sums[1:])
        for size, prints in zip(sizes, out, strict=True):
            n = min(_STEP, len(prints) - a)
            if n > 0:
                ones = sums[size : size + n] > sums[:n]
                prints[a : a + n] = np.packbits(ones, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def block_shifts(radius: int) -> list[tuple[int, int]]:
    """(shift, bits) of ``radius`` + 1 blocks that cover 64 bits."""
    edges = np.linspace(0, 64, radius + 2).astype(int)
    return [(int(a), int(b - a)) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def shingle_similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Weighted share of five-word shingles that two windows (rows of word hashes) hold at the same or another place."""
    n = a.shape[1] - SHINGLE + 1
    mix = np.uint64(0x9E3779B97F4A7C15)

    def shingles(x: np.ndarray) -> np.ndarray:
        s = np.zeros((len(x), n), np.uint64)
        for k in range(SHINGLE):
            s = s * mix + x[:, k : k + n]
        return s

    out = np.empty(len(a))
    for low in range(0, len(a), 4096):
        x, y = a[low : low + 4096], b[low : low + 4096]
        sa, sb, wa, wb = shingles(x), shingles(y), _weights(x)[:, :n].astype(float), _weights(y)[:, :n].astype(float)
        in_b = (sa[:, :, None] == sb[:, None, :]).any(2)
        in_a = (sb[:, :, None] == sa[:, None, :]).any(2)
        both = (wa * in_b).sum(1)
        out[low : low + 4096] = both / np.maximum(both + (wa * ~in_b).sum(1) + (wb * ~in_a).sum(1), 1e-9)
    return out


class _Index:
    """Windows of the items, by block."""

    def __init__(self, fingerprints: np.ndarray, radius: int):
        self.fingerprints, self.blocks = fingerprints, []
        for shift, bits in block_shifts(radius):
            key = (fingerprints >> np.uint64(shift)) & np.uint64((1 << bits) - 1)
            order = np.argsort(key, kind="stable")
            maybe = np.zeros(1 << 16, bool)
            maybe[(key & np.uint64(0xFFFF)).astype(np.int64)] = True
            self.blocks.append((shift, bits, key[order], order, maybe))

    def near(self, x: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (window, item window) within ``radius`` bits; a pair may come more than once."""
        a, b = [], []
        for shift, bits, keys, order, maybe in self.blocks:
            mine = (x >> np.uint64(shift)) & np.uint64((1 << bits) - 1)
            hit = np.flatnonzero(maybe[(mine & np.uint64(0xFFFF)).astype(np.int64)])
            low, high = np.searchsorted(keys, mine[hit], "left"), np.searchsorted(keys, mine[hit], "right")
            n = high - low
            left, right = np.repeat(hit, n), order[np.repeat(low, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))]
            near = np.bitwise_count(x[left] ^ self.fingerprints[right]) <= radius
            a.append(left[near])
            b.append(right[near])
        return np.concatenate(a), np.concatenate(b)


def _held(doc: np.ndarray, item: np.ndarray, run: int) -> bool:
    """Do two sequences of word hashes share ``run`` consecutive words?"""
    if min(len(doc), len(item)) < run:
        return False
    x, y = (np.lib.stride_tricks.sliding_window_view(w, run) for w in (doc, item))
    mix = np.uint64(0x9E3779B97F4A7C15)
    hx, hy = np.zeros(len(x), np.uint64), np.zeros(len(y), np.uint64)
    for k in range(run):
        hx, hy = hx * mix + x[:, k], hy * mix + y[:, k]
    _, i, j = np.intersect1d(hx, hy, return_indices=True)
    return bool(len(i)) and bool((x[i] == y[j]).all(1).any())


HITS = "size int, candidates bigint, similar bigint, held boolean"


def _judged(pairs: np.ndarray, doc_of: callable, item_of: callable, run: int) -> np.ndarray:
    """Rows (doc, item, size, candidates, similar, held) of candidates (doc, item, size, doc_at, item_at), all numbers."""
    pairs = np.unique(pairs, axis=0)
    similar, equal = np.zeros(len(pairs), bool), np.zeros(len(pairs), bool)
    for size in np.unique(pairs[:, 2]):
        of = np.flatnonzero(pairs[:, 2] == size)
        a = np.stack([doc_of(p[0])[p[3] : p[3] + size] for p in pairs[of]])
        b = np.stack([item_of(p[1])[p[4] : p[4] + size] for p in pairs[of]])
        similar[of] = shingle_similarity(a, b) >= SIMILARITY
        equal[of] = (a == b).all(1)
    keys, group = np.unique(pairs[:, :3], axis=0, return_inverse=True)
    group = group.ravel()
    candidates, n_similar = np.bincount(group, minlength=len(keys)), np.bincount(group, similar, len(keys)).astype(np.int64)
    held = np.bincount(group, similar & equal, len(keys)) > 0
    for k in np.flatnonzero(~held & (n_similar > 0)):  # near windows alone: look for a passage anywhere in the two
        held[k] = _held(doc_of(keys[k, 0]), item_of(keys[k, 1]), run)
    return np.column_stack([keys, candidates, n_similar, held])


def hits(documents: DataFrame, items: DataFrame, *, run: int = RUN, sizes: tuple[int, ...] = SIZES, radius: int = RADIUS, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """(doc_id, item_id, size, candidates, similar, held): per size of window, how many pairs of windows were candidates, how many of them similar, and whether a passage is held."""
    doc_words = documents.select("doc_id", hashed_words(F.col("text")).alias("w")).where(F.size("w") >= run)
    item_words = items.select("item_id", hashed_words(F.col("text")).alias("w")).where(F.size("w") >= run)
    n_windows = item_words.agg(F.coalesce(F.sum(F.size("w") - run + 1), F.lit(0))).first()[0]
    by = _by_broadcast if n_windows <= broadcast_windows else _by_shuffle
    return by(doc_words, item_words, run, [run, *[s for s in sizes if s > run]], radius)


def leaks(documents: DataFrame, items: DataFrame, *, exact: bool = True, **options) -> DataFrame:
    """(doc_id, item_id, n_windows): documents that hold a passage of an item (or, unless ``exact``, windows similar to its), with the number of similar windows."""
    found = hits(documents, items, **options)
    return found.groupBy("doc_id", "item_id").agg(F.sum("similar").alias("n_windows"), F.bool_or("held").alias("held")).where("held" if exact else "n_windows > 0").drop("held")


def stages(documents: DataFrame, items: DataFrame, **options) -> DataFrame:
    """(size, candidates, similar, pairs_similar, pairs_held): what each stage leaves, per size of window."""
    found = hits(documents, items, **options).groupBy("doc_id", "item_id", "size").agg(F.sum("candidates").alias("candidates"), F.sum("similar").alias("similar"), F.bool_or("held").alias("held"))
    return found.groupBy(F.col("size").cast("bigint").alias("size")).agg(F.sum("candidates").alias("candidates"), F.sum("similar").alias("similar"), F.count_if(F.col("similar") > 0).alias("pairs_similar"), F.count_if("held").alias("pairs_held"))


def _by_broadcast(doc_words: DataFrame, item_words: DataFrame, run: int, sizes: list[int], radius: int) -> DataFrame:
    held = item_words.toArrow()
    shared = doc_words.sparkSession.sparkContext.broadcast((held.column("item_id").combine_chunks(), *_flat(held.column("w").combine_chunks())))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, item_flat, item_n = shared.value
        item_end = np.cumsum(item_n)
        item_of = lambda k: item_flat[item_end[k] - item_n[k] : item_end[k]]
        index = []
        for size, prints in zip(sizes, _fingerprints(item_flat, sizes), strict=True):
            row, first = item_windows(item_n, size, run)
            if len(first):
                index.append((size, row, first - (item_end - item_n)[row], _Index(prints[first], radius)))
        if not index:
            return
        for batch in batches:
            flat, n = _flat(batch.column("w"))
            end = np.cumsum(n)
            pairs = []
            for (size, item_row, item_at, of), prints in zip(index, _fingerprints(flat, [i[0] for i in index]), strict=True):
                row, first = _starts(n, size)
                left, right = of.near(prints[first], radius) if len(first) else (np.empty(0, int), np.empty(0, int))
                pairs.append(np.column_stack([row[left], item_row[right], np.full(len(left), size), first[left] - (end - n)[row[left]], item_at[right]]))
            pairs = np.concatenate(pairs)
            if len(pairs):
                out = _judged(pairs, lambda k, flat=flat, end=end, n=n: flat[end[k] - n[k] : end[k]], item_of, run)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(out[:, 0])), ids.take(pa.array(out[:, 1])), pa.array(out[:, 2], pa.int32()), pa.array(out[:, 3], pa.int64()), pa.array(out[:, 4], pa.int64()), pa.array(out[:, 5].astype(bool))],
                    names=["doc_id", "item_id", "size", "candidates", "similar", "held"],
                )

    return doc_words.mapInArrow(search, f"doc_id {dict(doc_words.dtypes)['doc_id']}, item_id {dict(item_words.dtypes)['item_id']}, {HITS}")


def _by_shuffle(doc_words: DataFrame, item_words: DataFrame, run: int, sizes: list[int], radius: int) -> DataFrame:
    """Rows are named by a hash of their words, so that equal texts send their fingerprints once; ids come back at the end."""

    def prints_of(rows: DataFrame, name: str, of_items: bool) -> DataFrame:
        def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                flat, n = _flat(batch.column("w"))
                for size, prints in zip(sizes, _fingerprints(flat, sizes), strict=True):
                    row, first = item_windows(n, size, run) if of_items else _starts(n, size)
                    if len(first):
                        at = first - (np.cumsum(n) - n)[row]
                        yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(row)), pa.array(np.full(len(row), size), pa.int32()), pa.array(at, pa.int32()), pa.array(prints[first].view(np.int64))], names=[name, "size", f"{name}_at", f"{name}_print"])

        made = rows.mapInArrow(make, f"{name} bigint, size int, {name}_at int, {name}_print bigint")
        blocks = F.array(*[F.struct(F.lit(k).alias("nth"), F.shiftrightunsigned(f"{name}_print", shift).bitwiseAND(F.lit((1 << bits) - 1)).alias("value")) for k, (shift, bits) in enumerate(block_shifts(radius))])
        return made.withColumn("block", F.explode(blocks))

    keyed = [rows.withColumn("key", F.xxhash64("w")) for rows in (doc_words, item_words)]
    once = [rows.groupBy("key").agg(F.first("w").alias("w")) for rows in keyed]
    docs, its = once
    near = prints_of(docs, "doc", False).join(prints_of(its, "item", True), ["size", "block"]).where(F.bit_count(F.col("doc_print").bitwiseXOR(F.col("item_print"))) <= radius)
    # All candidates of a document and an item go together; their number is bounded by the windows of the document.
    candidates = near.groupBy("doc", "item").agg(F.collect_set(F.struct("size", "doc_at", "item_at")).alias("at"))
    fetched = candidates.join(docs.select(F.col("key").alias("doc"), F.col("w").alias("doc_w")), "doc").join(its.select(F.col("key").alias("item"), F.col("w").alias("item_w")), "item")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = _flat(batch.column("doc_w")), _flat(batch.column("item_w"))
            ex, ey = np.cumsum(x[1]), np.cumsum(y[1])
            at, n = pc.list_flatten(batch.column("at")), pc.list_value_length(batch.column("at")).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(n)), n)
            if len(row):
                out = _judged(np.column_stack([row, row, *[at.field(c).to_numpy(zero_copy_only=False) for c in ("size", "doc_at", "item_at")]]), lambda k, x=x, ex=ex: x[0][ex[k] - x[1][k] : ex[k]], lambda k, y=y, ey=ey: y[0][ey[k] - y[1][k] : ey[k]], run)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc").take(pa.array(out[:, 0])), batch.column("item").take(pa.array(out[:, 1])), pa.array(out[:, 2], pa.int32()), pa.array(out[:, 3], pa.int64()), pa.array(out[:, 4], pa.int64()), pa.array(out[:, 5].astype(bool))],
                    names=["doc", "item", "size", "candidates", "similar", "held"],
                )

    checked = fetched.select("doc", "item", "at", "doc_w", "item_w").mapInArrow(verify, f"doc bigint, item bigint, {HITS}").where("similar > 0")
    names = [rows.select(F.col("key").alias(name), id_).distinct() for rows, name, id_ in ((keyed[0], "doc", "doc_id"), (keyed[1], "item", "item_id"))]
    return checked.join(names[0], "doc").join(names[1], "item").select("doc_id", "item_id", "size", "candidates", "similar", "held")
