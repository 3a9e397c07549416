"""Near-duplicate texts: pairs whose shingle sets are similar, without pairwise comparison.

1. Each text is read once and becomes a set of hashed three-word shingles, a hash of that set (equal
   sets are one class from then on), min-hashes in ``BANDS`` bands of ``ROWS``, and a fingerprint of
   256 bits: the parities of how many shingles fall on each bit.  Two fingerprints differ in at most as
   many bits as the sets differ in elements, so the Hamming distance is a metric bound without error.
2. Classes that agree on a band share a shard.  (Distances between unrelated texts are concentrated
   around one value, where the bounds of a vantage-point tree over the whole collection would prune
   next to nothing; the bands make the first cut.  At similarity 0.7 a pair shares no band with
   probability 0.00015, at 0.75 with 0.000005, at 0.8 with 0.00000005.)
3. Shards are searched by vantage-point trees.  Up to ``LEAF`` members they are leaves.  Larger ones
   are cut by distance: first from the empty set (that is, by size), then, level by level, from a
   vantage point chosen in each shard that is still large, into rings as wide as the search radius; by
   the triangle inequality a partner lies in the own or the next ring, so each member also visits the
   ring beside its own, and a pair meets exactly once: where not both are visitors on any level.  Levels
   end when every shard is a leaf or a level no longer divides; what stays large then is compared in
   blocks.  Pairs within the fingerprint bound remain.
4. These few pairs are checked exactly: the shingle sets of just their classes are gathered and
   intersected.

Defined cases: null, empty and short texts (under ``SHINGLE`` words) take no part; identical texts are
pairs of similarity 1 (a class of very many copies is spread over blocks); texts are read whole; repeated ids are reported as given; an empty table gives no
rows; other columns are ignored.  No group is capped: what is large is split.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orefield.llm.words import U, distinct_shingles, mix
from orefield.plans.lineage import cut
from orefield.plans.skew import heavy_keys

SHINGLE = 3
SIMILARITY = 0.7
BANDS, ROWS = 32, 4
LEAF = 48
FILTER_BITS = 1 << 24
SAMPLE = 16
SALTS = 32
PRINT = "struct<a:bigint,b:bigint,c:bigint,d:bigint>"


def _multipliers(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U) * U(0xD1342543DE82EF95)) | U(1)


def _set_hash(hashes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return mix(np.add.reduceat(mix(hashes ^ U(0xA5A5A5A5A5A5A5A5)), starts) + sizes.astype(U)).view(np.int64)


def _rows_with_shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    hashes, sizes = distinct_shingles(texts, SHINGLE)
    rows = np.flatnonzero(sizes)
    sizes = sizes[rows]
    return rows, hashes, np.cumsum(sizes) - sizes, sizes


def prints(texts: DataFrame, id_: str, text: str) -> DataFrame:
    """(id, set, n, bands, print) of every text that takes part."""
    id_type = dict(texts.dtypes)[id_]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = _multipliers(BANDS * ROWS)
        for batch in batches:
            rows, hashes, starts, sizes = _rows_with_shingles(batch.column("text"))
            if not len(rows):
                continue
            sets = _set_hash(hashes, starts, sizes)
            new = np.zeros(len(rows), bool)
            new[np.unique(sets, return_index=True)[1]] = True  # copies in a batch send their bands once
            keys = np.empty((len(rows), BANDS), U)
            for band in range(BANDS):
                key = np.full(len(rows), U(band + 1))
                for k in range(ROWS):
                    key = mix(key * U(0x9E3779B97F4A7C15) + np.minimum.reduceat(mix32(hashes, by[band * ROWS + k]), starts))
                keys[:, band] = key
            bit = (hashes * U(0xC2B2AE3D27D4EB4F)) >> U(56)
            one = U(1) << (bit & U(63))
            words = [np.bitwise_xor.reduceat(np.where(bit >> U(6) == U(w), one, U(0)), starts).view(np.int64) for w in range(4)]
            offsets = np.concatenate([[0], np.cumsum(np.where(new, BANDS, 0))])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(pa.array(rows)), pa.array(sets), pa.array(sizes, pa.int32()),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys[new].ravel().view(np.int64))),
                    pa.StructArray.from_arrays([pa.array(w) for w in words], names=["a", "b", "c", "d"]),
                ], names=["id", "set", "n", "bands", "print"],
            )

    return texts.select(F.col(id_).alias("id"), F.col(text).alias("text")).mapInArrow(make, f"id {id_type}, set bigint, n int, bands array<bigint>, print {PRINT}")


def mix32(x: np.ndarray, by: np.uint64) -> np.ndarray:
    """High half of a product: one hash function per odd multiplier."""
    return (x * by) >> U(32)


def _distance(p: Column | str, q: Column | str) -> Column:
    p, q = (F.col(c) if isinstance(c, str) else c for c in (p, q))
    return sum((F.bit_count(p[w].bitwiseXOR(q[w])) for w in "bcd"), F.bit_count(p["a"].bitwiseXOR(q["a"])))


def radius(n1: Column, n2: Column, similarity: float) -> Column:
    """Elements in which two sets of these sizes may differ at most."""
    return F.floor((n1 + n2) * ((1 - similarity) / (1 + similarity)) + 1e-9)


def _leaf_pairs(shards: DataFrame, similarity: float) -> DataFrame:
    """Pairs within shards of at most LEAF members."""
    visited = ["visits"] if "visits" in shards.columns else []

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.column("members")
            flat, count = pc.list_flatten(m), pc.list_value_length(m).to_numpy(zero_copy_only=False).astype(np.int64)
            visits = flat.field("visits").to_numpy(zero_copy_only=False) if visited else None
            sets, n = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("set", "n"))
            words = np.stack([flat.field("print").field(w).to_numpy(zero_copy_only=False).view(U) for w in "abcd"], 1) if len(flat) else np.empty((0, 4), U)
            end = np.repeat(np.cumsum(count), count)
            partners = end - np.arange(len(sets)) - 1
            i = np.repeat(np.arange(len(sets)), partners)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(partners) - partners, partners)
            near = np.bitwise_count(words[i] ^ words[j]).sum(1) <= np.floor((n[i].astype(float) + n[j]) * ((1 - similarity) / (1 + similarity)) + 1e-9)
            near &= (np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - 1e-9) & (sets[i] != sets[j])
            if visits is not None:
                near &= visits[i] & visits[j] == 0
            i, j = i[near], j[near]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(sets[i], sets[j])), pa.array(np.maximum(sets[i], sets[j]))], names=["a", "b"])

    grouped = shards.groupBy("key").agg(F.collect_list(F.struct("set", "n", "print", *visited)).alias("members"))
    return grouped.select("members").mapInArrow(compare, "a bigint, b bigint")


def _counted(shards: DataFrame) -> DataFrame:
    return shards.withColumn("members", F.count(F.lit(1)).over(Window.partitionBy("key")))


def _sized(shards: DataFrame) -> DataFrame:
    """Members of each shard, counted in the map tasks first: no shard is gathered in one task."""
    counts = shards.groupBy("key").agg(F.count(F.lit(1)).alias("members"))
    return shards.join(counts, "key")


def _vantage_pairs(shards: DataFrame, similarity: float, levels: int = 4) -> DataFrame:
    """Pairs within large shards (key, set, n, print): a vantage-point tree per shard, then blocks."""
    # From the empty set the distance is the size: partners are in the own or the next size class.
    size_class = F.floor(F.log(F.col("n").cast("double")) / np.log(1 / similarity) + 1e-9)
    open_ = _beside(shards.withColumn("visits", F.lit(0)), size_class, 0)
    found, held = [], None
    for level in range(1, levels + 1):
        sized = cut(_sized(open_))
        found.append(_leaf_pairs(sized.where(F.col("members") <= LEAF), similarity))
        large = sized.where(F.col("members") > LEAF)
        total = large.count()
        if not total or (held is not None and total > 0.8 * held):
            break
        held = total
        vantage = large.groupBy("key").agg(F.min_by("print", F.xxhash64("set")).alias("vantage"), F.max("n").alias("most"))
        width = F.greatest(F.lit(1), radius(F.col("most"), F.col("most"), similarity))
        open_ = _beside(large.drop("members").join(vantage, "key"), F.floor(_distance("print", "vantage") / width), level).drop("vantage", "most")
    else:
        large = cut(_sized(open_))
    found.append(_block_pairs(large, similarity))
    return reduce(DataFrame.unionByName, found)


def _block_pairs(sized: DataFrame, similarity: float) -> DataFrame:
    """Pairs within shards of any size: every two blocks of a shard meet in one task."""
    blocks = F.greatest(F.lit(1), F.ceil(F.col("members") / (4 * LEAF)).cast("int"))
    mine = F.pmod(F.xxhash64("set"), blocks).cast("int")
    spread = (
        sized.withColumn("blocks", blocks).withColumn("block", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", "visits", "set", "n", "print", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    )
    left, right = (spread.select("key", "i", "j", *(F.col(c).alias(f"{c}_{side}") for c in ("visits", "set", "n", "print", "block"))) for side in "lr")
    met = left.join(right, ["key", "i", "j"]).where(
        (F.col("set_l") < F.col("set_r")) & (F.col("visits_l").bitwiseAND(F.col("visits_r")) == 0)
        & ((F.col("i") == F.col("j")) | (F.col("block_l") != F.col("block_r")))
        & (F.least("n_l", "n_r") >= similarity * F.greatest("n_l", "n_r") - 1e-9)
        & (_distance("print_l", "print_r") <= radius(F.col("n_l"), F.col("n_r"), similarity))
    )
    return met.select(F.col("set_l").alias("a"), F.col("set_r").alias("b"))


def _beside(members: DataFrame, ring: Column, level: int) -> DataFrame:
    """Members in their own ring and, as visitors (a bit of ``visits`` per level), in the next one; the key becomes that of the ring."""
    ring = ring.cast("bigint")
    places = F.array(F.struct(ring.alias("ring"), F.col("visits").alias("visits")), F.struct((ring + 1).alias("ring"), F.col("visits").bitwiseOR(F.lit(1 << level)).alias("visits")))
    return (
        members.withColumn("place", F.explode(places))
        .withColumn("key", F.xxhash64("key", "place.ring")).withColumn("visits", F.col("place.visits")).drop("place")
    )


def _wanted(sets: DataFrame) -> np.ndarray:
    """A filter of FILTER_BITS bits (its size is fixed) that holds all given set hashes."""
    places = sets.select(F.pmod("set", F.lit(FILTER_BITS)).alias("h"))
    words = places.groupBy(F.expr("h div 64").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(h % 64 as int)))").alias("bits"))
    out = np.zeros(FILTER_BITS // 64, np.int64)
    got = words.toPandas()
    out[got["w"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64)
    return out.view(np.uint8)


def _verified(texts: DataFrame, text: str, pairs: DataFrame, similarity: float) -> DataFrame:
    """Pairs of classes whose shingle sets are that similar."""
    wanted = texts.sparkSession.sparkContext.broadcast(_wanted(pairs.select(F.explode(F.array("a", "b")).alias("set"))))

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, hashes, starts, sizes = _rows_with_shingles(batch.column("text"))
            if not len(rows):
                continue
            sets = _set_hash(hashes, starts, sizes)
            h = sets % FILTER_BITS
            first = np.zeros(len(rows), bool)
            first[np.unique(sets, return_index=True)[1]] = True
            keep = np.flatnonzero(first & ((wanted.value[h >> 3] >> (h & 7).astype(np.uint8)) & 1).astype(bool))
            # 48 bits of each hash: within a pair, two different shingles then look equal once in 10**11 pairs.
            content = [np.ascontiguousarray(hashes[starts[i] : starts[i] + sizes[i]].view(np.uint8).reshape(-1, 8)[:, :6]).tobytes() for i in keep]
            yield pa.RecordBatch.from_arrays([pa.array(sets[keep]), pa.array(content, pa.binary())], names=["set", "content"])

    contents = texts.select(F.col(text).alias("text")).mapInArrow(shingles, "set bigint, content binary").groupBy("set").agg(F.first("content").alias("content"))
    contents = cut(contents)

    def intersect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                p, q = (np.frombuffer(v, np.uint8).reshape(-1, 6) for v in (x, y))
                p, q = (np.concatenate([v, np.zeros((len(v), 2), np.uint8)], 1).view(U).ravel() for v in (p, q))
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(both >= similarity * (len(p) + len(q) - both) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(contents.select(F.col("set").alias("a"), F.col("content").alias("x")), "a").join(contents.select(F.col("set").alias("b"), F.col("content").alias("y")), "b")
    return joined.select("a", "b", "x", "y").mapInArrow(intersect, "a bigint, b bigint")


def similar_classes(texts: DataFrame, id_: str = "unit_id", text: str = "source", similarity: float = SIMILARITY, hot_classes: int = 1 << 16) -> tuple[DataFrame, DataFrame]:
    """(members, links): members (id, set) says which class each text is in, links (a, b) which classes are similar."""
    made = cut(prints(texts, id_, text))
    small_print = made.where(F.size("bands") > 0).groupBy("set").agg(F.first("n").alias("n"), F.first("print").alias("print"))
    bands = made.select("set", F.explode("bands").alias("key"))
    # A band that very many classes share is known by every SAMPLE-th class; which way a band takes changes no result.
    hot = heavy_keys(bands.where(F.pmod("set", F.lit(SAMPLE)) == 0), "key", min_rows=hot_classes // SAMPLE)
    is_hot = F.col("key").isin(hot) if hot else F.lit(False)
    postings = bands.where(~is_hot).repartition("key").dropDuplicates(["key", "set"])
    shards = cut(_counted(postings).where("members > 1").join(small_print, "set").select("key", "members", "set", "n", "print"))
    pairs = _leaf_pairs(shards.where(F.col("members") <= LEAF), similarity)
    large = shards.where(F.col("members") > LEAF).drop("members")
    if hot:  # never gathered by their key: repeats are removed by key and class
        large = large.unionByName(bands.where(is_hot).dropDuplicates(["key", "set"]).join(small_print, "set").select("key", "set", "n", "print"))
    if not large.isEmpty():
        pairs = pairs.unionByName(_vantage_pairs(large, similarity))
    pairs = cut(pairs.distinct())
    return made.select("id", "set"), cut(_verified(texts, text, pairs, similarity))


def near_pairs(texts: DataFrame, id_: str = "unit_id", text: str = "source", similarity: float = SIMILARITY, hot_copies: int = 4096) -> DataFrame:
    """(<id>_a, <id>_b), a < b: all pairs of texts at least that similar, copies included."""
    members, links = similar_classes(texts, id_, text, similarity)
    hot = heavy_keys(members, "set", min_rows=hot_copies)
    is_hot = F.col("set").isin(hot) if hot else F.lit(False)
    # Copies of a class, of which there may be very many, meet in blocks: the left side is cut up, the right side sent to every block.
    salts = F.when(is_hot, F.lit(SALTS)).otherwise(F.lit(1))
    one = members.select(F.col("set"), F.col("id").alias("x"), F.pmod(F.xxhash64("id"), salts).cast("int").alias("salt"))
    two = members.select(F.col("set").alias("set2"), F.col("id").alias("y"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt2"))
    copies = one.join(two, (F.col("set") == F.col("set2")) & (F.col("salt") == F.col("salt2"))).where(F.col("x") < F.col("y"))
    other = links.withColumn("salt3", F.explode(F.sequence(F.lit(0), F.when(F.col("a").isin(hot), F.lit(SALTS)).otherwise(F.lit(1)) - 1 if hot else F.lit(0))))
    across = other.join(one, (F.col("a") == F.col("set")) & (F.col("salt3") == F.col("salt"))).select("x", "b")
    across = across.join(two.where("salt2 = 0"), F.col("b") == F.col("set2"))
    return copies.select("x", "y").unionByName(across.select("x", "y")).select(F.least("x", "y").alias(f"{id_}_a"), F.greatest("x", "y").alias(f"{id_}_b"))


def near_classes(texts: DataFrame, id_: str = "unit_id", text: str = "source", similarity: float = SIMILARITY) -> DataFrame:
    """(<id>, class_id, n_copies, n_links): the class of every text (named by its least id), its size and the classes similar to it."""
    members, links = similar_classes(texts, id_, text, similarity)
    classes = members.groupBy("set").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("n_copies"))
    degree = links.select(F.explode(F.array("a", "b")).alias("set")).groupBy("set").agg(F.count(F.lit(1)).alias("n_links"))
    known = classes.join(degree, "set", "left").select("set", "class_id", "n_copies", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
    return members.join(known, "set").select(F.col("id").alias(id_), "class_id", "n_copies", "n_links")
