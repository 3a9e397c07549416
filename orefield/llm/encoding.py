"""Encoding a whole corpus with a public byte-level BPE tokenizer, and decoding it again.

Texts are cut into pre-tokens in the JVM.  All distinct pre-tokens of the corpus are gathered by one
shuffle (each document, then each map task, sends a word once), and each is encoded exactly once.
The ids are then joined back by position: the ids of the most frequent words, a table of at most
``HOT_WORDS`` entries of at most ``HOT_LENGTH`` characters, are broadcast and put in place while a
document is read; the rare rest (every word of it in few places, so without skew) is joined by a
shuffle on the word and put into the gaps of its document.  Hot words never travel.

Defined cases: null and empty texts have an empty array; special tokens are never produced, their
spelling in a text is ordinary text; one row per input row, so repeated rows stay repeated; a null
doc_id stays null; texts are encoded whole, whatever their length; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orefield.plans.lineage import cut

HOT_WORDS = 65_536
HOT_LENGTH = 64

#: Pre-tokens of the byte-level vocabulary: contractions, then runs of letters, digits and others with one blank before them, then white space.
PRE_TOKENS = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{IsWhite_Space}\p{L}\p{N}]+"
    r"|\p{IsWhite_Space}+(?!\P{IsWhite_Space})|\p{IsWhite_Space}+"
)


def vocabulary_file(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Place of an installed public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pre_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PRE_TOKENS), F.lit(0))


def _ranks(path: str) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(path).read_bytes().splitlines() if line)}


def dictionary(texts: DataFrame, text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(word, n_docs, ids): every distinct pre-token of the corpus, encoded once; ids as bytes."""
    path = vocabulary or vocabulary_file()
    packed = _id_type(path)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        bpe = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=_ranks(path), special_tokens={})
        for b in batches:
            ids = bpe.encode_ordinary_batch(b.column("word").to_pylist(), num_threads=1)
            yield pa.RecordBatch.from_arrays([b.column("word"), b.column("n_docs"), pa.array([np.array(i, packed).tobytes() for i in ids], pa.binary())], names=["word", "n_docs", "ids"])

    words = texts.select(F.explode(F.array_distinct(pre_tokens(F.col(text)))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n_docs"))
    return words.mapInArrow(encode, "word string, n_docs bigint, ids binary")


def _id_type(path: str) -> np.dtype:
    """Bytes for an id: two where the vocabulary allows it."""
    return np.dtype(np.uint16 if max(_ranks(path).values()) < 1 << 16 else np.int32)


def _hot(words: DataFrame, packed: np.dtype) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The most frequent words with offsets into their ids: bounded by HOT_WORDS and HOT_LENGTH."""
    top = words.where(F.length("word") <= HOT_LENGTH).orderBy(F.desc("n_docs"), "word").limit(HOT_WORDS).select("word", "ids").toArrow()
    ids, lengths = _unbinary(top.column("ids").combine_chunks(), packed)
    return top.column("word").combine_chunks(), np.concatenate([[0], np.cumsum(lengths)]), ids


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of flat[starts[i] : starts[i] + lengths[i]]."""
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return flat[:0]
    return flat[np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1])]


def _binary(ids: np.ndarray, per_row: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(per_row)]) * ids.itemsize
    return pa.Array.from_buffers(pa.binary(), len(per_row), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(ids)])


def _unbinary(packed: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(b"".join(packed.to_pylist()), kind).astype(np.int32)
    return ids, pc.binary_length(packed).to_numpy(zero_copy_only=False).astype(np.int64) // kind.itemsize


def _lists(ids: np.ndarray, per_row: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per_row)]), pa.int32()), pa.array(ids, pa.int32()))


def encode(documents: DataFrame, id_: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(id, ids): the token ids of every text, without special tokens."""
    words = cut(dictionary(documents, text, vocabulary))
    packed = _id_type(vocabulary or vocabulary_file())
    hot_words, hot_at, hot_ids = _hot(words, packed)
    shared = documents.sparkSession.sparkContext.broadcast((hot_words, hot_at, hot_ids))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, at, flat_ids = shared.value
        size = np.append(np.diff(at), 0)
        for b in batches:
            lists = b.column("words")
            n_words = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = pc.list_flatten(lists)
            code = pc.fill_null(pc.index_in(flat, value_set=names), len(names)).to_numpy(zero_copy_only=False).astype(np.int64)
            n_ids = size[code]
            doc = np.repeat(np.arange(len(n_words)), n_words)
            per_doc = np.bincount(doc, weights=n_ids, minlength=len(n_words)).astype(np.int64)
            out = _binary(gather(flat_ids, at[code], n_ids).astype(packed), per_doc)
            cold = np.flatnonzero(code == len(names))
            before = np.cumsum(n_ids) - n_ids - np.repeat(np.cumsum(per_doc) - per_doc, n_words)  # ids of the document before each word
            gaps = pa.StructArray.from_arrays([pa.array(before[cold], pa.int32()), pa.array(cold, pa.int64()), flat.take(pa.array(cold))], names=["at", "nth", "word"])
            n_cold = np.bincount(doc[cold], minlength=len(n_words))
            cold_lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_cold)]), pa.int32()), gaps)
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("id"), out, cold_lists], names=["row", "id", "ids", "gaps"])

    id_type = dict(documents.dtypes)[id_]
    # A row is known by its id and a hash of its content together: rows that agree in both are equal and share their pieces.
    rows = documents.select(F.hash(F.col(id_), F.col(text)).alias("row"), F.col(id_).alias("id"), pre_tokens(F.col(text)).alias("words"))
    placed = rows.mapInArrow(place, f"row int, id {id_type}, ids binary, gaps array<struct<at:int,nth:bigint,word:string>>")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, n = _unbinary(b.column("ids"), packed)
            yield pa.RecordBatch.from_arrays([b.column("id"), _lists(ids, n)], names=[id_, "ids"])

    placed = cut(placed)
    whole = placed.where(F.size("gaps") == 0).select("id", "ids").mapInArrow(unpack, f"{id_} {id_type}, ids array<int>")
    gapped = placed.where(F.size("gaps") > 0)
    cold = gapped.dropDuplicates(["row", "id"]).select("row", "id", F.explode("gaps").alias("gap")).select("row", "id", "gap.*")
    pieces = (
        cold.join(words.select("word", F.col("ids").alias("piece")), "word")
        .groupBy(F.col("row").alias("row_"), F.col("id").alias("id_")).agg(F.array_sort(F.collect_list(F.struct("nth", "at", "piece"))).alias("pieces"))
    )

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, n_old = _unbinary(b.column("ids"), packed)
            pieces, n_pieces = pc.list_flatten(b.column("pieces")), pc.list_value_length(b.column("pieces")).to_numpy(zero_copy_only=False).astype(np.int64)
            new, n_new = _unbinary(pieces.field("piece"), packed)
            start = np.cumsum(n_old) - n_old
            where = pieces.field("at").to_numpy(zero_copy_only=False).astype(np.int64) + np.repeat(start, n_pieces)
            filled = np.insert(ids, np.repeat(where, n_new), new)
            of = np.repeat(np.arange(len(n_old)), n_pieces)
            sizes = n_old + np.bincount(of, weights=n_new, minlength=len(n_old)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("id"), _lists(filled, sizes)], names=[id_, "ids"])

    same = (F.col("row") == F.col("row_")) & F.col("id").eqNullSafe(F.col("id_"))
    joined = gapped.select("row", "id", "ids").join(pieces, same).select("id", "ids", "pieces")
    return whole.unionByName(joined.mapInArrow(fill, f"{id_} {id_type}, ids array<int>"))


def token_table(spark: SparkSession, vocabulary: str | None = None) -> DataFrame:
    """(token, bytes): one row per entry of the vocabulary."""
    ranks = _ranks(vocabulary or vocabulary_file())
    return spark.createDataFrame(pa.table({"token": pa.array(ranks.values(), pa.int32()), "bytes": pa.array(ranks.keys(), pa.binary())}))


def decode(encoded: DataFrame, id_: str = "doc_id", ids: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """(id, text): the texts again.

    Ids, compact as they are, are shuffled once, by id and content; tokens are then joined with the table of
    the bytes of each, which is broadcast (its size is that of the vocabulary), and put together by position
    where they are.  Null or empty ids give the empty text; ids that the vocabulary lacks are left out, bytes
    that are no UTF-8 become U+FFFD; repeated rows stay repeated.
    """
    table = F.broadcast(token_table(encoded.sparkSession, vocabulary).withColumn("hex", F.hex("bytes")).drop("bytes"))
    rows = encoded.select(F.col(id_).alias("id"), F.coalesce(F.col(ids), F.array().cast("array<int>")).alias("ids"))
    once = rows.groupBy("id", F.xxhash64("ids").alias("content")).agg(F.first("ids").alias("ids"), F.count(F.lit(1)).alias("n"))
    tokens = once.select("id", "content", "n", F.posexplode_outer("ids").alias("at", "token")).join(table, "token", "left")
    texts = tokens.groupBy("id", "content", "n").agg(F.array_sort(F.collect_list(F.struct("at", "hex"))).alias("parts"))
    text = F.make_valid_utf8(F.unhex(F.array_join(F.transform("parts", lambda x: x["hex"]), "")).cast("string"))
    copies = F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy")
    return texts.select(F.col("id").alias(id_), text.alias("text"), copies).drop("copy")
