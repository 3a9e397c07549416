"""Per-document text quality: statistics, and telling prose from lists, tables, listings and junk.

One pass over the bytes of whole Arrow batches gives a table of features per document: words, their
mean length and its spread, shares of symbols, digits and common words, entropy of the characters,
lines that end in punctuation, shares of repeated lines and paragraphs (paragraphs also by their
characters), the characters covered by the dominant n-gram for several n, and the share of characters in pieces (lines
and sentences) that read as prose.  The verdict is taken from that table by combined rules.

A piece reads as prose if it has words enough, few symbols and digits and hardly any single letters,
and either has its share of words that stand for nouns or accompany them (lists of four languages), or,
for other languages, has the shape of a sentence: a capital first and a sentence mark last, plain words
of spread lengths, short ones among them; or it runs in another script.  Pieces that a text repeats
over and over are no prose whatever they say.

Every feature of a document is computed where it is read; nothing is shuffled.

Defined cases: null, empty and blank texts are no cases and have no statistics; each input row is
judged by itself, repeated rows give the same verdict once; texts are judged whole; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orefield.llm.words import U, mix, run_hashes

#: Words that accompany nouns or stand for them in running sentences.
SENTENCE_WORDS = {
    "en": "the a an this that these those each every another our their your his her its we they it he she you there who which",
    "de": "der die das den dem des ein eine einen einem einer dieser diese dieses unser unsere unseren alle viele einige kein keine wir sie es ihre",
    "fr": "le la les des un une ce cet cette ces nos notre leur leurs quelques plusieurs chaque nous ils elles il elle qui",
    "es": "el los las unos unas una esta este estos estas nuestro nuestros nuestra nuestras varios varias algunos algunas cada su sus ellos",
}
#: Common words of four languages, for the share of common words.
COMMON_WORDS = "of to and in is for on with as by or be are not from at und ist nicht mit von auf zu et est dans pour que de en y con por para no"

LEAST_WORDS = 4
LEAST_SHARE = 0.09
REPEATED = 3
GRAMS = (4, 16)
#: Least words of a sentence that is known by its shape alone.
SHAPE_WORDS = 8
#: Bounds of the verdict.
PROSE_SHARE, GRAM_COVER, REPEATED_PARAGRAPHS, SYMBOLS, ENTROPY = 0.5, 0.5, 0.5, 0.4, 2.0

_SYMBOL, _SPACE, _LINE, _LETTER, _DIGIT = range(5)
_CLASS = np.full(256, _SYMBOL, np.uint8)
_CLASS[[9, 32]] = _SPACE
_CLASS[[28, 29, 30, 31]] = _SPACE
_CLASS[[10, 11, 12, 13]] = _LINE
_CLASS[48:58] = _DIGIT
_CLASS[65:91] = _CLASS[97:123] = _CLASS[128:] = _LETTER
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _one_of(characters: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters.encode())] = True
    return out


_BEFORE, _BEHIND, _JOINT, _STOPS = _one_of("\"'(>/*#"), _one_of("\"'),;:.!?"), _one_of(".,:'"), _one_of(".!?")
_ENDS = _one_of(".!?:;")
_WIDE_ENDS = np.array([int.from_bytes(c.encode(), "big") for c in "…。！？：；।"] + [], np.int64)
_NARROW_ENDS = np.array([int.from_bytes(c.encode(), "big") for c in "؟۔"], np.int64)
_BYTES = 1 << 22


def _hashes_of(words: str) -> np.ndarray:
    data = np.frombuffer(" ".join(words.split()).encode(), np.uint8)
    blank = np.flatnonzero(data == 32)
    return np.unique(run_hashes(data, np.r_[0, blank + 1], np.r_[blank, len(data)]))


_SENTENCE = _hashes_of(" ".join(SENTENCE_WORDS.values()))
_COMMON = np.union1d(_SENTENCE, _hashes_of(COMMON_WORDS))


def _classes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class of every byte (all bytes of a character have that of the character), and first bytes of letters of other scripts."""
    kind = _CLASS[data]
    lead = np.flatnonzero(data >= 0xC2)
    lead = lead[lead + 1 < len(data)]
    foreign = np.zeros(len(data), bool)
    if not len(lead):
        return kind, foreign
    b0, b1 = data[lead].astype(np.int32), data[lead + 1].astype(np.int32)
    b2 = data[np.minimum(lead + 2, len(data) - 1)].astype(np.int32)
    wide = b0 >= 0xE0
    two, three = b0 << 8 | b1, b0 << 16 | b1 << 8 | b2
    symbol = (
        ((b0 == 0xC2) & ~np.isin(b1, (0xAA, 0xB5, 0xBA))) | np.isin(two, (0xC397, 0xC3B7, 0xD88C, 0xD89B, 0xD89F, 0xDB94)) | (b0 == 0xE2) | (two == 0xE380) | np.isin(three, (0xE0A5A4, 0xEFBBBF, 0xEFBFBD))
        | ((two == 0xEFBC) & ((b2 <= 0x8F) | ((b2 >= 0x9A) & (b2 <= 0xA0)))) | (b0 == 0xF0) & (b1 == 0x9F)
    )
    space = (two == 0xC2A0) | np.isin(three, (0xE280AF, 0xE2819F, 0xE38080)) | ((two == 0xE280) & (b2 <= 0x8A))
    line = (two == 0xC285) | np.isin(three, (0xE280A8, 0xE280A9))
    new = np.where(line, _LINE, np.where(space, _SPACE, np.where(symbol, _SYMBOL, _LETTER))).astype(np.uint8)
    for k in range(4):
        part = lead[(k < 2) | (wide & (k < 3)) | (b0 >= 0xF0)]
        kind[np.minimum(part + k, len(data) - 1)] = new[(k < 2) | (wide & (k < 3)) | (b0 >= 0xF0)]
    latin = (b0 <= 0xCB) | ((b0 == 0xE1) & (b1 >= 0xB8) & (b1 <= 0xBB)) | (b0 == 0xCC) | ((b0 == 0xCD) & (b1 < 0xB0))
    foreign[lead[(new == _LETTER) & ~latin]] = True
    return kind, foreign


def _runs(inside: np.ndarray, border: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs; none goes over a border (first byte of a text)."""
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    first[border] = inside[border]
    last[border - 1] = inside[border - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def _groups(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the group of each element, and the first element of each, where ``new`` marks the first ones."""
    return np.cumsum(new) - 1, np.flatnonzero(new)


def _sequence_hashes(hashes: np.ndarray, group: np.ndarray, starts: np.ndarray) -> np.ndarray:
    place = (np.arange(len(hashes)) - starts[group]).astype(U)
    return np.add.reduceat(mix(hashes ^ mix(place + U(1))), starts)


def _repeats(row: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each element occurs in its row, and whether it is the first of its kind there."""
    key = (row.astype(U) << U(40)) | (hashes >> U(24))
    _, first, inverse, counts = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    once = np.zeros(len(key), bool)
    once[first] = True
    return counts[inverse], once


def _gram_cover(row: np.ndarray, hashes: np.ndarray, chars: np.ndarray, rows: int) -> np.ndarray:
    """Share of the characters of the words of each row that occurrences of its dominant n-gram cover, over the sizes GRAMS."""
    total = np.maximum(np.bincount(row, chars, rows), 1)
    best = np.zeros(rows)
    for n in GRAMS:
        if len(row) < n:
            continue
        at = np.flatnonzero(row[: len(row) - n + 1] == row[n - 1 :])
        if not len(at):
            continue
        mixed = np.zeros(len(at), U)
        for k in range(n):
            mixed = mixed * U(0x9E3779B97F4A7C15) + hashes[at + k]
        key = (row[at].astype(U) << U(40)) | (mix(mixed) >> U(24))
        ordered = np.sort(key)
        starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
        counts = np.diff(np.r_[starts, len(ordered)])
        of = (ordered[starts] >> U(40)).astype(np.int64)
        top = np.zeros(rows, np.int64)
        np.maximum.at(top, of, counts)
        often = (counts == top[of]) & (counts >= REPEATED)
        dominant = np.zeros(rows, U)
        dominant[of[often]] = ordered[starts[often]]
        hit = at[(dominant[row[at]] == key) & (top[row[at]] >= REPEATED)]
        change = np.zeros(len(row) + 1, np.int32)
        change[hit] += 1
        np.add.at(change, hit + n, -1)
        best = np.maximum(best, np.bincount(row, chars * (np.cumsum(change[:-1]) > 0), rows) / total)
    return best


def _features(data: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """Features of the texts that lie between the offsets ``at`` of ``data``."""
    rows = len(at) - 1
    row_of = np.repeat(np.arange(rows), np.diff(at))
    border = np.unique(at[1:-1])
    border = border[(border > 0) & (border < len(data))]
    kind, foreign = _classes(data)
    low = _LOWER[data]
    char = (data & 0xC0) != 0x80
    n_chars = np.r_[0, np.cumsum(char)]  # characters before each byte
    per_row = lambda what, weights=None: np.bincount(what, weights, rows)
    share = lambda part, whole: part / np.maximum(whole, 1)
    length = per_row(row_of, char)

    # Tokens between blanks, and the pieces, lines and paragraphs they form.
    starts, ends = _runs((kind != _SPACE) & (kind != _LINE), border)
    if not len(starts):
        return {c: np.zeros(rows, np.int64 if c in COUNTS else float) for c in FEATURES}
    row = row_of[starts]
    hashes = run_hashes(low, starts, ends)
    token_chars = n_chars[ends] - n_chars[starts]
    breaks = np.r_[0, np.cumsum((kind == _LINE) & ~((data == 13) & np.r_[data[1:] == 10, False]) & char)]
    gap = np.r_[9, breaks[starts[1:]] - breaks[ends[:-1]]]
    new_row = np.r_[True, row[1:] != row[:-1]]
    stopped = np.r_[True, _STOPS[data[ends[:-1] - 1]]]
    piece, piece_at = _groups(new_row | (gap > 0) | stopped)
    line, line_at = _groups(new_row | (gap > 0))
    _, paragraph_at = _groups(new_row | (gap > 1))
    paragraph = np.searchsorted(paragraph_at, np.arange(len(starts)), "right") - 1
    until = lambda first: np.r_[first[1:], len(starts)] - 1
    span = lambda first: n_chars[ends[until(first)]] - n_chars[starts[first]]

    # Runs of letters, of letters and digits, and those among them that stand alone.
    letter_at, letter_end = _runs(kind == _LETTER, border)
    letter_piece = piece[np.searchsorted(starts, letter_at, "right") - 1]
    single = n_chars[letter_end] - n_chars[letter_at] == 1
    words_at, words_end = _runs((kind == _LETTER) | (kind == _DIGIT), border)
    word_hash, word_row = run_hashes(low, words_at, words_end), row_of[words_at]
    word_token = np.searchsorted(starts, words_at, "right") - 1
    before, behind = words_at - 1, np.minimum(words_end, len(data) - 1)
    b1, b2, c1, c2, c3 = (data[np.clip(k, 0, len(data) - 1)] for k in (words_at - 1, words_at - 2, words_end, words_end + 1, words_end + 2))
    open_ = (words_at == starts[word_token]) | _BEFORE[data[before]] | ((b2 == 0x80) & np.isin(b1, (0x98, 0x9C))) | ((b2 == 0xC2) & np.isin(b1, (0xA1, 0xAB, 0xBF)))  # opening quotes and marks
    close = (words_end == ends[word_token]) | _BEHIND[data[behind]] | ((c1 == 0xE2) & (c2 == 0x80) & np.isin(c3, (0x99, 0x9D, 0xA6))) | ((c1 == 0xC2) & (c2 == 0xBB))  # closing ones
    further = np.minimum(words_end + 1, len(data) - 1)
    close &= (words_end == ends[word_token]) | (words_end + 1 >= ends[word_token]) | ~(_JOINT[data[behind]] & ((kind[further] == _LETTER) | (kind[further] == _DIGIT)))
    alone = open_ & close
    said = alone & np.isin(word_hash, _SENTENCE)
    word_chars = n_chars[words_end] - n_chars[words_at]

    # Pieces.
    pieces = len(piece_at)
    per_piece = lambda what, weights=None: np.bincount(what, weights, pieces)
    piece_row, chars = row[piece_at], span(piece_at).astype(float)
    n_tokens = per_piece(piece)
    byte_piece = np.repeat(np.arange(pieces), ends[until(piece_at)] - starts[piece_at])
    inside = np.repeat(starts[piece_at] - np.r_[0, np.cumsum(ends[until(piece_at)] - starts[piece_at])[:-1]], ends[until(piece_at)] - starts[piece_at]) + np.arange(len(byte_piece))
    symbols, digits, strange = (per_piece(byte_piece, w[inside]) for w in (char & (kind == _SYMBOL), kind == _DIGIT, foreign))
    words_of = piece[word_token]
    spread_1, spread_2 = per_piece(words_of, word_chars), per_piece(words_of, word_chars.astype(float) ** 2)
    n_alone, n_words_p = per_piece(words_of, alone), per_piece(words_of)
    variance = share(spread_2, n_words_p) - share(spread_1, n_words_p) ** 2
    plain = (n_tokens >= LEAST_WORDS) & (per_piece(letter_piece, single) < 0.4 * per_piece(letter_piece)) & (symbols + digits < 0.5 * chars)
    function_words = per_piece(words_of, said) >= LEAST_SHARE * n_tokens
    head = data[starts[piece_at]]
    short_plain = alone & (word_chars <= 3) & (kind[words_at] == _LETTER) & (low[words_at] == data[words_at])
    sentence = (
        (n_tokens >= SHAPE_WORDS) & (((head >= 65) & (head <= 90)) | (head >= 0xC3)) & _STOPS[data[ends[until(piece_at)] - 1]] & (n_alone >= 0.8 * n_words_p) & (variance >= 3)
        & (per_piece(words_of, short_plain) >= 0.15 * n_words_p) & (symbols + digits < 0.1 * chars)
    )
    reads = (plain & (function_words | sentence)) | ((strange >= 12) & (strange >= 0.5 * chars))
    times, _ = _repeats(piece_row, _sequence_hashes(hashes, piece, piece_at))
    piece_chars = np.maximum(per_row(piece_row, chars), 1)

    # Lines and paragraphs.
    line_row, line_last = row[line_at], ends[until(line_at)]
    n_lines = per_row(line_row)
    tail = lambda k: data[np.maximum(line_last - k, 0)].astype(np.int64)
    ended = _ENDS[data[line_last - 1]] | np.isin(tail(3) << 16 | tail(2) << 8 | tail(1), _WIDE_ENDS) | np.isin(tail(2) << 8 | tail(1), _NARROW_ENDS)
    _, line_once = _repeats(line_row, _sequence_hashes(hashes, line, line_at))
    paragraph_row, paragraph_chars = row[paragraph_at], span(paragraph_at).astype(float)
    _, paragraph_once = _repeats(paragraph_row, _sequence_hashes(hashes, paragraph, paragraph_at))

    n_words = per_row(word_row)
    mean = share(per_row(word_row, word_chars), n_words)
    counts = np.bincount(row_of * 256 + low, minlength=rows * 256).reshape(rows, 256)
    p = counts / np.maximum(counts.sum(1, keepdims=True), 1)
    return {
        "n_words": n_words.astype(np.int64), "n_tokens": per_row(row).astype(np.int64), "mean_word_length": mean, "word_length_spread": np.sqrt(np.maximum(share(per_row(word_row, word_chars.astype(float) ** 2), n_words) - mean**2, 0)),
        "symbol_ratio": share(per_row(row_of, char & (kind == _SYMBOL)), length), "digit_ratio": share(per_row(row_of, kind == _DIGIT), length), "entropy": np.where(per_row(row) > 0, -(p * np.log2(np.where(p > 0, p, 1))).sum(1), 0.0),
        "punctuated_lines": share(per_row(line_row, ended), n_lines), "common_words": share(per_row(word_row, np.isin(word_hash, _COMMON)), n_words),
        "repeated_lines": share(per_row(line_row, ~line_once), n_lines), "repeated_paragraphs": share(per_row(paragraph_row, ~paragraph_once), per_row(paragraph_row)),
        "repeated_paragraph_chars": share(per_row(paragraph_row, paragraph_chars * ~paragraph_once), per_row(paragraph_row, paragraph_chars)),
        "gram_cover": _gram_cover(row, hashes, token_chars, rows), "prose_share": per_row(piece_row, chars * (reads & (times < REPEATED))) / piece_chars, "repeated_share": per_row(piece_row, chars * (times >= REPEATED)) / piece_chars,
    }


COUNTS = ("n_words", "n_tokens")
FEATURES = (
    "n_words", "n_tokens", "mean_word_length", "word_length_spread", "symbol_ratio", "digit_ratio", "entropy", "punctuated_lines", "common_words", "repeated_lines", "repeated_paragraphs", "repeated_paragraph_chars", "gram_cover", "prose_share", "repeated_share",
)


def features(documents: DataFrame) -> DataFrame:
    """(doc_id, FEATURES) of every row with text: one pass, no shuffle."""
    id_type = dict(documents.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "").cast(pa.large_string())
            at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            all_ = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
            a = 0
            while a < len(texts):  # some rows at a time, so that what is held stays in proportion to them
                b = max(int(np.searchsorted(at, at[a] + _BYTES, "right")) - 1, a + 1)
                made = _features(all_[at[a] : at[b]], at[a : b + 1] - at[a])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), *[pa.array(made[c]) for c in FEATURES]], names=["doc_id", *FEATURES])
                a = b

    schema = ", ".join(f"{c} {'bigint' if c in COUNTS else 'double'}" for c in FEATURES)
    return documents.where(F.col("text").rlike(r"\S")).select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, {schema}")


def is_prose() -> Column:
    """The verdict over the features: prose by most of its characters, without much repetition, of letters rather than symbols."""
    f = F.col
    return (
        (f("prose_share") >= PROSE_SHARE) & (f("gram_cover") < GRAM_COVER) & (f("repeated_paragraph_chars") < REPEATED_PARAGRAPHS)
        & (f("symbol_ratio") < SYMBOLS) & (f("entropy") >= ENTROPY) & f("mean_word_length").between(1.5, 40)
    )


def judged(documents: DataFrame) -> DataFrame:
    """(doc_id, prose_share, repeated_share, gram_cover, is_prose) of every row with text."""
    return features(documents).where("n_tokens > 0").select("doc_id", "prose_share", "repeated_share", "gram_cover", is_prose().alias("is_prose"))


def not_prose(documents: DataFrame) -> DataFrame:
    """(doc_id) of texts that are no prose."""
    return judged(documents).where(~F.col("is_prose")).select("doc_id").distinct()


def statistics(documents: DataFrame) -> DataFrame:
    """Per row with text: its features, rounded.

    Words are runs of letters and digits of any script, with the marks that belong to their letters; symbols are what is neither that nor blank.
    """
    return features(documents).select("doc_id", "n_words", *[F.round(c, 4).alias(c) for c in FEATURES if c not in COUNTS])


def agreement(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, is_prose, n): verdicts against the labels on which the raters of a document agree."""
    agreed = labels.where(F.col("label").isNotNull()).groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other")
    return judged(documents).select("doc_id", "is_prose").join(agreed.select("doc_id", "label"), "doc_id").groupBy("label", "is_prose").agg(F.count(F.lit(1)).alias("n"))
