"""Words of texts, hashed in whole Arrow batches.

Words are the maximal runs of ASCII letters and digits, in lower case.  A batch of texts is taken as
one array of bytes; words are found by where letters begin and end, and hashed by differences of one
running polynomial sum, so nothing is done word by word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LOWER = np.zeros(256, np.uint8)
for _c in b"0123456789abcdefghijklmnopqrstuvwxyz":
    _LOWER[_c] = _c
for _c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _LOWER[_c] = _c + 32
_BLOCK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A well-spread 64-bit function of 64 bits (the finaliser of the splitmix generator)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a batch, text after text, and the number of words of each text."""
    texts = pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = pa.types.is_large_string(texts.type)
    at = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    low = _LOWER[data]
    inside = low > 0
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    border = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(data))]
    first[border] = inside[border]
    last[border - 1] = inside[border - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    per_text = np.searchsorted(starts, at[1:], "left") - np.searchsorted(starts, at[:-1], "left")
    return run_hashes(low, starts, ends), per_text.astype(np.int64)


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the runs of bytes from ``starts`` to ``ends``, both ascending and without overlap."""
    out = np.empty(len(starts), U)
    power, inverse = _powers(min(len(data), 2 * _BLOCK) + 1)
    a = 0
    while a < len(starts):
        b = max(np.searchsorted(ends, starts[a] + _BLOCK, "right"), a + 1)
        begin, end = starts[a], ends[b - 1]
        if end - begin >= len(power):  # one run longer than a block
            power, inverse = _powers(int(end - begin) + 1)
        sums = np.zeros(end - begin + 1, U)
        np.cumsum(data[begin:end] * power[: end - begin], out=sums[1:])
        s, e = starts[a:b] - begin, ends[a:b] - begin
        out[a:b] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(U))
        a = b
    return out


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    power, inverse = np.full(n, _BASE), np.full(n, _INVERSE)
    power[0] = inverse[0] = 1
    return np.multiply.accumulate(power), np.multiply.accumulate(inverse)


def shingle_hashes(words: np.ndarray, per_text: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words within a text, and the text of each."""
    n = np.maximum(per_text - size + 1, 0)
    text = np.repeat(np.arange(len(per_text)), n)
    first = np.repeat(np.cumsum(per_text) - per_text - (np.cumsum(n) - n), n) + np.arange(n.sum())
    out = np.zeros(len(first), U)
    for k in range(size):
        out = mix(out * _BASE + words[first + k])
    return out, text


def distinct_shingles(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Different shingle hashes of each text, ascending within it, and their number per text."""
    hashes, text = shingle_hashes(*word_hashes(texts), size)
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    keep = np.ones(len(hashes), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    return hashes[keep], np.bincount(text[keep], minlength=len(texts)).astype(np.int64)
