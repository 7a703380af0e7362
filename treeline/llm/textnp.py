"""Vectorised text kernels: whole batches of texts as one byte buffer.

Words are runs of digits, letters and non-ASCII bytes after lower-casing A-Z, that is
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` over UTF-8, which breaks only at ASCII bytes.
Everything is computed with numpy over the buffer, never per word in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def splitmix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64 over an array of unsigned 64-bit integers."""
    z = x + _U(0x9E3779B97F4A7C15)
    z = (z ^ (z >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> _U(27))) * _U(0x94D049BB133111EB)
    return z ^ (z >> _U(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64."""
    out = np.full(n + 1, base & ((1 << 64) - 1), dtype=_U)
    out[0] = 1
    return np.multiply.accumulate(out)


_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_word = np.zeros(256, dtype=bool)
_word[48:58] = _word[97:123] = _word[128:] = True
IS_WORD = _word[_lower]
BYTE_VALUE = np.where(IS_WORD, splitmix(_lower.astype(_U) + _U(1)), _U(0))


def packed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and their offsets; a null counts as an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(offsets: np.ndarray, most_bytes: int, most_rows: int) -> Iterator[tuple[int, int]]:
    """Row ranges that hold at most so many bytes and rows, or a single row."""
    start, rows = 0, len(offsets) - 1
    while start < rows:
        stop = int(np.searchsorted(offsets, offsets[start] + most_bytes, side="right")) - 1
        stop = min(max(stop, start + 1), start + most_rows, rows)
        yield start, stop
        start = stop


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word, in order, and the number of words of every text."""
    n = len(raw)
    if not n:
        return np.zeros(0, _U), np.zeros(len(offsets) - 1, np.int64)
    inside = IS_WORD[raw]
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    total = np.zeros(n + 1, _U)
    np.cumsum(BYTE_VALUE[raw] * powers(_BASE, n - 1), out=total[1:])
    hashes = splitmix((total[ends] - total[starts]) * powers(_BASE_INVERSE, n - 1)[starts])
    return hashes, np.diff(np.searchsorted(starts, offsets))


def sequence_keys(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit keys of every text's whole word sequence."""
    stops = np.cumsum(counts)
    starts, n, keys = stops - counts, len(hashes), []
    for salt, base in ((0x5851F42D4C957F2D, 0xD1342543DE82EF95), (0x14057B7EF767814F, 0xAF251AF3B0F025B5)):
        total = np.zeros(n + 1, _U)
        np.cumsum(splitmix(hashes ^ _U(salt)) * powers(base, max(n - 1, 0))[:n], out=total[1:])
        back = powers(pow(base, -1, 1 << 64), n)
        keys.append(splitmix((total[stops] - total[starts]) * back[starts] + counts.astype(_U)))
    return keys[0], keys[1]


_PLACE = splitmix(np.arange(64, dtype=_U) + _U(0x51ED2701)) | _U(1)


def shingles(hashes: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hash) of every k-word shingle; a shorter text is a single shingle."""
    stops = np.cumsum(counts)
    starts = stops - counts
    owner = np.repeat(np.arange(len(counts)), counts)
    n = len(hashes) - k + 1
    found_owner, found = [np.zeros(0, np.int64)], [np.zeros(0, _U)]
    if n > 0:
        total = np.zeros(n, _U)
        for j in range(k):
            total += hashes[j : j + n] * _PLACE[j]
        whole = owner[:n] == owner[k - 1 : k - 1 + n]
        found_owner.append(owner[:n][whole])
        found.append(total[whole])
    for length in range(1, k):
        short = np.flatnonzero(counts == length)
        if len(short):
            total = np.full(len(short), length, _U)
            for j in range(length):
                total += hashes[starts[short] + j] * _PLACE[j]
            found_owner.append(short)
            found.append(total)
    return np.concatenate(found_owner), splitmix(np.concatenate(found))


def weighted(owner: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text index, 52-bit element) pairs in order, with their multiplicities.

    One sort of a combined 64-bit key; at most 4,096 texts at a time.
    """
    key = np.sort((owner.astype(_U) << _U(52)) | (hashes >> _U(12)))
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(first)
    key, count = key[at], np.diff(np.append(at, len(key)))
    return (key >> _U(52)).astype(np.int64), key & _U((1 << 52) - 1), count
