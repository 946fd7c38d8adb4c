"""Vectorised byte-level text kernels for Arrow batches: words, hashes, shingles.

Texts are taken as UTF-8 bytes. A word is a maximal run of digits, letters A-Z and a-z, and bytes from 0x80 on
(every non-ASCII character); A-Z are folded to a-z. All functions treat every document as a separate sequence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_rng = np.random.default_rng(20240607)
#: A random odd 64-bit number for every byte, and the base of the rolling word hash with its inverse modulo 2^64.
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 2**64)
WORD_BYTE = np.zeros(256, dtype=bool)
WORD_BYTE[ord("0") : ord("9") + 1] = True
WORD_BYTE[ord("A") : ord("Z") + 1] = True
WORD_BYTE[ord("a") : ord("z") + 1] = True
WORD_BYTE[128:] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[ord("A") : ord("Z") + 1] += 32
FOLDED_CODE = BYTE_CODE[FOLD]
#: Bytes that one vectorised step holds; its scratch arrays are about 60 times as large.
BLOCK = 1 << 18
_POWERS: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit words with good avalanche."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base of rolling hashes, and of its inverse."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, BLOCK)
        _POWERS[:] = [np.cumprod(np.concatenate([[U64(1)], np.full(size - 1, base, dtype=np.uint64)]), dtype=np.uint64) for base in (_BASE, _BASE_INV)]
    return _POWERS[0], _POWERS[1]


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string or binary column; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def spans(offsets: np.ndarray, most: int = 4 * BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of documents that hold about ``most`` bytes each, one document at least."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every folded word in order, and the number of words of each document."""
    n, docs = len(data), len(offsets) - 1
    hashes, ends = [], []
    lo = 0
    while lo < n:
        hi = min(lo + BLOCK, n)
        if hi < n:  # cut between words
            gaps = np.flatnonzero(~WORD_BYTE[data[lo:hi]])
            if len(gaps):
                hi = lo + int(gaps[-1]) + 1
            else:
                after = np.searchsorted(offsets, lo, side="right")
                inside = offsets[after : after + 1]
                if len(inside) and inside[0] < hi:
                    hi = int(offsets[np.searchsorted(offsets, hi, side="right") - 1])
                else:
                    stop = int(inside[0]) if len(inside) else n
                    while hi < stop and WORD_BYTE[data[hi]]:
                        hi += 1
        part = data[lo:hi]
        first = offsets[np.searchsorted(offsets, lo, side="left") : np.searchsorted(offsets, hi, side="left")] - lo
        inside_word = WORD_BYTE[part]
        starts_here = inside_word.copy()
        starts_here[1:] &= ~inside_word[:-1]
        starts_here[first] = inside_word[first]
        ends_here = inside_word.copy()
        ends_here[:-1] &= ~inside_word[1:]
        before = first[first > 0] - 1
        ends_here[before] = inside_word[before]
        start, end = np.flatnonzero(starts_here), np.flatnonzero(ends_here) + 1
        power, inverse = powers(len(part))
        total = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(FOLDED_CODE[part] * power[: len(part)], out=total[1:])
        hashes.append(mix((total[end] - total[start]) * inverse[start]))
        ends.append(start + lo)
        lo = hi
    if not hashes:
        return np.zeros(0, dtype=np.uint64), np.zeros(docs, dtype=np.int64)
    at = np.concatenate(ends)
    bounds = np.searchsorted(at, offsets, side="left")
    return np.concatenate(hashes), np.diff(bounds)


_PLACE = _rng.integers(1, 2**63, 64, dtype=np.uint64) | U64(1)


def shingles(words: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of ``size`` words, and how many each document has.

    A document of fewer words, but not none, has one shingle: all of its words.
    """
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    per_doc = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    total = int(per_doc.sum())
    if not total:
        return np.zeros(0, dtype=np.uint64), per_doc
    lead = np.repeat(first - np.concatenate([[0], np.cumsum(per_doc)])[:-1], per_doc) + np.arange(total)
    out = np.zeros(total, dtype=np.uint64)
    room = np.repeat(np.minimum(counts, size), per_doc)
    short = bool((room < size).any())
    for j in range(size):
        if short:
            there = room > j
            out[there] += words[lead[there] + j] * _PLACE[j]
        else:
            out += words[lead + j] * _PLACE[j]
    return mix(out + room.astype(np.uint64)), per_doc
