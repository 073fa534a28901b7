"""Kernels over many texts at once, on the buffers of Arrow batches; nothing is put together as a Python string.

Texts of a batch are visited in pieces of bounded size, so a task's memory
follows neither the batch nor the table; one long text is a piece of its own.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes and rows of a piece.
PIECE_BYTES, PIECE_ROWS = 1 << 20, 1 << 13


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, np.uint32(0xEDB88320) ^ (c >> np.uint32(1)), c >> np.uint32(1))
    return c.astype(np.uint32)


_CRC = _crc_table()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null texts are empty."""
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    _, ends, data = column.buffers()
    at = np.frombuffer(ends, np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4)).astype(np.int64) if ends is not None and len(column) else np.zeros(len(column) + 1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)), at


def pieces(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets from 0) of runs of texts that are small together."""
    raw, at = utf8(column)
    lo, n = 0, len(column)
    while lo < n:
        hi = int(np.searchsorted(at, at[lo] + PIECE_BYTES, side="right")) - 1
        hi = min(max(hi, lo + 1), lo + PIECE_ROWS, n)
        yield lo, hi, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def characters(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte of each character and the end of all, row of each character)."""
    lead = (raw & 0xC0) != 0x80
    lead[at[:-1][at[:-1] < at[1:]]] = True
    begin = np.flatnonzero(lead)
    row = np.searchsorted(at, begin, side="right") - 1 if len(at) < 64 else np.repeat(np.arange(len(at) - 1), np.diff(np.searchsorted(begin, at)))
    return np.append(begin, len(raw)), row


def _crc32_grams(raw: np.ndarray, begin: np.ndarray, widths: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray]]:
    """(width, CRC-32 of the characters i to i + width) for each i; runs over a text's end are in it."""
    n = len(begin) - 1
    size = np.diff(begin)
    long = [np.flatnonzero(size > j) for j in range(1, 4)] if n != len(raw) else []
    state = np.full(n, 0xFFFFFFFF, dtype=np.uint32)
    for k in range(min(max(widths), n)):
        state = state[: n - k]
        own = raw[begin[k:n]]
        state = _CRC[(state ^ own) & np.uint32(0xFF)] ^ (state >> np.uint32(8))
        for j, which in enumerate(long, 1):
            some = which[np.searchsorted(which, k) :]
            s = state[some - k]
            state[some - k] = _CRC[(s ^ raw[begin[some] + j]) & np.uint32(0xFF)] ^ (s >> np.uint32(8))
        if k + 1 in widths:
            yield k + 1, ~state


def _rotl(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint32(by)) | (x >> np.uint32(32 - by))


def _mixed(k: np.ndarray) -> np.ndarray:
    return _rotl(k * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)


def _murmur_grams(raw: np.ndarray, begin: np.ndarray, widths: tuple[int, ...], seed: int = 42) -> Iterator[tuple[int, np.ndarray]]:
    """(width, MurmurHash3 of the characters i to i + width), as ``pyspark.ml``'s HashingTF has it."""
    padded = np.append(raw, np.zeros(24, np.uint8)).astype(np.uint32)
    four = padded[:-3] | padded[1:-2] << np.uint32(8) | padded[2:-1] << np.uint32(16) | padded[3:] << np.uint32(24)
    tail = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF], dtype=np.uint32)
    n = len(begin) - 1
    for w in widths:
        if w > n:
            continue
        s = begin[: n - w + 1]
        size = begin[w:] - s
        h = np.full(len(s), seed, dtype=np.uint32)
        for j in range(int(size.max()) // 4):
            step = _rotl(h ^ _mixed(four[s + 4 * j]), 13) * np.uint32(5) + np.uint32(0xE6546B64)
            h = np.where(size >= 4 * j + 4, step, h)
        h ^= _mixed(four[s + (size & ~3)] & tail[size & 3])
        h ^= size.astype(np.uint32)
        h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
        h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        yield w, h ^ (h >> np.uint32(16))


def gram_buckets(raw: np.ndarray, at: np.ndarray, buckets: int, widths: tuple[int, ...] = (3, 4, 5), kind: str = "crc32") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, count) of the character n-grams of each text, in order of row and bucket."""
    begin, row = characters(raw, at)
    keys = []
    for w, h in (_crc32_grams if kind == "crc32" else _murmur_grams)(raw, begin, widths):
        own = row[: len(h)]
        inside = own == row[w - 1 :]
        bucket = h.view(np.int32).astype(np.int64) % buckets if buckets & (buckets - 1) else (h & np.uint32(buckets - 1)).astype(np.int64)
        keys.append((own * buckets + bucket)[inside])
    key = np.concatenate(keys) if keys else np.empty(0, np.int64)
    narrow = (len(at) - 1) * buckets <= 1 << 32
    key = np.sort(key.astype(np.uint32) if narrow else key)
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
    count = np.diff(np.append(new, len(key)))
    key = key[new].astype(np.int64)
    return key // buckets, key % buckets, count


_CLASSES: list[np.ndarray] = []


def _classes() -> np.ndarray:
    """For each code point 0 for white space, 1 for a letter of a word, 2 for a sign, as :data:`WORD_OR_SIGN` has them."""
    if not _CLASSES:
        # Surrogates, which no text has, are left out of the string and its places moved back.
        every = "".join(map(chr, (*range(0xD800), *range(0xE000, sys.maxunicode + 1))))
        of = np.full(len(every), 2, dtype=np.uint8)
        for pattern, kind in ((r"\w+", 1), (r"\s+", 0)):
            for m in re.finditer(pattern, every):
                of[m.start() : m.end()] = kind
        _CLASSES.append(np.concatenate([of[:0xD800], np.full(0x800, 2, np.uint8), of[0xD800:]]))
    return _CLASSES[0]


def tokens(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(row, start, end, token) of the words and signs of each text; places are code points of the text."""
    points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
    begin, char_row = characters(raw, at)
    kind = _classes()[points]
    first = np.searchsorted(begin[:-1], at[:-1])
    word = kind == 1
    goes_on = np.append(False, word[1:] & word[:-1]) if len(word) else word
    goes_on[first[first < len(word)]] = False
    cut = np.flatnonzero(~goes_on)
    kept = kind[cut] != 0
    s, e = cut[kept], np.append(cut[1:], len(kind))[kept] if len(cut) else cut
    data = raw[np.repeat(kind != 0, np.diff(begin))]
    ends = np.append(0, np.cumsum(begin[e] - begin[s])).astype(np.int32)
    row = char_row[s]
    return row, (s - first[row]).astype(np.int32), (e - first[row]).astype(np.int32), pa.StringArray.from_buffers(len(s), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data)))


def _scattered(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def token_hashes(raw: np.ndarray, at: np.ndarray, base: int) -> np.ndarray:
    """A 64-bit hash of each string of a column, by its bytes and the odd number ``base``."""
    size = np.diff(at)
    powers = np.cumprod(np.full(int(size.max(initial=0)) + 1, base, dtype=np.uint64))
    raw, begin = raw[at[0] : at[-1]], at[:-1] - at[0]
    parts = (raw.astype(np.uint64) + np.uint64(1)) * powers[np.arange(len(raw)) - np.repeat(begin, size)]
    sums = np.add.reduceat(np.append(parts, np.uint64(0)), begin) if len(begin) else np.empty(0, np.uint64)
    return _scattered(np.where(size > 0, sums, np.uint64(0)))


def run_hashes(tokens: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` neighbours of hashed tokens."""
    n = max(len(tokens) - width + 1, 0)
    h = np.full(n, width, dtype=np.uint64)
    for k in range(width):
        h = _scattered(h * np.uint64(0x9E3779B97F4A7C15) + tokens[k : k + n])
    return h
