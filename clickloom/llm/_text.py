"""Vectorised text kernels that the Arrow-based operators share.

Texts stay UTF-8 bytes in one buffer per slice. Words, their 64-bit hashes and
shingles come from whole-array numpy steps, so the cost per byte is a few
nanoseconds and memory is bounded by the slice, not by the Arrow batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: A slice holds at most so many bytes of text, or one document.
SLICE_BYTES = 1 << 19

_MULT = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_MULT), -1, 1 << 64))
_BLOCK = 1 << 22
#: Longest span that is hashed by a polynomial sum.
SHORT_SPAN = 32

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_table(separators: bytes) -> np.ndarray:
    """256 flags: which bytes belong to words, all but ``separators``."""
    flags = np.ones(256, dtype=bool)
    flags[list(separators)] = False
    return flags


#: Words ``[^\x20\x09-\x0D]+``.
SPACE_WORDS = word_table(b"\x20\x09\x0a\x0b\x0c\x0d")
#: Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z.
ALNUM_WORDS = word_table(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n, base, dtype=np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


_tables: dict[str, np.ndarray] = {}


def power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables.get("up", ())) < n:
        size = max(n, 1 << 16)
        _tables["up"], _tables["down"] = _powers(_MULT, size), _powers(_INV, size)
    return _tables["up"], _tables["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser of 64-bit values (the public splitmix64 steps)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls are empty."""
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        kind = np.int32
    else:
        kind = np.int64
    if column.null_count:
        column = column.fill_null("" if "string" in str(column.type) else b"")
    _, offsets, data = column.buffers()
    n = len(column)
    at = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, at


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most ``limit`` bytes, or of one document."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def words_of(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of the documents ``data[offsets[k]:offsets[k + 1]]`` of one slice.

    Returns lower-cased bytes, word starts, word ends (both into those bytes)
    and, for each document and the end, the index of its first word.
    """
    base = int(offsets[0])
    low = LOWER[data[base : int(offsets[-1])]]
    at = offsets - base
    if not len(low):
        return low, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = is_word[low]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    edge = at[1:-1]
    before[edge[edge < len(low)]] = False
    after[edge[edge > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return low, starts, ends, np.searchsorted(starts, at)


def hash_spans(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans, equal for equal spans wherever they stand.

    Spans of up to ``SHORT_SPAN`` bytes are polynomial sums modulo 2**64, all in one go.
    Such sums can't tell some long spans of regular build apart, so longer ones are
    hashed by themselves. A very long document is summed in blocks, so the running
    sums need no more than a block's memory.
    """
    out = np.zeros(len(starts), dtype=np.uint64)
    up, down = power_table(min(len(low), _BLOCK + SHORT_SPAN) + 1)
    for b in range(0, max(len(low), 1), _BLOCK):
        part = low[b : b + _BLOCK + SHORT_SPAN]  # short spans that begin in the block end in it
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=sums[1:])
        lo, hi = np.searchsorted(starts, b), np.searchsorted(starts, b + _BLOCK)
        s = starts[lo:hi] - b
        e = np.minimum(ends[lo:hi] - b, len(part))
        out[lo:hi] = (sums[e] - sums[s]) * down[s]
    out = mix(out ^ (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    for k in np.flatnonzero(ends - starts > SHORT_SPAN).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(low[starts[k] : ends[k]], digest_size=8).digest(), "little")
    return out


def shingles(hashes: np.ndarray, first: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """For each document its distinct shingle hashes, ascending; fewer words make one shingle."""
    factors = [np.uint64(pow(0xC2B2AE3D27D4EB4F, k + 1, 1 << 64)) for k in range(width)]
    n = len(hashes)
    if n >= width:
        whole = np.zeros(n - width + 1, dtype=np.uint64)
        for k, f in enumerate(factors):
            whole += hashes[k : n - width + 1 + k] * f
        whole = mix(whole)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            s = np.sort(whole[a : b - width + 1])
            yield s if len(s) == 1 else s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif b > a:
            short = np.array([b - a], dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25)
            for k in range(b - a):
                short = short + hashes[a + k : a + k + 1] * factors[k]
            yield mix(short)
        else:
            yield np.zeros(0, dtype=np.uint64)
