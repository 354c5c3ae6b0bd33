"""Arrow batches of texts as byte blocks, and rolling hashes over them in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text that are held as arrays at a time, unless one text alone is longer.
CHUNK = 2_000_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits (a fixed bijection)."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_PRIME, _31 = np.uint64((1 << 31) - 1), np.uint64(31)
#: Two fixed bases, drawn once, of polynomials modulo the prime 2 ** 31 - 1.
_BASES = (1_318_699_077, 752_918_453)
_powers = {(base, way): np.ones(1, np.uint64) for base in _BASES for way in (1, -1)}


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo the prime, or the prime itself for 0, for x under 2 ** 63."""
    x = (x & _PRIME) + (x >> _31)
    return (x & _PRIME) + (x >> _31)


def _power(base: int, n: int, way: int) -> np.ndarray:
    """base ** (way * i) modulo the prime, for i < n."""
    have = _powers[base, way]
    while len(have) < n:
        step = np.uint64(pow(base, way * len(have), int(_PRIME)))
        have = np.concatenate([have, _reduced(have * step)])
        _powers[base, way] = have
    return have[:n]


def prefix(values: np.ndarray) -> list[np.ndarray]:
    """For each base, sums of 31 bits of values[i] * base ** i; spans() makes hashes of any stretch of them."""
    out = []
    for base, bits in zip(_BASES, (values >> np.uint64(33), values & _PRIME), strict=True):
        sums = np.zeros(len(values) + 1, np.uint64)
        x = bits * _power(base, len(values), 1)
        np.cumsum((x & _PRIME) + (x >> _31), out=sums[1:])
        out.append(sums)
    return out


def spans(pre: list[np.ndarray], start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hash of values[start:stop], the same wherever it stands.

    Polynomials modulo a prime in two bases, 62 bits: sequences that differ collide by chance only (modulo a power of two
    they would not: a Thue-Morse word and its complement have one value there).
    """
    h = (stop - start).astype(np.uint64) * _ODD
    for base, sums in zip(_BASES, pre, strict=True):
        x = _reduced(_reduced(sums[stop] - sums[start]) * _power(base, len(sums), -1)[start])
        h = mix(h + np.where(x >= _PRIME, x - _PRIME, x))
    return h


def joined(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of values[i:i + k] for each i, by doubling."""
    have, out = 1, values
    while have < k:
        more = min(have, k - have)
        # the second half may overlap the first: both together still tell all k values
        out = _pair(out[: len(out) - more], out[more:])
        have += more
    return out


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = a * _M1 + b
    h ^= h >> np.uint64(29)
    h *= _M2
    h ^= h >> np.uint64(32)
    return h


def names(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hash of each data[start:stop], eight bytes at a time; of over a thousand bytes XXH64."""
    n = stop - start
    h = mix(n.astype(np.uint64) * _ODD + _M1)
    if not len(n):
        return h
    eight = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, np.uint8)]), 8)
    live, at = np.flatnonzero(n <= 1024), 0
    while len(live):
        left = np.minimum(n[live] - at, 8)
        word = eight[start[live] + at].view("<u8")[:, 0]
        word = np.where(left < 8, word & ((np.uint64(1) << (8 * left).astype(np.uint64)) - np.uint64(1)), word)
        h[live] = mix(_pair(h[live], word))
        at += 8
        live = live[n[live] > at]
    for i in np.flatnonzero(n > 1024):
        h[i] = xxhash.xxh64_intdigest(data[start[i] : stop[i]].tobytes(), 42)
    return h


def word_grams(word: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first) of the k-word shingles of each row; a row of fewer words has one, of no words none."""
    count = np.diff(first)
    size = np.where(count > 0, np.maximum(count - k + 1, 1), 0)
    at, end = ranges(first[:-1], size), np.repeat(first[1:], size)
    h = np.zeros(len(at), np.uint64)
    for i in range(k if len(at) else 0):
        h = _pair(h, np.where(at + i < end, word[np.minimum(at + i, len(word) - 1)], np.uint64(0)))
    return mix(h), np.r_[0, np.cumsum(size)]


def texts(batch: pa.RecordBatch, name: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    col = pc.fill_null(batch.column(name).cast(pa.large_binary()), b"")
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def chunks(batches: Iterator[pa.RecordBatch], name: str = "text", limit: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets from 0) of at most limit bytes, or of one text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = texts(batch, name)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
#: Bytes of words of letters and digits: ASCII ones, and all that is not ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop, first) of the runs of bytes with inside[byte]; words of row r are first[r]:first[r+1]."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    is_word = inside[data]
    begins = is_word.copy()
    begins[1:] &= ~is_word[:-1]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    begins[edge] = is_word[edge]
    ends = is_word.copy()
    ends[:-1] &= ~is_word[1:]
    ends[edge - 1] = is_word[edge - 1]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(start, offsets)


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Concatenation of start[i] + 0 .. length[i] - 1."""
    if not len(start):
        return np.zeros(0, np.int64)
    ends = np.cumsum(length)
    return np.arange(ends[-1]) + np.repeat(start - (ends - length), length)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of values[i:i+width] for each i."""
    have, out = 1, values
    while have < width:
        more = min(have, width - have)
        out = np.minimum(out[: len(out) - more], out[more:])
        have += more
    return out
