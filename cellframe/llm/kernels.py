"""Numpy kernels over the contiguous bytes of an Arrow text column."""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
import sys

import numpy as np
import pyarrow as pa

_U = np.uint64
#: An odd multiplier, so that products keep all bits of what is hashed.
_R = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows end to end, and the n + 1 row offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return byte_buffer(column.fill_null(""))


def byte_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """The same of strings or binaries, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    array = column.cast(pa.large_binary())
    if len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = array.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _padded(buf: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
    """A copy of the bytes (through a table) with eight more, so that eight can be read from each place."""
    out = np.zeros(len(buf) + 8, np.uint8)
    if table is None:
        out[: len(buf)] = buf
    else:
        np.take(table, buf, out=out[: len(buf)])
    return out


def _eights(padded: np.ndarray) -> np.ndarray:
    """View of the eight bytes from each place as one little-endian number."""
    return np.ndarray((len(padded) - 7,), "<u8", padded, 0, (1,))


#: By number of bytes: the mask of a number's lowest ones.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], _U)


def release() -> None:
    """Give a worker's free memory back to the system; workers live longer than tasks."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)


def window_hashes(buf: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """64-bit hashes of ``buf[i : i + length]`` for every i in ``at``: eight bytes after another are mixed in, so
    that no arithmetic relation between texts outlives a step."""
    eights = _eights(_padded(buf))
    out = np.full(len(at), _U(length * _R & _MASK))
    last = max(0, length - 8)
    for k in (*range(0, last, 8), last):
        out = mix((out * _U(_R)) ^ (eights[at + k] & _LOW[min(8, length)]))
    return out


def _lower_table() -> np.ndarray:
    low = np.arange(256, dtype=np.uint8)
    low[65:91] += 32
    return low


#: ASCII white space: U+0020 and U+0009 to U+000D.
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_LOWER = _lower_table()


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of other than ASCII white space), and n + 1 word offsets by row."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[buf]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    heads = offsets[:-1][np.diff(offsets) > 0]
    tails = offsets[1:][np.diff(offsets) > 0] - 1
    first[heads] = inside[heads]
    last[tails] = inside[tails]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


#: Longer words are hashed one by one.
_LONG_WORD = 64


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the words, independent ones by seed; A-Z count as a-z if ``lower``. Words of one length up
    to eight bytes never share a hash."""
    size = ends - starts
    out = mix(size.astype(_U) + _U((seed + 1) * _R & _MASK))
    if not len(buf):
        return out
    padded = _padded(buf, _LOWER if lower else None)
    eights = _eights(padded)
    of = np.flatnonzero((size > 0) & (size <= _LONG_WORD))
    for k in range(0, _LONG_WORD, 8):
        if k:
            of = of[size[of] > k]
        if not len(of):
            break
        out[of] = mix((out[of] * _U(_R)) ^ (eights[starts[of] + k] & _LOW[np.minimum(8, size[of] - k)]))
    for i in np.flatnonzero(size > _LONG_WORD).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(padded[starts[i] : ends[i]], digest_size=8, key=bytes([seed])).digest(), "little")
    return out


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams that start at each of the first len(h) - n + 1 words."""
    out = np.full(max(0, len(h) - n + 1), _U((n * 0xD6E8FEB86659FD93) & _MASK))
    for k in range(n):
        out = mix(out + h[k : len(h) - n + 1 + k] * _U((2 * k + 3) * _R & _MASK))
    return out


def shingle_sets(h: np.ndarray, word_offsets: np.ndarray, n: int, other: np.ndarray | None = None) -> list:
    """By row, the sorted distinct hashes of its n-word shingles; of all words as one if it has fewer than n.
    With ``other`` hashes of the words: pairs of these hashes and, in the same order, those by the others."""
    grams, out = ngram_hashes(h, n), []
    more = None if other is None else ngram_hashes(other, n)
    for a, b in zip(word_offsets[:-1].tolist(), word_offsets[1:].tolist()):
        if b - a < n:
            s = [ngram_hashes(x[a:b], b - a) if b > a else np.zeros(0, _U) for x in (h, other) if x is not None]
        elif more is None:
            s = [np.sort(grams[a : b - n + 1])]
        else:
            order = np.argsort(grams[a : b - n + 1])
            s = [grams[a : b - n + 1][order], more[a : b - n + 1][order]]
        new = np.concatenate([[True], s[0][1:] != s[0][:-1]])[: len(s[0])]
        out.append(s[0][new] if more is None else (s[0][new], s[1][new]))
    return out


def shingles(text: bytes, n: int) -> set[tuple[bytes, ...]]:
    """Distinct n-word shingles of a text, A-Z as a-z; all words as one if it has fewer than n."""
    words = text.lower().split()
    if len(words) < n:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(n))))
