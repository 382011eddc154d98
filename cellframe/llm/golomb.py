"""Golomb-Rice coding of sorted hashes, by owners of equal hash ranges."""

from __future__ import annotations

import struct

import numpy as np

_U = np.uint64


def owner_of(h: np.ndarray, bits: int, owners: int) -> np.ndarray:
    """Owner of each hash of ``bits`` bits (32 to 64); not decreasing in the hash."""
    return (((h >> _U(bits - 32)) * _U(owners)) >> _U(32)).astype(np.int64)


def _base(owner: int, bits: int, owners: int) -> int:
    return -(-(owner << 32) // owners) << (bits - 32)


def _pack(values: np.ndarray, k: int) -> bytes:
    """The low k bits of each value: whole bytes as planes, then the bits that are left."""
    out = [(values >> _U(8 * i)).astype(np.uint8).tobytes() for i in range(k // 8)]
    if k % 8:
        rest = (values >> _U(k // 8 * 8)).astype(np.uint8) & np.uint8((1 << k % 8) - 1)
        out.append(np.packbits(np.unpackbits(rest[:, None], axis=1)[:, 8 - k % 8 :]).tobytes())
    return b"".join(out)


def _unpack(data: memoryview, n: int, k: int) -> np.ndarray:
    out = np.zeros(n, _U)
    for i in range(k // 8):
        out |= np.frombuffer(data[i * n : (i + 1) * n], np.uint8).astype(_U) << _U(8 * i)
    if r := k % 8:
        bits = np.unpackbits(np.frombuffer(data[k // 8 * n :], np.uint8))[: n * r].reshape(n, r)
        out |= (bits @ (1 << np.arange(r - 1, -1, -1))).astype(_U) << _U(k // 8 * 8)
    return out


def encode(h: np.ndarray, owner: int, bits: int, owners: int) -> bytes:
    """Sorted hashes of one owner: quotients in unary, remainders in k bits."""
    n = len(h)
    gap = max(1, (1 << bits) // owners // max(1, n))
    k = min(63, max(0, gap.bit_length() - 1))
    deltas = np.diff(h, prepend=_U(_base(owner, bits, owners)))
    q = (deltas >> _U(k)).astype(np.int64)
    ones = np.cumsum(q + 1) - 1
    unary = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
    unary[ones] = 1
    unary = np.packbits(unary).tobytes()
    return struct.pack("<IBI", n, k, len(unary)) + unary + _pack(deltas, k)


def decode(data: bytes, owner: int, bits: int, owners: int) -> np.ndarray:
    n, k, size = struct.unpack_from("<IBI", data)
    body = memoryview(data)[9:]
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(body[:size], np.uint8)))[:n]
    q = np.diff(ones, prepend=-1) - 1
    deltas = (q.astype(_U) << _U(k)) | _unpack(body[size:], n, k)
    return np.cumsum(deltas, dtype=_U) + _U(_base(owner, bits, owners))


def by_owner(h: np.ndarray, bits: int, owners: int):
    """(owner, start, stop) of each owner that has some of the sorted hashes."""
    cuts = np.searchsorted(owner_of(h, bits, owners), np.arange(owners + 1))
    for o in np.flatnonzero(np.diff(cuts)).tolist():
        yield o, int(cuts[o]), int(cuts[o + 1])
