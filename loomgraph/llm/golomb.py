"""Golomb-Rice codes of sorted 64-bit numbers, in numpy."""

from __future__ import annotations

import numpy as np


def encode(values: np.ndarray) -> tuple[int, bytes]:
    """Parameter and code of ascending unsigned numbers.

    Gaps are cut at bit ``k``, near the binary logarithm of their mean. The quotients come
    first, in unary, then the remainders with ``k`` bits each.
    """
    values = values.astype(np.uint64)
    if not len(values):
        return 0, b""
    gaps = np.diff(values, prepend=np.uint64(0))
    mean = max(1, int(values[-1]) // len(values))
    k = min(63, max(0, mean.bit_length() - 1))
    ends = np.cumsum((gaps >> np.uint64(k)).astype(np.int64) + 1)
    unary = np.zeros(int(ends[-1]), np.uint8)
    unary[ends - 1] = 1
    return k, np.packbits(unary).tobytes() + _low_bits(gaps, k)


def _low_bits(gaps: np.ndarray, k: int, step: int = 1 << 15) -> bytes:
    """The ``k`` lowest bits of every number, packed; ``step`` times ``k`` is a whole number of bytes."""
    parts = []
    for i in range(0, len(gaps) if k else 0, step):
        bits = np.unpackbits(gaps[i : i + step].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        parts.append(np.packbits(bits[:, 64 - k :]).tobytes())
    return b"".join(parts)


def decode(n: int, k: int, code: bytes, step: int = 1 << 15) -> np.ndarray:
    """The ``n`` numbers that ``encode`` was given."""
    if not n:
        return np.zeros(0, np.uint64)
    low = (n * k + 7) // 8
    data = np.frombuffer(code, np.uint8)
    ends = np.flatnonzero(np.unpackbits(data[: len(data) - low]))[:n]
    gaps = np.diff(ends, prepend=-1).astype(np.uint64) - np.uint64(1)
    gaps <<= np.uint64(k)
    rest = data[len(data) - low :]
    for i in range(0, n if k else 0, step):
        m = min(step, n - i)
        bits = np.zeros((m, 64), np.uint8)
        bits[:, 64 - k :] = np.unpackbits(rest[i * k // 8 : (i * k + m * k + 7) // 8])[: m * k].reshape(m, k)
        gaps[i : i + m] |= np.packbits(bits, axis=1).view(">u8").ravel().astype(np.uint64)
    return np.cumsum(gaps)
