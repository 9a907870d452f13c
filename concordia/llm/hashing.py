"""Vectorised hashes of the words of a text."""

from __future__ import annotations

import numpy as np

_M = 0x9E3779B97F4A7C15
_BLOCK = 1 << 17
_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, 2 * len(_pow), 1 << 16)
        with np.errstate(over="ignore"):
            base = np.full(size, _M, np.uint64)
            base[0] = 1
            _pow = np.cumprod(base)
            base[1:] = pow(_M, -1, 1 << 64)
            _inv = np.cumprod(base)
    return _pow, _inv


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads each bit over all others."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(30))


def runs(kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of one class in kind, class 0 left out."""
    if not len(kind):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    starts, ends = np.concatenate(([0], cut)), np.concatenate((cut, [len(kind)]))
    keep = kind[starts] != 0
    return starts[keep], ends[keep]


def tokens(data: bytes, classes: np.ndarray, lower: np.ndarray, heads: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """(hash, class, first byte, length, hash of each head) of each run of a nonzero class; classes and lower are tables over bytes,
    a head is so many bytes at a run's start.

    Worked off in blocks that end at a class-0 byte, so memory follows the block and not the text.
    """
    raw = np.frombuffer(data, np.uint8)
    out, at = [], 0
    while at < len(raw):
        end = min(at + _BLOCK, len(raw))
        while end < len(raw) and classes[raw[end]]:
            end += 1
        part = raw[at:end]
        kind = classes[part]
        s, e = runs(kind)
        pw, inv = _powers(len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((lower[part].astype(np.uint64) + np.uint64(1)) * pw[: len(part)], out=total[1:])
        h = mix((total[e] - total[s]) * inv[s] + (e - s).astype(np.uint64))
        top = [mix((total[np.minimum(e, s + k)] - total[s]) * inv[s] + np.uint64(k << 32)) for k in heads]
        out.append((h, kind[s], part[s], e - s, *top))
        at = end
    if not out:
        none = [np.zeros(0, np.uint64) for _ in heads]
        return np.zeros(0, np.uint64), np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros(0, np.int64), *none
    return tuple(np.concatenate(x) for x in zip(*out))


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n consecutive values."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(m, n, np.uint64)
    for k in range(n):
        out = out * np.uint64(_M) + h[k : k + m]
    return mix(out)


SPACE = np.array([32, *range(9, 14)])
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32
#: Class 1: anything but white space.
WORDS = np.ones(256, np.uint8)
WORDS[SPACE] = 0
#: Class 1: letters, digits and bytes of longer characters; class 0: all else.
ALNUM = np.array([1 if b >= 128 or chr(b).isalnum() else 0 for b in range(256)], np.uint8)
#: Class 1 as in ALNUM; class 2: signs; class 0: white space.
MIXED = np.where(ALNUM == 1, 1, np.where(WORDS == 1, 2, 0)).astype(np.uint8)
