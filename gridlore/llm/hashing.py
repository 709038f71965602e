"""Rolling hashes of whole texts in numpy.

A chunk of texts is one byte buffer, texts separated by a line feed. Two sums of prefixes,
T[byte] * BASE**position modulo 2**64 and (byte + 1) * ROOT**position modulo the prime 2**31 - 1, give any
substring's hash as a difference of two prefixes times the base's inverse power: O(1) a substring, O(n)
a text. The prime is there because strings like the Thue-Morse word collide modulo a power of two for
every base; a hash mixes both sums.
"""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)
_APART = 0xD6E8FEB86659FD93
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
PRIME = (1 << 31) - 1
ROOT = 1220703125 % PRIME
_ROOT_INVERSE = pow(ROOT, -1, PRIME)
_residues: list[np.ndarray] = [np.ones(1, np.uint32), np.ones(1, np.uint32)]
#: Positions whose terms are summed before the sum is reduced.
_PIECE = 1 << 22


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n."""
    if len(_powers[0]) < n:
        for k, b in enumerate((BASE, _INVERSE)):
            x = np.full(n + n // 4, b, np.uint64)
            x[0] = 1
            _powers[k] = np.cumprod(x, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def reduced(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, for x below 2**63; in place."""
    m, shift = np.uint64(PRIME), np.uint64(31)
    for _ in range(2):
        high = x >> shift
        x &= m
        x += high
    np.subtract(x, m, out=x, where=x >= m)
    return x


def residues(n: int) -> tuple[np.ndarray, np.ndarray]:
    """ROOT**i and ROOT**-i modulo PRIME for i < n."""
    if len(_residues[0]) < n:
        size = n + n // 4
        for k, b in enumerate((ROOT, _ROOT_INVERSE)):
            x = np.ones(1, np.uint64)
            while len(x) < size:
                x = np.concatenate((x, reduced(x * np.uint64(pow(b, len(x), PRIME)))))
            _residues[k] = x[:size].astype(np.uint32)
    return _residues[0][:n], _residues[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (a bijection)."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


class Texts:
    """A chunk of texts: buf, the texts' starts and ends in it, and substring hashes."""

    def __init__(self, docs: list[bytes]):
        self.docs = docs
        self.buf = np.frombuffer(b"\n".join([*docs, b""]), np.uint8)
        size = np.fromiter(map(len, docs), np.int64, len(docs))
        self.ends = np.cumsum(size + 1) - 1
        self.starts = self.ends - size

    def prefixes(self) -> tuple[np.ndarray, np.ndarray]:
        """Both sums of the bytes before each position, the second one reduced."""
        n = len(self.buf)
        up, _ = powers(n + 1)
        out = np.empty(n + 1, np.uint64)
        out[0] = 0
        np.cumsum(_TABLE[self.buf] * up[:n], out=out[1:])
        root, _ = residues(n + 1)
        low, carry = np.zeros(n + 1, np.uint32), np.uint64(0)
        for a in range(0, n, _PIECE):
            x = self.buf[a : a + _PIECE].astype(np.uint64)
            x += np.uint64(1)
            x *= root[a : a + len(x)]
            np.cumsum(x, out=x)
            x += carry
            low[a + 1 : a + 1 + len(x)] = reduced(x)
            carry = np.uint64(low[a + len(x)])
        return out, low

    def spans(self, start: np.ndarray, end: np.ndarray, prefixes: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """The hashes of the bytes from start to end."""
        p, q = self.prefixes() if prefixes is None else prefixes
        _, down = powers(len(self.buf) + 1)
        _, back = residues(len(self.buf) + 1)
        low = q[end].astype(np.uint64)
        low += np.uint64(PRIME)
        low -= q[start]
        low *= back[start]
        return mix((p[end] - p[start]) * down[start] + reduced(low) * np.uint64(_APART) + (end - start).astype(np.uint64))

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the words [^\\x20\\x09-\\x0D]+, their hashes, and each text's first word (with the total last)."""
        space = _SPACE[self.buf]
        if not len(space):
            return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64), np.zeros(len(self.docs) + 1, np.int64))
        before = np.empty_like(space)
        before[0] = True
        before[1:] = space[:-1]
        start = np.flatnonzero(before & ~space)
        end = np.flatnonzero(space & ~before)
        h = self.spans(start, end)
        first = np.append(np.searchsorted(start, self.starts), len(start))
        return start, end, h, first

    def windows(self, size: int, prefixes: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """The hash of the `size` bytes from each position on (whatever texts they are in)."""
        n = len(self.buf) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        p, q = self.prefixes() if prefixes is None else prefixes
        _, down = powers(len(self.buf) + 1)
        _, back = residues(len(self.buf) + 1)
        low = q[size:].astype(np.uint64)
        low += np.uint64(PRIME)
        low -= q[:-size]
        low *= back[:n]
        low = reduced(low)
        low *= np.uint64(_APART)
        low += (p[size:] - p[:-size]) * down[:n]
        return mix(low)


def grams(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of the `size` word hashes from each word on."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(size):
        h *= np.uint64(BASE)
        h += words[j : j + n]
        h ^= h >> np.uint64(29)
    return mix(h)


def inside(ends: np.ndarray, starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of n positions begin a run of `size` units that stays in one text, texts given by starts and ends."""
    return cover(starts, np.maximum(ends - size + 1, starts), n)


def leftmost_minimum(h: np.ndarray, size: int) -> np.ndarray:
    """For each window of `size` hashes the position of its smallest (by upper half, the leftmost of equals)."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    span = 1
    while span * 2 <= size:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    rest = size - span
    key = np.minimum(key[:n], key[rest : rest + n])
    return (key & np.uint64(0xFFFFFFFF)).astype(np.int64)


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    edge = np.diff(np.concatenate(([False], flags, [False])).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def cover(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in any of the intervals."""
    if not len(starts):
        return np.zeros(n, bool)
    step = np.bincount(np.minimum(starts, n), minlength=n + 1)
    step -= np.bincount(np.minimum(ends, n), minlength=n + 1)
    return np.cumsum(step[:n]) > 0


def isin_sorted(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Membership in a sorted table by binary search."""
    if not len(table) or not len(values):
        return np.zeros(len(values), bool)
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return table[at] == values
