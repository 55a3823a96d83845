"""Vectorised text kernels over the bytes of many documents at once."""

from __future__ import annotations

import numpy as np

#: Bytes that a kernel takes at a time, unless one word or document is longer.
BLOCK = 1 << 19

_rng = np.random.default_rng(0x5EED)
#: A random 64-bit value for each byte.
BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
#: Base of the polynomial hashes and its inverse modulo 2^64.
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
#: Factors of the words in a shingle.
PLACE = _rng.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_VALUE = BYTE[_FOLD]


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over the output."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class _Powers:
    """Powers of the base and of its inverse, grown as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, BLOCK + 1)
            self.up, self.down = (np.concatenate(([np.uint64(1)], np.cumprod(np.full(size - 1, b, np.uint64)))) for b in (BASE, INVERSE))
        return self.up[:n], self.down[:n]


POWERS = _Powers()


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """S[i] = sum of values[j] * BASE^j for j < i, modulo 2^64."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * POWERS.get(len(values))[0], out=out[1:])
    return out


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, and the offset of each text's first word."""
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    lengths = np.array([len(t) for t in texts], np.int64)
    begins = np.concatenate(([0], np.cumsum(lengths + 1)))[:-1]
    blank = np.ones(len(data) + 2, bool)
    blank[1:-1] = _SPACE[data]
    starts = np.flatnonzero(blank[:-1] & ~blank[1:])
    ends = np.flatnonzero(~blank[:-1] & blank[1:])
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        base = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, base + BLOCK, side="right")))
        a, b = starts[at:to] - base, ends[at:to] - base
        sums = prefix_sums(_VALUE[data[base : base + int(b[-1])]])
        out[at:to] = (sums[b] - sums[a]) * POWERS.get(int(a[-1]) + 1)[1][a]
        at = to
    return mix(out), np.searchsorted(starts, np.append(begins, len(data) + 1))


def shingle_sets(texts: list[bytes], k: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its ``k``-word shingles; with fewer words, of all as one."""
    words, offsets = word_hashes(texts)
    n = max(0, len(words) - k + 1)
    rolled = np.zeros(n, np.uint64)
    for i in range(k):
        rolled += words[i : i + n] * PLACE[i]
    rolled = mix(rolled) >> np.uint64(1)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= k:
            got = np.sort(rolled[a : b - k + 1])
            fresh = np.empty(len(got), bool)
            fresh[0] = True
            np.not_equal(got[1:], got[:-1], out=fresh[1:])
            out.append(got[fresh])
        elif b > a:
            out.append(mix(np.array([np.sum(words[a:b] * PLACE[: b - a]) + np.uint64(b - a)], np.uint64)) >> np.uint64(1))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
