"""Words of many texts at once: borders and 64-bit hashes by numpy, alike in every task and on every machine."""

from __future__ import annotations

import numpy as np

U = np.uint64
#: White space between words: space and 0x09 to 0x0D. Words are runs of anything else.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
_powers = {BASE: np.ones(1, U), INVERSE: np.ones(1, U)}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64; kept from call to call, doubled when short."""
    have = _powers[base]
    while len(have) < n:
        step = U(pow(base, len(have), 1 << 64))
        have = np.concatenate([have, have * step])
    _powers[base] = have if len(have) <= 1 << 21 else have[: 1 << 21]
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (Steele, Lea and Flood's SplitMix finaliser)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Words:
    """Texts side by side, a line feed after each: `data` their bytes, `ends[i]` where text i ends; of every word its
    `start`, `stop`, `hash` and, by `first[i]` to `first[i + 1]`, its text."""

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.ends = np.cumsum(sizes + 1) - 1
        self.begins = self.ends - sizes
        inside = ~SPACE[self.data]
        edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
        self.start, self.stop = edges[::2], edges[1::2]
        self.first = np.searchsorted(self.start, np.concatenate([self.begins, [len(self.data)]]))
        total = np.zeros(len(self.data) + 1, U)
        np.cumsum((self.data.astype(U) + U(1)) * powers(BASE, len(self.data)), out=total[1:])
        raw = (total[self.stop] - total[self.start]) * powers(INVERSE, len(self.data) + 1)[self.start]
        self.hash = mix(raw + (self.stop - self.start).astype(U) * U(0xD1B54A32D192ED03))

    def __len__(self):
        return len(self.ends)

    @property
    def counts(self) -> np.ndarray:
        """Words of each text."""
        return np.diff(self.first)

    @property
    def owner(self) -> np.ndarray:
        """Of each word, the number of its text."""
        return np.repeat(np.arange(len(self)), self.counts)

    def runs(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of n words within a text, and the place of each one's first word."""
        h = self.hash
        if len(h) < n:
            return np.zeros(0, U), np.zeros(0, np.int64)
        key = np.zeros(len(h) - n + 1, U)
        for k in range(n):
            key = key * U(BASE) + h[k : len(h) - n + 1 + k]
        owner = self.owner
        at = np.flatnonzero(owner[: len(key)] == owner[n - 1 :])
        return mix(key[at]), at

