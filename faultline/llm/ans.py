"""Static range asymmetric numeral system over token ids: coder and decoder of independent blocks.

A block holds `n` symbols dealt over LANES interleaved states: symbol i belongs to lane i % LANES. All lanes of
all blocks of a call advance together, so each step is a few numpy operations. A checkpoint (the states and
the place in the words) is kept every STEPS steps; a reader may start at any of them, and `decode` does, reading
all parts of all blocks side by side. States lie in [2^20, 2^52), where division in double precision is exact
once floored, and shed 32-bit words.
"""

from __future__ import annotations

import zlib

import numpy as np

from faultline.llm.common import spans_to_flat

LANES, STEPS, PRECISION = 128, 128, 20
LOW = 1 << PRECISION
WORD = 32


def quantise(counts: np.ndarray) -> np.ndarray:
    """Frequencies that add up to 2^PRECISION, at least 1 for every symbol that occurs."""
    counts = np.asarray(counts, np.int64)
    total = int(counts.sum())
    if total == 0:
        return np.zeros(len(counts), np.int64)
    whole = 1 << PRECISION
    if np.count_nonzero(counts) > whole:
        raise ValueError("more symbols than the precision can tell apart")
    freq = np.where(counts > 0, np.maximum(1, (counts.astype(np.float64) / total * whole).astype(np.int64)), 0)
    order = np.lexsort((np.arange(len(counts)), -freq))
    excess = int(freq.sum()) - whole
    if excess < 0:
        freq[order[0]] -= excess
    while excess > 0:  # take from the most frequent, each keeping one
        spare = np.minimum(freq[order] - 1, np.maximum(1, freq[order] * excess // max(1, int(freq.sum()))))
        take = np.minimum(spare, np.maximum(0, excess - (np.cumsum(spare) - spare)))
        freq[order] -= np.maximum(take, 0)
        excess = int(freq.sum()) - whole
    return freq


class Coder:
    """Shared frequency tables of all blocks."""

    def __init__(self, freq: np.ndarray):
        self.freq = np.asarray(freq, np.int64)
        self.first = np.cumsum(self.freq) - self.freq
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.int32), self.freq)

    def encode(self, blocks: list[np.ndarray]) -> list[dict]:
        """Each block as its states and word positions by checkpoint, its words, and a checksum of both."""
        if not blocks:
            return []
        sizes = np.array([len(b) for b in blocks])
        steps = -(-sizes // LANES)
        most, wide = int(steps.max()), len(blocks) * LANES
        symbols = np.zeros((len(blocks), most * LANES), np.int32)
        for row, b in zip(symbols, blocks):
            row[: len(b)] = b
        symbols = np.ascontiguousarray(symbols.reshape(len(blocks), most, LANES).transpose(1, 0, 2)).reshape(most, wide)
        left = np.repeat(sizes, LANES) - np.tile(np.arange(LANES), len(blocks))  # a lane is live at step t while t * LANES < left
        always = int(left.min() - 1) // LANES  # up to this step every lane is
        x = np.full(wide, LOW, np.int64)
        words, shed = np.zeros((most, wide), np.uint32), np.zeros((most, wide), bool)
        states = np.zeros((-(-most // STEPS), wide), np.int64)
        for t in range(most - 1, -1, -1):
            at = symbols[t].astype(np.int64)
            f, c = self.freq.take(at), self.first.take(at)
            if t > always:
                live = left > t * LANES
                f[~live] = 1
            over = x >= f << WORD
            if t > always:
                over &= live
            shed[t] = over
            full = np.flatnonzero(over)
            words[t, full] = x[full] & 0xFFFFFFFF
            x[full] >>= WORD
            quotient = (x / f).astype(np.int64)
            moved = (quotient << PRECISION) + (x - quotient * f) + c
            x = moved if t <= always else np.where(live, moved, x)
            if t % STEPS == 0:
                states[t // STEPS] = x
        out = []
        for b in range(len(blocks)):
            lanes, parts = slice(b * LANES, (b + 1) * LANES), -(-int(steps[b]) // STEPS)
            own = words[:, lanes][shed[:, lanes]].astype("<u4").tobytes()
            before = np.concatenate([[0], np.cumsum(shed[:, lanes].sum(1))])[: int(steps[b]) : STEPS]
            kept = states[:parts, lanes].astype("<u8").tobytes()
            out.append({"n": int(sizes[b]), "states": kept, "marks": before.tolist(), "words": own, "checksum": zlib.crc32(own, zlib.crc32(kept))})
        return out

    def decode(self, blocks: list[dict]) -> list[np.ndarray]:
        """The symbols of each block; raises on a damaged one."""
        starts, states, left, owner, stream, base = [], [], [], [], [], 0
        for k, b in enumerate(blocks):
            if zlib.crc32(b["words"], zlib.crc32(b["states"])) != b["checksum"]:
                raise ValueError("a block of token ids is damaged: its checksum differs")
            stream.append(np.frombuffer(b["words"], "<u4"))
            states.append(np.frombuffer(b["states"], "<u8").reshape(-1, LANES))
            for p, mark in enumerate(b["marks"]):
                starts.append(base + mark)
                left.append(min(STEPS * LANES, b["n"] - p * STEPS * LANES))
                owner.append(k)
            base += len(stream[-1])
        if not owner:
            return [np.zeros(0, np.int64) for _ in blocks]
        stream = np.concatenate(stream).astype(np.int64)
        x, at, left = np.concatenate(states).astype(np.int64), np.array(starts), np.array(left)
        lane, always = np.arange(LANES), int(left.min() - LANES) // LANES
        out = np.zeros((STEPS, len(left), LANES), np.int32)
        for t in range(-(-int(left.max()) // LANES)):
            slot = x & ((1 << PRECISION) - 1)
            s = self.symbol.take(slot).astype(np.int64)
            out[t] = s
            y = self.freq.take(s) * (x >> PRECISION) + slot - self.first.take(s)
            need = y < LOW
            if t > always:
                live = (left - t * LANES)[:, None] > lane
                need &= live
                y = np.where(live, y, x)
            counts = need.sum(1)
            short = np.flatnonzero(need)
            y.reshape(-1)[short] = (y.reshape(-1)[short] << WORD) | stream[spans_to_flat(at, counts)]
            x, at = y, at + counts
        parts = out.transpose(1, 0, 2).reshape(len(left), -1)
        owner = np.array(owner)
        return [np.concatenate([parts[i][: left[i]] for i in np.flatnonzero(owner == k)] or [np.zeros(0, np.int32)]).astype(np.int64) for k in range(len(blocks))]
