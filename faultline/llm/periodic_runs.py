"""Periodic runs of words by recompression.

The words of many texts stand in one sequence, each text with symbols of its own. Block compression names every stretch of one
repeated symbol, pair compression every neighbouring pair of a left and a right symbol; both in turn, until no symbol
occurs twice. Equal stretches are cut alike at every level but for their ends, so how far two places agree is found by a
climb through the levels and a descent, a few steps at each: no suffix array.

A run of period p and length 4p or more agrees with itself, p words on, over 3p places, one of them a multiple of 3p. So the
places 0, 3p, 6p, .. of every text and period are the only candidates: n/3 * (1 + 1/2 + 1/3 + ..) for n words.
"""

from __future__ import annotations

import itertools
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import chunks, spans_to_flat, texts_of, utf8
from faultline.llm.words import U, mix

#: A run is at least so long, and at least so many of its periods.
SHORTEST, TIMES = 6, 4
#: Bytes of text whose words make one sequence, and candidates that are looked at together.
STEP, TOGETHER = 1 << 20, 1 << 19


class Level:
    """One level's symbols and how they make up the next: symbol k above begins at `first[k]`, `up[i]` is the one above place i."""

    def __init__(self, text: np.ndarray, first: np.ndarray, up: np.ndarray, pairs: bool):
        self.text, self.first, self.up, self.pairs = text, first, up, pairs

    def mirrored(self) -> Level:
        return Level(self.text[::-1], len(self.text) - self.first[::-1], len(self.first) - 2 - self.up[::-1], self.pairs)


def _sides(text: np.ndarray, turn: int) -> np.ndarray:
    """Whether each symbol is a left one in this turn."""
    return mix(text.astype(U) * U(0x9E3779B97F4A7C15) + U(turn)) & U(1) == 0


class Grammar:
    """Run-length grammar of a sequence, whose first and last symbols occur once."""

    def __init__(self, text: np.ndarray):
        self.levels, self.size = [], len(text)
        self.names = int(text.max()) + 1
        text = text.astype(np.int32)
        for turn in itertools.count():
            if np.bincount(text, minlength=1).max() < 2:
                break
            text = self._pair(self._block(text), turn)

    def _next(self, text: np.ndarray, starts: np.ndarray, named: np.ndarray, key: np.ndarray, pairs: bool) -> np.ndarray:
        """The level above: symbols begin at `starts`; the `named` among them get a new symbol for each `key`."""
        above = text[starts]
        keys, name = np.unique(key, return_inverse=True)
        above[named] = self.names + name
        self.names += len(keys)
        begins = np.zeros(len(text), bool)
        begins[starts] = True
        first = np.append(starts, len(text)).astype(np.int32)
        self.levels.append(Level(text, first, np.cumsum(begins, dtype=np.int32) - np.int32(1), pairs))
        return above

    def _block(self, text: np.ndarray) -> np.ndarray:
        starts = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
        sizes = np.diff(starts, append=len(text))
        many = np.flatnonzero(sizes > 1)
        if not len(many):
            return text
        return self._next(text, starts, many, text[starts[many]].astype(np.int64) * (len(text) + 1) + sizes[many], False)

    def _pair(self, text: np.ndarray, turn: int) -> np.ndarray:
        left = _sides(text, turn)
        ahead, back = left[:-1] & ~left[1:], ~left[:-1] & left[1:]
        opens = np.flatnonzero(ahead if ahead.sum() >= back.sum() else back)
        if not len(opens):
            return text
        inner = np.zeros(len(text), bool)
        inner[opens + 1] = True
        starts = np.flatnonzero(~inner)
        return self._next(text, starts, np.searchsorted(starts, opens), text[opens].astype(np.int64) * self.names + text[opens + 1], True)

    def mirrored(self) -> Grammar:
        """The grammar of the sequence read backwards."""
        other = object.__new__(Grammar)
        other.levels, other.size, other.names = [x.mirrored() for x in self.levels], self.size, self.names
        return other

    def agree(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols from i and from j on are alike, i unequal to j, for each pair of places."""
        x, y = i.astype(np.int64), j.astype(np.int64)
        open_, stopped = np.arange(len(x)), []
        for level in self.levels:
            same = level.text[x[open_]] == level.text[y[open_]]
            stopped.append(open_[~same])
            open_ = open_[same]
            a, b = x[open_], y[open_]
            begin_a, begin_b = level.first[level.up[a]], level.first[level.up[b]]
            if level.pairs:  # the second of a pair is never the first of one, so both go on
                step = ((begin_a != a) | (begin_b != b)).astype(np.int64)
                differ = np.zeros(len(a), bool)
            else:
                left_a, left_b = level.first[level.up[a] + 1] - a, level.first[level.up[b] + 1] - b
                differ = left_a != left_b
                step = np.where(differ | (begin_a != a) | (begin_b != b), np.minimum(left_a, left_b), 0)
            a, b = a + step, b + step
            x[open_], y[open_] = np.where(differ, a, level.up[a]), np.where(differ, b, level.up[b])
            stopped[-1] = np.concatenate([stopped[-1], open_[differ]])
            open_ = open_[~differ]
        for level, own in zip(reversed(self.levels), reversed(stopped)):
            up_a, up_b = x[open_], y[open_]
            a, b = level.first[up_a].astype(np.int64), level.first[up_b].astype(np.int64)
            step = np.ones(len(a), np.int64) if level.pairs else np.minimum(level.first[up_a + 1] - a, level.first[up_b + 1] - b)
            step = np.where(level.text[a] == level.text[b], step, 0)
            x[open_], y[open_] = a + step, b + step
            open_ = np.concatenate([open_, own])
        return x - i


def sequence(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts as symbols, those of different texts different, between two symbols of their own; where each text begins."""
    counts = np.fromiter(map(len, texts), np.int64, len(texts))
    symbols = np.empty(int(counts.sum()) + 2, np.int64)
    begins = 1 + np.cumsum(counts) - counts
    fresh = itertools.count(1)
    for words, begin in zip(texts, begins.tolist()):
        own = defaultdict(fresh.__next__)
        symbols[begin : begin + len(words)] = np.fromiter(map(own.__getitem__, words), np.int64, len(words))
    symbols[0], symbols[-1] = 0, next(fresh)
    return symbols, begins


def candidates(counts: np.ndarray):
    """(text, place, period) of every candidate, about TOGETHER at a time."""
    periods = np.where(counts >= SHORTEST, counts // TIMES, 0)
    text = np.repeat(np.arange(len(counts)), periods)
    period = spans_to_flat(np.ones(len(counts), np.int64), periods)
    stride = (TIMES - 1) * period
    grid = -(-(counts[text] - period) // stride)
    slab = (np.cumsum(grid) - grid) // TOGETHER
    cuts = np.flatnonzero(np.diff(slab, prepend=-1, append=-1))
    for a, b in zip(cuts[:-1], cuts[1:]):
        many = grid[a:b]
        at = spans_to_flat(np.zeros(b - a, np.int64), many) * np.repeat(stride[a:b], many)
        yield np.repeat(text[a:b], many), at, np.repeat(period[a:b], many)


def runs_of(texts: list[list[bytes]]) -> np.ndarray:
    """(text, start, length, period) of every run, by text, start and period."""
    counts = np.fromiter(map(len, texts), np.int64, len(texts))
    symbols, begins = sequence(texts)
    grammar = back = None
    found = [np.zeros((0, 4), np.int64)]
    for text, at, period in candidates(counts):
        i = begins[text] + at
        hit = np.flatnonzero(symbols[i] == symbols[i + period])
        if not len(hit):
            continue
        if grammar is None:
            grammar = Grammar(symbols)
            back = grammar.mirrored()
        text, i, period = text[hit], i[hit], period[hit]
        after = grammar.agree(i, i + period)
        before = back.agree(len(symbols) - i, len(symbols) - i - period)
        length = before + after + period
        long = length >= np.maximum(SHORTEST, TIMES * period)
        found.append(np.stack([text, i - before - begins[text], length, period], axis=1)[long])
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (rows[1:, :3] != rows[:-1, :3]).any(axis=1)  # a stretch's multiples of its period come after it
    rows = rows[fresh]
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words, one space between, but for those in a run after its first period."""
    if not len(runs):
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 1] + runs[:, 3], 1)
    np.add.at(change, runs[:, 1] + runs[:, 2], -1)
    return b" ".join(itertools.compress(words, (np.cumsum(change[:-1]) == 0).tolist()))


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, runs, collapsed): of each row of `docs` the maximal periodic runs of its words, `[^\\x20\\x09-\\x0D]+`, as (start, length,
    period) by start and period, and its text without the words that a run repeats.

    A run is a stretch with smallest period q, of length 6 or more and 4q or more, that no neighbouring word continues. A null text
    is empty; a text without words has no run and collapses to the empty text; repeated rows give a row each; `doc_id` keeps its type
    and may be null. A very long text is a sequence of its own, in memory that grows with its words alone.
    """

    def run(batches):
        for batch in batches:
            texts = utf8(batch.column("text"))
            for a, b in chunks(texts, STEP):
                words = [t.split() for t in texts[a:b]]
                rows = runs_of(words)
                border = np.searchsorted(rows[:, 0], np.arange(b - a + 1))
                short = [collapsed(w, rows[border[k] : border[k + 1]]) for k, w in enumerate(words)]
                columns = pa.StructArray.from_arrays([pa.array(rows[:, c]) for c in (1, 2, 3)], ["start", "length", "period"])
                runs = pa.ListArray.from_arrays(pa.array(border, pa.int32()), columns)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), runs, pa.array(short, pa.binary()).cast(pa.string())], ["doc_id", "runs", "collapsed"])

    plain = texts_of(docs)
    return plain.mapInArrow(run, f"doc_id {plain.schema['doc_id'].dataType.simpleString()}, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def repeat_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text): the texts, one in ten with a tail that repeats. With h = crc32 of the decimal doc_id and g = h div 10,
    where h ends in 0, each of n words from a = g % n on becomes word a + (i - a) % p, p = 1 + (n - a) div (3 + g % 8)."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    plain = texts_of(docs)
    chosen = plain.withColumn("words", F.when(h % 10 == 0, words)).withColumn("n", F.greatest(F.size("words"), F.lit(1)))
    a = (g % F.col("n")).cast("int")
    p = (1 + F.floor((F.col("n") - a) / (3 + g % 8))).cast("int")
    block = F.slice("words", a + 1, p)
    times = F.ceil((F.col("n") - a) / p).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(block, times)), F.lit(1), F.col("n") - a)
    made = F.array_join(F.concat(F.slice("words", F.lit(1), a), tail), " ")
    return chosen.select("doc_id", F.when(F.size("words") > 0, made).otherwise(F.col("text")).alias("text"))
