"""What several operators share: reading the text column in tasks, chunks of bounded size, shared folders."""

from __future__ import annotations

import ctypes
import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.session import materialize, work_folder  # noqa: F401

#: Bytes of text that a task turns into words at once; one longer document is a chunk of its own.
CHUNK_BYTES = 1 << 20


def texts_of(docs: DataFrame, key: str = "doc_id", text: str = "text", null: str = "") -> DataFrame:
    """The key and the text alone: any other column of the input, whatever its name, stays out of the way."""
    return docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit(null)).alias("text"))


def key_type(docs: DataFrame, key: str = "doc_id") -> str:
    """The type of the key as Spark names it: results keep it."""
    return docs.schema[key].dataType.simpleString()


def free_name(name: str, taken: list[str]) -> str:
    """`name`, or that with underscores before it: one that is not taken, in any case of letters."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name = "_" + name
    return name


def release() -> None:
    """Give memory that is free but held by allocators back to the system. Python workers live on from stage to stage, so what one
    stage holds on to would be missing in the next."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run):
    """The task function `run`, which gives its memory back when it ends."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def utf8(column: pa.Array) -> list[bytes]:
    """The values of a string column as UTF-8 bytes, null as no bytes."""
    return [b"" if v is None else v for v in column.cast(pa.large_binary()).to_pylist()]


def spans(sizes: list[int], limit: int = CHUNK_BYTES):
    """(from, to) ranges of consecutive texts of about `limit` bytes each, by the bytes of each text."""
    start = held = 0
    for i, size in enumerate(sizes):
        if i > start and held + size > limit:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)


def chunks(texts: list[bytes], limit: int = CHUNK_BYTES):
    """(from, to) ranges of consecutive texts of about `limit` bytes each."""
    return spans([len(t) for t in texts], limit)


def utf8_runs(column: pa.Array, limit: int = CHUNK_BYTES):
    """Lists of consecutive values of a string column as UTF-8 bytes, about `limit` bytes each; null as no bytes."""
    for a, b in spans(pc.binary_length(column).fill_null(0).to_pylist(), limit):
        yield utf8(column.slice(a, b - a))


def spans_to_flat(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions starts[i] .. starts[i] + lengths[i] - 1 of every i, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


class PieceTable:
    """Token ids of distinct text pieces, encoded once and looked up for every occurrence.

    `encode` maps a list of unseen pieces to a list of id lists. The table starts anew once it holds `limit`
    pieces or `limit_bytes` of them, so a task's memory does not grow with its input.
    """

    def __init__(self, encode, limit: int = 1_000_000, limit_bytes: int = 64 << 20):
        self.encode, self.limit, self.limit_bytes = encode, limit, limit_bytes
        self._reset()

    def clear(self):
        """Forget all pieces, and the room that they took."""
        self._reset()

    def _reset(self):
        self.index: dict[bytes, int] = {}
        self.begin = np.zeros(1 << 12, np.int64)
        self.size = np.zeros(1 << 12, np.int64)
        self.flat = np.zeros(1 << 14, np.int32)
        self.used = self.held = 0

    def _add(self, pieces: list[bytes]) -> None:
        coded = self.encode(pieces)
        n, first = len(pieces), len(self.index)
        sizes = np.fromiter(map(len, coded), np.int64, n)
        new = np.fromiter(itertools.chain.from_iterable(coded), np.int32, int(sizes.sum()))
        while first + n > len(self.begin):
            self.begin, self.size = np.concatenate([self.begin, self.begin]), np.concatenate([self.size, self.size])
        while self.used + len(new) > len(self.flat):
            self.flat = np.concatenate([self.flat, self.flat])
        self.flat[self.used : self.used + len(new)] = new
        self.begin[first : first + n] = self.used + np.cumsum(sizes) - sizes
        self.size[first : first + n] = sizes
        self.index.update(zip(pieces, range(first, first + n)))
        self.used += len(new)
        self.held += sum(map(len, pieces))

    def __call__(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and how many each piece has."""
        if len(self.index) > self.limit or self.held > self.limit_bytes:
            self._reset()
        at = np.fromiter(map(self.index.get, pieces, itertools.repeat(-1)), np.int64, len(pieces))
        unseen = np.flatnonzero(at < 0)
        if len(unseen):
            new = [pieces[i] for i in unseen.tolist()]
            self._add(list(dict.fromkeys(new)))
            at[unseen] = np.fromiter(map(self.index.__getitem__, new), np.int64, len(new))
        sizes = self.size[at]
        return self.flat[spans_to_flat(self.begin[at], sizes)], sizes


def per_text(sizes: np.ndarray, counts: list[int]) -> np.ndarray:
    """Sum of `sizes` over consecutive runs of `counts` pieces each."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    at = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    return ends[at[1:]] - ends[at[:-1]]
