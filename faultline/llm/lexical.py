"""Ranked lexical search with bit-sliced Bloom signatures.

The index has blocks of documents of like vocabulary size. A block is a bit matrix: a row for every place of a Bloom filter, a bit
in it for every document. A term that stands 2^l times or more in a document sets PLACES bits for each level up to l. The
rows of a term and level, joined by AND, are a bitmap of all documents that may hold it so often, and of a few others; the
weighted sum of the bitmaps of an item's terms is an upper bound of each document's score. Documents whose bound stays below the
tenth best score seen are left; all others are scored from their whole text.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.common import chunks, materialize, texts_of, utf8

#: Fixed values of the score: parts of the length term in a hundred, and the scale of a term's share.
BASE, SLOPE, SCALE, LENGTH = 10, 90, 1_000_000_000, 8
#: Bits that a term and level sets, and rows for each bit of a block's largest document: a quarter of the bits is set at most.
PLACES, SPARE = 4, 3.5
#: Documents of a block, bytes of a block's matrix, bytes of text that are read into blocks together.
BLOCK, MATRIX_BYTES, STEP = 1024, 1 << 20, 1 << 22
#: Items, and bytes of their texts, that one pass over the index answers.
ITEMS, ITEM_BYTES = 256, 1 << 22
#: Documents of a block that are scored first for each item, to raise the score to beat.
FIRST = 16
#: Letters, digits and all beyond ASCII stay, A-Z as a-z; anything else parts terms.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def hashes(vocabulary: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers for each term, from which its places come."""
    h = np.fromiter(map(xxhash.xxh64_intdigest, vocabulary), np.uint64, len(vocabulary))
    return (h & np.uint64(0xFFFFFFFF)).astype(np.int64), (h >> np.uint64(33)).astype(np.int64) | 1


def places(h: tuple[np.ndarray, np.ndarray], level, rows: int) -> np.ndarray:
    """PLACES rows of each term at its level."""
    turn = np.asarray(level)[..., None] * PLACES + np.arange(PLACES)
    return (h[0][:, None] + turn * h[1][:, None]) % rows


def blocks_of(keys: list, texts: list[bytes]):
    """Blocks of the documents that hold a term, as dicts; the first one carries the terms of all and in how many documents each is."""
    ids: defaultdict = defaultdict(itertools.count().__next__)
    own = [terms(t) for t in texts]
    sizes = np.fromiter(map(len, own), np.int64, len(own))
    flat = np.fromiter(map(ids.__getitem__, itertools.chain.from_iterable(own)), np.int64, int(sizes.sum()))
    del own
    vocabulary = list(ids)
    entry, often = np.unique(np.repeat(np.arange(len(texts)), sizes) * max(1, len(vocabulary)) + flat, return_counts=True)
    doc, term = np.divmod(entry, max(1, len(vocabulary)))
    levels = np.frexp(often)[1]
    marks = np.bincount(doc, levels, len(texts)).astype(np.int64)
    first = np.searchsorted(doc, np.arange(len(texts) + 1))
    h = hashes(vocabulary)
    found = {"terms": vocabulary, "df": np.bincount(term, minlength=len(vocabulary))}
    order = [d for d in np.argsort(-marks, kind="stable").tolist() if marks[d]]
    while order:
        rows = int(marks[order[0]] * PLACES * SPARE) + 64
        n = max(8, min(BLOCK, 8 * MATRIX_BYTES // rows))
        some, order = order[:n], order[n:]
        bits = np.zeros((rows, -(-len(some) // 8) * 8), bool)
        for column, d in enumerate(some):
            at = slice(first[d], first[d + 1])
            for level in range(int(levels[at].max())):
                t = term[at][levels[at] > level]
                bits[places((h[0][t], h[1][t]), level, rows).ravel(), column] = True
        yield {
            "ids": [keys[d] for d in some], "sizes": sizes[some], "texts": [texts[d] for d in some], "rows": rows,
            "levels": int(max(levels[first[d] : first[d + 1]].max() for d in some)), "bits": np.packbits(bits, axis=1).tobytes(), **found,
        }
        found = {"terms": [], "df": np.zeros(0, np.int64)}


def index(docs: DataFrame) -> DataFrame:
    """The index of `docs`, a row for each block, written once. Documents without a term, null ones too, are in no block: no item
    finds them. Repeated rows are documents of their own; `doc_id` keeps its type and may be null."""
    plain = texts_of(docs)
    key = plain.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts, keys = utf8(batch.column("text")), batch.column("doc_id")
            for a, b in chunks(texts, STEP):
                own = keys.slice(a, b - a).to_pylist()
                for x in blocks_of(own, texts[a:b]):
                    columns = [
                        pa.array([x["ids"]], pa.list_(keys.type)), pa.array([x["sizes"]], pa.list_(pa.int64())), pa.array([[t.decode() for t in x["texts"]]], pa.list_(pa.string())), pa.array([x["rows"]], pa.int64()),
                        pa.array([x["levels"]], pa.int32()), pa.array([x["bits"]], pa.binary()), pa.array([[t.decode() for t in x["terms"]]], pa.list_(pa.string())), pa.array([x["df"]], pa.list_(pa.int64())),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["ids", "sizes", "texts", "rows", "levels", "bits", "terms", "df"])

    schema = f"ids array<{key}>, sizes array<long>, texts array<string>, rows long, levels int, bits binary, terms array<string>, df array<long>"
    return materialize(plain.mapInArrow(run, schema), "lexical-index")


def totals(blocks: DataFrame) -> tuple[int, int]:
    """Documents with a term, and terms with their repeats."""
    row = blocks.select(F.size("ids").alias("n"), F.aggregate("sizes", F.lit(0).cast("long"), lambda s, x: s + x).alias("l")).agg(F.sum("n"), F.sum("l")).first()
    return row[0] or 0, row[1] or 0


def frequencies(blocks: DataFrame, wanted: list[bytes]) -> np.ndarray:
    """In how many documents each wanted term is."""

    def run(batches):
        known = pa.array([t.decode() for t in wanted], pa.string())
        total = np.zeros(len(wanted), np.int64)
        for batch in batches:
            at = pc.index_in(batch.column("terms").flatten(), value_set=known)
            df = batch.column("df").flatten().filter(at.is_valid()).to_numpy(zero_copy_only=False)
            total += np.bincount(at.drop_null().to_numpy(zero_copy_only=False), df, len(wanted)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total)), pa.array(total[total > 0])], ["at", "n"])

    out = np.zeros(len(wanted), np.int64)
    for row in blocks.select("terms", "df").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():  # a row for each wanted term
        out[row["at"]] = row["n"]
    return out


class Search:
    """Some items, ready to be looked up in blocks: best documents so far of each."""

    def __init__(self, items: list[list[bytes]], wanted: list[bytes], weights: np.ndarray, n: int, total: int, k: int):
        self.n, self.total, self.k = n, total, k
        used = {t: i for i, t in enumerate(wanted)}
        self.number, self.weights, self.hashes = used, weights, hashes(wanted)
        self.items = [np.array([i for i in map(used.__getitem__, own) if weights[i] > 0], np.int64) for own in items]
        self.best: list[list[tuple]] = [[] for _ in items]

    def least(self, item: int) -> int:
        """The score that a document of this item must reach."""
        best = self.best[item]
        return max(1, -best[-1][0]) if len(best) == self.k else 1

    def shares(self, often, length: np.ndarray) -> np.ndarray:
        return SCALE * often // (1000 * often + LENGTH * length)

    def bounds(self, bits: np.ndarray, levels: int, length: np.ndarray) -> np.ndarray:
        """An upper bound of each item's score of each document of a block."""
        out = np.zeros((len(self.items), len(length)), np.int64)
        here, before = np.full((len(self.weights), bits.shape[1]), 255, np.uint8), np.zeros(len(length), np.int64)
        live = np.arange(len(self.weights))
        for level in range(levels):
            here[live] &= np.bitwise_and.reduce(bits[places((self.hashes[0][live], self.hashes[1][live]), level, len(bits))], axis=1)
            live = live[here[live].any(axis=1)]
            mask = np.zeros(len(self.weights), bool)
            mask[live] = True
            most = self.shares(np.int64((2 << level) - 1), length)
            for item, own in enumerate(self.items):
                own = own[mask[own]]
                if len(own):
                    held = np.unpackbits(here[own], axis=1, count=len(length))
                    out[item] += (most - before) * (self.weights[own].astype(np.float64) @ held).astype(np.int64)  # whole numbers below 2^53
            before = most
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """How often each wanted term is in each text."""
        out = np.zeros((len(texts), len(self.weights)), np.int32)
        for row, text in enumerate(texts):
            for term, often in Counter(terms(text)).items():
                at = self.number.get(term)
                if at is not None:
                    out[row, at] = often
        return out

    def add(self, block: dict) -> None:
        """Look all items up in a block."""
        sizes = np.array(block["sizes"], np.int64)
        length = 100 - SLOPE + SLOPE * sizes * self.n // self.total
        bits = np.frombuffer(block["bits"], np.uint8).reshape(block["rows"], -1)
        bounds = self.bounds(bits, block["levels"], length)
        done = np.zeros(bounds.shape, bool)
        for turn in range(2):
            asked = bounds >= np.array([self.least(i) for i in range(len(self.items))])[:, None]
            asked &= ~done
            if not turn and bounds.shape[1] > FIRST:
                cut = -np.partition(-bounds, FIRST - 1, axis=1)[:, FIRST - 1 : FIRST]
                asked &= bounds >= cut
            done |= asked
            docs = np.flatnonzero(asked.any(axis=0))
            for a in range(0, len(docs), 128):
                self._score(block, docs[a : a + 128], asked, length)

    def _score(self, block: dict, docs: np.ndarray, asked: np.ndarray, length: np.ndarray) -> None:
        often = self.scores([block["texts"][d] for d in docs.tolist()])
        for item in np.flatnonzero(asked[:, docs].any(axis=1)).tolist():
            own = np.flatnonzero(asked[item, docs])
            held = often[np.ix_(own, self.items[item])].astype(np.int64)
            score = self.shares(held, length[docs[own]][:, None]) @ self.weights[self.items[item]]
            good = np.flatnonzero(score >= self.least(item))
            if len(good):
                new = [(-s, key is None, key) for s, key in zip(score[good].tolist(), (block["ids"][d] for d in docs[own[good]].tolist()))]
                self.best[item] = heapq.nsmallest(self.k, self.best[item] + new)


def _groups(items: DataFrame):
    """The distinct (item_id, text) in groups of about ITEMS rows, by hash."""
    rows = materialize(items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct(), "items")
    n, size = rows.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    parts = max(-(-n // ITEMS), -(-(size or 0) // ITEM_BYTES))
    for part in range(parts):
        yield rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).collect()


def search(blocks: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): of every item the k documents of highest score above 0, ties by ascending doc_id, null last.

    A term's weight is floor(1000 ln((2N + 2) / (2 df + 1))), a document's length term m = 10 + (90 n N) div L; a document scores
    weight * ((10^9 tf) div (1000 tf + 8 m)), summed over the distinct terms of the item. Items without a term, null ones too, find
    nothing; rows that repeat item_id and text are one item, an item_id with two texts is two, each with its own ranks. Items go
    through the index ITEMS at a time; a task gives k rows for each, and these are ranked in two steps.
    """
    n, total = totals(blocks)
    key = blocks.schema["ids"].dataType.elementType.simpleString()
    kind = items.schema["item_id"].dataType.simpleString()
    schema = f"part long, item int, doc_id {key}, score long"
    found = None
    for number, group in enumerate(_groups(items)) if n else ():
        own = [list(dict.fromkeys(terms(r["text"].encode()))) for r in group]
        wanted = list(dict.fromkeys(itertools.chain.from_iterable(own)))
        df = frequencies(blocks, wanted)
        weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) if d else 0 for d in df.tolist()], np.int64)

        def run(batches, own=own, wanted=wanted, weights=weights):
            look = Search(own, wanted, weights, n, total, k)
            for batch in batches:
                for row in range(batch.num_rows):
                    block = batch.slice(row, 1)
                    texts = utf8(block.column("texts").flatten())
                    look.add({c: block.column(c)[0].as_py() for c in ("ids", "sizes", "rows", "levels", "bits")} | {"texts": texts})
            rows = [(item, b[2], -b[0]) for item, best in enumerate(look.best) for b in best]
            columns = list(zip(*rows)) or [(), (), ()]
            arrow = batch.column("ids").type.value_type if rows else None
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], arrow), pa.array(columns[2], pa.int64())], ["item", "doc_id", "score"])

        local = blocks.select("ids", "sizes", "texts", "rows", "levels", "bits").mapInArrow(run, schema.partition(", ")[2])
        names = blocks.sparkSession.createDataFrame([(i, r["item_id"]) for i, r in enumerate(group)], f"item int, item_id {kind}")
        order = (F.desc("score"), F.asc_nulls_last("doc_id"))
        some = local.withColumn("part", F.spark_partition_id() % 32)
        some = some.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).where(F.col("rank") <= k)
        some = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
        some = some.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        found = some if found is None else found.unionByName(some)
    return found if found is not None else blocks.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id {key}, score long")
