"""Token ids of a corpus as files of range-ANS coded blocks, and their reading.

A corpus folder has three tables. `ids`: the ids of each document, as the tokenizer gave them. `model`: the shared
frequency table (id, freq). `blocks`: rows of whole documents, in ascending key order over the sorted part files;
a row has the documents' keys and lengths, the coder's checkpoints, words and checksum (see ans.py), its part and
its first token within the part. Every block decodes by itself. Spark's writers commit the files, so a lost task is
simply run again; any file system that Spark can reach will do.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultline.llm import tokens
from faultline.llm.ans import Coder, quantise
from faultline.llm.common import chunks, texts_of, tidy, utf8_runs

#: Tokens after which a block is closed; a longer document is a block of its own.
BLOCK = 1 << 16
#: Bytes of text that a task cuts into pieces at once.
CUT_UP = 2 << 20
#: Blocks coded side by side.
ABREAST = 64
MODEL = "id int, freq long"
BLOCKS = "part int, block int, part_start long, doc_ids array<long>, sizes array<int>, n long, states binary, marks array<int>, words binary, checksum long"


def tokenise(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(doc_id, ids): the ids of each whole text and the end id, as little-endian unsigned 16-bit integers. A null
    text is empty: the end id alone."""

    def run(batches):
        encoder = tokens.byte_level(tokenizer)
        for batch in batches:
            keys, at = batch.column("doc_id"), 0
            for ids, sizes in encoder.runs(utf8_runs(batch.column("text"), CUT_UP)):
                n, ends = len(sizes), np.cumsum(sizes)
                whole = np.full(len(ids) + n, end_id, "<u2")
                for i, (a, b) in enumerate(zip((ends - sizes).tolist(), ends.tolist())):
                    whole[a + i : b + i] = ids[a:b]
                bounds = 2 * np.concatenate([[0], ends + np.arange(1, n + 1)])
                column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(bounds), pa.py_buffer(whole)])
                yield pa.RecordBatch.from_arrays([keys.slice(at, n), column.cast(pa.binary())], ["doc_id", "ids"])
                at += n

    if tokens.library(tokenizer).get_vocab_size() > 1 << 16 or end_id >= 1 << 16:
        raise ValueError("ids are kept in 16 bits")
    return texts_of(docs).mapInArrow(tidy(run), "doc_id long, ids binary")


def count_ids(ids: DataFrame) -> DataFrame:
    """(id, n): how often each id occurs in all documents; each task adds up its own first."""

    def run(batches):
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            values = [v.as_buffer() for v in batch.column("ids")]
            for a, b in chunks(values):
                total += np.bincount(np.frombuffer(b"".join(values[a:b]), "<u2"), minlength=1 << 16)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["id", "n"])

    return ids.mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))


def coder_of(model: DataFrame) -> Coder:
    """The coder of a frequency table; the table has at most one row for each id of the vocabulary."""
    freq = np.zeros(1 << 16, np.int64)
    for row in model.collect():
        freq[row["id"]] = row["freq"]
    return Coder(freq)


def _blocks(coder: Coder):
    def run(batches):
        part, block, start = TaskContext.get().partitionId(), 0, 0
        keys: list[list] = [[]]
        held: list[list] = [[]]

        def encoded(blocks):
            """Blocks coded side by side are padded to the longest, so one beyond BLOCK, a long document, is coded alone."""
            short = [b for b in blocks if len(b) <= BLOCK]
            coded = iter(coder.encode(short) if short else [])
            return [next(coded) if len(b) <= BLOCK else coder.encode([b])[0] for b in blocks]

        def flush():
            nonlocal block, start, keys, held
            kept = [(k, v) for k, v in zip(keys, held) if k]
            rows = []
            for (k, v), coded in zip(kept, encoded([np.concatenate(v).astype(np.int64) for _, v in kept])):
                rows.append({"part": part, "block": block, "part_start": start, "doc_ids": k, "sizes": [len(x) for x in v]} | coded)
                block, start = block + 1, start + coded["n"]
            keys, held = [[]], [[]]
            return pa.RecordBatch.from_pylist(rows, ARROW)

        size = 0
        for batch in batches:
            for key, value in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()):
                ids = np.frombuffer(value, "<u2")
                if size and size + len(ids) > BLOCK:
                    keys, held, size = [*keys, []], [*held, []], 0
                    if len(keys) > ABREAST:
                        yield flush()
                keys[-1].append(key)
                held[-1].append(ids)
                size += len(ids)
        if keys[-1]:
            yield flush()

    return run


ARROW = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("part_start", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("n", pa.int64()), ("states", pa.binary()), ("marks", pa.list_(pa.int32())), ("words", pa.binary()), ("checksum", pa.int64())])


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int) -> None:
    """Encode every document of `docs` into the corpus folder.

    Documents are in ascending key order, null keys first; rows that share a key are in the order of a hash of their ids. An
    empty table gives a folder without blocks. What the range exchange samples are keys and hashes, never texts.
    """
    spark = docs.sparkSession
    tokenise(docs, tokenizer, end_id).write.parquet(f"{folder}/ids")
    ids = spark.read.parquet(f"{folder}/ids")
    counts = np.zeros(1 << 16, np.int64)
    for row in count_ids(ids).collect():  # a row for each id of the vocabulary at most
        counts[row["id"]] = row["n"]
    freq = quantise(counts)
    spark.createDataFrame([(int(i), int(freq[i])) for i in np.flatnonzero(freq)], MODEL).write.parquet(f"{folder}/model")
    order = ["doc_id", F.xxhash64("ids")]
    ranged = ids.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.mapInArrow(_blocks(Coder(freq)), BLOCKS).write.parquet(f"{folder}/blocks")


def read(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids): the documents of a corpus folder, decoded; `ids` as little-endian
    uint32, their checksum over the same bytes, `start` the tokens of all documents before."""
    coder = coder_of(spark.read.schema(MODEL).parquet(f"{folder}/model"))
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    parts = blocks.groupBy("part").agg(F.sum("n").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part file
    offsets = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            for a in range(0, len(rows), ABREAST):
                some = rows[a : a + ABREAST]
                for row, ids in zip(some, coder.decode(some)):
                    sizes = np.array(row["sizes"], np.int64)
                    ends = np.cumsum(sizes)
                    raw, bounds = ids.astype("<u4").tobytes(), [0, *(4 * ends).tolist()]
                    own = [raw[x:y] for x, y in zip(bounds, bounds[1:])]
                    columns = [pa.array(row["doc_ids"], pa.int64()), pa.array(row["offset"] + row["part_start"] + ends - sizes), pa.array(sizes), pa.array([zlib.crc32(x) for x in own], pa.int64())]
                    columns += [pa.array(own, pa.binary())] if with_ids else []
                    yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    names = [c.split()[0] for c in schema.split(", ")]
    return blocks.join(F.broadcast(offsets), "part").mapInArrow(run, schema)
