"""Quality rules: text statistics, and a log-likelihood ratio between a trusted target and the raw corpus.

Both corpora are multinomials over hashed n-grams (runs of GRAM bytes of UTF-8, BUCKETS buckets). A document's
score is the mean, over its n-grams, of log p(target) - log p(raw); every document is compared with one fixed threshold.
The raw counts are of all documents, from a pass without a join. The target counts are of all trusted documents: a bit for
each hash of a trusted key, FILTER_BITS in all, tells which texts may be trusted, and only these move to the join by key that
tells which are. The plan is the same at every size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import chunks, key_type, release, texts_of, tidy, utf8
from faultline.llm.words import Words

GRAM, BUCKETS = 4, 1 << 15
#: A document is kept at this mean log ratio or more: on the average n-gram at most e^0.5 times likelier raw than trusted.
#: A language that a small target holds little of costs up to 0.35; symbols, tables and capitals cost 0.8 and more. On a whole
#: target of 88,145 documents -0.2 and -0.5 part alike: 6,952 and 6,941 of 7,081 bad ones go, and none of 85,070 good ones.
LEAST = -0.5
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
REPEAT = 8
STEP = 1 << 18
#: Bits of the filter of trusted keys, in words of 64: 262,144 rows at most. It spares moves, never rows.
FILTER_BITS = 1 << 24


def grams(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram that lies within a text, and its text."""
    data = words.data
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = np.zeros(n, np.uint32)
    for k in range(GRAM):
        code = (code << np.uint32(8)) | data[k : n + k]
    bucket = ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int64)
    sizes = np.maximum(0, words.ends - words.begins - GRAM + 1)
    owner = np.repeat(np.arange(len(words)), sizes)
    at = np.repeat(words.begins - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(owner))
    return bucket[at], owner


def base(words: Words, texts: list[bytes]) -> dict[str, np.ndarray]:
    """The statistics of each text and whether it fails on them alone."""
    n = len(words)
    shown = np.concatenate([[0], np.cumsum(((words.data & 0xC0) != 0x80) & ~_space(words.data))])
    signs = np.concatenate([[0], np.cumsum(SYMBOL[words.data])])
    lines = np.zeros(n, np.int64)
    for i, text in enumerate(texts):
        if b"\n" in text:
            own = [x for x in text.split(b"\n") if x.strip()]
            lines[i] = len(own) - len(set(own))
    key, at = words.runs(REPEAT)
    owner = words.owner
    repeated = np.zeros(n, np.int64)
    if len(key):
        key = key ^ (owner[at].astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
        ordered = np.sort(key)
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if len(twice):
            found = at[np.isin(key, twice)]
            change = np.zeros(len(owner) + 1, np.int64)
            np.add.at(change, found, 1)
            np.add.at(change, found + REPEAT, -1)
            repeated = np.bincount(owner, np.cumsum(change[:-1]) > 0, n).astype(np.int64)
    n_words = words.counts
    return {
        "n_words": n_words,
        "word_chars": shown[words.ends] - shown[words.begins],
        "n_symbols": signs[words.ends] - signs[words.begins],
        "n_dup_lines": lines,
        "n_repeat_words": repeated,
        "base_failed": (n_words < 20) | (100 * repeated > 30 * n_words),
    }


def _space(data: np.ndarray) -> np.ndarray:
    return (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))


def trusted_keys(labels: DataFrame) -> DataFrame:
    """The keys of all documents labelled good."""
    return labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()


def may_be_trusted(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """The rows of `docs` (doc_id, text) whose key may be a trusted one: all that are, and a few more."""
    bit = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(FILTER_BITS))
    word, place = F.floor(bit / 64).cast("int").alias("word"), (bit % 64).cast("int").alias("place")
    words = trusted.select(word, place).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, place)")).alias("bits"))
    marked = docs.select("doc_id", "text", word, place).join(F.broadcast(words), "word")  # FILTER_BITS / 64 rows at most
    return marked.where(F.expr("getbit(bits, place) = 1")).select("doc_id", "text")


def histogram(texts: DataFrame, name: str) -> DataFrame:
    """(bucket, `name`): how often the n-grams of `text` fall into each bucket, added up by each task first."""

    def run(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            own = utf8(batch.column("text"))
            for a, b in chunks(own, STEP):
                total += np.bincount(grams(Words(own[a:b]))[0], minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS, dtype=np.int32)), pa.array(total)], ["bucket", name])

    return texts.select("text").mapInArrow(tidy(run), f"bucket int, {name} long").groupBy("bucket").agg(F.sum(name).alias(name))


def count_grams(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """(bucket, raw, target): n-gram counts of all documents and of the trusted ones."""
    plain = texts_of(docs)
    named = trusted.select(F.col("doc_id").cast("string").alias("doc_id")).distinct()
    # an inner join: the optimizer would move a semi join below the filter, and all texts with it
    good = may_be_trusted(plain.withColumn("doc_id", F.col("doc_id").cast("string")), named).join(named.hint("shuffle_hash"), "doc_id")
    zero = F.lit(0).cast("long")
    both = histogram(plain, "raw").withColumn("target", zero).unionByName(histogram(good, "target").withColumn("raw", zero))
    return both.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def ratios(docs: DataFrame, trusted: DataFrame) -> np.ndarray:
    """log p(target) - log p(raw) by bucket, each count one more than found; all zero without trusted documents."""
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for row in count_grams(docs, trusted).collect():  # BUCKETS rows
        raw[row["bucket"]], target[row["bucket"]] = row["raw"], row["target"]
    if not target.sum():
        return np.zeros(BUCKETS)
    return np.log((target + 1) / (target.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))


def verdicts(texts: list[bytes], table: np.ndarray, least: float = LEAST) -> dict[str, np.ndarray]:
    """Statistics, score and verdict of each text. Without any n-gram the score is 0."""
    words = Words(texts)
    out = base(words, texts)
    bucket, owner = grams(words)
    total, n = np.bincount(owner, table[bucket], len(texts)), np.bincount(owner, minlength=len(texts))
    out["log_ratio"] = total / np.maximum(n, 1)
    out["kept"] = ~out["base_failed"] & (out["log_ratio"] >= least)
    return out


RESULT = "doc_id {}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, log_ratio double, kept boolean"


def apply_rules(docs: DataFrame, table: np.ndarray, least: float = LEAST) -> DataFrame:
    """One row of statistics, score and verdict for each row of `docs`, repeated ones too; a null text has no words and fails. `doc_id` keeps
    its type and may be null. Results leave a task by slices of STEP bytes of text."""
    names = [c.split()[0] for c in RESULT.split(", ")][1:]
    plain = texts_of(docs)

    def run(batches):
        for batch in batches:
            texts = utf8(batch.column("text"))
            for a, b in chunks(texts, STEP):
                own = verdicts(texts[a:b], table, least)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), *(pa.array(own[c]) for c in names)], ["doc_id", *names])

    return plain.mapInArrow(tidy(run), RESULT.format(key_type(plain)))


def keep_good(docs: DataFrame, table: np.ndarray, least: float = LEAST) -> DataFrame:
    """The rows of `docs`, all columns, that the rules keep."""

    @F.pandas_udf("boolean")
    def good(text):
        import pandas as pd

        texts = [b"" if t is None else t.encode() for t in text]
        kept = pd.Series(np.concatenate([verdicts(texts[a:b], table, least)["kept"] for a, b in chunks(texts, STEP)] or [np.zeros(0, bool)]))
        release()
        return kept

    return docs.where(good("text"))
