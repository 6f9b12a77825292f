"""Quality classifier: ridge regression on random Fourier features of document statistics, then isotonic calibration.

The features cos(w.x + b), w normal and b uniform, approximate a Gaussian kernel over the standardised statistics.
Each task adds up its rows' part of the normal equations, apart for each fold; the sum of all folds gives the model,
the sum without one fold the scores that calibrate it. Calibration pools adjacent violators over score cells. Labels
are used for fitting only, from a sample bounded by FIT_ROWS; every document is scored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import CHUNK_BYTES, chunks, key_type, release, texts_of, tidy, utf8
from faultline.llm.words import Words

FEATURES, BANDWIDTH, RIDGE, SEED, FOLDS = 256, 3.0, 1.0, 20240229, 4
#: Labelled rows that a fit takes at most: those with the smallest hashes of their keys.
FIT_ROWS = 200_000
#: Tasks that add up normal equations, and cells of the score that calibration counts in.
FIT_TASKS, CELLS = 32, 512
STEP = 1 << 18
SYMBOLS, STOPS = b"#$%&*@^~<>\\/+=_", b".,;:?'\"()-"
#: Byte classes whose shares are statistics.
CLASSES = np.zeros((256, 9))
for _k, _members in enumerate((range(65, 91), range(97, 123), range(48, 58), STOPS, b"!", SYMBOLS, b"|", b"\n", range(128, 256))):
    CLASSES[list(_members), _k] = 1
N_STATISTICS = 9 + 8


def statistics(texts: list[bytes]) -> np.ndarray:
    """A row of statistics for each text; an empty text has zeros."""
    words, n = Words(texts), len(texts)
    sizes = words.ends - words.begins
    owner = np.repeat(np.arange(n), sizes + 1)
    bytes_of = np.bincount(owner * 256 + words.data, minlength=256 * n).reshape(n, 256)
    bytes_of[:, 10] -= 1  # the line feed after each text
    shares = bytes_of @ CLASSES / np.maximum(1, sizes)[:, None]
    count, of, h = words.counts, words.owner, words.hash
    some = np.maximum(1, count)
    letters = np.bincount(of, (words.stop - words.start), n)
    # the text's number in the low bits keeps equal words of different texts apart
    own_key = (h >> np.uint64(20) << np.uint64(20)) | of.astype(np.uint64)
    distinct = np.bincount((np.unique(own_key) & np.uint64((1 << 20) - 1)).astype(np.int64), minlength=n)
    again = np.bincount(of[1:], (h[1:] == h[:-1]) & (of[1:] == of[:-1]), n) if len(h) else np.zeros(n)
    lines, repeated = np.ones(n), np.zeros(n)
    for i, text in enumerate(texts):
        if b"\n" in text:
            own = [x for x in text.split(b"\n") if x.strip()]
            lines[i], repeated[i] = max(1, len(own)), len(own) - len(set(own))
    ends = bytes_of[:, [46, 33, 63]].sum(1)
    return np.column_stack([shares, np.log1p(count), np.log1p(sizes), np.minimum(letters / some, 40), distinct / some, again / some, repeated / lines, np.log1p(count / (1 + ends)), np.log1p(count / lines)]) * (sizes > 0)[:, None]


def with_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the statistics of each document."""

    def run(batches):
        for batch in batches:
            texts = utf8(batch.column("text"))
            for a, b in chunks(texts, CHUNK_BYTES):
                x = np.concatenate([statistics(texts[a + c : a + d]) for c, d in chunks(texts[a:b], STEP)]).astype(np.float32)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.ListArray.from_arrays(np.arange(0, x.size + 1, N_STATISTICS, dtype=np.int32), pa.array(x.reshape(-1)))], ["doc_id", "x"])

    plain = texts_of(docs)
    return plain.mapInArrow(tidy(run), f"doc_id {key_type(plain)}, x array<float>")


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    levels: np.ndarray  # raw scores
    chances: np.ndarray  # what they are calibrated to

    def features(self, x: np.ndarray) -> np.ndarray:
        return _features((x - self.mean) / self.scale)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.levels):
            return np.full(len(x), 0.5)
        return np.interp(self.features(x) @ self.weights, self.levels, self.chances)


def _features(z: np.ndarray) -> np.ndarray:
    """The random Fourier features of standardised statistics, and a constant. The draws are the same everywhere."""
    draw = np.random.default_rng(SEED)
    w, b = draw.normal(0, 1 / BANDWIDTH, (N_STATISTICS, FEATURES)), draw.uniform(0, 2 * np.pi, FEATURES)
    return np.column_stack([np.sqrt(2 / FEATURES) * np.cos(np.clip(z, -8, 8) @ w + b), np.ones(len(z))])


def labelled_sample(features: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, x, y): training rows, those whose crc32 of the key as text is not a multiple of 5; a document labelled twice
    counts twice. Beyond `rows` labels, a share of them by the hash of their keys."""
    y = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out()).select("doc_id", F.col("quality").cast("double").alias("y"))
    n = y.count()
    if n > rows:
        y = y.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(rows / n * (1 << 30)))
    return features.join(y, "doc_id")


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def _unpack(batch, name="x"):
    return np.asarray(batch.column(name).flatten(), dtype=np.float64).reshape(-1, N_STATISTICS)


def fit(sample: DataFrame) -> Model:
    """Fit on rows (doc_id, x, y). `sample` is read three times: pass a written table. Without rows of both labels
    every score is 0.5."""
    at = [F.col("x")[i] for i in range(N_STATISTICS)]
    row = sample.agg(F.count("*"), F.sum("y"), *(f(c) for c in at for f in (F.avg, F.stddev_pop))).first()
    n, positive, moments = row[0], row[1], np.array([v or 0.0 for v in row[2:]]).reshape(-1, 2)
    if not n or positive in (0, n):
        return Model(np.zeros(N_STATISTICS), np.ones(N_STATISTICS), np.zeros(FEATURES + 1), np.zeros(0), np.zeros(0))
    mean, scale = moments[:, 0], np.where(moments[:, 1] > 1e-6, moments[:, 1], 1.0)
    width = FEATURES + 1
    dealt = sample.withColumn("fold", F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(FOLDS)).cast("int")).repartition(FIT_TASKS)

    def equations(batches):
        total = np.zeros((FOLDS, width, width + 1))
        for batch in batches:
            z, y, fold = _features((_unpack(batch) - mean) / scale), batch.column("y").to_numpy(), batch.column("fold").to_numpy()
            for k in range(FOLDS):
                own = z[fold == k]
                total[k] += own.T @ np.column_stack([own, y[fold == k]])
        yield pa.RecordBatch.from_arrays([pa.array(range(FOLDS), pa.int32()), pa.array([m.tobytes() for m in total], pa.binary())], ["fold", "m"])

    def added(parts):
        total = np.sum([np.frombuffer(m) for m in sorted(parts.column("m").to_pylist())], axis=0)  # FIT_TASKS of them
        return pa.table({"fold": parts.column("fold")[:1], "m": pa.array([total.tobytes()], pa.binary())})

    parts = dealt.mapInArrow(equations, "fold int, m binary").groupBy("fold").applyInArrow(added, "fold int, m binary")
    sums = np.zeros((FOLDS, width, width + 1))
    for r in parts.collect():  # FOLDS rows
        sums[r["fold"]] = np.frombuffer(r["m"]).reshape(width, width + 1)
    penalty = np.diag([*[RIDGE] * FEATURES, 1e-6])  # the constant is free: what no training row resembles gets the mean
    solve = lambda m: np.linalg.solve(m[:, :width] + penalty, m[:, width])
    whole = sums.sum(0)
    weights, without = solve(whole), np.stack([solve(whole - sums[k]) for k in range(FOLDS)])

    def cells(batches):
        for batch in batches:
            raw = (_features((_unpack(batch) - mean) / scale) * without[batch.column("fold").to_numpy()]).sum(1)
            yield pa.RecordBatch.from_arrays([pa.array(np.clip((raw + 0.5) / 2 * CELLS, 0, CELLS - 1).astype(np.int32)), batch.column("y")], ["cell", "y"])

    counted = dealt.mapInArrow(cells, "cell int, y double").groupBy("cell").agg(F.count("*").alias("n"), F.sum("y").alias("y")).orderBy("cell").collect()  # CELLS rows
    levels = (np.array([r["cell"] for r in counted]) + 0.5) / CELLS * 2 - 0.5
    return Model(mean, scale, weights, *isotonic(levels, np.array([r["y"] for r in counted]), np.array([r["n"] for r in counted], float)))


def isotonic(levels: np.ndarray, positive: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; the centre of each pool and its share of positives, smoothed by half a row of either kind."""
    pools: list[list[float]] = []
    for level, p, w in zip(levels, positive, n):
        pools.append([level * w, p, w])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    out = np.array(pools)
    return out[:, 0] / out[:, 2], np.maximum.accumulate((out[:, 1] + 0.5) / (out[:, 2] + 1))


def score(features: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row; null keys are not held out."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(_unpack(batch)))], ["doc_id", "score"])

    rows = features.mapInArrow(run, f"doc_id {key_type(features)}, score double")
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of `docs`, all columns, that the classifier does not reject."""

    @F.pandas_udf("boolean")
    def good(text):
        import pandas as pd

        texts = [b"" if t is None else t.encode() for t in text]
        x = np.concatenate([statistics(texts[a:b]) for a, b in chunks(texts, STEP)] or [np.zeros((0, N_STATISTICS))]).astype(np.float32).astype(np.float64)
        kept = pd.Series(model.score(x) >= threshold)
        release()
        return kept

    return docs.where(good("text"))
