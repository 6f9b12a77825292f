"""Exact top-k search by inner product with a uniform threshold in three phases.

Vectors are cut into SLICES ranges of components; a slice of a block of rows is a table row of its own, so each slice is a node that
knows only its part of every score. Phase one gathers from every node the rows of highest partial score and scores these
candidates in full: a query's k-th best of them is a cutoff that is safe, as no better rows can be missed by asking for it. Of a
score that reaches the cutoff at least one of its parts reaches the cutoff divided by SLICES. So phase two sends the
cutoffs to all nodes and collects every entry that high. Phase three adds the parts up; where a part was too low to be sent,
the score is worked out from the whole vectors.

Equal vectors are one class, listed with its smallest ids, so copies cost nothing in the search. Queries are searched GROUP at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.common import materialize, work_folder

SCALE = 1024
#: Nodes of a vector, rows of a block, queries whose scores are worked out together and that are sent to all tasks at once.
SLICES, BLOCK, TILE, GROUP = 2, 4096, 512, 1 << 14
#: Entries of a query and node that stay after phase one, whatever the number of tasks.
LISTED = 128
#: A query class's results are laid out so often, for classes that many queries share.
SALTS = 16


def whole(vector: Column) -> Column:
    """Components as floor(1024 x)."""
    return F.transform(vector, lambda v: F.floor(SCALE * v.cast("double")))


def rows_of(vectors: DataFrame) -> DataFrame:
    """(vec_id, key, x): each different (id, vector) once; `key` is a digest of the vector."""
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) != float("inf")))
    plain = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite).select("vec_id", whole(F.col("embedding")).alias("x"))
    return plain.withColumn("key", F.sha2(F.array_join(F.transform("x", lambda v: v.cast("string")), ","), 256)).groupBy("vec_id", "key").agg(F.first("x").alias("x"))


def classes_of(rows: DataFrame, k: int) -> DataFrame:
    """(row, ids, key, x): a row for each different vector with its k + 1 smallest ids; `row` ascends with the smallest one."""
    first = rows.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))).where(F.col("place") <= k + 1)
    grouped = first.groupBy("key").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"), F.first("x").alias("x")).withColumn("least", F.col("ids")[0])
    ordered = grouped.repartitionByRange("least").sortWithinPartitions("least")
    return materialize(ordered.select(F.monotonically_increasing_id().alias("row"), "ids", "key", "x"), "classes")


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors as the rows of a matrix, short ones with zeros at their end."""
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), dims), np.int64)
    out[np.arange(dims) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def borders(dims: int) -> list[int]:
    return [dims * s // SLICES for s in range(SLICES + 1)]


def nodes_of(classes: DataFrame, dims: int) -> DataFrame:
    """(slice, rows, cells): the blocks of every node, by slice in folders of their own."""
    cuts = borders(dims)

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                some = batch.slice(a, BLOCK)
                x = matrix(some.column("x"), dims)
                own = [x[:, p:q].ravel() for p, q in zip(cuts, cuts[1:])]
                ids = [some.column("row").to_numpy()] * SLICES
                yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array(ids, pa.list_(pa.int64())), pa.array(own, pa.list_(pa.int64()))], ["slice", "rows", "cells"])

    schema, folder = "slice int, rows array<long>, cells array<long>", work_folder(classes.sparkSession, "nodes")
    classes.select("row", "x").mapInArrow(run, schema).write.partitionBy("slice").parquet(folder)
    return classes.sparkSession.read.schema(schema).parquet(folder).select("slice", "rows", "cells")


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in 64-bit integers; by way of doubles where these hold every sum exactly."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def parts(batches, queries: np.ndarray, cuts: list[int]):
    """(slice, first query, rows, partial scores) of every block in `batches`, TILE queries at a time."""
    for batch in batches:
        for r in range(batch.num_rows):
            block = batch.slice(r, 1)
            slice_ = block.column("slice")[0].as_py()
            rows = block.column("rows").flatten().to_numpy()
            own = queries[:, cuts[slice_] : cuts[slice_ + 1]]
            cells = block.column("cells").flatten().to_numpy().reshape(len(rows), -1) if own.shape[1] else np.zeros((len(rows), 0), np.int64)
            for low in range(0, len(queries), TILE):
                yield slice_, low, rows, product(own[low : low + TILE], cells)


ENTRY = "q int, slice int, row long, part long"


def _entries(q, slice_, row, part):
    return pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(np.full(len(q), slice_, np.int32)), pa.array(row, pa.int64()), pa.array(part, pa.int64())], ["q", "slice", "row", "part"])


def local_lists(nodes: DataFrame, queries: np.ndarray, dims: int, keep: int) -> DataFrame:
    """Phase one: the `keep` entries of highest partial score of every query, node and task."""

    def run(batches):
        lists: dict[tuple[int, int], tuple] = {}
        for slice_, low, rows, score in parts(batches, queries, borders(dims)):
            n = min(keep, len(rows))
            at = np.argpartition(-score, n - 1, axis=1)[:, :n]
            best, own = np.take_along_axis(score, at, 1), rows[at]
            if (slice_, low) in lists:
                best, own = (np.concatenate([x, y], axis=1) for x, y in zip(lists[slice_, low], (best, own)))
                at = np.argpartition(-best, min(keep, best.shape[1]) - 1, axis=1)[:, :keep]
                best, own = np.take_along_axis(best, at, 1), np.take_along_axis(own, at, 1)
            lists[slice_, low] = best, own
        for (slice_, low), (best, own) in lists.items():
            q = low + np.repeat(np.arange(len(best)), best.shape[1])
            yield _entries(q, slice_, own.ravel(), best.ravel())

    return nodes.mapInArrow(run, ENTRY)


def high_entries(nodes: DataFrame, queries: np.ndarray, cutoffs: np.ndarray, dims: int) -> DataFrame:
    """Phase two: every entry of at least its query's cutoff divided by the nodes."""

    def run(batches):
        for slice_, low, rows, score in parts(batches, queries, borders(dims)):
            least = -(-cutoffs[low : low + len(score)] // SLICES)
            q, at = np.nonzero(score >= least[:, None])
            yield _entries(low + q, slice_, rows[at], score[q, at])

    return nodes.mapInArrow(run, ENTRY)


def resolve(pairs: DataFrame, classes: DataFrame, queries: np.ndarray, dims: int) -> DataFrame:
    """(q, row, score) of each (q, row), from the whole vectors."""

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                some = batch.slice(a, BLOCK)
                score = (matrix(some.column("x"), dims) * queries[some.column("q").to_numpy()]).sum(axis=1)
                yield pa.RecordBatch.from_arrays([some.column("q"), some.column("row"), pa.array(score)], ["q", "row", "score"])

    return pairs.join(classes.select("row", "x"), "row").select("q", "row", "x").mapInArrow(run, "q int, row long, score long")


def best(scored: DataFrame, n: int) -> DataFrame:
    """Each query's n rows of highest score, ties to smaller rows."""
    order = Window.partitionBy("q").orderBy(F.desc("score"), "row")
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def search_group(classes: DataFrame, nodes: DataFrame, queries: np.ndarray, dims: int, k: int) -> DataFrame:
    """(q, row, score): the k + 1 best classes of each query, ties to the class with the smaller id."""
    lists = Window.partitionBy("q", "slice").orderBy(F.desc("part"), "row")
    listed = local_lists(nodes, queries, dims, 2 * (k + 1)).withColumn("place", F.row_number().over(lists)).where(F.col("place") <= LISTED)
    known = best(resolve(listed.select("q", "row").distinct(), classes, queries, dims), k + 1)
    cutoffs = np.full(len(queries), -(1 << 62), np.int64)
    for r in known.groupBy("q").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") == k + 1).collect():  # a row for each query of the group
        cutoffs[r["q"]] = r["least"]
    entries = high_entries(nodes, queries, cutoffs, dims)
    sums = materialize(entries.groupBy("q", "row").agg(F.sum("part").alias("score"), F.count("*").alias("n")), "entries")
    complete = sums.where(F.col("n") == SLICES).select("q", "row", "score")
    return best(complete.unionByName(resolve(sums.where(F.col("n") < SLICES), classes, queries, dims)), k + 1).select("q", "row", "score")


def search(vectors: DataFrame, asked: Column, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of `vectors` (vec_id, embedding) that `asked` picks, the k other rows of highest integer inner
    product of the components floor(1024 x), ties to the smaller vec_id; all of them where there are fewer.

    Rows without vec_id, and vectors that are null or hold a null or a number that is not finite, take no part. A row that repeats id and vector
    is one row; an id with two vectors is two rows, each a candidate of the other and a query of its own. Shorter vectors end in
    zeros. Scores are exact as long as they fit in 64 bits. `vec_id` keeps its type.
    """
    rows = materialize(rows_of(vectors), "vectors")
    classes = classes_of(rows, k)
    dims = classes.agg(F.max(F.size("x"))).first()[0] or 0
    nodes = nodes_of(classes, dims)
    queries = rows.where(asked).select("vec_id", "key")
    wanted = materialize(classes.join(queries.select("key").distinct(), "key", "left_semi").select("row", "key", "x"), "queries")
    groups = -(-wanted.count() // GROUP)
    kind = rows.schema["vec_id"].dataType.simpleString()
    found = vectors.sparkSession.createDataFrame([], f"key string, results array<struct<score: long, vec_id: {kind}, own: boolean>>")
    for group in range(groups):
        own = wanted.where(F.pmod(F.xxhash64("key"), F.lit(groups)) == group).collect()  # about GROUP rows
        table = np.zeros((len(own), dims), np.int64)
        for q, r in enumerate(own):
            table[q, : len(r["x"])] = r["x"]
        top = search_group(classes, nodes, table, dims, k)
        names = vectors.sparkSession.createDataFrame([(q, r["row"], r["key"]) for q, r in enumerate(own)], "q int, own_row long, own_key string")
        listed = top.join(classes.select("row", "ids"), "row").join(F.broadcast(names), "q")
        each = listed.select("q", F.col("own_key").alias("key"), "score", F.explode("ids").alias("vec_id"), (F.col("row") == F.col("own_row")).alias("own"))
        each = each.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("place") <= k + 1)
        packed = each.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("place", "score", "vec_id", "own"))).alias("results"))
        found = found.unionByName(packed.withColumn("results", F.transform("results", lambda r: F.struct(r["score"].alias("score"), r["vec_id"].alias("vec_id"), r["own"].alias("own")))))
    laid = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = queries.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int")).join(laid, ["key", "salt"])
    others = F.filter("results", lambda r: ~(r["own"] & (r["vec_id"] == F.col("vec_id"))))
    ranked = salted.select(F.col("vec_id").alias("query_id"), F.posexplode(F.slice(others, 1, k)).alias("place", "result"))
    return ranked.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("result.vec_id").alias("vec_id"), F.col("result.score").alias("score"))
