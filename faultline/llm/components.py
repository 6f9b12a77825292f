"""Connected components of a link table by repeated joins; labels never leave the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.session import materialize


def components(links: DataFrame) -> DataFrame:
    """(key, label) for every key in `links` (a, b): label is the smallest key that links reach.

    Alternates two steps until nothing changes: each key links its larger neighbours to its smallest one, then
    its smaller neighbours (and itself) to that. Both keep components and shrink paths; what is left are stars. A key
    with many neighbours is summed up by its minimum; rows per key never meet in memory.
    """
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = materialize(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        edges = materialize(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        before, state = state, _state(edges)
        if state == before:
            break
    roots = edges.select(F.col("v").alias("key")).distinct()
    return edges.select(F.col("u").alias("key"), F.col("v").alias("label")).unionByName(roots.select("key", F.col("key").alias("label")))


def _state(edges: DataFrame) -> tuple:
    """How many edges there are and a sum that tells edge sets apart."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
