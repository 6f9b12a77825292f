"""For each row the share of its repository's rows, up to its time, whose value is at most its own: without pairs, and with each row sent once.

Time is cut into months. How many values of earlier months are at most a value comes from counts per month and value, cut by value;
what is left is among the rows of one month, which one task holds.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from faultline.operators.file_states import loose
from faultline.operators.running import month_level
from faultline.session import materialize

#: Rows of a month that are compared with each other at once.
CHUNK = 1024
#: Rows without a repository or a time, which have no rank, lie in so many months below any real one.
NOWHERE, NOWHERE_PARTS = -(10**12), 1000
OF = ["repo", "feature"]


def upto(ts, x):
    """How many of the pairs have ts and x at most those of each, for pairs in order of ts."""
    n = len(ts)
    values, code = np.unique(x, return_inverse=True)
    seen, out = np.zeros(len(values), np.int64), np.zeros(n, np.int64)
    ends = np.append(np.flatnonzero(ts[1:] != ts[:-1]) + 1, n)  # where another time begins
    at = 0
    while at < n:
        # as many whole times as a chunk takes, one at least
        end = ends[max(np.searchsorted(ends, at + CHUNK, side="right") - 1, np.searchsorted(ends, at, side="right"))]
        own = code[at:end]
        if ts[at] == ts[end - 1]:
            seen += np.bincount(own, minlength=len(values))
            out[at:end] = np.cumsum(seen)[own]
        else:
            near = (own[None, :] <= own[:, None]) & (ts[None, at:end] <= ts[at:end, None])
            out[at:end] = np.cumsum(seen)[own] + near.sum(1)
            seen += np.bincount(own, minlength=len(values))
        at = end
    return out


def _earlier(table):
    """(repo, feature, x, month, prior) of a part of the values: how many values of earlier months are at most x. Rows without x tell how many lie in
    the parts below, by month."""
    column = {c: table.column(c).to_numpy(zero_copy_only=False) for c in ("x", "month", "m", "start")}
    months, month = np.unique(column["month"], return_inverse=True)
    start = column["start"].astype(bool)
    base = np.bincount(month[start], column["m"][start], len(months))
    xs, code = np.unique(column["x"][~start], return_inverse=True)
    grid = np.zeros((len(xs), len(months)), np.int64)
    np.add.at(grid, (code, month[~start]), column["m"][~start])
    below = np.cumsum(np.cumsum(grid, 0) + base.astype(np.int64), 1)
    at = month[~start]
    prior = np.where(at > 0, below[code, at - 1], 0)
    kept = table.filter(pa.array(~start))
    return kept.select([*OF, "x", "month"]).append_column("prior", pa.array(prior.astype(np.int64)))


def priors(points, level):
    """(repo, feature, x, month, prior) for every value of a month, from `points` (repo, feature, x, month, m) with the part of x as `level`."""
    totals = points.groupBy(*OF, level, "month").agg(F.sum("m").alias("m"))
    whole = totals.select(*OF, level).distinct().join(totals.select(*OF, "month").distinct(), OF)
    below = Window.partitionBy(*OF, "month").orderBy(level).rowsBetween(Window.unboundedPreceding, -1)
    filled = whole.join(totals, [*OF, level, "month"], "left").select(*OF, level, "month", F.sum("m").over(below).alias("m")).where("m > 0")
    rows = points.withColumn("start", F.lit(False)).unionByName(filled.withColumn("start", F.lit(True)), allowMissingColumns=True)
    return rows.groupBy(*OF, level).applyInArrow(_earlier, "repo string, feature string, x double, month long, prior long")


def _ranks(columns):
    def run(table):
        kind = table.column("row").is_valid().to_numpy()
        rows, priors_ = table.filter(pa.array(kind)), table.filter(pa.array(~kind))
        if table.column("month")[0].as_py() <= NOWHERE:
            return pa.table({"row": loose(rows.column("row")), **{c: pa.nulls(rows.num_rows, pa.float64()) for c in columns}})
        ts = rows.column("ts").to_numpy(zero_copy_only=False)
        order = np.argsort(ts, kind="stable")
        feature = np.array(priors_.column("feature").to_pylist(), object)
        px, pn = priors_.column("x").to_numpy(zero_copy_only=False), priors_.column("prior").to_numpy(zero_copy_only=False)
        total = priors_.column("total").to_numpy(zero_copy_only=False).astype(bool)
        out = {}
        for i, c in enumerate(columns):
            held = rows.column(f"x{i}")
            valid = held.is_valid().to_numpy(zero_copy_only=False)
            some = order[valid[order]]
            x, at = held.to_numpy(zero_copy_only=False)[some].astype(float), ts[some]
            share = np.zeros(rows.num_rows)
            if len(some):
                own = (feature == c) & ~total
                place = np.argsort(px[own])
                before = pn[own][place][np.searchsorted(px[own][place], x)] if own.any() else 0
                all_before = pn[(feature == c) & total].sum()
                counts = before + upto(at, x)
                share[some] = counts / (all_before + np.searchsorted(at, at, side="right"))
            out[c] = pa.array(share, pa.float64(), mask=~valid)
        return pa.table({"row": loose(rows.column("row")), **out})

    return run


def ranked_rows(stamped, columns, level_of):
    """(row, a share for each of `columns`): every row of `stamped` as a struct `row`; no shares without a repository or a ts."""
    given = stamped.columns
    known = F.col("repo").isNotNull() & F.col("ts").isNotNull()
    nowhere = F.lit(NOWHERE) - F.pmod(F.xxhash64(*given), F.lit(NOWHERE_PARTS))
    placed = stamped.withColumn("month", F.when(known, month_level(F.col("ts"))).otherwise(nowhere))
    cells = placed.where(known).select("repo", "month", F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns]))).where("x IS NOT NULL")
    points = materialize(cells.groupBy(*OF, "x", "month").agg(F.count(F.lit(1)).alias("m")), "points")
    parted, level = level_of(points)
    found = priors(parted.withColumn("_part", level).drop("_level"), "_part").withColumn("total", F.lit(False))
    earlier = Window.partitionBy(*OF).orderBy("month").rowsBetween(Window.unboundedPreceding, -1)
    totals = points.groupBy(*OF, "month").agg(F.sum("m").alias("m")).select(*OF, "month", F.coalesce(F.sum("m").over(earlier), F.lit(0)).cast("long").alias("prior"), F.lit(True).alias("total"))
    rows = placed.select("repo", "month", "ts", F.struct(*[F.col(c) for c in given]).alias("row"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
    rows = rows.unionByName(found, allowMissingColumns=True).unionByName(totals, allowMissingColumns=True)
    kept = rows.schema["row"].dataType.simpleString()
    return rows.groupBy("repo", "month").applyInArrow(_ranks(columns), ", ".join([f"row {kept}", *[f"`{c}` double" for c in columns]]))
