"""Running aggregates and ranks that stay parallel inside one very large group.

A plain window sorts a whole group in one task, so a repository holding a third
of all rows would be one task. Here a group is cut along its own order into
nested buckets. Bucket totals are combined map-side and are few; a window over
those totals gives every bucket its starting value, and a window inside the
finest bucket gives the rest. The result equals the plain window exactly.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

_COMBINE = {"sum": F.sum, "max": F.max, "min": F.min}

DAY = 86400
MONTH = 30 * DAY


QUARTER = 91 * DAY


def quarter_level(ts):
    """Whole seconds by 91 days: at most 7,862,400 different ones in a bucket, and some 200 buckets in fifty years."""
    return F.floor(ts / F.lit(QUARTER))


def day_level(ts):
    return F.floor(ts / F.lit(DAY))


def month_level(ts):
    return F.floor(ts / F.lit(MONTH))


def rank_level(rank):
    """10,000 consecutive positions per bucket."""
    return F.floor((rank - 1) / F.lit(10000))


def value_level(value):
    """A non-decreasing bucket of about one percent relative width, at most a few thousand in all."""
    v = value.cast("double")
    return (F.signum(v) * F.floor(F.lit(64.0) * F.log2(F.lit(1.0) + F.abs(v) * 1000.0))).cast("long")


def running(df, keys, levels, order, aggs, inclusive=False):
    """Add running aggregates per `keys`, over the rows before each row (and the row itself if inclusive).

    levels: columns, coarse to fine, each non-decreasing in the row order within its parent.
    order:  columns that order rows inside the finest level; with levels they must be a total order.
    aggs:   {output name: ("sum" | "max" | "min", input column name)}.
    Sums before the first row are 0, maxima and minima are null. Key columns must not be null.
    """
    names = [f"_level{i}" for i in range(len(levels))]
    rows = df.select("*", *[c.alias(n) for c, n in zip(levels, names)])
    totals = rows.groupBy(*keys, *names).agg(
        *[_COMBINE[kind](col).alias(out) for out, (kind, col) in aggs.items()]
    )

    offsets = None
    for depth in range(len(names), 0, -1):
        if depth == len(names):
            level_totals = totals
        else:
            level_totals = totals.groupBy(*keys, *names[:depth]).agg(
                *[_COMBINE[kind](out).alias(out) for out, (kind, _) in aggs.items()]
            )
        before = (
            Window.partitionBy(*keys, *names[: depth - 1])
            .orderBy(names[depth - 1])
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        part = level_totals.select(
            *keys,
            *names[:depth],
            *[_COMBINE[kind](out).over(before).alias(f"_offset{depth}_{out}") for out, (kind, _) in aggs.items()],
        )
        offsets = part if offsets is None else offsets.join(part, [*keys, *names[:depth]])

    inside = (
        Window.partitionBy(*keys, *names)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    local = rows.select(
        "*", *[_COMBINE[kind](col).over(inside).alias(f"_local_{out}") for out, (kind, col) in aggs.items()]
    )
    joined = local.join(offsets, [*keys, *names])

    result = []
    for out, (kind, _) in aggs.items():
        parts = [F.col(f"_local_{out}")] + [F.col(f"_offset{d}_{out}") for d in range(1, len(names) + 1)]
        if kind == "sum":
            total = F.coalesce(parts[0], F.lit(0))
            for p in parts[1:]:
                total = total + F.coalesce(p, F.lit(0))
            result.append(total.alias(out))
        else:
            pick = F.greatest if kind == "max" else F.least
            result.append(pick(*parts).alias(out))
    return joined.select(*df.columns, *result)


def stepwise(events, keys, order, level, aggs, inclusive=False):
    """Aggregates of the events before each different (keys, order), one row for each: (keys, order, names, at_names).

    events: rows of `keys`, `order` and the input columns, read once; those with a null key or order count for nothing. They
            are dealt out by keys and bucket and combined per position there; the totals of a bucket come from the same rows.
    level:  the bucket, non-decreasing in `order`, with a bounded number of positions: what one task holds of a
            group is bounded by that number, whatever the data.
    aggs:   {name: ("sum" | "max" | "min", input column or expression)}; `name` is the aggregate before the position (and at it if
            inclusive), `at_name` the one of the position alone. Sums are 0 before the first position, others null.
    """
    kinds = {out: kind for out, (kind, _) in aggs.items()}
    present = F.col(order).isNotNull() & F.col("_bucket").isNotNull()
    for key in keys:
        present = present & F.col(key).isNotNull()
    # both branches below ask for all columns of `steps`, under the filters that the join would add to one of them, and the
    # second renames its own: so Spark sees that they start from one exchange, and runs what is below it once
    dealt = events.withColumn("_bucket", level).where(present).repartition(*keys, "_bucket")
    steps = dealt.groupBy(*keys, "_bucket", order).agg(*[_COMBINE[kind](col).alias(f"at_{out}") for out, (kind, col) in aggs.items()])
    inside = (
        Window.partitionBy(*keys, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    own = [f"at_{out}" for out in kinds]
    local = steps.select(
        *keys, "_bucket", order, *own, *[_COMBINE[kind](f"at_{out}").over(inside).alias(f"_in_{out}") for out, kind in kinds.items()]
    )
    totals = steps.groupBy(*keys, "_bucket").agg(*[_COMBINE[kind](f"at_{out}").alias(f"_all_{out}") for out, kind in kinds.items()])
    named = totals.select(*[F.col(c).alias(f"_of_{c}") for c in (*keys, "_bucket")], *[F.col(f"_all_{out}").alias(f"_sum_{out}") for out in kinds])
    before = Window.partitionBy(*[f"_of_{c}" for c in keys]).orderBy("_of__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = named.select(
        *[f"_of_{c}" for c in (*keys, "_bucket")], *[_COMBINE[kind](f"_sum_{out}").over(before).alias(f"_before_{out}") for out, kind in kinds.items()]
    )
    same = F.col("_bucket") == F.col("_of__bucket")
    for key in keys:
        same = same & (F.col(key) == F.col(f"_of_{key}"))

    def whole(out, kind):
        parts = F.col(f"_in_{out}"), F.col(f"_before_{out}")
        if kind == "sum":
            return F.coalesce(parts[0], F.lit(0)) + F.coalesce(parts[1], F.lit(0))
        return (F.greatest if kind == "max" else F.least)(*parts)

    return local.join(offsets, same).select(*keys, order, *own, *[whole(out, kind).alias(out) for out, kind in kinds.items()])


def ranked(df, keys, levels, order, out="rank"):
    """Row number 1, 2, 3, ... per `keys` in the order (levels, order)."""
    one = df.withColumn("_one", F.lit(1).cast("long"))
    return running(one, keys, levels, order, {out: ("sum", "_one")}, inclusive=True).drop("_one")


def hash_level(hex_column, digits=3):
    """The leading hex digits of a hash: even buckets for orders that begin with that hash."""
    return F.substring(hex_column, 1, digits)


def exact_quantiles(df, keys, value, probs):
    """Linear-interpolation quantiles per `keys`, exact, as rows (keys, prob, quantile, n).

    Values are counted first, so the work is on distinct values; their running
    counts locate the two order statistics each quantile lies between.
    """
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("_value"))
        .agg(F.count(F.lit(1)).alias("_count"))
    )
    placed = running(counts, keys, [value_level(F.col("_value"))], ["_value"], {"_before": ("sum", "_count")})
    if keys:
        sizes = counts.groupBy(*keys).agg(F.sum("_count").alias("n"))
        placed = placed.join(sizes, keys)
    else:
        placed = placed.withColumn("n", counts.agg(F.sum("_count")).scalar())

    def covered(position):
        return (position >= F.col("_before")) & (position < F.col("_before") + F.col("_count"))

    def needed(p):
        at = p * (F.col("n") - 1)
        return covered(F.floor(at)) | covered(F.ceil(at))

    grid = F.array(*[F.lit(float(p)) for p in probs])
    at = F.col("prob") * (F.col("n") - 1)
    hits = placed.select("*", F.explode(F.filter(grid, needed)).alias("prob"))
    ends = hits.groupBy(*keys, "prob", "n").agg(
        F.max(F.when(covered(F.floor(at)), F.col("_value"))).alias("_low"),
        F.max(F.when(covered(F.ceil(at)), F.col("_value"))).alias("_high"),
    )
    return ends.select(
        *keys, "prob", (F.col("_low") + (F.col("_high") - F.col("_low")) * (at - F.floor(at))).alias("quantile"), "n"
    )
