"""Per-file development history before each snapshot, and labels from what follows it.

The reference shape is one log query per (file, snapshot). Here every quantity is
a running aggregate over the ordered changes of a file: a snapshot looks up the
state after its r-th change, r being the number of changes strictly before it.
Changes are (repo, file_path, commit_id, author, commit_date, message, lines)
with is_bug_fix and score already attached; snapshots need repo, file_path,
commit_id, commit_date.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from faultline.operators.file_states import states_before
from faultline.operators.running import DAY, quarter_level, rank_level, stepwise

FILE = ["repo", "file_path"]


def with_ts(df):
    return df.withColumn("ts", F.unix_timestamp("commit_date"))


def counts_before(points, events, keys, measures):
    """Sums of event measures strictly before each point's ts: rows (keys, ts, *measures)."""
    rows = events.select(*keys, "ts", *[F.col(m).cast("long").alias(m) for m in measures]).unionByName(
        points.select(*keys, "ts"), allowMissingColumns=True
    )
    return stepwise(rows, keys, "ts", quarter_level(F.col("ts")), {m: ("sum", m) for m in measures}).select(*keys, "ts", *measures)


def _numbered(changes, before):
    """Changes with rank, their position 1, 2, ... in the file's history: the number of changes before their second, and
    their place in it. `before` has the former as `r` for every (file, ts)."""
    place = Window.partitionBy(*FILE, "ts").orderBy("commit_id")
    return changes.join(before, [*FILE, "ts"]).withColumn("rank", F.col("r") + F.row_number().over(place)).drop("r")


def _items(changes, order, last=None):
    """(file, kind, item, `order`, delta) for each word and author of a change, and with `last` for its departure so many positions later."""
    words = F.filter(F.split(F.lower("message"), r"\s+"), lambda w: w != "")
    items = F.concat(
        F.transform(F.coalesce(words, F.array()), lambda w: F.struct(F.lit("word").alias("kind"), w.alias("item"))),
        F.array(F.struct(F.lit("author").alias("kind"), F.coalesce("author", F.lit("")).alias("item"))),
    )
    arrive = changes.select(*FILE, order, F.inline(items)).withColumn("delta", F.lit(1).cast("long"))
    if last is None:
        return arrive
    moves = F.array(F.struct(F.col(order), F.col("delta")), F.struct((F.col(order) + last).alias(order), (-F.col("delta")).alias("delta")))
    return arrive.select(*FILE, "kind", "item", F.inline(moves))


def _moves(changes, order, moves):
    """What changes bring at their positions and take away at others: `moves` are maps from measure to value, with the position
    as `order`."""
    names = sorted({n for m in moves for n in m})
    rows = [F.struct(*[(m[n] if n in m else F.lit(None)).cast("long").alias(n) for n in names]) for m in moves]
    return changes.select(*FILE, F.inline(F.array(*rows)))


def _item_terms(items, order, level):
    """Per file and position the change in sum(c*log2 c) and the number of words, in sum(c*c) and the number of present authors, and
    the greatest count an author reaches; c is the running count of an item in its file. Each sum is the total over items, so
    adding up the changes in order of position gives the state.

    The items of a file and bucket meet once, each with a row, ahead of its positions, that has its count before the bucket.
    """
    bucketed = items.withColumn("_bucket", level)
    earlier = Window.partitionBy(*FILE, "kind", "item").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = bucketed.groupBy(*FILE, "kind", "item", "_bucket").agg(F.sum("delta").alias("_sum"))
    starts = starts.select(*FILE, "kind", "item", "_bucket", F.sum("_sum").over(earlier).alias("delta")).where("delta <> 0")
    met = bucketed.unionByName(starts, allowMissingColumns=True).repartition(*FILE, "_bucket")
    met = met.groupBy(*FILE, "_bucket", "kind", "item", order).agg(F.sum("delta").alias("delta"))
    so_far = Window.partitionBy(*FILE, "_bucket", "kind", "item").orderBy(F.col(order).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    met = met.withColumn("count", F.coalesce(F.sum("delta").over(so_far), F.lit(0))).where(F.col(order).isNotNull())
    before, after = F.col("count").cast("double"), (F.col("count") + F.col("delta")).cast("double")

    def xlogx(c):
        return F.when(c > 0, c * F.log2(c)).otherwise(F.lit(0.0))

    def of(kind, value):
        return F.when(F.col("kind") == kind, value)

    return met.groupBy(*FILE, "_bucket", order).agg(
        F.sum(of("word", xlogx(after) - xlogx(before))).alias("word_xlogx"),
        F.sum(of("word", F.col("delta"))).alias("word_total"),
        F.sum(of("author", (after * after - before * before).cast("long"))).alias("author_square"),
        F.sum(of("author", (after > 0).cast("long") - (before > 0).cast("long"))).alias("authors"),
        F.max(of("author", after.cast("long"))).alias("top_author"),
    ).drop("_bucket")


_AGGREGATES = {
    **dict.fromkeys(("changes", "fixes", "lines", "recent", "word_xlogx", "word_total", "author_square", "authors"), "sum"),
    **dict.fromkeys(("top_author", "last_ts", "old_ts"), "max"), "first_ts": "min",
}


def _states(items, moves, order, level, measures, inclusive=False, points=None):
    """The state of each file before each of its positions (at it, if inclusive), also at `points`: one stream of what items and
    changes bring, dealt out once by file and bucket."""
    events = _item_terms(items, order, level).unionByName(moves, allowMissingColumns=True)
    if points is not None:
        events = events.unionByName(points, allowMissingColumns=True)
    states = stepwise(events, FILE, order, level, {n: (_AGGREGATES[n], n) for n in measures}, inclusive)
    return states.select(*FILE, order, *measures)


def _entropy(total, xlogx):
    return F.when(total > 0, F.log2(total) - xlogx / total).otherwise(F.lit(0.0))


def file_history(changes, snapshots, recent_days=30, active_days=7):
    """History metrics of each snapshot from the changes strictly before it, whole past.

    Changes are dealt out as they are and walked in order of time, a quarter of a file at a time; see file_states.
    """
    states = states_before(with_ts(changes), with_ts(snapshots), recent_days)
    known = states.select("row.*", *[c for c in states.columns if c != "row"])
    r = F.col("changes")
    days_since = (F.col("ts") - F.col("last_ts")) / F.lit(float(DAY))

    def known_or(value, default):
        return F.when(r > 0, value).otherwise(default)

    return known.select(
        *snapshots.columns,
        r.alias("previous_file_commits"),
        F.col("fixes").alias("previous_bug_fixes"),
        F.col("authors").alias("contributors"),
        F.col("recent").alias("recent_file_commits"),
        F.col("lines").alias("code_churn_history"),
        known_or((F.col("ts") - F.col("first_ts")) / float(DAY), F.lit(0.0)).alias("file_age_days"),
        known_or(days_since, F.lit(0.0)).alias("days_since_last_change"),
        known_or(F.col("top_author") / r, F.lit(0.0)).alias("ownership_concentration"),
        known_or(F.round(_entropy(F.col("words"), F.col("xlogx")), 4), F.lit(0.0)).alias("commit_message_entropy"),
        known_or(F.col("lines") / r, F.lit(0.0)).alias("avg_commit_size"),
        F.when(r > 1, (F.col("last_ts") - F.col("first_ts")) / float(DAY) / (r - 1)).otherwise(0.0).alias("avg_time_between_commits"),
        known_or((F.col("authors") > 1).cast("int"), F.lit(0)).alias("has_multiple_contributors"),
        known_or((F.round(days_since, 2) <= active_days).cast("int"), F.lit(0)).alias("is_recently_touched"),
    )


def last_n_history(changes, snapshots, last=100, recent_days=30, active_days=7):
    """The Java profile: only the `last` latest changes strictly before the snapshot count.

    Concentration is the sum of squared author shares, the mean gap is in hours,
    ages are whole days, experience is commits / 50 up to 1. Changes are numbered in their file; what the change of rank k
    brings departs at rank k + last, and a snapshot after r changes takes the state at rank r.
    """
    stamped, snaps = with_ts(changes), with_ts(snapshots)
    one, day = F.lit(1).cast("long"), recent_days * DAY
    arrivals = stamped.select(*FILE, F.explode(F.array(F.struct("ts", one.alias("n"), one.alias("recent")), F.struct((F.col("ts") + day).alias("ts"), F.lit(0).cast("long").alias("n"), (-one).alias("recent")))).alias("e"))
    points = arrivals.select(*FILE, "e.*").unionByName(snaps.select(*FILE, "ts"), allowMissingColumns=True)
    before = stepwise(points, FILE, "ts", quarter_level(F.col("ts")), {"r": ("sum", "n"), "recent": ("sum", "recent")}).select(*FILE, "ts", "r", "recent")
    numbered = _numbered(stamped, before.drop("recent"))
    level = rank_level(F.col("rank"))
    rank, ts, fix = F.col("rank"), F.col("ts"), F.col("is_bug_fix").cast("long")
    moves = _moves(numbered, "rank", [
        {"rank": rank, "fixes": fix, "first_ts": ts, "last_ts": ts}, {"rank": rank + last, "fixes": -fix}, {"rank": rank + (last - 1), "old_ts": ts},
    ])
    states = _states(
        _items(numbered, "rank", last), moves, "rank", level, ["fixes", "word_xlogx", "word_total", "author_square", "authors", "first_ts", "last_ts", "old_ts"], inclusive=True
    )
    # ranks beyond the last change only carry departures and are never looked up
    known = snaps.join(before, [*FILE, "ts"]).join(states.withColumnRenamed("rank", "r"), [*FILE, "r"], "left")
    r = F.col("r")
    n = F.least(r, F.lit(last).cast("long"))
    oldest = F.coalesce("old_ts", "first_ts")

    def known_or(value, default):
        return F.when(r > 0, value).otherwise(default)

    return known.select(
        *snapshots.columns,
        n.alias("previous_file_commits"),
        known_or(F.col("fixes"), F.lit(0)).alias("previous_bug_fixes"),
        known_or(F.col("authors"), F.lit(0)).alias("contributors"),
        F.least(n, F.col("recent")).alias("recent_file_commits"),
        known_or(F.floor((F.col("ts") - oldest) / DAY).cast("double"), F.lit(0.0)).alias("file_age_days"),
        known_or(F.floor((F.col("ts") - F.col("last_ts")) / DAY).cast("double"), F.lit(0.0)).alias("days_since_last_change"),
        known_or(F.least(n / F.lit(50.0), F.lit(1.0)), F.lit(0.0)).alias("developer_experience"),
        known_or(F.col("author_square") / (n * n), F.lit(1.0)).alias("ownership_concentration"),
        known_or(F.round(_entropy(F.col("word_total"), F.col("word_xlogx")), 4), F.lit(0.0)).alias("commit_message_entropy"),
        F.when(n > 1, (F.col("last_ts") - oldest) / 3600.0 / (n - 1)).otherwise(0.0).alias("avg_time_between_commits"),
        known_or((F.col("authors") > 1).cast("int"), F.lit(0)).alias("has_multiple_contributors"),
        known_or((F.col("ts") - F.col("last_ts") <= active_days * DAY).cast("int"), F.lit(0)).alias("is_recently_touched"),
    )


def author_experience(commits):
    """Per commit, the author's commits to the repository strictly before it."""
    stamped = with_ts(commits)
    events = stamped.withColumn("prior", F.lit(1))
    before = counts_before(stamped.select("repo", "author", "ts").distinct(), events, ["repo", "author"], ["prior"])
    return stamped.join(before, ["repo", "author", "ts"]).select(
        *commits.columns, F.col("prior").alias("developer_experience")
    )


def asof_history(changes, snapshots):
    """As-of join: the number of earlier changes of the file and the latest one strictly before the snapshot."""
    stamped, snaps = with_ts(changes), with_ts(snapshots)
    before = counts_before(snaps.select(*FILE, "ts"), stamped.withColumn("r", F.lit(1)), FILE, ["r"])
    latest = _numbered(stamped, before).select(
        *FILE, F.col("rank").alias("r"), F.col("commit_id").alias("last_commit_id"), F.col("ts").alias("last_ts")
    )
    return (
        snaps.join(before, [*FILE, "ts"])
        .join(latest, [*FILE, "r"], "left")
        .select(
            *snapshots.columns,
            F.col("r").alias("commits_before"),
            "last_commit_id",
            ((F.col("ts") - F.col("last_ts")) / float(DAY)).alias("days_since_last"),
        )
    )


def future_label(changes, snapshots, window_days=90):
    """Label 1 and the best fix score when a bug-fix change follows within the window, strictly after.

    Otherwise label 0 and the best score of any change in the window, 0 without one.
    The window reaches into the next time bucket only, so each change is placed in
    its own bucket and the one before, and a range frame works inside a bucket;
    changes are first reduced to one row per file and second.
    """
    width = window_days * DAY
    events = with_ts(changes).groupBy(*FILE, "ts").agg(
        F.max("score").alias("any_score"),
        F.max(F.when(F.col("is_bug_fix"), F.col("score"))).alias("fix_score"),
    )
    slots = events.select(
        "*", F.explode(F.array(F.floor(F.col("ts") / width), F.floor(F.col("ts") / width) - 1)).alias("slot")
    )
    snaps = with_ts(snapshots).withColumn("slot", F.floor(F.col("ts") / width))
    marks = snaps.select(*FILE, "ts", "slot").distinct().select(
        *FILE, "ts", "slot",
        F.lit(None).cast("double").alias("any_score"), F.lit(None).cast("double").alias("fix_score"),
        F.lit(True).alias("asked"),
    )
    frame = Window.partitionBy(*FILE, "slot").orderBy("ts").rangeBetween(1, width)
    answers = (
        slots.withColumn("asked", F.lit(False))
        .unionByName(marks)
        .withColumn("best_fix", F.max("fix_score").over(frame))
        .withColumn("best_any", F.max("any_score").over(frame))
        .where("asked")
        .select(*FILE, "ts", "best_fix", "best_any")
    )
    return snaps.join(answers, [*FILE, "ts"]).select(
        *snapshots.columns,
        F.col("best_fix").isNotNull().cast("int").alias("label"),
        F.coalesce("best_fix", "best_any", F.lit(0.0)).alias("label_score"),
    )


def author_concentration(changes):
    """Per file: changes, authors, top author's share and the sum of squared shares."""
    per_author = changes.groupBy(*FILE, "author").agg(F.count(F.lit(1)).alias("c"))
    total = F.sum("c")
    return per_author.groupBy(*FILE).agg(
        total.alias("commits"),
        F.count(F.lit(1)).alias("authors"),
        (F.max("c") / total).alias("top_share"),
        (F.sum(F.col("c") * F.col("c")) / (total * total)).alias("herfindahl"),
    )


def message_entropy(changes):
    """Per file: Shannon entropy in bits of the words of its change messages."""
    words = changes.select(
        *FILE, F.explode(F.filter(F.split(F.lower("message"), r"\s+"), lambda w: w != "")).alias("word")
    )
    counts = words.groupBy(*FILE, "word").agg(F.count(F.lit(1)).cast("double").alias("c"))
    total = F.sum("c")
    return counts.groupBy(*FILE).agg(
        total.cast("long").alias("words"),
        F.round(F.log2(total) - F.sum(F.col("c") * F.log2("c")) / total, 4).alias("entropy"),
    )
