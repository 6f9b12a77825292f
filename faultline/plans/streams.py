"""Registered queries on streams: all available files are processed and the sink is read back."""

from contextlib import contextmanager

from pyspark.sql import functions as F

from faultline.plans.check_text import scored
from faultline.plans.inputs import VIEWS
from faultline.plans.registry import query_on_dir
from faultline.session import work_folder
from faultline.streaming import streams as op

EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
ORDER_SCHEMA = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"


@contextmanager
def rocksdb(spark):
    """Stateful processors need this state store; the session's own setting comes back."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, op.ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def folders(spark, label):
    base = work_folder(spark, label)
    return f"{base}/out", f"{base}/state"


def commit_stream(spark, sf_dir):
    """The commit view as a stream over the orders file."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    op.read_stream(spark, sf_dir, "orders.parquet", ORDER_SCHEMA).createOrReplaceTempView("orders")
    commits = spark.sql(VIEWS["c_commits"])
    return commits.withColumn("commit_date", F.col("commit_date").cast("timestamp"))


def event_stream(spark, sf_dir):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    events = op.read_stream(spark, sf_dir, "events.parquet", EVENT_SCHEMA)
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


@query_on_dir("stream_commit_score", "C", f"WITH {scored('c_commits')} SELECT commit_id, score, is_bug_fix FROM scored")
def stream_commit_score(spark, sf_dir, _batch):
    out, state = folders(spark, "score")
    op.run_to_parquet(op.scored_stream(commit_stream(spark, sf_dir)).select("commit_id", "score", "is_bug_fix"), out, state)
    return spark.read.parquet(out)


@query_on_dir(
    "stream_pr_filter", "",
    """SELECT event_id, CASE event_type WHEN 'click' THEN 'opened' WHEN 'view' THEN 'synchronize' END AS action, user_id AS number, 'queued' AS status
FROM events WHERE event_type IN ('click', 'view')""",
)
def stream_pr_filter(spark, sf_dir):
    out, state = folders(spark, "changes")
    action = F.when(F.col("event_type") == "click", "opened").when(F.col("event_type") == "view", "synchronize").otherwise("closed")
    raw = event_stream(spark, sf_dir).select(
        "event_id", F.to_json(F.struct(action.alias("action"), F.col("user_id").alias("number"), F.lit("r").alias("repo"))).alias("value")
    )
    op.run_to_parquet(op.change_set_events(raw).select("event_id", "action", "number", "status"), out, state)
    return spark.read.parquet(out)


@query_on_dir("stream_dedup", "", "SELECT DISTINCT concat(user_id, '|', event_type) AS snapshot_id FROM events")
def stream_dedup(spark, sf_dir):
    """The events are one file, so one batch, in which each key leaves once; the state is freed two days after."""
    out, state = folders(spark, "dedup")
    keyed = event_stream(spark, sf_dir).select(F.concat_ws("|", F.col("user_id").cast("string"), "event_type").alias("snapshot_id"), "ts")
    op.run_to_parquet(op.dedup_stream(keyed, ["snapshot_id"], "ts", "2 days").select("snapshot_id"), out, state)
    return spark.read.parquet(out)


@query_on_dir(
    "stream_progress", "",
    "SELECT concat('repo', user_id % 8) AS repo, count(*) AS rows, count(*) FILTER (event_type = 'error') AS positives FROM events GROUP BY 1",
)
def stream_progress(spark, sf_dir):
    out, state = folders(spark, "progress")
    rows = event_stream(spark, sf_dir).select(
        F.concat(F.lit("repo"), (F.col("user_id") % 8).cast("string")).alias("repo"), (F.col("event_type") == "error").cast("int").alias("future_bug_fix")
    )
    op.run_complete(op.progress_stream(rows), out, state)
    return spark.read.parquet(out)


def fix_events(spark, sf_dir):
    return event_stream(spark, sf_dir).select("event_id", "ts", (F.col("event_type") == "error").alias("is_bug_fix"))


@query_on_dir(
    "stream_tumbling", "",
    """SELECT strftime(time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d') AS start, count(*) AS commits, count(*) FILTER (event_type = 'error') AS fixes FROM events GROUP BY 1""",
)
def stream_tumbling(spark, sf_dir):
    """All weeks. In complete mode, so that those still open at the end are part of the result."""
    out, state = folders(spark, "tumbling")
    op.run_complete(op.windowed_fixes(fix_events(spark, sf_dir), "ts", "7 days"), out, state)
    return spark.read.parquet(out).select(F.date_format("start", "yyyy-MM-dd").alias("start"), "commits", "fixes")


@query_on_dir(
    "stream_sliding", "",
    """SELECT strftime(date_trunc('day', ts) - to_days(i::INT), '%Y-%m-%d') AS start, count(*) AS commits, count(*) FILTER (event_type = 'error') AS fixes FROM events, range(30) r(i) GROUP BY 1""",
)
def stream_sliding(spark, sf_dir):
    """Thirty days, each day anew; in complete mode, so that those still open at the end are part of the result."""
    out, state = folders(spark, "sliding")
    op.run_complete(op.windowed_fixes(fix_events(spark, sf_dir), "ts", "30 days", "1 day"), out, state)
    return spark.read.parquet(out).select(F.date_format("start", "yyyy-MM-dd").alias("start"), "commits", "fixes")


@query_on_dir(
    "stream_session", "",
    """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS b FROM events),
s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS edits, max_by(event_id, ts) AS latest FROM s GROUP BY user_id, sid""",
)
def stream_session(spark, sf_dir):
    """In complete mode, so that sessions still open at the end are part of the result."""
    out, state = folders(spark, "session")
    op.run_complete(op.edit_sessions(event_stream(spark, sf_dir), "user_id", "ts", "event_id", "12 hours"), out, state)
    return spark.read.parquet(out).select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "edits", "latest")


CLOSED = "(SELECT max(ts) FROM events)"


@query_on_dir(
    "stream_future_label", "C",
    f"""WITH {scored('c_commits')}, keyed AS (SELECT *, concat(repo, '/', author) AS file FROM scored)
SELECT s.file, s.commit_id AS id, (count(f.commit_id) > 0)::INT AS label
FROM keyed s LEFT JOIN keyed f ON s.file = f.file AND f.is_bug_fix AND f.commit_date > s.commit_date AND f.commit_date <= s.commit_date + INTERVAL 90 DAY
WHERE s.commit_date + INTERVAL 90 DAY <= (SELECT max(commit_date) FROM c_commits) - INTERVAL 1 DAY GROUP BY 1, 2""",
)
def stream_future_label(spark, sf_dir, _batch):
    """Whether a fix by the same author in the same repository follows a commit within 90 days, for commits whose 90 days are over."""
    out, state = folders(spark, "label")
    with rocksdb(spark):
        scored = op.scored_stream(commit_stream(spark, sf_dir)).select(F.concat_ws("/", "repo", "author").alias("file"), F.col("commit_id").alias("id"), F.col("commit_date").alias("ts"), "is_bug_fix")
        op.run_to_parquet(op.label_stream(scored, scored.where("is_bug_fix")), out, state)
    return spark.read.parquet(out)


@query_on_dir(
    "stream_file_history", "",
    f"""SELECT a.user_id AS file, a.event_id, count(b.event_id) AS previous_commits, count(*) FILTER (b.event_type = 'error') AS previous_fixes, count(DISTINCT b.event_type) AS contributors,
  round(coalesce((epoch(any_value(a.ts)) - epoch(min(b.ts))) / 86400, 0), 6) AS age_days, round(coalesce((epoch(any_value(a.ts)) - epoch(max(b.ts))) / 86400, 0), 6) AS days_since_last
FROM events a LEFT JOIN events b ON a.user_id = b.user_id AND (b.ts < a.ts OR (b.ts = a.ts AND b.event_id < a.event_id))
WHERE a.ts <= {CLOSED} - INTERVAL 1 DAY GROUP BY 1, 2""",
)
def stream_file_history(spark, sf_dir):
    """History before each event that the watermark has passed."""
    out, state = folders(spark, "history")
    with rocksdb(spark):
        events = event_stream(spark, sf_dir).select(
            F.col("user_id").alias("file"), "event_id", "ts", F.col("event_type").alias("kind"), (F.col("event_type") == "error").alias("is_fix")
        )
        op.run_to_parquet(op.file_history_stream(events), out, state)
    return spark.read.parquet(out).withColumn("age_days", F.round("age_days", 6)).withColumn("days_since_last", F.round("days_since_last", 6))


@query_on_dir(
    "stream_last_n", "",
    f"""SELECT file, event_id FROM (SELECT user_id AS file, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
FROM events WHERE ts <= {CLOSED} - INTERVAL 1 DAY) WHERE rn <= 20""",
)
def stream_last_n(spark, sf_dir):
    """The newest twenty events of each file when the watermark has passed: those that joined and did not leave."""
    out, state = folders(spark, "newest")
    with rocksdb(spark):
        events = event_stream(spark, sf_dir).select(F.col("user_id").alias("file"), "event_id", "ts")
        op.run_to_parquet(op.newest_stream(events, 20), out, state)
    rows = spark.read.parquet(out)
    left = rows.where("leaves IS NOT NULL").select("file", F.col("leaves").alias("event_id"))
    return rows.select("file", "event_id").join(left, ["file", "event_id"], "left_anti")
