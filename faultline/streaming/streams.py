"""Stream versions of the batch operators on Structured Streaming.

Windowed and stateful results leave in append mode: the watermark, the latest event time less a delay, closes windows, fires
timers and frees state, so a result row leaves once and what a query holds does not grow with the length of the stream.
Rows later than the delay are dropped.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

from faultline.operators.commits import score_commits

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_stream(spark, folder, name_glob, schema):
    """A file stream over Parquet files of a folder that hold other tables too."""
    return spark.readStream.schema(schema).option("pathGlobFilter", name_glob).parquet(folder)


def run_to_parquet(stream, out_folder, checkpoint, mode="append"):
    """Process everything available and stop; the sink is a Parquet folder."""
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", out_folder).option(
        "checkpointLocation", checkpoint
    ).trigger(availableNow=True).start()
    q.awaitTermination()


def run_complete(stream, out_folder, checkpoint):
    """Process everything available of a complete-mode aggregate; each batch replaces the output table."""

    def replace(batch, _):
        batch.write.mode("overwrite").parquet(out_folder)

    q = stream.writeStream.outputMode("complete").foreachBatch(replace).option("checkpointLocation", checkpoint).trigger(
        availableNow=True
    ).start()
    q.awaitTermination()


def scored_stream(commits, threshold=0.40):
    """Commits with their scores as they arrive; no state."""
    return score_commits(commits, threshold)


PR_ACTIONS = ["opened", "synchronize", "reopened"]
PR_SCHEMA = "action string, number long, repo string, files array<struct<path:string,source:string>>"


def change_set_events(raw, column="value"):
    """Parsed change-set events with an action that starts a review."""
    parsed = raw.withColumn("_e", F.from_json(F.col(column), PR_SCHEMA))
    return parsed.where(F.col("_e.action").isin(PR_ACTIONS)).select(
        *[c for c in raw.columns if c != column], "_e.action", "_e.number", "_e.repo", F.lit("queued").alias("status")
    )


def dedup_stream(events, key, time, delay="7 days"):
    """Each key once while its watermark lasts."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(key)


def progress_stream(snapshots, label="future_bug_fix"):
    """Rows and positives per repository so far; run in complete mode, its state is a row for each repository."""
    return snapshots.groupBy("repo").agg(F.count(F.lit(1)).alias("rows"), F.sum(label).cast("long").alias("positives"))


def windowed_fixes(scored, time, size, slide=None, delay="1 day"):
    """Commits and fixes per tumbling or sliding window, each window once, when the watermark has passed its end."""
    window = F.window(time, size, slide) if slide else F.window(time, size)
    return scored.withWatermark(time, delay).groupBy(window).agg(
        F.count(F.lit(1)).alias("commits"), F.count_if("is_bug_fix").alias("fixes")
    ).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "commits", "fixes")


def edit_sessions(edits, key, time, value, gap="30 minutes", delay="1 hour"):
    """One row per burst of edits, when the watermark has passed its end: its bounds, number of edits and latest value."""
    return edits.withWatermark(time, delay).groupBy(F.session_window(time, gap), key).agg(
        F.count(F.lit(1)).alias("edits"), F.max_by(value, time).alias("latest")
    ).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "edits", "latest")


def _packed(frame):
    """A table as one value of state."""
    sink = pa.BufferOutputStream()
    table = pa.Table.from_pandas(frame, preserve_index=False)
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(data):
    return pa.ipc.open_stream(data).read_all().to_pandas()


class Sorted(StatefulProcessor):
    """Holds a key's rows until the watermark has passed their time, then hands them to `release` in time order.

    However rows are dealt out to batches, and in whatever order they come, `release` sees the same sequence. Rows that the
    watermark has passed when they come are late and dropped. One timer per key stands at its earliest held row.
    """

    ORDER = ["at", "event_id"]

    def init(self, handle):
        self._handle = handle
        self._held = handle.getValueState("held", "rows binary")

    def ready_at(self, rows):
        """When each row may go, in microseconds like `at`, the time of the row."""
        return rows["at"].to_numpy()

    def release(self, key, rows):
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues):
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        new = [x[x["at"] > passed] for x in rows]
        held = [_unpacked(self._held.get()[0])] if self._held.exists() else []
        yield from self._go(key, pd.concat([*held, *new], ignore_index=True), timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self._held.exists():
            yield from self._go(key, _unpacked(self._held.get()[0]), timerValues)

    def _go(self, key, rows, timerValues):
        ready = self.ready_at(rows)
        due = ready <= timerValues.getCurrentWatermarkInMs() * 1000
        for old in list(self._handle.listTimers()):
            self._handle.deleteTimer(old)
        if due.all():
            self._held.clear()
        else:
            self._held.update((_packed(rows[~due]),))
            self._handle.registerTimer(-(-int(ready[~due].min()) // 1000))
        if due.any():
            yield self.release(key, rows[due].sort_values(self.ORDER, kind="stable", ignore_index=True))

    def close(self):
        pass


def _timed(events, delay):
    """The events with their time in microseconds, `at`, whatever the session's time zone."""
    return events.withWatermark("ts", delay).withColumn("at", F.unix_micros("ts"))


class FutureLabels(Sorted):
    """Labels snapshots: a snapshot is held until the watermark is `days` past it, then leaves with 1 if a fix of its key came in
    that time, strictly after it, else 0.

    Of the fixes the earliest and the latest of each day are kept: a window that ends in a day asks for that day's earliest,
    one that begins in it for its latest, and one that spans it for any.
    """

    ORDER = ["at", "id"]
    DAY = 86_400_000_000

    def __init__(self, days):
        self._width = days * self.DAY

    def init(self, handle):
        super().init(handle)
        self._fixes = handle.getValueState("fixes", "rows binary")

    def ready_at(self, rows):
        return rows["at"].to_numpy() + self._width

    def handleInputRows(self, key, rows, timerValues):
        new = pd.concat(list(rows), ignore_index=True)
        at = new.loc[new["is_fix"] & (new["at"] > timerValues.getCurrentWatermarkInMs() * 1000), "at"].to_numpy()
        if len(at):
            known = [_unpacked(self._fixes.get()[0])] if self._fixes.exists() else []
            self._keep(pd.concat([*known, pd.DataFrame({"day": at // self.DAY, "first": at, "last": at})]), timerValues)
        yield from super().handleInputRows(key, iter([new[~new["is_fix"]]]), timerValues)

    def _keep(self, fixes, timerValues):
        """Fixes up to the watermark serve held snapshots only; with none held they go."""
        done = timerValues.getCurrentWatermarkInMs() * 1000
        if self._held.exists():
            done = min(done, int(_unpacked(self._held.get()[0])["at"].min()))
        fixes = fixes[fixes["last"] > done].groupby("day", as_index=False).agg({"first": "min", "last": "max"})
        if len(fixes):
            self._fixes.update((_packed(fixes),))
        else:
            self._fixes.clear()

    def _go(self, key, rows, timerValues):
        if len(rows):
            yield from super()._go(key, rows, timerValues)
        if self._fixes.exists():
            self._keep(_unpacked(self._fixes.get()[0]), timerValues)

    def release(self, key, rows):
        at = rows["at"].to_numpy()
        label = np.zeros(len(rows), np.int32)
        if self._fixes.exists():
            fixes = _unpacked(self._fixes.get()[0]).sort_values("day")
            first, last = fixes["first"].to_numpy(), fixes["last"].to_numpy()
            place = np.searchsorted(last, at, side="right")  # the first day with a fix after the snapshot
            inside = np.minimum(place, len(last) - 1)
            soonest = np.where(first[inside] > at, first[inside], last[inside])
            label = ((place < len(last)) & (soonest <= at + self._width)).astype(np.int32)
        return pd.DataFrame({"file": key[0], "id": rows["id"], "label": label})


def label_stream(snapshots, fixes, window_days=90, delay="1 day"):
    """(file, id, label) of each snapshot, once, when the watermark is `window_days` past it.

    snapshots are (file, id, ts), fixes (file, ts); both may come in any order within the delay.
    """
    events = snapshots.select("file", "id", "ts", F.lit(False).alias("is_fix")).unionByName(
        fixes.select("file", F.lit(0).cast("long").alias("id"), "ts", F.lit(True).alias("is_fix"))
    )
    return _timed(events, delay).groupBy("file").transformWithStateInPandas(
        statefulProcessor=FutureLabels(window_days), outputStructType=_schema("file string, id long, label int"), outputMode="Append", timeMode="EventTime",
    )


class FileHistory(Sorted):
    """Running history of a key: before each event the events and errors so far, kinds seen, days since the first and the last one."""

    def init(self, handle):
        super().init(handle)
        self._totals = handle.getValueState("totals", "n long, fixes long, first double, last double, kinds array<string>")

    def release(self, key, rows):
        n, fixes, first, last, kinds = self._totals.get() if self._totals.exists() else (0, 0, np.nan, np.nan, [])
        t, fix = rows["at"].to_numpy() / 1e6, rows["is_fix"].to_numpy().astype(np.int64)
        first = t[0] if n == 0 else first
        before = np.concatenate([[last], t[:-1]])
        fresh = ~(rows["kind"].duplicated() | rows["kind"].isin(list(kinds))).to_numpy()
        number = n + np.arange(len(rows))
        out = pd.DataFrame({
            "file": key[0], "event_id": rows["event_id"], "previous_commits": number, "previous_fixes": fixes + np.cumsum(fix) - fix,
            "contributors": len(kinds) + np.cumsum(fresh) - fresh, "age_days": (t - first) / 86400, "days_since_last": np.where(number > 0, t - before, 0.0) / 86400,
        })
        self._totals.update((int(n + len(rows)), int(fixes + fix.sum()), float(first), float(t[-1]), [*kinds, *rows["kind"][fresh]]))
        return out


FILE_HISTORY_SCHEMA = "file long, event_id long, previous_commits long, previous_fixes long, contributors long, age_days double, days_since_last double"


def file_history_stream(events, delay="1 day"):
    """Per event the history of its file before it, once, when the watermark has passed it; events are (file, event_id, ts, kind, is_fix)."""
    return _timed(events, delay).groupBy("file").transformWithStateInPandas(
        statefulProcessor=FileHistory(), outputStructType=_schema(FILE_HISTORY_SCHEMA), outputMode="Append", timeMode="EventTime"
    )


class NewestRows(Sorted):
    """Each event as it joins the newest n of its key, with the one that leaves them for it."""

    def __init__(self, n):
        self._n = n

    def init(self, handle):
        super().init(handle)
        self._newest = handle.getValueState("newest", "ids array<long>")

    def release(self, key, rows):
        known = list(self._newest.get()[0]) if self._newest.exists() else []
        ids = pd.Series([*known, *rows["event_id"]], dtype="Int64")
        self._newest.update(([int(i) for i in ids[-self._n :]],))
        return pd.DataFrame({"file": key[0], "event_id": rows["event_id"], "leaves": ids.shift(self._n)[len(known) :].reset_index(drop=True)})


def newest_stream(events, n, delay="1 day"):
    """(file, event_id, leaves): who joins and who leaves the newest n events of each file, once, when the watermark has passed; the
    newest n are those that have joined and not left. Events are (file, event_id, ts)."""
    return _timed(events, delay).groupBy("file").transformWithStateInPandas(
        statefulProcessor=NewestRows(n), outputStructType=_schema("file long, event_id long, leaves long"), outputMode="Append", timeMode="EventTime"
    )


def _schema(ddl):
    return StructType.fromDDL(ddl)
