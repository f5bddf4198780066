"""Run logs as streams: attempts keyed by file, works that complete, progress by window.

runs(ts timestamp, work, file, status) arrives in any order; state is bounded by the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MOST_ATTEMPTS = 3
KEEP_MS = 24 * 3600 * 1000  # state of a file is kept so long after its last run


def progress(runs: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts by status in windows of event time (an extension: the batch form is ``manifest``)."""
    return runs.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "status").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "status", "n")


def _count_attempts(key, batches, state):
    if state.hasTimedOut:
        state.remove()
        return
    attempts, status = state.get if state.exists else (0, "")
    rows = pd.concat(list(batches)).sort_values("ts")
    for s in rows["status"]:
        if status != "success":
            attempts, status = attempts + 1, s
    final = status != "success" and attempts >= MOST_ATTEMPTS
    state.update((int(attempts), status))
    # A file that nothing was heard of for so long is forgotten, so state holds live files only.
    state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), int(rows["ts"].max().timestamp() * 1000)) + KEEP_MS)
    yield pd.DataFrame({"work": [key[0]], "file": [key[1]], "attempts": [int(attempts)], "status": ["failed_for_good" if final else status], "retry": [status != "success" and not final]})


def retry_queue(runs: DataFrame, late: str = "10 minutes") -> DataFrame:
    """After every change of a file its attempts, status and whether to try again.

    State is one row per file: upserts by key, at most three attempts.  It goes a day after the file's
    last run, by event time.  ``retry_table`` is the batch form.
    """
    out, kept = "work string, file string, attempts int, status string, retry boolean", "attempts int, status string"
    return runs.withWatermark("ts", late).groupBy("work", "file").applyInPandasWithState(_count_attempts, out, kept, "update", "EventTimeTimeout")


def retry_table(runs: DataFrame) -> DataFrame:
    """T1 / T5 over a whole log: rows (work, file, attempts, status, retry) as the stream leaves them."""
    by_time = F.array_sort(F.collect_list(F.struct("ts", "status")))
    seen = runs.groupBy("work", "file").agg(by_time.alias("r"))
    won = F.array_position(F.transform("r", lambda x: x["status"]), F.lit("success"))
    attempts = F.when(won > 0, won).otherwise(F.size("r")).cast("int")
    seen = seen.withColumns({"attempts": attempts, "last": F.element_at("r", attempts)["status"]})
    final = (F.col("last") != "success") & (F.col("attempts") >= MOST_ATTEMPTS)
    return seen.select("work", "file", "attempts", F.when(final, "failed_for_good").otherwise(F.col("last")).alias("status"), ((F.col("last") != "success") & ~final).alias("retry"))


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Completion(StatefulProcessor):
    """Files seen of a work until it is complete, then a mark that it has been named; a timer ends both."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.files = handle.getMapState("files", "file string", "seen boolean")
        self.count = handle.getValueState("count", "n long")
        self.named = handle.getValueState("named", "named boolean")
        self.ends = handle.getValueState("ends", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = self.count.get()[0] if self.count.exists() else 0
        seen, needed, last = before, 0, timerValues.getCurrentWatermarkInMs()
        for batch in rows:
            needed, last = int(batch["n"].iloc[0]), max(last, int(batch["ts"].max().timestamp() * 1000))
            for file in [] if self.named.exists() else batch["file"].unique():
                if not self.files.containsKey((file,)):
                    self.files.updateValue((file,), (True,))
                    seen += 1
        if self.ends.exists():
            self.handle.deleteTimer(self.ends.get()[0])
        self.ends.update((last + KEEP_MS,))
        self.handle.registerTimer(last + KEEP_MS)
        if not self.named.exists() and seen >= needed:
            self.named.update((True,))
            self.files.clear()
            self.count.clear()
            yield pd.DataFrame({"work": [key[0]]})
        elif seen > before:
            self.count.update((seen,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (self.files, self.count, self.named, self.ends):
            state.clear()
        yield from ()

    def close(self) -> None:
        pass


def completed_works(runs: DataFrame, expected: DataFrame, late: str = "10 minutes") -> DataFrame:
    """T4: works whose number of distinct files reached expected(work, n), exactly.

    On a stream a work is named once, when its last file arrives.  Its files leave the state then; the mark
    that it was named, or what is known of a work that never ends, goes a day after its last run, by event
    time.  A run of a work that comes after that starts the work anew.  Needs the RocksDB state store, which
    is set for the session.
    """
    if not runs.isStreaming:
        return runs.groupBy("work").agg(F.count_distinct("file").alias("seen")).join(expected, "work").filter("seen >= n").select("work")
    runs.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    kind = dict(runs.dtypes)["work"]
    rows = runs.withWatermark("ts", late).select("work", "file", "ts").join(expected, "work")
    return rows.groupBy("work").transformWithStateInPandas(_Completion(), f"work {kind}", "Append", "EventTime")
