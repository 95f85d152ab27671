
from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from ..functions import text as T
from ..operators import sessions as batch

EVENT_SCHEMA = "file string, line_no long, value string"
SESSION_SCHEMA = "file string, tid string, key string, start_ts string, tool_calls long, status string, elapsed double, error_type string, error_msg string, img_type string"
STATE_SCHEMA = "key string, start_ts string, tool_calls long, last long"


def lines(spark: SparkSession, path: str, schema: str = EVENT_SCHEMA, per_trigger: int = 100) -> DataFrame:
    """Numbered lines that a collector drops as JSON files into a folder. Numbers order the lines of a file."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).json(path)


def events(rows: DataFrame) -> DataFrame:
    """What each log line says, by row functions only, as operators.sessions.log_events; lines that say nothing are dropped."""
    return batch.log_events(rows).where("kind <> 'other'").withColumn("error_type", F.when(F.col("kind") == "failed", T.error_class(F.coalesce("message", F.lit("")))))


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, idle: int) -> Iterator[pd.DataFrame]:
    """[R1, W1] One open session a thread is all the state there is. Lines are in order within a batch; a batch's lines follow those of earlier ones."""
    file, tid = key
    open_ = state.get if state.exists else None
    out: list[tuple[Any, ...]] = []
    close = lambda status, *end: out.append((file, tid, open_[0], open_[1], open_[2], status, *(end or (None,) * 4)))
    if state.hasTimedOut:
        close("incomplete")
        state.remove()
    else:
        rows = pd.concat(list(batches)).sort_values("line_no", kind="stable")
        for r in rows.itertuples(index=False):
            if r.kind == "start":
                if open_ is not None:
                    close("incomplete")
                open_ = (r.key, r.ts, 0, int(r.line_no))
            elif open_ is not None and r.kind == "tool":
                open_ = (open_[0], open_[1], open_[2] + 1, int(r.line_no))
            elif open_ is not None:
                failed = r.kind == "failed"
                close("failed" if failed else "success", float(r.elapsed), r.error_type if failed else None, r.message if failed else None, None if failed else r.img_type)
                open_ = None
        if open_ is None:
            if state.exists:
                state.remove()
        else:
            state.update(open_)
            state.setTimeoutDuration(idle)
    yield pd.DataFrame(out, columns=["file", "tid", "key", "start_ts", "tool_calls", "status", "elapsed", "error_type", "error_msg", "img_type"])


#: [R6, H9] A thread that is silent for so long has ended.
IDLE_MS = 300_000


def sessions(rows: DataFrame, idle_ms: int = IDLE_MS) -> DataFrame:
    """[R1] Sessions as they end; a session that stays silent ends as incomplete. operators.sessions.log_sessions is the specification."""
    step = lambda key, batches, state: _step(key, batches, state, idle_ms)
    return events(rows).groupBy("file", "tid").applyInPandasWithState(step, SESSION_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.ProcessingTimeTimeout)


def stop_after(query: StreamingQuery, rows: int, seconds: float = 600.0, stop: bool = True) -> None:
    """Stops a query (or leaves it running) once it has read so many rows and written what they give. A query with timeouts of its own never runs out of batches."""
    end = time.monotonic() + seconds
    while sum(p["numInputRows"] for p in query.recentProgress) < rows:
        if not query.isActive or time.monotonic() > end:
            raise RuntimeError(f"the stream ended or took too long: {query.exception()}")
        time.sleep(0.1)
    if stop:
        query.stop()


def _flags(rows: DataFrame) -> DataFrame:
    """What a line is to a reader of the output."""
    x = rows.select("file", "line_no", T.right_trimmed("value").alias("value"))
    return x.withColumns({"ended": T.done("value").isNotNull() | T.failed("value").isNotNull(), "failed": T.failed("value").isNotNull(), "begun": F.contains("value", F.lit("▶")), "warned": T.tagged("value", "[WARNING]"), "total": F.regexp_extract("value", r"To process:\s*(\d+)", 1).try_cast("long")})


def _counted() -> Column:
    return F.format_string("[%d/%d] %.2f%% (done: %d, errors: %d, warns: %d)", "done", "total", T.percent("done", "total"), "done", "errors", "warns")


def shown(rows: DataFrame) -> DataFrame:
    """[R2] What a reader of a run's output sees: file, line_no, text.

    Before the first session begins or ends, each line that says something, without its time and thread; then a line of
    counts whenever another whole percent of the total is done (the total is the last "To process" before), lines that
    tell of a saved file, and the end. It is the batch form of ``live``.
    """
    x = _flags(rows)
    line = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    count = lambda c: F.sum(F.col(c).cast("int")).over(line)
    x = x.withColumns({"total": F.coalesce(F.last("total", ignorenulls=True).over(line), F.lit(0)), "done": count("ended"), "errors": count("failed"), "body": F.max(F.col("begun") | F.col("ended")).over(line), "warns": F.sum((F.col("warned") & ~F.col("ended")).cast("int")).over(line)})
    x = x.withColumn("percent", F.when(F.col("total") > 0, F.floor(F.col("done") * 100 / F.col("total"))).otherwise(-1))
    before = F.coalesce(F.max(F.when(F.col("ended"), F.col("percent"))).over(Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    x = x.withColumn("last", before)
    clean = T.without_prefix("value")
    said = _counted()
    text = (
        F.when(~F.col("body"), F.when((F.trim(clean) != "") & ~clean.rlike("^=+"), clean))
        .when(F.col("ended"), F.when(F.col("percent") > F.col("last"), said))
        .when(F.contains("value", F.lit("Saved:")), clean)
        .when(F.contains("value", F.lit("Done!")), F.concat(said, F.lit("\nDone!")))
    )
    return x.select("file", "line_no", text.alias("text")).where("text is not null")


LIVE_SCHEMA = "file string, line_no long, kind string, clean string, done long, total long, errors long, warns long"


class _Shown(StatefulProcessor):
    """What ``shown`` keeps of a file's earlier lines: counts, and lines that came before their turn."""

    def __init__(self, dense: bool, idle: int):
        self.dense, self.idle = dense, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", "next long, total long, done long, errors long, warns long, body boolean, last long")
        self.early = handle.getListState("early", "line_no long, clean string, ended boolean, failed boolean, begun boolean, warned boolean, total long, saved boolean, over boolean")
        self.timer = handle.getValueState("timer", "at long")

    def _emitted(self, file: str, rows: list[tuple], whole: bool) -> pd.DataFrame:
        """Goes on with the rows whose turn it is (all, if whole) and keeps the others."""
        following, total, done, errors, warns, body, last = self.counts.get() if self.counts.exists() else (0, 0, 0, 0, 0, False, -1)
        out, rows = [], sorted(rows)
        for k, (n, clean, ended, failed, begun, warned, said, saved, over) in enumerate(rows):
            if n > following and not whole:
                break
            following = max(following, n + 1)
            total = total if said is None or said != said else int(said)
            done, errors, warns, body = done + ended, errors + failed, warns + (warned and not ended), body or begun or ended
            percent = done * 100 // total if total > 0 else -1
            kind = ("count" if percent > last else None) if body and ended else None if body and not (saved or over) else "line" if not body or saved else "over"
            if not body and (not clean.strip(" ") or clean.startswith("=")):
                kind = None
            last = max(last, percent) if ended else last
            if kind:
                out.append((file, n, kind, clean, done, total, errors, warns))
        else:
            k = len(rows)
        self.counts.update((following, total, done, errors, warns, body, last))
        if rows[k:]:
            self.early.put(rows[k:])
        elif self.early.exists():
            self.early.clear()
        return pd.DataFrame(out, columns=["file", "line_no", "kind", "clean", "done", "total", "errors", "warns"])

    def _waiting(self) -> list[tuple]:
        return [tuple(r) for r in self.early.get()] if self.early.exists() else []

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = [tuple(r) for b in rows for r in b.drop(columns="file").astype(object).where(b.drop(columns="file").notna(), None).itertuples(index=False)]
        yield self._emitted(key[0], self._waiting() + new, not self.dense)
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
            self.timer.clear()
        if self.early.exists():
            at = timerValues.getCurrentProcessingTimeInMs() + self.idle
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.timer.clear()
        yield self._emitted(key[0], self._waiting(), True)

    def close(self) -> None:
        pass


def live(rows: DataFrame, dense: bool = True, idle_ms: int = IDLE_MS) -> DataFrame:
    """[R2] ``shown`` of a stream: file, line_no, text as lines come. A batch costs its own lines, whatever came before.

    Kept of a file are its counts. If its lines are numbered without gaps from 0 (dense), lines that come before their turn
    wait in the state; when no more lines of a file come for idle_ms, a missing one is given up. Otherwise lines are
    taken as batches bring them, in order within a batch. Start the query with ``started``.
    """
    flags = _flags(rows).select(
        "file", "line_no", T.without_prefix("value").alias("clean"), *[F.coalesce(c, F.lit(False)).alias(c) for c in ("ended", "failed", "begun", "warned")], "total",
        F.contains("value", F.lit("Saved:")).alias("saved"), F.contains("value", F.lit("Done!")).alias("over"),
    )
    kept = flags.groupBy("file").transformWithStateInPandas(_Shown(dense, idle_ms), LIVE_SCHEMA, "append", "processingTime")
    said = _counted()
    return kept.select("file", "line_no", F.when(F.col("kind") == "line", F.col("clean")).when(F.col("kind") == "count", said).otherwise(F.concat(said, F.lit("\nDone!"))).alias("text"))


def started(writer: DataStreamWriter, spark: SparkSession) -> StreamingQuery:
    """Starts a query with state of several kinds, for which Spark needs its RocksDB state store; the session's choice stays."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return writer.start()
    finally:
        spark.conf.set(name, before)


def progress(rows: DataFrame, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """[R2, A24] done, errors and warnings by window of a stream with an event time column at."""
    flags = rows.withWatermark("at", late).select("at", T.done("value").isNotNull().alias("d"), T.failed("value").isNotNull().alias("f"), T.tagged("value", "[WARNING]").alias("w"))
    count = lambda c, name: F.count(F.when(c, 1)).alias(name)
    return flags.groupBy(F.window("at", window)).agg(count(F.col("d") | F.col("f"), "done"), count(F.col("f"), "errors"), count(F.col("w"), "warnings"))


def upserting(apply: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """[R3] foreachBatch function of one writer: keeps the last row of each key in a batch and hands it on; batch ids make a repeat harmless."""
    from ..operators.sessions import latest_per_key

    def run(batch: DataFrame, number: int) -> None:
        apply(latest_per_key(batch, "key", ["seq"]), number)

    return run
