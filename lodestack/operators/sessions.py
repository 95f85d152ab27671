"""

Order within a key is needed. A key's rows are cut into segments, ranges of the order; each segment gives its effect on what
comes after it (counts, the last start, the last end), the effects of the segments before are put together in a window
over one row a segment, and segments are then finished side by side. So one thread with most lines of all runs in many
tasks. Without a segment a key's rows are sorted in one task, on disk if they don't fit. Logs are cut every SEGMENT_LINES.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.text import _c

STATUS = ("pending", "success", "failed", "incomplete")


#: Lines of a log in a segment.
SEGMENT_LINES = 1 << 18


def _carried(rows: DataFrame, by: list[str], effects: dict[str, Column], before: dict[str, Callable[[WindowSpec], Column]]) -> DataFrame:
    """rows(by, _segment, ...) with what the segments before a row's own leave behind: ``effects`` of each, put together by ``before``."""
    each = rows.groupBy(*by, "_segment").agg(*[c.alias(name) for name, c in effects.items()])
    line = Window.partitionBy(*by).orderBy("_segment")
    left = each.select(*[F.col(c).alias(f"_at_{c}") for c in [*by, "_segment"]], *[c(line).alias(name) for name, c in before.items()])
    here = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_at_{c}")) for c in [*by, "_segment"]])
    return rows.join(left, here).drop(*[f"_at_{c}" for c in [*by, "_segment"]])


def _earlier(line: WindowSpec) -> WindowSpec:
    return line.rowsBetween(Window.unboundedPreceding, -1)


def sessionise(rows: DataFrame, by: list[str], order: list[str], kind: str | Column, key: str | Column, elapsed: str | Column, started: str | Column, message: str | Column, img_type: str | Column | None = None, segment: Column | None = None) -> DataFrame:
    """[W1] One row a session.

    kind is start, tool, done, failed or anything else. A start opens a session and closes an open one as incomplete;
    rows without an open session and rows after its end count nothing; an end closes it; one that never ends is incomplete.
    segment must not fall along the order; rows with the same order are in no order.
    """
    base = rows.select(*by, *order, _c(kind).alias("_kind"), _c(key).alias("_key"), _c(elapsed).cast("double").alias("_elapsed"), _c(started).alias("_started"), _c(message).alias("_message"), (F.lit(None).cast("string") if img_type is None else _c(img_type)).alias("_img"), (F.lit(0) if segment is None else segment).alias("_segment"))
    starts, final = F.col("_kind") == "start", F.col("_kind").isin("done", "failed")
    sessions, ended = F.lit(0), F.lit(False)
    if segment is not None:
        at = F.struct(*order)
        base = _carried(
            base, by, {"_n": F.count(F.when(starts, 1)), "_start": F.max(F.when(starts, at)), "_end": F.max(F.when(final, at))},
            {"_sessions": lambda w: F.coalesce(F.sum("_n").over(_earlier(w)), F.lit(0)), "_ended": lambda w: F.coalesce(F.max("_end").over(_earlier(w)) > F.max("_start").over(_earlier(w)), F.lit(False))},
        )
        sessions, ended = F.col("_sessions"), F.col("_ended")
    line = Window.partitionBy(*by, "_segment").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    base = base.withColumn("session", sessions + F.sum(starts.cast("int")).over(line)).where("session > 0")
    # The end is the first one of the session; what comes later belongs to nobody.
    inside = Window.partitionBy(*by, "_segment", "session").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    over = F.coalesce(F.max(final).over(inside), F.lit(False)) | (ended & (F.col("session") == sessions))
    base = base.withColumn("_over", over).where("not _over")
    of = lambda c, *kinds: F.max(F.when(F.col("_kind").isin(*kinds), F.col(c)))  # noqa: E731  a session has one row of each
    out = base.groupBy(*by, "session").agg(
        of("_key", "start").alias("key"), of("_started", "start").alias("start_ts"),
        F.count(F.when(F.col("_kind") == "tool", 1)).alias("tool_calls"),
        F.coalesce(F.max(F.when(F.col("_kind") == "done", "success").when(F.col("_kind") == "failed", "failed")), F.lit("incomplete")).alias("status"),
        of("_elapsed", "done", "failed").alias("elapsed"), of("_message", "failed").alias("error_msg"), of("_img", "done").alias("img_type"),
    )
    return out.withColumn("error_type", F.when(F.col("status") == "failed", T.error_class(F.coalesce("error_msg", F.lit("")))))


def log_events(lines: DataFrame) -> DataFrame:
    """Log lines (file, line_no, value) with time, thread and what they say; other lines are dropped. A line's first meaning counts."""
    x = lines.select("file", "line_no", T.right_trimmed("value").alias("value")).withColumn("ts", T.log_time("value")).where("ts is not null")
    x = x.withColumns({"tid": T.log_thread("value"), "_start": T.started_key("value"), "_done": T.done("value"), "_failed": T.failed("value")})
    kind = F.when(F.col("_start").isNotNull(), "start").when(T.tagged("value", "[ToolCall]"), "tool").when(F.col("_done").isNotNull(), "done").when(F.col("_failed").isNotNull(), "failed").otherwise("other")
    return x.select(
        "file", "tid", "line_no", "ts", "value", kind.alias("kind"), F.col("_start").alias("key"),
        F.coalesce("_done.elapsed", "_failed.elapsed").alias("elapsed"), F.col("_failed.message").alias("message"), F.col("_done.img_type").alias("img_type"),
    )


def log_sessions(lines: DataFrame) -> DataFrame:
    """[W1, U1, A22] Sessions of one or many logs: file, tid, session, key, start_ts, tool_calls, status, elapsed, error_type, error_msg, img_type."""
    return sessionise(log_events(lines), ["file", "tid"], ["line_no"], "kind", "key", "elapsed", "ts", "message", "img_type", F.expr(f"line_no div {SEGMENT_LINES}"))


def problem_blocks(rows: DataFrame, by: list[str], order: list[str], header: str | Column, flag: str | Column, segment: Column | None = None) -> DataFrame:
    """[W2] Blocks from a header (its path; null for other rows) to the next: block, path, bad if a later row is flagged."""
    base = rows.select(*by, *order, _c(header).alias("_path"), _c(flag).alias("_flag"), (F.lit(0) if segment is None else segment).alias("_segment"))
    blocks = F.lit(0)
    if segment is not None:
        base = _carried(base, by, {"_n": F.count("_path")}, {"_blocks": lambda w: F.coalesce(F.sum("_n").over(_earlier(w)), F.lit(0))})
        blocks = F.col("_blocks")
    line = Window.partitionBy(*by, "_segment").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    base = base.withColumn("block", blocks + F.count("_path").over(line)).where("block > 0")
    return base.groupBy(*by, "block").agg(F.max("_path").alias("path"), F.coalesce(F.max(F.col("_flag") & F.col("_path").isNull()), F.lit(False)).alias("bad"))


def log_problems(lines: DataFrame) -> DataFrame:
    """[W2, U2] Distinct paths of blocks with an error or a warning."""
    flagged = T.tagged("value", "[ERROR]", "[WARNING]")
    return problem_blocks(lines, ["file"], ["line_no"], T.header_path("value"), flagged, F.expr(f"line_no div {SEGMENT_LINES}")).where("bad").select("path").distinct()


def running_progress(rows: DataFrame, by: list[str], order: list[str], counted: str | Column, total: str | Column, segment: Column | None = None) -> DataFrame:
    """[W4, A24] Counted rows with their running count and whole percent, where that percent exceeds the one before."""
    base = rows.where(_c(counted)).select(*by, *order, _c(total).alias("total"), (F.lit(0) if segment is None else segment).alias("_segment"))
    percent = lambda done, total: F.when(F.col(total) > 0, F.floor(F.col(done) * 100 / F.col(total))).otherwise(0).cast("long")
    if segment is None:
        base = base.withColumns({"_done": F.lit(0), "_total": F.lit(None).cast("long")})
    else:
        # a segment that is there has a row, so the one before has the row before
        base = _carried(
            base, by, {"_n": F.count(F.lit(1)), "_t": F.max_by("total", F.struct(*order))},
            {"_done": lambda w: F.coalesce(F.sum("_n").over(_earlier(w)), F.lit(0)), "_total": lambda w: F.lag("_t").over(w)},
        )
    line = Window.partitionBy(*by, "_segment").orderBy(*order)
    base = base.withColumn("done", (F.col("_done") + F.row_number().over(line)).cast("int" if segment is None else "long"))
    base = base.withColumn("percent", percent("done", "total"))
    before = F.when(F.col("_done") > 0, percent("_done", "_total")).otherwise(-1)
    return base.withColumn("_last", F.coalesce(F.lag("percent").over(line), before)).where("percent > _last").drop("_last", "_segment", "_done", "_total")


def first_seen(rows: DataFrame, name: str, order: list[str]) -> DataFrame:
    """[W7] The first row of each name: with aggregates that combine before the shuffle, so a hot name is no burden."""
    rest = [c for c in rows.columns if c != name]
    return rows.groupBy(name).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(name, "_r.*")


def latest_per_key(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """[A23, K4] The last row of each key."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(key, "_r.*")


def round_robin(rows: DataFrame, by: list[str], order: list[str], workers: int) -> DataFrame:
    """[W10] Worker numbers 1 to ``workers`` in turn, within each value of by."""
    return rows.withColumn("worker", ((F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1) % workers + 1).cast("long"))


def sample_n(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """[T7] n rows without replacement, the same for a seed: those with the smallest md5 of key and seed."""
    return rows.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), key).limit(n)


def event_sessions(events: DataFrame) -> DataFrame:
    """[W1] The event log as sessions of users: signup starts, view and click are calls, purchase is done, error has failed."""
    kind = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type").isin("view", "click"), "tool").when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "failed")
    return sessionise(events, ["user_id"], ["ts", "event_id"], kind, F.col("event_id"), "value", T.micros("ts") / 1e6, F.lit("timeout"))
