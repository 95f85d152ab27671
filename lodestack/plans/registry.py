"""Every query of the library itself on the driver's tables, with the DuckDB SQL it is held against.

Documents have no Markdown images, so links of web pages stand in for references and
lines for pages; roles of the event log are those of operators.sessions.event_sessions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import policy
from ..functions import text as T
from ..operators import markdown, organize, parts, progress, sessions, statistics

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}

LINK = r'<a href="([^"]*)"'


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql is not None:
            _sql[f.__name__] = sql
        return f

    return keep


# Sessions and their statistics

SESSIONS = """
WITH base AS (
  SELECT user_id, ts, event_id, value, event_type, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM events),
ended AS (
  SELECT *, coalesce(max(CASE WHEN event_type IN ('purchase', 'error') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, session ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS over_ FROM base WHERE session > 0),
s AS (
  SELECT user_id, session, max(CASE WHEN event_type = 'signup' THEN event_id END) AS key, max(CASE WHEN event_type = 'signup' THEN epoch_us(ts) / 1e6 END) AS start_seconds,
    count(CASE WHEN event_type IN ('view', 'click') THEN 1 END) AS tool_calls,
    CASE WHEN count(CASE WHEN event_type = 'purchase' THEN 1 END) > 0 THEN 'success' WHEN count(CASE WHEN event_type = 'error' THEN 1 END) > 0 THEN 'failed' ELSE 'incomplete' END AS status,
    max(CASE WHEN event_type IN ('purchase', 'error') THEN value END) AS elapsed
  FROM ended WHERE over_ = 0 GROUP BY user_id, session),
"""


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.event_sessions(read(spark, sf_dir, "events")).withColumnRenamed("start_ts", "start_seconds")


@query(SESSIONS + "x AS (SELECT 1) SELECT user_id, session, key, round(start_seconds, 6) AS start_seconds, tool_calls, status, round(elapsed, 6) AS elapsed, CASE WHEN status = 'failed' THEN 'connection_timeout' END AS error_type FROM s")
def session_table(spark, sf_dir):
    return _sessions(spark, sf_dir).select("user_id", "session", "key", F.round("start_seconds", 6).alias("start_seconds"), "tool_calls", "status", F.round("elapsed", 6).alias("elapsed"), "error_type")


@query(SESSIONS + "x AS (SELECT count(*) AS total, count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'incomplete') AS incomplete FROM s) SELECT *, round(CASE WHEN total > 0 THEN success * 100.0 / total ELSE 0 END, 6) AS success_rate FROM x")
def session_status_counts(spark, sf_dir):
    return statistics.status_counts(_sessions(spark, sf_dir))


@query(SESSIONS + "x AS (SELECT * FROM s WHERE status = 'success') SELECT sum(tool_calls) AS sum_calls, round(avg(tool_calls), 6) AS avg_calls, round(quantile_cont(tool_calls, 0.5), 6) AS median_calls, min(tool_calls) AS min_calls, max(tool_calls) AS max_calls FROM x HAVING count(*) > 0")
def toolcall_stats(spark, sf_dir):
    return statistics.tool_call_stats(_sessions(spark, sf_dir))


@query(SESSIONS + "x AS (SELECT tool_calls, count(*) AS sessions FROM s WHERE status = 'success' GROUP BY 1) SELECT tool_calls, sessions, round(sessions * 100.0 / (SELECT sum(sessions) FROM x), 6) AS share FROM x")
def toolcall_distribution(spark, sf_dir):
    return statistics.tool_call_distribution(_sessions(spark, sf_dir))


@query(SESSIONS + "x AS (SELECT * FROM s WHERE status = 'success') SELECT round(sum(elapsed), 6) AS sum_elapsed, round(avg(elapsed), 6) AS avg_elapsed, round(quantile_cont(elapsed, 0.5), 6) AS median_elapsed, round(min(elapsed), 6) AS min_elapsed, round(max(elapsed), 6) AS max_elapsed, round(coalesce(stddev_samp(elapsed), 0), 6) AS stdev_elapsed FROM x HAVING count(elapsed) > 0")
def elapsed_stats(spark, sf_dir):
    return statistics.elapsed_stats(_sessions(spark, sf_dir))


@query(SESSIONS + "x AS (SELECT * FROM s WHERE status = 'success') SELECT round(coalesce(quantile_cont(elapsed, 0.90), 0), 6) AS p90, round(coalesce(quantile_cont(elapsed, 0.95), 0), 6) AS p95, round(coalesce(quantile_cont(elapsed, 0.99), 0), 6) AS p99 FROM x")
def elapsed_percentiles(spark, sf_dir):
    return statistics.elapsed_percentiles(_sessions(spark, sf_dir))


@query(SESSIONS + "x AS (SELECT 1) SELECT tool_calls, count(*) AS sessions, round(avg(elapsed), 6) AS avg_elapsed, round(quantile_cont(elapsed, 0.5), 6) AS median_elapsed FROM s WHERE status = 'success' GROUP BY 1")
def elapsed_by_toolcalls(spark, sf_dir):
    return statistics.elapsed_by_calls(_sessions(spark, sf_dir))


@query(SESSIONS + """x AS (SELECT user_id, count(*) AS sessions, count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'failed') AS failed,
  coalesce(sum(elapsed) FILTER (status = 'success'), 0) AS s, coalesce(max(elapsed) FILTER (status = 'success'), 0) AS m FROM s GROUP BY 1)
SELECT user_id, sessions, success, failed, round(s, 6) AS sum_elapsed, round(m, 6) AS max_elapsed, round(success * 100.0 / sessions, 6) AS success_rate, round(CASE WHEN success > 0 THEN s / success ELSE 0 END, 6) AS avg_elapsed FROM x""")
def thread_stats(spark, sf_dir):
    return statistics.thread_stats(_sessions(spark, sf_dir), "user_id")


@query(SESSIONS + "x AS (SELECT 1) SELECT count(DISTINCT user_id) AS threads FROM s")
def thread_count(spark, sf_dir):
    return statistics.thread_count(_sessions(spark, sf_dir), "user_id")


@query(SESSIONS + """x AS (SELECT greatest(coalesce(max(start_seconds + elapsed) - min(start_seconds), 0), 0) AS wall, count(*) FILTER (status = 'success') AS success FROM s)
SELECT round(wall, 6) AS wall_seconds, success, round(CASE WHEN wall > 0 THEN success / wall ELSE 0 END, 6) AS throughput FROM x""")
def wall_clock_throughput(spark, sf_dir):
    return statistics.wall_clock(_sessions(spark, sf_dir))


@query(SESSIONS + "x AS (SELECT 1) SELECT user_id AS key, tool_calls FROM (SELECT user_id, tool_calls, row_number() OVER (PARTITION BY user_id ORDER BY start_seconds DESC, session DESC) AS r FROM s WHERE status = 'success') WHERE r = 1 ORDER BY tool_calls DESC, key LIMIT 20")
def top_sessions(spark, sf_dir):
    s = _sessions(spark, sf_dir).drop("key").withColumnsRenamed({"user_id": "key", "start_seconds": "start_ts"})
    return statistics.top_sessions(s, 20)


LOG_SESSIONS = SESSIONS.replace("ORDER BY ts, event_id", "ORDER BY event_id")


@query(LOG_SESSIONS + """x AS (SELECT event_id, extract(hour FROM ts) * 3600 + extract(minute FROM ts) * 60 + floor(extract(second FROM ts)) AS start_seconds FROM events)
SELECT s.user_id, s.session, 'doc::images/' || s.key || '.png' AS key, CAST(x.start_seconds AS DOUBLE) AS start_seconds, s.tool_calls, s.status, round(s.elapsed, 6) AS elapsed,
  CASE WHEN s.status = 'failed' THEN 'rate_limit' END AS error_type FROM s JOIN x ON x.event_id = s.key""")
def log_sessions(spark, sf_dir):
    """Events written as the lines of one log and read again."""
    from ..sources.sinks import log_line

    seconds = F.concat(F.lit("["), F.col("value").cast("string"), F.lit("s] "))
    body = (
        F.when(F.col("event_type") == "signup", F.concat(F.lit("▶ START doc::images/"), F.col("event_id").cast("string"), F.lit(".png")))
        .when(F.col("event_type") == "purchase", F.concat(F.lit("✓ "), seconds, F.lit("DONE")))
        .when(F.col("event_type") == "error", F.concat(F.lit("✗ "), seconds, F.lit("FAILED HTTP 429 rate limit")))
        .otherwise("  [ToolCall] AI wants +5up/-5down")
    )
    lines = read(spark, sf_dir, "events").select(F.lit("img2text_1.log").alias("file"), F.col("event_id").alias("line_no"), log_line("ts", "user_id", body).alias("value"))
    found = sessions.log_sessions(lines)
    return found.select(F.col("tid").cast("long").alias("user_id"), "session", "key", T.seconds_of_day("start_ts").alias("start_seconds"), "tool_calls", "status", F.round("elapsed", 6).alias("elapsed"), "error_type")


@query("SELECT user_id, count(*) AS lines FROM events GROUP BY 1")
def lines_per_thread(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("lines"))


@query(SESSIONS + "x AS (SELECT 1) SELECT CAST(key AS VARCHAR) AS key, user_id AS thread_id, tool_calls, status, nullif(round(elapsed, 6), 0) AS elapsed_sec, CASE WHEN status = 'failed' THEN 'connection_timeout' ELSE '' END AS error_type, CASE WHEN status = 'failed' THEN 'timeout' ELSE '' END AS error_msg, '' AS img_type FROM s")
def csv_rows(spark, sf_dir):
    from ..sources.sinks import session_csv_rows

    return session_csv_rows(_sessions(spark, sf_dir).withColumns({"key": F.col("key").cast("string"), "elapsed": F.round("elapsed", 6)}), thread="user_id")


# Ordered lines

BLOCKS = """
WITH base AS (SELECT user_id, event_id, event_type, CASE WHEN event_type = 'view' THEN CAST(event_id AS VARCHAR) END AS path, count(CASE WHEN event_type = 'view' THEN 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS block FROM events),
b AS (SELECT user_id, block, max(path) AS path, bool_or(event_type = 'error' AND path IS NULL) AS bad FROM base WHERE block > 0 GROUP BY 1, 2)
"""


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    header = F.when(F.col("event_type") == "view", F.col("event_id").cast("string"))
    return sessions.problem_blocks(read(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], header, F.col("event_type") == "error")


@query(BLOCKS + "SELECT * FROM b")
def problem_blocks(spark, sf_dir):
    return _blocks(spark, sf_dir)


@query(BLOCKS + "SELECT DISTINCT path FROM b WHERE bad")
def problem_set(spark, sf_dir):
    return _blocks(spark, sf_dir).where("bad").select("path").distinct()


@query("""
WITH d AS (SELECT user_id, ts, event_id, count(*) OVER (PARTITION BY user_id) AS total, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS done FROM events WHERE event_type IN ('purchase', 'error')),
p AS (SELECT *, CAST(floor(done * 100 / total) AS BIGINT) AS percent FROM d)
SELECT user_id, ts, event_id, total, done, percent FROM (SELECT *, lag(percent, 1, -1) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last FROM p) WHERE percent > last""")
def running_progress(spark, sf_dir):
    from pyspark.sql import Window

    ends = read(spark, sf_dir, "events").where(F.col("event_type").isin("purchase", "error"))
    ends = ends.withColumn("total", F.count(F.lit(1)).over(Window.partitionBy("user_id")))
    return sessions.running_progress(ends, ["user_id"], ["ts", "event_id"], F.lit(True), F.col("total"))


@query("SELECT o_orderkey, o_custkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1) % 10 + 1 AS worker FROM orders")
def round_robin(spark, sf_dir):
    return sessions.round_robin(read(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], 10).select("o_orderkey", "o_custkey", "worker")


@query("SELECT user_id, event_id, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_per_key(spark, sf_dir):
    return sessions.latest_per_key(read(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value"), "user_id", ["ts", "event_id"])


@query("SELECT md5(text) AS name, doc_id FROM (SELECT text, doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def first_seen(spark, sf_dir):
    named = read(spark, sf_dir, "documents").select(F.md5("text").alias("name"), "doc_id")
    return sessions.first_seen(named, "name", ["doc_id"])


@query("SELECT doc_id, lang, source FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR) || ':42'), doc_id LIMIT 50")
def sample_n(spark, sf_dir):
    return sessions.sample_n(read(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id", 50, 42)


_NOTE = "(p.pages - f.pages >= 100 OR p.state = 'done')"
_DUE = f"(NOT {_NOTE} AND p.hours - f.hours >= f.wait)"
POLL = f"""
WITH RECURSIVE p AS (
  SELECT user_id, CAST(ts AS DATE) AS day, epoch_us(ts) / 1e6 / 3600 AS hours, CAST(floor(value) AS BIGINT) AS pages, CASE WHEN event_type = 'purchase' THEN 'done' ELSE 'running' END AS state,
    row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS place FROM events),
f AS (
  SELECT user_id, day, place, pages, hours, CAST(3.0 AS DOUBLE) AS wait, true AS shown FROM p WHERE place = 1
  UNION ALL
  SELECT p.user_id, p.day, p.place, CASE WHEN {_NOTE} OR {_DUE} THEN p.pages ELSE f.pages END, CASE WHEN {_NOTE} OR {_DUE} THEN p.hours ELSE f.hours END,
    CASE WHEN {_NOTE} THEN CAST(3.0 AS DOUBLE) WHEN {_DUE} THEN least(f.wait * 2, 64.0) ELSE f.wait END, {_NOTE} OR {_DUE}
  FROM f JOIN p ON p.user_id = f.user_id AND p.day = f.day AND p.place = f.place + 1)
SELECT user_id, day, place FROM f WHERE shown
"""


@query(POLL)
def poll_emit(spark, sf_dir):
    """Polls of one user and day are one batch."""
    events = read(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    poll = F.struct("ts", "event_id", (T.micros("ts") / 1e6 / 3600).alias("at"), F.floor("value").cast("long").alias("pages"), F.when(F.col("event_type") == "purchase", "done").otherwise("running").alias("state"))
    batches = events.groupBy("user_id", "day").agg(F.sort_array(F.collect_list(poll)).alias("polls"))
    return batches.select("user_id", "day", F.explode(F.transform(policy.emitted_polls("polls", 100), lambda p: p.cast("long"))).alias("place"))


@query(POLL)
def poll_stream(spark, sf_dir):
    """The same, of sorted polls that pass by one after the other."""
    e = read(spark, sf_dir, "events").withColumns({"day": F.to_date("ts"), "at": T.micros("ts") / 1e6 / 3600})
    state = F.when(F.col("event_type") == "purchase", "done").otherwise("running")
    return progress.shown_polls(e, ["user_id", "day"], ["ts", "event_id"], "at", F.floor("value"), state, 100)


# Error classes and texts

_CLASS = """CASE WHEN regexp_matches({x}, 'connection|timeout|timed out', 'i') THEN 'connection_timeout' WHEN regexp_matches({x}, '429|rate.*limit', 'i') THEN 'rate_limit' WHEN regexp_matches({x}, 'IMG_MISSING', 'i') THEN 'img_missing'
WHEN regexp_matches({x}, 'IMG_ERROR', 'i') THEN 'img_error' WHEN regexp_matches({x}, 'IMG_API_ERROR|IMG_PROCESS_ERROR', 'i') THEN 'api_error' WHEN regexp_matches({x}, 'IMG_WORKER_FATAL', 'i') THEN 'worker_fatal'
WHEN regexp_matches({x}, 'IMG_EMPTY_RESPONSE', 'i') THEN 'empty_response' WHEN regexp_matches({x}, 'IMG_INVALID_FORMAT', 'i') THEN 'invalid_format' ELSE 'unknown' END"""
_MESSAGE = "CASE conv_id % 9 WHEN 0 THEN 'Connection reset ' WHEN 1 THEN 'HTTP 429 ' WHEN 2 THEN '[IMG_MISSING: x] ' WHEN 3 THEN '[IMG_ERROR: x] ' WHEN 4 THEN '[IMG_API_ERROR] ' WHEN 5 THEN '[IMG_WORKER_FATAL] ' WHEN 6 THEN '[IMG_EMPTY_RESPONSE]' WHEN 7 THEN '[IMG_INVALID_FORMAT]' ELSE '' END"


@query(f"SELECT conv_id, turn, {_CLASS.format(x='m')} AS error_class FROM (SELECT conv_id, turn, {_MESSAGE} || text AS m FROM conversations)")
def error_class(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", T.error_class(F.concat(F.expr(_MESSAGE), F.col("text"))).alias("error_class"))


@query(f"SELECT error_type, count(*) AS sessions FROM (SELECT {_CLASS.format(x='m')} AS error_type FROM (SELECT {_MESSAGE} || text AS m FROM conversations)) GROUP BY 1")
def error_distribution(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    return statistics.error_distribution(c.select(F.lit("failed").alias("status"), T.error_class(F.concat(F.expr(_MESSAGE), F.col("text"))).alias("error_type")))


_RESULT = "CASE conv_id % 4 WHEN 0 THEN '  [IMG_TYPE: table] ' || text WHEN 1 THEN 'Well: [IMG_TYPE: text] ' || text || ' ' WHEN 2 THEN '[IMG_ERROR: x]' ELSE text END"
_FIXED = "CASE turn % 3 WHEN 0 THEN 'so [IMG_TYPE: latex] ' || text WHEN 1 THEN 'nothing' END"


@query(f"""
WITH r AS (SELECT conv_id, turn, trim({_RESULT}) AS x, trim({_FIXED}) AS f FROM conversations),
n AS (SELECT conv_id, turn, CASE WHEN strpos(x, '[IMG_TYPE:') > 0 THEN trim(substr(x, strpos(x, '[IMG_TYPE:'))) WHEN starts_with(x, '[IMG_') THEN x WHEN coalesce(strpos(f, '[IMG_TYPE:'), 0) > 0 THEN trim(substr(f, strpos(f, '[IMG_TYPE:'))) ELSE '__INVALID_RESPONSE__' END AS result,
  CASE WHEN strpos(x, '[IMG_TYPE:') > 0 THEN 'ok' WHEN starts_with(x, '[IMG_') THEN 'error' WHEN coalesce(strpos(f, '[IMG_TYPE:'), 0) > 0 THEN 'ok' ELSE 'retry' END AS status FROM r)
SELECT conv_id, turn, status, CASE WHEN length(result) > 80 THEN left(result, 80) || '...' ELSE result END AS result FROM n WHERE status <> 'retry'""")
def result_normalise(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    n = c.select("conv_id", "turn", policy.normalised_result(F.expr(_RESULT), F.expr(_FIXED)).alias("n"))
    return n.where(policy.persisted("n.status")).select("conv_id", "turn", F.col("n.status").alias("status"), T.preview("n.result", 80).alias("result"))


@query("SELECT conv_id, sum(least(length(text), 200)) + 30 AS window_size, count(*) AS requests FROM conversations GROUP BY 1")
def window_growth(spark, sf_dir):
    asked = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.length("text")).alias("requests"))
    return asked.select("conv_id", policy.grown_window("requests", 30, 200).alias("window_size"), F.size("requests").cast("long").alias("requests"))


@query("""
WITH e AS (SELECT event_id, event_id % 12 AS attempt, CASE event_type WHEN 'view' THEN 'rate_limit' WHEN 'click' THEN 'connection' ELSE 'api' END AS kind FROM events)
SELECT event_id, kind, CAST(CASE kind WHEN 'rate_limit' THEN least(2 * pow(2, attempt), 60) WHEN 'connection' THEN least(5 * pow(2, attempt), 60) ELSE 2 END AS DOUBLE) AS wait, CAST(least(3 * pow(2, attempt), 64) AS DOUBLE) AS throttle FROM e""")
def retry_schedule(spark, sf_dir):
    """Waits after a failure of each event, by what its message says and how often it was tried."""
    said = F.when(F.col("event_type") == "view", "HTTP 429 rate").when(F.col("event_type") == "click", "TLS handshake timeout").otherwise("bad request")
    tries = read(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 12).alias("attempt"), said.alias("message")).withColumn("kind", policy.transport_class("message"))
    return tries.select("event_id", "kind", policy.backoff("kind", "attempt").cast("double").alias("wait"), policy.throttle("attempt").cast("double").alias("throttle"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 2 = 0 THEN 'skip' WHEN o_orderstatus = 'O' AND o_orderkey % 5 <> 0 THEN CASE o_orderkey % 3 WHEN 0 THEN 'download' WHEN 1 THEN 'poll' ELSE 'resubmit' END ELSE 'submit' END AS action FROM orders""")
def resume_action(spark, sf_dir):
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    states = read(spark, sf_dir, "orders").select(
        k, F.when(s == "F", "done").when(s == "O", "running").otherwise("failed").alias("status"), (k % 2 == 0).alias("has_output"),
        F.when(k % 5 != 0, k.cast("string")).alias("batch_id"), F.when(k % 3 == 0, "done").when(k % 3 == 1, "running").alias("remote"),
    )
    return progress.resume_actions(states).select("o_orderkey", "action")


# Lines and references

_LINES = "SELECT doc_id, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents"


@query(f"SELECT doc_id, line_no, md5(line) AS line, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM ({_LINES})")
def line_table(spark, sf_dir):
    return markdown.line_table(read(spark, sf_dir, "documents"), "doc_id", "text").withColumn("line", F.md5("line"))


@query("SELECT doc_id, len(string_split(substr(text, 1, CAST(n_chars // 2 AS BIGINT)), chr(10))) - 1 AS line_index FROM documents")
def line_index(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.line_index("text", F.expr("n_chars div 2")).cast("long").alias("line_index"))


@query(f"""
WITH l AS ({_LINES}), n AS (SELECT doc_id, CAST(max(line_no) // 2 AS BIGINT) AS mid FROM l GROUP BY 1)
SELECT l.doc_id, md5(string_agg(CASE WHEN line_no = mid THEN '>>>[IMG] ' ELSE '[L' || line_no || '] ' END || line, chr(10) ORDER BY line_no)) AS context, count(*) AS lines
FROM l JOIN n ON l.doc_id = n.doc_id WHERE line_no BETWEEN mid - 2 AND mid + 3 GROUP BY 1""")
def context_frame(spark, sf_dir):
    at = F.floor((F.size(F.split("text", "\n", -1)) - 1) / 2)
    frames = read(spark, sf_dir, "documents").select("doc_id", markdown.context("text", at, 2, 3).alias("c"))
    return frames.select("doc_id", F.md5(F.array_join("c", "\n")).alias("context"), F.size("c").cast("long").alias("lines"))


@query(f"""
WITH l AS ({_LINES}), n AS (SELECT doc_id, CAST(max(line_no) // 2 AS BIGINT) AS mid FROM l GROUP BY 1)
SELECT n.doc_id, md5(coalesce(string_agg('[L' || line_no || '] ' || line, chr(10) ORDER BY line_no), '')) AS delta, count(line_no) AS lines
FROM n LEFT JOIN l ON l.doc_id = n.doc_id AND line_no BETWEEN mid - 3 AND mid + 4 AND NOT line_no BETWEEN mid - 1 AND mid + 1 GROUP BY 1""")
def context_delta(spark, sf_dir):
    at = F.floor((F.size(F.split("text", "\n", -1)) - 1) / 2)
    frames = read(spark, sf_dir, "documents").select("doc_id", markdown.context_delta("text", at, (1, 1), (3, 4)).alias("c"))
    return frames.select("doc_id", F.md5(F.array_join("c", "\n")).alias("delta"), F.size("c").cast("long").alias("lines"))


@query("SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS path FROM pages")
def ref_extract(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.explode(T.image_refs("html", LINK)).alias("path"))


@query("SELECT page_id, len(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS refs, len(list_distinct(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1))) AS distinct_refs FROM pages")
def ref_counts(spark, sf_dir):
    return markdown.reference_counts(read(spark, sf_dir, "pages"), "page_id", "html", LINK)


@query("SELECT CAST(sum(len(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1))) AS BIGINT) AS refs FROM pages")
def ref_total(spark, sf_dir):
    return markdown.reference_total(read(spark, sf_dir, "pages"), "html", LINK)


@query("SELECT page_id, unnest(list_distinct(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1))) AS path FROM pages")
def ref_distinct(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.explode(F.array_distinct(T.image_refs("html", LINK))).alias("path"))


@query("""
WITH c AS (SELECT page_id, html, unnest(generate_series(1, len(string_split_regex(html, '<a href="[^"]*"')) - 1)) AS k FROM pages),
h AS (SELECT page_id, html, k, regexp_extract_all(html, '<a href="[^"]*"') AS hits, string_split_regex(html, '<a href="[^"]*"') AS gaps FROM c)
SELECT page_id, CAST(list_sum(list_transform(gaps[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:k - 1], lambda x: length(x))), 0) AS BIGINT) AS start, regexp_extract(hits[k], '<a href="([^"]*)"', 1) AS path FROM h""")
def ref_positions(spark, sf_dir):
    refs = markdown.references(read(spark, sf_dir, "pages"), "page_id", "html", LINK)
    return refs.select("page_id", F.col("start").cast("long").alias("start"), "path")


@query("SELECT page_id, md5(CASE WHEN regexp_matches(html, '<a href=\"([^\"]*)\"') THEN replace(html, 'href=\"/', 'href=\"//' || page_id || '/') ELSE html END) AS html FROM pages")
def path_rewrite(spark, sf_dir):
    p = read(spark, sf_dir, "pages")
    rewritten = T.rewritten_paths("html", F.concat(F.lit("/"), F.col("page_id").cast("string")), LINK, 'href="/')
    return p.select("page_id", F.md5(rewritten).alias("html"))


@query("""
SELECT page_id, md5(regexp_replace(html, '<a href="([^"]*)"', chr(10) || chr(10) || '<!-- IMG: \\1 -->' || chr(10) || '[AI] seen' || chr(10) || chr(10) || '<!-- /IMG -->' || chr(10) || chr(10), 'g')) AS html FROM pages""")
def splice(spark, sf_dir):
    p = read(spark, sf_dir, "pages").select("page_id", "html")
    results = markdown.references(p, "page_id", "html", LINK).withColumn("result", F.lit("seen"))
    return markdown.spliced_documents(p, "page_id", "html", results).select("page_id", F.md5("html").alias("html"))


@query("SELECT page_id, translate(url, '/' || chr(92), '__') || '.json' AS name, regexp_replace(string_split(url, '/')[-1], '\\.[^.]*$', '') AS stem, left(string_split(page_id || '::' || url, '::')[-1], 50) AS short FROM pages")
def safe_names(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", T.safe_name("url").alias("name"), T.stem("url").alias("stem"), T.short_key(T.key_of(F.col("page_id").cast("string"), "url")).alias("short"))


# Parts and progress


@query("""
SELECT doc_id // 10 AS subject, count(*) AS parts, md5(string_agg(rtrim(text, ' ' || chr(9) || chr(13) || chr(10)), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY doc_id % 10)) AS content
FROM documents WHERE rtrim(text, ' ' || chr(9) || chr(13) || chr(10)) <> '' GROUP BY 1""")
def part_merge(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.expr("doc_id div 10").alias("subject"), (F.col("doc_id") % 10).alias("part"), "text")
    return organize.merged_parts(d).withColumn("content", F.md5("content"))


@query("SELECT d.doc_id, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def matched_refs(spark, sf_dir):
    return organize.matched(read(spark, sf_dir, "documents").select("doc_id"), read(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_refs(spark, sf_dir):
    return organize.missing(read(spark, sf_dir, "documents").select("doc_id"), read(spark, sf_dir, "labels"), "doc_id")


_ITEMS = "SELECT doc_id, source || '::' || doc_id AS key, CASE WHEN quality = 1 THEN '[IMG_TYPE: text] x' WHEN toxic = 1 THEN '__INVALID_RESPONSE__' ELSE '[IMG_API_ERROR: x]' END AS result, toxic FROM documents JOIN labels USING (doc_id)"


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", "source").join(read(spark, sf_dir, "labels"), "doc_id")
    result = F.when(F.col("quality") == 1, "[IMG_TYPE: text] x").when(F.col("toxic") == 1, "__INVALID_RESPONSE__").otherwise("[IMG_API_ERROR: x]")
    return d.select("doc_id", T.key_of("source", F.col("doc_id").cast("string")).alias("key"), result.alias("result"), "toxic")


@query(f"SELECT source || '::' || doc_id AS key, doc_id FROM documents WHERE source || '::' || doc_id NOT IN (SELECT key FROM ({_ITEMS}) WHERE contains(result, '[IMG_TYPE:'))")
def resume_pending(spark, sf_dir):
    tasks = read(spark, sf_dir, "documents").select(T.key_of("source", F.col("doc_id").cast("string")).alias("key"), "doc_id")
    return progress.pending(tasks, _items(spark, sf_dir))


@query(f"SELECT count(*) FILTER (contains(result, '[IMG_TYPE:')) AS completed, count(*) FILTER (NOT contains(result, '[IMG_TYPE:')) AS invalid, (SELECT count(*) FROM documents) AS total, (SELECT count(*) FROM documents) - count(*) AS remaining FROM ({_ITEMS})")
def progress_counts(spark, sf_dir):
    total = read(spark, sf_dir, "documents").agg(F.count(F.lit(1))).scalar()
    return progress.counts(_items(spark, sf_dir), total)


@query(f"""
WITH c AS (SELECT DISTINCT key FROM ({_ITEMS}) WHERE contains(result, '[IMG_TYPE:')), b AS (SELECT DISTINCT key FROM ({_ITEMS}) WHERE toxic = 1)
SELECT count(*) AS completed, count(b.key) AS bad, round(CASE WHEN count(*) > 0 THEN (count(*) - count(b.key)) * 100.0 / count(*) ELSE 0 END, 6) AS good_rate FROM c LEFT JOIN b ON c.key = b.key""")
def good_rate(spark, sf_dir):
    items = _items(spark, sf_dir)
    return progress.good_rate(items.where(T.valid_result("result")), items.where("toxic = 1"), "key")


@query("SELECT s.name, d.source || '::' || d.doc_id AS key FROM (SELECT DISTINCT source AS name FROM documents WHERE source <> 'src1') s JOIN documents d ON d.source = s.name")
def prefix_join(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    names = d.where("source <> 'src1'").select(F.col("source").alias("name")).distinct()
    return organize.results_of_documents(names, d.select(T.key_of("source", F.col("doc_id").cast("string")).alias("key")))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_state(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.from_json("props", "k LONG")["k"].alias("k"))


PARTS = """
WITH RECURSIVE pages AS (SELECT doc_id, unnest(generate_series(1, len(string_split(text, chr(10))))) AS page, unnest(list_transform(string_split(text, chr(10)), lambda x: length(x))) AS size FROM documents),
f AS (
  SELECT doc_id, page, 1 AS part, 1 AS n, size AS s FROM pages WHERE page = 1
  UNION ALL
  SELECT p.doc_id, p.page, CASE WHEN f.n >= 5 OR f.s + p.size > 400 THEN f.part + 1 ELSE f.part END, CASE WHEN f.n >= 5 OR f.s + p.size > 400 THEN 1 ELSE f.n + 1 END, CASE WHEN f.n >= 5 OR f.s + p.size > 400 THEN p.size ELSE f.s + p.size END
  FROM f JOIN pages p ON p.doc_id = f.doc_id AND p.page = f.page + 1),
g AS (SELECT f.doc_id, f.part, min(f.page) AS first_page, count(*) AS pages, CAST(sum(p.size) AS BIGINT) AS size FROM f JOIN pages p ON p.doc_id = f.doc_id AND p.page = f.page GROUP BY 1, 2)
"""


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = F.transform(F.split("text", "\n", -1), lambda x: F.length(x).cast("long"))
    return parts.greedy_parts(read(spark, sf_dir, "documents"), "doc_id", sizes, 5, 400)


@query(PARTS + "SELECT * FROM g")
def greedy_parts(spark, sf_dir):
    return _parts(spark, sf_dir)


@query(PARTS + "SELECT doc_id, len(string_split(text, chr(10))) AS pages FROM documents")
def part_totals(spark, sf_dir):
    sources = read(spark, sf_dir, "documents").select("doc_id", F.size(F.split("text", "\n", -1)).cast("long").alias("pages"))
    return parts.already_split(sources, _parts(spark, sf_dir), "doc_id")


@query("SELECT doc_id, CASE WHEN n_chars // 1000 > 0 AND n_chars // 1000 <= 2 THEN 'keep' ELSE 'convert' END AS route FROM documents")
def route_document(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", parts.route(F.expr("n_chars div 1000"), 5).alias("route"))


@query("SELECT 'documents/' || doc_id || '.pdf' AS path FROM documents UNION ALL SELECT 'pages/' || page_id || '.HTML' FROM pages")
def union_sources(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.concat(F.lit("documents/"), "doc_id", F.lit(".pdf")).alias("path"))
    p = read(spark, sf_dir, "pages").select(F.explode(F.array(F.concat(F.lit("pages/"), "page_id", F.lit(".HTML")), F.concat(F.lit("pages/"), "page_id", F.lit(".txt")))).alias("path"))
    return d.unionByName(p).where(T.supported("path"))


def queries() -> dict[str, Query]:
    from . import registry_more  # noqa: F401  adds its own

    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_sql)
