"""More queries on the driver's tables: scalar functions, names and paths, sources and sinks by a round trip, connectors with fakes, streams.

What a query writes goes below the folder that driver and executors share.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import policy
from ..functions import text as T
from ..operators import organize, parts, progress, sessions, statistics
from ..sources import config, connectors, durable, files, office, scratch, sinks
from ..streaming import follow, logs
from .registry import _ITEMS, LOG_SESSIONS, _items, query, read

# Log lines

BODY = """CASE event_type WHEN 'signup' THEN '▶ START doc::images/' || event_id || '.png' WHEN 'purchase' THEN '✓ [' || CAST(value AS VARCHAR) || 's] DONE [IMG_TYPE: table]'
  WHEN 'error' THEN '[ERROR] ✗ [' || CAST(value AS VARCHAR) || 's] FAILED HTTP 429 rate limit' WHEN 'click' THEN '[WARNING] odd' ELSE '  [ToolCall] AI wants +5up/-5down' END"""
LINES = f"lines AS (SELECT event_id, user_id, ts, event_type, 'img2text_' || user_id % 3 || '.log' AS name, '[' || strftime(ts, '%H:%M:%S') || '][T' || CASE WHEN user_id < 10 THEN '0' ELSE '' END || user_id || '] ' || {BODY} AS value FROM events)"


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as lines (name, event_id, user_id, value) of three logs."""
    seconds = F.concat(F.lit("["), F.col("value").cast("string"), F.lit("s] "))
    kind = lambda k: F.col("event_type") == k
    body = (
        F.when(kind("signup"), F.concat(F.lit("▶ START doc::images/"), F.col("event_id").cast("string"), F.lit(".png")))
        .when(kind("purchase"), F.concat(F.lit("✓ "), seconds, F.lit("DONE [IMG_TYPE: table]")))
        .when(kind("error"), F.concat(F.lit("[ERROR] ✗ "), seconds, F.lit("FAILED HTTP 429 rate limit")))
        .when(kind("click"), "[WARNING] odd").otherwise("  [ToolCall] AI wants +5up/-5down")
    )
    name = F.concat(F.lit("img2text_"), (F.col("user_id") % 3).cast("string"), F.lit(".log"))
    return read(spark, sf_dir, "events").select(name.alias("name"), "event_id", "user_id", "ts", sinks.log_line("ts", "user_id", body).alias("value"))


def _logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The logs as files beside an error log; their listing."""
    path, lines = scratch.folder(spark, "logs"), event_lines(spark, sf_dir)
    for k in (0, 2, 1):
        sinks.write_file(lines.where(f"name = 'img2text_{k}.log'").orderBy("event_id").select("value"), path, f"img2text_{k}.log")
    sinks.write_file(lines.where("contains(value, '[ERROR]')").limit(1).select("value"), path, "img2text_error_9.log")
    return files.listing(spark, path)


@query(f"WITH {LINES} SELECT name, row_number() OVER (PARTITION BY name ORDER BY event_id) - 1 AS line_no, value FROM lines")
def log_scan(spark, sf_dir):
    found = files.resolved_logs(_logs(spark, sf_dir), everything=True)
    lines = files.log_lines(spark, *[r["path"] for r in found.collect()])
    return lines.select(F.element_at(F.split("file", "/"), -1).alias("name"), "line_no", "value")


@query("SELECT * FROM (VALUES ('all', 'img2text_0.log'), ('all', 'img2text_1.log'), ('all', 'img2text_2.log'), ('latest', 'img2text_1.log'), ('path', 'img2text_2.log'), ('name', 'img2text_0.log')) t(choice, name)")
def log_choice(spark, sf_dir):
    """The log changed last, all of them, and explicit ones by path and by name."""
    found = _logs(spark, sf_dir)
    path = found.where("name = 'img2text_2.log'").select(files.plain_path("path").alias("p")).first()["p"]
    chosen = {"all": files.resolved_logs(found, everything=True), "latest": files.resolved_logs(found), "path": files.resolved_logs(found, [path]), "name": files.resolved_logs(found, ["img2text_0.log"])}
    out = [df.select(F.lit(k).alias("choice"), F.element_at(F.split("path", "/"), -1).alias("name")) for k, df in chosen.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query(f"""WITH {LINES} SELECT event_id, strftime(ts, '%H:%M:%S') AS time, regexp_extract(value, '\\[T(\\d+)\\]', 1) AS thread, rtrim(regexp_replace(value, '^\\[\\d\\d:\\d\\d:\\d\\d\\] ?', '')) AS content,
  'T' || regexp_extract(value, '\\[T(\\d+)\\]', 1) AS split_thread, regexp_replace(value, '^\\[\\d\\d:\\d\\d:\\d\\d\\]\\[T\\d+\\]\\s*', '') AS bare, contains(value, '[ToolCall]') AS tool, contains(value, '[ERROR]') OR contains(value, '[WARNING]') AS flagged,
  nullif(regexp_extract(value, 'START (.+)$', 1), '') AS started, CAST(nullif(regexp_extract(value, '✓ \\[([0-9.]+)s\\]', 1), '') AS DOUBLE) AS done, CAST(nullif(regexp_extract(value, '✗ \\[([0-9.]+)s\\]', 1), '') AS DOUBLE) AS failed FROM lines""")
def log_fields(spark, sf_dir):
    v = F.col("value")
    return event_lines(spark, sf_dir).select(
        "event_id", T.log_time(v).alias("time"), T.log_thread(v).alias("thread"), T.log_content(v).alias("content"), T.split_thread(v).alias("split_thread"), T.without_prefix(v).alias("bare"),
        T.tagged(v, "[ToolCall]").alias("tool"), T.tagged(v, "[ERROR]", "[WARNING]").alias("flagged"), T.started_key(v).alias("started"), T.done(v)["elapsed"].alias("done"), T.failed(v)["elapsed"].alias("failed"),
    )


@query("SELECT page_id, 'images/' || page_id || '.PNG' AS path FROM pages WHERE page_id % 2 = 0")
def header_lines(spark, sf_dir):
    """Paths of header lines; lines that are none give none."""
    said = F.when(F.col("page_id") % 2 == 0, F.format_string("[12:00:00] [%d/99] images/%d.PNG (from %s.md)", "page_id", "page_id", "url")).otherwise(F.format_string("[12:00:00] images/%d.png", "page_id"))
    return read(spark, sf_dir, "pages").select("page_id", T.header_path(said).alias("path")).where("path is not null")


@query(LOG_SESSIONS + "x AS (SELECT 1) SELECT 'img2text_' || user_id % 3 || '.log' AS name, count(*) AS sessions FROM s GROUP BY 1")
def sessions_of_logs(spark, sf_dir):
    """Sessions of all logs together, by log."""
    lines = event_lines(spark, sf_dir).select(F.col("name").alias("file"), F.col("event_id").alias("line_no"), "value")
    return statistics.sessions_per_file(sessions.log_sessions(lines)).select(F.col("file").alias("name"), "sessions")


@query(f"WITH {LINES} SELECT replace(name, '.log', '') AS log, 'T' || regexp_extract(value, '\\[T(\\d+)\\]', 1) AS tid, md5(string_agg(value || chr(10), '' ORDER BY event_id)) AS content FROM lines GROUP BY 1, 2")
def thread_logs(spark, sf_dir):
    """One log for each thread, written and read again."""
    path = scratch.folder(spark, "threads")
    sinks.write_thread_logs(event_lines(spark, sf_dir).select(F.col("name").alias("file"), F.col("event_id").alias("line_no"), "value"), path)
    files.many_small(spark)
    files_ = spark.read.text(path, wholetext=True).select(F.col("log").cast("string").alias("log"), "tid", F.struct(F.col("_metadata.file_name").alias("part"), "value").alias("x"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["value"]), "")
    return files_.groupBy("log", "tid").agg(F.md5(whole).alias("content"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') || ' [ERROR] ' || event_type AS line FROM events WHERE event_type = 'error'")
def error_log(spark, sf_dir):
    e = read(spark, sf_dir, "events").where("event_type = 'error'")
    return e.select("event_id", sinks.error_log_line("ts", "ERROR", "event_type").alias("line"))


RUN_LINES = f"""WITH {LINES}, x AS (
  SELECT name, event_id AS n, value, event_type, event_type IN ('purchase', 'error') AS ended, event_type = 'error' AS bad FROM lines),
c AS (SELECT *, sum(CAST(ended AS INT)) OVER w AS done, sum(CAST(bad AS INT)) OVER w AS errors, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER w AS warns, bool_or(ended OR event_type = 'signup') OVER w AS body FROM x WINDOW w AS (PARTITION BY name ORDER BY n)),
p AS (SELECT *, CAST(floor(done * 100 / 5000) AS BIGINT) AS percent FROM c),
l AS (SELECT *, coalesce(max(CASE WHEN ended THEN percent END) OVER (PARTITION BY name ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS last FROM p)
SELECT name, n, CASE WHEN NOT body THEN regexp_replace(value, '^\\[\\d\\d:\\d\\d:\\d\\d\\]\\[T\\d+\\]\\s*', '') ELSE '[' || CAST(done AS BIGINT) || '/5000] ' || printf('%.2f', done * 100.0 / 5000) || '% (done: ' || CAST(done AS BIGINT) || ', errors: ' || CAST(errors AS BIGINT) || ', warns: ' || CAST(warns AS BIGINT) || ')' END AS text
FROM l WHERE NOT body OR (ended AND percent > last)
UNION ALL SELECT DISTINCT name, CAST(-1 AS BIGINT), 'To process: 5000' FROM lines"""


@query(RUN_LINES)
def run_output(spark, sf_dir):
    """What a reader of the run's output is shown, of logs whose first line gives a total."""
    lines = event_lines(spark, sf_dir).select(F.col("name").alias("file"), F.col("event_id").alias("line_no"), "value")
    head = lines.select("file").distinct().select("file", F.lit(-1).cast("long").alias("line_no"), F.lit("[00:00:00][T00] To process: 5000").alias("value"))
    return logs.shown(lines.unionByName(head)).select(F.col("file").alias("name"), F.col("line_no").alias("n"), "text")


# Names, paths, numbers


@query("SELECT doc_id, source AS subject, CASE WHEN doc_id % 3 > 0 THEN doc_id END AS part FROM documents")
def part_names(spark, sf_dir):
    name = F.when(F.col("doc_id") % 3 > 0, F.concat("source", F.lit("_part"), F.col("doc_id").cast("string"))).otherwise(F.col("source"))
    p = T.part_of(name)
    return read(spark, sf_dir, "documents").select("doc_id", p["subject"].alias("subject"), p["part"].alias("part"))


@query("SELECT source AS subject FROM documents GROUP BY 1 HAVING bool_or(doc_id % 3 = 0) AND bool_or(doc_id % 3 > 0)")
def part_conflicts(spark, sf_dir):
    name = F.when(F.col("doc_id") % 3 > 0, F.concat("source", F.lit("_part"), F.col("doc_id").cast("string"))).otherwise(F.col("source"))
    return organize.part_conflicts(read(spark, sf_dir, "documents").select(name.alias("name")))


@query("SELECT page_id, substr(url, instr(url, '/') + 1) AS file, 'images/a/' || page_id || '.png' AS path, page_id || '.png' AS name, 'a' AS folder FROM pages")
def image_paths(spark, sf_dir):
    p = read(spark, sf_dir, "pages")
    named = p.select(F.format_string("x/a/images/%d.png", "page_id").alias("path"), "page_id").withColumn("name", F.element_at(F.split("path", "/"), -1))
    other = p.select(F.format_string("x/a/pictures/%d.png", "page_id").alias("path"), "page_id", F.lit("no").alias("name"))
    found = files.image_files(named.unionByName(other)).select(F.regexp_extract("name", r"(\d+)", 1).try_cast("long").alias("page_id"), "name", "folder", F.concat(F.lit("images/a/"), "name").alias("path"))
    return p.select("page_id", T.image_file("url").alias("file")).join(found, "page_id")


@query("SELECT p_partkey, round(p_retailprice * 1000 / 1048576, 1) AS mb, round(p_size * 700 / 1024, 1) AS kb, CAST(ceil(p_size / 10) AS BIGINT) AS pages, CASE WHEN p_size > 0 THEN 100.0 / p_size ELSE 0 END AS share, CAST(greatest(1, floor(p_size * 100 * least(1, 1280 / (p_size * 100), 1280 / ((51 - p_size) * 50)))) AS BIGINT) AS width, CAST(greatest(1, floor((51 - p_size) * 50 * least(1, 1280 / (p_size * 100), 1280 / ((51 - p_size) * 50)))) AS BIGINT) AS height FROM part")
def sizes(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    box = T.resized(F.col("p_size") * 100, (F.lit(51) - F.col("p_size")) * 50)
    return p.select(
        "p_partkey", T.megabytes(F.col("p_retailprice") * 1000).alias("mb"), T.kilobytes(F.col("p_size") * 700).alias("kb"), T.estimated_pages("p_size").alias("pages"),
        T.percent(F.lit(1), F.col("p_size")).alias("share"), box["width"].alias("width"), box["height"].alias("height"),
    )


@query("SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: x <> '')) AS paragraphs FROM documents")
def paragraph_counts(spark, sf_dir):
    lines = F.transform(F.split("text", "\n", -1), lambda x: F.struct((x != "").alias("is_paragraph")))
    return read(spark, sf_dir, "documents").select("doc_id", T.paragraph_count(lines).cast("long").alias("paragraphs"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN '排队中' WHEN 'O' THEN '解析中' ELSE 'other' END AS state, CASE o_orderstatus WHEN 'F' THEN 'split files' ELSE 'step' END AS step FROM orders")
def labels(spark, sf_dir):
    from ..functions.patterns import STEP_LABELS

    is_ = lambda k: F.col("o_orderstatus") == k
    return read(spark, sf_dir, "orders").select("o_orderkey", T.label(F.when(is_("F"), "pending").when(is_("O"), "running").otherwise("other")).alias("state"), T.label(F.when(is_("F"), "split").otherwise("step"), STEP_LABELS).alias("step"))


@query("SELECT DISTINCT o_custkey, n AS percentile FROM (SELECT o_custkey, unnest([o_orderkey % 130, 95, o_custkey % 100]) AS n FROM orders) WHERE n BETWEEN 1 AND 99")
def percentile_lists(spark, sf_dir):
    each = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.collect_list(F.concat_ws(", ", (F.col("o_orderkey") % 130).cast("string"), F.lit("95"), F.lit("x"), (F.col("o_custkey") % 100).cast("string"))), ",").alias("said"))
    flat = each.select("o_custkey", F.explode(T.percentile_list("said")).alias("percentile"))
    return flat.withColumn("percentile", F.col("percentile").cast("long"))


@query("SELECT conv_id, turn, 'Use 3 calls, answer in ' || CASE role WHEN 'user' THEN 'English' WHEN 'assistant' THEN 'Chinese' ELSE role END AS prompt, CASE WHEN turn % 3 = 0 THEN text WHEN turn % 3 = 1 THEN '' ELSE '{\"turn\":' || turn || '}' END AS content FROM conversations")
def messages(spark, sf_dir):
    """Prompts by language, and contents that are text, nothing or an object."""
    c = read(spark, sf_dir, "conversations")
    lang = F.when(F.col("role") == "user", "EN").when(F.col("role") == "assistant", "").otherwise(F.col("role"))
    quoted = F.to_json(F.struct("text"))
    content = F.when(F.col("turn") % 3 == 0, F.substring(quoted, F.lit(9), F.length(quoted) - 9)).when(F.col("turn") % 3 == 1, "null").otherwise(F.to_json(F.struct("turn")))
    return c.select("conv_id", "turn", policy.prompt(F.lit("Use {MAX_TOOL_CALLS} calls, answer in {OUTPUT_LANG}"), 3, lang).alias("prompt"), policy.content_text(content).alias("content"))


@query("""
WITH f AS (SELECT 'in/' || doc_id || CASE doc_id % 5 WHEN 0 THEN '.pdf' WHEN 1 THEN '.DOCX' WHEN 2 THEN '.png' WHEN 3 THEN '.txt' ELSE '.docx' END AS path, doc_id FROM documents)
SELECT path FROM f WHERE doc_id % 5 = 2 OR (doc_id % 5 IN (1, 4) AND doc_id % 7 <> 0) UNION ALL SELECT 'split/' || doc_id || '_part1.pdf' FROM documents WHERE doc_id % 7 = 0""")
def pending_inputs(spark, sf_dir):
    """Parts, and the inputs that are neither PDF nor split already."""
    d = read(spark, sf_dir, "documents").select("doc_id")
    kind = F.element_at(F.array(*map(F.lit, (".pdf", ".DOCX", ".png", ".txt", ".docx"))), (F.col("doc_id") % 5 + 1).cast("int"))
    ext = lambda df: df.withColumn("extension", F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))).drop("doc_id")
    inputs = ext(d.select("doc_id", F.concat(F.lit("in/"), F.col("doc_id").cast("string"), kind).alias("path")))
    cut = ext(d.where("doc_id % 7 = 0").select("doc_id", F.format_string("split/%d_part1.pdf", "doc_id").alias("path")))
    return files.pending_inputs(inputs, cut).select("path")


@query("""
WITH f AS (SELECT CASE WHEN doc_id % 11 = 0 THEN 'in/.' ELSE 'in/' END || doc_id || CASE doc_id % 4 WHEN 0 THEN '.PDF' WHEN 1 THEN '.docx' ELSE '.txt' END AS path, doc_id FROM documents)
SELECT path, CASE doc_id % 4 WHEN 0 THEN 'pdf' ELSE 'docx' END AS kind, row_number() OVER (ORDER BY CASE doc_id % 4 WHEN 0 THEN 0 ELSE 1 END, path) AS place FROM f WHERE doc_id % 4 < 2 AND doc_id % 11 <> 0""")
def split_order(spark, sf_dir):
    """Files to split, in their order: a sequence number is given by one task, as the order of a list of files is one."""
    kind = F.element_at(F.array(*map(F.lit, (".PDF", ".docx", ".txt", ".txt"))), (F.col("doc_id") % 4 + 1).cast("int"))
    lead = F.when(F.col("doc_id") % 11 == 0, "in/.").otherwise("in/")
    chosen = parts.to_split(read(spark, sf_dir, "documents").select(F.concat(lead, F.col("doc_id").cast("string"), kind).alias("path")))
    return chosen.select("path", "kind", F.row_number().over(Window.orderBy(F.desc("kind"), "path")).cast("long").alias("place"))


@query("SELECT 'out/' || source AS folder, count(*) AS files, round(sum(n_chars) / 1024, 1) AS kilobytes FROM documents GROUP BY 1")
def folder_summary(spark, sf_dir):
    return organize.folder_summary(read(spark, sf_dir, "documents").select(F.format_string("out/%s/%d.md", "source", "doc_id").alias("path"), F.col("n_chars").alias("length")))


@query("SELECT CASE WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderstatus = 'O' THEN 'skip' ELSE 'fail' END AS status, count(*) AS files FROM orders GROUP BY 1")
def file_outcomes(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "skip").otherwise("fail")
    return progress.outcomes(read(spark, sf_dir, "orders").select(status.alias("status")))


@query(f"SELECT key FROM ({_ITEMS}) WHERE NOT contains(result, '[IMG_TYPE:') ORDER BY key LIMIT 10")
def first_invalid(spark, sf_dir):
    return progress.first_invalid(_items(spark, sf_dir))


@query("""
SELECT n_nationkey, CAST(CASE WHEN n_nationkey % 3 = 0 THEN 30 ELSE n_nationkey END AS VARCHAR) AS window_up, '30' AS window_down, CASE WHEN n_nationkey % 2 = 0 THEN '0' ELSE '1' END AS format_fix_attempts, '200' AS max_pages, '10' AS concurrency,
  'logs' || n_name AS logs, CASE WHEN n_nationkey % 4 = 0 THEN 42 ELSE n_nationkey END AS seed, '[' || (n_nationkey + 1) || ', 90]' AS percentiles FROM nation""")
def config_values(spark, sf_dir):
    """A configuration for each nation: explicit values, also those of zero, before defaults; null is no value."""

    def run(batches):
        for b in batches:
            out = []
            for n, name in zip(b["n_nationkey"], b["n_name"]):
                given = {"options": {"window_up": None if n % 3 == 0 else int(n), "window_down": None} | ({"format_fix_attempts": 0} if n % 2 == 0 else {}), "paths": {"logs": f"logs{name}"}, "model": None}
                c = config.Config.load(json.dumps(given))
                said = [str(c.options[k]) for k in ("window_up", "window_down", "format_fix_attempts")] + [str(c.parser["max_pages"]), str(c.model["concurrency"]), c.paths["logs"]]
                out.append((n, *said, config.seed("x" if n % 4 == 0 else str(n)), str(config.percentiles(f"{n + 1},90,{n + 1},0,x"))))
            yield pd.DataFrame(out, columns=["n_nationkey", "window_up", "window_down", "format_fix_attempts", "max_pages", "concurrency", "logs", "seed", "percentiles"])

    schema = "n_nationkey long, window_up string, window_down string, format_fix_attempts string, max_pages string, concurrency string, logs string, seed long, percentiles string"
    return read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long"), "n_name").mapInPandas(run, schema)


# Retries and rounds

OUTCOMES = "CASE event_type WHEN 'purchase' THEN 'ok' WHEN 'view' THEN 'rate_limit' WHEN 'click' THEN 'connection' ELSE 'api' END"


@query(f"""
WITH e AS (SELECT user_id, {OUTCOMES} AS o, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
n AS (SELECT *, sum(CASE WHEN o = 'rate_limit' THEN 1 ELSE 0 END) OVER w AS rate, sum(CASE WHEN o IN ('connection', 'api') THEN 1 ELSE 0 END) OVER w AS other FROM e WINDOW w AS (PARTITION BY user_id ORDER BY k)),
f AS (SELECT user_id, min(CASE WHEN o = 'ok' OR rate > 5 OR other > 3 THEN k END) AS first, count(*) AS total FROM n GROUP BY 1)
SELECT n.user_id, max(coalesce(f.first, f.total)) AS attempts, CAST(coalesce(sum(CASE WHEN k < coalesce(f.first, f.total + 1) THEN CASE o WHEN 'rate_limit' THEN least(2 * pow(2, rate - 1), 60) WHEN 'connection' THEN least(5 * pow(2, other - 1), 60) ELSE 2 END END), 0) AS DOUBLE) AS waited, bool_or(k = f.first AND o = 'ok') AS ok
FROM n JOIN f ON n.user_id = f.user_id GROUP BY 1""")
def retry_budgets(spark, sf_dir):
    """Each user's events as the outcomes of one call's attempts."""
    kind = F.when(F.col("event_type") == "purchase", "ok").when(F.col("event_type") == "view", "rate_limit").when(F.col("event_type") == "click", "connection").otherwise("api")
    tries = read(spark, sf_dir, "events").groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("event_id", kind.alias("o")))), lambda e: e["o"]).alias("o"))
    r = policy.retried("o", 5, 3)
    return tries.select("user_id", r["attempts"].cast("long").alias("attempts"), r["waited"].alias("waited"), r["ok"].alias("ok"))


@query("""
WITH r AS (SELECT conv_id, (turn + conv_id) % 3 AS calls, CASE WHEN role = 'system' THEN '' ELSE trim(text) END AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
f AS (SELECT conv_id, min(CASE WHEN NOT (calls > 0 AND k - 1 < 3) AND text <> '' AND k <= 5 THEN k END) AS first, count(*) AS total FROM r GROUP BY 1)
SELECT r.conv_id, max(coalesce(f.first, least(f.total, 5))) AS rounds, md5(coalesce(max(CASE WHEN r.k = f.first THEN r.text END), '[IMG_EMPTY_RESPONSE]')) AS result FROM r JOIN f ON r.conv_id = f.conv_id GROUP BY 1""")
def tool_loops(spark, sf_dir):
    """Conversations as recorded rounds with a model."""
    said = F.when(F.col("role") == "system", "").otherwise(F.trim("text"))
    one = F.struct("turn", ((F.col("turn") + F.col("conv_id")) % 3).cast("int").alias("calls"), said.alias("text"))
    rounds = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(one)), lambda r: F.struct(r["calls"].alias("calls"), r["text"].alias("text"))).alias("r"))
    t = policy.tool_rounds("r", 3)
    return rounds.select("conv_id", t["rounds"].cast("long").alias("rounds"), F.md5(t["result"]).alias("result"))


# Sources and sinks, there and back


@query(f"""
WITH i AS ({_ITEMS})
SELECT key, CASE WHEN doc_id % 2 = 0 THEN '[IMG_TYPE: new] y' ELSE result END AS result FROM i""")
def item_upsert(spark, sf_dir):
    """Items, then newer ones of half the keys, written by key and read again."""
    path, items = scratch.folder(spark, "items"), _items(spark, sf_dir)
    rows = items.select("doc_id", "key", "result", F.lit(0).alias("start"), F.lit(1).alias("end"), F.col("key").alias("img_path"))
    sinks.write_items(rows.drop("doc_id"), path)
    sinks.write_items(rows.where("doc_id % 2 = 0").drop("doc_id").withColumn("result", F.lit("[IMG_TYPE: new] y")), path)
    return files.progress_items(spark, path).where("_corrupt is null").select("key", "result")


@query("SELECT 'f' || c_nationkey || '.pdf' AS file, CASE WHEN count(*) % 2 = 0 THEN 'done' ELSE 'running' END AS status, CAST(max(c_custkey) AS VARCHAR) AS batch_id FROM customer GROUP BY c_nationkey")
def task_states(spark, sf_dir):
    """States, one file a nation; some are written first as pending and then again."""
    path = scratch.folder(spark, "states")
    by = read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.max("c_custkey").cast("string").alias("batch_id"))
    said = by.select("c_nationkey", F.format_string("f%d.pdf", "c_nationkey").alias("file"), "batch_id", F.lit("2024-01-01").alias("created_at"), F.when(F.col("n") % 2 == 0, "done").otherwise("running").alias("status"), F.lit("").alias("last_error"), F.format_string("f%d", "c_nationkey").alias("output_folder"))
    sinks.write_states(said.where("c_nationkey % 2 = 0").drop("c_nationkey").withColumn("status", F.lit("pending")), path)
    sinks.write_states(said.drop("c_nationkey"), path)
    return files.task_states(spark, path).select("file", "status", "batch_id")


PARSED = """
WITH p AS (SELECT source || '_part' || (doc_id % 4 + 8) AS folder, source AS subject, doc_id % 4 + 8 AS part, string_agg(text, chr(10) ORDER BY doc_id) AS text FROM documents GROUP BY ALL)
"""


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as parsed parts on disk, numbered 8 to 11, and read again."""
    path = scratch.folder(spark, "parsed")
    by = read(spark, sf_dir, "documents").groupBy("source", (F.col("doc_id") % 4 + 8).alias("part")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "text"))), lambda x: x["text"]), "\n").alias("content"))
    sinks.write_documents(by.select(F.format_string("%s_part%d/full.md", "source", "part").alias("name"), "content"), path)
    return files.parsed_parts(spark, path)


@query(PARSED + "SELECT subject, part, md5(rtrim(text, chr(10))) AS text FROM p")
def parsed_parts(spark, sf_dir):
    return _parsed(spark, sf_dir).select("subject", "part", F.md5(F.rtrim("text", F.lit("\n"))).alias("text"))


@query(PARSED + "SELECT subject || '.md' AS name, md5(string_agg(rtrim(text, ' ' || chr(9) || chr(13) || chr(10)), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY part) || chr(10)) AS content FROM p WHERE rtrim(text, ' ' || chr(9) || chr(13) || chr(10)) <> '' GROUP BY 1")
def markdown_files(spark, sf_dir):
    """Parts merged into Markdown files, and the files read as the next step does."""
    path = scratch.folder(spark, "markdown")
    merged = organize.merged_parts(_parsed(spark, sf_dir))
    sinks.write_documents(merged.withColumnRenamed("subject", "name"), path)
    return files.markdown(spark, path).select("name", F.md5("content").alias("content"))


@query("SELECT source || '::' || doc_id AS key, md5(text) AS result FROM documents")
def legacy_items(spark, sf_dir):
    """One JSON object of all items of a source; keys without exactly one separator are left out."""
    item = F.struct(F.col("text").alias("result"), F.lit(0).alias("start"), F.lit(1).alias("end"), F.lit("x").alias("img_path"))
    named = F.concat_ws("::", "source", F.col("doc_id").cast("string"))
    both = read(spark, sf_dir, "documents").select("source", F.explode(F.array(F.struct(named.alias("k"), item.alias("v")), F.struct(F.concat(named, F.lit("::x")).alias("k"), item.alias("v")))).alias("e"))
    texts = both.groupBy("source").agg(F.to_json(F.map_from_entries(F.collect_list("e"))).alias("value"))
    return files.legacy_items(texts).select("key", F.md5("result").alias("result"))


@query("SELECT page_id, md5(base64(encode(html))) AS image FROM pages")
def images_base64(spark, sf_dir):
    rows = read(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), F.col("html").cast("binary").alias("content"))
    return files.images_base64(rows).select(F.col("path").cast("long").alias("page_id"), F.md5("image").alias("image"))


@query("SELECT page_id, md5(html) AS content, strlen(html) AS length FROM pages")
def copied_files(spark, sf_dir):
    """Pages as binary files, copied into folders of their own, and the copies read."""
    path = scratch.folder(spark, "copied")
    sinks.write_bytes(read(spark, sf_dir, "pages").select(F.format_string("p%d.bin", "page_id").alias("name"), F.col("html").cast("binary").alias("content")), f"{path}/from")
    listed = files.listing(spark, f"{path}/from", "*.bin").select("path", F.concat(F.regexp_extract("name", r"(\d)\.bin$", 1), F.lit("/"), "name").alias("target"))
    sinks.copied(listed, f"{path}/to")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{path}/to")
    return found.select(F.regexp_extract("path", r"p(\d+)\.bin$", 1).cast("long").alias("page_id"), F.md5("content").alias("content"), "length")


def _zips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as zip files with the page and a count of pages."""

    def run(batches):
        import io
        import zipfile

        for b in batches:
            made = []
            for html in b["html"]:
                raw = io.BytesIO()
                with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr("page/index.html", html)
                    z.writestr("docProps/app.xml", f"<Properties><Pages> {len(html) % 50} </Pages></Properties>")
                made.append(raw.getvalue())
            yield b[["path"]].assign(content=made)

    return read(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), "html").mapInPandas(run, "path string, content binary")


@query("SELECT page_id, md5(html) AS html FROM pages")
def unzipped(spark, sf_dir):
    found = files.unzipped(_zips(spark, sf_dir)).where("entry = 'page/index.html'")
    return found.select(F.col("path").cast("long").alias("page_id"), F.md5("content").alias("html"))


@query("SELECT page_id, length(html) % 50 AS pages FROM pages")
def office_pages(spark, sf_dir):
    return files.office_pages(_zips(spark, sf_dir)).select(F.col("path").cast("long").alias("page_id"), "pages")


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS k FROM documents)
SELECT doc_id, CAST(k AS BIGINT) AS element, CASE WHEN k % 5 = 4 THEN 'table' ELSE 'paragraph' END AS kind, md5(line) AS text FROM l""")
def office_body(spark, sf_dir):
    """Documents as DOCX files, a line a paragraph and every fifth a table, and the elements of their bodies."""

    def run(batches):
        import io
        import zipfile
        from xml.sax.saxutils import escape

        for b in batches:
            made = []
            for text in b["text"]:
                raw = io.BytesIO()
                with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
                    lines = [f"<w:p><w:r><w:t>{escape(x)}</w:t></w:r></w:p>" for x in text.split("\n")]
                    lines = [f"<w:tbl><w:tr>{x}</w:tr></w:tbl>" if k % 5 == 4 else x for k, x in enumerate(lines)]
                    z.writestr("word/document.xml", f'<w:document xmlns:w="w"><w:body>{"".join(lines)}<w:sectPr/></w:body></w:document>')
                made.append(raw.getvalue())
            yield b[["path"]].assign(content=made)

    d = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "text").mapInPandas(run, "path string, content binary")
    found = office.body_elements(d).where("kind in ('paragraph', 'table', 'error')")
    return found.select(F.col("path").cast("long").alias("doc_id"), "element", "kind", F.md5("text").alias("text"))


# Services, with fakes


@query("SELECT page_id || '.html' AS name, CASE WHEN page_id % 10 = 0 THEN 'skip' WHEN page_id = 3 THEN 'fail' ELSE 'done' END AS status, CASE WHEN page_id % 10 > 0 AND page_id <> 3 THEN '# batch-' || page_id || '.html' END AS text, CASE WHEN page_id = 3 THEN 'broken' END AS error FROM pages")
def parse_service(spark, sf_dir):
    """Pages sent to a service that is asked until it is done; every tenth is done already."""
    action = F.when(F.col("page_id") % 10 == 0, "skip").otherwise("submit")
    rows = read(spark, sf_dir, "pages").select(F.format_string("%d.html", "page_id").alias("name"), F.col("html").cast("binary").alias("content"), action.alias("action"), F.lit(None).cast("string").alias("batch_id"))
    return connectors.parsed(rows, connectors.FakeParser(failing=("3.html",)), interval=0.0).select("name", "status", "text", "error")


@query("SELECT doc_id, '[IMG_TYPE: text] ' || CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 0 END AS result, 'ok' AS status, CAST(CASE WHEN doc_id % 2 = 0 THEN 3 ELSE 1 END AS BIGINT) AS requests FROM documents")
def vision_service(spark, sf_dir):
    """Documents' lines, all of them, described by a model that asks twice for more lines, or not at all."""
    d = read(spark, sf_dir, "documents")
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    tasks = d.select(F.col("doc_id").cast("string").alias("key"), F.lit("images/x.png").alias("path"), F.lit("aW1n").alias("image"), lines.alias("lines"), F.lit(0).alias("line_at"))
    asked = lambda rows, n: connectors.described(rows, connectors.FakeVision(asks=n), "model", "prompt", concurrency=4)
    even = F.col("key").cast("long") % 2 == 0
    both = asked(tasks.where(even), 2).unionByName(asked(tasks.where(~even), 0))
    return both.select(F.col("key").cast("long").alias("doc_id"), "result", "status", "requests")


@query("SELECT page_id || '.html' AS name, CASE page_id % 4 WHEN 0 THEN 'skip' WHEN 1 THEN 'poll' WHEN 2 THEN 'resubmit' ELSE 'submit' END AS action FROM pages")
def parse_actions(spark, sf_dir):
    """What is to be done with each page, by its state, its output and what the service says."""
    from . import parse

    p = read(spark, sf_dir, "pages")
    inputs = p.select(F.format_string("in/%d.html", "page_id").alias("path"), F.format_string("%d.html", "page_id").alias("name"))
    k = F.col("page_id") % 4
    states = p.where(k < 3).select(F.format_string("%d.html", "page_id").alias("file"), F.when(k == 0, "done").otherwise("running").alias("status"), F.when(k == 2, "lost").otherwise("batch-x").alias("batch_id"))
    outputs = p.where(k == 0).select(F.col("page_id").cast("string").alias("folder"))
    return parse.actions(inputs, states, outputs, connectors.FakeParser(polls=1 << 30, lost=("lost",))).select("name", "action")


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS k FROM documents),
w AS (SELECT doc_id, k, string_agg(line, chr(10)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING) AS around FROM l)
SELECT doc_id, CAST(k AS BIGINT) AS line_no, md5(around) AS lines, least(k, 3)::INT AS line_at FROM w WHERE k % 2 = 0""")
def frame_lines(spark, sf_dir):
    """The lines that a conversation about every other line of each document can reach."""
    from . import describe

    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("name"), F.col("text").alias("content"))
    at = F.explode(F.sequence(F.lit(0), F.size(F.split("content", "\n", -1)) - 1, F.lit(2)))
    found = describe.with_lines(docs.select("name", at.alias("line_no")), docs, connectors.Limits(start=(2, 1), most=(1, 1), rounds=1))
    return found.select(F.col("name").cast("long").alias("doc_id"), F.col("line_no").cast("long").alias("line_no"), F.md5(F.array_join("lines", "\n")).alias("lines"), "line_at")


BLOCK = "chr(10) || chr(10) || '<!-- IMG: images/' || page_id % 5 || '.png -->' || chr(10) || '[AI] [IMG_TYPE: text] 1' || chr(10) || chr(10) || '<!-- /IMG -->' || chr(10) || chr(10)"


@query(f"SELECT 'd' || page_id % 5 || '.md' AS name, md5(string_agg('p' || page_id || {BLOCK}, chr(10) ORDER BY page_id) || chr(10)) AS content FROM pages GROUP BY page_id % 5")
def described_files(spark, sf_dir):
    """Five documents with an image for each page, described by a model and written with its answers in their places."""
    from . import describe

    top = scratch.folder(spark, "described")
    paths = {k: f"{top}/{k}" for k in ("markdown", "images", "output", "progress", "logs")}
    line = F.format_string("p%d![x](images/%d.png)", F.col("page_id"), F.col("page_id") % 5)
    lines = F.sort_array(F.collect_list(F.struct("page_id", line.alias("line"))))
    docs = read(spark, sf_dir, "pages").groupBy((F.col("page_id") % 5).alias("d")).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("content"))
    sinks.write_documents(docs.select(F.format_string("d%d", "d").alias("name"), "content"), paths["markdown"])
    sinks.write_bytes(docs.select(F.format_string("%d.png", "d").alias("name"), F.lit(b"picture").alias("content")), paths["images"])
    describe.run(spark, paths, connectors.FakeVision(), config.Config.of(), "prompt")
    return files.markdown(spark, paths["output"]).select("name", F.md5("content").alias("content"))


@query("""
WITH r AS (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS refs FROM pages),
u AS (SELECT page_id, unnest(refs) AS path, unnest(generate_series(1, len(refs))) AS k FROM r)
SELECT page_id, path, row_number() OVER (PARTITION BY page_id ORDER BY min(k)) - 1 AS place FROM u GROUP BY page_id, path""")
def ref_order(spark, sf_dir):
    """Distinct references in the order in which they are first seen."""
    from .registry import LINK

    flat = read(spark, sf_dir, "pages").select("page_id", F.posexplode(F.array_distinct(T.image_refs("html", LINK))).alias("place", "path"))
    return flat.withColumn("place", F.col("place").cast("long"))


@query("SELECT 'split' AS name, count(*) AS n FROM pages UNION ALL SELECT 'parse', count(*) FROM documents")
def workflow_steps(spark, sf_dir):
    """Steps that count a table each, until one reads a table that isn't there: those that ran before, and what they counted."""
    from . import workflow

    ran: list[tuple[str, int]] = []
    steps = [("split", "pages"), ("parse", "documents"), ("organize", "missing"), ("describe", "events"), ("analyze", "orders")]
    try:
        workflow.run([(name, lambda name=name, table=table: ran.append((name, read(spark, sf_dir, table).count()))) for name, table in steps], said=lambda _: None)
    except AnalysisException:
        return spark.createDataFrame(ran, "name string, n long")
    return spark.createDataFrame([("none failed", 0)], "name string, n long")


# Streams


STREAM_SESSIONS = LOG_SESSIONS + """o AS (SELECT user_id, max(session) AS last FROM s GROUP BY 1)
SELECT s.user_id, 'doc::images/' || s.key || '.png' AS key, count_tools AS tool_calls, s.status, round(s.elapsed, 6) AS elapsed, CASE WHEN s.status = 'failed' THEN 'rate_limit' END AS error_type, CASE WHEN s.status = 'success' THEN 'table' END AS img_type
FROM (SELECT s.*, (SELECT count(*) FROM base b WHERE b.user_id = s.user_id AND b.session = s.session AND b.event_type = 'view' AND (s.fin IS NULL OR b.event_id < s.fin)) AS count_tools FROM (SELECT s.*, (SELECT min(event_id) FROM base b WHERE b.user_id = s.user_id AND b.session = s.session AND b.event_type IN ('purchase', 'error')) AS fin FROM s) s) s JOIN o ON o.user_id = s.user_id
WHERE NOT (s.status = 'incomplete' AND s.session = o.last)"""


@query(STREAM_SESSIONS)
def stream_sessions(spark, sf_dir):
    """Sessions of the logs as a stream brings them; those still open at its end are not among them."""
    path = scratch.folder(spark, "stream")
    event_lines(spark, sf_dir).select(F.col("name").alias("file"), F.col("event_id").alias("line_no"), "value").coalesce(1).write.json(f"{path}/in")
    found = logs.sessions(logs.lines(spark, f"{path}/in"))
    q = found.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").start()
    logs.stop_after(q, spark.read.json(f"{path}/in").count())
    out = spark.read.parquet(f"{path}/out")
    return out.select(F.col("tid").cast("long").alias("user_id"), "key", "tool_calls", "status", F.round("elapsed", 6).alias("elapsed"), "error_type", "img_type")


def _raw_logs(spark: SparkSession, sf_dir: str, head: str | None = None) -> tuple[str, int]:
    """The event lines as plain logs in a folder, each after a line of its own if there is a head; and how many lines there are."""
    path, lines = scratch.folder(spark, "raw"), event_lines(spark, sf_dir).select("name", "event_id", "value")
    if head is not None:
        lines = lines.unionByName(lines.select("name").distinct().select("name", F.lit(-1).cast("long").alias("event_id"), F.lit(head).alias("value")))
    for k in range(3):
        sinks.write_file(lines.where(f"name = 'img2text_{k}.log'").orderBy("event_id").select("value"), path, f"img2text_{k}.log")
    return path, lines.count()


@query(STREAM_SESSIONS)
def followed_sessions(spark, sf_dir):
    """Sessions of plain logs that are followed as they grow, some hundred kilobytes a batch."""
    path, n = _raw_logs(spark, sf_dir)
    rows = follow.lines(spark, path, max_bytes=1 << 19, split_bytes=1 << 17, state=f"{path}/plan")
    q = logs.sessions(rows).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").start()
    logs.stop_after(q, n)
    out = spark.read.parquet(f"{path}/out")
    return out.select(F.col("tid").cast("long").alias("user_id"), "key", "tool_calls", "status", F.round("elapsed", 6).alias("elapsed"), "error_type", "img_type")


@query(f"SELECT name, text FROM ({RUN_LINES})")
def live_output(spark, sf_dir):
    """What a reader of a growing log is shown, from counts that are kept between batches."""
    path, n = _raw_logs(spark, sf_dir, "[00:00:00][T00] To process: 5000")
    rows = logs.live(follow.lines(spark, path, max_bytes=1 << 20), dense=False)
    q = logs.started(rows.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append"), spark)
    logs.stop_after(q, n)
    return spark.read.parquet(f"{path}/out").select(F.col("file").alias("name"), "text")


@query("SELECT user_id AS key, max(event_id) AS seq FROM events GROUP BY 1")
def stream_upsert(spark, sf_dir):
    """One writer that keeps the last row of each key, batch after batch."""
    path = scratch.folder(spark, "upsert")
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"))
    e.repartitionByRange(3, "seq").write.parquet(f"{path}/in")

    def apply(rows: DataFrame, number: int) -> None:
        kept = spark.read.parquet(f"{path}/out/{number - 1}") if number else rows.limit(0)
        progress.upserted(kept, rows).write.mode("overwrite").parquet(f"{path}/out/{number}")

    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    q = stream.writeStream.foreachBatch(logs.upserting(apply)).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{path}/out/{q.lastProgress['batchId']}")


@query("SELECT user_id % 100 AS user_id, count(*) AS result, CAST(1 AS BIGINT) AS calls FROM events GROUP BY 1")
def durable_calls(spark, sf_dir):
    """A call for each hundredth of the users that counts events, in a run that breaks half-way and one that goes on: no call that ended is made twice."""
    path = scratch.folder(spark, "calls")
    asked = read(spark, sf_dir, "events").groupBy((F.col("user_id") % 100).alias("user_id")).agg(F.count(F.lit(1)).alias("n"))

    def call(row) -> None:
        kept = durable.Store(path)
        if kept.has(f"answers/{row.user_id}.json"):
            return
        if row.user_id == 3 and not kept.has(f"broken/{row.user_id}"):
            kept.put(f"broken/{row.user_id}", b"", sync=False)
            raise RuntimeError("the run breaks here")
        made = (kept.get_json(f"made/{row.user_id}.json") or {"calls": 0})["calls"] + 1
        kept.put_json(f"made/{row.user_id}.json", {"user_id": row.user_id, "calls": made}, sync=False)
        kept.put_json(f"answers/{row.user_id}.json", {"user_id": row.user_id, "result": row.n}, sync=False)

    for _ in range(100):  # as often as it breaks
        try:
            durable.write_calls(asked, call, 4)
            break
        except Exception as e:  # noqa: BLE001
            if "the run breaks here" not in str(e):
                raise
    answers = spark.read.schema("user_id long, result long").json(f"{path}/answers", multiLine=True)
    return answers.join(spark.read.schema("user_id long, calls long").json(f"{path}/made", multiLine=True), "user_id")


@query(f"WITH {LINES} SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS hour, count(*) FILTER (event_type IN ('purchase', 'error')) AS done, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'click') AS warnings FROM lines GROUP BY 1")
def stream_progress(spark, sf_dir):
    """Counts by hour of a stream's event time."""
    path = scratch.folder(spark, "hours")
    lines = event_lines(spark, sf_dir).select(F.timestamp_seconds(T.micros("ts") / 1e6).alias("at"), "value")
    lines.write.parquet(f"{path}/in")
    stream = logs.progress(spark.readStream.schema(lines.schema).parquet(f"{path}/in"), "1 hour")

    def apply(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/out/{number}")

    q = stream.writeStream.foreachBatch(apply).outputMode("complete").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.parquet(f"{path}/out/{q.lastProgress['batchId']}")
    return out.select(F.unix_seconds("window.start").alias("hour"), "done", "errors", "warnings")


@query("SELECT o_orderpriority AS priority, o_orderstatus = 'F' AS closed, count(*) AS orders, round(quantile_cont(CAST(o_totalprice AS DOUBLE), 0.1), 6) AS p10, round(quantile_cont(CAST(o_totalprice AS DOUBLE), 0.5), 6) AS median, round(quantile_cont(CAST(o_totalprice AS DOUBLE), 0.99), 6) AS p99 FROM orders GROUP BY ALL")
def group_quantiles(spark, sf_dir):
    """Exact quantiles of prices in groups of very different sizes."""
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("priority"), (F.col("o_orderstatus") == "F").alias("closed"), "o_totalprice")
    counts = statistics.value_counts(rows, ["priority", "closed"], "o_totalprice")
    found = statistics.quantiles(counts, ["priority", "closed"], (0.1, 0.5, 0.99))
    found = found.select("priority", "closed", *[F.round(f"q{k}", 6).alias(name) for k, name in enumerate(("p10", "median", "p99"))])
    return counts.groupBy("priority", "closed").agg(F.sum("n").alias("orders")).join(found, ["priority", "closed"])


TAKE = "greatest(1, len(list_filter(range(1, least(20, len(s) - {f} + 1) + 1), lambda k: k * list_max(list_slice(s, {f}, {f} + k - 1)) <= 400)))"


@query(f"""
WITH RECURSIVE l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: strlen(x)) AS s FROM documents),
p AS (
  SELECT doc_id, s, 1 AS part, 1 AS f, {TAKE.format(f="1")} AS n FROM l
  UNION ALL SELECT doc_id, s, part + 1, f + n, {TAKE.format(f="(f + n)")} FROM p WHERE f + n <= len(s))
SELECT doc_id, CAST(part AS BIGINT) AS part, CAST(f AS BIGINT) AS first_page, CAST(n AS BIGINT) AS pages, CAST(n * list_max(list_slice(s, f, f + n - 1)) AS DOUBLE) AS size FROM p""")
def measured_parts(spark, sf_dir):
    """Lines of documents as pages that all get the room of the longest one: a size that isn't a sum."""
    lines = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("page", "line"))
    room = lambda pages: len(pages) * max(map(len, pages))
    return parts.measured_parts(lines, "doc_id", "page", "line", room, max_pages=20, max_size=400)


# One hot key: all events as one log of one worker


HOT = """WITH b AS (SELECT event_id, event_type, value, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (ORDER BY event_id) AS session FROM events),
f AS (SELECT session, min(event_id) AS fin FROM b WHERE event_type IN ('purchase', 'error') GROUP BY 1)
"""


def _one_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").withColumn("log", F.lit("one"))


@query(HOT + """SELECT b.session, max(CASE WHEN event_type = 'signup' THEN event_id END) AS key, count(*) FILTER (event_type IN ('view', 'click')) AS tool_calls,
  coalesce(max(CASE event_type WHEN 'purchase' THEN 'success' WHEN 'error' THEN 'failed' END), 'incomplete') AS status, max(CASE WHEN event_type IN ('purchase', 'error') THEN value END) AS elapsed
FROM b LEFT JOIN f ON b.session = f.session WHERE b.session > 0 AND (fin IS NULL OR event_id <= fin) GROUP BY 1""")
def hot_sessions(spark, sf_dir):
    """Sessions of one key, in segments of 500 rows that are finished side by side."""
    kind = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type").isin("view", "click"), "tool").when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "failed")
    found = sessions.sessionise(_one_log(spark, sf_dir), ["log"], ["event_id"], kind, "event_id", "value", F.lit(None), F.lit("x"), segment=F.expr("event_id div 500"))
    return found.select("session", "key", "tool_calls", "status", "elapsed")


@query("""WITH b AS (SELECT *, count(*) FILTER (event_type = 'signup') OVER (ORDER BY event_id) AS block FROM events)
SELECT block, max(CASE WHEN event_type = 'signup' THEN 'p' || event_id END) AS path, bool_or(event_type = 'error') AS bad FROM b WHERE block > 0 GROUP BY 1""")
def hot_blocks(spark, sf_dir):
    """Blocks of one log and whether they hold an error."""
    header = F.when(F.col("event_type") == "signup", F.format_string("p%d", "event_id"))
    return sessions.problem_blocks(_one_log(spark, sf_dir), ["log"], ["event_id"], header, F.col("event_type") == "error", F.expr("event_id div 500")).select("block", "path", "bad")


@query("""WITH c AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS done, (SELECT count(*) FROM events) // 2 AS total FROM events WHERE event_type IN ('purchase', 'error', 'view')),
p AS (SELECT *, done * 100 // total AS percent, lag(done * 100 // total, 1, -1) OVER (ORDER BY event_id) AS last FROM c)
SELECT event_id, done, percent FROM p WHERE percent > last""")
def hot_progress(spark, sf_dir):
    """The running percent of one log, where it grows."""
    e = _one_log(spark, sf_dir)
    rows = e.withColumn("total", F.floor(F.lit(e.count()) / 2))
    return sessions.running_progress(rows, ["log"], ["event_id"], F.col("event_type").isin("purchase", "error", "view"), "total", F.expr("event_id div 500")).select("event_id", "done", "percent")


# Files by kind, items that can't be read, texts for readers, schemas, uploads


@query("""
WITH f AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 3 = 0 THEN 'deep/' ELSE '' END AS d, 's' || s_suppkey || '.' || CASE s_suppkey % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'DOCX' WHEN 2 THEN 'png' ELSE 'txt' END AS name FROM supplier)
SELECT 'one' AS choice, name FROM f WHERE name LIKE '%.pdf' UNION ALL SELECT 'set', name FROM f WHERE lower(name) LIKE '%.docx' OR name LIKE '%.png' UNION ALL SELECT 'glob', name FROM f WHERE name LIKE 's1%.p%' UNION ALL SELECT 'top', name FROM f WHERE d = ''""")
def listed_files(spark, sf_dir):
    """Files of several kinds, one a supplier, by one extension, by a set, by a pattern, and of the folder itself only."""
    path = scratch.folder(spark, "listed")
    k = F.col("s_suppkey") % 4
    kind = F.when(k == 0, "pdf").when(k == 1, "DOCX").when(k == 2, "png").otherwise("txt")
    name = F.concat(F.when(F.col("s_suppkey") % 3 == 0, "deep/").otherwise(""), F.lit("s"), F.col("s_suppkey").cast("string"), F.lit("."), kind)
    durable.write_records(read(spark, sf_dir, "supplier"), path, name, F.lit("x"))
    every = files.listing(spark, path)
    chosen = {"one": files.listing(spark, path, "*.pdf"), "set": files.of_formats(every, "docx", "png"), "glob": files.listing(spark, path, "s1*.p*"), "top": files.listing(spark, path, recursive=False)}
    out = [df.select(F.lit(choice).alias("choice"), "name") for choice, df in chosen.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


def _odd_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as they are kept, every seventh of them cut off in the middle."""
    path = scratch.folder(spark, "odd")
    whole = durable.json_of("key", "result", F.lit(0).alias("start"), F.lit(1).alias("end"), F.col("key").alias("img_path"))
    text = F.when(F.col("doc_id") % 7 == 0, F.substring(whole, 1, 9)).otherwise(whole)
    durable.write_records(_items(spark, sf_dir), path, sinks.item_file("key"), text)
    return files.progress_items(spark, path)


COUNTED = f"""WITH i AS ({_ITEMS}), x AS (SELECT key, doc_id % 7 = 0 AS broken, doc_id % 7 > 0 AND contains(result, '[IMG_TYPE:') AS ok FROM i),
c AS (SELECT count(*) FILTER (ok) AS completed, count(*) FILTER (NOT ok) AS invalid, (SELECT count(*) FROM documents) AS total FROM x)
"""


@query(COUNTED + "SELECT completed, invalid, total, total - completed - invalid AS remaining FROM c")
def counted_items(spark, sf_dir):
    """Items for a count, in which those that can't be read are invalid."""
    return progress.counts(_odd_items(spark, sf_dir), read(spark, sf_dir, "documents").count())


@query(COUNTED + """, l AS (SELECT 0 AS a, 'Progress:' AS line UNION ALL SELECT 1, '  completed=' || completed || '  invalid=' || invalid || '  total=' || total || '  remaining=' || (total - completed - invalid) FROM c UNION ALL SELECT 2, 'Invalid:'
  UNION ALL SELECT 3, '  key=' || coalesce(key, 'None') FROM (SELECT CASE WHEN broken THEN NULL ELSE key END AS key FROM x WHERE NOT ok ORDER BY key NULLS FIRST LIMIT 10))
SELECT a, line, count(*) AS n FROM l GROUP BY ALL""")
def progress_lines(spark, sf_dir):
    """The report of progress, line by line; equal lines count."""
    from . import report

    said = report.progress_report(_odd_items(spark, sf_dir), read(spark, sf_dir, "documents").count()).split("\n")
    rows = [(min(k, 3), x) for k, x in enumerate(said)]
    return spark.createDataFrame(rows, "a int, line string").groupBy("a", "line").agg(F.count(F.lit(1)).alias("n"))


@query(LOG_SESSIONS + """t AS (SELECT user_id, count(*) AS n, count(*) FILTER (status = 'success') AS ok, count(*) FILTER (status = 'failed') AS bad, round(coalesce(sum(elapsed) FILTER (status = 'success'), 0), 6) AS total, round(coalesce(max(elapsed) FILTER (status = 'success'), 0), 6) AS most FROM s GROUP BY 1)
SELECT row_number() OVER (ORDER BY user_id) AS place, 'tid=' || user_id || ' sessions=' || n || ' success=' || ok || ' failed=' || bad AS line FROM t""")
def thread_report(spark, sf_dir):
    """The threads of a session report, in the order of their numbers."""
    from . import report

    found = sessions.log_sessions(event_lines(spark, sf_dir).select(F.lit("all").alias("file"), F.col("event_id").alias("line_no"), "value")).withColumn("tid", F.col("tid").cast("long").cast("string"))
    said = report.numbered(report.lines_of(report.by_thread(found)))
    return said.select("place", F.array_join(F.slice(F.split(F.trim("line"), r"\s+"), 1, 4), " ").alias("line"))


@query("SELECT n_nationkey, 'get_more_context' AS name, CAST(n_nationkey + 1 AS BIGINT) AS up, CAST(2 * n_nationkey + 3 AS BIGINT) AS down, 'more_above,more_below' AS needed FROM nation")
def tool_schemas(spark, sf_dir):
    """The tool that a model is offered, with limits for each nation."""

    def run(batches):
        for b in batches:
            yield b.assign(tool=[json.dumps(connectors.tools(int(n) + 1, 2 * int(n) + 3)[0]["function"]) for n in b["n_nationkey"]])

    made = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long")).mapInPandas(run, "n_nationkey long, tool string")
    most = lambda side: F.get_json_object("tool", f"$.parameters.properties.more_{side}.maximum").cast("long")
    needed = F.array_join(F.from_json(F.get_json_object("tool", "$.parameters.required"), "array<string>"), ",")
    return made.select("n_nationkey", F.get_json_object("tool", "$.name").alias("name"), most("above").alias("up"), most("below").alias("down"), needed.alias("needed"))


@query("""
WITH g AS (SELECT user_id, CAST(ts AS DATE) AS day, event_id, row_number() OVER w AS k, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER w AS gap FROM events WINDOW w AS (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id)),
f AS (SELECT user_id, day, count(*) AS chunks, min(CASE WHEN gap > 7200 THEN k END) AS late FROM g GROUP BY 1, 2)
SELECT user_id, day, CAST(coalesce(late - 2, chunks - 1) AS BIGINT) AS sent, late IS NOT NULL AS idle FROM f""")
def idle_uploads(spark, sf_dir):
    """Uploads whose chunks are taken at the times of a user's events of a day; one that waits for over two hours ends."""

    def run(batches):
        for b in batches:
            out = []
            for times in b["times"]:
                clock, sent, idle = iter([times[0], *(t for x in times[1:] for t in (x, x))]), 0, False
                try:
                    for _ in connectors.unless_idle(iter([b"x"] * (len(times) - 1)), 7200.0, lambda clock=clock: next(clock)):
                        sent += 1
                except TimeoutError:
                    idle = True
                out.append((sent, idle))
            yield b[["user_id", "day"]].assign(sent=[x for x, _ in out], idle=[x for _, x in out])

    at = F.struct((T.micros("ts") / 1e6).alias("at"), "event_id")
    by = read(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.transform(F.sort_array(F.collect_list(at)), lambda x: x["at"]).alias("times"))
    return by.mapInPandas(run, "user_id long, day date, sent long, idle boolean")
