
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.text import _c
from ..operators.sessions import latest_per_key
from . import durable

SESSION_COLUMNS = ("key", "thread_id", "tool_calls", "status", "elapsed_sec", "error_type", "error_msg", "img_type")


def session_csv_rows(sessions: DataFrame, thread: str = "tid") -> DataFrame:
    """[K1, A6 of the fixtures] The eight columns of the session file; an elapsed time of 0 and missing texts are empty."""
    said = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return sessions.select("key", F.col(thread).alias("thread_id"), "tool_calls", "status", F.nullif(F.col("elapsed"), F.lit(0.0)).alias("elapsed_sec"), said("error_type"), said("error_msg"), said("img_type"))


def write_session_csv(sessions: DataFrame, path: str, thread: str = "tid") -> None:
    """[K1]"""
    session_csv_rows(sessions, thread).write.mode("overwrite").csv(path, header=True, emptyValue="", escape='"')


#: Lines of thread logs that a task writes.
TASK_LINES = 20_000
#: What Spark writes otherwise in the names of a partition's folders; the percent sign first.
_ESCAPED = "%\"#'*/:=?\\{[]^" + "".join(map(chr, range(1, 32))) + "\x7f"


def _partition(name: str) -> Column:
    """A folder ``name=value`` as Spark's readers take it apart."""
    value = F.col(name)
    for c in _ESCAPED:
        value = F.replace(value, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return F.concat(F.lit(f"{name}="), F.when(F.col(name).isNull() | (F.col(name) == ""), "__HIVE_DEFAULT_PARTITION__").otherwise(value))


def write_thread_logs(lines: DataFrame, path: str) -> None:
    """[K2] One folder of text for each file and thread, lines in their order, over part files in theirs.

    Dealt by ranges of (log, thread, line), so a thread with most lines is written by many tasks, and a task has few folders.
    Their number goes by lines: adaptive execution goes by bytes, of which a file has few, and would leave one task or two. Tasks
    put their own files in place; Hadoop's writer takes several milliseconds for each, and the driver's for its move.
    """
    spark = lines.sparkSession
    removed(spark, path)
    x = lines.select(T.stem("file").alias("log"), T.split_thread("value").alias("tid"), "line_no", "value")
    ordered = x.repartitionByRange(lines.count() // TASK_LINES + 1, "log", "tid", "line_no").sortWithinPartitions("log", "tid", "line_no")
    name = F.concat_ws("/", _partition("log"), _partition("tid"), F.format_string("part-%05d.txt", F.spark_partition_id()))
    durable.write_pieces(ordered, path, name, F.lit(None), F.concat(F.coalesce("value", F.lit("")), F.lit("\n")))


def _files(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and a function that makes its paths."""
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make


def qualified(spark: SparkSession, path: str) -> str:
    """A path as Spark's listings write it."""
    fs, make = _files(spark, path)
    return fs.makeQualified(make(path)).toString()


def exists(spark: SparkSession, path: str) -> bool:
    """[F43]"""
    fs, make = _files(spark, path)
    return fs.exists(make(path))


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder, if it is there."""
    fs, make = _files(spark, path)
    fs.delete(make(path), True)


def write_documents(docs: DataFrame, path: str, name: str = "name", content: str = "content", manifest: str | None = None) -> None:
    """[K5, K6] One file ``<path>/<name>`` for each document, with .md where the name has no such end; a text ends with a line end.

    The task that has a document writes its file, beside its place and then into it; the driver touches none. Each task
    lists what it wrote below ``manifest``, if that is given.
    """
    named = F.when(F.endswith(F.col(name), F.lit(".md")), F.col(name)).otherwise(F.concat(F.col(name), F.lit(".md")))
    durable.write_large(docs, path, named, F.concat(F.regexp_replace(content, r"\n\z", ""), F.lit("\n")), manifest)


def write_file(lines: DataFrame, folder: str, name: str) -> None:
    """One text file of rows in their order, written by one task and renamed at the end."""
    fs, make = _files(lines.sparkSession, folder)
    fs.mkdirs(make(folder))
    staged = f"{folder}/_staged-{uuid.uuid4().hex}"
    lines.coalesce(1).write.text(staged)
    for part in fs.listStatus(make(staged)):
        if part.getPath().getName().startswith("part-"):
            fs.delete(make(f"{folder}/{name}"), False)
            fs.rename(part.getPath(), make(f"{folder}/{name}"))
    fs.delete(make(staged), True)


def write_bytes(rows: DataFrame, folder: str, name: str = "name", content: str = "content") -> int:
    """[K14] Binary files of rows(name, content), written by the tasks that have them; returns how many."""
    listed = f"{folder}/_written-{uuid.uuid4().hex}"
    durable.write_records(rows, folder, name, content, listed)
    spark = rows.sparkSession
    n = spark.read.text(listed).count() if exists(spark, listed) else 0
    removed(spark, listed)
    return n


def copied(files: DataFrame, target: str, path: str = "path", to: str = "target", concurrency: int = 16) -> int:
    """[K11] Copies files(path, target: a path below the folder target) on executors, some megabytes at a time. Returns how many."""
    listed = files.select(F.col(path).alias("source"), F.col(to).alias("name"))

    def call(row) -> None:
        durable.Store(target).copy(row.source, row.name)

    durable.write_calls(listed, call, concurrency)
    return listed.count()


def write_items(items: DataFrame, path: str, key: str = "key", order: str | None = None) -> None:
    """[K3, K4] Upserts progress items, each as ``<path>/<stem of its document>/<safe name of its image>.json``.

    Of items with one key the last by ``order`` counts (any, without one). Nothing but the files of new items is touched.
    """
    one = items.dropDuplicates([key]) if order is None else latest_per_key(items, key, [order]).drop(order)
    durable.write_records(one, path, item_file(key), durable.json_of(*one.columns))


def write_states(states: DataFrame, path: str, key: str = "file") -> None:
    """[K13] Upserts task states, each as ``<path>/<stem of its file>_task.json``."""
    durable.write_records(states.dropDuplicates([key]), path, state_file(key), durable.json_of(*states.columns))


def item_file(key: str | Column = "key") -> Column:
    """[K4] Where the item of a key is kept."""
    parts = T.key_parts(key)
    return F.concat(T.stem(parts["document"]), F.lit("/"), T.safe_name(parts["path"]))


def state_file(file: str | Column = "file") -> Column:
    """[K13] Where the state of a file is kept."""
    return F.concat(T.stem(file), F.lit("_task.json"))


def log_line(time: str | Column, thread: str | Column, body: str | Column, concurrency: int = 10, level: str | None = None) -> Column:
    """[K10] A line of the main log."""
    said = _c(body) if level is None else F.concat(F.lit(f"[{level}] "), _c(body))
    return F.concat(F.lit("["), F.date_format(_c(time), "HH:mm:ss"), F.lit("][T"), T.padded_thread(thread, concurrency), F.lit("] "), said)


def error_log_line(time: str | Column, level: str, body: str | Column) -> Column:
    """[K10] A line of the error log, which carries the date."""
    return F.concat(F.date_format(_c(time), "yyyy-MM-dd HH:mm:ss"), F.lit(f" [{level}] "), _c(body))
