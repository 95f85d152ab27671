
from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from os.path import abspath
from posixpath import normpath

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T

#: [E6] progress item and [E7, S10] task state.
ITEM_SCHEMA = "key string, result string, start int, end int, img_path string"
STATE_SCHEMA = "file string, batch_id string, created_at string, status string, last_error string, output_folder string"
POLL_SCHEMA = "code int, msg string, data struct<extract_result: array<struct<state: string, err_msg: string, full_zip_url: string, extract_progress: struct<extracted_pages: int, total_pages: int>>>>"
CREATE_SCHEMA = "code int, msg string, data struct<batch_id: string, file_urls: array<string>>"
LEGACY_SCHEMA = "map<string, struct<result: string, start: int, end: int, img_path: string>>"
PAGES_TAG = r"<Pages>\s*(\d+)\s*</Pages>"


def _name(path: str | Column = "path") -> Column:
    return F.element_at(F.split(F.col(path) if isinstance(path, str) else path, "/"), -1)


def plain_path(path: str | Column) -> Column:
    """A local path without its scheme, so that it can be compared with one that was never given any."""
    return F.regexp_replace(F.col(path) if isinstance(path, str) else path, "^file:/+", "/")


def _source() -> Column:
    """The file a row comes from, as it is written: Spark gives it percent-encoded."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def many_small(spark: SparkSession) -> None:
    """For folders of very many small files: a session that has the default of 4 MB for opening one, which makes a task of every
    32 files, gets 64 KB, also for what else it reads."""
    if spark.conf.get("spark.sql.files.openCostInBytes", "4194304") in ("4194304", "4194304b", "4MB", "4mb", "4m"):
        spark.conf.set("spark.sql.files.openCostInBytes", "65536")


def small_batches(spark: SparkSession) -> None:
    """Rows that are whole files would fill Arrow batches of the defaults of 10,000 rows and 64 MB: a session that has these gets
    smaller ones, also for what else it runs."""
    for name, default, less in (("maxRecordsPerBatch", "10000", "500"), ("maxBytesPerBatch", "67108864b", "4m")):
        if spark.conf.get(f"spark.sql.execution.arrow.{name}", None) == default:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", less)


def listing(spark: SparkSession, path: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """[E18, S13 to S15] path, name, extension, length, modificationTime; file contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(path)
    return files.select("path", _name().alias("name"), F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).alias("extension"), "length", "modificationTime")


def of_formats(files: DataFrame, *extensions: str) -> DataFrame:
    """[S14, S25] Files with one of the extensions (of all formats that can be parsed, if none is given), by path."""
    return files.where(F.col("extension").isin(*(extensions or P.SUPPORTED))).orderBy("path")


def main_logs(files: DataFrame) -> DataFrame:
    """[S5, D9] Main logs; the error logs, whose names begin alike, are none."""
    return files.where(F.col("name").rlike(r"^img2text_.*\.log$") & ~F.col("name").startswith("img2text_error"))


def resolved_logs(files: DataFrame, explicit: list[str] | None = None, everything: bool = False) -> DataFrame:
    """[S3 to S6] An explicit choice by path, URI or bare name, or all main logs by name, or the one changed last (the greater name at one time)."""
    if explicit:
        paths = ["/" + x.removeprefix("file:").lstrip("/") if x.startswith("file:") else x if "://" in x else abspath(x) for x in explicit]
        return files.where(plain_path("path").isin(*paths) | F.col("name").isin(*explicit)).select("path")
    logs = main_logs(files)
    if everything:
        return logs.select("path").orderBy("path")
    return logs.agg(F.max_by("path", F.struct("modificationTime", "name")).alias("path")).where("path is not null")


def log_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """[S1, S2, H1] file, line_no from 0, value of logs; a carriage return at a line's end goes.

    Files are read by splits, so a log may be of any size. A line's number is its place in its split and the lines of the
    file's earlier splits: only a count for each split is gathered.
    """
    rows = spark.read.option("lineSep", "\n").text(list(paths)).select("value", _source().alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    splits = rows.groupBy("file", "_block").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "_block", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    numbered = rows.join(splits, ["file", "_block"])
    return numbered.select("file", (F.col("_id") + F.col("_shift")).alias("line_no"), F.regexp_replace("value", r"\r$", "").alias("value"))


def markdown(spark: SparkSession, path: str, by_name: bool = True) -> DataFrame:
    """[S7] name, content of the *.md files of a folder, itself only, by name; or as the tasks read them, without a shuffle of texts."""
    docs = spark.read.option("pathGlobFilter", "*.md").text(path, wholetext=True)
    named = docs.select(_name(_source()).alias("name"), F.col("value").alias("content"))
    return named.orderBy("name") if by_name else named


def parsed_parts(spark: SparkSession, path: str) -> DataFrame:
    """[S11, E14] subject, part, text of <path>/<subject>[_part<n>]/full.md; [D29] a whole text counts as part 0 beside parts."""
    docs = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "full.md").text(path, wholetext=True)
    folder = F.element_at(F.split(_source(), "/"), -2)
    return docs.select(T.part_of(folder).alias("p"), F.col("value").alias("text")).select("p.subject", F.coalesce("p.part", F.lit(0)).alias("part"), "text")


def pending_inputs(inputs: DataFrame, parts: DataFrame) -> DataFrame:
    """[U6, J6] What is to be parsed: all parts that can be, and of the inputs those that can be but are neither PDF nor split already."""
    from ..operators.organize import unsplit

    others = [x for x in P.SUPPORTED if x != "pdf"]
    rest = inputs.where(F.col("extension").isin(*others))
    office = unsplit(rest.where("extension = 'docx'"), parts)
    return parts.where(T.supported("path")).unionByName(rest.where("extension <> 'docx'")).unionByName(office)


def image_files(files: DataFrame) -> DataFrame:
    """[S12] Files of folders named images: name, path, folder."""
    return files.where(F.col("path").rlike("/images/[^/]+$")).select("name", "path", F.element_at(F.split("path", "/"), -3).alias("folder"))


def progress_items(spark: SparkSession, path: str) -> DataFrame:
    """[S8, S9, D10, H10] Items at any depth, one or more a file, with _corrupt for what isn't JSON: skip it for progress, count it as invalid."""
    many_small(spark)
    texts = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(path, wholetext=True)
    lines = F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")
    each = F.when(F.forall(lines, lambda x: x.startswith("{") & F.rtrim(x, F.lit(" \r")).endswith("}")), lines).otherwise(F.array("value"))
    return json_items(texts.select(F.explode(each).alias("value")))


def json_items(texts: DataFrame, content: str = "value") -> DataFrame:
    """[E6] Items of JSON texts; one that can't be read is kept in _corrupt."""
    item = F.from_json(content, f"{ITEM_SCHEMA}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return texts.select(item.alias("item")).select("item.*")


def task_states(spark: SparkSession, path: str) -> DataFrame:
    """[S10, D19] Task states, at any depth; files that aren't JSON are no state."""
    reader = spark.read.schema(f"{STATE_SCHEMA}, _corrupt string").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json")
    # parsed once and kept: a filter on the corrupt column alone would read nothing else
    states = reader.json(path, multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt")
    return states.where("_corrupt is null and file is not null").drop("_corrupt")


def legacy_items(texts: DataFrame, content: str = "value") -> DataFrame:
    """[S24] Items of one JSON object {key: item}; keys without exactly one ``::`` are invalid and left out."""
    flat = texts.select(F.explode(F.from_json(content, LEGACY_SCHEMA)).alias("key", "item"))
    return flat.where(F.size(F.split("key", "::", -1)) == 2).select("key", "item.*")


def office_pages(files: DataFrame) -> DataFrame:
    """[S18] path, pages of DOCX files read as binaryFile, by their own count; 0 without one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        for b in batches:
            pages = []
            for raw in b["content"]:
                try:
                    found = re.search(PAGES_TAG.encode(), zipfile.ZipFile(io.BytesIO(raw)).read("docProps/app.xml"))
                except (zipfile.BadZipFile, KeyError):
                    found = None
                pages.append(int(found[1]) if found else 0)
            yield pd.DataFrame({"path": b["path"], "pages": pages})

    return files.select("path", "content").mapInPandas(run, "path string, pages long")


def unzipped(files: DataFrame) -> DataFrame:
    """[S21] path, entry, content of zip files read as binaryFile; an entry that leads out of its folder fails the file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, raw in zip(b["path"], b["content"]):
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    for name in z.namelist():
                        if name.startswith("/") or normpath(name).startswith(".."):
                            raise ValueError(f"{path}: entry {name} leads out of its folder")
                        if not name.endswith("/"):
                            yield pd.DataFrame({"path": [path], "entry": [name], "content": [z.read(name)]})

    return files.select("path", "content").mapInPandas(run, "path string, entry string, content binary")


def images_base64(files: DataFrame) -> DataFrame:
    """[S20, without resizing] path and content of image files as base64."""
    return files.select("path", base64_of("content").alias("image"))


def base64_of(content: str | Column) -> Column:
    """Base64 in one line: Spark's own breaks it after 76 characters."""
    return F.translate(F.base64(content), "\r\n", "")
