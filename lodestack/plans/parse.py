
from __future__ import annotations

import io
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import policy
from ..functions import text as T
from ..operators import parts, progress
from ..sources import connectors, durable, files, sinks
from ..sources.config import Config

#: A splitter gives the parts (name, content) of a file.
Splitter = Callable[[str, bytes], list[tuple[str, bytes]]]


def actions(inputs: DataFrame, states: DataFrame, outputs: DataFrame, client: connectors.ParseClient, concurrency: int = 5) -> DataFrame:
    """[R7, J7, F43] inputs(path, name) with batch_id and action: by the kept state, whether there is output in a folder of its stem, and what the service says."""
    kept = states.select(F.col("file").alias("name"), "status", "batch_id").dropDuplicates(["name"])
    have = outputs.select(F.col("folder").alias("_stem")).distinct().withColumn("has_output", F.lit(True))
    known = inputs.join(kept, "name", "left").withColumn("_stem", T.stem("name")).join(have, "_stem", "left").withColumn("has_output", F.coalesce("has_output", F.lit(False)))
    asked = connectors.remote_states(known.drop("_stem"), client, concurrency)
    return progress.resume_actions(asked)


def run(spark: SparkSession, inputs: DataFrame, output: str, states: str, client: connectors.ParseClient, config: Config) -> DataFrame:
    """Parses inputs, a listing with path and name, into <output>/<stem>/full.md; returns counts of done, skip, fail and running.

    A file's state has its batch id before the first poll and its text is there before the state says done, so a run that is
    killed leaves nothing to be paid for again: the next one polls the batches that are open and skips what is done. A failed
    file doesn't end the run; its count says so.
    """
    o = config.parser
    kept = files.task_states(spark, states) if sinks.exists(spark, states) else spark.createDataFrame([], files.STATE_SCHEMA)
    none = spark.createDataFrame([], "path string")
    texts = files.listing(spark, output, "full.md").select("path") if sinks.exists(spark, output) else none
    have = texts.select(F.element_at(F.split("path", "/"), -2).alias("folder"))
    todo = actions(inputs.select("path", "name"), kept, have, client, o["concurrency"])
    content = spark.read.format("binaryFile").load([r["path"] for r in inputs.select("path").collect()]) if inputs.take(1) else spark.createDataFrame([], "path string, content binary")
    ready = todo.join(content.select("path", "content"), "path").select("name", T.stem("name").alias("stem"), sinks.state_file("name").alias("state"), "content", "action", "batch_id")
    run_id = uuid.uuid4().hex
    durable.write_calls(ready, connectors.parsing(client, states, output, run_id, connectors.Waits(o["poll_interval"], o["poll_timeout"])), o["concurrency"])
    results = durable.outcomes(spark, f"{states}/_runs/{run_id}", "name string, status string, batch_id string, error string")
    counts = spark.createDataFrame(progress.outcomes(results).collect(), "status string, files long")
    sinks.removed(spark, f"{states}/_runs")
    return counts


def split(listed: DataFrame, splitters: dict[str, Splitter]) -> DataFrame:
    """[O5] path, name, content, error of the parts of listed files, PDF and DOCX; a file that fails has one row with its error."""
    spark = listed.sparkSession
    chosen = parts.to_split(listed).select("path", "kind")
    rows = [r["path"] for r in chosen.select("path").collect()]
    content = spark.read.format("binaryFile").load(rows) if rows else spark.createDataFrame([], "path string, content binary")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, kind, raw in zip(b["path"], b["kind"], b["content"]):
                try:
                    made = [(path, name, part, None) for name, part in splitters[kind](path.rsplit("/", 1)[-1], raw)]
                except Exception as e:  # noqa: BLE001  the others go on
                    made = [(path, None, None, str(e)[:200] or type(e).__name__)]
                yield pd.DataFrame(made, columns=["path", "name", "content", "error"])

    return chosen.join(content.select("path", "content"), "path").select("path", "kind", "content").mapInPandas(cut, "path string, name string, content binary, error string")


def by_zip_entries(name: str, raw: bytes) -> list[tuple[str, bytes]]:
    """A splitter for tests and for archives that hold pages as entries: one part for each entry, numbered."""
    import zipfile

    stem, kind = name.rsplit(".", 1)
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        return [(f"{stem}_part{k + 1}.{kind}", z.read(entry)) for k, entry in enumerate(sorted(z.namelist()))]
