
from __future__ import annotations

import uuid
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import policy
from ..functions import text as T
from ..operators import markdown, progress, sessions
from ..sources import connectors, durable, files, sinks
from ..sources.config import Config


def tasks_of(docs: DataFrame) -> DataFrame:
    """Every reference of docs(name, content): key, name, path, line_no, start, end. An image that is referenced twice has one key."""
    refs = markdown.references(docs, "name", "content")
    return refs.select(T.key_of("name", "path").alias("key"), "name", "path", "line_no", "start", "end")


def with_images(tasks: DataFrame, spark: SparkSession, images: str) -> DataFrame:
    """[F31, S20] Adds image, the base64 of the file that a path names below the folder; null if there is none."""
    if not sinks.exists(spark, images):
        return tasks.withColumn("image", F.lit(None).cast("string"))
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(images)
    root = sinks.qualified(spark, images)
    pictures = found.select(F.substring("path", F.lit(len(root) + 2), F.length("path")).alias("_file"), files.base64_of("content").alias("image"))
    return tasks.withColumn("_file", T.image_file("path")).join(pictures, "_file", "left").drop("_file")


#: Lines in a block, the unit in which documents and frames meet.
BLOCK_LINES = 256


def with_lines(tasks: DataFrame, docs: DataFrame, limits: connectors.Limits) -> DataFrame:
    """[J8] Adds lines and line_at: of a task's document only what any conversation can reach, so a row's size is bounded by the limits.

    A band join: documents are cut into blocks of lines once, a task's frame is dealt to the few blocks that it touches, both
    meet by document and block, and the exact bounds are cut from those. A task of a document that isn't there is left out.
    """
    up, down = limits.reach()
    cut = F.transform(F.sequence(F.lit(0), (F.size("_lines") - 1).cast("int"), F.lit(BLOCK_LINES)), lambda at: F.slice(F.col("_lines"), at + 1, F.lit(BLOCK_LINES)))
    blocks = docs.select("name", markdown.lines_of("content").alias("_lines")).select("name", F.posexplode(cut).alias("_block", "_part"))
    first = F.greatest(F.col("line_no") - up, F.lit(0)).cast("int")
    touched = F.sequence((first / BLOCK_LINES).cast("int"), ((F.col("line_no") + down) / BLOCK_LINES).cast("int"))
    met = tasks.withColumn("_block", F.explode(touched)).join(blocks, ["name", "_block"])
    # cut to the frame before the shuffle: a block is some hundred lines, a frame a few
    at = F.col("_block") * BLOCK_LINES
    low = F.greatest(first - at, F.lit(0)).cast("int")
    high = F.least(F.col("line_no").cast("int") + down - at, F.lit(BLOCK_LINES - 1)).cast("int")
    met = met.withColumn("_part", F.slice("_part", low + 1, high - low + 1))
    whole = met.groupBy(*tasks.columns).agg(F.sort_array(F.collect_list(F.struct("_block", "_part"))).alias("_parts"))  # as many as a frame touches
    return whole.withColumns({"lines": F.flatten(F.transform("_parts", lambda p: p["_part"])), "line_at": (F.col("line_no") - first).cast("int")}).drop("_parts")


def log_of(results: DataFrame, concurrency: int) -> DataFrame:
    """[K10] The lines of a run's log, by time: what operators.sessions.log_sessions reads."""
    at = lambda c: F.timestamp_seconds(c)
    end = F.col("started") + F.col("elapsed")
    took = F.concat(F.lit("["), F.format_string("%.2f", F.col("elapsed")), F.lit("s] "))
    said = F.array(
        F.struct(F.col("started").alias("at"), F.lit(0).alias("step"), F.concat(F.lit("▶ START "), F.col("key")).alias("body")),
        F.struct(end.alias("at"), F.lit(1 << 20).alias("step"), F.when(F.col("status") == "ok", F.concat(F.lit("✓ "), took, F.lit("DONE"))).otherwise(F.concat(F.lit("[ERROR] ✗ "), took, F.lit("FAILED "), T.preview("result", 200))).alias("body")),
    )
    call = lambda x, k: F.struct(F.col("started").alias("at"), (k + 1).alias("step"), F.format_string("  [ToolCall] AI wants +%dup/-%ddown", x["more_above"], x["more_below"]).alias("body"))
    flat = results.select("key", "thread", F.explode(F.concat(said, F.transform("asked", call))).alias("e"))
    return flat.select("e.at", "thread", "key", "e.step", sinks.log_line(at("e.at"), "thread", "e.body", concurrency).alias("value")).orderBy("at", "thread", "key", "step").select("value")


def run(spark: SparkSession, paths: dict[str, str], client: connectors.VisionClient, config: Config, template: str, number: int | None = None, seed: int = 42, concurrency: int | None = None) -> dict[str, int]:
    """Describes the images of paths["markdown"] and writes the described documents to paths["output"].

    Items are kept below paths["progress"], each as soon as it is answered and before the next is asked for; those that are
    valid aren't asked for again, by whatever run they came and however it ended. With a number only so many images are
    taken, the same ones for a seed. Every occurrence of an image gets its text, from this run or an earlier one. Returns
    counts. A run that ends well removes the notes (_runs) of itself and of those that were killed.
    """
    options, limits = config.options, connectors.Limits.of(config.options)
    concurrency = concurrency or config.model["concurrency"]
    docs = files.markdown(spark, paths["markdown"], by_name=False)
    tasks = tasks_of(docs).persist()  # of each text once: they are asked for, spliced and counted
    kept = files.progress_items(spark, paths["progress"]) if sinks.exists(spark, paths["progress"]) else spark.createDataFrame([], f"{files.ITEM_SCHEMA}, _corrupt string")
    once = sessions.first_seen(tasks, "key", ["start"])
    left = progress.pending(once, kept)
    if number is not None:
        left = sessions.sample_n(left, "key", number, seed)
    prompt = said_prompt(spark, template, options)
    ready = with_images(with_lines(left, docs, limits), spark, paths["images"])
    number_of_run = uuid.uuid4().hex
    model = connectors.Model(client, config.model.get("name", "model"), prompt, config.model["request_body"], limits)
    calls = ready.select("key", sinks.item_file("key").alias("item"), "path", "image", "lines", "line_at", F.col("start").cast("int"), F.col("end").cast("int"))
    durable.write_calls(calls, connectors.describing(model, paths["progress"], number_of_run), concurrency)
    results = durable.outcomes(spark, f"{paths['progress']}/_runs/{number_of_run}", connectors.RESULTS)
    if "logs" in paths:
        stamp = datetime.now(UTC).strftime("%Y%m%d_%H%M%S")
        sinks.write_file(log_of(results, concurrency), paths["logs"], f"img2text_{stamp}.log")
    # all that is known by now, whichever run it is from
    items = files.progress_items(spark, paths["progress"]) if sinks.exists(spark, paths["progress"]) else kept
    texts = items.where(T.valid_result("result")).select("key", "result").dropDuplicates(["key"])
    described = tasks.join(texts, "key").select("name", "start", "end", "path", "result")
    sinks.write_documents(markdown.spliced_documents(docs, "name", "content", described), paths["output"])
    counts: dict[str, Any] = results.agg(F.count(F.lit(1)).alias("asked"), *[F.count(F.when(F.col("status") == s, 1)).alias(s) for s in ("ok", "error", "retry")]).first().asDict()
    counts |= {"images": tasks.count(), "left": progress.pending(once, items).count()}
    tasks.unpersist()
    sinks.removed(spark, f"{paths['progress']}/_runs")
    return counts


def said_prompt(spark: SparkSession, template: str, options: dict[str, Any]) -> str:
    """The configured prompt, on the driver."""
    return spark.range(1).select(policy.prompt(F.lit(template), options["max_retries"], F.lit(options["output_language"]))).first()[0]
