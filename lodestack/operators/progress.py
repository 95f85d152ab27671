
from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions import policy
from ..functions.text import _c, percent, valid_result
from .sessions import latest_per_key

if TYPE_CHECKING:
    import pyarrow as pa


def pending(tasks: DataFrame, items: DataFrame, key: str = "key", result: str = "result") -> DataFrame:
    """[J1, U4] Tasks, repeats included, without a valid item."""
    return tasks.join(items.where(valid_result(result)).select(key), key, "left_anti")


def counts(items: DataFrame, total: int | Column, result: str = "result") -> DataFrame:
    """[A14] completed, invalid and remaining of a total (a number, or a scalar subquery); remaining may be negative."""
    ok = valid_result(result)
    out = items.agg(F.count(F.when(ok, 1)).alias("completed"), F.count(F.when(~ok, 1)).alias("invalid"))
    out = out.withColumn("total", F.lit(total).cast("long"))
    return out.withColumn("remaining", F.col("total") - F.col("completed") - F.col("invalid"))


def first_invalid(items: DataFrame, most: int = 10, key: str = "key", result: str = "result") -> DataFrame:
    """[T8] The first keys of items without a valid result; the limit is the report's."""
    return items.where(~valid_result(result)).select(key).orderBy(key).limit(most)


def good_rate(completed: DataFrame, problems: DataFrame, path: str = "path") -> DataFrame:
    """[A15, J5, U3] completed, bad (completed paths with a problem) and the share of the others in percent."""
    done = completed.select(path).distinct()
    bad = problems.select(path).distinct().withColumn("_bad", F.lit(1))
    out = done.join(bad, path, "left").agg(F.count(F.lit(1)).alias("completed"), F.count("_bad").alias("bad"))
    return out.withColumn("good_rate", F.round(percent(F.col("completed") - F.col("bad"), "completed"), 6))


def upserted(kept: DataFrame, new: DataFrame, key: str = "key", order: str = "seq") -> DataFrame:
    """[K4, K13, R3] The last item of each key; results that are to be retried aren't kept."""
    return latest_per_key(kept.unionByName(new), key, [order])


def resume_actions(states: DataFrame) -> DataFrame:
    """[R7, J7] Adds action to rows with status, has_output, batch_id and remote."""
    return states.withColumn("action", policy.resume_action("status", "has_output", "batch_id", "remote"))


def outcomes(results: DataFrame, status: str = "status") -> DataFrame:
    """[A19] Counts of done, skip and fail."""
    return results.groupBy(status).agg(F.count(F.lit(1)).alias("files"))


def shown_polls(rows: DataFrame, by: list[str], order: list[str], at: str | Column, pages: str | Column, state: str | Column, threshold: int, first: float = 3.0, most: float = 64.0) -> DataFrame:
    """[W11, R4] by and place, from 1, of the polls that are shown, by the rule of policy.emitted_polls.

    A key's polls come sorted, batch after batch, and only what was last shown is carried on, so a key may have any number
    of them; the sort spills to disk. Keys may be null.
    """
    base = rows.select(*by, *order, _c(at).cast("double").alias("_at"), _c(pages).cast("long").alias("_pages"), _c(state).alias("_state"))
    dealt = base.repartition(*by).sortWithinPartitions(*by, *order).select(*by, "_at", "_pages", "_state")
    n = len(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        key: object = run  # no row has it
        place, last_pages, last_at, wait = 0, None, 0.0, first
        for b in batches:
            hits, places = [], []
            for k, row in enumerate(zip(*(c.to_pylist() for c in b.columns))):
                if row[:n] != key:
                    key, place, last_pages, last_at, wait = row[:n], 0, None, 0.0, first
                now, seen, said = row[n:]
                place += 1
                note = last_pages is None or (seen is not None and seen - last_pages >= threshold) or said in ("done", "failed")
                if not note and (None in (seen, said, now, last_at) or now - last_at < wait):  # as columns compare: nothing follows from an unknown
                    continue
                wait = first if note else min(wait * 2, most)
                last_pages, last_at = seen, now
                hits.append(k)
                places.append(place)
            kept = b.take(pa.array(hits, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns[:n], pa.array(places, pa.int64())], [*b.schema.names[:n], "place"])

    schema = StructType([*dealt.schema.fields[:n], StructField("place", LongType())])
    return dealt.mapInArrow(run, schema)
