"""

All of it works on the lines of one document, so nothing here shuffles texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..functions.text import _c


def lines_of(content: str | Column) -> Column:
    return F.split(_c(content), "\n", -1)


def line_starts(content: str | Column) -> Column:
    """[W9] Code points before each line."""
    sizes = F.transform(lines_of(content), lambda x: F.length(x) + 1)
    return F.zip_with(T.running_sum(sizes), sizes, lambda end, n: end - n)


def line_table(docs: DataFrame, key: str, content: str) -> DataFrame:
    """[W9] key, line_no from 0, start, line."""
    # steps of their own: lines and sizes are used more than once, but made once
    cut = docs.select(key, lines_of(content).alias("_lines")).withColumn("_sizes", F.transform("_lines", lambda x: F.length(x) + 1))
    cut = cut.withColumn("_ends", T.running_sum("_sizes"))
    flat = cut.select(key, F.posexplode(F.arrays_zip("_ends", "_sizes", "_lines")).alias("line_no", "x"))
    return flat.select(key, F.col("line_no").cast("long").alias("line_no"), (F.col("x._ends") - F.col("x._sizes")).cast("long").alias("start"), F.col("x._lines").alias("line"))


def _frame(lines: Column, at: Column, up: int | Column, down: int | Column) -> Column:
    first = F.greatest(F.lit(0), at - up)
    last = F.least(F.size(lines), at + down + 1)
    return F.struct(first.alias("first"), last.alias("last"))


def _marked(lines: Column, numbers: Column, at: Column) -> Column:
    one = lambda n: F.concat(F.when(n == at, F.lit(">>>[IMG] ")).otherwise(F.concat(F.lit("[L"), n.cast("string"), F.lit("] "))), F.element_at(lines, n + 1))
    return F.transform(numbers, one)


def _between(first: Column, last: Column) -> Column:
    """first to last - 1; empty if there is none."""
    return F.when(first < last, F.sequence(first, last - 1)).otherwise(F.array().cast("array<int>"))


def context(content: str | Column, at: str | Column, up: int, down: int) -> Column:
    """[W3, J8] Lines around line ``at``, marked with their numbers; the line itself is marked as the image's."""
    lines, at = lines_of(content), _c(at).cast("int")
    f = _frame(lines, at, up, down)
    return _marked(lines, _between(f["first"], f["last"]), at)


def context_delta(content: str | Column, at: str | Column, old: tuple[int, int], new: tuple[int, int]) -> Column:
    """[W5] Lines of the new frame that the old one didn't have, those above first."""
    lines, at = lines_of(content), _c(at).cast("int")
    a, b = _frame(lines, at, *old), _frame(lines, at, *new)
    return _marked(lines, F.concat(_between(b["first"], F.least(a["first"], b["last"])), _between(F.greatest(a["last"], b["first"]), b["last"])), at)


def references(docs: DataFrame, key: str, content: str, pattern: str = P.IMAGE_REF, within: int = 1) -> DataFrame:
    """[F12, F20, E5] Every reference: key, number, line_no, start, end (code points of the whole match), path.

    A reference never crosses a line end, so matches are placed by the pieces between them within each line.
    """
    lines = line_table(docs, key, content).where(F.col("line").rlike(pattern))
    # steps of their own: each line is matched once for its hits and once for their paths
    lines = lines.withColumn("_hits", F.regexp_extract_all("line", F.lit(pattern), F.lit(0)))
    lines = lines.withColumn("_sizes", F.zip_with(F.slice(F.split("line", pattern, -1), F.lit(1), F.size("_hits")), "_hits", lambda p, h: F.length(p) + F.length(h)))
    places = F.zip_with(T.running_sum("_sizes"), "_hits", lambda end, h: F.struct((end - F.length(h)).alias("start"), end.alias("end")))
    paths = F.regexp_extract_all("line", F.lit(pattern), F.lit(within))
    flat = lines.select(key, "line_no", "start", F.posexplode(F.arrays_zip(places.alias("place"), paths.alias("path"))).alias("number", "x"))
    return flat.select(key, "line_no", F.col("number").cast("long").alias("number"), (F.col("start") + F.col("x.place.start")).alias("start"), (F.col("start") + F.col("x.place.end")).alias("end"), F.col("x.path").alias("path"))


def reference_counts(docs: DataFrame, key: str, content: str, pattern: str = P.IMAGE_REF) -> DataFrame:
    """[A13, W8] References of each document, all and distinct, documents without one included."""
    refs = T.image_refs(content, pattern)
    return docs.select(key, F.coalesce(F.size(refs), F.lit(0)).cast("long").alias("refs"), F.coalesce(F.size(F.array_distinct(refs)), F.lit(0)).cast("long").alias("distinct_refs"))


def reference_total(docs: DataFrame, content: str, pattern: str = P.IMAGE_REF) -> DataFrame:
    """[A12]"""
    return docs.agg(F.coalesce(F.sum(F.size(T.image_refs(content, pattern))), F.lit(0)).alias("refs"))


def spliced_documents(docs: DataFrame, key: str, content: str, results: DataFrame) -> DataFrame:
    """[F21, K6] Documents with the results(key, start, end, path, result) in their places; those without any stay as they are."""
    reps = results.groupBy(key).agg(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "path", "result")).alias("_reps"))
    joined = docs.join(reps, key, "left")  # a document's references are as many as it has
    return joined.withColumn(content, F.when(F.col("_reps").isNull(), F.col(content)).otherwise(T.spliced(content, "_reps"))).drop("_reps")
