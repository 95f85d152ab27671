"""Site-relative line dedup, with DataFrame functions only.

A line is boilerplate on a host if the host's pages that contain it, divided by
the host's page total, exceed ``ratio``, and if it is on ``min_pages`` pages at
least. Pages with the same text count once (a page that was fetched again is the
same page; without this, a large group of copies would make its own content
boilerplate). Lines are compared without the white space around them.

Defined cases: a null text stays null and holds no lines; an empty text stays
empty; blank lines are never dropped; a null host and an empty one are the same
host; repeated rows are all returned; an empty table gives an empty table; input
columns named like an output column are replaced; a line that exactly meets the
ratio stays.

Scale: pass one counts 64-bit hashes of lines, so what is shuffled is 24 bytes for
a distinct line of a page, after a map-side combine, and a line that is on a
third of all pages is first spread by page. Pass two counts the real lines of the
few hashes that are over the ratio. The surviving set holds at most
(mean distinct lines of a page) / ratio lines for each host; it is broadcast only
if its measured size is below ``BROADCAST_BYTES``, and else joined by host, which
adaptive execution splits where a host is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, unused

RATIO = 0.03
MIN_PAGES = 5
BROADCAST_BYTES = 8 << 20


def _trimmed(text: Column) -> Column:
    return F.transform(F.split(text, "\n", -1), lambda x: F.trim(x, F.lit(" \t\r")))


def _exploded(docs: DataFrame, text: str, host: str) -> DataFrame:
    """One row for each page and distinct line that isn't blank: _host, _page, _line."""
    return docs.where(F.col(text).isNotNull()).select(
        F.coalesce(F.col(host), F.lit("")).alias("_host"),
        F.xxhash64(text).alias("_page"),
        F.explode(F.array_distinct(F.filter(_trimmed(F.col(text)), lambda x: x != ""))).alias("_line"),
    )


def boilerplate(docs: DataFrame, text: str = "text", host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """The boilerplate lines: host, line, pages with the line, pages of the host."""
    totals = (
        docs.where(F.col(text).isNotNull())
        .select(F.coalesce(F.col(host), F.lit("")).alias("_host"), F.xxhash64(text).alias("_page"))
        .groupBy("_host").agg(F.countDistinct("_page").alias("_total"))
    )
    lines = _exploded(docs, text, host)
    over = (F.col("_n") >= min_pages) & (F.col("_n") > F.lit(ratio) * F.col("_total"))
    # Pass one: no line's own count exceeds that of its hash.
    maybe = (
        lines.select("_host", "_page", F.xxhash64("_line").alias("_hash"))
        .groupBy("_host", "_hash").agg(F.countDistinct("_page").alias("_n"))
        .where(F.col("_n") >= min_pages)
        .join(totals, "_host").where(over).select("_host", "_hash", "_total")
    )
    maybe = stored(maybe, "line-hashes")
    # Pass two: the lines themselves.
    return (
        lines.withColumn("_hash", F.xxhash64("_line"))
        .join(maybe, ["_host", "_hash"])
        .groupBy("_host", "_line").agg(F.countDistinct("_page").alias("_n"), F.max("_total").alias("_total"))
        .where(over)
        .select(F.col("_host").alias("host"), F.col("_line").alias("line"), F.col("_n").alias("pages"), F.col("_total").alias("host_pages"))
    )


def drop_lines(docs: DataFrame, text: str = "text", host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES, counts: bool = True) -> DataFrame:
    """All rows of docs with boilerplate lines cut from their text; counts adds n_lines and n_dropped."""
    names = unused(docs, "host", "bad", "own", "kept")
    own_host, bad, own, kept = names
    found = boilerplate(docs, text, host, ratio, min_pages)
    found = stored(found.groupBy(F.col("host").alias(own_host)).agg(F.collect_set("line").alias(bad)), "boilerplate")
    size = found.agg(F.sum(F.expr(f"aggregate({bad}, 0L, (s, x) -> s + octet_length(x) + 16L)"))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        found = F.broadcast(found)
    given = [c for c in docs.columns if not counts or c.lower() not in ("n_lines", "n_dropped") or c in (text, host)]
    joined = docs.select(*[f"`{c}`" for c in given], F.coalesce(F.col(f"`{host}`"), F.lit("")).alias(own_host)).join(found, own_host, "left")
    # The page's own boilerplate lines, by a hash set of the host's; the page's lines are compared with these few.
    joined = joined.withColumn(own, F.array_intersect(_trimmed(F.col(f"`{text}`")), bad))
    lines = F.split(F.col(f"`{text}`"), "\n", -1)
    rest = F.filter(lines, lambda x: ~F.array_contains(F.col(own), F.trim(x, F.lit(" \t\r"))))
    joined = joined.withColumn(kept, F.when(F.size(own) > 0, rest))
    cut = {text: F.when(F.col(kept).isNull(), F.col(f"`{text}`")).otherwise(F.array_join(kept, "\n"))}
    n = F.when(F.col(f"`{text}`").isNull(), F.lit(0)).otherwise(F.size(lines))
    if counts:
        cut |= {"n_lines": n.cast("long"), "n_dropped": F.when(F.col(kept).isNull(), F.lit(0)).otherwise(n - F.size(kept)).cast("long")}
    return joined.withColumns(cut).drop(*names)
