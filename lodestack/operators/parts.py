
from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..functions.text import _c

if TYPE_CHECKING:
    import pyarrow as pa


def part_starts(sizes: str | Column, max_pages: int, max_size: float) -> Column:
    """[O1, O2] The pages, from 0, at which the parts of an array of page sizes begin.

    A part takes pages as long as it has at most max_pages and stays within max_size; a page that is too large is a part
    of its own; a max_size of 0 or less limits pages only. Only a new part adds to the state, not each page.
    """
    zero = F.struct(F.lit(0).alias("page"), F.lit(0).alias("pages"), F.lit(0.0).alias("size"), F.array().cast("array<int>").alias("starts"))

    def step(s: Column, x: Column) -> Column:
        x = F.coalesce(x.cast("double"), F.lit(0.0))
        full = (s["page"] == 0) | (s["pages"] >= max_pages)
        if max_size > 0:
            full = full | (s["size"] + x > max_size)
        return F.struct(
            (s["page"] + 1).alias("page"), F.when(full, 1).otherwise(s["pages"] + 1).alias("pages"),
            F.when(full, x).otherwise(s["size"] + x).alias("size"), F.when(full, F.concat(s["starts"], F.array(s["page"]))).otherwise(s["starts"]).alias("starts"),
        )

    return F.aggregate(_c(sizes), zero, step, lambda s: s["starts"])


def greedy_parts(docs: DataFrame, key: str, sizes: str | Column, max_pages: int, max_size: float) -> DataFrame:
    """[O1 to O3] Parts of each document: key, part, first_page, pages, size. A document's pages stay in its row, so only rows of parts go on."""
    cut = docs.select(key, _c(sizes).alias("_sizes")).withColumn("_starts", part_starts("_sizes", max_pages, max_size))
    # without pages there is no part, and so no end
    ends = F.slice(F.concat(F.slice("_starts", F.lit(2), F.greatest(F.size("_starts") - 1, F.lit(0))), F.array(F.size("_sizes"))), F.lit(1), F.size("_starts"))
    flat = cut.select(key, "_sizes", F.posexplode(F.zip_with("_starts", ends, lambda a, z: F.struct(a.alias("first"), (z - a).alias("pages")))).alias("part", "x"))
    total = F.aggregate(F.slice("_sizes", F.col("x.first") + 1, F.col("x.pages")), F.lit(0).cast("double"), lambda acc, v: acc + F.coalesce(v, F.lit(0)))
    kind = cut.schema["_sizes"].dataType.elementType.simpleString()
    return flat.select(key, (F.col("part") + 1).cast("long").alias("part"), (F.col("x.first") + 1).cast("long").alias("first_page"), F.col("x.pages").cast("long").alias("pages"), total.cast("double" if kind in ("double", "float") else "long").alias("size"))


def longest_run(size: Callable[[int], float], most: int, max_size: float) -> int:
    """[O3] The largest n of 1 to ``most`` with size(n) <= max_size, 1 if there is none. size must not fall as n grows.

    Doubles n until it is too much and halves the rest, so size is asked some 2 log2(n) times.
    """
    good, step = 1, 1
    if size(1) > max_size:
        return 1
    while good < most:
        n = min(most, good + step)
        if size(n) > max_size:
            bad = n
            break
        good, step = n, step * 2
    else:
        return good
    while bad - good > 1:
        n = (good + bad) // 2
        good, bad = (n, bad) if size(n) <= max_size else (good, n)
    return good


class _Cutter:
    """The pages of one document that aren't in a part yet, and how many parts there are."""

    def __init__(self, key: tuple, measure: Callable[[list[bytes]], float], max_pages: int, max_size: float):
        self.key, self.measure, self.max_pages, self.max_size = key, measure, max_pages, max_size
        self.held: list[bytes] = []
        self.first, self.parts = 1, 0

    def cut(self, ended: bool) -> Iterator[tuple]:
        """Parts that no later page can change."""
        while self.held and (ended or len(self.held) >= self.max_pages):
            sizes: dict[int, float] = {}

            def size(n: int, sizes: dict[int, float] = sizes) -> float:
                if n not in sizes:
                    sizes[n] = self.measure(self.held[:n])
                return sizes[n]

            n = longest_run(size, min(self.max_pages, len(self.held)), self.max_size) if self.max_size > 0 else min(self.max_pages, len(self.held))
            self.parts += 1
            yield (*self.key, self.parts, self.first, n, float(size(n)))
            self.first, self.held = self.first + n, self.held[n:]


def measured_parts(pages: DataFrame, key: str, page: str, content: str, measure: Callable[[list[bytes]], float], max_pages: int = 200, max_size: float = 0.0) -> DataFrame:
    """[O1, O3] key, part, first_page, pages, size of pages(key, page, content binary): parts as long as they may be, by what they measure together.

    measure gives the size of a part of these pages, for instance that of its compressed bytes; it needn't be a sum, but
    must not fall as pages are added. A page that is too large alone is a part; a max_size of 0 or less limits pages only; a
    null page is empty; the order of pages with the same number is open. A document's pages pass by sorted, and max_pages of
    them are held.
    """
    base = pages.select(key, page, F.coalesce(F.col(content).cast("binary"), F.lit(b"")).alias("_content"))
    dealt = base.repartition(key).sortWithinPartitions(key, page).select(key, "_content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        now: _Cutter | None = None
        kind = None

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            types = [kind, pa.int64(), pa.int64(), pa.int64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], [key, "part", "first_page", "pages", "size"])

        for b in batches:
            kind, out = b.column(0).type, []
            for k, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if now is None or now.key != (k,):
                    out += now.cut(True) if now else []
                    now = _Cutter((k,), measure, max_pages, max_size)
                now.held.append(raw)
                out += now.cut(False)
            yield batch(out)
        if now:
            yield batch(list(now.cut(True)))

    names = StructType([dealt.schema.fields[0], *[StructField(n, LongType()) for n in ("part", "first_page", "pages")], StructField("size", DoubleType())])
    return dealt.mapInArrow(run, names)


def compressed_size(pages: list[bytes]) -> float:
    """[O3] Bytes of the pages in one compressed file."""
    import zlib

    return float(len(zlib.compress(b"".join(pages), 6)))


def already_split(sources: DataFrame, parts: DataFrame, key: str = "key", pages: str = "pages") -> DataFrame:
    """[J10] Sources whose parts' pages sum up to their own."""
    have = parts.groupBy(key).agg(F.sum(pages).alias("_have"))
    return sources.join(have, key).where(F.col("_have") == F.col(pages)).drop("_have")


def route(pages: str | Column, max_pages: int = 200) -> Column:
    """[O4] Office files with few known pages stay as they are, others are converted first: parsers count more pages."""
    return F.when((_c(pages) > 0) & (_c(pages) <= max_pages // 2), "keep").otherwise("convert")


def to_split(files: DataFrame, path: str = "path") -> DataFrame:
    """[O5] Files to split, by kind, hidden ones left out: PDF first, then DOCX, each by name."""
    name = F.element_at(F.split(path, "/"), -1)
    kind = F.when(F.lower(name).endswith(".pdf"), "pdf").when(F.lower(name).endswith(".docx"), "docx")
    return files.withColumn("kind", kind).where(kind.isNotNull() & ~name.startswith(".")).orderBy(F.desc("kind"), path)
