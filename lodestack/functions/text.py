"""Scalar functions over log lines, keys, paths and results; every one is a Column of built-in functions.

"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _or(x: Column, default: str) -> Column:
    """default where x is empty or null."""
    return F.coalesce(F.nullif(x, F.lit("")), F.lit(default))


def running_sum(xs: str | Column) -> Column:
    """Sums of an array's numbers up to each: every round adds the sum that ends 1, 2, 4, ... places before, so no array is grown one by one."""
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(xs), F.lit(1)))).cast("int"))
    before = lambda acc, k: F.slice(F.concat(F.array_repeat(F.lit(0).cast("long"), F.pow(F.lit(2), k).cast("int")), acc), F.lit(1), F.size(acc))
    return F.aggregate(rounds, F.transform(_c(xs), lambda x: x.cast("long")), lambda acc, k: F.zip_with(before(acc, k), acc, lambda x, y: x + y))


# Log lines


def log_time(line: str | Column) -> Column:
    """The HH:MM:SS prefix; null if the line has none and so is no log line."""
    return F.nullif(F.regexp_extract(_c(line), P.TIMESTAMP, 1), F.lit(""))


def log_thread(line: str | Column) -> Column:
    """Digits of the first [T..] anywhere, as they are written; "0" without one."""
    return _or(F.regexp_extract(_c(line), P.THREAD, 1), "0")


def log_content(line: str | Column) -> Column:
    """What follows the time, without one leading space and without trailing white space."""
    return right_trimmed(F.regexp_replace(_c(line), r"(?d)^\[\d{2}:\d{2}:\d{2}\] ?", ""))


def started_key(line: str | Column) -> Column:
    """Key of a START line, else null."""
    return F.nullif(F.regexp_extract(_c(line), P.START, 1), F.lit(""))


def done(line: str | Column) -> Column:
    """struct(elapsed, img_type) of a DONE line, else null."""
    x = _c(line)
    return F.when(x.rlike(P.DONE), F.struct(number_or_zero(F.regexp_extract(x, P.DONE, 1)).alias("elapsed"), F.nullif(F.regexp_extract(x, P.DONE, 2), F.lit("")).alias("img_type")))


def failed(line: str | Column) -> Column:
    """struct(elapsed, message) of a FAILED line, else null."""
    x = _c(line)
    return F.when(x.rlike(P.FAILED), F.struct(number_or_zero(F.regexp_extract(x, P.FAILED, 1)).alias("elapsed"), F.regexp_extract(x, P.FAILED, 2).alias("message")))


def tagged(line: str | Column, *tags: str) -> Column:
    """Whether one of the tags is in the line."""
    found = F.lit(False)
    for tag in tags:
        found = found | F.contains(_c(line), F.lit(tag))
    return found


def error_class(message: str | Column) -> Column:
    """[F8] The first of the error classes that matches, else "unknown"."""
    out = None
    for name, pattern in P.ERROR_CLASSES:
        test = _c(message).rlike(f"(?di){pattern}")
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("unknown")


def right_trimmed(x: str | Column) -> Column:
    """Without trailing spaces, tabs and line ends."""
    return F.rtrim(_c(x), F.lit(" \t\r\n"))


def number_or_zero(x: str | Column) -> Column:
    """A number, 0 if it can't be read."""
    return F.coalesce(_c(x).try_cast("double"), F.lit(0.0))


def seconds_of_day(x: str | Column) -> Column:
    """HH:MM:SS as seconds; null if it is no time of day."""
    t = F.try_to_timestamp(_c(x), F.lit("HH:mm:ss"))
    return (F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)).cast("double")


def micros(x: str | Column) -> Column:
    """Microseconds since 1970 of a timestamp without a zone, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), _c(x).cast("timestamp_ntz"))


def split_thread(line: str | Column) -> Column:
    """The T.. of a line's second bracket, "T00" without one."""
    return _or(F.regexp_extract(_c(line), P.SPLIT_THREAD, 1), "T00")


def without_prefix(line: str | Column) -> Column:
    """The line without its time and thread."""
    return F.regexp_replace(_c(line), P.PREFIX, "")


def header_path(line: str | Column) -> Column:
    """Image path of an [N/M] header line, else null."""
    return F.nullif(F.regexp_extract(_c(line), P.HEADER, 1), F.lit(""))


# Keys, names and paths


def image_refs(content: str | Column, pattern: str = P.IMAGE_REF) -> Column:
    """Paths of all Markdown image references, in order, repeats included."""
    return F.regexp_extract_all(_c(content), F.lit(pattern), F.lit(1))


def part_of(name: str | Column) -> Column:
    """struct(subject, part) of ``<subject>_part<n>``; other names are a subject without a part."""
    x = _c(name)
    part = F.regexp_extract(x, P.PART_NAME, 2).try_cast("long")
    return F.struct(F.when(part.isNull(), x).otherwise(F.regexp_extract(x, P.PART_NAME, 1)).alias("subject"), part.alias("part"))


def valid_result(result: str | Column) -> Column:
    """[F16] A result with a type tag that isn't the sentinel of an invalid response; null is invalid."""
    x = _c(result)
    return F.coalesce(F.contains(x, F.lit(P.TYPE_TAG)) & (x != P.INVALID_RESPONSE), F.lit(False))


def safe_name(path: str | Column) -> Column:
    """The file name a path's item is kept under."""
    return F.concat(F.translate(_c(path), "/\\", "__"), F.lit(".json"))


def stem(path: str | Column) -> Column:
    """Base name without its last extension."""
    return F.regexp_replace(F.element_at(F.split(_c(path), "/"), -1), r"\.[^.]*$", "")


def key_of(document: str | Column, path: str | Column) -> Column:
    """document::path."""
    return F.concat_ws("::", _c(document), _c(path))


def key_parts(key: str | Column) -> Column:
    """struct(document, path) of a key, split at the first ``::``; null without one."""
    x = F.split(_c(key), "::", 2)
    return F.when(F.size(x) == 2, F.struct(x[0].alias("document"), x[1].alias("path")))


def line_index(content: str | Column, offset: str | Column) -> Column:
    """Number, from 0, of the line that holds a code-point offset."""
    before = F.substring(_c(content), F.lit(1), _c(offset).cast("int"))
    return F.size(F.split(before, "\n", -1)) - 1


#: Code points in a block, the unit in which a spliced text is looked up.
BLOCK = 256


def spliced(content: str | Column, replacements: str | Column) -> Column:
    """[F21, T6] Puts a description block in place of each replacement(start, end, path, result); they don't overlap.

    The text between two replacements is taken once, so nothing is copied again for each of them. It is taken from blocks of the
    text: substring counts code points from the beginning of what it is given, which is the whole text for each replacement.
    """
    reps = F.sort_array(_c(replacements))
    block = lambda r: F.concat(F.lit("\n\n<!-- IMG: "), r["path"], F.lit(" -->\n[AI] "), r["result"], F.lit("\n\n<!-- /IMG -->\n\n"))
    ends = F.concat(F.array(F.lit(0)), F.transform(reps, lambda r: r["end"]))
    number = lambda at: F.floor(at / BLOCK).cast("int")

    def taken(blocks: Column, end: Column, n: Column, size: Column) -> Column:
        return F.substring(F.array_join(F.slice(blocks, number(end) + 1, F.greatest(n, F.lit(0))), ""), end % BLOCK + 1, size)

    def put(blocks: Column, end: Column, r: Column) -> Column:
        rest = taken(blocks, end, F.size(blocks), F.size(blocks) * BLOCK)
        return F.when(r.isNull(), rest).otherwise(F.concat(taken(blocks, end, number(r["start"] - 1) - number(end) + 1, r["start"] - end), block(r)))

    # an array of one: its element is made once for all replacements
    whole = F.array(F.regexp_extract_all(_c(content), F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)))
    return F.transform(whole, lambda blocks: F.array_join(F.zip_with(ends, reps, lambda end, r: put(blocks, end, r)), ""))[0]


def rewritten_paths(content: str | Column, subject: str | Column, pattern: str = P.IMAGE_REF, folder: str = "images/") -> Column:
    """Every ``images/`` gets the subject's folder, if the document has a reference at all."""
    x = _c(content)
    return F.when(x.rlike(pattern), F.replace(x, F.lit(folder), F.concat(F.lit(folder), _c(subject), F.lit("/")))).otherwise(x)


def short_key(key: str | Column, most: int = 50) -> Column:
    """What follows the last ``::``, cut to ``most`` characters."""
    return F.left(F.substring_index(_c(key), "::", -1), F.lit(most))


def preview(x: str | Column, most: int) -> Column:
    """At most ``most`` characters, and ... where something is cut off."""
    return F.when(F.length(_c(x)) > most, F.concat(F.left(_c(x), F.lit(most)), F.lit("..."))).otherwise(_c(x))


def image_file(path: str | Column) -> Column:
    """A path without what stands before its first slash."""
    return F.regexp_replace(_c(path), r"^[^/]*/", "")


def supported(path: str | Column) -> Column:
    """[S25] Whether a file has one of the formats that can be parsed."""
    return F.lower(F.regexp_extract(_c(path), r"\.([^./]*)$", 1)).isin(*P.SUPPORTED)


def padded_thread(thread: str | Column, concurrency: int, most: int = 2) -> Column:
    """A thread number filled up with zeros to the digits of the concurrency, two at least."""
    x, width = _c(thread).cast("string"), max(most, len(str(concurrency)))
    return F.when(F.length(x) >= width, x).otherwise(F.lpad(x, width, "0"))


def label(state: str | Column, labels: Iterable[tuple[str, str]] = P.STATE_LABELS) -> Column:
    """A state's label, itself if it has none."""
    out = F.lit(None).cast("string")
    for name, said in labels:
        out = F.when(_c(state) == name, said).otherwise(out)
    return F.coalesce(out, _c(state))


# Numbers


def percent(part: str | Column, whole: str | Column, scale: float = 100.0) -> Column:
    """[F32] part / whole in percent, 0 if the whole is not positive."""
    return F.when(_c(whole) > 0, _c(part) / _c(whole) * scale).otherwise(0.0)


def megabytes(size: str | Column) -> Column:
    """[F33]"""
    return F.round(_c(size) / (1 << 20), 1)


def kilobytes(size: str | Column) -> Column:
    """[F33]"""
    return F.round(_c(size) / 1024, 1)


def estimated_pages(paragraphs: str | Column, each: int = 10) -> Column:
    """Pages for a number of paragraphs, rounded up, at least 1 if there are any."""
    return F.ceil(_c(paragraphs) / each).cast("long")


def paragraph_count(elements: str | Column) -> Column:
    """[A20] Paragraphs among a document's elements(is_paragraph)."""
    return F.size(F.filter(_c(elements), lambda e: e["is_paragraph"]))


def resized(width: str | Column, height: str | Column, most: int = 1280) -> Column:
    """struct(width, height) whose longest side is ``most`` at most, at least one pixel each."""
    w, h = _c(width), _c(height)
    ratio = F.least(F.lit(1.0), F.lit(float(most)) / w, F.lit(float(most)) / h)
    side = lambda x: F.greatest(F.lit(1), F.floor(x * ratio)).cast("long")
    return F.struct(side(w).alias("width"), side(h).alias("height"))


def percentile_list(said: str | Column) -> Column:
    """[F36, U7] Percentiles of a comma-separated list, 1 to 99, in their order and once each."""
    each = F.transform(F.split(_c(said), ","), lambda x: F.trim(x).try_cast("int"))
    return F.array_distinct(F.filter(each, lambda x: x.between(1, 99)))
