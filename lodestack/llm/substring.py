"""Repeated passages: paragraph MinHash banding, and runs of words wherever lines break.

A paragraph is a line of at least ``MIN_WORDS`` words. Its signature has
``PERMUTATIONS`` minima of its ``WORDS``-word shingles. Paragraphs that agree in a
whole band collide; the number of rows in a band is the largest whose recall at the
similarity in question is at least ``RECALL``. Colliding paragraphs whose signatures
agree well enough are confirmed by exact Jaccard on full shingle sets; components of
confirmed links are groups of which one paragraph stays, the first by doc_id and
place.

A run is more than ``MIN_WORDS`` words in a row that occur word for word in another
place, wherever lines begin and end; words are those of ``neardup.shingles``. Texts are
marked by winnowing: of every window of neighbouring word grams, as many as a shortest
run has, the one with the least hash is a mark. Two copies of a run share a mark for
certain, so only windows of words with shared marks are grouped, by 64-bit hashes, and
neighbouring windows of one mark go together where they can. Of equal windows the first
by doc_id and place stays; neighbouring windows with the same first document are one
passage. What a paragraph's row says already isn't listed again, and links chain: the
first holder of a run may lie in a paragraph that goes for a similar one.

Defined cases: a null or empty text has no paragraphs; paragraphs with the same
words are one class and linked; a paragraph that repeats within a document counts like
one across documents; rows without a doc_id take no part (``cut_repeats`` keeps them);
doc_ids are taken to be unique, and of repeated rows every one is cut alike; an empty
table gives an empty table; extra columns are not read; a doc_id of repeated rows is
listed once for each row by paragraphs, and once by runs; passages of one document may
overlap where parts of a text have different first holders; words that belong to a
passage that stays are not cut.

Scale: texts stay where they are read; what moves is a signature for each distinct
paragraph. Long lists of colliding paragraphs are resolved through centres and
components, not by all their pairs. Of runs, a mark for some 18 words moves, and where
the holders of a mark differ a hash for each window of each different surrounding.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import neardup
from .common import kept_for, ship, stored, text_of, unused
from .components import components

WORDS, SIMILARITY, MIN_WORDS = 5, 0.8, 50
PERMUTATIONS, RECALL = 48, 0.9999
#: Texts are laid out as arrays of words so many bytes at a time.
PART_BYTES = 1 << 20


def tuned(similarity: float, permutations: int = PERMUTATIONS, recall: float = RECALL) -> tuple[int, int]:
    """(bands, rows) with the most rows a band whose chance to collide at this similarity reaches the recall."""
    fits = [r for r in range(1, permutations + 1) if 1 - (1 - similarity**r) ** (permutations // r) >= recall]
    rows = max(fits, default=1)
    return permutations // rows, rows


def _multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(5).integers(1, 1 << 31, (2, n), dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def signatures(shingles: np.ndarray, first: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """The minima of each permutation over the upper halves of the hashes from each first one up to the next."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(first), multipliers.shape[1]), dtype=np.uint32)
    ends, at = np.append(first, len(x))[1:], 0
    while at < len(first):  # as many sets at once as stay in the processor's cache
        last = max(at + 1, int(np.searchsorted(ends, first[at] + 32768, "right")))
        part, cuts = x[first[at] : ends[last - 1]], first[at:last] - first[at]
        for k, (a, b) in enumerate(multipliers.T):
            out[at:last, k] = np.minimum.reduceat(part * a + b, cuts)
        at = last
    return out.view(np.int32)


def _lists(values: np.ndarray):
    """An Arrow array of the rows of a table, as lists."""
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), pa.array(values.ravel()))


def paragraphs(docs: DataFrame, words: int, min_words: int, key: str, text: str, permutations: int = PERMUTATIONS) -> DataFrame:
    """Paragraphs of at least min_words words: doc_id, paragraph (line number), start, end, n_words, n (shingles), d1, d2 (a digest of its words), signature.

    A shingle has ``words`` words, or min_words if those are fewer.
    """
    ship(docs.sparkSession)
    width = min(words, min_words)

    def run(batches):
        import pyarrow as pa
        import xxhash

        by, digest = _multipliers(permutations), xxhash.xxh3_128_digest
        kept_for("paragraphs")
        for b in _parts(batches):
            held, made, digests = [], [], []
            for doc, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                at = 0
                for number, line in enumerate(t.split("\n")):
                    if len(line) >= 2 * min_words - 1:
                        found = line.encode("utf-8", "surrogatepass").translate(neardup._LOWER).split()
                        if len(found) >= min_words:
                            held += found
                            made.append((doc, number, at, at + len(line), len(found)))
                            digests.append(digest(b" ".join(found)))
                    at += len(line) + 1
            table = np.array(made, dtype=np.int64).reshape(-1, 5)
            sizes = table[:, 4]
            x = _joined_n(_hashed(held), width)
            # shingles within one line, and how many of them are different
            place = np.arange(len(x))
            line = np.repeat(np.arange(len(sizes)), sizes)[: len(x)]
            inside = place + width <= np.cumsum(sizes)[line]
            x, line = x[inside], line[inside]
            first = np.flatnonzero(np.r_[True, line[1:] != line[:-1]]) if len(line) else line
            bits = np.uint64(max(1, int(len(sizes)).bit_length()))
            in_order = np.sort((line.astype(np.uint64) << (np.uint64(64) - bits)) | (x >> bits))
            new = np.r_[True, in_order[1:] != in_order[:-1]] if len(in_order) else np.empty(0, dtype=bool)
            n = np.add.reduceat(new.astype(np.int64), first) if len(first) else first
            d = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            columns = [*(pa.array(c) for c in table.T), pa.array(n.astype(np.int64)), *(pa.array(np.ascontiguousarray(c)) for c in d.T), _lists(signatures(x, first, by))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "paragraph", "start", "end", "n_words", "n", "d1", "d2", "signature"])

    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc_id"), text_of(text).alias("text"))
    schema = "doc_id long, paragraph long, start long, `end` long, n_words long, n long, d1 long, d2 long, signature array<int>"
    return rows.mapInArrow(run, schema)


def repeated_paragraphs(docs: DataFrame, words: int, similarity: float, min_words: int, key: str, text: str) -> DataFrame:
    """Paragraphs that repeat: doc_id, paragraph, start, end, n_words, first_doc_id and first_paragraph of the group, kept."""
    all_ = stored(paragraphs(docs, words, min_words, key, text), "paragraphs")
    # A class of equal words goes by one half of its digest; both halves name it among paragraphs.
    place = F.struct("doc_id", "paragraph")
    classes = all_.groupBy("d1", "d2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("size"))
    classes = stored(classes.select(F.col("d1").alias("node"), "d2", "first", "size"), "classes")
    firsts = classes.select("node", "d2", F.col("first.doc_id").alias("doc_id"), F.col("first.paragraph").alias("paragraph"))
    full = all_.join(firsts, ["doc_id", "paragraph"]).where("d1 = node").select("node", F.col("n"), "signature").dropDuplicates(["node"])
    full = stored(full, "signatures")
    bands, rows = tuned(similarity)
    band = F.array(*[F.xxhash64(F.lit(k), F.slice("signature", k * rows + 1, rows)) for k in range(bands)])
    held = full.select(F.explode(band).alias("value"), "node", "n")
    lists = neardup.inverted(held)

    agree = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda e: e))
    floor = similarity - neardup.SIGMAS * (similarity * (1 - similarity) / PERMUTATIONS) ** 0.5

    def screen(pairs: DataFrame) -> DataFrame:
        of = lambda end: full.select(F.col("node").alias(end), F.col("signature").alias(f"s{end}"))
        return pairs.join(of("a"), "a").join(of("b"), "b").where(agree >= F.lit(floor * PERMUTATIONS)).select("a", "b", F.lit(False).alias("_whole"))

    def texts(ends: DataFrame) -> DataFrame:
        wanted = stored(firsts.drop("d2").join(ends, "node", "left_semi"), "wanted")
        wanted = neardup.bounded(wanted)
        lines = docs.select(F.col(key).cast("long").alias("doc_id"), text_of(text).alias("text")).join(wanted, "doc_id")
        return lines.select("node", F.element_at(F.split("text", "\n", -1), (F.col("paragraph") + 1).cast("int")).alias("text"))

    groups = components(neardup.links(lists, screen, texts, words, similarity))
    named = classes.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    whole = named.groupBy("component").agg(F.min("first").alias("first"), F.sum("size").alias("size")).where("size > 1")
    labels = named.drop("first", "size").join(whole, "component").select(F.col("node").alias("d1"), "d2", "first")
    out = all_.drop("signature").join(labels, ["d1", "d2"])
    kept = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("paragraph") == F.col("first.paragraph"))
    return out.select("doc_id", "paragraph", "start", "end", "n_words", F.col("first.doc_id").alias("first_doc_id"), F.col("first.paragraph").alias("first_paragraph"), kept.alias("kept"))


def _hashed(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word."""
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def _joined(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    out = x * np.uint64(0x9E3779B97F4A7C15) + y
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def grams(x: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n neighbours of x, put together from blocks of 1, 2, 4 and more."""
    if len(x) < n:
        return x[:0]
    out, size, block, length = None, 0, x, 1
    while True:
        if n & length:
            out = block if out is None else _joined(out[: len(x) - size - length + 1], block[size:])
            size += length
        if 2 * length > n:
            return out
        block, length = _joined(block[:-length], block[length:]), 2 * length


def _joined_n(x: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n neighbours of x, one after the other."""
    if len(x) < n:
        return x[:0]
    out = x[: len(x) - n + 1]
    for k in range(1, n):
        out = _joined(out, x[k : len(x) - n + 1 + k])
    return out


def _least(g: np.ndarray, wide: int) -> np.ndarray:
    """The place of the least of every ``wide`` neighbours, counted from the first of them; argmin copies its windows, so a few at a time."""
    view = np.lib.stride_tricks.sliding_window_view(g, wide)
    return np.concatenate([view[k : k + 8192].argmin(axis=1) for k in range(0, len(view), 8192)])


def blocks(x: np.ndarray, sizes: np.ndarray, run: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, number, mark, block) of neighbouring windows of run words with the same least gram, the mark; block is a hash of all their words.

    x are the words of texts of these sizes in a row; windows lie within one text.
    """
    none = (np.empty(0, dtype=np.int64),) * 4
    h, g, wide = grams(x, run), grams(x, gram), run - gram + 1
    if not len(h):
        return none
    s = np.flatnonzero(np.repeat(np.cumsum(sizes), sizes)[: len(h)] - np.arange(len(h)) >= run)
    if not len(s):
        return none
    at = _least(g, wide)[s] + s
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    n = np.diff(np.r_[first, len(s)])
    begin, mark = s[first], g[at[first]]
    # Two windows with the same gram overlap, so the first and the last one hold all words.
    block = _joined(_joined(h[begin], h[begin + n - 1]), mark + n.astype(np.uint64))
    return begin, n, mark.view(np.int64), block.view(np.int64)


class Laid:
    """Words of texts in a row: sizes (words of each text), base (words before each text), line (a word's line number in its text)."""

    def __init__(self, texts: list[bytes]):
        self.raw = b"\n".join(texts)
        self.codes = codes = np.frombuffer(self.raw, np.uint8)
        blank = (codes == 32) | ((codes >= 9) & (codes <= 13))
        turns = np.flatnonzero(np.diff(np.r_[True, blank, True]))
        self.start, self.end = turns[::2], turns[1::2]
        self.offset = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
        self.base = np.searchsorted(self.start, self.offset)
        self.sizes = np.diff(np.r_[self.base, len(self.start)])
        breaks = np.flatnonzero(codes == 10)
        self.line = np.searchsorted(breaks, self.start) - np.repeat(np.searchsorted(breaks, self.offset), self.sizes)

    def hashes(self) -> np.ndarray:
        return _hashed(self.raw.translate(neardup._LOWER).split())

    def spans(self, first: np.ndarray, last: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code points in its text at which the first word begins and the last one ends."""
        before = np.r_[0, np.cumsum((self.codes & 0xC0) == 0x80)]  # bytes that go on a character
        zero = self.offset[text] - before[self.offset[text]]
        return self.start[first] - before[self.start[first]] - zero, self.end[last] - before[self.end[last]] - zero


def _parts(batches):
    """Batches, cut so that a part has about PART_BYTES of text at most, or one document."""
    import pyarrow.compute as pc

    for b in batches:
        ends, at = np.cumsum(pc.binary_length(b.column("text")).to_numpy(zero_copy_only=False), dtype=np.int64), 0
        while at < len(ends):
            last = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PART_BYTES, "right")))
            yield b.slice(at, last - at)
            at = last


def _entries(column, *names: str) -> tuple[np.ndarray, ...]:
    """For a column of lists of structs: the row of each entry, and the entries' fields."""
    import pyarrow.compute as pc

    flat = column.flatten()
    counts = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(column)), counts), *(flat.field(n).to_numpy(zero_copy_only=False) for n in names)


def _spread(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For entries of n places each: the entry and the number of every place."""
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)


def _batch(schema: str, columns: list[np.ndarray]):
    import pyarrow as pa

    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    fields = [f.replace("`", "").split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c.astype(kinds[kind].to_pandas_dtype())) for c, (_, kind) in zip(columns, fields)], [n for n, _ in fields])


def _at(rows: DataFrame, by_doc: DataFrame, column: str) -> DataFrame:
    """rows(doc_id, text) with what by_doc holds for each document, broadcast if its lists have few entries."""
    by_doc = stored(by_doc, "by-document")
    few = (by_doc.agg(F.sum(F.size(column) + 1)).first()[0] or 0) <= neardup.BROADCAST_ROWS
    return rows.join(F.broadcast(by_doc) if few else by_doc, "doc_id")


def equal_windows(rows: DataFrame, run: int) -> DataFrame:
    """Ranges of equal windows of run words: doc_id, at, to (the first and last window's word), first_doc_id, first_at, first_line.

    Copies agree in whole blocks but for their ends: blocks are classes, and only one of each class is looked at window by
    window, if its mark has other classes too.
    """
    gram = max(1, run // 3)

    marked = "doc_id long, at int, n int, line int, mark long, block long"

    def mark(batches):
        kept_for("passages")
        for b in _parts(batches):
            ids, laid = b.column("doc_id").to_numpy(), Laid(b.column("text").to_pylist())
            at, n, m, block = blocks(laid.hashes(), laid.sizes, run, gram)
            text = np.searchsorted(laid.base, at, "right") - 1
            yield _batch(marked, [ids[text], at - laid.base[text], n, laid.line[at], m, block])

    marks = stored(rows.mapInArrow(mark, marked), "marks")
    # A table of its own: both sides of the join come straight from a shuffle, so that a very common mark can be split.
    shared = stored(marks.groupBy("mark").agg(F.count(F.lit(1)).alias("_df")).where("_df > 1").drop("_df"), "marks")
    hits = stored(marks.join(shared, "mark"), "hits", instead_of=marks)
    classes = hits.groupBy("block").agg(F.min("mark").alias("mark"), F.min(F.struct("doc_id", "at", "line", "n")).alias("first"), F.count(F.lit(1)).alias("size"))
    classes = stored(classes.select("block", "mark", "first.*", "size"), "classes")
    several = classes.groupBy("mark").agg(F.count(F.lit(1)).alias("_df")).where("_df > 1").drop("_df")
    whole = classes.where("size > 1").join(several, "mark", "left_anti")
    whole = whole.select("block", F.lit(0).alias("i"), (F.col("n") - 1).alias("j"), F.col("doc_id").alias("first_doc_id"), F.col("at").alias("first_at"), F.col("line").alias("first_line"))
    open_ = classes.join(several, "mark").groupBy("doc_id").agg(F.collect_list(F.struct("block", "at", "n", "size")).alias("open"))

    windows = "h long, block long, i int, doc_id long, at int, line int, size long"

    def spread(batches):
        kept_for("passages")
        for b in _parts(batches):
            ids, laid = b.column("doc_id").to_numpy(), Laid(b.column("text").to_pylist())
            h = grams(laid.hashes(), run)
            text, block, at, n, size = _entries(b.column("open"), "block", "at", "n", "size")
            which, i = _spread(np.clip(np.minimum(n, laid.sizes[text] - run + 1 - at), 0, None))
            place = laid.base[text[which]] + at[which] + i
            yield _batch(windows, [h[place].view(np.int64), block[which], i, ids[text[which]], at[which] + i, laid.line[place], size[which]])

    single = stored(_at(rows, open_, "open").mapInArrow(spread, windows), "windows")
    first = single.groupBy("h").agg(F.min(F.struct("doc_id", "at", "line")).alias("first"), F.sum("size").alias("size")).where("size > 1").drop("size")
    found = single.select("h", "block", "i").join(first, "h")
    by = ["block", "first_doc_id", "_shift"]
    found = found.select("block", "i", F.col("first.doc_id").alias("first_doc_id"), F.col("first.at").alias("first_at"), F.col("first.line").alias("first_line"), (F.col("first.at") - F.col("i")).alias("_shift"))
    found = found.withColumn("_island", F.col("i") - F.dense_rank().over(Window.partitionBy(*by).orderBy("i")))
    part = found.groupBy(*by, "_island").agg(F.min("i").alias("i"), F.max("i").alias("j"), F.min("first_at").alias("first_at"), F.min("first_line").alias("first_line"))
    ranges = stored(whole.unionByName(part.select(*whole.columns)), "ranges")
    return hits.select("doc_id", "at", "block").join(ranges, "block").select("doc_id", (F.col("at") + F.col("i")).alias("at"), (F.col("at") + F.col("j")).alias("to"), "first_doc_id", "first_at", "first_line")


def repeated_runs(docs: DataFrame, lines: DataFrame, min_words: int, key: str, text: str) -> DataFrame:
    """Runs of more than min_words words that repeat and that lines, the repeated paragraphs, don't name; columns as there."""
    ship(docs.sparkSession)
    run = min_words + 1
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc_id"), text_of(text).cast("binary").alias("text"))
    equal = equal_windows(rows, run).groupBy("doc_id").agg(F.collect_set(F.struct("at", "to", "first_doc_id", "first_at", "first_line")).alias("equal"))
    named = lines.groupBy("doc_id").agg(F.collect_set(F.struct("paragraph", "kept")).alias("named"))

    schema = "doc_id long, paragraph long, start long, `end` long, n_words long, first_doc_id long, first_paragraph long, kept boolean"

    def merged(batches):
        kept_for("passages")
        for b in _parts(batches):
            ids, laid = b.column("doc_id").to_numpy(), Laid(b.column("text").to_pylist())
            text, *ranges = _entries(b.column("equal"), "at", "to", "first_doc_id", "first_at", "first_line")
            order = np.lexsort((ranges[0], text))
            text, (at, to, first, first_at, first_line) = text[order], (c[order] for c in ranges)
            kept = (first == ids[text]) & (first_at == at)
            # every window, by text and place
            r, i = _spread(np.clip(np.minimum(to, laid.sizes[text] - run) - at + 1, 0, None))
            s = at[r] + i
            place = laid.base[text[r]] + s
            # without what the paragraph's row says
            of, number, stays = _entries(b.column("named"), "paragraph", "kept")
            own = laid.line[place]
            code, said = text[r] << 32 | own, of << 32 | number
            said = np.where(kept[r], np.isin(code, said), np.isin(code, said[~stays.astype(bool)])) & (own == laid.line[place + run - 1])
            r, s, place = r[~said], s[~said], place[~said]
            turn = lambda c: c[1:] != c[:-1]
            new = np.flatnonzero(np.r_[True, (place[1:] != place[:-1] + 1) | turn(text[r]) | turn(first[r]) | turn(kept[r])]) if len(r) else r
            last = np.r_[new[1:], len(r)].astype(np.int64) - 1 if len(r) else r
            x, y, r = place[new], place[last] + run - 1, r[new]
            start, end = laid.spans(x, y, text[r])
            yield _batch(schema, [ids[text[r]], laid.line[x], start, end, y - x + 1, first[r], first_line[r], kept[r]])

    return _at(rows, equal.join(named, "doc_id", "left"), "equal").mapInArrow(merged, schema)


def repeats(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, min_words: int = MIN_WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Passages that repeat, paragraphs and runs: doc_id, paragraph (line number of its start), start, end, n_words, first_doc_id and first_paragraph, kept."""
    lines = stored(repeated_paragraphs(docs, words, similarity, min_words, key, text), "repeated")
    return lines.unionByName(repeated_runs(docs, lines, min_words, key, text))


def without(text: str, gone, cut, stay) -> str:
    """A text without the lines gone and without what lies in spans of cut and not in spans of stay; lines emptied by this go as well."""
    goes = np.zeros(len(text), dtype=bool)
    for spans, value in ((cut, True), (stay, False)):
        for a, z in spans:
            goes[a:z] = value
    gone, out, at = set(gone), [], 0
    for number, line in enumerate(text.split("\n")):
        part = goes[at : at + len(line)]
        at += len(line) + 1
        if number in gone:
            continue
        if part.any():
            line = "".join(c for c, g in zip(line, part.tolist()) if not g)
            if not line.strip():
                continue
        out.append(line)
    return "\n".join(out)


def cut_repeats(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, min_words: int = MIN_WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows of docs, without the repeated passages that aren't the first of their group."""
    ship(docs.sparkSession)
    lines = stored(repeated_paragraphs(docs, words, similarity, min_words, key, text), "repeated")
    span = F.array("start", "end")
    gone = lines.where("not kept").select("doc_id", "paragraph", F.lit(None).cast("array<long>").alias("cut"), F.lit(None).cast("array<long>").alias("stay"))
    runs = repeated_runs(docs, lines, min_words, key, text).select("doc_id", F.lit(None).cast("long").alias("paragraph"), F.when(~F.col("kept"), span).alias("cut"), F.when(F.col("kept"), span).alias("stay"))
    names = unused(docs, "doc", "gone", "cut", "stay")
    by, lost, out, rest_ = names
    what = gone.unionByName(runs).groupBy(F.col("doc_id").alias(by)).agg(F.collect_set("paragraph").alias(lost), F.collect_set("cut").alias(out), F.collect_set("stay").alias(rest_))
    what = stored(what.where(F.size(lost) + F.size(out) > 0), "gone")

    @F.pandas_udf("string")
    def rest(t: pd.Series, gone: pd.Series, cut: pd.Series, stay: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else x if g is None else without(x, g, c, s) for x, g, c, s in zip(t, gone, cut, stay)], dtype=object)

    joined = docs.join(what, F.col(key).cast("long") == F.col(by), "left")
    return joined.withColumn(text, rest(F.col(text), lost, out, rest_)).drop(*names)
