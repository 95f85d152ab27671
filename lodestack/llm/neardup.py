"""Near-duplicate documents by bottom-k sketches and inverted lists.

One hash function numbers the word shingles; a document's sketch is its ``K`` smallest
numbers (all of a smaller set), in order. Documents with equal sets are one class, and
only classes go on. Inverted lists hold, for each run of ``RUN`` neighbouring retained
values, the sketches that have it: a run is as good a sign of overlap as ``RUN`` single
values, and one that unrelated documents with a few common shingles hardly share. If
two whole sets have a Jaccard similarity of 0.8 or more, their I common and B other
values satisfy I >= 4 B, so with two marks at each end some run of (I + 4) / (B + 1) >= 4
common values is unbroken: lists of runs of 4 miss no pair. For larger sets a pair of
exactly 0.8 is missed with a chance of some 0.8 ** K, below one in a million. Pairs of
the lists are filtered by the estimate from the union's sketch, and confirmed by exact
Jaccard on full sets of 64-bit shingle hashes.

A list's first candidates are its centre, the member with the smallest id, beside each
other member: as many as it has members, not their square. Then, knowing the components
so far, the members outside a list's largest component meet all members of other
components, in blocks of full sets where they are many. So no link that could join two
components is left out, and a large group costs links in proportion to its size. What
stays quadratic is a list of many documents that are not near copies of each other,
which share four neighbouring retained values all the same.

Defined cases: a null or empty text, or one without words, has the empty set and is
linked with nothing; a text with fewer words than a shingle has one shingle of them
all; equal sets are linked; rows without a doc_id are linked with nothing and are
their own, null, component; doc_ids are taken to be unique, and repeated rows are all
returned; an empty table gives an empty table; extra columns are not read (``keep_one``
returns them). For a similarity below 0.8 runs are shorter, see ``run_length``. Sets are
sets of 64-bit hashes: sizes and similarities are exact but for collisions of these.

Scale: texts are shuffled only if the documents in question don't fit
``BROADCAST_ROWS``; else what moves is ``K`` values for each distinct text. Hot runs
are keys of joins, which adaptive execution splits, and of combined counts.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_columns, ids_of, kept_for, lean, ship, stored, text_of, unused
from .components import components

K = 64
SIGMAS = 5
#: Lists with more pairs to look at than this are worked through in blocks of about so many sets and bytes.
PLAIN_PAIRS, BLOCK, BLOCK_BYTES = 2048, 512, 4 << 20
BROADCAST_ROWS = 500_000


_LOWER = bytes(range(256)).lower()


def shingles(text: str, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; words are runs without ASCII white space, A-Z in lower case."""
    import xxhash

    h = xxhash.xxh3_64_intdigest
    found = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not found:
        return np.empty(0, dtype=np.int64)
    n = min(words, len(found))
    x = np.array([h(w) for w in found], dtype=np.uint64)
    acc = np.full(len(x) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        acc = (acc ^ x[k : len(x) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        acc ^= acc >> np.uint64(29)
        acc *= np.uint64(0xBF58476D1CE4E5B9)
        acc ^= acc >> np.uint64(32)
    return np.unique(acc.view(np.int64))


def sketches(docs: DataFrame, words: int, key: str, text: str, k: int = K) -> DataFrame:
    """doc_id, n_shingles, the set's 128-bit digest as two longs, and its sketch."""
    ship(docs.sparkSession)

    def run(batches):
        import xxhash

        kept_for("neardup")
        for b in lean(batches):
            out = []
            for doc, t in zip(ids_of(b), b["text"]):
                s = shingles(t, words)
                d = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), "<i8")
                out.append((doc, len(s), int(d[0]), int(d[1]), s[:k]))
            yield pd.DataFrame(out, columns=["doc_id", "n_shingles", "d1", "d2", "sketch"]).astype({"doc_id": "Int64"})

    rows = docs.select(*id_columns(key), text_of(text).alias("text"))
    return rows.mapInPandas(run, "doc_id long, n_shingles long, d1 long, d2 long, sketch array<long>")


def run_length(similarity: float) -> int:
    """The longest run of common values that two similar whole sets have for certain, with two marks at each end; 4 at most."""
    return max(1, min(4, math.floor(similarity / (1 - similarity) + 1e-9))) if similarity < 1 else 4


def runs(classes: DataFrame, similarity: float, k: int = K) -> DataFrame:
    """Inverted lists of the runs of classes(node, n, sketch)."""
    r = run_length(similarity)
    marks = lambda low: F.array(*[F.lit((-(1 << 63) + i) if low else ((1 << 63) - 1 - i)) for i in range(2)])
    marked = F.when(F.col("n") <= k, F.concat(marks(True), F.col("sketch"), marks(False))).otherwise(F.col("sketch"))
    places = F.sequence(F.lit(1), F.size("_m") - r + 1)
    held = classes.withColumn("_m", marked).where(F.size("_m") >= r)
    held = held.select("node", "n", F.explode(F.transform(places, lambda i: F.xxhash64(F.slice("_m", i, F.lit(r))))).alias("value"))
    return inverted(held)


def inverted(held: DataFrame) -> DataFrame:
    """Inverted lists of held(value, node, n) with two members or more: value, df (how many), centre (node, n), node, n."""
    # sums of numbers only, which need no sorting
    heads = held.groupBy("value").agg(F.count(F.lit(1)).alias("df"), F.min("node").alias("_node"), F.min_by("n", "node").alias("_n")).where("df > 1")
    heads = heads.select("value", "df", F.struct(F.col("_node").alias("node"), F.col("_n").alias("n")).alias("centre"))
    return held.join(heads, "value").select("value", "df", "centre", "node", "n")


def _fits(similarity: float, x: str = "x", y: str = "y") -> Column:
    """Sets of too different sizes can't be similar."""
    percent = round(similarity * 100)
    return (F.col(f"{x}.n") * 100 >= F.col(f"{y}.n") * percent) & (F.col(f"{y}.n") * 100 >= F.col(f"{x}.n") * percent)


def _agreement(x: np.ndarray, y: np.ndarray, nx: int, ny: int, k: int) -> tuple[int, int]:
    """(common values, values) of the union's sketch, or of the whole sets if the sketches hold them."""
    union = np.union1d(x, y)
    both = np.intersect1d(x, y, assume_unique=True)
    if nx <= k and ny <= k:
        return len(both), len(union)
    cut = union[min(k, len(union)) - 1]
    return int(np.searchsorted(both, cut, "right")), min(k, len(union))


def screened(pairs: DataFrame, classes: DataFrame, similarity: float, k: int = K) -> DataFrame:
    """Those of pairs(a, b) that the union's sketch leaves; _whole says that it held both sets and so has decided."""
    ship(pairs.sparkSession)
    of = lambda end: classes.select(F.col("node").alias(end), F.col("n").alias(f"n{end}"), F.col("sketch").alias(f"s{end}"))
    percent = round(similarity * 100)
    floor = similarity - SIGMAS * math.sqrt(similarity * (1 - similarity) / k)

    def run(batches):
        kept_for("neardup")
        for b in lean(batches):
            keep, whole = [], []
            for x, y, nx, ny in zip(b["sa"], b["sb"], b["na"], b["nb"]):
                hits, size = _agreement(x, y, nx, ny, k)
                whole.append(nx <= k and ny <= k)
                keep.append(100 * hits >= percent * size if whole[-1] else hits >= floor * size)
            out = b[["a", "b"]].assign(_whole=whole)
            yield out[np.array(keep, dtype=bool)]

    return pairs.join(of("a"), "a").join(of("b"), "b").mapInPandas(run, "a long, b long, _whole boolean")


def joining(hit: np.ndarray, x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """Places of links that join components x of the rows and y of the columns, as few as do it."""
    root: dict[int, int] = {}

    def find(k: int) -> int:
        while root.setdefault(k, k) != k:
            root[k] = k = root[root[k]]
        return k

    out = []
    for r in np.flatnonzero(hit.any(axis=1)).tolist():
        cols = np.flatnonzero(hit[r])
        for other, at in zip(*np.unique(y[cols], return_index=True)):
            p, q = find(int(x[r])), find(int(other))
            if p != q:
                root[max(p, q)] = min(p, q)
                out.append((r, int(cols[at])))
    return out


def common_counts(x: list[np.ndarray], y: list[np.ndarray], columns: int = 1 << 12) -> np.ndarray:
    """Sizes of the intersections of the sets x with the sets y, by products of incidence matrices of so many values at once."""
    values, code, times = np.unique(np.concatenate([*x, *y]), return_inverse=True, return_counts=True)
    often = np.flatnonzero(times > 1)
    place = np.full(len(values), -1)
    place[often] = np.arange(len(often))
    row = np.repeat(np.arange(len(x) + len(y)), [len(v) for v in (*x, *y)])
    col = place[code]
    row, col = row[col >= 0], col[col >= 0]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    out = np.zeros((len(x), len(y)), dtype=np.float32)
    for first in range(0, len(often), columns):
        a, b = np.searchsorted(col, [first, first + columns])
        table = np.zeros((len(x) + len(y), min(columns, len(often) - first)), dtype=np.float32)
        table[row[a:b], col[a:b] - first] = 1
        out += table[: len(x)] @ table[len(x) :].T
    return out


def block_links(apart: DataFrame, members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) of apart(value, blocks_a, blocks_b, node, n, component) with members of the same list and other components.

    A group holds one block of each side with their full sets, so its memory is bounded, its links are exact, and only
    those are given that join components.
    """
    ship(apart.sparkSession)
    percent = round(similarity * 100)
    deal = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), (F.col(n) - 1).cast("int")))
    left = apart.join(sets, "node").withColumn("i", deal("blocks_a", 1)).withColumn("j", every("blocks_b"))
    right = members.join(sets, "node").withColumn("j", deal("blocks_b", 2)).withColumn("i", every("blocks_a"))
    cols = ["value", "i", "j", "node", "component", "set"]

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        kept_for("neardup")
        none = pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})
        if not len(x) or not len(y):
            return none
        p, q = ([np.frombuffer(v, np.int64) for v in side["set"]] for side in (x, y))
        both = common_counts(p, q)
        sizes = np.array([len(v) for v in p])[:, None] + np.array([len(v) for v in q])[None]
        cx, cy = x["component"].to_numpy(), y["component"].to_numpy()
        links_ = joining((100 * both >= percent * (sizes - both)) & (cx[:, None] != cy[None]), cx, cy)
        if not links_:
            return none
        r, c = np.array(links_).T
        m, n = x["node"].to_numpy()[r], y["node"].to_numpy()[c]
        return pd.DataFrame({"a": np.minimum(m, n), "b": np.maximum(m, n)})

    left, right = (df.select(*[F.col(c).alias(f"{c}_{end}") for c in cols]).toDF(*cols) for df, end in ((left, "a"), (right, "b")))  # columns of their own
    return left.groupBy("value", "i", "j").cogroup(right.groupBy("value", "i", "j")).applyInPandas(run, "a long, b long")


def confirmed(seen: DataFrame, texts: Callable[[DataFrame], DataFrame], words: int, similarity: float) -> DataFrame:
    """Those of seen(a, b, _whole) that are decided or whose full sets are similar; texts(nodes) gives (node, text) of these nodes."""
    ship(seen.sparkSession)
    percent = round(similarity * 100)
    seen = stored(seen, "pairs")
    open_ = seen.where("not _whole").select("a", "b")
    ends = stored(open_.select(F.col("a").alias("node")).unionByName(open_.select(F.col("b").alias("node"))).distinct(), "ends")

    held = full_sets(texts(ends), words)

    def check(batches):
        kept_for("neardup")
        for b in lean(batches):
            ok = []
            for x, y in zip(b["x"], b["y"]):
                x, y = np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield b.loc[ok, ["a", "b"]]

    joined = open_.join(held.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(held.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
    return seen.where("_whole").select("a", "b").unionByName(joined.mapInPandas(check, "a long, b long"))


def full_sets(texts: DataFrame, words: int) -> DataFrame:
    """(node, set) of texts(node, text): all shingle hashes, in order, as bytes."""
    ship(texts.sparkSession)

    def run(batches):
        kept_for("neardup")
        for b in lean(batches):
            yield pd.DataFrame({"node": b["node"], "set": [shingles(t, words).tobytes() for t in b["text"]]})

    return one_each(stored(texts.mapInPandas(run, "node long, set binary"), "sets"))


def one_each(table: DataFrame) -> DataFrame:
    """A stored table with one row a node. Nearly all have that already: to see it from the nodes alone takes less memory than
    to sort whole rows twice."""
    rows, nodes = table.agg(F.count("node"), F.countDistinct("node")).first()
    return table if rows == nodes else table.dropDuplicates(["node"])


def bounded(ends: DataFrame) -> DataFrame:
    """A stored table of nodes, to be broadcast if it has at most BROADCAST_ROWS rows of some 8 to 20 bytes."""
    return F.broadcast(ends) if ends.count() <= BROADCAST_ROWS else ends


def document_texts(docs: DataFrame, key: str, text: str) -> Callable[[DataFrame], DataFrame]:
    rows = docs.select(F.col(key).cast("long").alias("node"), text_of(text).alias("text"))
    return lambda ends: rows.join(bounded(ends), "node", "left_semi")


def links(lists: DataFrame, screen: Callable[[DataFrame], DataFrame], texts: Callable[[DataFrame], DataFrame], words: int, similarity: float) -> DataFrame:
    """Confirmed links (a, b) that join the same components as all links would.

    lists are inverted lists of which every two similar nodes share one.
    """
    front = stored(lists, "lists")
    ends = lambda df, x, y: df.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()
    one = front.select("centre", F.struct("node", "n").alias("member")).where("centre.node <> member.node").where(_fits(similarity, "centre", "member"))
    first = stored(ends(one, "centre.node", "member.node"), "candidates")
    found = stored(confirmed(screen(first), texts, words, similarity), "links")
    # What the centres left apart.
    groups = components(found)
    labelled = front.where("df > 2").select("value", "node", "n").join(groups.select("node", "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    labelled = stored(labelled, "labelled")
    held = labelled.groupBy("value", "component").agg(F.count(F.lit(1)).alias("size"), (F.sum("n") * 8).alias("bytes"))
    by_list = held.groupBy("value").agg(
        F.max_by(F.struct("component", "size", "bytes"), F.struct("size", "component")).alias("largest"), F.sum("size").alias("size"), F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("parts")
    ).where("parts > 1")
    # The members of the other components meet all: their number and bytes, and all members', make the blocks.
    others = F.col("size") - F.col("largest.size")
    share = lambda n, size: F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_BYTES)).cast("int")
    by_list = by_list.select(
        "value", F.col("largest.component").alias("largest"), (F.col("size") * others).alias("pairs"),
        share(others, F.col("bytes") - F.col("largest.bytes")).alias("blocks_a"), share(F.col("size"), F.col("bytes")).alias("blocks_b"),
    )
    labelled = stored(labelled.join(by_list, "value"), "open-lists")
    plain, large = labelled.where(F.col("pairs") <= PLAIN_PAIRS), labelled.where(F.col("pairs") > PLAIN_PAIRS)
    other = (F.col("x.value") == F.col("y.value")) & (F.col("x.component") != F.col("y.component")) & _fits(similarity)
    rest = ends(plain.where("component <> largest").alias("x").join(plain.alias("y"), other), "x.node", "y.node")
    rest = stored(rest.join(first, ["a", "b"], "left_anti"), "candidates")
    wanted = stored(large.select("node").distinct(), "ends")
    blocked = block_links(large.where("component <> largest"), large, full_sets(texts(wanted), words), similarity)
    return found.unionByName(confirmed(screen(rest), texts, words, similarity)).unionByName(blocked)


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (the smallest doc_id of its group), kept."""
    all_ = stored(sketches(docs, words, key, text), "sketches")
    known = all_.where("n_shingles > 0 and doc_id is not null")
    classes = known.groupBy("d1", "d2").agg(F.min("doc_id").alias("node"))
    classes = stored(classes, "classes")
    full = known.join(classes, ["d1", "d2"]).where("doc_id = node").select("node", F.col("n_shingles").alias("n"), "sketch")
    full = one_each(stored(full, "class-sketches"))
    found = links(runs(full, similarity), lambda pairs: screened(pairs, full, similarity), document_texts(docs, key, text), words, similarity)
    groups = components(found)
    labels = classes.join(groups, "node", "left").select("d1", "d2", F.coalesce("component", "node").alias("component_id"))
    out = all_.drop("sketch").join(labels, ["d1", "d2"], "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id").isNull() | F.col("doc_id").eqNullSafe(component)).alias("kept"))


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs without those whose group keeps another document."""
    (name,) = unused(docs, "gone")
    gone = near_duplicates(docs, words, similarity, key, text).where("not kept").select(F.col("doc_id").alias(name))
    return docs.join(bounded(stored(gone, "gone")), F.col(key) == F.col(name), "left_anti")
