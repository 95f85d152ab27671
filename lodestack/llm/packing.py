"""Packing of documents into training sequences by cutting-stock column generation.

A document longer than a sequence gives whole sequences of its own and a rest; any
other document stays in one piece. The pieces' lengths form a histogram with at most
``length`` entries, which is merged into at most ``CLASSES`` length classes with the
least added width. A linear program over patterns (how many pieces of each class
share a sequence) is solved by column generation: a knapsack dynamic program over
token widths prices the columns. Its solution is rounded down; what remains, at most
about as many sequences as there are classes, is filled by best fit. Each class's
pieces are ranked, and the rank alone says which pattern, sequence and place a piece
gets.

Defined cases: a null or empty text is its end id alone; repeated rows are separate
documents and identical pieces are interchangeable; an empty table gives an empty
table; extra columns are not read; among pieces of a class the rank goes by a hash
bucket, doc_id and start.

Scale: texts are tokenized once, where they are read, and only rows of some 40 bytes
for each piece are written and shuffled. The driver sees the histogram and the
patterns, both bounded by ``length`` and ``CLASSES``. Ranks come from counts by
(class, bucket), so a class with a third of all pieces is spread over the buckets.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_columns, ids_of, lean, ship, stored, text_of
from .tokens import KEEP, encoder

LENGTH = 4096
CLASSES = 320
#: The program is solved when it can't get shorter by more than this share.
GAP = 3e-3
MAX_COLUMNS = 1500
#: A column is priced with so many of the densest widths first, and with all of them before the program counts as solved.
DENSEST = 24
#: Ranks are counted by so many buckets of each class at least, and by one for so many pieces.
RANK_BUCKETS, BUCKET_PIECES = 256, 500_000


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 2, length: int = LENGTH, key: str = "doc_id", text: str = "text", keep: int = KEEP) -> DataFrame:
    """Each document's pieces: doc_id, start, length, ids_crc32, doc_tokens. keep is how many encoded word pieces a worker holds on to."""
    ship(docs.sparkSession)
    end = struct.pack("<I", end_id)

    def run(batches):
        enc = encoder(tokenizer, keep)
        for b in lean(batches):
            out = []
            for doc, x in zip(ids_of(b), enc.ids(b["text"].tolist())):
                x += end
                n = len(x) // 4
                out += [(doc, s, min(length, n - s), zlib.crc32(x[4 * s : 4 * (s + length)]), n) for s in range(0, n, length)]
            made = pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
            yield made.astype({"doc_id": "Int64"})

    rows = docs.select(*id_columns(key), text_of(text).alias("text"))
    return rows.mapInPandas(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def classes_of(histogram: dict[int, int], most: int = CLASSES) -> list[int]:
    """Upper widths of at most ``most`` classes: neighbours are merged, those that add the least width first."""
    import heapq

    widths = sorted(histogram)
    count = [histogram[w] for w in widths]
    right = list(range(1, len(widths) + 1))
    left = list(range(-1, len(widths) - 1))
    alive, version = [True] * len(widths), [0] * len(widths)
    cost = lambda i: count[i] * (widths[right[i]] - widths[i])
    heap = [(cost(i), i, 0) for i in range(len(widths) - 1)]
    heapq.heapify(heap)
    left_over = len(widths)
    while left_over > most and heap:
        _, i, v = heapq.heappop(heap)
        if not alive[i] or v != version[i] or right[i] >= len(widths):
            continue
        j = right[i]
        alive[i], count[j] = False, count[j] + count[i]
        left[j] = left[i]
        left_over -= 1
        if left[i] >= 0:
            right[left[i]] = j
        for k in (left[j], j):
            if k >= 0 and right[k] < len(widths):
                version[k] += 1
                heapq.heappush(heap, (cost(k), k, version[k]))
    return [w for w, a in zip(widths, alive) if a]


def knapsack(widths: np.ndarray, values: np.ndarray, length: int, most: int | None = None) -> tuple[float, np.ndarray]:
    """The best value of an unbounded knapsack, and how often each width is in it; only the ``most`` densest widths, if given."""
    best = np.zeros(length + 1)
    use = np.flatnonzero(values > 1e-12)
    use = use[np.argsort(-values[use] / widths[use], kind="stable")][:most]
    for k in use:
        w, v = int(widths[k]), values[k]
        rows = length // w + 1
        padded = np.full(rows * w, -np.inf)
        padded[: length + 1] = best[: rows * w]
        steps = v * np.arange(rows)[:, None]
        best = (np.maximum.accumulate(padded.reshape(rows, w) - steps, axis=0) + steps).ravel()[: length + 1]
    best = np.maximum.accumulate(best)
    counts, at = np.zeros(len(widths), dtype=np.int64), length
    while at > 0:
        room = use[widths[use] <= at]
        hit = room[np.abs(best[at - widths[room]] + values[room] - best[at]) <= 1e-9 * max(1.0, best[at])]
        if len(hit):
            counts[hit[0]] += 1
            at -= int(widths[hit[0]])
        else:
            lower = np.flatnonzero(best[:at] >= best[at] - 1e-12)
            if not len(lower):
                break
            at = int(lower[0]) if best[at] > 1e-12 else 0
    return float(counts @ values), counts


def column_generation(widths: list[int], demand: list[int], length: int = LENGTH, gap: float = GAP) -> list[tuple[np.ndarray, float]]:
    """Patterns with their fractional uses that cover the demand in about the fewest sequences: a revised simplex method."""
    w, d = np.array(widths, dtype=np.int64), np.array(demand, dtype=float)
    m = len(w)
    if not m:
        return []
    basis = np.diag(length // w).astype(float)
    columns = [np.where(np.arange(m) == k, length // w, 0) for k in range(m)]
    inverse, x = np.diag(1.0 / np.diag(basis)), d / np.diag(basis)
    for turn in range(MAX_COLUMNS):
        if turn % 500 == 499:  # against drift
            inverse = np.linalg.inv(np.array(columns, dtype=float).T)
            x = np.maximum(inverse @ d, 0)
        duals = inverse.sum(axis=0)
        value, counts = knapsack(w, duals, length, DENSEST)
        if value <= 1 + gap:
            value, counts = knapsack(w, duals, length)
            if value <= 1 + gap:  # then x.sum() / value is a lower bound
                break
        way = inverse @ counts
        up = way > 1e-9
        if not up.any():
            break
        ratio = np.where(up, x / np.where(up, way, 1), np.inf)
        out = int(np.argmin(ratio))
        step = ratio[out]
        x = np.maximum(x - step * way, 0)
        x[out] = step
        row = inverse[out] / way[out]
        inverse -= np.outer(way, row)
        inverse[out] = row
        columns[out] = counts
    return [(c, float(v)) for c, v in zip(columns, x) if v > 1e-9]


def best_fit(widths: list[int], left: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """Patterns of one use each for what rounding left over, widest pieces first into the fullest sequence with room."""
    bins: list[list[list[int]]] = [[] for _ in range(length + 1)]  # by room
    filled = np.zeros(length + 1, dtype=np.int64)
    for k in np.argsort(-np.array(widths), kind="stable"):
        for _ in range(int(left[k])):
            at = np.flatnonzero(filled[widths[k] :])
            room = int(at[0]) + widths[k] if len(at) else length
            if len(at):
                one = bins[room].pop()
                filled[room] -= 1
            else:
                one = []
            one.append(int(k))
            bins[room - widths[k]].append(one)
            filled[room - widths[k]] += 1
    return [np.bincount(one, minlength=len(widths)) for group in bins for one in group]


def plan(histogram: dict[int, int], length: int = LENGTH) -> tuple[list[int], list[tuple[int, int, int, int, int]]]:
    """Class widths, and slots (class, first rank, ranks, pieces a sequence, first sequence) that cover each class's ranks."""
    part = {w: n for w, n in histogram.items() if w < length}
    widths = classes_of(part)
    demand = [0] * len(widths)
    for w, n in part.items():
        demand[int(np.searchsorted(widths, w))] += n
    uses = [(c, int(v + 1e-6)) for c, v in column_generation(widths, demand, length)]
    left = np.array(demand, dtype=np.int64)
    chosen = []
    for c, n in uses:
        held = c > 0
        n = min(n, int((left[held] // c[held]).min())) if held.any() else 0
        if n > 0:
            left -= n * c
            chosen.append((c, n))
    chosen += [(c, 1) for c in best_fit(widths, left, length)]
    slots, next_rank, sequence = [], [0] * len(widths), 0
    for c, n in chosen:
        for k in np.flatnonzero(c):
            slots.append((int(k), next_rank[k], n * int(c[k]), int(c[k]), sequence))
            next_rank[k] += n * int(c[k])
        sequence += n
    if length in histogram:
        slots.append((len(widths), 0, histogram[length], 1, sequence))
    return [*widths, length], slots


def ranked(df: DataFrame, by: str, order: list[str], buckets: int = RANK_BUCKETS) -> DataFrame:
    """Adds _rank, from 0 within each value of ``by``, without gathering a value's rows in one task."""
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    counts = dealt.groupBy(by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # at most ``buckets`` rows
    counts = counts.select(by, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy(by, "_bucket").orderBy(*order)
    return dealt.withColumn("_rank", F.row_number().over(own) - 1).join(counts, [by, "_bucket"]).withColumn("_rank", F.col("_rank") + F.col("_before")).drop("_bucket", "_before")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, length: int = LENGTH, key: str = "doc_id", text: str = "text", keep: int = KEEP) -> DataFrame:
    """pieces() with the sequence_id and offset of each."""
    spark = docs.sparkSession
    # a number tells repeats of a row apart, so that they are dealt to many buckets
    cut = stored(pieces(docs, tokenizer, end_id, length, key, text, keep).withColumn("_row", F.monotonically_increasing_id()), "pieces")
    histogram = {int(r["length"]): int(r["n"]) for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``length`` rows
    widths, slots = plan(histogram, length)
    by_class: dict[int, list] = {}
    for k, first, ranks, each, sequence in slots:
        by_class.setdefault(k, []).append((first, ranks, each, sequence))
    table = spark.createDataFrame(sorted(by_class.items()), "_class int, _slots array<struct<first:long,ranks:long,each:long,sequence:long>>")
    # Class of a length: the first width that holds it; at most length + 1 entries.
    upper = F.array(*[F.lit(int(x)) for x in np.searchsorted(widths, np.arange(length + 1))])
    classed = cut.withColumn("_class", F.element_at(upper, F.col("length").cast("int") + 1))
    order = ["doc_id", "start", "ids_crc32", "doc_tokens", "_row"]
    placed = ranked(classed, "_class", order, max(RANK_BUCKETS, sum(histogram.values()) // BUCKET_PIECES)).join(F.broadcast(table), "_class")  # the table is bounded by classes and patterns
    slot = F.filter("_slots", lambda s: (s["first"] <= F.col("_rank")) & (F.col("_rank") < s["first"] + s["ranks"]))[0]
    placed = placed.withColumn("_slot", slot).withColumn("sequence_id", F.expr("_slot.sequence + (_rank - _slot.first) div _slot.each"))
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("length"), *order).rowsBetween(Window.unboundedPreceding, -1)  # at most ``length`` rows
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(F.sum("length").over(inside), F.lit(0)).alias("offset"))
