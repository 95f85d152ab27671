"""Importance resampling towards a target text: hashed runs of words weigh documents, Gumbel noise draws without replacement.

A document's features are its runs of 1 to ``RUN`` consecutive words, each hashed to one of ``BUCKETS``. A bucket's gain is
the log ratio of its shares in the target and in the documents, in thousandths and rounded down; a document's weight is
the sum over an array of gains. Score is weight plus noise that depends on the id alone, so that the highest scores are
a sample in proportion to the weights' exponentials. The k-th highest key (score descending, id ascending) is found by
its digits: each round counts the rows still in question by the next digit and goes on within the one that holds the k-th.
Only rows up to that key are sorted, by ranges, and ranked.

Defined cases: a null or empty text has no features and weight 0; a null id counts as an empty string for the noise and
sorts after all others; rows with the same score and id are told apart by their place in the scored table, so exactly
as many as asked for are drawn, which of equal ones is open; an empty table draws nothing; an empty target has no
counts; extra columns are not read.

Scale: two passes over the texts (counts, weights), each without a shuffle of them; a task sends one row of counts for each
bucket it met. A round of the selection sends at most 65,536 counts; only drawn rows are shuffled. Nothing grows with the
documents but the scored table (six numbers a row), which lies in the shared folder.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytewords import Words
from .common import kept_for, ship, stored, unused

RUN, BUCKETS = 3, 10_000
SEED, MIN_WORDS = 42, 20
DIGIT_BITS = 16


def bucket_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """How many features of all texts fall into each bucket."""
    ship(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        kept_for("importance")
        counts = np.zeros(BUCKETS, dtype=np.int64)
        for b in batches:
            for _, crc in Words(b.column(0)).runs(RUN):
                counts += np.bincount(crc % np.uint32(BUCKETS), minlength=BUCKETS)
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(counts[met])], ["bucket", "n"])

    found = docs.select(F.col(text).cast("string")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, dtype=np.int64)
    for r in found.collect():  # at most BUCKETS rows
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, for each bucket."""
    s_all, t_all = float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + BUCKETS) / ((s + 1.0) * (t_all + BUCKETS)))) for s, t in zip(source.tolist(), target.tolist())], dtype=np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row."""
    ship(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        kept_for("importance")
        for b in batches:
            words = Words(b.column(1))
            weight, n = np.zeros(words.rows, dtype=np.int64), np.zeros(words.rows, dtype=np.int64)
            for row, crc in words.runs(RUN):
                # sums of whole numbers far below 2 ** 53, so doubles hold them exactly
                weight += np.bincount(row, weights=gain[crc % np.uint32(BUCKETS)], minlength=words.rows).astype(np.int64)
                n += np.bincount(row, minlength=words.rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words.counts()), pa.array(n), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(key: str = "doc_id", seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from a hash of the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def _before(keys: list[str], at: list[int], last: bool) -> Column:
    """Rows whose keys sort before ``at``, or with it; ``at`` may be shorter than keys."""
    upto = F.lit(last)
    for k, v in reversed(list(zip(keys, at))):
        upto = (F.col(k) < v) | ((F.col(k) == v) & upto)
    return upto


def kth(rows: DataFrame, keys: list[str], k: int) -> list[int]:
    """The first parts of the k-th smallest key, k of 1 to the number of rows: exactly k rows sort before it or with it.

    Keys are non-null longs that together tell all rows apart. Each round is one job that counts by a digit of DIGIT_BITS bits.
    """
    found: list[int] = []
    for name in keys:
        within = rows.where(_same(keys, found)).select(F.col(name).alias("x"))
        low, high, shift = None, None, 64 - DIGIT_BITS
        while True:
            some = within if low is None else within.where((F.col("x") >= low) & (F.col("x") <= high))
            digits = some.groupBy(F.shiftright("x", shift).alias("digit")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).collect()
            for r in sorted(digits, key=lambda r: r["digit"]):
                if k <= r["n"]:
                    break
                k -= r["n"]
            low, high = r["low"], r["high"]
            if k == r["n"]:  # all of this digit
                return [*found, high]
            if low == high:
                break
            shift = max(0, (low ^ high).bit_length() - DIGIT_BITS) if (low < 0) == (high < 0) else 64 - DIGIT_BITS
        found.append(low)
    return found


def _same(keys: list[str], values: list[int]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k) == v for k, v in zip(keys, values)], F.lit(True))


def ranked(rows: DataFrame, keys: list[str], rank: str) -> DataFrame:
    """rows with their places, from 1, by keys: sorted by ranges, numbered within each, moved by the counts of those before."""
    place, of, start = unused(rows, "place", "of", "start")
    table = stored(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(place, F.monotonically_increasing_id()), "ranked")
    within, part = F.col(place).bitwiseAND((1 << 33) - 1), F.shiftright(place, 33)
    moved, before = [], 0
    for r in sorted(table.groupBy(part.alias("part")).count().collect(), key=lambda r: r["part"]):  # one row a range
        moved.append((r["part"], before))
        before += r["count"]
    starts = table.sparkSession.createDataFrame(moved, f"{of} long, {start} long")
    return table.withColumn(of, part).join(F.broadcast(starts), of).withColumn(rank, (within + F.col(start) + 1).cast("long")).drop(place, of, start)


def draw(scored: DataFrame, eligible: Column, percent: int) -> DataFrame:
    """All rows of scored(doc_id, score, ...) with their rank among the drawn ones, ``percent`` of the eligible, else null."""
    minus, ident, row = keys = unused(scored, "minus", "ident", "row")
    table = stored(scored.withColumns({minus: -F.col("score"), ident: F.coalesce("doc_id", F.lit((1 << 63) - 1)), row: F.monotonically_increasing_id()}), "scored")
    k = percent * table.where(eligible).count() // 100
    none = F.lit(None).cast("long")
    if k <= 0:
        return table.withColumn("rank", none).drop(*keys)
    at = kth(table.where(eligible), keys, k)
    taken = F.coalesce(eligible & _before(keys, at, True), F.lit(False))
    return ranked(table.where(taken), keys, "rank").unionByName(table.where(~taken).withColumn("rank", none)).drop(*keys)


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, min_words: int = MIN_WORDS, key: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """Every row's doc_id, n_words, n_features, weight, score and rank; the drawn ones are ``percent`` of those with min_words."""
    gain = gains(bucket_counts(docs, text), bucket_counts(target, target_text))
    return draw(weighed(docs, gain, key, text).withColumn("score", F.col("weight") + noise()), F.col("n_words") >= min_words, percent)
