"""Spelling variants: frequent words one edit away from a word at least twice as frequent, by symmetric deletion.

Every word emits itself and its distinct single deletions. Two words that share such a key are candidates (words that
differ by one edit share exactly one), and a candidate counts if its edit distance is one. A word's form is its most
frequent near word, if that has ``RATIO`` times its occurrences; its root is what following forms ends at. As counts at
least double along the way, there are no cycles, and joining roots with roots halves the way each time.

Defined cases: a null or empty text has no words; a null id counts as an empty string for the noise; repeated rows count
again; of near words with equal counts the first in code-point order is the form; a table without frequent words gives an
empty table; extra columns are not read.

Scale: texts aren't shuffled, words are counted before the shuffle, so that the most common word is one row a task.
Afterwards everything is of the size of the vocabulary. A key is shared by words that insert one of the alphabet's 90
letters at one of its places, so a group has at most 90 times a word's length; candidates are never more than those. Words
of over ``LONG`` code points would emit keys of the square of their length: they emit hashes of their deletions (all of
them in one pass over the word) with a number in place of the word, and are fetched for the exact check.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, kept_for, ship, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = "[A-Za-zÀ-ÿ]"
MIN_LENGTH, MIN_COUNT, RATIO, NOISE = 5, 3, 2, 97
LONG = 64
#: By shuffle, whatever sizes are guessed: the guess for keys is that of the compressed words, which are a small part of them, so
#: that a broadcast would take gigabytes of the driver.
JOIN = "merge"
#: Primes and bases of the hashes of long words' deletions.
_HASHES = ((2147483647, 911382323), (2147483629, 972663749))


def _lower(run: Column) -> Column:
    """A-Z only; the fast way for runs that hold nothing else but a-z."""
    return F.when(F.octet_length(run) == F.char_length(run), F.lower(run)).otherwise(F.translate(run, UPPER, LOWER))


def words(docs: DataFrame, key: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): runs of letters, some of which lose a letter by a hash of their document, counted over all documents."""
    # a shorter run can't give a word, as letters are only lost
    found = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col(text), F.lit(f"{LETTERS}{{{min_length},}}"), F.lit(0))).alias("run"))
    found = found.select("id", _lower(F.col("run")).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = F.expr("cast(h % char_length(run) as int)")
    lost = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    word = F.when(F.col("h") % NOISE == 0, lost).otherwise(F.col("run"))
    counted = found.withColumn("h", h).select(word.alias("word")).where(F.char_length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= min_count)


def _near_short(vocabulary: DataFrame) -> DataFrame:
    cut = "transform(sequence(1, char_length(word)), i -> concat(substring(word, 1, i - 1), substring(word, i + 1)))"
    keys = vocabulary.select("word", "n", F.explode(F.expr(f"array_distinct(concat(array(word), {cut}))")).alias("key"))
    other = keys.select(F.col("word").alias("near"), F.col("n").alias("near_n"), "key")
    return keys.join(other.hint(JOIN), "key").where("word <> near").where(F.levenshtein("word", "near", 1) == 1).select("word", "n", "near", "near_n")


def deletion_hashes(word: str) -> np.ndarray:
    """Hashes of the word and of its distinct single deletions, in time proportional to its length."""
    code = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    size, out = len(code), np.zeros(len(code) + 1, dtype=np.int64)
    for prime, base in _HASHES:
        power = np.ones(1, dtype=np.int64)
        while len(power) < size:  # base ** (m + k) = base ** m * base ** k
            power = np.concatenate([power, power * pow(base, len(power), prime) % prime])
        before = np.concatenate([[0], np.cumsum(code * power[:size] % prime) % prime])
        cut = (before[:-1] + (before[-1] - before[1:]) % prime * pow(base, -1, prime)) % prime
        out = (out << 31) ^ np.concatenate([before[-1:], cut])
    return np.unique(out)


def _near_long(vocabulary: DataFrame) -> DataFrame:
    ship(vocabulary.sparkSession)
    numbered = stored(vocabulary.withColumn("id", F.monotonically_increasing_id()), "long-words")

    def run(batches):
        import pyarrow as pa

        kept_for("spelling")
        for b in batches:
            for ident, word in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                keys = deletion_hashes(word)
                for k in range(0, len(keys), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(keys[k : k + (1 << 16)]), pa.array(np.full(len(keys[k : k + (1 << 16)]), ident))], ["key", "id"])

    keys = numbered.select("id", "word").mapInArrow(run, "key long, id long")
    pairs = keys.join(keys.withColumnRenamed("id", "other").hint(JOIN), "key").where("id < other").select("id", "other").distinct()
    near = pairs.join(numbered.hint(JOIN), "id").join(numbered.select(F.col("id").alias("other"), F.col("word").alias("near"), F.col("n").alias("near_n")).hint(JOIN), "other").where(F.levenshtein("word", "near", 1) == 1)
    return near.select("word", "n", "near", "near_n").unionByName(near.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(word, n, near, near_n): all ordered pairs of words that differ by one inserted, deleted or replaced code point."""
    length = F.char_length("word")
    near = _near_short(vocabulary.where(length <= LONG + 1))
    if vocabulary.where(length > LONG).isEmpty():
        return near
    # words of LONG and LONG + 1 meet in the first part only
    far = _near_long(vocabulary.where(length > LONG))
    return near.unionByName(far.where((F.char_length("word") > LONG + 1) | (F.char_length("near") > LONG + 1)))


def forms(vocabulary: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n) of every word."""
    alone = vocabulary.select("word", "n", F.lit(None).cast("string").alias("near"), F.lit(None).cast("long").alias("near_n"))
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("minus"), "near")))
    summed = near_words(vocabulary).unionByName(alone).groupBy("word").agg(F.max("n").alias("n"), F.count("near").alias("n_near"), best.alias("best"))
    has = -F.col("best.minus") >= ratio * F.col("n")
    return summed.select("word", "n", "n_near", F.when(has, F.col("best.near")).alias("form"), F.when(has, -F.col("best.minus")).alias("form_n"))


def roots(found: DataFrame) -> DataFrame:
    """(word, root) of every word that has a form: each round, a root that has a root itself gives way to it."""
    now = stored(found.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(now.join(onward.hint(JOIN), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        forget(now.sparkSession, now._stored_at)
        if moved.where("moved").isEmpty():
            return moved.select("word", "root")
        now = moved


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every frequent word."""
    vocabulary = stored(words(docs, key, text), "words")
    found = stored(forms(vocabulary), "forms")
    return found.join(roots(found).hint(JOIN), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
