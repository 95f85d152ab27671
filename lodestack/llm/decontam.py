"""Benchmark decontamination with one Aho-Corasick automaton.

Texts and items are normalised alike: A-Z in lower case, words of digits, a-z and
characters beyond ASCII. A window is ``WINDOW`` consecutive words of an item (all of
a shorter one). The automaton's alphabet is the items' words, so it has at most
``WINDOW`` nodes a window, and a text is scanned once, a word at a time; where it is
hit, words are mapped back to code points of the original text.

Defined cases: a null or empty text has no words; an item without words has no
window, one without item_id goes by the empty string; repeated items and item_ids
count once; an empty benchmark hits nothing; repeated documents are all returned;
extra columns are not read (``clean`` keeps them); overlapping hits count each word
once.

Scale: no shuffle; documents are scanned where they are read. The benchmark is
fetched in slices of at most ``SLICE_WORDS`` words, by which one automaton's memory
is bounded; one slice, the usual case, is one pass over the texts. A benchmark of n times
as many words takes n automata and n passes, each of which adds to what the one before
wrote; the result is the same.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept_for, lean, ship, stored, text_of

WINDOW = 10
SLICE_WORDS = 200_000

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _flat() -> bytes:
    """Bytes to themselves, A-Z to a-z, and all ASCII between words to a space."""
    return bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


_FLAT = _flat()


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FLAT).split(b" ") if text else []


def normalised(text: str) -> list[bytes]:
    """The words of a text, in order."""
    return [w for w in words_of(text) if w]


def slices(benchmark: DataFrame, item: str, text: str, window: int, most: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items as (item_id, words), at most ``most`` words at a time; an item that is longer is cut with an overlap of window - 1 words."""
    held: list[tuple[str, list[bytes]]] = []
    size = 0
    rows = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("i"), text_of(text).alias("t")).distinct()
    for r in rows.toLocalIterator():
        words = normalised(r["t"])
        step = max(1, most - window + 1)
        for at in range(0, max(1, len(words) - window + 1), step):
            part = words[at : at + most]
            if held and size + len(part) > most:
                yield held
                held, size = [], 0
            if part:
                held.append((r["i"], part))
                size += len(part)
    if held:
        yield held


def _one_ahead(parts: Iterator[list]) -> Iterator[tuple[list, bool]]:
    """Each slice, and whether it is the last; the driver holds two."""
    now = next(parts, None)
    while now is not None:
        following = next(parts, None)
        yield now, following is None
        now = following


class Matcher:
    """hits(words) finds every occurrence of a window: (first word, words, item_ids)."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        import ahocorasick

        self.codes: dict[bytes, int] = {}
        code = lambda w: self.codes.setdefault(w, len(self.codes) + 1)
        owners: dict[tuple[int, ...], set[str]] = {}
        for name, words in items:
            ids = tuple(map(code, words))
            for k in range(max(1, len(ids) - window + 1)):
                owners.setdefault(ids[k : k + window], set()).add(name)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for ids, names in owners.items():
            self.automaton.add_word(ids, (len(ids), tuple(sorted(names))))
        if owners:
            self.automaton.make_automaton()
        self.any = bool(owners)

    def hits(self, words: list[bytes]) -> list[tuple[int, int, tuple[str, ...]]]:
        if not self.any or not words:
            return []
        get = self.codes.get
        ids = tuple([get(w, 0) for w in words])
        return [(end - n + 1, n, names) for end, (n, names) in self.automaton.iter(ids)]


def matcher(broadcast, window: int) -> Matcher:
    """One for each worker process and broadcast slice."""
    kept, (number, items) = kept_for("decontam"), broadcast.value
    if number not in kept:
        kept.clear()
        kept[number] = Matcher(items, window)
    return kept[number]


_slice_ids = iter(range(1 << 62))


def _runs(hit: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def _lowered(text: str) -> str:
    """The text with A-Z in lower case, each character in its place."""
    return text.translate(_LOWER)


_LOWER = {c: c + 32 for c in range(65, 91)}


def scan(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, slice_words: int = SLICE_WORDS) -> DataFrame:
    """One row a document: key, n_words, n_hit, items (sorted strings), spans (code points of hit runs of words, ends exclusive), contaminated."""
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema[key].dataType.simpleString()
    state = docs.select(key, text_of(text).alias("text"), F.expr("cast(array() as array<struct<first:long,last:long>>)").alias("runs"), F.expr("cast(array() as array<string>)").alias("items"))
    done = f"`{key}` {kind}, n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>, contaminated boolean"

    def step(shared, last: bool):
        def run(batches):
            import pyarrow as pa

            m = matcher(shared, window)
            for b in batches:
                out = []
                for t, runs, items in zip(*(b.column(c).to_pylist() for c in ("text", "runs", "items"))):
                    words = normalised(t)
                    found = m.hits(words)
                    runs, names = [(r["first"], r["last"]) for r in runs] + [(first, first + n) for first, n, _ in found], set(items).union(*(who for *_, who in found))
                    spans, n_hit = [], 0
                    if runs:
                        hit = np.zeros(len(words), dtype=bool)
                        for first, end in runs:
                            hit[first:end] = True
                        runs, n_hit = _runs(hit), int(hit.sum())
                    if last and runs:
                        places = [x.span() for x in _WORD.finditer(_lowered(t))]
                        spans = [{"start": places[a][0], "end": places[z - 1][1]} for a, z in runs]
                    if last:
                        out.append((len(words), n_hit, sorted(names), spans, n_hit > 0))
                    else:
                        out.append((t, [{"first": a, "last": z} for a, z in runs], sorted(names)))
                place = lambda a, z: pa.list_(pa.struct([(a, pa.int64()), (z, pa.int64())]))
                words_, names_ = pa.list_(pa.string()), ["n_words", "n_hit", "items", "spans", "contaminated"]
                kinds = [pa.int64(), pa.int64(), words_, place("start", "end"), pa.bool_()] if last else [pa.string(), place("first", "last"), words_]
                made = [pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([b.column(key), *made], [key, *(names_ if last else ["text", "runs", "items"])])

        return run

    held: DataFrame | None = None
    parts = slices(benchmark, item, item_text, window, slice_words)
    for part, last in _one_ahead(itertools.chain([next(parts, [])], parts)):
        shared = spark.sparkContext.broadcast((next(_slice_ids), part))
        state = state.mapInArrow(step(shared, last), done if last else state.schema)
        if not last:
            state = held = stored(state, "decontam", instead_of=held)
            shared.destroy()
    return state


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, slice_words: int = SLICE_WORDS) -> DataFrame:
    """The rows of docs whose text holds no window. Only texts go to Python and only flags come back; nothing is shuffled."""
    spark = docs.sparkSession
    ship(spark)
    before: DataFrame | None = None
    for part, last in _one_ahead(slices(benchmark, item, item_text, window, slice_words)):
        shared = spark.sparkContext.broadcast((next(_slice_ids), part))
        docs = docs.where(~_holds(shared, window)(text_of(f"`{text}`")))
        if not last:
            docs = before = stored(docs, "decontam", instead_of=before)
            shared.destroy()
    return docs


def _holds(shared, window: int):
    @F.pandas_udf("boolean")
    def holds(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = matcher(shared, window)
        for texts in lean(batches):
            yield pd.Series([bool(m.hits(normalised(t))) for t in texts], dtype=bool)

    return holds
