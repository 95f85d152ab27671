"""Toxicity by a factorization machine over hashed terms, trained here in numpy.

Terms are words (A-Z lower-cased, runs of digits, letters and all beyond ASCII), hashed to 32 bits. A text is cut into blocks
of ``BLOCK`` words; a window is two neighbouring blocks, and its features are the distinct terms of each. A window's logit
is a bias, a weight for each term and the inner product of vectors for each pair of terms, so a pair such as an insult
with a mention of a group can count for more than its parts. A text's logit is its highest window's: a few words
in a very long text count as much as in a short one.

Learning reads at most about ``MOST_ROWS`` distinct labelled texts and ``MOST_CHARS`` characters of them, by hash order. It
knows a term if it is in at least ``MIN_TEXTS`` of those and the share of toxic ones among them differs from the share
of all by ``EVIDENCE`` standard errors; other terms count for nothing, as most labels on a long text say nothing
about most of its words. Weights begin at the terms' log odds, so that the highest window is the one with the evidence, and
are then learned with the vectors. Everything else covers all rows and whole texts.

Defined cases: a null or empty text has one empty window, so its score goes by the bias; a null key, a null label or a label
without a document is never learned from; labels that contradict each other count by their mean; a text that occurs often
is learned from once; without labels of both kinds all scores are 0; repeated rows are all returned; an empty table
gives an empty table; extra columns are not read.

Scale: labels are sampled before they meet documents, so what is broadcast is at most about ``MOST_ROWS`` ids, and the
driver gets hashes of their words only. Scoring is one pass without a shuffle; the model is some thousand terms.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytewords import Words
from .common import kept_for, ship, threshold

BLOCK, FACTORS = 32, 4
#: Bounds of what is learned from: texts and characters in all; a text of more than LONGEST characters isn't used.
MOST_ROWS, MOST_CHARS, LONGEST = 20_000, 50_000_000, 200_000
MIN_TEXTS, EVIDENCE = 4, 3.5
EPOCHS, LEARN_BATCH, RATE, DECAY, SEED = 40, 64, 0.1, 1e-4, 11


def held_out(key: str = "doc_id") -> Column:
    """Rows of this fold are never learned from."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of ranges of these sizes, one after the other."""
    return np.arange(size.sum()) + np.repeat(first - (np.cumsum(size) - size), size)


class Blocks:
    """The distinct known terms of each block of some texts.

    ``term``: places in the model's list, block after block; ``ends``: where each block's begin, and the end; ``first``: each
    text's first block, and the end; ``text``: each block's text.
    """

    def __init__(self, term: np.ndarray, ends: np.ndarray, first: np.ndarray):
        self.term, self.ends, self.first = term, ends, first
        self.text = np.repeat(np.arange(len(first) - 1), np.diff(first))

    @classmethod
    def of(cls, terms: np.ndarray, text: np.ndarray, crc: np.ndarray, texts: int) -> Blocks:
        """From the text and the hash of each word, in order."""
        counts = np.bincount(text, minlength=texts)
        first = np.concatenate([[0], np.cumsum(np.maximum(1, -(-counts // BLOCK)))])
        at = np.searchsorted(terms, crc)
        known = at < len(terms)
        known[known] = terms[at[known]] == crc[known]
        word = np.flatnonzero(known)
        block = first[text[word]] + (word - (np.cumsum(counts) - counts)[text[word]]) // BLOCK
        block, term = np.divmod(np.unique(block * max(1, len(terms)) + at[word]), max(1, len(terms)))
        return cls(term, np.searchsorted(block, np.arange(first[-1] + 1)), first)

    def take(self, texts: np.ndarray) -> Blocks:
        size = self.first[texts + 1] - self.first[texts]
        block = _ranges(self.first[texts], size)
        each = self.ends[block + 1] - self.ends[block]
        return Blocks(self.term[_ranges(self.ends[block], each)], np.concatenate([[0], np.cumsum(each)]), np.concatenate([[0], np.cumsum(size)]))


class Machine:
    """Terms (sorted hashes), their weights and vectors, and a bias."""

    def __init__(self, terms: np.ndarray, seed: int = SEED):
        self.terms = terms
        self.bias = 0.0
        self.weight = np.zeros(len(terms))
        self.vector = np.random.default_rng(seed).normal(0, 0.05, (len(terms), FACTORS))

    def sums(self, blocks: Blocks) -> np.ndarray:
        """Of each block: weights, vectors, squares of vectors."""
        v = self.vector[blocks.term]
        each = np.concatenate([self.weight[blocks.term][:, None], v, (v * v).sum(axis=1, keepdims=True)], axis=1)
        total = np.concatenate([np.zeros((1, FACTORS + 2)), np.cumsum(each, axis=0)])
        return total[blocks.ends[1:]] - total[blocks.ends[:-1]]

    def best(self, blocks: Blocks) -> tuple[np.ndarray, np.ndarray]:
        """Each text's highest logit, and the block that its window begins with (the window of a text's last block is that block alone)."""
        one = self.sums(blocks)
        both = one.copy()
        go = np.flatnonzero(blocks.text[1:] == blocks.text[:-1])
        both[go] += one[go + 1]
        z = self.bias + both[:, 0] + 0.5 * ((both[:, 1:-1] ** 2).sum(axis=1) - both[:, -1])
        top = np.maximum.reduceat(z, blocks.first[:-1]) if len(z) else z
        hit = np.flatnonzero(z == top[blocks.text])
        return top, hit[np.unique(blocks.text[hit], return_index=True)[1]]

    def score(self, blocks: Blocks) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.best(blocks)[0], -35, 35)))

    def kept(self, least: float = 1e-3) -> Machine:
        """Without the terms that count for nothing."""
        use = (np.abs(self.weight) > least) | ((self.vector**2).sum(axis=1) > least)
        out = Machine(self.terms[use])
        out.bias, out.weight, out.vector = self.bias, self.weight[use], self.vector[use]
        return out


def train(texts: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Machine | None:
    """A machine from each text's word hashes and its label (0 to 1); None without labels of both kinds."""
    labels = np.asarray(labels, dtype=float)
    if not ((labels > 0.5).any() and (labels < 0.5).any()):
        return None
    own = [np.unique(t) for t in texts]
    terms, which, texts_with = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
    toxic_with = np.bincount(which, weights=np.repeat(labels, [len(t) for t in own]), minlength=len(terms))
    share = labels.mean()
    chance = texts_with * share
    known = (texts_with >= MIN_TEXTS) & (np.abs(toxic_with - chance) - 0.5 >= EVIDENCE * np.sqrt(chance * (1 - share)))
    net, rng = Machine(terms[known], seed), np.random.default_rng(seed)
    whole = Blocks.of(net.terms, np.repeat(np.arange(len(texts)), [len(t) for t in texts]), np.concatenate(texts), len(texts))
    net.bias = float(np.log(share / (1 - share)))
    net.weight = np.log((toxic_with[known] + share) / (texts_with[known] - toxic_with[known] + 1 - share)) - net.bias
    steps = {k: np.full_like(w, 1e-8) for k, w in (("weight", net.weight), ("vector", net.vector))}
    bias_step = 1e-8
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for k in range(0, len(order), LEARN_BATCH):
            some = order[k : k + LEARN_BATCH]
            blocks = whole.take(some)
            top, at = net.best(blocks)
            error = 1 / (1 + np.exp(-np.clip(top, -35, 35))) - labels[some]
            size = blocks.ends[np.minimum(at + 1, blocks.first[1:] - 1) + 1] - blocks.ends[at]
            row, place = np.repeat(np.arange(len(some)), size), _ranges(blocks.ends[at], size)
            term = blocks.term[place]
            v = net.vector[term]
            total = np.zeros((len(some), FACTORS))
            np.add.at(total, row, v)
            used, where = np.unique(term, return_inverse=True)
            gw, gv = np.zeros(len(used)), np.zeros((len(used), FACTORS))
            np.add.at(gw, where, error[row] / len(some))
            np.add.at(gv, where, (error[row] / len(some))[:, None] * (total[row] - v))
            gv += DECAY * net.vector[used]
            steps["weight"][used] += gw * gw
            steps["vector"][used] += gv * gv
            rate = RATE / np.sqrt(steps["weight"][used])
            net.weight[used] -= rate * (gw + DECAY * net.weight[used])
            net.vector[used] -= RATE * 0.3 * gv / np.sqrt(steps["vector"][used])
            bias_step += error.mean() ** 2
            net.bias -= RATE * error.mean() / np.sqrt(bias_step)
    return net.kept()


def labelled(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> list[tuple[np.ndarray, float]]:
    """Word hashes and mean label of each text to learn from."""
    ship(docs.sparkSession)
    known = labels.select(F.col(key).alias("doc_id"), F.col(label).cast("double").alias("y")).where("doc_id is not null and y is not null").where(~held_out("doc_id"))
    known = known.groupBy("doc_id").agg(F.avg("y").alias("y"))
    n = known.count()
    if n > MOST_ROWS:
        known = known.where(F.xxhash64("doc_id") <= threshold(MOST_ROWS / n))
    # ids are distinct here, so at most about MOST_ROWS of them are broadcast
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text")).where(F.length("text") <= LONGEST).join(F.broadcast(known), "doc_id").withColumn("h", F.xxhash64("text"))
    once = rows.groupBy("h").agg(F.max(F.length("text")).alias("size"))
    n, chars = once.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    share = min(1.0, MOST_ROWS / max(1, n), MOST_CHARS / max(1, chars))
    if share < 1:
        rows = rows.where(F.col("h") <= threshold(share))

    def run(batches):
        import pyarrow as pa

        kept_for("toxicity")
        for b in batches:
            words = Words(b.column(2))
            crc = np.concatenate([c for _, c in words.runs(1)] or [np.zeros(0, np.uint32)]).astype("<u4")
            ends = np.cumsum(words.counts())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([crc[e - c : e].tobytes() for e, c in zip(ends, words.counts())], pa.binary())], ["h", "y", "crc"])

    found = rows.groupBy("h").agg(F.avg("y").alias("y"), F.first("text").alias("text")).mapInArrow(run, "h long, y double, crc binary").collect()
    return [(np.frombuffer(r["crc"], "<u4"), r["y"]) for r in sorted(found, key=lambda r: r["h"])]


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Machine | None:
    pairs = labelled(docs, labels, key, text, label)
    return train([t for t, _ in pairs], np.array([y for _, y in pairs]))


def score(docs: DataFrame, net: Machine | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of every row."""
    ship(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        kept_for("toxicity")
        for b in batches:
            words = Words(b.column(1))
            if net is None:
                found = np.zeros(words.rows)
            else:
                text_of, crc = (np.concatenate(x) for x in zip(*words.runs(1))) if len(words) else (np.zeros(0, np.int64), np.zeros(0, np.uint32))
                found = net.score(Blocks.of(net.terms, text_of, crc, words.rows))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found)], ["doc_id", "score"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def classified(docs: DataFrame, net: Machine | None, key: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    return score(docs, net, key, text).select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
