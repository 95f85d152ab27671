"""Language identification by a byte convolutional network, trained here in numpy.

Bytes are embedded, convolved with filters of several widths, rectified, max-pooled
over a window and classified by softmax. A text is cut into windows of ``WINDOW``
bytes, all of them are classified, and their probabilities are averaged by length.

Learning reads at most ``PER_LANGUAGE`` distinct labelled texts of each language, and fewer
of each (one at least) where all languages together would have over ``MOST_ROWS``, by
the order of their hashes, and ``PLACES`` windows of each; every language that has a label to learn
from is a class, and everything else covers all rows and whole texts.

Defined cases: a text that is null or holds no letter is ``und`` with score 0; so is
any text if there was nothing to learn from; a null key is never learned from and not
held out; a null language is no label; ties go to the language that sorts first;
repeated rows are all returned; an empty table gives an empty table; extra columns
are not read (``keep`` returns them).

Scale: no shuffle of texts; prediction is one pass, windows in batches of
``BATCH`` (about 2 MB). The model has some thousand weights.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import kept_for, lean, ship, threshold

WINDOW = 512
EMBED, WIDTHS, FILTERS = 6, (2, 3, 4, 5), 8
PAD = 256
BATCH = 32
#: Bounds of what is learned from.
PER_LANGUAGE, MOST_ROWS, PLACES = 600, 120_000, 3
EPOCHS, LEARN_BATCH, RATE, SEED = 5, 48, 4e-3, 7
UNDETERMINED = "und"
#: Below this score the pipeline rejects a document.
MIN_SCORE = 0.3

_LETTER = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]")


def held_out(key: str = "doc_id") -> Column:
    """Rows of this fold are never learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def labelled_windows(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> list[tuple[str, str]]:
    """(language, piece of text) pairs to learn from, bounded as the module says."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull() & ~held_out(key)).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("h")
    )
    counts = rows.select("lang", "h").distinct().groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    if not counts:
        return []
    per_language = max(1, min(per_language, MOST_ROWS // len(counts)))
    limit = {r["lang"]: threshold((1.5 * per_language + 40) / r["count"]) for r in counts}
    low = F.create_map(*[F.lit(x) for pair in limit.items() for x in pair])
    at = lambda k: F.pmod(F.xxhash64("h", F.lit(k)), F.greatest(F.length("text") - WINDOW // 2, F.lit(1))).cast("int") + 1
    some = rows.where(F.col("h") <= low[F.col("lang")]).select("lang", "h", F.array(*[F.substring("text", at(k), F.lit(WINDOW)) for k in range(PLACES)]).alias("w")).dropDuplicates(["lang", "h"])
    taken: dict[str, int] = {}
    out = []
    for r in sorted(some.collect(), key=lambda r: (r["h"], r["lang"])):  # at most about 1.5 x per_language for each language
        if taken.setdefault(r["lang"], 0) < per_language:
            taken[r["lang"]] += 1
            out += [(r["lang"], w) for w in r["w"]]
    return out


def windows_of(raw: bytes) -> np.ndarray:
    n = max(1, -(-len(raw) // WINDOW))
    out = np.full(n * WINDOW, PAD, dtype=np.int16)
    out[: len(raw)] = np.frombuffer(raw, np.uint8)
    return out.reshape(n, WINDOW)


class Network:
    """forward(windows of byte codes) gives probabilities by class."""

    def __init__(self, classes: list[str], seed: int = SEED):
        rng, n = np.random.default_rng(seed), len(WIDTHS) * FILTERS
        self.classes, self.most = classes, max(WIDTHS)
        self.mask = np.zeros((self.most * EMBED, n), dtype=np.float32)
        for k, w in enumerate(WIDTHS):
            self.mask[: w * EMBED, k * FILTERS : (k + 1) * FILTERS] = 1
        self.w = {
            "embed": rng.normal(0, 0.5, (PAD + 1, EMBED)).astype(np.float32),
            "conv": (rng.normal(0, 0.3, self.mask.shape).astype(np.float32)) * self.mask,
            "bias": np.zeros(n, dtype=np.float32),
            "dense": rng.normal(0, 0.2, (n, len(classes))).astype(np.float32),
            "out": np.zeros(len(classes), dtype=np.float32),
        }
        self.w["embed"][PAD] = 0

    def _columns(self, x: np.ndarray) -> np.ndarray:
        """Each position's next ``most`` embedded bytes in a row; positions at the end see padding."""
        e = np.zeros((len(x), x.shape[1] + self.most - 1, EMBED), dtype=np.float32)
        e[:, : x.shape[1]] = self.w["embed"][x]
        s = e.strides
        view = np.lib.stride_tricks.as_strided(e, (len(x), x.shape[1], self.most * EMBED), (s[0], s[1], s[2]))
        return np.ascontiguousarray(view).reshape(-1, self.most * EMBED)

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cols = self._columns(x)
        return cols, (cols @ self.w["conv"]).reshape(len(x), x.shape[1], -1)

    def classified(self, top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        act = np.maximum(top + self.w["bias"], 0)
        z = act @ self.w["dense"] + self.w["out"]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return act, z / z.sum(axis=1, keepdims=True)

    def forward(self, x: np.ndarray) -> np.ndarray:
        # rectifying and adding the bias after the maximum give the same and touch less memory
        return np.concatenate([self.classified(self.pooled(x[k : k + BATCH])[1].max(axis=1))[1] for k in range(0, len(x), BATCH)])

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        cols, conv = self.pooled(x)
        at = conv.argmax(axis=1)
        rows = np.arange(len(x))[:, None]
        act, p = self.classified(conv[rows, at, np.arange(conv.shape[2])])
        p[np.arange(len(x)), y] -= 1
        p /= len(x)
        g = {"dense": act.T @ p, "out": p.sum(axis=0)}
        d = (p @ self.w["dense"].T) * (act > 0)
        seen = cols[rows * x.shape[1] + at]  # window, filter, column
        g["bias"] = d.sum(axis=0)
        g["conv"] = np.einsum("bfk,bf->kf", seen, d) * self.mask
        back = (d[:, :, None] * self.w["conv"].T[None]).reshape(len(x), -1, self.most, EMBED)
        padded = np.concatenate([x, np.full((len(x), self.most - 1), PAD, dtype=x.dtype)], axis=1)
        codes = padded[rows[:, :, None], at[:, :, None] + np.arange(self.most)]
        g["embed"] = np.zeros_like(self.w["embed"])
        np.add.at(g["embed"], codes.ravel(), back.reshape(-1, EMBED))
        g["embed"][PAD] = 0
        return g


def train(pairs: list[tuple[str, str]], epochs: int = EPOCHS, seed: int = SEED) -> Network | None:
    """A network by Adam with a fixed seed; None if there is nothing to learn from."""
    pairs = [(a, t.encode("utf-8", "surrogatepass")[:WINDOW]) for a, t in pairs if _has_letter(t)]
    if not pairs:
        return None
    classes = sorted({a for a, _ in pairs})
    net, rng = Network(classes, seed), np.random.default_rng(seed)
    x = np.concatenate([windows_of(t) for _, t in pairs])
    y = np.array([classes.index(a) for a, _ in pairs])
    # short texts are classified too: some windows end early
    cut = rng.random(len(x)) < 0.25
    ends = rng.integers(24, WINDOW, len(x))
    x[cut[:, None] & (np.arange(WINDOW) >= ends[:, None])] = PAD
    first, second, t = ({k: np.zeros_like(v) for k, v in net.w.items()} for _ in range(2)), None, 0
    first, second = first
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        rate = RATE * (1 - epoch / epochs * 0.8)
        for k in range(0, len(x), LEARN_BATCH):
            one, t = order[k : k + LEARN_BATCH], t + 1
            for name, g in net.gradients(x[one], y[one]).items():
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.999 * second[name] + 0.001 * g * g
                net.w[name] -= (rate * (first[name] / (1 - 0.9**t)) / (np.sqrt(second[name] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return net


def _has_letter(text: str | None) -> bool:
    return bool(text) and (bool(_LETTER.search(text)) or any(c.isalpha() for c in text))


def classify(net: Network | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and score of each whole text."""
    langs, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
    known = [k for k, t in enumerate(texts) if net is not None and _has_letter(t)]
    held: list[tuple[int, np.ndarray, int]] = []

    def flush() -> None:
        if not held:
            return
        p = net.forward(np.concatenate([w for _, w, _ in held]))
        at = 0
        for k, w, size in held:
            weight = np.full(len(w), WINDOW, dtype=float)
            weight[-1] = size - WINDOW * (len(w) - 1)
            mean = weight @ p[at : at + len(w)].astype(float) / size
            at += len(w)
            best = int(np.argmax(mean))
            langs[k], scores[k] = net.classes[best], float(min(1.0, max(0.0, mean[best])))
        held.clear()

    waiting = 0
    for k in known:
        raw = texts[k].encode("utf-8", "surrogatepass")
        held.append((k, windows_of(raw), len(raw)))
        waiting += len(raw)
        if waiting > 1 << 20:
            flush()
            waiting = 0
    flush()
    return langs, scores


def predict(docs: DataFrame, net: Network | None, text: str = "text") -> DataFrame:
    """All columns of docs with lang_pred and score; columns of these names are replaced."""
    ship(docs.sparkSession)
    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]

    def run(batches):
        import pyarrow as pa

        kept_for("langid")
        for b in lean(batches):
            langs, scores = classify(net, b.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*b.schema.names, "lang_pred", "score"])

    plain = docs.select(*[F.col(f"`{c}`") for c in kept])
    schema = StructType([*plain.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return plain.mapInArrow(run, schema)


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Network | None:
    return train(labelled_windows(docs, key, text, lang))


def keep(docs: DataFrame, net: Network | None, text: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """The rows whose language is determined with at least min_score, in the columns of docs."""
    return predict(docs, net, text).where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= min_score)).select(*[f"`{c}`" for c in docs.columns])
