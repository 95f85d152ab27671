"""Importance resampling, spelling variants and toxicity: brute force, held-out accuracy and the defined cases of their docstrings."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestack.llm import ann, bytewords, decontam, importance, langid, packing, spelling, toxicity
from lodestack.llm.queries import vocabulary

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def docs(spark, texts, ids=None):
    rows = list(zip(ids if ids is not None else range(len(texts)), texts))
    clash = {c: F.lit("x") for c in ("score", "rank", "word", "n", "weight", "_place", "h", "lang", "predicted")}
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns(clash)


# Words of batches


@pytest.mark.parametrize("block", [5, 1 << 17])
def test_runs_of_words(block, monkeypatch):
    monkeypatch.setattr(bytewords, "BLOCK", block)
    rng = random.Random(3)
    texts = ["skipped", None, "", "A b", "abc", "def", "é" * 60 + " " + "q" * 41 + " " + "z" * 40] + ["".join(rng.choice("aB9 .é-漢") for _ in range(rng.randint(0, 90))) for _ in range(300)]
    found = bytewords.Words(pa.array(texts, pa.string()).slice(1))
    got = [Counter() for _ in texts[1:]]
    for rows, crc in found.runs(3):
        for r, c in zip(rows.tolist(), crc.tolist()):
            got[r][c] += 1
    for t, g in zip(texts[1:], got):
        w = WORD.findall(lower(t))
        assert g == Counter(zlib.crc32(" ".join(w[i : i + k]).encode()) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    assert len(bytewords.Words(pa.array([None, None], pa.string()))) == 0 == len(bytewords.Words(pa.array([], pa.string())))


# 11. Importance resampling


def buckets(text):
    w = WORD.findall(lower(text))
    return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def resampled(rows, target, percent):
    s, t = Counter(), Counter()
    for _, x in rows:
        s.update(buckets(x)[1])
    for x in target:
        t.update(buckets(x)[1])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10000) / ((s[b] + 1) * (t.total() + 10000)))) for b in range(10000)]
    out = []
    for i, x in rows:
        n, f = buckets(x)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    fit = sorted((-r[4], r[0] is None, r[0] or 0) for r in out if r[1] >= 20)
    return out, fit[: percent * len(fit) // 100]


def test_resample(spark):
    rng = random.Random(5)
    words = [f"w{i}é" for i in range(60)] + ["A", "the"]
    texts = [" ".join(rng.choice(words[:: 1 + k % 3]) for _ in range(rng.randint(10, 60))) for k in range(300)] + [None, "", "?", " ".join(words * 3000)]
    ids = [*range(300), 300, 301, 302, None]
    texts += texts[:20] * 3  # repeated rows
    ids += ids[:20] * 3
    target = [texts[3], texts[9] + " x", None, ""]
    d = docs(spark, texts, ids)
    got = importance.resample(d, spark.createDataFrame([(t,) for t in target], "text string"), percent=30).collect()
    want, drawn = resampled(list(zip(ids, texts)), target, 30)
    key = lambda r: tuple((v is None, v or 0) for v in r)
    assert sorted(((r["doc_id"], r["n_words"], r["n_features"], r["weight"], r["score"]) for r in got), key=key) == sorted(want, key=key)
    ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [(-r["score"], r["doc_id"] is None, r["doc_id"] or 0) for r in ranked] == drawn


def test_resample_odd_tables(spark):
    empty = docs(spark, ["x"]).limit(0)
    assert importance.resample(empty, empty).count() == 0
    same = importance.resample(docs(spark, ["a b " * 20] * 50, ids=[7] * 50), empty, percent=50).collect()  # one key for all rows
    assert sorted(r["rank"] for r in same if r["rank"]) == list(range(1, 26)) and len(same) == 50


@pytest.mark.parametrize("bits", [2, 16])
def test_kth_key(spark, monkeypatch, bits):
    monkeypatch.setattr(importance, "DIGIT_BITS", bits)
    rng = random.Random(bits)
    rows = [(rng.choice([-3, 0, 5, 1 << 40, -(1 << 62), rng.randint(-9, 9)]), rng.choice([1, 2, (1 << 63) - 1]), k) for k in range(200)]
    table = spark.createDataFrame(rows, "a long, b long, c long").cache()
    for k in (1, 2, 77, 150, 200):
        at = importance.kth(table, ["a", "b", "c"], k)
        taken = table.where(importance._before(["a", "b", "c"], at, True)).collect()
        assert sorted(map(tuple, taken)) == sorted(rows)[:k]


# 12. Spelling variants


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    best = {w: min(near[w], key=lambda v: (-n[v], v)) for w in n if near[w]}
    form = {w: v for w, v in best.items() if n[v] >= 2 * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), n[w], len(near[w]), n.get(form.get(w))) for w in n}


def test_variants(spark):
    rng = random.Random(8)
    base = ["".join(rng.choice("abéß") for _ in range(rng.randint(4, 7))) for _ in range(60)] + ["colour", "Colour", "coulour", "aaaaa", "aaaaaa", "aaaab", "x×y÷z", "x" * 63, "x" * 64, "x" * 65]
    base += ["ab" * 40 + tail for tail in ("", "c", "d", "cd")] + ["q" * 300, "q" * 299 + "r", "q" * 301, "q" * 150 + "r" + "q" * 149]
    for w in base[:20]:
        k = rng.randrange(len(w))
        base += [w[:k] + w[k + 1 :], w[:k] + "a" + w[k:], w[:k] + "b" + w[k + 1 :]]
    rows = [(k, " ".join(rng.choices(base, weights=[1 + 90 // (1 + i) for i in range(len(base))], k=60))) for k in range(120)]
    rows += [(None, " ".join(base)), (500, None), (501, ""), (502, "1234 5!"), *rows[:30]]
    got = spelling.variants(docs(spark, [t for _, t in rows], [i for i, _ in rows])).collect()
    want = variants(rows)
    assert {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got} == want and len(got) == len(want)
    assert any(len(w[0]) > 64 and w[4] > 1 for w in want) and any(w[1] for w in want)


def test_variants_of_chains_and_nothing(spark):
    # each twice as frequent as the one before, so that roots take several rounds
    chain = ["a" * k + "b" * (12 - k) for k in range(9)]
    text = " ".join(w for k, w in enumerate(chain) for _ in range(3 * 2**k))
    got = {r["word"]: r for r in spelling.variants(docs(spark, [text], [3])).collect()}
    assert [got[w]["form"] for w in chain[:-1] if w in got] == chain[1:] and {got[w]["root"] for w in chain} == {chain[-1]}
    assert spelling.variants(docs(spark, ["abcde abcde", None, ""])).count() == 0
    assert spelling.variants(docs(spark, ["x"]).limit(0)).count() == 0


def test_keys_are_joined_by_shuffle(spark, tmp_path):
    """Keys are guessed by the size of the compressed words; a broadcast of them took gigabytes of the driver."""
    spark.createDataFrame([("letters", 3), ("lettres", 5), ("z" * 70, 3)], "word string, n long").write.parquet(str(tmp_path / "words"))
    plan = spelling.near_words(spark.read.parquet(str(tmp_path / "words")))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_long_words_keys():
    word = "abc" * 30_000
    keys = spelling.deletion_hashes(word)
    assert len(keys) == len(word) + 1 and len(spelling.deletion_hashes("z" * 1000)) == 2
    assert len(np.intersect1d(keys, spelling.deletion_hashes(word[:777] + "é" + word[778:]))) == 1
    assert len(np.intersect1d(keys, spelling.deletion_hashes(word[:777] + "é" + word[777:]))) == 1


# 13. Toxicity

INSULTS, GROUPS = ["fool", "nitwit", "oaf", "dolt"], ["bakers", "miners", "poets", "clerks"]


def written(rng, n, *inside):
    w = [f"v{int(rng.paretovariate(0.6)) % 900}" for _ in range(n)]
    at = rng.randrange(max(1, n - 9))
    for k, x in enumerate(inside):
        w.insert(min(len(w), at + 3 * k), x)
    return " ".join(w)


def example(rng, n=None):
    """An insult near a mention of a group is toxic; either alone, and both of the plain kind, is not."""
    kind = rng.randrange(5)
    inside = [(), (rng.choice(INSULTS),), (rng.choice(GROUPS),), (rng.choice(INSULTS), rng.choice(GROUPS)), (rng.choice(GROUPS), rng.choice(INSULTS))][kind]
    return written(rng, n or rng.randint(5, 400), *inside), int(kind >= 3)


def test_pairs_are_learned(spark):
    rng = random.Random(13)
    rows = [(k, *example(rng)) for k in range(3000)]
    rows += [(5000 + k, *example(rng, 20_000)) for k in range(12)]
    d = docs(spark, [r[1] for r in rows], [r[0] for r in rows])
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    net = toxicity.learn(d, labels)
    got = {r["doc_id"]: r for r in toxicity.classified(d, net).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    right = [got[i]["predicted"] == y for i, _, y in rows if got[i]["held_out"] or i >= 5000]
    assert len(right) > 500 and np.mean(right) > 0.97
    flat = toxicity.Machine(net.terms)  # the same without pairs
    flat.bias, flat.weight, flat.vector = net.bias, net.weight, np.zeros_like(net.vector)
    plain = {r["doc_id"]: r["predicted"] for r in toxicity.classified(d, flat).collect()}
    assert np.mean([plain[i] == y for i, _, y in rows if got[i]["held_out"]]) < 0.9

    # a plain loop over windows and pairs gives the same scores
    place = {int(t): k for k, t in enumerate(net.terms)}
    for i, text, _ in rows[:60]:
        known = [place.get(zlib.crc32(w.encode())) for w in WORD.findall(lower(text))]
        blocks = [sorted({k for k in known[a : a + toxicity.BLOCK] if k is not None}) for a in range(0, max(1, len(known)), toxicity.BLOCK)]
        best = -math.inf
        for a in range(len(blocks)):
            f = blocks[a] + (blocks[a + 1] if a + 1 < len(blocks) else [])
            best = max(best, net.bias + sum(net.weight[k] for k in f) + sum(float(net.vector[f[x]] @ net.vector[f[y]]) for x in range(len(f)) for y in range(x)))
        assert got[i]["score"] == pytest.approx(1 / (1 + math.exp(-max(-35, min(35, best)))), abs=1e-9)


def test_toxicity_odd_rows(spark, monkeypatch):
    rng = random.Random(4)
    texts = [example(rng) for _ in range(300)]
    rows = [(1, t) for t, _ in texts] + [(None, texts[0][0]), (2, None), (3, ""), (4, "?!"), (5, texts[1][0]), (5, texts[1][0])]
    d = docs(spark, [t for _, t in rows], [i for i, _ in rows])
    some = spark.createDataFrame([(1, 1), (1, 0), (1, 1), (None, 1), (2, 0), (3, None), (99, 1), (4, 0)], "doc_id long, toxic int")
    pairs = toxicity.labelled(d, some)
    assert len(pairs) == len({t for t, _ in texts}) + 1 and {round(y, 2) for _, y in pairs} == {0.67, 0.0}  # contradictory labels by their mean; ids 1 and 4
    got = toxicity.classified(d, toxicity.train([t for t, _ in pairs], np.array([y for _, y in pairs]))).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    # one id with very many rows stays within the bound
    monkeypatch.setattr(toxicity, "MOST_ROWS", 40)
    assert 10 < len(toxicity.labelled(d, some)) < 100
    none = toxicity.classified(d, toxicity.learn(d, some.limit(0))).collect()
    assert {(r["score"], r["predicted"]) for r in none} == {(0.0, 0)}
    assert toxicity.classified(d.limit(0), None).count() == 0


def test_toxicity_of_the_tables(spark):
    sf = "/root/testdata/sf0.1"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    found = toxicity.classified(d, toxicity.learn(d, labels)).where("held_out").join(labels, "doc_id").groupBy("toxic", "predicted").count().collect()
    n = {(r["toxic"], r["predicted"]): r["count"] for r in found}
    assert n.get((0, 1), 0) <= 0.01 * n[0, 0] and n[1, 1] >= 0.85 * (n[1, 1] + n.get((1, 0), 0))


# Odd rows of earlier operators


def test_nearest_of_any_magnitude(spark):
    rng = np.random.default_rng(2)
    plain = rng.normal(size=(300, 8))
    for scale in (1e25, 1e-25, 1e-160, 1e150):
        x = plain * scale
        rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
        got = ann.search(rows, rows.where("vec_id % 20 = 0"), top=20).collect()
        right = 0
        for q in range(0, 300, 20):
            s = (x * x[q]).sum(axis=1)
            s[q] = -np.inf
            right += len({r["vec_id"] for r in got if r["query_id"] == q} & set(np.argsort(-s)[:20].tolist()))
        assert len(got) == 15 * 20 and right >= 0.95 * 15 * 20


def test_languages_of_repeated_ids(spark):
    words = {"aa": ["kala", "maja", "tuli"], "bb": ["brot", "stein", "wind"], "cc": ["ciel", "eau", "feu"]}
    rng = random.Random(6)
    said = lambda lang: " ".join(rng.choice(words[lang]) for _ in range(40))
    rows = [(1, said("aa"), "aa") for _ in range(3000)] + [(k, said("bb"), "bb") for k in range(300)] + [(3, said("cc"), "cc") for _ in range(150)] * 20
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    pairs = langid.labelled_windows(d)
    n = Counter(a for a, _ in pairs)
    assert n["aa"] == langid.PLACES * langid.PER_LANGUAGE and n["bb"] > 300 and n["cc"] == 150 * langid.PLACES  # a text that repeats counts once
    net = langid.train(pairs)
    assert langid.classify(net, [said("aa"), said("bb"), said("cc")])[0] == ["aa", "bb", "cc"]


def test_languages_by_a_plain_loop(spark):
    """The network's answers for whole texts, from its weights by loops over windows, places, filters and bytes."""
    rng = random.Random(9)
    texts = ["".join(rng.choice("abc déß漢 ") for _ in range(n)) for n in (1, 30, 511, 512, 513, 1300)]
    net = langid.train([("x", t) for t in texts[1:4]] + [("y", t[::-1].upper()) for t in texts[2:]], epochs=1)
    w = net.w
    for t, lang, score in zip(texts, *langid.classify(net, texts)):
        raw, mean = t.encode(), np.zeros(len(net.classes))
        if not any(c.isalpha() for c in t):
            continue
        for a in range(0, len(raw), langid.WINDOW):
            part = list(raw[a : a + langid.WINDOW])
            codes = part + [langid.PAD] * (langid.WINDOW - len(part) + max(langid.WIDTHS))
            top = []
            for k, width in enumerate(langid.WIDTHS):
                for f in range(langid.FILTERS):
                    col = w["conv"][:, k * langid.FILTERS + f].reshape(-1, langid.EMBED)
                    top.append(max(sum(float(w["embed"][codes[p + j]] @ col[j]) for j in range(width)) for p in range(langid.WINDOW)) + w["bias"][k * langid.FILTERS + f])
            z = np.maximum(top, 0) @ w["dense"].astype(float) + w["out"]
            p = np.exp(z - z.max())
            mean += len(part) / len(raw) * p / p.sum()
        assert lang == net.classes[int(np.argmax(mean))] and score == pytest.approx(mean.max(), abs=1e-4)


def test_benchmark_slices_come_one_by_one(spark, monkeypatch):
    made, used = [], []
    plain, step = decontam.slices, decontam.stored

    def watched(*a):
        for part in plain(*a):
            made.append(len(part))
            yield part

    monkeypatch.setattr(decontam, "slices", watched)
    monkeypatch.setattr(decontam, "stored", lambda *a, **k: (used.append(len(made)), step(*a, **k))[1])
    bench = spark.createDataFrame([(k, " ".join(f"w{k}x{j}" for j in range(12))) for k in range(6)], "item_id long, text string")
    d = docs(spark, [" ".join(f"w{k}x{j}" for j in range(12)) for k in range(8)])
    got = {r["doc_id"]: r["contaminated"] for r in decontam.scan(d, bench, slice_words=12).collect()}
    assert got == {k: k < 6 for k in range(8)} and used == [2, 3, 4, 5, 6]  # one slice ahead of the one in work
    assert decontam.clean(d, bench, slice_words=12).count() == 2 and decontam.clean(d, bench.limit(0)).count() == 8
    assert decontam.scan(d, bench.limit(0)).where("contaminated").count() == 0


def test_packing_deals_repeats(spark):
    rows = spark.createDataFrame([(None, "")] * 3000 + [(k, "a b c") for k in range(50)], "doc_id long, text string")
    got = packing.pack(rows, vocabulary("word_bpe_49k.json"))
    assert got.count() == 3050 and got.groupBy("sequence_id", "offset").count().where("count > 1").isEmpty()
    same = spark.range(3000).select(F.lit(0).alias("c"), F.lit(7).alias("x"), F.monotonically_increasing_id().alias("_row"))
    dealt = packing.ranked(same, "c", ["x", "_row"], 64)
    assert sorted(r["_rank"] for r in dealt.select("_rank").collect()) == list(range(3000))
    assert same.groupBy(F.pmod(F.xxhash64("x", "_row"), F.lit(64)).alias("b")).count().agg(F.max("count")).first()[0] < 200


def test_unseen_identifiers_and_paths(spark):
    """Names that the secret model wasn't trained on, of the standard library and of the files of a package."""
    import asyncio
    import email.message
    import http.client
    import inspect
    import logging
    import socket
    import unittest
    from pathlib import Path

    import pyspark

    from lodestack.llm import secretscan

    run = re.compile("[A-Za-z0-9+/_=-]{12,}")
    names = {n for m in (asyncio, email.message, http.client, inspect, logging, socket, unittest) for k in dir(m) for n in [k, *dir(getattr(m, k))] if run.fullmatch(n)}
    top = Path(pyspark.__file__).parent
    paths = sorted({x for p in top.rglob("*") for x in run.findall(f"/usr/lib/{p.relative_to(top.parent)}")})[:6000]
    rng = random.Random(21)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    secrets = ["".join(rng.choice(letters) for _ in range(n)) for n in (12, 20, 32) for _ in range(200)]
    ratios = secretscan.train(secretscan.labelled_samples(spark))
    groups = {"names": sorted(names), "paths": paths, "secrets": secrets}
    rows = spark.createDataFrame([(k, x) for k, v in groups.items() for x in v], "kind string, text string")
    found = {r["kind"]: r["share"] for r in secretscan.scan(rows, ratios).groupBy("kind").agg(F.avg((F.size("spans") > 0).cast("int")).alias("share")).collect()}
    assert len(names) > 300 and len(paths) > 500 and found["names"] < 0.02 and found["paths"] < 0.02 and found["secrets"] > 0.94


def test_dictionary_of_long_texts(spark, monkeypatch):
    """What the driver gets of a text is a window, however long the text is."""
    from lodestack.llm import tokenout

    sizes, plain = [], tokenout.bounded_sample
    monkeypatch.setattr(tokenout, "bounded_sample", lambda df, *a: (sizes.append(df.agg(F.max(F.length("t"))).first()[0]), plain(df, *a))[1])
    d = docs(spark, [f"{k} some words of text {k * k} " * (20_000 if k % 9 == 0 else 20) for k in range(60)])
    assert len(tokenout.train_dictionary(d, vocabulary("byte_bpe_50k.json"))) > 200 and sizes == [tokenout.SAMPLE_CHARS]
