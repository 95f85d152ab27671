"""The operators on small tables: brute force, round trips, and the defined cases of their docstrings."""

import hashlib
import itertools
import os
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.llm import ann, components, decontam, langid, linededup, neardup, packing, secretscan, substring, tokenout, tokens, urlfilter
from lodestack.llm.queries import vocabulary

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{i}ab" for i in range(400)]


def docs(spark, texts, ids=None, source=None, schema=DOCS):
    ids = ids or list(range(len(texts)))
    rows = [(i, t, "en", source[k] if source else "s", len(t or "")) for k, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, schema)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def test_large_ids_beside_null(spark):
    big = (1 << 62) + 1
    d = docs(spark, ["a b c d e f", "a b c d e f", "x"], ids=[big, None, big + 2])
    for df in (neardup.near_duplicates(d), packing.pack(d, vocabulary("word_bpe_49k.json")), decontam.scan(d, spark.createDataFrame([], "item_id long, text string"))):
        assert {r["doc_id"] for r in df.collect()} == {big, None, big + 2}


# 1. Lines


def test_line_dedup(spark):
    texts = [f"  menu\t\nunique {i}\n\nmenu" for i in range(6)] + [None, "", "\n", "menu x"] + ["copy a\ncopy b"] * 30
    sources = ["a"] * 6 + [None, "", "b", "b"] + ["a"] * 30
    d = docs(spark, texts, source=sources).withColumnsRenamed({"n_chars": "n_lines"})
    got = {r["doc_id"]: r for r in linededup.drop_lines(d, ratio=0.5, min_pages=5).collect()}
    assert [got[i]["text"] for i in range(6)] == [f"unique {i}\n" for i in range(6)]
    assert (got[0]["n_lines"], got[0]["n_dropped"]) == (4, 2)
    assert got[6]["text"] is None and got[7]["text"] == "" and got[8]["text"] == "\n" and got[9]["text"] == "menu x"
    # a page counts once, however often it was fetched
    assert all(got[i]["text"] == "copy a\ncopy b" for i in range(10, 40))
    assert linededup.drop_lines(d.limit(0)).count() == 0
    # exactly at the ratio a line stays
    d = docs(spark, [f"menu\n{i}" for i in range(5)] + [f"x{i}" for i in range(5)])
    assert linededup.boilerplate(d, ratio=0.5).count() == 0 and linededup.boilerplate(d, ratio=0.49).first()["pages"] == 5


def test_line_dedup_odd_tables(spark):
    long_ = "\n".join(["common"] + [f"line {k}" for k in range(100_000)])
    texts = [f"common\n{k}" for k in range(20)] + [long_, "", None]
    d = docs(spark, texts, source=["s"] * len(texts)).withColumns({"_host": F.lit(1), "_bad": F.lit(2), "_kept": F.lit(3), "n_lines": F.lit("old")})
    got = {r["doc_id"]: r for r in linededup.drop_lines(d).collect()}
    assert [got[k]["text"] for k in (3, 21, 22)] == ["3", "", None] and got[20]["text"] == long_[7:] and got[20]["n_lines"] == 100_001
    assert all((r["_host"], r["_bad"], r["_kept"]) == (1, 2, 3) for r in got.values())


def test_line_dedup_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(linededup, "BROADCAST_BYTES", -1)
    d = docs(spark, [f"menu\n{i}" for i in range(9)])
    assert sorted(r["text"] for r in linededup.drop_lines(d, ratio=0.5).collect()) == [str(i) for i in range(9)]


# 2. Vectors


def test_nearest(spark, monkeypatch):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[100:220] = x[100]  # a group of equal vectors
    rows = [(i, v.tolist(), 1, "clash") for i, v in enumerate(x)]
    bad = [(1000, None, 1, ""), (1001, [0.0] * 16, 1, ""), (1002, [float("nan")] * 16, 1, ""), (1003, [None] + [1.0] * 15, 1, ""), (1004, [], 1, ""), (1005, [1.0] * 3, 1, ""), (None, x[0].tolist(), 1, ""), (0, x[0].tolist(), 1, "")]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, rank int, score string")
    got = defaultdict(list)
    for r in ann.search(df, df.where("vec_id % 20 = 0 or vec_id > 999"), top=20, shard_rows=200, block_rows=10).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 600, 20))
    hits = 0
    for q, found in got.items():
        s = (x.astype(float) * x[q].astype(float)).sum(axis=1)
        s[q] = -np.inf
        want = np.lexsort((np.arange(600), -s))[:20].tolist()
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and all(abs(s[v] - sc) < 1e-12 for _, v, sc in found)
        hits += len(set(want) & {f[1] for f in found})
        if 100 <= q < 220:
            assert [f[1] for f in found] == want
    assert hits / (20 * len(got)) > 0.95
    few = df.where("vec_id < 4")
    assert ann.search(few, few.where("vec_id = 0"), top=20).count() == 3
    assert ann.search(df.limit(0), df.limit(0)).count() == 0


def brute_nearest(vectors, top=20):
    """(query, rank, id, score) of queries whose id is divisible by 20, among vectors of the same length."""
    out = []
    for q, x in vectors.items():
        if q % 20 == 0:
            near = sorted((-float(np.dot(x.astype(float), y.astype(float))), i) for i, y in vectors.items() if i != q and len(x) == len(y))[:top]
            out += [(q, k + 1, i, -s) for k, (s, i) in enumerate(near)]
    return out


def test_shards_are_built_by_many_tasks(spark):
    """Shards are few bytes: adaptive execution used to put all of them into one task."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(400, 8)).astype(np.float32))], "vec_id long, embedding array<float>")
    pts = ann.points(df, "vec_id", "embedding", 20)[0].withColumn("shard", F.pmod("_h", F.lit(8)).cast("int"))
    built = ann.index(pts, 8).select("shard", F.spark_partition_id().alias("task")).collect()
    assert sorted(r["shard"] for r in built) == list(range(8)) and len({r["task"] for r in built}) >= 4


def test_nearest_of_doubles_lengths_and_repeated_ids(spark):
    rng = np.random.default_rng(21)
    vectors = {i: rng.normal(size=4 if i % 3 else 6) for i in range(240)}
    rows = [(i, x.tolist(), "e") for i, x in vectors.items()]
    rows += [(40, (vectors[40] + 1).tolist(), "again"), (41, (vectors[41] - 5).tolist(), "again"), (None, [1.0] * 4, ""), (500, [], ""), (520, [0.0] * 4, ""), (540, [1.0, None, 1.0, 1.0], ""), (560, [float("nan")] * 4, ""), (580, None, ""), (600, [1.0] * 9, "alone")]
    for i, x in ((40, vectors[40] + 1), (41, vectors[41] - 5)):
        vectors[i] = np.array(min(vectors[i].tolist(), x.tolist()))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, _h string")
    got = [tuple(r) for r in ann.search(df, df.where("vec_id % 20 = 0"), shard_rows=64, block_rows=4).select("query_id", "rank", "vec_id", "score").collect()]
    want = brute_nearest(vectors)
    assert sorted(r[:3] for r in got) == sorted(r[:3] for r in want)
    scores = {r[:3]: r[3] for r in want}
    assert all(abs(r[3] - scores[r[:3]]) < 1e-12 for r in got)


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.1"), reason="the driver's tables aren't here")
def test_nearest_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    vectors = {r["vec_id"]: np.array(r["embedding"], dtype=np.float32) for r in df.collect() if r["embedding"]}
    want = {r[:3:2] for r in brute_nearest(vectors)}
    got = {(r["query_id"], r["vec_id"]) for r in ann.search(df, df.where("vec_id % 20 = 0")).collect()}
    assert len(got & want) / len(want) >= 0.97 and len(got) == len(want)


# 3. URLs


def test_urls(spark):
    entries = [("a", "domain", "X.com", 10, "add"), ("a", "domain", "x.com", 20, "remove"), ("a", "domain", "x.com", 30, "add"), ("a", "domain", "x.com", 30, "add"), ("b", "host", "w.x.com", 15, "add"), ("b", "host", "w.x.com", 15, "remove"), ("c", "url", "y.org/a", 0, "add"), (None, "host", "q", 0, "add"), ("d", "regex", "q", 0, "add")]
    e = spark.createDataFrame(entries, "list string, kind string, pattern string, since long, action string")
    caps = [("http://u:p@W.x.com:80/q", 10), ("http://w.x.com/q", 20), ("http://xx.com", 12), ("https://x.com.", 10**9), ("http://y.org/a/b?c", 5), ("http://y.org/ab", 5), (None, 5), ("junk", 5), ("http://x.com", None), ("http://x.com", 9), ("http://x.com", 30), ("http://x.com", 30)]
    c = spark.createDataFrame([(*x, "old") for x in caps], "url string, fetched_at long, host string")
    got = [(r["url"], r["fetched_at"], r["lists"], r["blocked"]) for r in urlfilter.evaluate(c, e).collect()]
    want = [(*caps[0], "a", True), (*caps[1], "", False), (*caps[2], "", False), (*caps[3], "a", True), (*caps[4], "c", True)] + [(*x, "", False) for x in caps[5:10]] + [(*caps[10], "a", True)] * 2
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert urlfilter.evaluate(c, e.limit(0)).where("blocked").count() == 0 and urlfilter.evaluate(c.limit(0), e).count() == 0
    assert urlfilter.evaluate(c.withColumn("fetched_at", F.timestamp_seconds("fetched_at")), e.withColumn("since", F.timestamp_seconds("since"))).where("blocked").count() == 5


# 4. Packing


def test_urls_at_absurd_times(spark):
    start = 1704067200
    entries = [("a", "domain", "x.org", 0, "add"), ("a", "domain", "y.org", -(10**15), "add"), ("b", "host", "x.org", start, "add"), ("b", "host", "x.org", 10**15, "remove"), ("b", "host", "y.org", 10**17, "add")]
    table = spark.createDataFrame(entries, "list string, kind string, pattern string, since long, action string")
    times = [start + 60 * k for k in range(300)] + [start * 1000, 10**15, 10**18, -5, -(10**16)]
    pages = spark.createDataFrame([(k, f"http://{'xy'[k % 2]}.org/p", t, "u", "n", "h") for k, t in enumerate(times)], "page_id long, url string, fetched_at long, _url string, _n string, host string")
    got = {r["page_id"]: r for r in urlfilter.evaluate(pages, table).collect()}
    for k, t in enumerate(times):
        on = (["a"] if t >= (0, -(10**15))[k % 2] else []) + (["b"] if (start <= t < 10**15, t >= 10**17)[k % 2] else [])
        assert got[k]["lists"] == ",".join(on) and got[k]["host"] == f"{'xy'[k % 2]}.org" and (got[k]["_url"], got[k]["_n"]) == ("u", "n")
    assert len(got) == len(times) and len(urlfilter.bounds(pages.select("url", F.col("fetched_at").alias("fetched")))) < urlfilter.PERIODS


def test_packing(spark):
    rng = random.Random(2)
    texts = [prose(rng, rng.choice([1, 3, 20, 80, 300])) for _ in range(120)] + ["", None, prose(rng, 3000), "same", "same"]
    d = docs(spark, texts, ids=[*range(len(texts) - 2), 7000, 7000])
    rows = packing.pack(d, vocabulary("word_bpe_49k.json"), length=512).collect()
    enc, by_doc, by_seq = tokens.encoder(vocabulary("word_bpe_49k.json")), defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    total = 0
    for i, t in [*enumerate(texts[:-2]), (7000, "same")]:
        ids = np.frombuffer(enc.ids([t or ""])[0] + b"\2\0\0\0", "<u4")
        copies = 2 if i == 7000 else 1
        total += copies * len(ids)
        spans = sorted((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in by_doc[i])
        want = [(s, len(ids[s : s + 512]), zlib.crc32(ids[s : s + 512].tobytes()), len(ids)) for s in range(0, len(ids), 512)]
        assert spans == sorted(want * copies)
    for found in by_seq.values():
        at = 0
        for r in sorted(found, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 512
    assert total / (512 * len(by_seq)) > 0.9
    assert packing.pack(d.limit(0), vocabulary("word_bpe_49k.json")).count() == 0


def test_column_generation():
    rng = np.random.default_rng(1)
    for widths in ([3, 5, 7], [1], [100], sorted(set(rng.integers(1, 100, 30).tolist()))):
        demand = rng.integers(1, 500, len(widths))
        got = packing.column_generation(widths, demand.tolist(), 100)
        made = sum(c * v for c, v in got)
        assert np.allclose(made, demand, atol=1e-6) and all(c @ np.array(widths) <= 100 for c, _ in got)
        bound = demand @ np.array(widths) / 100
        assert sum(v for _, v in got) >= bound - 1e-6
    values = rng.random(12)
    widths = rng.integers(3, 20, 12)
    best, counts = packing.knapsack(widths, values, 30)
    exact = [0.0] * 31
    for c in range(1, 31):
        exact[c] = max([exact[c - 1]] + [exact[c - w] + v for w, v in zip(widths, values) if w <= c])
    assert abs(best - exact[30]) < 1e-9 and counts @ widths <= 30
    assert len(packing.classes_of({w: 1 for w in range(1, 1000)}, 50)) == 50
    slots = packing.plan({5: 3, 4096: 2, 4000: 7})[1]
    assert sum(s[2] for s in slots) == 12


# 5. Decontamination


def brute_hits(texts, items, window=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    norm = lambda t: word.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    out = []
    for t in texts:
        w, hit, names = norm(t), set(), set()
        for name, item in items:
            x = norm(item)
            n = min(window, len(x))
            for k in range(len(x) - n + 1 if n else 0):
                for at in range(len(w) - n + 1):
                    if w[at : at + n] == x[k : k + n]:
                        hit |= set(range(at, at + n))
                        names.add(str(name))
        out.append((len(w), len(hit), sorted(names)))
    return out


@pytest.mark.parametrize("slice_words", [200_000, 12])
def test_decontamination(spark, slice_words):
    rng = random.Random(5)
    items = [(k, prose(rng, n)) for k, n in enumerate((25, 10, 4, 0, 1))] + [(7, None), (8, "Été İÑ 12-3"), (1, prose(rng, 12)), (None, prose(rng, 11))]
    texts = [prose(rng, 50) for _ in range(5)] + [None, "", "...", "x " + (items[0][1]).upper() + "; y " + items[2][1], "Été İñ, 12 3 Été İÑ(12)3", items[0][1].replace(" ", "\n", 3)[:-5], prose(rng, 4000) + " " + items[1][1]]
    b = spark.createDataFrame(items, "item_id long, text string")
    d = docs(spark, texts).withColumn("items", F.lit("clash"))
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontam.scan(d, b, slice_words=slice_words).collect()}
    assert [got[i] for i in range(len(texts))] == brute_hits(texts, [("" if k is None else k, t) for k, t in items])
    spans = {r["doc_id"]: r["spans"] for r in decontam.scan(d, b).collect()}
    assert [texts[9][s["start"] : s["end"]] for s in spans[9]] == ["Été İÑ(12)3"]
    assert decontam.scan(d, b.limit(0)).where("contaminated").count() == 0 and decontam.scan(d.limit(0), b).count() == 0
    assert sorted(r["doc_id"] for r in decontam.clean(d, b).collect()) == [i for i in range(len(texts)) if not got[i][1]]


def test_clean_with_null_and_repeated_ids(spark):
    rng = random.Random(27)
    item = prose(rng, 30)
    bad, good = prose(rng, 5) + " " + item, prose(rng, 40)
    d = docs(spark, [bad, good, bad, good, bad, None], ids=[None, None, 7, 7, 8, None])
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in decontam.clean(d, b).collect()) == sorted([("None", good), ("7", good), ("None", "None")])


# 6. Languages


def test_language(spark):
    rng = random.Random(4)
    syllables = {"aa": ["th", "ing", "er", "and"], "bb": ["ción", "ñ", "ado", "que"]}
    make = lambda lang, n: " ".join("".join(rng.choice(syllables[lang]) for _ in range(3)) for _ in range(n))
    rows = [(i, make(lang, rng.choice([1, 5, 60, 400])), lang, "s", 0) for i in range(300) for lang in [("aa", "bb")[i % 2]]]
    rows += [(1000, None, "aa", "s", 0), (1001, "", "bb", "s", 0), (1002, "123 ... ²", "aa", "s", 0), (None, "thing", "aa", "s", 0), (1003, "日本", None, "s", 0)]
    d = spark.createDataFrame(rows, DOCS)
    net = langid.learn(d)
    got = langid.predict(d.withColumn("score", F.lit("x")), net).withColumn("held_out", langid.held_out()).collect()
    by = {r["doc_id"]: r for r in got}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert [i for i in range(300) if by[i]["held_out"]] == held and by[None]["held_out"] is False
    assert sum(by[i]["lang_pred"] == by[i]["lang"] for i in held) / len(held) > 0.95
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0.0 for i in (1000, 1001, 1002)) and by[1003]["lang_pred"] in ("aa", "bb")
    assert all(0.0 <= r["score"] <= 1.0 for r in got)
    # neither the label nor the source is read
    other = langid.predict(d.withColumns({"lang": F.lit("bb"), "source": F.lit("z")}), net)
    assert {r["doc_id"]: r["lang_pred"] for r in other.collect()} == {r["doc_id"]: r["lang_pred"] for r in got}
    assert langid.learn(d.limit(0)) is None and langid.predict(d, None).where("lang_pred <> 'und'").count() == 0
    assert langid.keep(d, net).columns == d.columns


def test_network_gradients():
    net = langid.Network(["a", "b", "c"], 1)
    x = np.random.default_rng(0).integers(0, 257, (4, langid.WINDOW)).astype(np.int16)
    y = np.array([0, 1, 2, 1])
    loss = lambda: -np.log(net.forward(x)[np.arange(4), y]).mean()
    g = net.gradients(x, y)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    for name, at in (("dense", (3, 1)), ("out", (2,)), ("conv", (1, 0)), ("bias", (5,)), ("embed", (int(x[0, 0]), 2))):
        base, eps = net.w[name][at], 1e-3
        net.w[name][at] = base + eps
        up = loss()
        net.w[name][at] = base - eps
        down = loss()
        net.w[name][at] = base
        assert abs((up - down) / (2 * eps) - g[name][at]) < 2e-3 + 0.05 * abs(g[name][at]), name


def test_every_language_is_a_class(spark, monkeypatch):
    d = spark.createDataFrame([(8 * k + i, f"text {k} {i}", f"l{k:03}") for k in range(230) for i in range(8)], "doc_id long, text string, lang string")
    of = [lang for lang, _ in langid.labelled_windows(d)]
    learned = {r["lang"] for r in d.where(~langid.held_out()).select("lang").distinct().collect()}
    assert set(of) == learned and len(learned) > 200
    monkeypatch.setattr(langid, "MOST_ROWS", 460)
    of = [lang for lang, _ in langid.labelled_windows(d)]
    assert set(of) == learned and max(map(of.count, learned)) <= langid.PLACES * 2


# 7. Near duplicates


def brute_groups(texts, words, similarity=0.8, least=0):
    sets = {}
    for k, t in texts.items():
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", w)
        n = min(words, len(w))
        sets[k] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
    parent = {k: k for k in sets}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= similarity * 100 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {k: (len(sets[k]), find(k)) for k in sets}


def varied(rng, words, share):
    return [rng.choice(WORDS) if rng.random() < share else w for w in words]


@pytest.mark.parametrize("blocks", [False, True])
def test_near_duplicates(spark, monkeypatch, blocks):
    if blocks:
        monkeypatch.setattr(neardup, "PLAIN_PAIRS", 0)
        monkeypatch.setattr(neardup, "BLOCK", 7)
        monkeypatch.setattr(neardup, "BROADCAST_ROWS", 0)
    rng = random.Random(9)
    texts = []
    for size, copies, share in ((120, 40, 0.05), (40, 12, 0.06), (12, 8, 0.08), (5, 6, 0.2)):
        base = prose(rng, size).split()
        texts += [" ".join(varied(rng, base, share)) for _ in range(copies)]
    passage = prose(rng, 60)
    texts += [passage + " " + prose(rng, 40) for _ in range(30)] + [prose(rng, 30) for _ in range(20)] + [passage] * 25
    texts += ["", None, "one", "ONE", "one\ttwo", " One  two ", "a b", prose(rng, 3000)]
    ids = random.Random(1).sample(range(1000), len(texts))
    d = docs(spark, texts, ids=ids)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(d, words=2).collect()}
    want = brute_groups(dict(zip(ids, texts)), 2)
    assert got == {k: (n, c, k == c) for k, (n, c) in want.items()}


def test_near_duplicate_rows(spark):
    d = docs(spark, ["a b c", "a b c", "a b c", "x y", None], ids=[5, 5, 3, None, 4])
    rows = sorted((r["doc_id"] or -1, r["component_id"], r["kept"]) for r in neardup.near_duplicates(d).collect())
    assert rows == [(-1, None, True), (3, 3, True), (4, 4, True), (5, 3, False), (5, 3, False)]
    assert sorted(str(r["doc_id"]) for r in neardup.keep_one(d).collect()) == ["3", "4", "None"]
    assert neardup.near_duplicates(d.limit(0)).count() == 0


def test_runs_miss_no_whole_set():
    # of two sets with I >= 4 B, two marks at each end leave a run of four
    rng = random.Random(0)
    for _ in range(3000):
        common = rng.randrange(1, 60)
        other = rng.randrange(0, common // 4 + 1)
        order = ["=="] * 2 + rng.sample(["="] * common + ["x"] * other, common + other) + ["=="] * 2
        assert max(len(list(g)) for k, g in itertools.groupby(order, lambda v: v != "x") if k) >= min(4, common + 4)
    assert neardup.run_length(0.8) == 4 and neardup.run_length(0.5) == 1


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(1, 50)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}
    find = lambda k: k if parent.setdefault(k, k) == k else find(parent[k])
    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    assert got == {k: find(k) for k in parent}


# 8. Passages


def test_repeats(spark):
    rng = random.Random(8)
    p, q = prose(rng, 60).split(), prose(rng, 70).split()
    near = lambda w: " ".join(varied(rng, w, 0.02))
    texts = ["Intro\n" + near(p), near(p) + "\nend", prose(rng, 90), " ".join(p[:45]), "x\n\n" + " ".join(q) + "\n" + prose(rng, 55), " ".join(q), " ".join(q) + "\n" + " ".join(q), None, ""]
    d = docs(spark, texts)
    rows = substring.repeats(d).collect()
    lines = {(i, k): line for i, t in enumerate(texts) for k, line in enumerate((t or "").split("\n")) if len(line.split()) >= 50}
    groups = brute_groups(lines, 5)
    sizes = defaultdict(int)
    for _, c in groups.values():
        sizes[c] += 1
    assert {(r["doc_id"], r["paragraph"]): (r["first_doc_id"], r["first_paragraph"]) for r in rows} == {k: c for k, (_, c) in groups.items() if sizes[c] > 1}
    assert all(texts[r["doc_id"]][r["start"] : r["end"]] == lines[r["doc_id"], r["paragraph"]] for r in rows)
    cut = {r["doc_id"]: r["text"] for r in substring.cut_repeats(d).collect()}
    assert cut[5] == "" and cut[7] is None and cut[2] == texts[2] and cut[4] == texts[4] and len(cut) == len(texts)
    assert substring.repeats(d.limit(0)).count() == 0
    bands, rows_ = substring.tuned(0.8)
    assert bands * rows_ <= substring.PERMUTATIONS and 1 - (1 - 0.8**rows_) ** bands >= substring.RECALL


def brute_runs(texts, n):
    """For each text the places of words that lie in a run of n words that occurs twice."""
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    words = {k: re.findall(r"[^\x20\x09-\x0D]+", lower(t)) for k, t in texts.items()}
    held = defaultdict(list)
    for k, w in words.items():
        for i in range(len(w) - n + 1):
            held[tuple(w[i : i + n])].append((k, i))
    out = defaultdict(set)
    for who in held.values():
        if len(who) > 1:
            for k, i in who:
                out[k].update(range(i, i + n))
    return out


def test_repeated_runs_wherever_lines_break(spark):
    rng = random.Random(18)
    p, q, r = (prose(rng, n).split() for n in (51, 120, 60))
    wrapped = lambda w, n: "\n".join(" ".join(w[i : i + n]) for i in range(0, len(w), n))
    texts = [
        prose(rng, 70) + " " + " ".join(p) + " " + prose(rng, 80), "x " + wrapped(p, 7) + "\n" + prose(rng, 9), " ".join(p[:50]), "one\n" + prose(rng, 5) + " " + " ".join(q) + " " + prose(rng, 5) + "\nend",
        wrapped(q[:70], 20).upper(), wrapped(q[40:], 11), " ".join(r), prose(rng, 40) + " " + " ".join(r), "Ä " + " ".join(r), None, "", "a " * 130, "b " * 50, prose(rng, 200),
    ]
    d = docs(spark, texts)
    want = brute_runs(dict(enumerate(texts)), 51)
    rows = substring.repeats(d).collect()
    got = defaultdict(set)
    for row in rows:
        places = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", texts[row["doc_id"]])]
        inside = [k for k, (a, z) in enumerate(places) if row["start"] <= a and z <= row["end"]]
        assert len(inside) == row["n_words"] and texts[row["doc_id"]][: row["start"]].count("\n") == row["paragraph"]
        got[row["doc_id"]].update(inside)
    assert set(want) == {0, 1, 3, 4, 5, 6, 7, 8, 11} and all(want[k] <= got[k] for k in want) and set(got) == set(want)
    assert {(row["doc_id"], row["first_doc_id"]) for row in rows if not row["kept"]} == {(1, 0), (4, 3), (5, 3), (7, 6), (8, 6), (11, 11)}
    cut = {row["doc_id"]: row["text"] for row in substring.cut_repeats(d).collect()}
    assert all(cut[k] == texts[k] for k in (0, 2, 3, 6, 9, 10, 12, 13))
    assert cut[1] == "x \n" + texts[1].split("\n")[-1] and cut[4] == cut[5] == "" and len(cut[7].split()) == 40 and len(cut[11].split()) == 51


def test_blocks_hold_every_window():
    rng = np.random.default_rng(4)
    for alphabet in (1, 2, 3, 1000):
        x = rng.integers(0, alphabet, 700).astype(np.uint64)
        x[300:500] = 0
        for run, gram in ((51, 17), (9, 3), (2, 1)):
            g = substring.grams(x, gram).view(np.int64)
            for sizes in ([700], [0, 100, 0, 30, 8, 1, 561, 0]):
                at, n, mark, _ = substring.blocks(x, np.array(sizes), run, gram)
                ends = np.cumsum(sizes)
                assert [s for a, k in zip(at, n) for s in range(a, a + k)] == [s for z, k in zip(ends, sizes) for s in range(z - k, z - run + 1)]
                of = np.repeat(mark, n)
                places = [s for a, k in zip(at, n) for s in range(a, a + k)]
                assert all(m == g[s : s + run - gram + 1].view(np.uint64).min().view(np.int64) for m, s in zip(of, places))
    assert len(substring.blocks(x[:50], np.array([50]), 51, 17)[0]) == 0


def test_laid_words():
    texts = ["", "one two\n three", " \n\né 😀x\r\ny\u00a0z ", "", "end", "\x0b"]
    laid = substring.Laid([t.encode() for t in texts])
    for k, t in enumerate(texts):
        found = list(re.finditer(r"[^\x20\x09-\x0D]+", t))
        at = np.arange(laid.base[k], laid.base[k] + laid.sizes[k])
        start, end = laid.spans(at, at, np.full(len(at), k))
        assert [m.span() for m in found] == list(zip(start.tolist(), end.tolist()))
        assert [t[: m.start()].count("\n") for m in found] == laid.line[at].tolist()
    assert len(laid.hashes()) == len(laid.start) and len(substring.Laid([]).hashes()) == 0 and len(substring.Laid([b"", b""]).start) == 0


def test_parts_of_batches():
    import pyarrow as pa

    entry = lambda k: [{"at": k, "to": k + 1}] * (k % 3)
    texts = [b"x" * n for n in (0, 5, 2 * substring.PART_BYTES, 7, substring.PART_BYTES - 7, 1)]
    batch = pa.RecordBatch.from_pydict({"text": texts, "equal": [entry(k) if k != 4 else None for k in range(6)]})
    parts = list(substring._parts([batch]))
    assert [len(p) for p in parts] == [2, 1, 2, 1] and [t for p in parts for t in p.column("text").to_pylist()] == texts
    got = [(int(r) + sum(map(len, parts[:n])), int(a)) for n, p in enumerate(parts) for r, a, _ in zip(*substring._entries(p.column("equal"), "at", "to"))]
    assert got == [(k, k) for k in range(6) for _ in entry(k) if k != 4]


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(6)
    x = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    sets = [x[:100], x[10:110], x[2000:2001], x[:2900], x[:2900], x[100:3000]]
    first = np.cumsum([0, *map(len, sets)])[:-1]
    sig = substring.signatures(np.concatenate(sets), first, substring._multipliers(256))
    same = lambda a, b: float((sig[a] == sig[b]).mean())
    assert abs(same(0, 1) - 90 / 110) < 0.12 and same(3, 4) == 1 and abs(same(3, 5) - 2800 / 3000) < 0.08 and same(0, 2) < 0.05


# 9. Ids


def test_encoder_is_the_library():
    from tokenizers import Tokenizer

    rng = random.Random(3)
    alphabet = list("aäñÉß  \n\t'sdlrev19_.,-…€²日👍́ \x1cİſ")
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(800)] + ["", " ", "<|endoftext|> don't  stop", "a<|EndOfText|>b", " <|startoftext|>x <|endoftext|> <|endoftext", "it's<|endoftext|>\n\nit's", "<|endoftext|>" * 3]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        t = Tokenizer.from_file(vocabulary(name))
        enc = tokens.Encoder(vocabulary(name))
        for text, got in zip(texts, enc.ids(texts)):
            assert np.frombuffer(got, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, (name, text)
    assert 50256 in np.frombuffer(tokens.Encoder(vocabulary("byte_bpe_50k.json")).ids(["a<|endoftext|>b"])[0], "<u4")


def test_token_files(spark, tmp_path):
    rng = random.Random(7)
    texts = [prose(rng, rng.randrange(1, 60)) for _ in range(80)] + ["", None, prose(rng, 20000), "twice", "twice", "other"]
    ids = [*range(100, 183), 7, 7, 7]
    d = docs(spark, texts, ids=ids).unionByName(docs(spark, ["nameless"], ids=[None]))
    path = str(tmp_path / "ids")
    made = tokenout.write(d, path, vocabulary("byte_bpe_50k.json"), shard_bytes=2000, block_bytes=60)
    rows = sorted(tokenout.read(spark, path).collect(), key=lambda r: r["start"])
    assert len(made["shards"]) > 2 and [r["doc_id"] for r in rows] == [None, 7, 7, 7, *range(100, 183)]
    enc, at, by = tokens.encoder(vocabulary("byte_bpe_50k.json")), 0, dict(zip(ids, texts))
    for r in rows:
        got = np.frombuffer(bytes(r["ids"]), "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(got), zlib.crc32(bytes(r["ids"]))) and got[-1] == 0
        at += len(got)
        if r["doc_id"] and r["doc_id"] != 7:
            assert bytes(r["ids"]) == enc.ids([by[r["doc_id"]] or ""])[0] + bytes(4)
    big = docs(spark, ["a", "b"], ids=[(1 << 62) + 1, None])
    tokenout.write(big, str(tmp_path / "big"), vocabulary("byte_bpe_50k.json"))
    assert {r["doc_id"] for r in tokenout.read(spark, str(tmp_path / "big")).collect()} == {(1 << 62) + 1, None}
    assert sum(s[1] for s in made["shards"]) > len(made["shards"]) and sum(s[2] for s in made["shards"]) == len(rows)
    assert len(tokenout.lookup(spark, path, 7)) == 3 and len(tokenout.lookup(spark, path, 150)) == 1 and tokenout.lookup(spark, path, 1) == []
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    for k in (100, 182, 120):
        assert tokenout.lookup(spark, path, k)[0].tolist() == [*library.encode(by[k] or "", add_special_tokens=False).ids, 0]
    assert tokenout.write(d.limit(0), str(tmp_path / "none"), vocabulary("byte_bpe_50k.json"))["shards"] == []
    assert tokenout.read(spark, str(tmp_path / "none")).count() == 0
    tokenout._put(spark, f"{path}/dictionary.zdict", b"other")
    with pytest.raises(ValueError, match="dictionary"):
        tokenout.lookup(spark, path, 7)


def test_hot_ids_are_split(spark, tmp_path):
    rng = random.Random(17)
    texts = ["same text"] * 300 + [prose(rng, 20) for _ in range(300)]
    d = docs(spark, texts, ids=[5] * 600).unionByName(docs(spark, texts[:400]).withColumn("doc_id", F.lit(None).cast("long")))
    made = tokenout.write(d.repartition(6), str(tmp_path / "hot"), vocabulary("byte_bpe_50k.json"), shard_bytes=1000)
    assert len(made["shards"]) > 8 and max(s[2] for s in made["shards"]) < 200 and sum(s[2] for s in made["shards"]) == 1000
    rows = tokenout.read(spark, str(tmp_path / "hot")).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [None] * 400 + [5] * 600 and all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(rows, rows[1:]))


# 10. Secrets


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(t):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32])


def test_secrets(spark):
    rng = random.Random(2)
    bits = ["😀", " ", "password", "Api_Key", "TOKEN", "=", ": ", '"', "'", "abc", "AKIA", "ABCD1234", "0123456789abcdef", "é", "-", "hunter2hunter2", "secret=token:abcdefghijk"]
    texts = ["".join(rng.choice(bits) for _ in range(25)) for _ in range(150)] + [None, "", "x" * 50_000 + " token=abcdefgh1"]
    key = "kJ8sQ2vX9zLm4TpR7wYbN3cH"
    texts += [f"the value {key} here", "someOrdinaryIdentifierName and another_long_identifier_name2", f"token={key} again"]
    d = docs(spark, texts).withColumns({"spans": F.lit("clash"), "base": F.lit(1)})
    ratios = secretscan.train(secretscan.labelled_samples(spark, d))
    got = {r["doc_id"]: r for r in secretscan.digest(secretscan.scan(d, ratios)).collect()}
    for i, t in enumerate(texts):
        want = base_spans(t or "")
        said = ",".join(f"{secretscan.KINDS[k]}:{a}:{z}" for a, k, z in want)
        assert got[i]["base_sha256"] == hashlib.sha256(said.encode()).hexdigest(), t
        assert [got[i][c] for c in ("n_assign", "n_access", "n_hex")] == [sum(w[1] == k for w in want) for k in range(3)]
        assert [s for s in got[i]["spans"].split(",") if s and not s.startswith("random")] == [s for s in said.split(",") if s]
    n = len(texts)
    assert got[n - 3]["spans"] == "random:10:34" and got[n - 2]["spans"] == "" and got[n - 1]["spans"] == "assign:0:30"
    assert [r["text"] for r in secretscan.scan(d, ratios).orderBy("doc_id").select("text").collect()] == texts
    assert secretscan.scan(d.limit(0), ratios).count() == 0
    assert secretscan.train(secretscan.labelled_samples(spark).limit(0)) == [0.0] * 16384


def test_random_runs_by_brute_force(spark):
    rng = random.Random(12)
    ratios = secretscan.train(secretscan.labelled_samples(spark))
    alphabets = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJ0123456789", "abcXYZ789+/_=-", "0123456789", "aeiou_")
    runs = ["".join(rng.choice(a) for _ in range(rng.randrange(1, 60))) for a in alphabets for _ in range(40)]
    texts = [" ".join(rng.sample(runs, 5) + rng.sample(["token=abcdefgh", "é😀", "AKIA" + "B" * 16, "0" * 40, "the cat"], 3)) for _ in range(120)]
    llr = lambda w: sum(ratios[ord(x) * 128 + ord(y)] for x, y in zip(w, w[1:]))
    got = {r["doc_id"]: r["spans"] for r in secretscan.digest(secretscan.scan(docs(spark, texts), ratios)).collect()}
    for i, t in enumerate(texts):
        base = base_spans(t)
        found = [(m.start(), 3, m.end()) for m in re.finditer(r"[A-Za-z0-9+/_=-]{12,}", t) if re.search("[A-Za-z]", m[0]) and llr(m[0]) > 0.5 * (len(m[0]) - 1) + 0.5 * max(0, 24 - len(m[0]))]
        found = [s for s in found if all(s[2] <= b[0] or b[2] <= s[0] for b in base)]
        assert got[i] == ",".join(f"{secretscan.KINDS[k]}:{a}:{z}" for a, k, z in sorted(base + found)), t


def test_random_strings_and_identifiers(spark):
    rng = random.Random(13)
    letters, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    kinds = {20: letters, 12: letters + letters.upper() + digits, 18: letters + digits, 19: letters.upper()}
    secrets = ["".join(rng.choice(a) for _ in range(n)) for n, a in kinds.items() for _ in range(100)]
    names = [rng.choice("_-").join(rng.choice(secretscan.WORDS) for _ in range(3)) for _ in range(200)] + ["".join(rng.choice(secretscan.WORDS).title() for _ in range(3)) for _ in range(200)]
    got = [r["n"] for r in secretscan.scan(docs(spark, secrets + names), secretscan.train(secretscan.labelled_samples(spark))).orderBy("doc_id").selectExpr("size(spans) AS n").collect()]
    assert sum(n > 0 for n in got[:400]) >= 360 and sum(got[400:]) <= 4


def test_long_runs_and_many_matches(spark):
    import time

    rng = random.Random(14)
    long_ = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEF0123456789") for _ in range(1_000_000))
    many = " ".join(f"token=abcdefgh{k}" for k in range(50_000))
    began = time.time()
    rows = secretscan.scan(docs(spark, [long_, many]), secretscan.train(secretscan.labelled_samples(spark))).orderBy("doc_id").selectExpr("size(base) AS b", "size(spans) AS s", "spans[0].end AS z").collect()
    assert [(r["b"], r["s"]) for r in rows] == [(0, 1), (50_000, 50_000)] and rows[0]["z"] == 1_000_000 and time.time() - began < 60


def test_native_operators_run_no_python(spark):
    d = docs(spark, ["a\nb", "token=abcdefgh"])
    for df in (linededup.drop_lines(d), secretscan.scan(d, [0.0] * 16384)):
        plan = df._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


# All of them: clashing names and very long texts


CLASH = ("_gone", "_doc", "_cut", "_stay", "_known", "_text", "text_hash", "node", "value", "component", "sketch", "_row", "start", "kept", "block", "mark", "lang_pred")


def test_clashing_names(spark, tmp_path):
    rng = random.Random(31)
    p = prose(rng, 60)
    plain = docs(spark, [p, p + " end", prose(rng, 30), None, "", p])
    d = plain.withColumns({c: F.lit(f"own {c}") for c in CLASH})
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    items = spark.createDataFrame([(1, prose(random.Random(1), 10))], "item_id long, text string")
    for f in (neardup.near_duplicates, substring.repeats, lambda x: packing.pack(x, vocabulary("word_bpe_49k.json")), lambda x: decontam.scan(x, items)):
        assert same(f(d), f(plain))
    for f in (neardup.keep_one, substring.cut_repeats, lambda x: decontam.clean(x, items)):
        rows = f(d)
        assert set(rows.columns) == set(d.columns) and same(rows.select(*plain.columns), f(plain)) and all(r[c] == f"own {c}" for r in rows.collect() for c in CLASH)
    tokenout.write(d, str(tmp_path / "ids"), vocabulary("byte_bpe_50k.json"))
    assert tokenout.read(spark, str(tmp_path / "ids")).count() == 6


def test_very_long_texts(spark):
    rng = random.Random(32)
    words = [f"x{rng.randrange(10**6)}" for _ in range(400_000)]
    item = words[200_000:200_012]
    passage = words[300_000:300_060]
    d = docs(spark, [" ".join(words), "a " + " ".join(item) + " b", "c\n" + "\n".join(passage) + "\nd", "y" * 2_000_000])
    hits = {r["doc_id"]: r["n_hit"] for r in decontam.scan(d, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()}
    assert hits == {0: 12, 1: 12, 2: 0, 3: 0}
    assert {r["doc_id"]: r["n_words"] for r in substring.repeats(d).collect()} == {0: 60, 2: 60}
    assert {r["doc_id"]: r["kept"] for r in neardup.near_duplicates(d).collect()} == {0: True, 1: True, 2: True, 3: True}
    net = langid.train([("a", "x1 x2 x3"), ("b", "the cat sat")] * 20)
    assert langid.predict(d, net).where("score between 0 and 1").count() == 4
