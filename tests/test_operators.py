import random

from pyspark.sql import functions as F

from lodestack.functions import text as T
from lodestack.operators import markdown, organize, parts, progress, sessions, statistics

LOG = """[10:00:00][T01] ▶ START a.md::images/1.png
[10:00:01][T02] ▶ START a.md::images/2.png
noise
[10:00:02][T01]   [ToolCall] AI wants +5up/-5down
[10:00:03][T01] ✓ [3.00s] DONE [IMG_TYPE: table]
[10:00:03][T01] ✓ [9.00s] DONE
[10:00:04][T02] ▶ START a.md::images/3.png
[10:00:05][T02][ERROR] ✗ [1.50s] FAILED HTTP 429 rate limit
[10:00:06][T1] ✓ [1.00s] DONE
[10:00:07][T01] ▶ START b.md::images/ä.png
[00:00][T01] ✓ [1.00s] DONE
[10:00:08] [1/3] images/1.png (from a.md)
[10:00:09][T00][WARNING] odd
[10:00:10] [2/3] images/2.png (from a.md)""".split("\n")


def log(spark, lines=LOG, file="x.log"):
    return spark.createDataFrame([(file, i, x) for i, x in enumerate(lines)], "file string, line_no long, value string")


def test_log_sessions(spark):
    found = sessions.log_sessions(log(spark))
    got = {(r["tid"], r["key"]): (r["status"], r["tool_calls"], r["elapsed"], r["error_type"], r["img_type"]) for r in found.collect()}
    assert got == {
        ("01", "a.md::images/1.png"): ("success", 1, 3.0, None, "table"), ("02", "a.md::images/2.png"): ("incomplete", 0, None, None, None),
        ("02", "a.md::images/3.png"): ("failed", 0, 1.5, "rate_limit", None), ("01", "b.md::images/ä.png"): ("incomplete", 0, None, None, None),
    }
    assert [r[0] for r in sessions.log_problems(log(spark)).collect()] == ["images/1.png"]
    timed = found.withColumn("start_seconds", T.seconds_of_day("start_ts"))
    w = statistics.wall_clock(timed).first()
    assert (w["wall_seconds"], w["success"]) == (5.5, 1)
    assert statistics.elapsed_stats(found).first()["stdev_elapsed"] == 0.0
    assert statistics.status_counts(found).first()["success_rate"] == 25.0
    assert [r["files"] if "files" in r else r["sessions"] for r in statistics.sessions_per_file(found).collect()] == [4]


def test_no_sessions(spark):
    none = sessions.log_sessions(log(spark, ["x"]))
    assert none.count() == 0
    assert statistics.status_counts(none).first()["total"] == 0
    assert statistics.elapsed_stats(none).count() == 0 and statistics.tool_call_stats(none).count() == 0
    assert statistics.elapsed_percentiles(none).first()["p95"] == 0.0


def model(events):
    """The sequential meaning of sessions."""
    open_, out = {}, []
    for user, _, kind, number in events:
        if kind == "start":
            if user in open_:
                out.append((user, open_[user][0], open_[user][1], "incomplete"))
            open_[user] = [number, 0]
        elif user in open_ and kind == "tool":
            open_[user][1] += 1
        elif user in open_ and kind in ("done", "failed"):
            out.append((user, *open_.pop(user), {"done": "success", "failed": "failed"}[kind]))
    return sorted(out + [(u, *s, "incomplete") for u, s in open_.items()])


def test_sessions_like_the_model(spark):
    rng = random.Random(3)
    events = [(rng.randrange(7), k, rng.choice(["start", "tool", "tool", "done", "failed", "other"]), k) for k in range(3000)]
    df = spark.createDataFrame(events, "u long, n long, kind string, key long").repartition(5)
    got = sessions.sessionise(df, ["u"], ["n"], "kind", "key", F.lit(1.0), F.lit(0), F.lit("x"))
    assert sorted((r["u"], r["key"], r["tool_calls"], r["status"]) for r in got.collect()) == model(events)


def test_running_and_ranks(spark):
    rows = spark.createDataFrame([("f", i) for i in range(250)], "f string, n long")
    shown = sessions.running_progress(rows, ["f"], ["n"], F.lit(True), F.lit(250)).collect()
    assert [r["percent"] for r in sorted(shown, key=lambda r: r["n"])] == list(range(101))
    named = spark.createDataFrame([("a", 3), ("a", 1), ("b", 2), (None, 5)], "name string, n long")
    assert sorted((r["name"] or "", r["n"]) for r in sessions.first_seen(named, "name", ["n"]).collect()) == [("", 5), ("a", 1), ("b", 2)]
    assert sorted((r["name"] or "", r["n"]) for r in sessions.latest_per_key(named, "name", ["n"]).collect()) == [("", 5), ("a", 3), ("b", 2)]
    a, b = (sorted(r["n"] for r in sessions.sample_n(rows, "n", 20, s).collect()) for s in (1, 2))
    assert len(a) == 20 and a != b and a == sorted(r["n"] for r in sessions.sample_n(rows.repartition(7), "n", 20, 1).collect())
    assert [r["worker"] for r in sessions.round_robin(rows, ["f"], ["n"], 3).orderBy("n").limit(4).collect()] == [1, 2, 3, 1]


def test_markdown(spark):
    text = "ä😀 ![x](images/x.png) und ![y](images/y.png)\n\nimages/z.png\r\n![x](images/x.png)"
    docs = spark.createDataFrame([("a", text), ("b", ""), ("c", None)], "name string, content string")
    refs = sorted((r["line_no"], r["number"], r["start"], r["end"], r["path"]) for r in markdown.references(docs, "name", "content").collect())
    assert [text[s:e] for _, _, s, e, _ in refs] == ["![x](images/x.png)", "![y](images/y.png)", "![x](images/x.png)"]
    assert {r["name"]: (r["refs"], r["distinct_refs"]) for r in markdown.reference_counts(docs, "name", "content").collect()} == {"a": (3, 2), "b": (0, 0), "c": (0, 0)}
    assert markdown.reference_total(docs, "content").first()["refs"] == 3
    assert [(r["line_no"], r["start"]) for r in markdown.line_table(docs.where("name = 'a'"), "name", "content").orderBy("line_no").collect()] == [(0, 0), (1, 45), (2, 46), (3, 60)]
    results = markdown.references(docs, "name", "content").withColumn("result", F.lit("R"))
    done = {r["name"]: r["content"] for r in markdown.spliced_documents(docs, "name", "content", results).collect()}
    assert done["a"].count("[AI] R") == 3 and "![" not in done["a"] and done["b"] == "" and done["c"] is None


def test_context(spark):
    docs = spark.createDataFrame([("\n".join("abcdef"),)], "t string")
    show = lambda c: docs.select(c).first()[0]
    assert show(markdown.context("t", F.lit(1), 2, 2)) == ["[L0] a", ">>>[IMG] b", "[L2] c", "[L3] d"]
    assert show(markdown.context_delta("t", F.lit(1), (0, 0), (1, 2))) == ["[L0] a", "[L2] c", "[L3] d"]
    assert show(markdown.context_delta("t", F.lit(1), (2, 9), (5, 9))) == []


def test_organize(spark):
    p = spark.createDataFrame([("s", 10, "c\n"), ("s", 2, "b  "), ("s", 1, " \n"), ("t", None, "x")], "subject string, part long, text string")
    got = {r["subject"]: (r["parts"], r["content"]) for r in organize.merged_parts(p).collect()}
    assert got == {"s": (2, "b\n\n---\n\nc"), "t": (1, "x")}
    names = spark.createDataFrame([("a",), ("a_part1",), ("b_part1",)], "name string")
    assert [r[0] for r in organize.part_conflicts(names).collect()] == ["a"]
    files = spark.createDataFrame([("x.png", "b/x.png"), ("x.png", "a/x.png")], "name string, path string")
    src = organize.image_sources(files)
    refs = spark.createDataFrame([("x.png", 1), ("y.png", 2)], "name string, n int")
    assert [r["path"] for r in organize.matched(refs, src).collect()] == ["a/x.png"] and [r["n"] for r in organize.missing(refs, src).collect()] == [2]
    docs, res = spark.createDataFrame([("a.md",), ("a",)], "name string"), spark.createDataFrame([("a.md::x",), ("a.mdx::y",), ("a",)], "key string")
    assert [(r["name"], r["key"]) for r in organize.results_of_documents(docs, res).collect()] == [("a.md", "a.md::x")]
    ins, have = spark.createDataFrame([("in/a.docx",), ("in/b.docx",)], "path string"), spark.createDataFrame([("out/a_part1.pdf",), ("out/b.pdf",)], "path string")
    assert [r[0] for r in organize.unsplit(ins, have).collect()] == ["in/b.docx"]


def test_progress(spark):
    items = spark.createDataFrame([("a", "[IMG_TYPE: t]", 1), ("b", "__INVALID_RESPONSE__", 1), ("c", None, 1), ("d", "[IMG_ERROR: x]", 1)], "key string, result string, seq int")
    tasks = spark.createDataFrame([("a",), ("b",), ("b",), ("e",)], "key string")
    assert sorted(r[0] for r in progress.pending(tasks, items).collect()) == ["b", "b", "e"]
    c = progress.counts(items, 3).first()
    assert (c["completed"], c["invalid"], c["remaining"]) == (1, 3, -1)
    new = spark.createDataFrame([("b", "[IMG_TYPE: u]", 2)], "key string, result string, seq int")
    assert {r["key"]: r["result"] for r in progress.upserted(items, new).collect()}["b"] == "[IMG_TYPE: u]"
    g = progress.good_rate(spark.createDataFrame([("x",), ("y",)], "path string"), spark.createDataFrame([("y",), ("z",)], "path string")).first()
    assert (g["completed"], g["bad"], g["good_rate"]) == (2, 1, 50.0)


def greedy(sizes, pages, most):
    out, part, n, s = [], 0, 0, 0.0
    for x in sizes:
        if part == 0 or n >= pages or (most > 0 and s + x > most):
            part, n, s = part + 1, 0, 0.0
        n, s = n + 1, s + x
        out.append(part)
    return out


def test_parts(spark):
    rng = random.Random(1)
    rows = [(i, [float(rng.randrange(0, 30)) for _ in range(rng.randrange(0, 40))]) for i in range(30)] + [(99, [100.0, 1.0, 100.0])]
    df = spark.createDataFrame(rows, "k long, sizes array<double>")
    for pages, most in ((5, 40.0), (200, 50.0), (3, 0.0)):
        got = {(r["k"], r["part"]): (r["first_page"], r["pages"], r["size"]) for r in parts.greedy_parts(df, "k", "sizes", pages, most).collect()}
        want = {}
        for k, s in rows:
            for page, part in enumerate(greedy(s, pages, most)):
                first, n, size = want.get((k, part), (page + 1, 0, 0.0))
                want[k, part] = (first, n + 1, size + s[page])
        assert got == want
    assert [r[0] for r in spark.createDataFrame([(0,), (100,), (101,)], "p int").select(parts.route("p")).collect()] == ["convert", "keep", "convert"]
    files = spark.createDataFrame([("in/b.PDF",), ("in/.x.pdf",), ("in/a.docx",), ("in/a.txt",)], "path string")
    assert [r["path"] for r in parts.to_split(files).collect()] == ["in/b.PDF", "in/a.docx"]


def test_long_texts_cost_in_proportion(spark):
    import time

    text = "\n".join(f"line {k} ![x](images/{k}.png)" for k in range(60_000))
    docs = spark.createDataFrame([("a", text), ("b", ""), ("c", None), ("d", "x")], "k string, t string")
    began = time.time()
    assert {r["k"]: r["n"] for r in markdown.line_table(docs, "k", "t").groupBy("k").agg(F.count("*").alias("n")).collect()} == {"a": 60_000, "b": 1, "d": 1}
    refs = markdown.references(docs, "k", "t")
    assert all(text[r["start"] : r["end"]] == f"![x]({r['path']})" for r in refs.where("line_no % 5000 = 7").collect())
    sizes = spark.createDataFrame([("a", [1.0] * 60_000)], "k string, sizes array<double>")
    assert parts.greedy_parts(sizes, "k", "sizes", 200, 0.0).count() == 300 and time.time() - began < 40


def test_exact_quantiles(spark):
    rng = random.Random(5)
    for values in ([], [3.0], [1.0] * 50, [rng.random() for _ in range(1001)], [float(rng.randrange(4)) for _ in range(200)] + [1e300, -1e300]):
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
        got = statistics.exact_quantiles(df, "v", (0.0, 0.5, 0.95, 1.0)).first()
        for k, share in enumerate((0.0, 0.5, 0.95, 1.0)):
            if not values:
                assert got[k] is None
                continue
            place, x = (len(values) - 1) * share, sorted(values)
            low, high = x[int(place)], x[min(int(place) + 1, len(x) - 1)]
            assert abs(got[k] - (low + (high - low) * (place - int(place)))) <= 1e-9 * max(1.0, abs(got[k]))


def test_segments_of_one_key(spark):
    """However a key's rows are cut, the sessions, blocks and percents are those of the whole."""
    rng = random.Random(17)
    rows = [(rng.choice(["a", None]), k, rng.choice(["start", "tool", "tool", "done", "failed", "other"]), rng.random() < 0.1, rng.choice([0, 7, 40])) for k in range(400)]
    df = spark.createDataFrame(rows, "k string, n long, kind string, flag boolean, total long").cache()
    told = lambda x: sorted(map(str, x.collect()))
    of = {
        "sessions": lambda seg: sessions.sessionise(df, ["k"], ["n"], "kind", "n", F.col("n") / 2, "n", "kind", segment=seg),
        "blocks": lambda seg: sessions.problem_blocks(df, ["k"], ["n"], F.when(F.col("kind") == "start", F.col("n")), "flag", seg),
        "progress": lambda seg: sessions.running_progress(df, ["k"], ["n"], F.col("kind") != "other", "total", seg),
    }
    for name, f in of.items():
        whole = told(f(None))
        assert len(whole) > 20 and all(told(f(F.expr(f"n div {size}"))) == whole for size in (1, 7, 100, 1000)), name


def test_one_thread_runs_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(sessions, "SEGMENT_LINES", 50)
    value = F.format_string("[10:00:00][T01] %s", F.when(F.col("id") % 5 == 0, F.format_string("▶ START d::images/%d.png", "id")).when(F.col("id") % 5 == 4, "✓ [1.5s] DONE [IMG_TYPE: table]").otherwise("  [ToolCall] AI wants +5up/-5down"))
    lines = spark.range(5000).select(F.lit("one.log").alias("file"), F.col("id").alias("line_no"), value.alias("value"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = sessions.log_sessions(lines)
        assert found.count() == 1000 and found.where("status = 'success' and tool_calls = 3").count() == 1000
        dealt = sessions._carried(sessions.log_events(lines).withColumn("_segment", F.expr("line_no div 50")), ["file", "tid"], {"_n": F.count(F.lit(1))}, {"_b": lambda w: F.sum("_n").over(w)})
        sizes = [r["count"] for r in dealt.repartition("file", "tid", "_segment").groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) == 4 and max(sizes) < 2500
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_quantiles_of_groups(spark):
    """A hot group, null groups, ties, one value, no value: as numpy has them, and the hot group's values are sorted in many tasks."""
    import numpy as np

    rng = random.Random(23)
    rows = [("hot", round(rng.gauss(0, 9), 2)) for _ in range(6000)] + [(None, float(rng.randint(0, 3))) for _ in range(500)] + [("one", 5.0), ("none", None), ("two", 1.0), ("two", 2.0)] + [("same", 7.0)] * 900
    df = spark.createDataFrame(rows, "g string, v double")
    counts = statistics.value_counts(df, ["g"], "v")
    got = {r["g"]: r for r in statistics.quantiles(counts, ["g"], (0.0, 0.5, 0.95, 1.0)).collect()}
    assert set(got) == {"hot", None, "one", "two", "same"}
    for g, r in got.items():
        want = np.quantile([v for k, v in rows if k == g and v is not None], [0.0, 0.5, 0.95, 1.0])
        assert np.allclose([r[f"q{k}"] for k in range(4)], want, atol=1e-12), g
    assert statistics.quantiles(counts.limit(0), ["g"], (0.5,)).count() == 0


def test_polls_pass_by(spark):
    """A fold over sorted batches shows what the fold over each key's array does, at any batch size."""
    from lodestack.functions import policy

    rng = random.Random(29)
    rows = [(rng.choice(["a", "b", None]), k, rng.choice([None, *[float(k)] * 9]), rng.choice([None, *range(0, 60)]), rng.choice(["running"] * 30 + ["done"])) for k in range(900)]
    df = spark.createDataFrame(rows, "k string, n long, at double, pages long, state string")
    polls = df.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("n", "at", "pages", "state"))).alias("p"))
    want = sorted(map(str, polls.select("k", F.explode(F.transform(policy.emitted_polls("p", 30), lambda x: x.cast("long"))).alias("place")).collect()))
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    try:
        for n in ("7", "10000"):
            spark.conf.set(size, n)
            assert sorted(map(str, progress.shown_polls(df, ["k"], ["n"], "at", "pages", "state", 30).collect())) == want
    finally:
        spark.conf.set(size, before)
    assert len(want) > 30 and progress.shown_polls(df.limit(0), ["k"], ["n"], "at", "pages", "state", 30).count() == 0


def test_measured_parts(spark):
    """Parts by their compressed bytes are those of a plain search page by page, in few measurements."""
    rng = random.Random(37)
    rows = [(d, p, None if rng.random() < 0.02 else bytes(rng.randrange(256) for _ in range(rng.choice([0, 5, 40, 300]))) if p % 7 else b"same " * 60) for d in ("a", "b", None) for p in range(180)]
    rows.append(("huge", 0, bytes(rng.randrange(256) for _ in range(5000))))
    df = spark.createDataFrame(rows, "d string, p int, raw binary")
    for most, limit in ((200, 1500.0), (7, 1500.0), (30, 0.0)):
        want = set()
        for d in ("a", "b", None, "huge"):
            pages, first, part = [r[2] or b"" for r in sorted((r for r in rows if r[0] == d), key=lambda r: r[1])], 0, 0
            while first < len(pages):
                n = 1
                while n < most and first + n < len(pages) and (limit <= 0 or parts.compressed_size(pages[first : first + n + 1]) <= limit):
                    n += 1
                part += 1
                want.add((d, part, first + 1, n, parts.compressed_size(pages[first : first + n])))
                first += n
        got = parts.measured_parts(df, "d", "p", "raw", parts.compressed_size, most, limit).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want), (most, limit)
    assert parts.measured_parts(df.limit(0), "d", "p", "raw", parts.compressed_size).count() == 0
    for n in range(1, 70):
        asked = []
        assert parts.longest_run(lambda k: asked.append(k) or k, 1000, n) == n and len(asked) <= 14
