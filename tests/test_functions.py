import random
import time

import pytest
from pyspark.sql import functions as F

from lodestack.functions import policy
from lodestack.functions import text as T


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).first()["x"]


def value(spark, f, x):
    return spark.createDataFrame([(x,)], "v string").select(f("v").alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("f", "given", "wanted"),
    [
        (T.log_time, "[19:26:30][T01] x", "19:26:30"), (T.log_time, "19:26:30 x", None), (T.log_time, None, None),
        (T.log_thread, "[19:26:30] a [T007]", "007"), (T.log_thread, "[19:26:30] a", "0"),
        (T.log_content, "[19:26:30]  a \t\r", " a"), (T.started_key, "[19:26:30][T1] ▶ START a.md::images/x.png", "a.md::images/x.png"),
        (T.started_key, "[19:26:30] ▶ START a", None), (T.error_class, "Connection refused", "connection_timeout"), (T.error_class, "HTTP 429 timeout", "connection_timeout"),
        (T.error_class, "rate\u0085 limit", "rate_limit"), (T.error_class, "", "unknown"), (T.right_trimmed, " a \t\r\n", " a"), (T.number_or_zero, "1.5", 1.5), (T.number_or_zero, "x", 0.0),
        (T.seconds_of_day, "01:01:01", 3661.0), (T.seconds_of_day, "25:61:00", None), (T.split_thread, "[a][T3] x", "T3"), (T.split_thread, "x", "T00"),
        (T.without_prefix, "[19:26:30][T01]  x", "x"), (T.header_path, "[3/9] images/A.PNG (from a.md)", "images/A.PNG"), (T.header_path, "images/a.png", None),
        (T.image_refs, "![a](images/x.png) ![](images/y.JPG)\n![b](images/z.webp)", ["images/x.png", "images/z.webp"]),
        (T.valid_result, "[IMG_TYPE: t] x", True), (T.valid_result, "__INVALID_RESPONSE__", False), (T.valid_result, None, False),
        (T.safe_name, "images/a\\b.png", "images_a_b.png.json"), (T.stem, "x/a.tar.gz", "a.tar"), (T.image_file, "images/a/b.png", "a/b.png"),
        (T.supported, "x/A.PDF", True), (T.supported, "x/a.txt", False), (T.label, "running", "解析中"), (T.label, "other", "other"),
        (T.percentile_list, "95, 90,95,0,100,x", [95, 90]), (policy.transport_class, "429", "rate_limit"), (policy.transport_class, "TLS handshake", "connection"), (policy.transport_class, None, "api"),
    ],
)
def test_text(spark, f, given, wanted):
    assert value(spark, f, given) == wanted


def test_done_and_failed(spark):
    d = value(spark, T.done, "[19:26:30][T1] ✓ [3.12s] DONE [IMG_TYPE: table]")
    assert (d["elapsed"], d["img_type"]) == (3.12, "table")
    assert value(spark, T.done, "[19:26:30][T1] x") is None
    f = value(spark, T.failed, "[19:26:30][T1][ERROR] ✗ [0.5s] FAILED boom")
    assert (f["elapsed"], f["message"]) == (0.5, "boom")


def test_names_and_offsets(spark):
    p = value(spark, T.part_of, "a_part2_part10")
    assert (p["subject"], p["part"]) == ("a_part2", 10)
    assert value(spark, T.part_of, "a")["part"] is None
    k = value(spark, T.key_parts, "a.md::b::c")
    assert (k["document"], k["path"]) == ("a.md", "b::c")
    assert value(spark, T.key_parts, "a.md") is None
    assert one(spark, T.line_index(F.lit("ä😀\nb\nc"), F.lit(5))) == 2
    assert one(spark, T.short_key(F.lit("m::" + "x" * 60))) == "x" * 50
    assert one(spark, T.preview(F.lit("abcdef"), 3)) == "abc..."
    assert one(spark, T.rewritten_paths(F.lit("![a](images/x.png) images/y"), F.lit("s"))) == "![a](images/s/x.png) images/s/y"
    assert one(spark, T.rewritten_paths(F.lit("images/y"), F.lit("s"))) == "images/y"
    assert [one(spark, T.padded_thread(F.lit(7), n)) for n in (5, 200)] == ["07", "007"]
    assert one(spark, T.percent(F.lit(1), F.lit(0))) == 0.0
    r = one(spark, T.resized(F.lit(2560), F.lit(1)))
    assert (r["width"], r["height"]) == (1280, 1)
    assert one(spark, T.estimated_pages(F.lit(11))) == 2


def test_splice(spark):
    text = "a ![x](images/x.png) b ![y](images/y.png)"
    rows = [(text, [(2, 20, "images/x.png", "X"), (23, 41, "images/y.png", "Y")])]
    df = spark.createDataFrame(rows, "t string, r array<struct<start:int,end:int,path:string,result:string>>")
    block = lambda p, r: f"\n\n<!-- IMG: {p} -->\n[AI] {r}\n\n<!-- /IMG -->\n\n"
    assert df.select(T.spliced("t", "r")).first()[0] == f"a {block('images/x.png', 'X')} b {block('images/y.png', 'Y')}"


def spliced_by_hand(text, reps):
    out, end = "", 0
    for a, z, p, r in reps:
        out, end = out + text[end:a] + f"\n\n<!-- IMG: {p} -->\n[AI] {r}\n\n<!-- /IMG -->\n\n", z
    return out + text[end:]


def test_splice_at_edges_of_blocks(spark):
    """Places at, before and after the edges of blocks, of texts of any code points, line ends among them."""
    some, rows = random.Random(5), [("", [(0, 0, "p", "R")]), ("x" * T.BLOCK, [(T.BLOCK, T.BLOCK, "p", "R")]), ("x" * 3 * T.BLOCK, []), ("abc", [(0, 3, "p", "R")])]
    for n in (1, T.BLOCK - 1, T.BLOCK, T.BLOCK + 1, 5 * T.BLOCK + 3):
        for _ in range(8):
            text = "".join(some.choices("aä😀\n\r\u2028", k=n))
            edges = [e for e in (0, 1, T.BLOCK - 1, T.BLOCK, T.BLOCK + 1, 2 * T.BLOCK, 4 * T.BLOCK, n) if e <= n]
            at = sorted(some.choices(edges, k=4) + some.choices(range(n + 1), k=6))
            rows.append((text, [(a, z, f"{k}", f"R{k}") for k, (a, z) in enumerate(zip(at[::2], at[1::2]))]))
    # replacements are put by their places, so given in any order
    df = spark.createDataFrame([(k, t, some.sample(r, len(r))) for k, (t, r) in enumerate(rows)], "k int, t string, r array<struct<start:int,end:int,path:string,result:string>>")
    got = {r["k"]: r["x"] for r in df.select("k", T.spliced("t", "r").alias("x")).collect()}
    assert [got[k] for k in range(len(rows))] == [spliced_by_hand(t, sorted(r)) for t, r in rows]


def test_splice_of_many_in_one_text(spark):
    """Its time grows with the text and its replacements, not with their product."""
    refs = [f"p{k}![x](images/{k % 5}.png)" for k in range(40_000)]
    text, reps, at = "\n".join(refs), [], 0
    for x in refs:
        reps.append((at + x.index("!"), at + len(x), "p", "R"))
        at += len(x) + 1
    df = spark.createDataFrame([(text, reps)], "t string, r array<struct<start:int,end:int,path:string,result:string>>").cache()
    df.count()
    began = time.monotonic()
    assert df.select(T.spliced("t", "r")).first()[0] == spliced_by_hand(text, reps)
    assert time.monotonic() - began < 20


@pytest.mark.parametrize(
    ("result", "fix", "wanted"),
    [
        ("  [IMG_TYPE: t] x ", None, ("[IMG_TYPE: t] x", "ok")), ("Well [IMG_TYPE: t] x", None, ("[IMG_TYPE: t] x", "ok")), ("[IMG_ERROR: x]", "[IMG_TYPE: t]", ("[IMG_ERROR: x]", "error")),
        ("plain", "so [IMG_TYPE: t] y", ("[IMG_TYPE: t] y", "ok")), ("plain", "no", ("__INVALID_RESPONSE__", "retry")), (None, None, ("__INVALID_RESPONSE__", "retry")),
    ],
)
def test_normalised(spark, result, fix, wanted):
    df = spark.createDataFrame([(result, fix)], "r string, f string")
    assert tuple(df.select(policy.normalised_result("r", F.col("f")).alias("n")).first()["n"]) == wanted


def test_policy(spark):
    assert [one(spark, policy.backoff(F.lit("rate_limit"), F.lit(n))) for n in (0, 4, 90)] == [2.0, 32.0, 60.0]
    assert [one(spark, policy.throttle(F.lit(n))) for n in (0, 9)] == [3.0, 64.0]
    assert one(spark, policy.grown_window(F.array(*map(F.lit, (5, 500, -3))), 30, 200)) == 30 + 5 + 200 - 3
    out = lambda *o: tuple(one(spark, policy.retried(F.array(*map(F.lit, o)))))
    assert out("rate_limit", "ok", "ok") == (2, 2.0, True)
    assert out("api", "connection", "api", "ok") == (4, 14.0, True)
    assert out("api", "api", "api", "api", "ok") == (4, 6.0, False)
    rounds = spark.createDataFrame([([(1, ""), (1, None), (0, " a ")],), ([(1, ""), (2, ""), (1, ""), (0, "")],)], "r array<struct<calls:int,text:string>>")
    assert [tuple(r[0]) for r in rounds.select(policy.tool_rounds("r", 3)).collect()] == [(3, "a"), (4, "[IMG_EMPTY_RESPONSE]")]
    polls = [(float(t), p, "running") for t, p in ((0, 0), (1, 1), (3, 2), (5, 3), (10, 3), (11, 20))] + [(12.0, 20, "done")]
    df = spark.createDataFrame([(polls,)], "p array<struct<at:double,pages:long,state:string>>")
    assert df.select(policy.emitted_polls("p", 10)).first()[0] == [1, 3, 5, 6, 7]
    act = lambda *a: one(spark, policy.resume_action(*[F.lit(x).cast(t) for x, t in zip(a, ("string", "boolean", "string", "string"))]))
    assert [act("done", True, "b", None), act("done", False, "b", "done"), act("running", False, "b", "done"), act("timeout", False, "b", "running"), act("running", False, "b", None), act(None, False, None, None)] == ["skip", "submit", "download", "poll", "resubmit", "submit"]
    said = [one(spark, policy.prompt(F.lit("{MAX_TOOL_CALLS} {OUTPUT_LANG}"), 3, F.lit(x).cast("string"))) for x in ("", None, "en", "英文", "German")]
    assert said == ["3 Chinese", "3 Chinese", "3 English", "3 English", "3 German"]
    contents = {'"a \\"b\\" \\n"': 'a "b" \n', "null": "", None: "", '[{"x": 1}]': '[{"x": 1}]'}
    assert [value(spark, policy.content_text, x) for x in contents] == list(contents.values())
