import io
import json
import os
import re
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from lodestack.operators import organize, sessions
from lodestack.plans import parse, registry_more, report, workflow
from lodestack.sources import config, connectors, files, sinks
from lodestack.streaming import logs

from test_operators import LOG


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs/img2text_20240102_000000.log").write_text("\n".join(LOG), encoding="utf-8")
    (tmp_path / "logs/img2text_20240101_000000.log").write_bytes("\r\n".join(LOG[:5]).encode())
    (tmp_path / "logs/img2text_errors_20240109_000000.log").write_text("2024-01-09 00:00:00 [ERROR] x")
    old = time.time() - 1000
    os.utime(tmp_path / "logs/img2text_20240101_000000.log", (old, old))
    return tmp_path


def test_report_of_many_threads(spark):
    """All threads by their numbers, also those after the first ten thousand and beyond the range of an int."""
    n = 12_000
    s = spark.range(n).select((F.col("id") + (1 << 31) - 5).cast("string").alias("tid"), F.lit("success").alias("status"), F.lit(1.5).alias("elapsed"), F.lit(1).alias("tool_calls"), F.lit("k").alias("key"), F.lit(None).cast("string").alias("error_type"), F.lit("00:00:00").alias("start_ts"), F.lit(1).alias("session"))
    want = [f"tid={k + (1 << 31) - 5}" for k in range(n)]
    said = report.session_report(s, threads=True).split("Threads:\n")[1].split("\n")
    assert [x.split()[0] for x in said] == want
    lines = report.numbered(report.lines_of(report.by_thread(s))).orderBy("place").collect()
    assert [r["place"] for r in lines] == list(range(1, n + 1)) and [r["line"] for r in lines] == said


def test_logs(spark, folder, capsys):
    found = files.listing(spark, str(folder / "logs"))
    name = lambda df: [r["path"].rsplit("/", 1)[1] for r in df.collect()]
    assert name(files.resolved_logs(found)) == ["img2text_20240102_000000.log"]
    assert len(name(files.resolved_logs(found, everything=True))) == 2
    assert name(files.resolved_logs(found, ["img2text_20240101_000000.log"])) == ["img2text_20240101_000000.log"]
    path = str(folder / "logs/img2text_20240101_000000.log")
    assert name(files.resolved_logs(found, [path])) == name(files.resolved_logs(found, ["file://" + path])) == ["img2text_20240101_000000.log"]
    lines = files.log_lines(spark, *[r["path"] for r in files.resolved_logs(found, everything=True).collect()])
    assert [r["value"] for r in lines.where("file like '%20240102%'").orderBy("line_no").collect()] == LOG
    assert lines.where("value like '%\\r'").count() == 0
    s = sessions.log_sessions(lines)
    assert s.groupBy("file").count().count() == 2 and s.count() == 6
    sinks.write_session_csv(s, str(folder / "csv"))
    back = spark.read.csv(str(folder / "csv"), header=True)
    assert tuple(back.columns) == sinks.SESSION_COLUMNS and back.count() == 6
    sinks.write_thread_logs(lines, str(folder / "threads"))
    first = spark.read.text(str(folder / "threads/log=img2text_20240102_000000/tid=T01"))
    assert [r[0] for r in first.collect()] == [x for x in LOG if "][T01]" in x]
    text = report.session_report(s, threads=True, wall=s.withColumn("start_seconds", F.lit(0.0)))
    assert "Threads:" in text and "rate_limit" in text
    assert workflow.main(["analyze", str(folder / "logs"), "-o", str(folder / "csv2")]) == 0 and "Sessions:" in capsys.readouterr().out
    assert workflow.main(["splitlog", str(folder / "logs"), "--output-dir", str(folder / "t2")]) == 0


def test_parts_and_markdown(spark, tmp_path):
    for name, text in {"s_part2": "b", "s_part10": "c", "s_part1": " ", "t": "T"}.items():
        (tmp_path / name / "images").mkdir(parents=True)
        (tmp_path / name / "full.md").write_text(text)
        (tmp_path / name / "images/x.png").write_bytes(b"png")
    merged = organize.merged_parts(files.parsed_parts(spark, str(tmp_path)))
    assert {r["subject"]: r["content"] for r in merged.collect()} == {"s": "b\n\n---\n\nc", "t": "T"}
    images = files.image_files(files.listing(spark, str(tmp_path)))
    assert organize.image_sources(images).collect()[0]["path"].endswith("s_part1/images/x.png")
    assert organize.folder_summary(files.listing(spark, str(tmp_path))).count() == 8
    (tmp_path / "a.md").write_text("A\nB")
    assert [tuple(r) for r in files.markdown(spark, str(tmp_path)).collect()] == [("a.md", "A\nB")]
    assert [r["name"] for r in files.of_formats(files.listing(spark, str(tmp_path)), "md").collect()].count("a.md") == 1


def test_items(spark, tmp_path):
    deep = tmp_path / "a" / "b"
    deep.mkdir(parents=True)
    (deep / "x.json").write_text(json.dumps({"key": "a::x", "result": "[IMG_TYPE: t]", "start": 1, "end": 2, "img_path": "x", "more": 1}, indent=1))
    (deep / "y.json").write_text("{broken")
    items = files.progress_items(spark, str(tmp_path)).cache()
    assert items.count() == 2 and items.where("_corrupt is null").count() == 1
    assert "completed=1" in report.progress_report(items, 5)
    legacy = spark.createDataFrame([(json.dumps({"a::x": {"result": "r"}, "b": {"result": "s"}, "a::b::c": {"result": "t"}}),)], "value string")
    assert [(r["key"], r["result"]) for r in files.legacy_items(legacy).collect()] == [("a::x", "r")]
    kept = items.where("_corrupt is null").drop("_corrupt")
    sinks.write_items(kept, str(tmp_path / "out"))
    assert json.loads((tmp_path / "out/a/x.json").read_text())["result"] == "[IMG_TYPE: t]"  # the layout of other tools: document, safe name
    more = spark.createDataFrame([("a::x", "new", 1), ("a::y", "old", 0), ("a::y", "new", 5), ("b::z", "r", 0)], "key string, result string, seq int")
    sinks.write_items(more, str(tmp_path / "out"), order="seq")
    sinks.write_items(more.where("key = 'b::z'").drop("seq").withColumn("result", F.lit("s")), str(tmp_path / "out"))
    assert {r["key"]: r["result"] for r in files.progress_items(spark, str(tmp_path / "out")).collect()} == {"a::x": "new", "a::y": "new", "b::z": "s"}
    (tmp_path / "st").mkdir()
    (tmp_path / "st/a_task.json").write_text(json.dumps({"file": "a", "batch_id": "1", "status": "done"}))
    (tmp_path / "st/b_task.json").write_text("nothing")
    assert [r["file"] for r in files.task_states(spark, str(tmp_path / "st")).collect()] == ["a"]


def test_archives(spark, tmp_path):
    def packed(**entries):
        raw = io.BytesIO()
        with zipfile.ZipFile(raw, "w") as z:
            for k, v in entries.items():
                z.writestr(k.replace("__", "/"), v)
        return raw.getvalue()

    rows = [("a.docx", packed(**{"docProps/app.xml": "<Pages>12</Pages>"})), ("b.docx", packed(x="y")), ("c.docx", b"no zip")]
    df = spark.createDataFrame(rows, "path string, content binary")
    assert {r["path"]: r["pages"] for r in files.office_pages(df).collect()} == {"a.docx": 12, "b.docx": 0, "c.docx": 0}
    assert [r["entry"] for r in files.unzipped(df.where("path = 'b.docx'")).collect()] == ["x"]
    bad = spark.createDataFrame([("z", packed(**{"../x": "y"}))], "path string, content binary")
    with pytest.raises(Exception, match="leads out"):
        files.unzipped(bad).collect()


def test_config(tmp_path):
    c = config.Config.of({"options": {"format_fix_attempts": 0, "window_up": None}})
    assert c.options["format_fix_attempts"] == 0 and c.options["window_up"] == 30 and c.model["concurrency"] == 10
    assert config.Config.load(c.template()).options == c.options
    assert config.percentiles("95,90,95,0,x") == [95, 90]
    assert (config.seed(""), config.seed("7"), config.seed("x")) == (42, 7, 42)
    assert workflow.main(["init", "--output", str(tmp_path / "c.json")]) == 0
    ran = []
    with pytest.raises(RuntimeError):
        workflow.run([("split", lambda: ran.append(1)), ("parse", lambda: (_ for _ in ()).throw(RuntimeError())), ("organize", lambda: ran.append(2))], said=lambda _: None)
    assert ran == [1]


def test_lines_of_split_files(spark, tmp_path):
    text = "\n".join(f"{k} é" for k in range(5000)) + "\n"
    for name in ("a b+c%.log", "d.log"):
        (tmp_path / name).write_text(text, encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7001")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        lines = files.log_lines(spark, str(tmp_path))
        assert lines.where("value = concat(line_no, ' é')").count() == 10_000 == lines.select("file", "line_no").distinct().count()
        assert {r["file"].rsplit("/", 1)[1] for r in lines.select("file").distinct().collect()} == {"a b+c%.log", "d.log"}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_written_documents_are_read(spark, tmp_path):
    docs = spark.createDataFrame([("a b", "A\n\nB"), ("ü+%.md", "C\n"), ("x/full", "D")], "name string, content string")
    for _ in range(2):
        sinks.write_documents(docs, str(tmp_path / "out"))
    assert [tuple(r) for r in files.markdown(spark, str(tmp_path / "out")).collect()] == [("a b.md", "A\n\nB\n"), ("ü+%.md", "C\n")]
    assert (tmp_path / "out/x/full.md").read_text() == "D\n" and not [p for p in os.listdir(tmp_path / "out") if p.startswith("_")]
    listed = files.listing(spark, str(tmp_path / "out"), "*.md").select("path", F.concat(F.lit("copy/"), "name").alias("target"))
    assert sinks.copied(listed, str(tmp_path / "there")) == 3 and (tmp_path / "there/copy/a b.md").read_text() == "A\n\nB\n"


def test_vision_is_given_whole_texts(spark, tmp_path, monkeypatch):
    """The query's conversations hold all lines of a text, and a model that asks for them is shown those beyond the fiftieth."""

    class Reader(connectors.FakeVision):
        def complete(self, request):
            said = super().complete(request)
            if "content" in said:
                shown = re.findall(r"\[L\d+\] (w\d+)", str(request["messages"]))
                said["content"] += f" {shown[-1] if shown else None}"
            return said

    seen, described = [], connectors.described
    monkeypatch.setattr(connectors, "FakeVision", Reader)
    monkeypatch.setattr(connectors, "described", lambda rows, *a, **k: (seen.extend(rows.collect()), described(rows, *a, **k))[1])
    n = {0: 400, 1: 60, 2: 51, 4: 5000}
    docs = spark.createDataFrame([(k, "\n".join(f"w{i}" for i in range(m))) for k, m in n.items()] + [(5, None)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["result"] for r in registry_more.vision_service(spark, str(tmp_path)).collect()}
    assert {int(r["key"]): r["lines"] for r in seen} == {k: [f"w{i}" for i in range(m)] for k, m in n.items()} | {5: [""]}
    # asked twice: 30 lines below the first and 200 more each time; not asked: the 30
    assert got == {0: "[IMG_TYPE: text] 2 w399", 1: "[IMG_TYPE: text] 0 w30", 2: "[IMG_TYPE: text] 2 w50", 4: "[IMG_TYPE: text] 2 w430", 5: "[IMG_TYPE: text] 0 None"}


def test_connectors(spark):
    df = spark.createDataFrame([("a", b"1"), ("b", b"2")], "name string, content binary")
    out = connectors.parsed(df, connectors.FakeParser(failing=("b",)), interval=0.0, concurrency=2)
    assert {r["name"]: r["status"] for r in out.collect()} == {"a": "done", "b": "fail"}
    tasks = spark.createDataFrame([("k", "images/x.png", "img", [str(i) for i in range(100)], 50), ("n", "images/n.png", None, ["x"], 0)], "key string, path string, image string, lines array<string>, line_at int")
    got = {r["key"]: r for r in connectors.described(tasks, connectors.FakeVision(asks=9), "m", "p").collect()}
    r = got["k"]
    assert (r["requests"], r["result"], r["status"]) == (5, "[IMG_TYPE: text] 4", "ok")  # three rounds with tools, one without, a last request
    assert [tuple(a) for a in r["asked"]] == [(5, 500)] * 4 and (got["n"]["result"], got["n"]["status"], got["n"]["requests"]) == ("[IMG_MISSING: images/n.png]", "error", 0)
    plain = connectors.described(tasks.where("key = 'k'"), connectors.FakeVision(asks=0, plain=True), "m", "p").first()
    assert (plain["requests"], plain["result"]) == (2, "[IMG_TYPE: text] 0")
    none = connectors.described(tasks.where("key = 'k'"), connectors.FakeVision(asks=0, plain=True), "m", "p", limits=connectors.Limits(fixes=0)).first()
    assert (none["requests"], none["result"], none["status"]) == (1, "__INVALID_RESPONSE__", "retry")
    tries = iter([connectors.RateLimited, TimeoutError, ValueError, None])

    def call():
        e = next(tries)
        if e:
            raise e("x")
        return 5

    waits = []
    assert connectors.called(call, sleep=waits.append) == 5 and waits == [2.0, 5.0, 2.0]
    assert [len(x) for x in connectors.chunks(b"x" * 5, 2)] == [2, 2, 1]
    clock = iter([0.0, 1.0, 1.0, 900.0])
    with pytest.raises(TimeoutError):
        list(connectors.unless_idle(iter([b"a", b"b", b"c"]), 300.0, lambda: next(clock)))
    assert connectors.request_of({"a": 1}, {"a": 2, "b": 3}) == {"a": 2, "b": 3}
    limits = connectors.tools(7, 9)[0]["function"]["parameters"]["properties"]
    assert [(limits[k]["minimum"], limits[k]["maximum"]) for k in ("more_above", "more_below")] == [(1, 7), (1, 9)]
    assert connectors.arguments_of({"name": "other", "arguments": "{}"}) is None and connectors.arguments_of({"arguments": "{"}) is None
    assert connectors.text_of(None) == "" and connectors.text_of([{"a": 1}]) == '[{"a": 1}]'

    class Failing:
        def complete(self, request):
            raise RuntimeError("500 broken")

    failed = connectors.Conversation(Failing(), "m", "p", {}, connectors.Limits(), sleep=lambda s: None).result("i", "images/x.png", ["x"], 0)
    assert failed == ("[IMG_API_ERROR: 500 broken]", "error")


def zip_splitter():
    return parse.by_zip_entries


def test_whole_workflow(spark, tmp_path, capsys):
    """Split, parse, organize, describe and analyze on fakes; a second run asks for nothing that is known."""
    folder = lambda name: str(tmp_path / name)
    given = {"paths": {k: folder(k) for k in ("input", "split", "parsed", "markdown", "images", "output", "progress", "logs")}, "parser": {"poll_interval": 0, "concurrency": 2}, "model": {"concurrency": 3}}
    (tmp_path / "c.json").write_text(json.dumps(given))
    (tmp_path / "input").mkdir()
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("1", "page one")
        z.writestr("2", "page two")
    (tmp_path / "input/book.pdf").write_bytes(raw.getvalue())
    (tmp_path / "input/note.png").write_bytes(b"png")
    (tmp_path / "input/skip.txt").write_bytes(b"no")
    command = lambda *a: workflow.main(["-c", folder("c.json"), *a])
    assert command("split", "--splitter", "test_files:zip_splitter") == 0
    assert sorted(os.listdir(tmp_path / "split")) == ["book_part1.pdf", "book_part2.pdf"]
    assert command("parse", "--parser", "lodestack.sources.connectors:FakeParser") == 0
    assert "{'done': 3}" in capsys.readouterr().out and (tmp_path / "parsed/book_part2/full.md").read_text() == "# batch-book_part2.pdf\n"
    assert command("parse", "--parser", "lodestack.sources.connectors:FakeParser") == 0 and "{'skip': 3}" in capsys.readouterr().out
    for k in (1, 2):  # what a parser would have found
        with open(tmp_path / f"parsed/book_part{k}/full.md", "a") as f:
            f.write(f"text\n![a](images/p{k}.png) and ![b](images/gone{k}.png)\n")
        (tmp_path / f"parsed/book_part{k}/images").mkdir()
        (tmp_path / f"parsed/book_part{k}/images/p{k}.png").write_bytes(b"picture")
    for p in (tmp_path / "parsed").glob("*/.full.md.crc"):
        p.unlink()
    assert command("organize") == 0
    merged = (tmp_path / "markdown/book.md").read_text()
    assert merged.startswith("# batch-book_part1.pdf") and "![a](images/book/p2.png)" in merged and (tmp_path / "images/book/p1.png").read_bytes() == b"picture"
    assert command("img2text", "--vision", "lodestack.sources.connectors:FakeVision", "--test", "--number", "1", "--seed", "7") == 0
    assert "'asked': 1" in capsys.readouterr().out
    assert command("img2text", "--vision", "lodestack.sources.connectors:FakeVision") == 0
    said = capsys.readouterr().out
    assert "'images': 4" in said and "'left': 2" in said  # two images have no file: an error that is kept, but not as done
    out = (tmp_path / "output/book.md").read_text()
    assert out.count("[AI] [IMG_TYPE: text] 1") == 2 and "![a]" not in out and out.count("![b]") == 2
    assert command("img2text", "--vision", "lodestack.sources.connectors:FakeVision") == 0 and "'asked': 2" in capsys.readouterr().out
    assert command("analyze", "--all") == 0
    said = capsys.readouterr().out
    assert "success=2" in said and "img_missing" in said and "total=4" in said
    assert command("analyze", "--progress") == 0 and "completed=2" in capsys.readouterr().out
    assert command("workflow", "--step", "analyze") == 0 and command("workflow", "--step", "organize") == 0
    with pytest.raises(SystemExit):
        command("parse")


def test_streaming(spark, tmp_path):
    rows = [{"file": "x.log", "line_no": i, "value": x} for i, x in enumerate(LOG)]
    (tmp_path / "in").mkdir()
    for k in range(0, len(rows), 4):
        (tmp_path / f"in/{k:03d}.json").write_text("\n".join(map(json.dumps, rows[k : k + 4])), encoding="utf-8")
        os.utime(tmp_path / f"in/{k:03d}.json", (1e9 + k, 1e9 + k))
    stream = logs.sessions(logs.lines(spark, str(tmp_path / "in"), per_trigger=1))
    q = stream.writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    logs.stop_after(q, len(rows), 60)
    got = sorted((r["tid"], r["key"], r["status"], r["tool_calls"]) for r in spark.table("sessions").collect())
    batch = sessions.log_sessions(spark.createDataFrame([(r["file"], r["line_no"], r["value"]) for r in rows], "file string, line_no long, value string"))
    # what is open at the end stays open until it times out
    assert got == sorted((r["tid"], r["key"], r["status"], r["tool_calls"]) for r in batch.collect() if r["key"] != "b.md::images/ä.png")
    seen = []
    logs.upserting(lambda df, n: seen.append((n, sorted(tuple(r) for r in df.collect()))))(spark.createDataFrame([("a", 1), ("a", 2)], "key string, seq int"), 3)
    assert seen == [(3, [("a", 2)])]


def test_office_bodies(spark, monkeypatch):
    """Ranges give back the bytes, at any chunk size, with comments, self-closing and nested elements between."""
    from lodestack.sources import office

    inner = ['<w:p a="1"><w:r><w:t>one &amp; ä</w:t></w:r></w:p>', "<w:p/>", "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t><w:t>y</w:t></w:r></w:p></w:tc></w:tr></w:tbl>", '<w:sdt><w:body>z</w:body></w:sdt >', "<w:sectPr><w:x/></w:sectPr>"]
    between = ["\n", "<!-- c -->", "", "  <?pi?>", "\n", "\n "]
    head, tail = '<?xml version="1.0" encoding="UTF-8"?>\n<w:document xmlns:w="w"><w:bg/><w:body>', "</w:body>\n</w:document>\n<!-- end -->"
    xml = head + "".join(a + b for a, b in zip(between, inner)) + between[-1] + tail

    def archive(entry, text):
        raw = io.BytesIO()
        with zipfile.ZipFile(raw, "w") as z:
            z.writestr(entry, text)
        return raw.getvalue()

    for chunk in (1, 7, 1 << 16):
        monkeypatch.setattr(office, "CHUNK", chunk)
        found = list(office._Body().scan(io.BytesIO(xml.encode())))
        raw = xml.encode()
        assert [k for k, *_ in found] == ["prefix", "paragraph", "paragraph", "table", "sdt", "section", "suffix"]
        assert raw[: found[0][2]].decode() == head and raw[found[-1][1] : found[-1][2]].decode() == tail
        assert [raw[a:z].decode() for _, a, z, _ in found[1:-1]] == inner and [t for *_, t in found[1:-1]] == ["one & ä", "", "xy", "", ""]
    rows = [("good", archive("word/document.xml", xml)), ("no zip", b"x"), ("no entry", archive("other", "x")), ("no body", archive("word/document.xml", "<a/>")), ("broken", archive("word/document.xml", xml[:-40])), ("none", None)]
    got = office.body_elements(spark.createDataFrame(rows, "path string, content binary")).collect()
    assert {r["path"] for r in got if r["kind"] == "error"} == {"no zip", "no entry", "no body", "broken", "none"}
    assert [(r["element"], r["kind"]) for r in got if r["path"] == "good"][:3] == [(-1, "prefix"), (0, "paragraph"), (1, "paragraph")]


def test_a_hot_thread_is_written_by_many_tasks(spark, tmp_path):
    tid = F.when(F.col("id") % 10 == 0, F.lit("T02")).otherwise(F.lit("T01"))
    lines = spark.range(20_000).select(F.lit("x.log").alias("file"), F.col("id").alias("line_no"), F.format_string("[10:00:00][%s] line %d", tid, "id").alias("value"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_thread_logs(lines, str(tmp_path / "out"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted((tmp_path / "out/log=x/tid=T01").glob("part-*"))
    text = "".join(p.read_text() for p in parts)
    assert len(parts) >= 3 and text.splitlines() == [f"[10:00:00][T01] line {k}" for k in range(20_000) if k % 10]
