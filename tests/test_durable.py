"""Records and calls that outlive a crash: nothing that ended is asked for twice."""

import json
import os
import signal
import subprocess
import sys
import time
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodestack.plans import describe, parse
from lodestack.sources import connectors, durable, files, sinks
from lodestack.sources.config import Config

TOP = Path(__file__).resolve().parents[1]


def test_store(tmp_path):
    store = durable.Store(f"file://{tmp_path}/a%20b/")
    assert store.get("x/y.json") is None and store.get_json("x/y.json") is None and not store.has("x/y.json")
    store.put_json("x/y.json", {"k": "ü"})
    (tmp_path / "a b/x/.y.json.crc").write_bytes(b"stale")
    store.put_json("x/y.json", {"k": "ö"})
    assert store.get_json("x/y.json") == {"k": "ö"} and os.listdir(tmp_path / "a b/x") == ["y.json"]
    store.put("x/z.json", b"{broken")
    assert store.get_json("x/z.json") is None and store.has("x/z.json")


def test_records(spark, tmp_path):
    rows = spark.createDataFrame([("d/a.json", "1"), ("d/b.json", None), ("ü/c.json", "3")], "name string, value string")
    durable.write_records(rows, str(tmp_path / "out"))
    durable.write_records(rows.limit(0), str(tmp_path / "none"))
    assert sorted(str(p.relative_to(tmp_path / "out")) for p in (tmp_path / "out").rglob("*.json")) == ["d/a.json", "ü/c.json"] and not (tmp_path / "none").exists()
    sinks.write_states(spark.createDataFrame([("x/a.pdf", "running"), ("b.pdf", "done")], "file string, status string"), str(tmp_path / "st"))
    assert sorted(os.listdir(tmp_path / "st")) == ["a_task.json", "b_task.json"]
    assert {(r["file"], r["status"]) for r in files.task_states(spark, str(tmp_path / "st")).collect()} == {("x/a.pdf", "running"), ("b.pdf", "done")}


def test_stream_of_records(spark, tmp_path):
    """Later batches win, earlier ones that come late or again don't."""
    (tmp_path / "in").mkdir()
    batches = [[("a", 5, "a5"), ("a", 7, "a7"), ("b", 1, "b1")], [("a", 6, "a6"), ("b", 2, "b2"), ("c", None, "c")], [("a", 7, "a7 again"), ("c", 0, "c0"), ("c", None, "late")]]
    for k, rows in enumerate(batches):
        (tmp_path / f"in/{k}.json").write_text("\n".join(json.dumps({"k": a, "seq": s, "v": v}) for a, s, v in rows))
        os.utime(tmp_path / f"in/{k}.json", (1e9 + k, 1e9 + k))
    stream = spark.readStream.schema("k string, seq long, v string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = durable.stream_records(stream, str(tmp_path / "out"), str(tmp_path / "cp"), "seq", F.concat("k", F.lit(".txt")), "v", availableNow=True)
    q.awaitTermination()
    assert q.lastProgress["batchId"] == 2
    assert {p.name: p.read_text() for p in (tmp_path / "out").glob("*.txt")} == {"a.txt": "a7 again", "b.txt": "b2", "c.txt": "c0"}


def documents(tmp_path, n=12):
    for d in ("markdown", "images"):
        (tmp_path / d).mkdir()
    for k in range(n):
        (tmp_path / f"images/p{k}.png").write_bytes(b"picture %d" % k)
    for d in range(3):
        (tmp_path / f"markdown/d{d}.md").write_text("\n".join(f"line\n![a](images/p{k}.png)" for k in range(d, n, 3)))
    return {k: str(tmp_path / k) for k in ("markdown", "images", "output", "progress", "logs")}


def logging_client(log, die_at=None, wait=0.0):
    """Answers once it has noted the image; ends its process at the call of that number."""

    class Client:
        def complete(self, request):
            image = request["messages"][1]["content"][1]["image_url"]["url"][-16:]
            with open(log, "a") as f:
                f.write(f"begin {image}\n")
            with open(log) as f:
                begun = sum(x.startswith("begin") for x in f)
            if die_at and begun >= die_at:
                os._exit(1)
            time.sleep(wait)
            with open(log, "a") as f:
                f.write(f"end {image}\n")
            return {"content": f"[IMG_TYPE: text] {image}"}

    return Client()


def calls_of(log):
    begun, ended = Counter(), Counter()
    for x in Path(log).read_text().splitlines():
        {"begin": begun, "end": ended}[x.split()[0]][x.split(maxsplit=1)[1]] += 1
    return begun, ended


def test_worker_dies_while_describing(spark, tmp_path):
    paths, log = documents(tmp_path), tmp_path / "calls"
    config = Config.of({"model": {"concurrency": 3}})
    with pytest.raises(Exception, match="Python worker exited|crashed|EOF|Job aborted"):
        describe.run(spark, paths, logging_client(log, die_at=7), config, "prompt")
    first, answered = calls_of(log)
    kept = sum(1 for p in Path(paths["progress"]).glob("d*/*.json"))
    assert 0 < answered.total() < 12 and kept >= answered.total() - 3  # each is on disk before its task's next call
    counts = describe.run(spark, paths, logging_client(log), config, "prompt")
    begun, ended = calls_of(log)
    assert counts["left"] == 0 and counts["asked"] == 12 - kept and set(ended) == set(begun) and len(ended) == 12
    assert sum(n - 1 for n in ended.values()) <= answered.total() - kept  # only what was cut off between answer and disk
    assert not (tmp_path / "progress/_runs").exists() and (tmp_path / "output/d0.md").read_text().count("[IMG_TYPE: text]") == 4
    assert describe.run(spark, paths, logging_client(log), config, "prompt")["asked"] == 0


RUN = """
import sys
sys.path[:0] = [{top!r}, {tests!r}]
from pathlib import Path
from pyspark.sql import SparkSession
import test_durable as t
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
paths = {paths!r}
t.describe.run(spark, paths, t.logging_client({log!r}, wait=0.6), t.Config.of({{"model": {{"concurrency": 2}}}}), "prompt")
"""


def test_driver_is_killed_while_describing(spark, tmp_path):
    paths, log = documents(tmp_path), str(tmp_path / "calls")
    env = os.environ | {"PYTHONPATH": f"{TOP}:{TOP / 'tests'}"}
    run = subprocess.Popen([sys.executable, "-c", RUN.format(top=str(TOP), tests=str(TOP / "tests"), paths=paths, log=log)], env=env, start_new_session=True, stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL)
    items = lambda: sum(1 for _ in Path(paths["progress"]).glob("d*/*.json"))
    end = time.time() + 120
    while items() < 4 and time.time() < end and run.poll() is None:
        time.sleep(0.05)
    os.killpg(run.pid, signal.SIGKILL)
    run.wait()
    kept = items()
    assert 4 <= kept < 12
    counts = describe.run(spark, paths, logging_client(log), Config.of({"model": {"concurrency": 3}}), "prompt")
    begun, ended = calls_of(log)
    assert counts["asked"] == 12 - kept and counts["left"] == 0 and len(ended) == 12
    assert sum(n - 1 for n in begun.values()) <= 2  # what was on its way in two tasks


def parser(log, die_in_poll_of=None, flaky=False):
    class Client:
        def note(self, what, name):
            with open(log, "a") as f:
                f.write(f"{what} {name}\n")
            return Path(log).read_text().splitlines().count(f"{what} {name}")

        def request_upload(self, name):
            n = self.note("create", name)
            if flaky and n <= 2:
                raise ConnectionError("no connection")
            return {"batch_id": f"batch-{name}-{n}", "url": "x"}

        def upload(self, url, content):
            b"".join(content)

        def poll(self, batch):
            name = batch.split("-")[1]
            n = self.note("poll", name)
            if name == die_in_poll_of and n == 1:
                os._exit(1)
            if flaky and n % 2:
                raise TimeoutError("timed out")
            return {"state": "running" if n < 3 else "done"}

        def download(self, batch):
            self.note("download", batch.split("-")[1])
            return f"# {batch}"

    return Client()


@pytest.fixture
def inputs(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(6):
        (tmp_path / f"in/f{k}.pdf").write_bytes(b"pdf %d" % k)
    return files.listing(spark, str(tmp_path / "in"), "*.pdf")


def test_worker_dies_while_parsing(spark, tmp_path, inputs):
    log, out, states = tmp_path / "calls", str(tmp_path / "out"), str(tmp_path / "out/status")
    config = Config.of({"parser": {"poll_interval": 0, "concurrency": 1}})
    with pytest.raises(Exception, match="Python worker exited|crashed|EOF|Job aborted"):
        parse.run(spark, inputs, out, states, parser(log, die_in_poll_of="f3.pdf"), config)
    before = {r["file"]: r["status"] for r in files.task_states(spark, states).collect()}
    assert before["f3.pdf"] == "running"  # its batch id was kept before the poll
    counts = {r["status"]: r["files"] for r in parse.run(spark, inputs, out, states, parser(log), config).collect()}
    said = Counter(log.read_text().splitlines())
    assert all(said[f"create f{k}.pdf"] == 1 and said[f"download f{k}.pdf"] == 1 for k in range(6))
    assert counts.get("skip", 0) == sum(s == "done" for s in before.values()) and sum(counts.values()) == 6
    assert (tmp_path / "out/f3/full.md").read_text() == "# batch-f3.pdf-1\n" and not (tmp_path / "out/status/_runs").exists()
    assert {r["status"] for r in files.task_states(spark, states).collect()} == {"done"}


def test_parse_service_fails_now_and_then(spark, tmp_path, inputs, monkeypatch):
    monkeypatch.setattr(connectors, "RETRY_PAUSE", 0.0)
    calm = lambda s: None
    client = parser(tmp_path / "calls", flaky=True)
    ready = inputs.select("name", F.lit(b"x").alias("content"))
    got = connectors.parsed(ready, client, interval=0.0, concurrency=2, sleep=calm).collect()
    assert {(r["status"], r["batch_id"]) for r in got} == {("done", f"batch-f{k}.pdf-3") for k in range(6)}

    class Gone:
        def poll(self, batch):
            raise RuntimeError("500")

    states = spark.createDataFrame([("a", "running", "x"), ("b", "done", "y")], "name string, status string, batch_id string")
    assert {r["name"]: r["remote"] for r in connectors.remote_states(states, Gone(), 1, calm).collect()} == {"a": None, "b": None}


def test_files_are_written_by_executors(spark, tmp_path):
    docs = spark.createDataFrame([("a b", "A\n\nB"), ("x/full.md", "D\n"), ("ü", "")], "name string, content string")
    sinks.write_documents(docs, str(tmp_path / "out"), manifest=str(tmp_path / "made"))
    assert {str(p.relative_to(tmp_path / "out")): p.read_text() for p in (tmp_path / "out").rglob("*.md")} == {"a b.md": "A\n\nB\n", "x/full.md": "D\n", "ü.md": "\n"}
    assert sorted(x for p in (tmp_path / "made").iterdir() for x in p.read_text().splitlines()) == ["a b.md", "x/full.md", "ü.md"]
    raw = spark.createDataFrame([(f"{k}.bin", bytes([k]) * 10) for k in range(20)], "name string, content binary")
    assert sinks.write_bytes(raw, str(tmp_path / "bin")) == 20 and sorted(os.listdir(tmp_path / "bin")) == sorted(f"{k}.bin" for k in range(20))
    listed = files.listing(spark, str(tmp_path / "bin"), "*.bin").select("path", F.concat(F.lit("there/"), "name").alias("target"))
    assert sinks.copied(listed, f"file://{tmp_path}/copy") == 20 and (tmp_path / "copy/there/7.bin").read_bytes() == b"\x07" * 10
    assert sinks.write_bytes(raw.limit(0), str(tmp_path / "none")) == 0


def test_lines_of_frames(spark):
    """A band join gives what cutting each document's own list gives, at edges of blocks and of documents."""
    texts = {"a": [f"a{k}" for k in range(1000)], "b": ["only"], "c": [str(k) for k in range(257)]}
    docs = spark.createDataFrame([(n, "\n".join(x)) for n, x in texts.items()], "name string, content string")
    at = [("a", k) for k in (0, 1, 255, 256, 300, 511, 999)] + [("b", 0), ("c", 256), ("gone", 3)]
    tasks = spark.createDataFrame([(f"{n}::{k}", n, k) for n, k in at], "key string, name string, line_no int")
    limits = connectors.Limits(start=(30, 20), most=(100, 90), rounds=3)
    got = {r["key"]: (r["lines"], r["line_at"]) for r in describe.with_lines(tasks, docs, limits).collect()}
    assert got == {f"{n}::{k}": (texts[n][max(0, k - 330) : k + 291], min(k, 330)) for n, k in at if n in texts}


def test_large_values_come_in_pieces(spark, tmp_path, monkeypatch):
    """Files of values that are larger than a piece, empty, null or of a name that comes twice; no piece is larger than PIECE."""
    monkeypatch.setattr(durable, "PIECE", 7)
    seen = durable.write_pieces
    sizes = []
    monkeypatch.setattr(durable, "write_pieces", lambda rows, *a, **k: (sizes.append(rows.agg(F.max(F.octet_length("value"))).first()[0]), seen(rows, *a, **k)))
    rows = spark.createDataFrame([("a/x", "grüße, " * 9), ("b", ""), ("c", None), ("d", "one"), ("d", "second")], "name string, value string").coalesce(1)
    durable.write_large(rows, str(tmp_path / "out"))
    read = lambda n: (tmp_path / "out" / n).read_text(encoding="utf-8")
    assert read("a/x") == "grüße, " * 9 and read("b") == "" and read("d") == "second" and not (tmp_path / "out/c").exists()
    assert sizes == [7] and not list((tmp_path / "out").rglob("*.tmp"))

