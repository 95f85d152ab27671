"""Logs that grow: the source that follows them, and what is shown of them with state."""

import random
import time

import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from lodestack.streaming import follow, logs


def read_all(reader, start, end):
    out = []
    for part in reader.partitions(start, end):
        for b in reader.read(part):
            out += list(zip(*(c.to_pylist() for c in b.columns)))
    return sorted(out)


def test_ranges_give_each_line_once(tmp_path):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab é\r") for _ in range(rng.choice([0, 1, 3, 40]))) for _ in range(300)]
    (tmp_path / "x.log").write_bytes("\n".join([*texts, "half"]).encode())
    want = [t.removesuffix("\r") for t in texts]
    for split in (1, 7, 64, 10_000):
        reader = follow.FollowedReader({"path": str(tmp_path), "splitBytes": str(split)})
        got = read_all(reader, {}, reader.latestOffset())
        assert [v for _, _, v in got] == want and len({n for _, n, _ in got}) == 300
    # small blocks and a bound on a batch
    reader, at, seen = follow.FollowedReader({"path": f"file://{tmp_path}", "maxBytes": "50"}), {}, []
    for _ in range(2000):
        now = reader.latestOffset()
        if now == at:
            break
        seen += read_all(reader, at, now)
        at = now
    assert [v for _, _, v in sorted(seen)] == want


def test_growth_truncation_and_restart(tmp_path):
    options = {"path": str(tmp_path / "logs"), "state": str(tmp_path / "state")}
    reader = follow.FollowedReader(options)
    assert reader.latestOffset() == {}  # no folder yet
    (tmp_path / "logs").mkdir()
    log, other = tmp_path / "logs/a.log", tmp_path / "logs/b.log"
    log.write_bytes(b"one\ntwo\nthr")
    other.write_bytes(b"")
    (tmp_path / "logs/c.txt").write_bytes(b"no log\n")
    a = reader.latestOffset()
    assert [v for *_, v in read_all(reader, {}, a)] == ["one", "two"]
    log.write_bytes(log.read_bytes() + b"ee\n\n\xff\n")
    reader = follow.FollowedReader(options)  # started again
    b = reader.latestOffset()
    assert [v for *_, v in read_all(reader, a, b)] == ["three", "", "�"]
    log.write_bytes(b"new\n")  # shorter
    c = reader.latestOffset()
    assert [v for *_, v in read_all(reader, b, c)] == ["new"]
    log.write_bytes(b"different\nand longer than before by much\n")  # begins otherwise
    d = reader.latestOffset()
    later = read_all(reader, c, d)
    assert [v for *_, v in later] == ["different", "and longer than before by much"] and later[0][1] > 1 << 48
    log.unlink()
    assert read_all(reader, d, reader.latestOffset()) == []
    long = tmp_path / "logs/d.log"
    long.write_bytes(b"x" * 500 + b"\nshort\n" + b"y" * 500)
    reader = follow.FollowedReader(options | {"maxBytes": "100"})
    e = reader.latestOffset()
    assert [len(v) for *_, v in read_all(reader, d, e)] == [500]  # longer than the bound, but whole
    f = reader.latestOffset()
    assert [v for *_, v in read_all(reader, e, f)] == ["short"] and reader.latestOffset() == f
    assert isinstance(follow._store(f"file://{tmp_path}")[0], fs.LocalFileSystem)


BODY = ["▶ START d::images/{}.png", "  [ToolCall] AI wants +5up/-5down", "[WARNING] odd", "✓ [1.5s] DONE [IMG_TYPE: table]", "[ERROR] ✗ [2s] FAILED HTTP 429", "Saved: x", "Done!", "=====", ""]


def said(rng, n, total=40):
    return [f"[10:00:00][T01] To process: {total}"] + [f"[10:00:{k % 60:02d}][T0{rng.randint(1, 3)}] " + rng.choice(BODY).format(k) for k in range(n)]


def test_followed_logs_survive_a_restart(spark, tmp_path):
    rng = random.Random(2)
    texts = {f"{name}.log": said(rng, 60) for name in ("a", "b")}
    (tmp_path / "logs").mkdir()

    def run(rows):
        stream = logs.sessions(follow.lines(spark, str(tmp_path / "logs"), max_bytes=900, split_bytes=200, state=str(tmp_path / "plan")))
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
        logs.stop_after(q, rows, 120)

    half = {name: lines[:30] for name, lines in texts.items()}
    for name, lines in half.items():
        (tmp_path / "logs" / name).write_text("\n".join(lines) + "\n" + texts[name][30][:9])
    run(60)
    for name, lines in texts.items():
        with open(tmp_path / "logs" / name, "a") as f:
            f.write(lines[30][9:] + "\n" + "\n".join(lines[31:]) + "\n")
    run(62)
    from lodestack.operators import sessions

    rows = [(name, k, x) for name, lines in texts.items() for k, x in enumerate(lines)]
    whole = sessions.log_sessions(spark.createDataFrame(rows, "file string, line_no long, value string")).where("status <> 'incomplete'")
    cols = ["file", "tid", "key", "tool_calls", "status", "elapsed"]
    got = spark.read.parquet(str(tmp_path / "out")).where("status <> 'incomplete'")
    assert sorted(map(str, got.select(cols).collect())) == sorted(map(str, whole.select(cols).collect())) and whole.count() > 5


@pytest.mark.parametrize("dense", [True, False])
def test_shown_with_state(spark, tmp_path, dense):
    """Whatever batches bring the lines, and in which order within the dense form, what is shown is that of the whole."""
    rng = random.Random(3)
    rows = [(f, k, x) for f in ("a", "b") for k, x in enumerate(said(rng, 80))]
    schema = "file string, line_no long, value string"
    want = sorted(map(tuple, logs.shown(spark.createDataFrame(rows, schema)).collect()))
    dealt = [rows[k::4] for k in range(4)] if dense else [[r for r in rows if r[1] // 25 == k] for k in range(4)]
    (tmp_path / "in").mkdir()
    for k, part in enumerate(dealt):
        spark.createDataFrame(part, schema).coalesce(1).write.json(str(tmp_path / f"w{k}"))
        (next((tmp_path / f"w{k}").glob("part-*"))).rename(tmp_path / f"in/{k}.json")
        time.sleep(0.02)
    stream = logs.live(logs.lines(spark, str(tmp_path / "in"), per_trigger=1), dense=dense)
    q = logs.started(stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append"), spark)
    logs.stop_after(q, len(rows), 120)
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("file", "line_no", "text").collect()) == want


def test_a_gap_is_given_up(spark, tmp_path):
    """Lines behind a missing one wait, and are shown once their file has been silent."""
    (tmp_path / "in").mkdir()
    rows = [("a", k, f"[10:00:00][T01] line {k}") for k in (0, 1, 3, 4)]
    spark.createDataFrame(rows, "file string, line_no long, value string").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = logs.live(logs.lines(spark, str(tmp_path / "in")), idle_ms=1500)
    q = logs.started(stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append"), spark)
    logs.stop_after(q, len(rows), 60, stop=False)
    first = {r["line_no"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    end = time.time() + 60
    while time.time() < end and spark.read.parquet(str(tmp_path / "out")).count() < 4:
        time.sleep(0.3)
    q.stop()
    assert first == {0, 1} and {r["line_no"] for r in spark.read.parquet(str(tmp_path / "out")).where(F.col("text").startswith("line")).collect()} == {0, 1, 3, 4}
