"""The pipeline's stages against a plain version of each, and every query registered for this subpackage."""

import re
from pathlib import Path

import pytest

import corpus_pipeline
from lodestack.llm import langid, queries
from lodestack.llm.common import stored

from test_llm import brute_groups, brute_hits

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the driver's tables aren't here")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = stored(stage(spark, docs, SF), name)
        seen.append(name)
        rows = docs.collect()
        after = {r["doc_id"]: r for r in rows}
        if name != "packing":
            assert docs.columns == columns and len(rows) == len(after)
        if name == "language_id":
            assert set(before) - set(after) == {i for i, r in before.items() if not any(c.isalpha() for c in r["text"] or "")}
        elif name == "line_dedup":
            pages = {}
            for r in before.values():
                pages.setdefault(r["source"], set()).add(r["text"])
            for i, r in before.items():
                common = lambda line, p=pages[r["source"]]: (n := sum(line.strip(" \t\r") in [x.strip(" \t\r") for x in t.split("\n")] for t in p)) >= 5 and n > 0.03 * len(p)
                assert after[i]["text"] == "\n".join(x for x in r["text"].split("\n") if not x.strip(" \t\r") or not common(x))
                assert after[i]["n_chars"] == len(after[i]["text"])
        elif name == "near_duplicates":
            groups = brute_groups({i: r["text"] for i, r in before.items()}, 5)
            assert set(after) == {i for i, (_, c) in groups.items() if i == c}
        elif name == "decontamination":
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            ids = sorted(before)
            hits = brute_hits([before[i]["text"] for i in ids], items)
            assert set(after) == {i for i, h in zip(ids, hits) if not h[1]}
        else:
            assert set(after) == set(before)
            for i in before:
                own = [r for r in rows if r["doc_id"] == i]
                assert sum(r["length"] for r in own) == own[0]["doc_tokens"]
    assert seen == ["language_id", "line_dedup", "near_duplicates", "decontamination", "packing"]


def test_odd_rows(spark, tmp_path):
    """Nulls in every column, empty texts, repeated rows and an empty table, through all stages."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    odd = spark.createDataFrame([(None, None, None, None, None), (7001, None, "en", None, None), (None, "some words in a text without a key", None, None, 3), (7002, "", "", "", 0), (7003, "1 2 3", None, "s", 5)], docs.schema)
    long_ = spark.createDataFrame([(7004, "a long text of ordinary words " * 20_000, "en", "s", 1)], docs.schema)
    rows = docs.unionByName(docs.limit(10)).unionByName(odd).unionByName(long_)
    for given in (rows, rows.limit(0)):
        now, columns = stored(given, "odd"), given.columns
        for name, stage in corpus_pipeline.STAGES:
            before = {r["doc_id"] for r in now.collect()}
            now = stored(stage(spark, now, SF), name)
            assert {r["doc_id"] for r in now.collect()} <= before
            assert name == "packing" or now.columns == columns
        assert (now.count() > 0) == (given is rows)
        if given is rows:
            assert {7004} <= {r["doc_id"] for r in now.collect()} and not {7001, 7002, 7003} & {r["doc_id"] for r in now.collect()}


def test_registered():
    found = [m[1] for q in queries.queries() if (m := re.match(r"op(\d+)_", q))]
    assert sorted(map(int, found)) == list(range(1, 14))
    assert set(queries.oracle_sql()) <= set(queries.queries())


def test_sql(spark):
    import compare

    assert compare.compare(spark, list(queries.oracle_sql()), SF) == 0


def test_language_is_learned(spark):
    rows = queries.op6_language_id(spark, "/root/testdata/sf0.01").where("held_out").select("doc_id", "lang_pred").collect()
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    assert sum(lang[r["doc_id"]] == r["lang_pred"] for r in rows) / len(rows) > 0.97 and langid.WINDOW == 512


MEMORY = """
import re
from lodestack.llm import common, tokens
from lodestack.llm.queries import vocabulary
import numpy, pandas, pyarrow, tokenizers

def now():
    return sum(map(int, re.findall(r"\\nPss_(?:Anon|Shmem):\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

before = now()
enc = tokens.encoder(vocabulary("word_bpe_49k.json"), 1000)
print(now() - before)
assert now() - before < 23
"""


def test_workers_give_memory_back():
    """Executors' workers went on holding what they had freed: with the JVM's share, over 3000 MB in packing."""
    import subprocess
    import sys

    done = subprocess.run([sys.executable, "-c", MEMORY], cwd=corpus_pipeline.__file__.rsplit("/", 1)[0], capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stdout + done.stderr


def test_lean(monkeypatch):
    from lodestack.llm import common

    given = []
    monkeypatch.setattr(common, "give_back", lambda: given.append(len(seen)))
    seen = []
    for b in common.lean(iter(range(2 * common.GIVE_BACK + 1))):
        seen.append(b)
    assert seen == list(range(2 * common.GIVE_BACK + 1)) and given == [common.GIVE_BACK, 2 * common.GIVE_BACK, 2 * common.GIVE_BACK + 1]


def test_batches_of_texts_are_small(spark):
    """ship() took defaults for values that a user had set, so batches of 10,000 texts went through executors."""
    from lodestack.llm import common

    other = spark.newSession()
    other.conf.set("spark.sql.parquet.columnarReaderBatchSize", "77")
    common.ship(other)
    assert [other.conf.get(f"spark.sql.{k}") for k in ("execution.arrow.maxRecordsPerBatch", "execution.arrow.maxBytesPerBatch", "parquet.columnarReaderBatchSize")] == ["500", "4m", "77"]

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    assert {r["n"] for r in other.range(0, 2000, 1, 1).mapInArrow(sizes, "n long").collect()} == {500}


def test_one_each(spark):
    from lodestack.llm import neardup

    rows = stored(spark.createDataFrame([(1, b"x"), (2, b"y"), (2, b"y"), (3, b"")], "node long, set binary"), "rows")
    for table, want in ((rows, [1, 2, 3]), (rows.where("node <> 2"), [1, 3]), (rows.limit(0), [])):
        assert sorted(r["node"] for r in neardup.one_each(table).collect()) == want
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan(neardup.one_each(rows)) and "Aggregate" not in plan(neardup.one_each(rows.where("node <> 2")))
