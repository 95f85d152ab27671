"""Token ids in a binary format whose documents can be read one by one.

A written folder holds ``dictionary.zdict`` (a zstandard dictionary, trained on the
serialized id arrays of a bounded sample), ``manifest.json`` and ``blocks``, a table of
binary blocks. A block has some ``BLOCK_BYTES`` of zstandard frames, one for each
document, and an index: doc_id, frame offset, number of ids before the document in the
shard, as 64-bit arrays, and one byte saying whether the doc_id is known; a header says
magic, id width, SHA-256 of the dictionary, number of documents and size of the frames.
Beside it are the columns by which a block is found: shard, block, first_id, last_id,
documents, tokens. Documents are in ascending doc_id order, first those without a
doc_id; shards are ranges of them.

All files go through Spark and Hadoop's file systems, so the folder may be in any store
that the session reaches.

Defined cases: a null or empty text gives the end id alone; a null doc_id sorts
first; repeated doc_ids and rows are all written, in the order of their texts'
hashes; an empty table gives a folder without documents; ids are 16 bits wide if the
vocabulary allows, and else 32; extra columns are not read.

Scale: texts are tokenized once, where they are read; only compressed frames are
shuffled, by ranges of doc_id, text hash and place, so neither null nor repeated doc_ids
meet in one task. Blocks are written by Spark's commit protocol, so a repeated task
leaves one copy. Starts across shards are sums over the manifest, one entry a shard.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, id_columns, ids_of, ship, stored, text_of
from .tokens import encoder

MAGIC = b"LSTKIDS2"
HEADER = "<8sI32sQQ4x"
HEADER_BYTES = struct.calcsize(HEADER)
#: Documents of the dictionary's sample, by hash order, and the dictionary's size.
SAMPLE_DOCUMENTS, DICTIONARY_BYTES = 400, 64 << 10
#: Characters of a document that the dictionary may be trained on.
SAMPLE_CHARS = 20_000
LEVEL = 3
#: Shards and blocks aim at this many bytes of frames.
SHARD_BYTES, BLOCK_BYTES = 12 << 20, 1 << 20
#: The manifest has at most about so many entries; beyond, shards grow.
MOST_SHARDS = 50_000


def width_of(tokenizer: str, end_id: int) -> int:
    return 2 if max(encoder(tokenizer).vocabulary, end_id + 1) <= 1 << 16 else 4


def _serial(ids: bytes, width: int) -> bytes:
    return ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int = 0, text: str = "text", documents: int = SAMPLE_DOCUMENTS, size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary from at most ``documents`` documents, a window of SAMPLE_CHARS of each; empty if they are too few to train one."""
    import zstandard

    t = text_of(text)
    at = F.pmod(F.xxhash64(t), F.greatest(F.length(t) - SAMPLE_CHARS + 1, F.lit(1))).cast("int") + 1
    rows = bounded_sample(docs.select(F.xxhash64(t).alias("h"), F.substring(t, at, F.lit(SAMPLE_CHARS)).alias("t")), "h", documents).collect()
    width, end = width_of(tokenizer, end_id), struct.pack("<I", end_id)
    samples = [_serial(x + end, width) for x in encoder(tokenizer).ids([r["t"] for r in rows])]
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, samples)) // 8)), samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _compressor(dictionary: bytes):
    import zstandard

    return zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def _decompressor(dictionary: bytes):
    import zstandard

    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def frames(docs: DataFrame, tokenizer: str, dictionary: bytes, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's compressed ids: doc_id, text_hash, n_tokens, frame."""
    ship(docs.sparkSession)
    width, end = width_of(tokenizer, end_id), struct.pack("<I", end_id)

    def run(batches):
        enc, zip_ = encoder(tokenizer), _compressor(dictionary)
        for b in batches:
            ids = [x + end for x in enc.ids(b["text"].tolist())]
            yield pd.DataFrame({"doc_id": ids_of(b), "text_hash": b["text_hash"], "n_tokens": [len(x) // 4 for x in ids], "frame": [zip_.compress(_serial(x, width)) for x in ids]})

    rows = docs.select(*id_columns(key), F.xxhash64(text).alias("text_hash"), text_of(text).alias("text"))
    return rows.mapInPandas(run, "doc_id long, text_hash long, n_tokens long, frame binary")


def _put(spark: SparkSession, path: str, raw: bytes) -> None:
    """Write one small file from the driver."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(raw))
    finally:
        out.close()


def _get(spark: SparkSession, path: str) -> bytes:
    """Read one small file on the driver."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    source = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(p)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(source))
    finally:
        source.close()


def pack(width: int, digest: bytes, ids: np.ndarray, known: np.ndarray, frames_: list[bytes], starts: np.ndarray) -> bytes:
    """One block; starts has one entry more than there are documents."""
    ends = np.cumsum([0, *map(len, frames_)])
    parts = (ids.astype("<i8"), ends.astype("<i8"), starts.astype("<i8"), known.astype("u1"))
    return b"".join([struct.pack(HEADER, MAGIC, width, digest, len(frames_), int(ends[-1])), *(x.tobytes() for x in parts), *frames_])


BLOCKS = "shard int, block int, first_id long, last_id long, documents long, tokens long, data binary"


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, key: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES) -> dict:
    """Write docs below path, a folder that driver and executors share; returns the manifest."""
    spark = docs.sparkSession
    dictionary = train_dictionary(docs, tokenizer, end_id, text)
    digest, width = hashlib.sha256(dictionary).digest(), width_of(tokenizer, end_id)
    made = stored(frames(docs, tokenizer, dictionary, end_id, key, text), "frames")
    total = made.agg(F.sum(F.octet_length("frame"))).first()[0] or 0
    shards = max(spark.sparkContext.defaultParallelism, min(MOST_SHARDS, -(-total // shard_bytes)))

    def run(batches):
        shard, number, tokens = TaskContext.get().partitionId(), 0, 0
        held: list[tuple] = []
        size = 0

        def block() -> pd.DataFrame:
            nonlocal number, tokens
            ids, known, n, frames_ = (np.array([h[k] for h in held], dtype=kind) if kind else [h[k] for h in held] for k, kind in enumerate(("int64", "bool", "int64", None)))
            starts = tokens + np.concatenate([[0], np.cumsum(n)])
            named = ids[known]
            ends = (int(named[0]), int(named[-1])) if len(named) else (0, -1)
            row = (shard, number, *ends, len(held), int(n.sum()), pack(width, digest, ids, known, frames_, starts))
            number, tokens = number + 1, int(starts[-1])
            held.clear()
            return pd.DataFrame([row], columns=["shard", "block", "first_id", "last_id", "documents", "tokens", "data"])

        for b in batches:
            for row in zip(b["doc_id"].tolist(), b["_known"].tolist(), b["n_tokens"].tolist(), b["frame"]):
                held.append(row)
                size += len(row[3])
                if size >= block_bytes:
                    yield block()
                    size = 0
        if held:
            yield block()

    order = [F.col("doc_id").asc_nulls_first(), F.col("text_hash"), F.col("_row")]
    ordered = made.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(shards, *order).sortWithinPartitions(*order)
    ordered.select(*id_columns("doc_id"), "n_tokens", "frame").mapInPandas(run, BLOCKS).write.mode("overwrite").option("compression", "none").parquet(f"{path}/blocks")
    by_shard = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").groupBy("shard").agg(F.count(F.lit(1)).alias("blocks"), F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
    entries = sorted(tuple(r) for r in by_shard.collect())  # one row a shard
    manifest = {"width": width, "dictionary_sha256": digest.hex(), "end_id": end_id, "shards": [list(e) for e in entries]}
    _put(spark, f"{path}/dictionary.zdict", dictionary)
    _put(spark, f"{path}/manifest.json", json.dumps(manifest).encode())
    return manifest


def manifest_of(spark: SparkSession, path: str) -> dict:
    return json.loads(_get(spark, f"{path}/manifest.json"))


def dictionary_of(spark: SparkSession, path: str) -> bytes:
    """The dictionary, if it is the one that the documents were written with."""
    dictionary = _get(spark, f"{path}/dictionary.zdict")
    if hashlib.sha256(dictionary).hexdigest() != manifest_of(spark, path)["dictionary_sha256"]:
        raise ValueError(f"the dictionary of {path} isn't the one its documents were written with")
    return dictionary


class Block:
    """One block: its index, and documents by place."""

    def __init__(self, raw: bytes, dictionary: bytes):
        magic, self.width, digest, n, size = struct.unpack_from(HEADER, raw)
        if magic != MAGIC:
            raise ValueError("no block of token ids")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError("the dictionary isn't the one this block was written with")
        self.count, at = n, HEADER_BYTES
        self.ids = np.frombuffer(raw, "<i8", n, at)
        self.offsets = np.frombuffer(raw, "<i8", n + 1, at + 8 * n)
        self.starts = np.frombuffer(raw, "<i8", n + 1, at + 8 * (2 * n + 1))
        self.known = np.frombuffer(raw, "u1", n, at + 8 * (3 * n + 2)).astype(bool)
        self.frames, self.unzip = memoryview(raw)[len(raw) - size :], _decompressor(dictionary)

    def document(self, k: int) -> np.ndarray:
        return np.frombuffer(self.unzip.decompress(self.frames[self.offsets[k] : self.offsets[k + 1]]), f"<u{self.width}").astype("<u4")


def lookup(spark: SparkSession, path: str, doc_id: int) -> list[np.ndarray]:
    """Ids of the documents with this doc_id: reads the blocks whose range holds it, which Parquet's statistics tell, and opens its frames alone."""
    dictionary, found = dictionary_of(spark, path), []
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id))
    for r in blocks.orderBy("shard", "block").toLocalIterator():
        block = Block(bytes(r["data"]), dictionary)
        found += [block.document(int(k)) for k in np.flatnonzero((block.ids == doc_id) & block.known)]
    return found


def read(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """What the files hold: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids (little-endian 32 bits each)."""
    ship(spark)
    dictionary, base, start = dictionary_of(spark, path), {}, 0
    for shard, _, _, tokens in manifest_of(spark, path)["shards"]:
        base[shard] = start
        start += tokens

    def run(batches):
        for b in batches:
            for shard, raw in zip(b["shard"].tolist(), b["data"]):
                block = Block(bytes(raw), dictionary)
                docs = [block.document(k).tobytes() for k in range(block.count)]
                out = {
                    "doc_id": pd.array(np.where(block.known, block.ids, 0), "Int64"), "start": base[shard] + block.starts[:-1],
                    "n_tokens": np.diff(block.starts), "ids_crc32": [zlib.crc32(x) for x in docs],
                }
                out["doc_id"][~block.known] = pd.NA
                yield pd.DataFrame(out | ({"ids": docs} if ids else {}))

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * ids
    return spark.read.schema(BLOCKS).parquet(f"{path}/blocks").select("shard", "data").mapInPandas(run, schema)
