"""From raw documents to packed sequences: five stages, each written as Parquet and read again.

Language ID lets documents with a determined language through; line dedup cuts
site-wide boilerplate lines; near-duplicate detection keeps one document of each
group; decontamination drops documents with passages of the benchmark; packing lays
what is left into sequences of 4096 tokens. The first four return the columns of
documents.

Defined cases: a null, empty or letterless text has no language, so its row goes in the
first stage; a null language or source is no label and the empty host; a row without a
doc_id goes through all stages, is linked with nothing and is packed under a null doc_id;
repeated rows stay together: near-duplicate detection knows rows by doc_id, so it keeps
or drops all rows of one; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm import decontam, langid, linededup, neardup, packing
from lodestack.llm.common import read, stored
from lodestack.llm.queries import vocabulary


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep(docs, langid.learn(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = linededup.drop_lines(docs, counts=False)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs, words=5, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # after the stages before, executors have less memory left for kept pieces
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), end_id=2, length=4096, keep=150_000)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: A trained network and word shingles' components are beyond SQL; a brute-force version tests the stages instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of documents, after all stages."""
    docs = read(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        # what the stage before has written is freed once this one is
        docs = before = stored(stage(spark, docs, sf_dir), name, instead_of=before)
    return STAGES[-1][1](spark, docs, sf_dir)
