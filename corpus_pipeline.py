"""A corpus pipeline of five of the operators in ``vacantia.llm``.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; its result is written
as Parquet to the shared folder and read back as the next one's ``docs``.

1. language ID: documents without a known language go.
2. line dedup: repeated and nearly repeated lines go but for the first; a document that
   has nothing left goes.
3. SimHash near-dedup: of each group of near copies the smallest id stays.
4. mixing: sources are drawn to their target weights; a document may come out twice or
   not at all.
5. BPE: ids of every document and the text they decode to, as digests.

Defined results: a null or empty text has no language and goes in stage 1; a null id is
learnt from by none, comes first where line dedup keeps the first and last where
near-dedup keeps the smallest, and is drawn like any other id by the mix; rows that share an id and a
text count as one document in stages 2 and 3, rows that share an id only are documents of
their own but are drawn alike; a text of any length stays whole; columns beyond those of
documents pass through; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.llm import bpe, langid, lines, mixing, simhash
from vacantia.llm.common import remainder
from vacantia.llm.queries import vocabulary_path
from vacantia.durable import drop, settled


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the documents that are not held out; drops those without a known language."""
    return langid.keep_known(docs, langid.fit(docs, remainder(F.col("doc_id"), 5) != 0))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One line of each group of similar lines stays."""
    return lines.dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix, in its shards' shuffled order."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256, exact`` of every row."""
    return bpe.digests(docs, vocabulary_path())


STAGES = [
    ("language ID", language_id), ("line dedup", line_dedup), ("SimHash near-dedup", near_dedup), ("mixing sources", mix_sources), ("BPE encoding", encode),
]

#: Suffix automata, MinHash, fingerprints and merges are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``; what a stage wrote goes with its result's writing, its input after it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        last, docs = docs, settled(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
        drop(last)
    return docs
