"""Exact dedup through two passes of a Bloom filter, in DataFrame functions only.

Texts are equal when they are identical after lower-casing A-Z; the SHA-256 of that form
stands for the text, so no text is shuffled.

Pass 1 is a Bloom filter of one bit a hash that counts its hits: bits of SPACE times the
rows, of which a row sends one number (summed before the shuffle); the bits that were hit
more than once go into a second, blocked filter.  Pass 2 probes that one: a hash that it
holds may be repeated, and only such rows are shuffled and grouped; every other row is
alone and passes straight through.  A false alarm costs one shuffled row and changes no
result.  The second filter has a fixed size at most, so its broadcast has a bound; where
more bits repeat than it holds there are several, each for its own part of the bits, and
the narrow table of ids and hashes, stored in folders by such parts, is read once in all.

Defined results: a null text counts as empty; of equal texts the row with the largest
``doc_id`` stays, of repeated rows with that id exactly one; a null id is smaller than
any other.  Other columns are not looked at.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.durable import persist
from vacantia.llm import bloom

SPACE = 32  # bits a row of the first filter


def normalised(text: Column) -> Column:
    """A-Z in lower case, null as empty."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def possibly_repeated(rows: DataFrame, n: int, segments: int) -> DataFrame:
    """``rows`` with a boolean column ``repeated``: false only if no other row has this hash.

    ``rows`` has columns ``slot``, below SPACE * n, and ``segment``, of ``segments`` parts of the slots.
    """
    again = persist(rows.groupBy("slot", "segment").count().where("count > 1").select(F.xxhash64("slot").alias("slot"), "segment"))
    many = again.count()
    filters = min(segments, bloom.segments_for(many))
    words, flagged = bloom.words_for(-(-many // filters)), None
    for f in range(filters):
        mine = F.col("segment").between(f * segments // filters, (f + 1) * segments // filters - 1)
        part = bloom.probe(rows.where(mine), F.xxhash64("slot"), bloom.build(again.where(mine), F.col("slot"), words), words, "repeated")
        flagged = part if flagged is None else flagged.unionByName(part)
    return flagged


def exact_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` of every row, dropped ones too."""
    sha = F.sha2(normalised(F.col(text_column)).cast("binary"), 256)
    rows = docs.select(F.col(id_column).alias("doc_id"), sha.alias("text_sha256")).withColumn("hashed", F.xxhash64("text_sha256"))
    n = docs.count()
    segments = bloom.segments_for(n)
    rows = rows.select("doc_id", "text_sha256", F.pmod("hashed", F.lit(SPACE * max(1, n))).alias("slot")).withColumn("segment", F.pmod("slot", F.lit(segments)).cast("int"))
    rows = persist(rows, partition_by=["segment"] if segments > 1 else None)
    flagged = possibly_repeated(rows, n, segments)
    alone = flagged.where(~F.col("repeated")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    # hot groups: copies with one id first, then one row a group, both summed before the shuffle; as tables
    # of their own both sides of the join are plain shuffles, which adaptive execution can split
    ids = persist(flagged.where("repeated").groupBy("text_sha256", "doc_id").agg(F.count("*").alias("n")))
    groups = persist(ids.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size")))
    shared = (
        ids.join(groups, "text_sha256")
        .select("*", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy"))
        .select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256")
    )
    return alone.unionByName(shared)
