"""SimHash near-dedup by anchor points of a covering code.

Two fingerprints that differ in at most three of 64 bits differ in at most one bit of
the low 31 or of the next 31.  In 31 bits the perfect Hamming code has covering radius
1: every value is within one bit of exactly one code word, its anchor.  Replicating a
fingerprint to every anchor within covering radius plus threshold (1 + 1), 16 of the
2^26 code words a half, puts any two linked fingerprints at one anchor at least, where
they are compared over all 64 bits.

Fingerprints are made distinct first, so copies of a text are one row.  Anchors with a
single fingerprint are dropped by a spillable window count.  A crowded anchor is cut
into tiles of TILE fingerprints; every pair of tiles is a bounded task of its own, and a
task returns a star for each component of its links instead of all pairs.  Components are found
by distributed rounds; nothing but a row count reaches the driver.

Defined results: a null text counts as empty; a text without words has fingerprint zero
and links like any other; fewer than three words make one shingle; repeated rows get the
same answer; other columns pass through ``drop_near_duplicates`` untouched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vacantia.durable import drop, persist
from vacantia.llm import bloom
from vacantia.llm.common import by_batch, slices
from vacantia.operators.components import connected_components

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
SHINGLE, SEED, BITS, TILE = 3, 42, 3, 1024


def fingerprint(text: str | None) -> int:
    """SimHash of the word shingles, unsigned."""
    words = WORDS.findall((text or "").encode("utf-8", "surrogatepass").lower())
    if not words:
        return 0
    whole = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(whole, SEED)
    starts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)])
    ends = (starts[SHINGLE:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(whole[a:b], SEED) for a, b in zip(starts.tolist(), ends)], dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for lo in range(0, len(hashes), 4096):
        part = hashes[lo : lo + 4096]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, mark, fp`` (a signed long) of every row; the mark is a 64-bit hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "text", 4 << 20)):
            found = np.array([fingerprint(t) for t in batch.column(2).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found)], ["doc_id", "mark", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return by_batch(docs.select("doc_id", F.xxhash64(docs["text"]).alias("mark"), "text"), run, f"doc_id {kind}, mark long, fp long")


def at_anchors(distinct: DataFrame) -> DataFrame:
    """``anchor, fp``: every fingerprint at each code word within two bits of either half."""
    masks = [sum(1 << (i - 1) for i in range(1, 32) if i >> j & 1) for j in range(5)]
    parity = " | ".join(f"shiftleft(bit_count(v & {m}L) & 1, {j})" for j, m in enumerate(masks))
    halves = distinct.selectExpr("fp", "posexplode(array(fp & 2147483647L, shiftright(fp, 31) & 2147483647L)) as (half, v)")
    coded = halves.selectExpr("fp", "half", "v", f"cast({parity} as int) as s")
    nearest = "if(s = 0, v, v ^ shiftleft(1L, s - 1))"
    others = "transform(filter(sequence(1, 31), i -> i < (i ^ s)), i -> v ^ shiftleft(1L, i - 1) ^ shiftleft(1L, (i ^ s) - 1))"
    return coded.selectExpr("fp", "half", f"explode(concat(array({nearest}), {others})) as word").selectExpr("shiftleft(cast(half as long), 32) | word as anchor", "fp")


def forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """A star for each component of the links, which are fingerprints at most BITS bits apart."""
    n = len(fps)
    if n == 2:
        return [(int(fps[0]), int(fps[1]))] if np.bitwise_count((fps[:1] ^ fps[1:]).view(np.uint64))[0] <= BITS else []
    plain = fps.view(np.uint64)  # bitwise_count of a signed number counts its absolute value
    near = np.bitwise_count(plain[:, None] ^ plain[None, :]) <= BITS
    left, links = np.ones(n, dtype=bool), []
    for first in range(n):
        if not left[first]:
            continue
        left[first] = False
        queue = [first]
        while queue:
            new = np.flatnonzero(near[queue.pop()] & left)
            left[new] = False
            links += [(int(fps[first]), int(fps[i])) for i in new]
            queue += new.tolist()
    return links


def links(distinct: DataFrame) -> DataFrame:
    """``a, b``: links between distinct fingerprints, enough to connect every component."""
    crowd = at_anchors(distinct).withColumn("n", F.count("*").over(Window.partitionBy("anchor"))).where("n > 1")
    tiled = crowd.selectExpr(
        "anchor", "fp", f"cast(ceil(n / {TILE}) as int) as t"
    ).selectExpr("anchor", "fp", "t", "cast(pmod(xxhash64(fp), t) as int) as own").selectExpr(
        "anchor", "fp", "explode(transform(sequence(0, t - 1), j -> struct(least(own, j) as i, greatest(own, j) as j))) as tile"
    ).select("anchor", "tile.i", "tile.j", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.empty(0, dtype=np.int64)] * 4
        for batch in batches:
            columns = [np.concatenate([k, c.to_numpy(zero_copy_only=False).astype(np.int64)]) for k, c in zip(kept, batch.columns)]
            if not len(columns[0]):
                continue
            edge = np.flatnonzero(np.any([np.diff(c) != 0 for c in columns[:3]], axis=0)) + 1
            starts = np.concatenate([[0], edge])
            kept = [c[starts[-1] :] for c in columns]
            yield _forests(columns[3], starts[:-1], edge)
        yield _forests(kept[3], np.array([0]), np.array([len(kept[3])]))

    key = ["anchor", "i", "j"]
    return by_batch(tiled.repartition(*key).sortWithinPartitions(*key), run, "a long, b long")


def _forests(fps: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
    found: list[tuple[int, int]] = []
    several = ends - starts > 1
    for a, b in zip(starts[several].tolist(), ends[several].tolist()):
        found += forest(fps[a:b])
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])


def components(rows: DataFrame) -> DataFrame:
    """``fp, component`` of the distinct fingerprints of ``rows``; alone, a fingerprint is its own component."""
    distinct = persist(rows.select("fp").distinct())
    found = persist(links(distinct))
    members = connected_components(found)
    drop(found)
    answer = persist(distinct.join(members.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("component")))
    drop(distinct)
    return answer


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row: the smallest id reachable through links."""
    rows = persist(fingerprints(docs).select("doc_id", "fp"))
    firsts = rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    grouped = persist(components(rows).join(firsts, "fp"))
    # tables of their own: both sides of the joins are plain shuffles, which adaptive execution can split
    lowest = persist(grouped.groupBy("component").agg(F.min("first_id").alias("component_id")))
    answer = persist(grouped.join(lowest, "component").select("fp", "component_id"))
    drop(grouped, lowest)
    return rows.join(answer, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each component, with all columns of ``docs``.

    The row with the smallest id stays (no id: last), of equal ids the one with the
    smallest hash of its text, of rows that repeat both any one.  Rows pass straight
    through but for those that a Bloom filter takes for one that goes.
    """
    rows = persist(fingerprints(docs))
    answer = components(rows)
    counted = persist(rows.join(answer, "fp").groupBy("component", "doc_id", "mark").agg(F.count("*").alias("n")))
    drop(rows, answer)
    place = F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "mark")
    best = persist(counted.groupBy("component").agg(F.min(place).alias("best")))
    stays = place.eqNullSafe(F.col("best"))
    decided = persist(
        counted.join(best, "component").where(~stays | (F.col("n") > 1))
        .select(F.col("doc_id").alias("__doc"), F.col("mark").alias("__mark_of"), stays.alias("__stays"))
    )
    drop(counted, best)
    words = bloom.words_for(decided.count())
    table = persist(bloom.build(decided, F.xxhash64("__doc", "__mark_of"), words))
    whole = docs.select(F.struct("*").alias("__row"), F.xxhash64(docs["text"]).alias("__text_hash"))
    own = F.col("__row")["doc_id"]
    probed = bloom.probe(whole, F.xxhash64(own, "__text_hash"), table, words, "__maybe")
    clean = probed.where(~F.col("__maybe")).select("__row.*")
    met = probed.where("__maybe").join(decided, own.eqNullSafe(F.col("__doc")) & (F.col("__text_hash") == F.col("__mark_of")), "left")
    kept = clean.unionByName(met.where(F.col("__stays").isNull()).select("__row.*"))
    if decided.where("__stays").isEmpty():
        return kept
    repeated = met.where("__stays").groupBy("__doc", "__mark_of").agg(F.first("__row").alias("__row"))
    return kept.unionByName(repeated.select("__row.*"))
