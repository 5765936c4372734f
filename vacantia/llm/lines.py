"""Fuzzy line dedup by MinHash.

All lines but blank ones are compared (after lower-casing and collapsing white space) by
their sets of SHINGLE-character shingles; a line shorter than SHINGLE is its own one
shingle, so only an equal line is similar to it and it needs no bands.  One pass over the
texts hashes every line and computes its MinHash signature; equal lines are merged by a
64-bit key before anything else.  Distinct lines meet in BANDS bands of ROWS hashes; bands of one
line are dropped by a spillable window count, and bands that hold the same set of lines
are looked at once.  Lines that share a band are compared by their true shingle sets, a
pair only in the first band that it shares; a
crowded band is cut into tiles of bounded size, and a tile returns enough links to
connect what is similar rather than all pairs.  Components come from distributed
rounds.  One line of a component stays: the first by document id, then by position.

A row is told from others by its id and a 64-bit hash of its text, nulls being equal, so
rows without an id, or with one id and different texts, are documents of their own.

Lines to compare are read from the texts again, so no whole text is shuffled for them;
at the end a Bloom filter of fixed size lets documents that lose nothing pass straight
through.  Tables are deleted as soon as the next step has been written.

Defined results: a null text stays null; an empty text stays; blank lines are never
touched; repeated rows with one id and one text count as one document; of equal ids the lower hash
of the text is first; a document all of whose
content was removed goes in ``dedup_lines`` (those that were blank before stay); other
columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantia.durable import drop, persist
from vacantia.llm import bloom
from vacantia.llm.common import by_batch, slices
from vacantia.operators.components import connected_components

SHINGLE, SIMILARITY = 8, 0.8
BANDS, ROWS = 12, 4
TILE = 256
_draw = np.random.default_rng(8)
FACTORS = _draw.integers(1, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
SHIFTS = _draw.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)


def normal(line: str) -> str:
    return " ".join(line.lower().split())


def eligible(text: str) -> list[tuple[int, str]]:
    """Number and normal form of the lines that are compared."""
    return [(i, n) for i, line in enumerate(text.split("\n")) if (n := normal(line))]


def line_keys(texts: list[str]) -> np.ndarray:
    """64-bit keys of normal lines."""
    return np.array([xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) for t in texts], dtype=np.uint64).view(np.int64)


def _spread(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint32(16))
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    h *= np.uint32(0xC2B2AE35)
    return h ^ (h >> np.uint32(16))


def signatures(lines: list[str]) -> np.ndarray:
    """Band hashes (lines x BANDS) of normal lines of at least SHINGLE characters."""
    out = np.empty((len(lines), BANDS), dtype=np.int32)
    lo = 0
    while lo < len(lines):  # pieces that stay in the processor's cache
        hi, size = lo, 0
        while hi < len(lines) and (hi == lo or size + len(lines[hi]) < 120_000):
            size += len(lines[hi])
            hi += 1
        out[lo:hi] = _signatures(lines[lo:hi])
        lo = hi
    return out


def _signatures(lines: list[str]) -> np.ndarray:
    points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint32)
    h, step, factor = points * np.uint32(0x9E3779B1), 1, 0x01000193
    while step < SHINGLE:  # doubles the width of what a hash covers
        h = h[:-step] * np.uint32(factor) + h[step:]
        step, factor = step * 2, factor * factor & 0xFFFFFFFF
    sizes = np.fromiter(map(len, lines), dtype=np.int64, count=len(lines))
    starts = np.cumsum(sizes) - sizes
    inside = np.ones(len(points), dtype=bool)
    for k in range(1, SHINGLE):
        inside[starts[1:] - k] = False
    h = _spread(h[inside[: len(h)]])
    at = starts - np.arange(len(lines)) * (SHINGLE - 1)
    least, hashed = np.empty((BANDS * ROWS, len(lines)), dtype=np.uint32), np.empty_like(h)
    for k in range(BANDS * ROWS):
        np.multiply(h, FACTORS[k], out=hashed)
        np.add(hashed, SHIFTS[k], out=hashed)
        np.minimum.reduceat(hashed, at, out=least[k])
    least = _spread(least)
    bands = np.empty((len(lines), BANDS), dtype=np.uint32)
    for b in range(BANDS):
        mixed = np.full(len(lines), b + 1, dtype=np.uint32)
        for k in range(b * ROWS, b * ROWS + ROWS):
            mixed = mixed * np.uint32(0x01000193) ^ least[k]
        bands[:, b] = _spread(mixed)
    return bands.view(np.int32)


def text_hash(docs: DataFrame) -> Column:
    """What tells rows of one id, or of none, apart."""
    return F.xxhash64(docs["text"])


def line_rows(docs: DataFrame) -> DataFrame:
    """``doc_id, mark, line, key, bands`` of every line that is not blank; no bands for one shorter than SHINGLE."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                ids, marks, numbers, texts = [], [], [], []
                for doc, text, mark in zip(*(c.to_pylist() for c in batch.columns)):
                    for i, line in eligible(text or ""):
                        ids.append(doc), marks.append(mark), numbers.append(i), texts.append(line)
                keys = line_keys(texts)
                flat = pa.array(signatures([t for t in texts if len(t) >= SHINGLE]).reshape(-1))
                ends = np.cumsum([0, *(BANDS if len(t) >= SHINGLE else 0 for t in texts)], dtype=np.int32)
                bands = pa.ListArray.from_arrays(pa.array(ends), flat)
                yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(marks, pa.int64()), pa.array(numbers, pa.int32()), pa.array(keys), bands], ["doc_id", "mark", "line", "key", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return by_batch(docs.select("doc_id", "text", text_hash(docs).alias("mark")), run, f"doc_id {kind}, mark long, line int, key long, bands array<int>")


def shingles(line: str) -> set[str]:
    return {line[i : i + SHINGLE] for i in range(max(1, len(line) - SHINGLE + 1))}


def shingle_sets(lines: list[str]) -> list[np.ndarray]:
    """Sorted distinct shingles of lines of at least SHINGLE characters, as numbers that are equal for equal shingles only.

    Up to 256 different characters, eight of them fill 64 bits; of more, pieces of a shingle
    are numbered first.  So numbers hold for one call.
    """
    points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    seen = np.zeros(0x110000, dtype=bool)
    seen[points] = True
    codes, width, step = (np.cumsum(seen) - 1).astype(np.uint64)[points], max(1, int(seen.sum() - 1).bit_length()), 1
    while step < SHINGLE:  # doubles the width of what a number covers
        if 2 * width > 64:
            found, codes = np.unique(codes, return_inverse=True)
            codes, width = codes.astype(np.uint64), max(1, (len(found) - 1).bit_length())
        codes = codes[:-step] << np.uint64(width) | codes[step:]
        step, width = step * 2, width * 2
    ends = np.cumsum(np.fromiter((len(t) - SHINGLE + 1 for t in lines), dtype=np.int64, count=len(lines)))
    starts = np.append(0, ends)[:-1]
    inside = np.ones(len(codes), dtype=bool)
    for k in range(1, SHINGLE):  # what lies across two lines
        inside[starts[1:] + np.arange(1, len(lines)) * (SHINGLE - 1) - k] = False
    codes = codes[inside]
    for start, end in zip(starts.tolist(), ends.tolist()):
        codes[start:end].sort()
    new = np.ones(len(codes), dtype=bool)
    np.not_equal(codes[1:], codes[:-1], out=new[1:])
    new[starts] = True
    return np.split(codes[new], np.cumsum(new)[starts[1:]] - 1) if lines else []


def bitmap(of: np.ndarray) -> int:
    """One of 2,048 bits for every shingle; only ever compared within a call."""
    bits = np.zeros(2048, dtype=bool)
    bits[((of * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(53)).view(np.int64)] = True
    return int.from_bytes(np.packbits(bits).tobytes())


def _enough(a: int, b: int, both: int) -> bool:
    """Exact Jaccard similarity of SIMILARITY or more, of sets of ``a`` and ``b`` that share ``both``."""
    return both >= SIMILARITY * (a + b - both)


def similar(a: set[str], b: set[str]) -> bool:
    return _enough(len(a), len(b), len(a & b))


def _similar(a: np.ndarray, b: np.ndarray) -> bool:
    """``similar`` for sets of one call of ``shingle_sets``."""
    if not _enough(len(a), len(b), min(len(a), len(b))):
        return False
    each = np.sort(np.concatenate([a, b]))
    return _enough(len(a), len(b), int(np.count_nonzero(each[1:] == each[:-1])))


def first_met(a: np.ndarray, b: np.ndarray, band: int) -> np.ndarray:
    """Whether ``band`` is the first in which signatures agree, so that a pair is verified in one bucket only."""
    return (a[..., band] == b[..., band]) & ~(a[..., :band] == b[..., :band]).any(-1)


def similar_links(keys: list[int], lines: list[str], sides: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that connect all lines of one tile that are similar, of at least SHINGLE characters each."""
    return _links(keys, shingle_sets(lines), sides)


def _links(keys: list[int], sets: list[np.ndarray], sides: list[int] | None = None, due: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect all lines of one tile that are similar, each verified.

    A line meets the members of a component only until one is similar, as the rest could
    not connect more.  With ``sides``, only lines of different sides are compared; with
    ``due``, only pairs that it marks, as others are compared where they meet first.
    """
    bits = [bitmap(of) for of in sets]
    out: list[tuple[int, int]] = []

    def alike(i: int, j: int) -> bool:
        a, b = sets[i], sets[j]
        most = len(a) - (bits[i] & ~bits[j]).bit_count()  # each such bit is a shingle of a alone
        return _enough(len(a), len(b), most) and _similar(a, b)

    components: list[list[int]] = []
    for i in range(len(keys)):
        mine, apart = [i], []
        for members in components:
            near = next((j for j in members if (sides is None or sides[j] != sides[i]) and (due is None or due[i, j]) and alike(i, j)), None)
            if near is None:
                apart.append(members)
            else:
                mine = members + mine
                out.append((keys[i], keys[near]))
        components = [*apart, mine]
    return out


def with_lines(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``key, line_text`` for rows ``mark, line, key`` of ``wanted``: the lines' normal forms.

    The texts are read again and only the wanted lines leave them, told by a Bloom filter
    of fixed size; its false alarms are lines that nobody asks for.
    """
    number = F.col("line").cast("long")
    place = F.col("mark").bitwiseXOR(F.shiftleft(number, 32)).bitwiseXOR(F.shiftleft(number, 13)).bitwiseXOR(number)
    words = bloom.words_for(wanted.count())
    table = bloom.as_array(bloom.build(wanted.select(place.alias("place")), F.col("place"), words), words)
    shared = docs.sparkSession.sparkContext.broadcast(table)
    # documents that hold none are left out before their texts leave the JVM
    marks = bloom.build(wanted.select("mark").distinct(), F.col("mark"), words)
    near = bloom.probe(docs.select("text", text_hash(docs).alias("mark")), F.col("mark"), marks, words, "maybe").where("maybe").select("text", "mark")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                marks, numbers, texts = [], [], []
                for text, mark in zip(*(c.to_pylist() for c in batch.columns)):
                    cut = (text or "").split("\n")
                    marks.append(np.full(len(cut), mark, dtype=np.int64)), numbers.append(np.arange(len(cut))), texts.extend(cut)
                n = np.concatenate(numbers)
                maybe = np.flatnonzero(bloom.holds(shared.value, np.concatenate(marks) ^ (n << 32) ^ (n << 13) ^ n))
                found = [line for i in maybe if len(line := normal(texts[i])) >= SHINGLE]
                yield pa.RecordBatch.from_arrays([pa.array(line_keys(found)), pa.array(found, pa.string())], ["key", "line_text"])

    return by_batch(near, run, "key long, line_text string").dropDuplicates(["key"])


def links(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """``a, b``: verified links between keys of distinct lines (``key, mark, line, bands``)."""
    banded = distinct.select("key", F.posexplode("bands").alias("band", "hash")).selectExpr("key", "shiftleft(cast(band as long), 32) | (hash & 4294967295L) as bucket")
    crowd = persist(banded.withColumn("n", F.count("*").over(Window.partitionBy("bucket"))).where("n > 1"))
    # bands that hold the same lines: the first is enough
    sets = crowd.groupBy("bucket").agg(F.first("n").alias("n"), F.sum(F.xxhash64("key").cast("decimal(20,0)")).alias("mark"), F.min("key").alias("low"), F.max("key").alias("high"))
    once = sets.groupBy("n", "mark", "low", "high").agg(F.min("bucket").alias("bucket")).select("bucket")
    tiled = (
        crowd.join(once, "bucket").selectExpr("bucket", "key", f"cast(ceil(n / {TILE}) as int) as t")
        .selectExpr("bucket", "key", "t", "cast(pmod(xxhash64(key), t) as int) as own")
        .selectExpr("bucket", "key", "own", "explode(transform(sequence(0, t - 1), j -> struct(least(own, j) as i, greatest(own, j) as j))) as tile")
        .select("bucket", "tile.i", "tile.j", "own", "key")
    )
    asked = persist(crowd.select("key").distinct().join(distinct.select("key", "mark", "line", "bands"), "key"))
    texts = persist(with_lines(docs, asked.select("key", "mark", "line")).join(asked.select("key", "bands"), "key"))
    rows = tiled.join(texts, "key").select("bucket", "i", "j", "own", "key", "bands", "line_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([kept, table]) if kept is not None else table
            bucket, i, j = (table.column(c).to_numpy() for c in ("bucket", "i", "j"))
            edges = np.flatnonzero((np.diff(bucket) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1
            done = int(edges[-1]) if len(edges) else 0
            yield _pairs(_tiles(table.slice(0, done), edges[:-1]))
            kept = table.slice(done)
        if kept is not None:
            yield _pairs(_tiles(kept, np.empty(0, dtype=np.int64)))

    order = ["bucket", "i", "j"]
    found = persist(by_batch(rows.repartition(*order).sortWithinPartitions(*order, "key"), run, "a long, b long"))
    drop(crowd, asked, texts)
    return found


def _tiles(table: pa.Table, edges: np.ndarray) -> list[tuple[int, int]]:
    """Links of whole tiles; a tile begins at each edge."""
    out: list[tuple[int, int]] = []
    if not table.num_rows:
        return out
    bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
    keys, texts, own = table.column("key").to_pylist(), table.column("line_text"), table.column("own").to_numpy()
    band = table.column("bucket").to_numpy() >> 32
    across = table.column("i").to_numpy() != table.column("j").to_numpy()
    starts = np.concatenate([[0], edges]).astype(np.int64)
    sizes = np.diff(np.append(starts, len(keys)))
    # tiles of two, which most are, all at once
    two = starts[sizes == 2]
    agree = bands[two] == bands[two + 1]
    due = agree.any(1) & (agree.argmax(1) == band[two]) & ~(across[two] & (own[two] == own[two + 1]))
    asked: list[tuple[np.ndarray, np.ndarray | None]] = [(np.array([a, a + 1]), None) for a in two[due].tolist()]
    for a, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
        mine = bands[a : a + n]
        first = first_met(mine[:, None], mine[None, :], int(band[a]))
        np.fill_diagonal(first, False)
        met = np.flatnonzero(first.any(1))
        if len(met):
            asked.append((a + met, first[np.ix_(met, met)]))
    lengths = pc.utf8_length(texts).to_numpy()
    lo = 0
    while lo < len(asked):  # some tiles at a time, so that what is held does not grow with the batch
        hi, size = lo, 0
        while hi < len(asked) and (hi == lo or size < 1_000_000):
            size += int(lengths[asked[hi][0]].sum())
            hi += 1
        some = asked[lo:hi]
        sets = iter(shingle_sets(texts.take(np.concatenate([rows for rows, _ in some])).to_pylist()))
        for rows, first in some:
            of = list(islice(sets, len(rows)))
            if first is None:
                if _similar(*of):
                    out.append((keys[rows[0]], keys[rows[1]]))
            else:  # in a tile of two sides, pairs of one side are compared in that side's own tile
                out += _links([keys[r] for r in rows], of, own[rows].tolist() if across[rows[0]] else None, first)
        lo = hi
    return out


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])


def removed_lines(docs: DataFrame) -> DataFrame:
    """``doc_id, mark, lines array<int>``: the lines that go, for documents that lose any."""
    rows = persist(line_rows(docs))
    firsts = F.struct("doc_id", "mark", "line")
    distinct = persist(
        rows.groupBy("key").agg(F.min(firsts).alias("first"), F.any_value("bands").alias("bands"), F.count("*").alias("n"))
        .select("key", "first.doc_id", "first.mark", "first.line", "bands", "n")
    )
    found = links(docs, distinct)
    members = persist(connected_components(found).withColumnRenamed("node", "key"))
    drop(found)
    grouped = distinct.select("key", "doc_id", "mark", "line", "n").join(members, "key", "left")
    several = persist(grouped.where("n > 1 or component is not null").select("key", "doc_id", "mark", "line", F.coalesce("component", "key").alias("component")))
    drop(distinct, members)
    # both sides of the next join are plain shuffles, which adaptive execution can split
    staying = persist(several.groupBy("component").agg(F.min(firsts).alias("stays")))
    verdict = persist(several.join(staying, "component").select("key", "stays"))
    drop(several, staying)
    gone = persist(
        rows.select("doc_id", "mark", "line", "key").join(verdict, "key").where(~firsts.eqNullSafe(F.col("stays")))
        .groupBy("doc_id", "mark").agg(F.array_sort(F.collect_set("line")).alias("lines"))
    )
    drop(rows, verdict)
    return gone


def dedup_lines(docs: DataFrame, drop_emptied: bool = True) -> DataFrame:
    """``docs`` without the lines that go, all columns kept; see the module for what stays."""
    gone = removed_lines(docs).select(F.col("doc_id").alias("__doc"), F.col("mark").alias("__mark_of"), F.col("lines").alias("__lines"))
    words = bloom.words_for(gone.count())
    table = persist(bloom.build(gone, F.xxhash64("__doc", "__mark_of"), words))
    whole = docs.select(F.struct("*").alias("__row"), text_hash(docs).alias("__text_hash"))  # no name of the input can clash
    own, old = F.col("__row")["doc_id"], F.col("__row")["text"]
    probed = bloom.probe(whole, F.xxhash64(own, "__text_hash"), table, words, "__maybe")
    clean = probed.where(~F.col("__maybe")).select("__row.*")
    met = probed.where("__maybe").join(gone, own.eqNullSafe(F.col("__doc")) & (F.col("__text_hash") == F.col("__mark_of")), "left")
    kept = F.filter(F.split(old, "\n", -1), lambda x, i: ~F.array_contains("__lines", i))
    text = F.when(F.col("__lines").isNull(), old).otherwise(F.array_join(kept, "\n"))
    cut = met.withColumn("__left", text)
    if drop_emptied:
        cut = cut.where(F.col("__lines").isNull() | F.col("__left").rlike(r"\S"))
    changed = cut.select(*[F.col("__left").alias(c) if c == "text" else F.col("__row")[c].alias(c) for c in docs.columns])
    return clean.unionByName(changed)
