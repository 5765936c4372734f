"""N-gram Jaccard join by token-combination prefixes.

A document's tokens are the hashes of its distinct WORDS-word shingles.  Two sets of sizes
n and m that are similar share at least ceil(0.85 n) tokens, so in any order of all tokens
their first j common ones lie within the first n - ceil(0.85 n) + j of either (its prefix).
Tokens have classes: a pass over all texts counts them in COUNTERS counters, and a token
whose counter holds many is frequent.  Rare tokens come first in the order.

* If two sets' first common token is rare, both index it, as each indexes the rare tokens
  of its prefix (j = 1) singly.
* Otherwise all they share is frequent.  Frequent tokens are dealt to g groups by hash;
  with prefixes extended to j = g + 1, two of the first g + 1 common ones are of one group,
  and both sets index all pairs within a group.  g follows from the larger set's size, so
  a set indexes for each power of two that a partner's size may have (two at most).

Frequent passages so lead to a bucket only together.  Buckets are looked at in order of
size: every set meets the two before it, and only sets with a similar size three places
away stay for a full comparison, which leaves out pairs that the first links have already
connected and cuts crowded buckets into tiles.  Candidates carry bitmaps of their tokens
(4 to 8 bits each, a quarter of that for neighbours, folded to one length), whose difference bounds the overlap from above;
only pairs that pass are verified by their whole token sets, read from the texts again.
Equal sets are one set from the start.  Components come from distributed rounds.

Tokens and sets are told apart by 64-bit hashes.

Defined results: a null text or one without words has an empty set and is linked with
nothing; fewer than WORDS words make one shingle; repeated rows, and rows that share an id,
get the same component; a null id is reached by links but names no component unless alone
(then it is null); texts of any length count whole; an empty table gives no rows; other
columns are not looked at.
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

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
WORDS, PERCENT, LEAST = 4, 85, 6  # sets of fewer tokens than LEAST are similar to equal ones only
COUNTERS, FREQUENT, TILE, CROWDED = 1 << 20, 64, 1024, 64
NEAR = 2  # neighbours that every set of a bucket meets


def tokens(text: str | None) -> np.ndarray:
    """Sorted hashes of the distinct shingles."""
    words = WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())
    digest = xxhash.xxh3_64_intdigest
    if len(words) < WORDS:
        return np.array([digest(b" ".join(words))] if words else [], dtype=np.uint64).view(np.int64)
    h = np.fromiter(map(digest, words), dtype=np.uint64, count=len(words))
    out = np.zeros(len(h) - WORDS + 1, dtype=np.uint64)
    for k in range(WORDS):
        out = _spread(out + h[k : len(h) - WORDS + 1 + k])
    return np.unique(out.view(np.int64))


def _spread(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def counter(t: np.ndarray) -> np.ndarray:
    return (t.view(np.uint64) & np.uint64(COUNTERS - 1)).astype(np.int64)


def required(n: int) -> int:
    """Tokens that a set of ``n`` shares with any similar one, at least."""
    return -(-PERCENT * n // 100)


def groups_for(n: int) -> int:
    """Groups of frequent tokens where the larger set has ``n`` tokens."""
    return max(1, 1 << n.bit_length() >> 5)


def signatures(t: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, int]:
    """What a set is indexed by, and how many of these are rare tokens, in their order; pairs of frequent ones follow."""
    n = len(t)
    if n < LEAST:
        return np.empty(0, dtype=np.int64), 0
    often = frequent[counter(t)]
    rare, common = t[~often], t[often]
    spare = n - required(n)
    found = []
    for size in sorted({1 << k.bit_length() - 1 for k in (n, 100 * n // PERCENT)}):
        g = groups_for(size)
        use = common[: max(0, spare + g + 1 - len(rare))]
        if len(use) > 1:
            group = _spread(use.view(np.uint64)) & np.uint64(g - 1)
            order = np.argsort(group, kind="stable")
            use, group = use[order].view(np.uint64), group[order]
            for step in range(1, int(np.bincount(group.astype(np.int64)).max())):
                same = group[:-step] == group[step:]
                pair = _spread(_spread(use[:-step][same] + np.uint64(g)) + use[step:][same])
                found.append(pair.view(np.int64))
    single = rare[: spare + 1]
    return np.concatenate([single, np.unique(np.concatenate(found))]) if found else single, len(single)


def bitmap(t: np.ndarray, less: int = 0) -> bytes:
    """4 to 8 bits a token, halved ``less`` times; a half as long one is its halves, one upon the other."""
    size = max(64, 1 << len(t).bit_length() + 2 - less)
    bits = np.zeros(size, dtype=np.uint8)
    bits[(_spread(t.view(np.uint64)) & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def most_shared(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The overlap at most, of sets of ``n`` and ``m`` tokens with bitmaps in the rows of ``a`` and ``b`` (one length)."""
    only_a = np.bitwise_count(a & ~b).sum(-1, dtype=np.int64)
    only_b = np.bitwise_count(b & ~a).sum(-1, dtype=np.int64)
    return np.minimum(n - only_a, m - only_b)


def can_link(shared: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 100 * shared >= PERCENT * (n + m - shared)


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    """Rows of 64-bit words folded to ``words`` of them."""
    return np.bitwise_or.reduce(bits.reshape(len(bits), -1, words), axis=1)


def frequent_counters(docs: DataFrame) -> np.ndarray:
    """One boolean a counter: whether its tokens are frequent.  Shuffles at most COUNTERS small rows a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, dtype=np.int64)
        for batch in (part for whole in batches for part in slices(whole, "text", 4 << 20)):
            found = [tokens(text) for text in batch.column(0).to_pylist()]
            counts += np.bincount(counter(np.concatenate(found)), minlength=COUNTERS)
        at = np.flatnonzero(counts)
        for lo in range(0, len(at), 1 << 16):
            some = at[lo : lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], ["counter", "n"])

    totals = persist(by_batch(docs.select("text"), run, "counter int, n long").groupBy("counter").agg(F.sum("n").alias("n")))
    mean = (totals.agg(F.sum("n")).first()[0] or 0) / COUNTERS
    hot = totals.where(F.col("n") > FREQUENT + 2 * mean).select("counter").toArrow()  # COUNTERS at most
    drop(totals)
    out = np.zeros(COUNTERS, dtype=bool)
    out[hot.column(0).to_numpy()] = True
    return out


def token_sets(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """``doc_id, mark, sid, n, single, sigs, bits, small`` of every row: signatures, the first ``single`` of them rare tokens; an empty set has no ``sid``."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "text", 4 << 20)):
            found = [tokens(t) for t in batch.column(2).to_pylist()]
            sids = [xxhash.xxh3_64_intdigest(t.tobytes()) - (1 << 63) if len(t) else None for t in found]
            signed = [signatures(t, shared.value) for t in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sids, pa.int64()), pa.array([len(t) for t in found], pa.int32()), pa.array([k for _, k in signed], pa.int32()),
                 pa.array([s for s, _ in signed], pa.list_(pa.int64())), *(pa.array([bitmap(t, less) if len(t) >= LEAST else b"" for t in found], pa.binary()) for less in (0, 2))],
                ["doc_id", "mark", "sid", "n", "single", "sigs", "bits", "small"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return by_batch(docs.select("doc_id", F.xxhash64(docs["text"]).alias("mark"), "text"), run, f"doc_id {kind}, mark long, sid long, n int, single int, sigs array<long>, bits binary, small binary")


def whole_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``sid, tokens`` for rows ``sid, doc_id, mark`` of ``wanted``, read from the texts again.

    A Bloom filter of fixed size leaves most other texts in the JVM; the join leaves out its false alarms.
    """
    words = bloom.words_for(wanted.count())
    table = bloom.build(wanted, F.xxhash64("doc_id", "mark"), words)
    rows = docs.select("text", F.xxhash64("doc_id", F.xxhash64(docs["text"])).alias("at"))
    near = bloom.probe(rows, F.col("at"), table, words, "maybe").where("maybe").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "text", 4 << 20)):
            found = [t for t in map(tokens, batch.column(0).to_pylist()) if len(t)]
            sids = [xxhash.xxh3_64_intdigest(t.tobytes()) - (1 << 63) for t in found]
            yield pa.RecordBatch.from_arrays([pa.array(sids, pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["sid", "tokens"])

    return by_batch(near, run, "sid long, tokens array<long>").join(wanted.select("sid"), "sid", "left_semi").dropDuplicates(["sid"])


def may_link(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose small bitmaps allow a link."""
    one = sets.select(F.col("sid").alias("a"), F.col("n").alias("n"), F.col("small").alias("p"))
    two = sets.select(F.col("sid").alias("b"), F.col("n").alias("m"), F.col("small").alias("q"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            n, m = (batch.column(c).to_numpy().astype(np.int64) for c in ("n", "m"))
            p, q = (np.array(batch.column(c).to_pylist(), dtype=object) for c in ("p", "q"))
            sizes = np.array([(len(x), len(y)) for x, y in zip(p, q)], dtype=np.int64).reshape(-1, 2) // 8
            for lengths in np.unique(sizes, axis=0):
                at, words = np.flatnonzero((sizes == lengths).all(axis=1)), int(lengths.min())
                x, y = (fold(np.frombuffer(b"".join(side[at]), dtype=np.uint64).reshape(len(at), -1), words) for side in (p, q))
                keep[at] = can_link(most_shared(x, y, n[at], m[at]), n[at], m[at])
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return by_batch(pairs.join(one, "a").join(two, "b").select("a", "b", "n", "m", "p", "q"), run, "a long, b long")


def verified(docs: DataFrame, pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose whole token sets are similar."""
    ids = pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).distinct()
    wanted = persist(sets.select("sid", "first.doc_id", "first.mark").join(ids, "sid", "left_semi"))
    whole = persist(whole_sets(docs, wanted))
    both = pairs.join(whole.select(F.col("sid").alias("a"), F.col("tokens").alias("p")), "a").join(whole.select(F.col("sid").alias("b"), F.col("tokens").alias("q")), "b")
    shared = F.size(F.array_intersect("p", "q"))
    links = persist(both.where(100 * shared >= PERCENT * (F.size("p") + F.size("q") - shared)).select("a", "b"))
    drop(wanted, whole)
    return links


def met(sets: DataFrame) -> DataFrame:
    """``sig, sid, n, place`` of shared signatures, with the sets before in order of size and whether more than those are of similar size.

    ``place`` counts the tokens that stand before a rare one in its set: as they would be
    shared in an earlier bucket, none of them counts for what this one can bring.
    """
    rows = sets.select("sid", "n", "single", F.posexplode("sigs").alias("at", "sig")).select("sig", "sid", "n", F.when(F.col("at") < F.col("single"), F.col("at")).otherwise(0).alias("place"))
    by_size = Window.partitionBy("sig").orderBy("n", "sid")
    close = lambda less, more: 100 * less >= PERCENT * more
    before = [F.lag(F.struct("sid", "n", "place"), k).over(by_size).alias(f"b{k}") for k in range(1, NEAR + 1)]
    far = F.coalesce(close(F.lag("n", NEAR + 1).over(by_size), F.col("n")), F.lit(False)) | F.coalesce(close(F.col("n"), F.lead("n", NEAR + 1).over(by_size)), F.lit(False))
    found = rows.select("sig", "sid", "n", "place", *before, far.alias("far"))

    def likely(b):
        most = F.least(b["n"] - b["place"], F.col("n") - F.col("place"))
        return b.isNotNull() & (100 * most >= PERCENT * (b["n"] + F.col("n") - most))

    near = F.filter(F.array(*[f"b{k}" for k in range(1, NEAR + 1)]), likely)
    return found.select("sig", "sid", "n", "place", F.transform(near, lambda b: b["sid"]).alias("near"), "far").where("far or size(near) > 0")


def across(crowd: DataFrame, sets: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of one signature that no link has connected and whose bitmaps allow one."""
    rows = crowd.join(members.withColumnRenamed("node", "sid"), "sid", "left").select("sig", "sid", "place", F.coalesce("component", "sid").alias("component"))
    rows = persist(rows)
    open_ = rows.groupBy("sig").agg(F.count("*").alias("size"), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("sig", "size")
    opened = persist(rows.join(open_, "sig"))
    # a set's own crowded signatures: a pair of one is looked at under the first that it shares
    about = opened.groupBy("sid").agg(F.collect_set(F.when(F.col("size") > CROWDED, F.col("sig"))).alias("sigs")).join(sets.select("sid", "n", "bits"), "sid")
    tiled = (
        opened.selectExpr("sig", "sid", "place", "component", f"cast(ceil(size / {TILE}) as int) as t")
        .selectExpr("sig", "sid", "place", "component", "t", "cast(pmod(xxhash64(sid), t) as int) as own")
        .selectExpr("sig", "sid", "place", "component", "own", "explode(transform(sequence(0, t - 1), j -> struct(least(own, j) as i, greatest(own, j) as j))) as tile")
        .select("sig", "tile.i", "tile.j", "own", "sid", "place", "component")
        .join(about, "sid").select("sig", "i", "j", "own", "sid", "place", "component", "n", "bits", "sigs")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([kept, table]) if kept is not None else table
            sig, i, j = (table.column(c).to_numpy() for c in ("sig", "i", "j"))
            edges = np.flatnonzero((np.diff(sig) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1
            starts = [0, *edges.tolist()]
            for lo, hi in zip(starts, starts[1:]):
                yield _tile(table.slice(lo, hi - lo))
            kept = table.slice(starts[-1])
        if kept is not None:
            yield _tile(kept)

    key = ["sig", "i", "j"]
    found = persist(by_batch(tiled.repartition(*key).sortWithinPartitions(*key, "n"), run, "a long, b long").distinct())
    drop(rows, opened)
    return found


def _tile(table: pa.Table) -> pa.RecordBatch:
    """Pairs of a tile in order of size: of different components, of both its sides if it has two, with bitmaps that allow a link, and that share no lesser crowded signature."""
    sig = table.column("sig")[0].as_py()
    lesser = [{s for s in of if s < sig} for of in table.column("sigs").to_pylist()]
    sid, component, own, n, place = (table.column(c).to_numpy() for c in ("sid", "component", "own", "n", "place"))
    n = n.astype(np.int64)
    left = n - place
    two_sided = table.column("i")[0].as_py() != table.column("j")[0].as_py()
    bits = [np.frombuffer(b, dtype=np.uint64) for b in table.column("bits").to_pylist()]
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []
    lengths = np.fromiter(map(len, bits), dtype=np.int64, count=len(bits))
    for length in np.unique(lengths):  # sizes differ by less than two, so bitmaps by a fold at most
        own_rows = np.flatnonzero(lengths == length)
        rest = np.flatnonzero((lengths == length) | (lengths == 2 * length))
        grid = np.concatenate([fold(bits[r][None], length) for r in rest])
        for r, at in zip(own_rows, np.searchsorted(rest, own_rows)):
            last = int(np.searchsorted(n[rest], 100 * n[r] // PERCENT, side="right"))
            later = np.arange(at + 1, last)
            later = later[component[rest[later]] != component[r]]
            if two_sided:
                later = later[own[rest[later]] != own[r]]
            later = later[can_link(np.minimum(left[r], left[rest[later]]), n[r], n[rest[later]])]
            if len(later):
                shared = most_shared(grid[at][None], grid[later], n[r], n[rest[later]])
                hit = rest[later[can_link(shared, n[r], n[rest[later]])]]
                hit = hit[np.fromiter((lesser[r].isdisjoint(lesser[k]) for k in hit), dtype=bool, count=len(hit))]
                a.append(np.minimum(sid[hit], sid[r])), b.append(np.maximum(sid[hit], sid[r]))
    none = [np.empty(0, dtype=np.int64)]
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a or none)), pa.array(np.concatenate(b or none))], ["a", "b"])


def links(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b``: verified links between distinct sets, enough to connect every component."""
    buckets = persist(met(sets))
    near = persist(buckets.select("sid", F.explode("near").alias("other")).select(F.least("sid", "other").alias("a"), F.greatest("sid", "other").alias("b")).distinct())
    first = persist(may_link(near, sets))
    drop(near)
    linked = verified(docs, first, sets)
    members = persist(connected_components(linked))
    more = across(buckets.where("far"), sets, members)
    drop(buckets, members, first)
    rest = verified(docs, more, sets)
    drop(more)
    return linked.unionByName(rest)


def jaccard_join(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row: its set's size and the smallest id reachable through links."""
    rows = persist(token_sets(docs, frequent_counters(docs)))
    narrow = persist(rows.select("doc_id", "sid", "n"))
    sets = persist(rows.where(f"n >= {LEAST}").groupBy("sid").agg(F.any_value("n").alias("n"), F.any_value("single").alias("single"), F.min(F.struct("doc_id", "mark")).alias("first"), F.any_value("sigs").alias("sigs"), F.any_value("bits").alias("bits"), F.any_value("small").alias("small")))
    drop(rows)
    found = links(docs, sets)
    drop(sets)
    members = persist(connected_components(found).withColumnRenamed("node", "sid"))
    firsts = narrow.where("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("first_id"))
    grouped = persist(firsts.join(members, "sid", "left").select("sid", "first_id", F.coalesce("component", "sid").alias("component")))
    lowest = persist(grouped.groupBy("component").agg(F.min("first_id").alias("component_id")))
    answer = persist(grouped.join(lowest, "component").select("sid", "component_id"))
    drop(members, grouped, lowest)
    size = F.col("n").cast("long").alias("n_shingles")
    empty = narrow.where("sid is null").select("doc_id", size, F.col("doc_id").alias("component_id"))
    return narrow.where("sid is not null").join(answer, "sid").select("doc_id", size, "component_id").unionByName(empty)
