"""Language-model scoring by deleted interpolation.

P(w | h) = a2 c(hw)/c(h) + a1 c(w)/N + a0 /(V + 1), with weights a for each bucket of the
context's frequency.  Counts for learning the weights leave out a deleted part of the
training texts (one remainder of the id's crc32); expectation-maximisation then fits the
weights on the counts of that part, and scores use the counts of all training texts.

Tokens become numbers where they are read: a chunk of documents is one row with its own
vocabulary.  A chunk sends each distinct word and word pair once, as 64-bit keys packed
by hash part; a part sums the counts of all chunks and sends each chunk its counts back
in the order of its keys.  A pair that is very common costs one key a chunk, so no part
grows hot, and numbers of parts and chunks grow with the input.  All counts cover the
whole corpus.  The driver sees totals and one histogram over a fixed grid of cells.

Defined results: a null text counts as empty and has one token, the end; a null id is
neither held out nor learnt from; with nothing to learn from, c, N and V are 0; repeated
rows are scored each, and learnt from each; other columns are not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.llm.common import slices
from vacantia.durable import persist

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
CHUNK = 16 << 20
FOLDS, HELD_OUT, DELETED = 10, 0, 1
END, START = 0, 1  # local numbers of the end of a text and of what stands before its first word
BUCKETS, STEP, LOWEST = 24, 0.1, 120  # cells of the histogram: a tenth of a decade, down to 1e-12
UNSEEN = 0.1


def _pack(numbers: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(numbers).tobytes(), 1)


def _unpack(packed: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(packed), dtype=kind)


class Numbers(dict):
    """Local numbers of words, given out in order of first sight."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) + 2
        return n


def fold(doc_id) -> int:
    """Remainder that decides a document's part; -1 for a null id."""
    return zlib.crc32(str(doc_id).encode()) % FOLDS if doc_id is not None else -1


def chunks(docs: DataFrame) -> DataFrame:
    """A row a chunk: ids, lengths and local token numbers of its documents, and the words' keys."""

    def pack(number: int, rows: list[tuple]) -> list:
        words, tokens, lengths = Numbers(), [], []
        for _, text in rows:
            found = WORDS.findall((text or "").encode("utf-8", "surrogatepass").lower())
            tokens.append(np.fromiter(map(words.__getitem__, found), dtype=np.int32, count=len(found)))
            tokens.append(np.array([END], dtype=np.int32))
            lengths.append(len(found) + 1)
        keys = np.array([0, 1, *(xxhash.xxh3_64_intdigest(w) for w in words)], dtype=np.uint64)
        return [number, [d for d, _ in rows], lengths, _pack(np.concatenate(tokens)), keys.tobytes()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for whole in batches:
            for batch in slices(whole, "text", CHUNK):
                rows = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
                for deleted in (False, True):
                    if own := [r for r in rows if (fold(r[0]) == DELETED) == deleted]:
                        columns = [[x] for x in [deleted, *pack(number, own)]]
                        kinds = [pa.bool_(), pa.int64(), pa.list_(batch.schema.field(0).type), pa.list_(pa.int32()), pa.binary(), pa.binary()]
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["deleted", "chunk", "docs", "lengths", "tokens", "keys"])
                        number += 1

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"deleted boolean, chunk long, docs array<{kind}>, lengths array<int>, tokens binary, keys binary")


def pair_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    h = left * np.uint64(0x9E3779B97F4A7C15) + right * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Chunk:
    """Keys of a chunk in the order in which they are sent, and where each token's key is."""

    def __init__(self, docs: list, lengths: np.ndarray, tokens: bytes, keys: bytes, parts: int):
        self.docs, self.lengths, self.parts = docs, lengths.astype(np.int64), parts
        self.tokens, self.words = _unpack(tokens, "<i4").astype(np.int64), np.frombuffer(keys, dtype=np.uint64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.before = np.empty_like(self.tokens)
        self.before[1:] = self.tokens[:-1]
        self.before[self.starts] = START
        self.folds = np.array([fold(d) for d in docs])
        pairs, self.pair_of = np.unique(self.before * len(self.words) + self.tokens, return_inverse=True)
        left, right = np.divmod(pairs, len(self.words))
        self.keys = {1: self.words, 2: pair_keys(self.words[left], self.words[right])}
        self.order = {n: np.argsort(k % np.uint64(parts), kind="stable") for n, k in self.keys.items()}

    def own_counts(self, n: int) -> np.ndarray:
        """How often each key of order ``n`` occurs in this chunk's training texts."""
        at = self.tokens if n == 1 else self.pair_of
        learnt = np.repeat(self.folds > HELD_OUT, self.lengths)
        return np.bincount(at[learnt], minlength=len(self.keys[n])).astype(np.int32)

    def sent(self) -> Iterator[tuple[int, int, bytes, bytes]]:
        """order, part, keys, counts."""
        for n, keys in self.keys.items():
            order, counts = self.order[n], self.own_counts(n)
            edges = np.searchsorted((keys % np.uint64(self.parts))[order], np.arange(self.parts + 1, dtype=np.uint64))
            for p in np.flatnonzero(np.diff(edges)).tolist():
                at = order[edges[p] : edges[p + 1]]
                yield n, p, keys[at].tobytes(), _pack(counts[at])

    def place(self, n: int, answers: list[tuple[int, bytes]]) -> np.ndarray:
        """Counts in the order of the keys, from the parts' answers."""
        out = np.zeros(len(self.keys[n]), dtype=np.int64)
        if answers:
            out[self.order[n]] = np.concatenate([_unpack(a, "<i8") for _, a in sorted(answers)])
        return out


def counts(packed: DataFrame, parts: int) -> DataFrame:
    """The counts of every chunk's keys over the corpus: ``kept`` without, ``full`` with the deleted part.

    The columns from ``kept_tokens`` on hold a part's totals, on one row a part.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk(row["docs"], np.array(row["lengths"]), row["tokens"], row["keys"], parts)
                rows = list(chunk.sent())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["deleted"]] * len(rows), pa.bool_()), pa.array([row["chunk"]] * len(rows), pa.int64()), *(pa.array(list(c), k) for c, k in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary(), pa.binary())))],
                    ["deleted", "chunk", "n", "part", "keys", "counts"],
                )

    def add(table: pa.Table) -> pa.Table:
        blobs = [np.frombuffer(k, dtype=np.uint64) for k in table.column("keys").to_pylist()]
        sizes = [len(b) for b in blobs]
        got = np.concatenate([_unpack(c, "<i4") for c in table.column("counts").to_pylist()]).astype(np.float64)
        late = np.repeat(np.array(table.column("deleted").to_pylist()), sizes)
        values, at = np.unique(np.concatenate(blobs), return_inverse=True)
        full = np.bincount(at, weights=got, minlength=len(values)).astype(np.int64)
        kept = full - np.bincount(at, weights=np.where(late, got, 0), minlength=len(values)).astype(np.int64)
        edges = np.cumsum([0, *sizes])
        rest = [0] * (len(sizes) - 1)
        of = lambda x: [_pack(x[at[a:b]]) for a, b in zip(edges[:-1], edges[1:])]
        totals = [kept.sum(), (kept > 0).sum(), full.sum(), (full > 0).sum()]
        return table.select(["deleted", "chunk", "n", "part"]).append_column("kept", pa.array(of(kept), pa.binary())).append_column("full", pa.array(of(full), pa.binary())).append_column(
            "kept_tokens", pa.array([int(totals[0]), *rest], pa.int64())
        ).append_column("kept_types", pa.array([int(totals[1]), *rest], pa.int64())).append_column("tokens", pa.array([int(totals[2]), *rest], pa.int64())).append_column("types", pa.array([int(totals[3]), *rest], pa.int64()))

    sent = packed.mapInArrow(send, "deleted boolean, chunk long, n int, part int, keys binary, counts binary")
    return sent.groupBy("n", "part").applyInArrow(add, "deleted boolean, chunk long, n int, part int, kept binary, full binary, kept_tokens long, kept_types long, tokens long, types long")


def probabilities(chunk: Chunk, words: np.ndarray, pairs: np.ndarray, tokens: int, types: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Bucket, pair and word estimates of every token, and the floor."""
    context = words.copy()
    context[START] = words[END]  # as many texts begin as end
    seen = context[chunk.before]
    p2 = np.where(seen > 0, pairs[chunk.pair_of] / np.maximum(seen, 1), 0.0)
    p1 = words[chunk.tokens] / max(tokens, 1)
    bucket = np.minimum(np.floor(np.log2(seen + 1)).astype(np.int64), BUCKETS - 1)
    return bucket, p2, p1, 1.0 / (types + 1)


def _cell(p: np.ndarray) -> np.ndarray:
    """Cell of a probability on the grid; LOWEST for zero."""
    with np.errstate(divide="ignore"):
        return np.clip(np.round(-np.log10(p) / STEP), 0, LOWEST).astype(np.int64)


def learn_weights(cells: np.ndarray, floor: float, rounds: int = 60) -> np.ndarray:
    """Weights (BUCKETS x 3: pair, word, floor) by expectation-maximisation over ``bucket, pair cell, word cell, count``."""
    weights = np.full((BUCKETS, 3), 1 / 3)
    if not len(cells):
        return weights
    value = np.append(10.0 ** (-STEP * np.arange(LOWEST)), 0.0)
    bucket, n = cells[:, 0], cells[:, 3].astype(np.float64)
    parts = np.stack([value[cells[:, 1]], value[cells[:, 2]], np.full(len(cells), floor)], axis=1)
    for _ in range(rounds):
        share = weights[bucket] * parts
        share *= (n / share.sum(1))[:, None]
        total = np.full((BUCKETS, 3), 0.5)  # keeps every weight above zero
        np.add.at(total, bucket, share)
        weights = total / total.sum(1, keepdims=True)
    return weights


def _chunk_of(table: pa.Table, parts: int) -> Chunk:
    row = table.slice(0, 1).to_pylist()[0]
    return Chunk(row["docs"], np.array(row["lengths"]), row["tokens"], row["keys"], parts)


def _answers(table: pa.Table, n: int, column: str) -> list[tuple[int, bytes]]:
    return [(p, c) for m, p, c in zip(*(table.column(x).to_pylist() for x in ("n", "part", column))) if m == n]


def score(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row."""
    packed = persist(chunks(docs))
    parts = max(8, packed.count())
    found = persist(counts(packed, parts))
    sums = found.where("n = 1").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("kept_tokens", "kept_types", "tokens", "types")]).first()
    kept_tokens, kept_types, tokens, types = sums

    def histogram(left: pa.Table, right: pa.Table) -> pa.Table:
        chunk = _chunk_of(left, parts)
        words, pairs = (chunk.place(n, _answers(right, n, "kept")) for n in (1, 2))
        bucket, p2, p1, _ = probabilities(chunk, words, pairs, kept_tokens, kept_types)
        cell, n = np.unique((bucket * (LOWEST + 1) + _cell(p2)) * (LOWEST + 1) + _cell(p1), return_counts=True)
        return pa.table({"cell": pa.array(cell, pa.int64()), "n": pa.array(n, pa.int64())})

    late = packed.where("deleted").groupBy("chunk").cogroup(found.where("deleted").select("chunk", "n", "part", "kept").groupBy("chunk"))
    grid = late.applyInArrow(histogram, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # at most the grid's cells
    flat = np.array([(r["cell"], r["n"]) for r in grid], dtype=np.int64).reshape(-1, 2)
    rest, word_cell = np.divmod(flat[:, 0], LOWEST + 1)
    bucket, pair_cell = np.divmod(rest, LOWEST + 1)
    weights = learn_weights(np.stack([bucket, pair_cell, word_cell, flat[:, 1]], axis=1), 1.0 / (kept_types + 1))

    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        chunk = _chunk_of(left, parts)
        words, pairs = (chunk.place(n, _answers(right, n, "full")) for n in (1, 2))
        bucket, p2, p1, p0 = probabilities(chunk, words, pairs, tokens, types)
        a = weights[bucket]
        logs = np.log10(a[:, 0] * p2 + a[:, 1] * p1 + a[:, 2] * p0)
        c = words[chunk.tokens]
        base = np.log10((c + UNSEEN) / (tokens + UNSEEN * (types + 1)))
        total = lambda x: np.add.reduceat(x, chunk.starts)
        return pa.table({
            "doc_id": left.column("docs").combine_chunks().flatten(), "held_out": pa.array(chunk.folds == HELD_OUT), "n_tokens": pa.array(chunk.lengths, pa.int64()),
            "n_known": pa.array(total((c > 0).astype(np.int64)), pa.int64()), "base_score": pa.array(total(base)), "score": pa.array(total(logs)),
        })

    kind = docs.schema["doc_id"].dataType.simpleString()
    both = packed.groupBy("chunk").cogroup(found.select("chunk", "n", "part", "full").groupBy("chunk"))
    scored = both.applyInArrow(apply, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
