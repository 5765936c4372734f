"""Approximate nearest neighbours by additive quantisation.

A vector is approximated by a sum of full-dimensional code words, one from each
codebook.  Codebooks start as k-means of residuals and are refined jointly by least
squares; encoding is a beam search that keeps the best partial sums.  A query is scored
against a code by adding entries of its lookup table (one inner product a code word),
scaled by the stored norms of vector and approximation, and reranked by the exact inner
product of the original vectors in double precision.

How many are reranked follows from the data: each vector stores its encoding error, and
it is reranked unless its looked-up score, plus MARGIN times the error's spread along
any one direction times the query's norm, is below the k-th best exact score of the
first AHEAD times k by looked-up score.  With errors near normal, one in fifty of the true neighbours at the
very edge of the list is missed at MARGIN 2; no number of candidates is fixed.

The fit is bounded (``sample`` vectors); every row is encoded and searched.  The queries
meet the data in blocks: data rows are dealt once, by hash, to blocks of about BLOCK
rows, and each query is sent to every block.  A task holds one block and reads the
queries as a stream, so neither side is ever whole in memory; the queries sent grow with
their number times that of the blocks.  Vectors that are identical share one code and
one score; a block keeps the ids that can rank.

Defined results: a vector that is null, zero or empty, or holds a null or non-finite
component takes no part, as query or candidate; vectors of different lengths have no
inner product, so each length is searched among its own; a query's own id is never a
candidate; rows that repeat an id are candidates each, and of repeated queries the one
with the least vector answers; ties go to the smaller id; fewer candidates than asked for give all
of them; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantia.durable import persist

BOOKS, WORDS, BEAM = 8, 64, 4
BLOCK, LEAST_BLOCKS, MARGIN, AHEAD = 32_768, 8, 2.0, 8


def usable(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``vec_id, vec array<float>`` of the rows that take part."""
    v = F.col("vec")
    sound = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).alias("vec"))
    return rows.where(F.col("vec_id").isNotNull() & F.coalesce(sound, F.lit(False)))


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = np.argmin((centres**2).sum(1) - 2 * x @ centres.T, axis=1)
        counts = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


def beam_encode(x: np.ndarray, books: list[np.ndarray], beam: int = BEAM) -> np.ndarray:
    """Codes (rows x books) whose sums come closest, found by beam search over the books in turn."""
    n = len(x)
    residual, codes = x[:, None, :], np.zeros((n, 1, 0), dtype=np.uint8)
    for book in books:
        cost = (residual**2).sum(2)[:, :, None] - 2 * residual @ book.T + (book**2).sum(1)
        flat = cost.reshape(n, -1)
        width = min(beam, flat.shape[1])
        best = np.argpartition(flat, width - 1, axis=1)[:, :width]
        parent, word = np.divmod(best, len(book))
        rows = np.arange(n)[:, None]
        residual = residual[rows, parent] - book[word]
        codes = np.concatenate([codes[rows, parent], word[:, :, None].astype(np.uint8)], axis=2)
    return codes[np.arange(n), np.argmin((residual**2).sum(2), axis=1)]


def fit(sample: np.ndarray, books: int = BOOKS, words: int = WORDS, refine: int = 2, seed: int = 5) -> list[np.ndarray]:
    """Codebooks: residual k-means, then ``refine`` rounds of encoding and joint least squares."""
    rng = np.random.default_rng(seed)
    residual, found = sample.astype(np.float32), []
    for _ in range(books):
        centres = _kmeans(residual, words, rng)
        found.append(centres)
        residual = residual - centres[np.argmin((centres**2).sum(1) - 2 * residual @ centres.T, axis=1)]
    sizes = [len(b) for b in found]
    for _ in range(refine):
        codes = np.concatenate([beam_encode(sample[i : i + 4096], found) for i in range(0, len(sample), 4096)])
        hot = np.zeros((len(sample), sum(sizes)), dtype=np.float32)
        base = 0
        for m, size in enumerate(sizes):
            hot[np.arange(len(sample)), base + codes[:, m].astype(np.int64)] = 1
            base += size
        gram = hot.T @ hot + 1e-2 * np.eye(hot.shape[1], dtype=np.float32)
        solved, base = np.linalg.solve(gram, hot.T @ sample), 0
        for m, size in enumerate(sizes):
            found[m] = solved[base : base + size].astype(np.float32)
            base += size
    return found


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(rows, -1) if rows else np.zeros((0, 1))


def encode(rows: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """``vec_id, vec, codes, ratio, error``: stored norm of the vector over that of its approximation, and what scaling leaves over."""
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 2048):
                batch = whole.slice(lo, 2048)
                x = _matrix(batch.column(1), batch.num_rows).astype(np.float32)
                codes = beam_encode(x, shared.value)
                about = sum(book[codes[:, m]] for m, book in enumerate(shared.value))
                norm = np.linalg.norm(about, axis=1)
                ratio = np.where(norm > 0, np.linalg.norm(x, axis=1) / np.where(norm > 0, norm, 1), 1).astype(np.float32)
                error = ((x - about * ratio[:, None]) ** 2).sum(1).astype(np.float32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(ratio), pa.array(error)], ["vec_id", "vec", "codes", "ratio", "error"]
                )

    kind = rows.schema["vec"].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id long, vec {kind}, codes binary, ratio float, error float")


class Block:
    """Rows of one block, ready for queries."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, codes: np.ndarray, ratio: np.ndarray, error: np.ndarray, books: list[np.ndarray]):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x, codes, self.books = ids[order], x[order], codes[order], books
        # identical vectors: one is scored, the k + 1 smallest ids can rank
        _, first, group = np.unique(np.ascontiguousarray(self.x).view(f"V{x.shape[1] * x.itemsize}").ravel(), return_index=True, return_inverse=True)
        self.first, self.members = first, np.argsort(group.ravel(), kind="stable")
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(group.ravel()))])
        self.codes, self.ratio = np.ascontiguousarray(codes[first].T), ratio[order][first]
        self.spread = np.sqrt(error[order][first] / x.shape[1])  # of a vector's encoding error along any one direction
        self.vectors = self.x[first].astype(np.float64)

    def scores(self, queries: np.ndarray) -> np.ndarray:
        """Looked-up scores (queries x distinct vectors)."""
        out = np.zeros((len(queries), len(self.first)), dtype=np.float32)
        for book, words in zip(self.books, self.codes):
            out += (queries.astype(np.float32) @ book.T)[:, words]
        out *= self.ratio
        return out

    def nearest(self, own: int, query: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact scores of the k best for one query, given its looked-up scores."""
        wide = query.astype(np.float64)
        some = AHEAD * (k + 1)
        if len(row) > some:
            start = np.argpartition(row, len(row) - some)[len(row) - some :]
            least = np.sort((self.vectors[start] * wide).sum(axis=1))[-k - 1]  # one more than k, as the query itself may be among them
            near = np.union1d(start, np.flatnonzero(row + MARGIN * float(np.linalg.norm(wide)) * self.spread >= least))
        else:
            near = np.arange(len(row))
        exact = (self.vectors[near] * wide).sum(axis=1)
        sizes = np.minimum(self.starts[near + 1] - self.starts[near], k + 1)
        picked = np.concatenate([self.members[self.starts[g] : self.starts[g] + n] for g, n in zip(near, sizes)]) if sizes.max(initial=0) > 1 else self.first[near]
        exact = np.repeat(exact, sizes)
        kept = self.ids[picked] != own
        picked, exact = picked[kept], exact[kept]
        top = np.lexsort((self.ids[picked], -exact))[:k]
        return self.ids[picked][top], exact[top]

    def search(self, q_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query id, candidate id, exact score) of the k best of this block for every query."""
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        for lo in range(0, len(queries), 64):
            scores = self.scores(queries[lo : lo + 64])
            for own, query, row in zip(q_ids[lo : lo + 64], queries[lo : lo + 64], scores):
                ids, exact = self.nearest(own, query, row, k)
                out.append((np.full(len(ids), own), ids, exact))
        return tuple(np.concatenate(c) for c in zip(*out))


def _block_of(table: pa.Table, books: list[np.ndarray]) -> Block:
    codes = np.frombuffer(b"".join(table.column("codes").to_pylist()), dtype=np.uint8).reshape(table.num_rows, -1)
    numbers = (table.column(c).to_numpy() for c in ("vec_id", "ratio", "error"))
    ids, ratio, error = numbers
    return Block(ids, _matrix(table.column("vec"), table.num_rows), codes, ratio, error, books)


def _search(rows: DataFrame, query: Column, k: int, sample: int) -> DataFrame:
    """``query_id, vec_id, score`` for rows of one length: the k best of every block."""
    spark, n = rows.sparkSession, rows.count()
    space = 1 << 30
    picked = rows.where(F.pmod(F.xxhash64(F.lit(9), "vec_id"), F.lit(space)) < min(space, space * sample // n)).select("vec").limit(2 * sample).collect()
    few = np.array([r["vec"] for r in picked] or [r["vec"] for r in rows.limit(sample).collect()], dtype=np.float32)
    books = fit(few)
    shared = spark.sparkContext.broadcast(books)
    blocks = max(-(-n // BLOCK), min(LEAST_BLOCKS, -(-n // 512)))
    data = encode(rows, books).withColumn("block", F.pmod(F.xxhash64(F.lit(3), "vec_id"), F.lit(blocks))).withColumn("asks", F.lit(False))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block")
    asked = rows.where(query).groupBy("vec_id").agg(F.min("vec").alias("vec")).select("vec_id", "vec", F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("float").alias("ratio"), F.lit(None).cast("float").alias("error"), every).withColumn("asks", F.lit(True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, block = None, [], None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            numbers, asks = table.column("block").to_numpy(), table.column("asks").to_numpy()
            edges = [0, *(np.flatnonzero((np.diff(numbers) != 0) | (asks[1:] != asks[:-1])) + 1).tolist(), table.num_rows]
            for a, z in zip(edges, edges[1:]):
                if a == z:
                    continue
                part = table.slice(a, z - a)
                if numbers[a] != at:
                    at, held, block = numbers[a], [], None
                if not asks[a]:
                    held.append(part)
                    continue
                if block is None and held:
                    block, held = _block_of(pa.concat_tables(held), shared.value), []
                if block is not None:
                    found = block.search(part.column("vec_id").to_numpy(), _matrix(part.column("vec"), part.num_rows), k)
                    yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.float64())], ["query_id", "vec_id", "score"])

    order = ["vec_id", "vec", "codes", "ratio", "error", "block", "asks"]
    both = data.select(order).unionByName(asked.select(order))
    return both.repartitionById(int(blocks), F.col("block").cast("int")).sortWithinPartitions("block", "asks").mapInArrow(run, "query_id long, vec_id long, score double")


def search(vectors: DataFrame, query: Column, k: int = 20, sample: int = 20_000) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest found for every row where ``query`` holds."""
    rows = persist(usable(vectors))
    sizes = [r["d"] for r in rows.where(query).select(F.size("vec").alias("d")).distinct().orderBy("d").collect()]  # a row a length
    if not sizes:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = functools.reduce(DataFrame.unionByName, (_search(rows.where(F.size("vec") == d), query, k, sample) for d in sizes))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
