"""Vector code compression through memoised grid cells.

Components become integers, floor(SCALE * x); vectors are cut into PARTS equal parts, each
with a codebook of up to WORDS entries that starts as the parts of the smallest ids and is
moved to its parts' mean, rounded down, ROUNDS times.  A code is the nearest entry of every
part.

The nearest entry is found through a grid: a part's coarse cell is hashed, and for every
cell met the entries are remembered that can be nearest to some point of its box, which are
those whose least distance to the box is not above the smallest of all entries' greatest
distances.  Only these are evaluated exactly, so results do not depend on the grid; its
width follows from how far apart the entries are.  A task remembers two generations of
MEMO cells a part, so its memory is bounded.

A round sends PARTS * WORDS partial sums a task, and as many rows reach the driver; every
other step is a map.  Codebooks are the only thing that is broadcast.

Defined results: a vector that is null, empty or holds a null or non-finite component takes no
part; fewer vectors than WORDS give as many entries; a null id comes last when entries are
chosen, rows of one id in order of their vectors; equal distances go to the lower entry;
repeated rows count each; an empty table has no codebooks and gives no rows; other columns
but the label are not looked at.  Vectors of different lengths, of a length that PARTS does
not divide, or with components beyond what 64-bit distances hold are refused by an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.llm.common import by_batch

PARTS, WORDS, ROUNDS, SCALE = 4, 256, 4, 1024
MEMO, ROWS_AT_ONCE = 1 << 13, 1024


def usable(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """``vec_id, label, vec`` of the rows that take part."""
    v = F.col(vector_column)
    sound = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.coalesce(sound, F.lit(False))).select(F.col(id_column).alias("vec_id"), F.col(label_column).alias("label"), v.alias("vec"))


def whole(values: np.ndarray, width: int) -> np.ndarray:
    """Vectors (rows x parts x components) as integers; ``width`` is that of a part."""
    x = np.floor(values.astype(np.float64) * SCALE)
    most = 1 << (60 - max(1, width).bit_length()) // 2
    if len(x) and np.abs(x).max(initial=0) >= most:
        raise ValueError(f"components of {most / SCALE:g} or more are beyond exact distances")
    return x.astype(np.int64).reshape(-1, PARTS, width)


def vectors_of(column: pa.Array, width: int) -> np.ndarray:
    return whole(column.flatten().to_numpy(zero_copy_only=False), width) if width else np.zeros((len(column), PARTS, 0), dtype=np.int64)


class Grid:
    """The nearest entry of one codebook, through remembered cells."""

    def __init__(self, book: np.ndarray):
        self.book = book
        apart = ((book[:, None, :] - book[None, :, :]) ** 2).sum(-1).astype(np.float64)
        apart[apart == 0] = np.inf
        near = np.sqrt(apart.min(axis=1))
        spacing = float(np.median(near[np.isfinite(near)])) if np.isfinite(near).any() else 1.0
        self.width = max(1, int(spacing / (4 * math.sqrt(max(1, book.shape[1])))))
        self.young: dict[bytes, np.ndarray] = {}
        self.old: dict[bytes, np.ndarray] = {}

    def _survivors(self, cells: np.ndarray) -> list[np.ndarray]:
        """Entries, ascending, that can be nearest somewhere in the box of each cell."""
        out: list[np.ndarray] = []
        for lo in range(0, len(cells), 64):
            low = cells[lo : lo + 64, None, :] * self.width
            above, below = self.book[None] - (low + self.width - 1), low - self.book[None]
            least = (np.maximum(np.maximum(above, below), 0) ** 2).sum(-1)
            most = (np.maximum(np.abs(above), np.abs(below)) ** 2).sum(-1)
            out += [np.flatnonzero(k).astype(np.uint16) for k in least <= most.min(axis=1)[:, None]]
        return out

    def _recall(self, cells: np.ndarray) -> list[np.ndarray]:
        keys = [c.tobytes() for c in cells]
        found = [self.young.get(k) for k in keys]
        missing = []
        for i, k in enumerate(keys):
            if found[i] is None:
                found[i] = self.old.get(k)
                if found[i] is None:
                    missing.append(i)
        for i, kept in zip(missing, self._survivors(cells[missing]) if missing else []):
            found[i] = kept
        for k, kept in zip(keys, found):
            if len(self.young) >= MEMO:
                self.old, self.young = self.young, {}
            self.young[k] = kept
        return found

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry to each row, and its squared distance."""
        index, distance = np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=np.int64)
        for lo in range(0, len(x), ROWS_AT_ONCE):
            some = x[lo : lo + ROWS_AT_ONCE]
            cells, of = np.unique(np.floor_divide(some, self.width), axis=0, return_inverse=True)
            kept = self._recall(cells)
            sizes = np.array([len(k) for k in kept])[of]
            entries = np.concatenate([kept[c] for c in of]).astype(np.int64)
            owner = np.repeat(np.arange(len(some)), sizes)
            d = ((some[owner] - self.book[entries]) ** 2).sum(-1)
            best = np.minimum.reduceat(d, np.cumsum(sizes) - sizes)
            hits = np.flatnonzero(d == best[owner])
            _, first = np.unique(owner[hits], return_index=True)
            index[lo : lo + ROWS_AT_ONCE], distance[lo : lo + ROWS_AT_ONCE] = entries[hits[first]], best
        return index, distance


def width_of(rows: DataFrame) -> int | None:
    """Components of a part; none without rows."""
    low, high = rows.agg(F.min(F.size("vec")), F.max(F.size("vec"))).first()
    if low is None:
        return None
    if low != high or low % PARTS:
        raise ValueError(f"vectors have from {low} to {high} components; one multiple of {PARTS} is needed")
    return low // PARTS


def fit(rows: DataFrame, width: int) -> np.ndarray:
    """Codebooks (parts x entries x components) of the rows of ``usable``."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vec").limit(WORDS).select("vec").toArrow()
    books = np.ascontiguousarray(vectors_of(first.column(0).combine_chunks(), width).transpose(1, 0, 2))
    for _ in range(ROUNDS):
        books = moved(rows, books)
    return books


def moved(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks with every entry at its parts' mean, rounded down; unused ones stay."""
    shared = rows.sparkSession.sparkContext.broadcast(books)
    _, words, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grids = [Grid(b) for b in shared.value]
        counts, sums = np.zeros((PARTS, words), dtype=np.int64), np.zeros((PARTS, words, width), dtype=np.int64)
        for batch in batches:
            x = vectors_of(batch.column(0), width)
            for p, grid in enumerate(grids):
                index = grid.nearest(np.ascontiguousarray(x[:, p]))[0]
                counts[p] += np.bincount(index, minlength=words)
                np.add.at(sums[p], index, x[:, p])
        p, w = np.nonzero(counts)
        if len(p):
            yield pa.RecordBatch.from_arrays(
                [pa.array(p.astype(np.int32)), pa.array(w.astype(np.int32)), pa.array(counts[p, w]), pa.array(list(sums[p, w]), pa.list_(pa.int64()))], ["part", "word", "n", "sums"]
            )

    partial = by_batch(rows.select("vec"), run, "part int, word int, n long, sums array<long>")
    total = partial.groupBy("part", "word").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)]).collect()  # PARTS * WORDS rows at most
    shared.unpersist()
    out = books.copy()
    for r in total:
        out[r["part"], r["word"]] = [r[f"s{i}"] // r["n"] for i in range(width)]
    return out


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """``vec_id, label, code array<int>, error`` of the rows of ``usable``."""
    shared = rows.sparkSession.sparkContext.broadcast(books)
    width = books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grids = [Grid(b) for b in shared.value]
        for batch in batches:
            x = vectors_of(batch.column(2), width)
            found = [g.nearest(np.ascontiguousarray(x[:, p])) for p, g in enumerate(grids)]
            code = np.stack([i for i, _ in found], axis=1).astype(np.int32)
            error = np.sum([d for _, d in found], axis=0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(code), pa.list_(pa.int32())), pa.array(error)], ["vec_id", "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return by_batch(rows, run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code array<int>, error long")


def compress(vectors: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """Codes of all vectors that take part, and the codebooks they refer to."""
    rows = usable(vectors)
    width = width_of(rows)
    books = np.zeros((PARTS, 0, 0), dtype=np.int64) if width is None else fit(rows, width)
    return encode(rows if width is not None else rows.limit(0), books), books
