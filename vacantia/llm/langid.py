"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over a bounded sample of labelled text.  A
text is parsed greedily against each automaton into phrases, every phrase being the
longest match found anywhere in the sample; a phrase names one of the m places of the
sample or says that a symbol follows which the sample lacks, one of w, so c phrases and e
such symbols cost (c * log2(m + 1) + e * log2(w)) / n bits a symbol over a text of n
symbols, and the language with the lowest cost wins.  Every language keeps its
own sample, up to ``sample_symbols``; the price of a phrase makes samples of different
length comparable, so one language with little labelled text takes nothing from others.

Only the fit is bounded (``sample_symbols`` a language, from at most ``sample_docs``
documents in expectation, at most twice as many); prediction parses every whole text.  Texts are parsed in
blocks of BLOCK symbols, each starting at the automaton's root, which adds less than one
phrase a block for every language alike and lets numpy step through many blocks at once.
Every letter of the samples is a symbol of its own.  Ways on by the DENSE most frequent
ones stand in a table that is indexed by state and symbol, ways by other letters in a
sorted list that is searched, so an alphabet of thousands of letters costs no more memory
than its sample.  The automata travel as one broadcast whose size the sample bounds.  No
shuffle of texts.

Defined results: a null text, or one without a letter, is ``und`` with score 0; equal
costs go to the language first by code point; a letter that no sample has is one symbol, the
same for all languages; repeated rows are judged each; no labelled
text at all makes every row ``und``; other columns are not looked at by ``predict`` and
pass through ``keep_known`` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantia.llm.common import by_batch, slices

UNKNOWN = "und"
BLOCK, DENSE = 256, 96
GAP, OTHER = 1, 2  # symbols of anything between words, and of letters that no sample has; 0 pads
ROWS_AT_ONCE = 4096
PIECE = 960 << 10  # bytes of text judged at a time, whose blocks come to about ROWS_AT_ONCE; arrays made of them take eleven times that


def fold(code: int) -> int:
    """The lower-case letter of a code point, 0 if it is no letter."""
    c = chr(code)
    if not c.isalpha():
        return 0
    low = c.lower()
    return ord(low) if len(low) == 1 else code


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


class SuffixAutomaton:
    """Suffix automaton of a sequence of symbols; state 0 is the root."""

    def __init__(self, symbols: list[int]):
        self.next: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for s in symbols:
            new = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and s not in self.next[p]:
                self.next[p][s] = new
                p = link[p]
            if p >= 0:
                q = self.next[p][s]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    twin = len(self.next)
                    self.next.append(dict(self.next[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and self.next[p].get(s) == q:
                        self.next[p][s] = twin
                        p = link[p]
                    link[q] = link[new] = twin
            last = new


class Model:
    """Transition tables of all languages in one array, and the table from code points to symbols."""

    def __init__(self, samples: dict[str, list[str]], sample_symbols: int):
        self.languages = sorted(samples)
        folded = {k: [np.array([fold(c) for c in code_points(t)], dtype=np.int64) for t in texts] for k, texts in samples.items()}
        values, counts = np.unique(np.concatenate([np.empty(0, dtype=np.int64), *(t for texts in folded.values() for t in texts)]), return_counts=True)
        letters = [int(v) for v in values[np.lexsort((values, -counts))] if v]  # the most frequent first
        number = {c: i + 3 for i, c in enumerate(letters)}
        self.symbols = np.full(0x110000, GAP, dtype=np.uint8 if len(letters) < 250 else np.int32)
        for code in range(0x110000):
            if not 0xD800 <= code < 0xE000 and (low := fold(code)):
                self.symbols[code] = number.get(low, OTHER)
        self.width, self.dense = len(letters) + 3, min(len(letters), DENSE) + 3
        streams = []
        for k in self.languages:
            parts = [np.append(self.squeeze([t])[0], self.symbols.dtype.type(GAP)) for t in samples[k]]
            share = max(200, sample_symbols // max(1, len(parts)))
            stream = np.concatenate([p[:share] for p in parts])
            if len(stream) < sample_symbols:
                stream = np.concatenate([stream, *(p[share:] for p in parts)])
            streams.append(stream[:sample_symbols])
        self.lengths = np.array([len(s) for s in streams], dtype=np.int64)
        self.length = int(self.lengths.max(initial=0))
        tables, base = [], 1  # state 0 means that there is no way on
        self.roots, rare = [], []
        for stream in streams:
            machine = SuffixAutomaton(stream.tolist())
            table = np.zeros((len(machine.next), self.dense), dtype=np.int32)
            for state, ways in enumerate(machine.next):
                for s, to in ways.items():
                    if s < self.dense:
                        table[state, s] = to + base
                    else:
                        rare.append(((state + base) * self.width + s, to + base))
            table[:, 0] = np.arange(base, base + len(table))  # padding leaves the state alone
            self.roots.append(base)
            tables.append(table)
            base += len(table)
        self.table = np.concatenate([np.zeros((1, self.dense), dtype=np.int32), *tables])
        rare.sort()
        self.rare_keys = np.array([k for k, _ in rare] + [np.iinfo(np.int64).max], dtype=np.int64)
        self.rare_ways = np.array([w for _, w in rare] + [0], dtype=np.int32)

    def step(self, state: np.ndarray, column: np.ndarray) -> np.ndarray:
        """The states that symbols (one a column) lead to from states (languages x columns); 0 where there is no way."""
        common = column < self.dense
        if common.all():
            return self.table.reshape(-1)[state * self.dense + column]
        to = self.table.reshape(-1)[state * self.dense + np.where(common, column, 0)]
        keys = state[:, ~common].astype(np.int64) * self.width + column[~common]
        at = np.searchsorted(self.rare_keys, keys)
        to[:, ~common] = np.where(self.rare_keys[at] == keys, self.rare_ways[at], 0)
        return to

    def squeeze(self, texts: list[str]) -> list[np.ndarray]:
        """Symbols of each text, with one GAP for whatever stands between words and none at the ends."""
        whole = self.symbols[code_points("\n".join(texts) + "\n")]
        keep = np.ones(len(whole), dtype=bool)
        keep[1:] = ~((whole[1:] == GAP) & (whole[:-1] == GAP))
        ends = np.cumsum([len(t) + 1 for t in texts])
        counts = np.add.reduceat(keep, np.concatenate([[0], ends[:-1]])) if len(texts) else []
        out, at, kept = [], 0, whole[keep]
        for n in counts:
            part = kept[at : at + n]
            at += n
            if len(part) and part[-1] == GAP:
                part = part[:-1]
            if len(part) and part[0] == GAP:
                part = part[1:]
            out.append(part)
        return out

    def phrases(self, parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of phrases of each part against each language, and of symbols that the language's sample lacks."""
        blocks = [-(-len(p) // BLOCK) for p in parts]
        total = sum(blocks)
        grid = np.zeros((total, BLOCK), dtype=self.symbols.dtype)
        row = 0
        for p, n in zip(parts, blocks):
            grid[row : row + n].reshape(-1)[: len(p)] = p
            row += n
        counts, lacks = (np.zeros((total, len(self.languages)), dtype=np.int64) for _ in range(2))
        roots = np.array(self.roots, dtype=np.int32)[:, None]
        for lo in range(0, total, ROWS_AT_ONCE):
            tile = np.ascontiguousarray(grid[lo : lo + ROWS_AT_ONCE].T).astype(np.int32)
            state = np.repeat(roots, tile.shape[1], axis=1)
            count, lack = np.zeros_like(state), np.zeros_like(state)
            for column in tile:
                to = self.step(state, column)
                stuck = to == 0
                count += stuck
                again = self.step(np.broadcast_to(roots, state.shape), column)
                new = stuck & (again == 0)
                lack += new
                state = np.where(stuck, np.where(new, roots, again), to)
            counts[lo : lo + ROWS_AT_ONCE], lacks[lo : lo + ROWS_AT_ONCE] = (count + 1).T, lack.T
        owner = np.repeat(np.arange(len(parts)), blocks)
        out = np.zeros((2, len(parts), len(self.languages)), dtype=np.int64)
        np.add.at(out[0], owner, counts)
        np.add.at(out[1], owner, lacks)
        return out[0], out[1]

    def bits(self, parts: list[np.ndarray]) -> np.ndarray:
        """What each part costs against each language."""
        phrases, lacks = self.phrases(parts)
        return phrases * np.log2(self.lengths + 1) + lacks * np.log2(self.width)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """Language, score (how far the second best is behind, 0 to 1), and bits a symbol of the best."""
        parts = self.squeeze([t or "" for t in texts])
        known = [bool(len(p)) and len(self.languages) > 0 for p in parts]
        found, row = self.bits([p for p, k in zip(parts, known) if k]) if any(known) else np.zeros((0, 1)), 0
        names, scores, costs = [], [], []
        for part, k in zip(parts, known):
            if not k:
                names.append(UNKNOWN), scores.append(0.0), costs.append(0.0)
                continue
            c = found[row]
            row += 1
            best = int(np.argmin(c))
            second = float(np.partition(c, 1)[1]) if len(c) > 1 else 0.0
            names.append(self.languages[best])
            scores.append(float(1 - c[best] / second) if second else 1.0)
            costs.append(float(c[best] / len(part)))
        return names, scores, costs


def judged(model: Model, batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, tuple[list[str], list[float], list[float]]]]:
    """Pieces of a batch, each with the predictions for its texts."""
    for part in slices(batch, column, PIECE):
        yield part, model.predict(part.column(column).to_pylist())


def fit(docs: DataFrame, train: Column, sample_symbols: int = 40_000, sample_docs: int = 120, seed: int = 7) -> Model:
    """Fit on rows where ``train`` holds and ``lang`` and ``text`` are not null.

    The sample is bounded: about ``sample_docs`` documents a language by hash of id and text
    (all, where there are fewer), of which ``sample_symbols`` symbols are used.
    """
    rows = docs.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = dict(rows.groupBy("lang").count().collect())  # one row a language
    if not counts:
        return Model({}, sample_symbols)
    space = 1 << 40
    at = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")), F.lit(space))
    most = F.create_map(*[x for k, n in sorted(counts.items()) for x in (F.lit(k), F.lit(min(space, space * sample_docs // n)))])
    picked = (
        rows.where(at < most[F.col("lang")])
        .select("lang", at.alias("at"), F.substring("text", 1, sample_symbols).alias("text"))
    )
    # rows that repeat id and text are picked together; of them so many stay that the sample keeps its bound
    picked = picked.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("at", "text"))).where(F.col("place") <= 2 * sample_docs).collect()
    samples: dict[str, list[str]] = {}
    for r in sorted(picked, key=lambda r: (r["lang"], r["at"], r["text"])):
        if any(map(str.isalpha, r["text"])):
            samples.setdefault(r["lang"], []).append(r["text"])
    return Model(samples, sample_symbols)


def predict(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, bits`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, (names, scores, costs) in judged(shared.value, whole, text_column):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(costs, pa.float64())], ["doc_id", "lang_pred", "score", "bits"]
                )

    kind = docs.schema[id_column].dataType.simpleString()
    return by_batch(docs.select(id_column, text_column), run, f"doc_id {kind}, lang_pred string, score double, bits double")


def keep_known(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` whose language is known, all columns as they were."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, (names, _, _) in judged(shared.value, whole, "text"):
                yield batch.filter(pa.array([n != UNKNOWN for n in names]))

    return by_batch(docs, run, docs.schema)
