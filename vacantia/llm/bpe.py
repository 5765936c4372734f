"""BPE encoding and decoding with a public byte-level vocabulary.

Encoding backtracks: an Aho-Corasick pass finds the longest token that starts at each
byte of a word, and a token is taken only if the pair-compatibility table says that the
merges would leave the border between it and its left neighbour alone.  A token that
does not fit is shortened to its longest prefix in the vocabulary; when none is left the
neighbour is taken back.  Each byte position is given up at most once, so the work is
linear in the word, and the result equals that of the merges applied one by one.
Decoding gathers the bytes of all ids through a table of offsets into one array.

The vocabulary file is a parameter.  The driver reads it and broadcasts its two lists,
whose size the file bounds.  Documents never leave their partition: no shuffle.

Defined results: a null text counts as empty; an empty text has no ids; repeated rows
are encoded each; the text of a special token is that token, wherever it stands; other
columns are not looked at.

A text of any length is encoded whole, in one task; a batch is cut so that few texts are
Python strings at a time.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from vacantia.llm.common import by_batch, slices

# Fixed value: the split pattern of the vocabulary's byte-level pre-tokenizer. The white
# space is spelled out as Unicode's White_Space property.
SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LATIN = r"A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"

#: The same over texts of ASCII and Latin letters alone, where the plain engine's classes suffice.
PLAIN = re.compile(rf"[\t-\r\x20-\x7e{LATIN}]*")
PLAIN_PATTERN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LATIN}]+| ?[0-9]+| ?[^\t-\r\x200-9{LATIN}]+|[\t-\r\x20]+(?![^\t-\r\x20])|[\t-\r\x20]+")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary file."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_vocabulary(path: str) -> tuple[list[bytes], list[tuple[int, int, int]], dict[str, int]]:
    """Bytes by id, merges as (left, right, made) in order of rank, special tokens."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    letters = byte_letters()
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ids = spec["model"]["vocab"]
    tokens = [b""] * (max(max(ids.values()), *special.values(), 0) + 1)
    for word, i in ids.items():
        tokens[i] = word.encode() if word in special else bytes(letters[c] for c in word)
    for word, i in special.items():
        tokens[i] = word.encode()
    merges = []
    for pair in spec["model"]["merges"]:
        left, right = pair.split(" ") if isinstance(pair, str) else pair
        merges.append((ids[left], ids[right], ids[left + right]))
    return tokens, merges, special


PIECE = 4 << 20  # bytes of text that are Python strings at a time
LONGEST_REMEMBERED = 64  # characters; bounds the memory of a worker together with the number of words


class Codec:
    """Encoder and decoder of one vocabulary.

    ``remembered``: short words whose ids are kept at most, in two halves; when the newer
    half is full the older one goes, so words that keep coming stay.  Pairs of tokens found
    to fit or not are as many at most.  By default both take some 80 MB, however long a worker lives.
    """

    def __init__(self, tokens: list[bytes], merges: list[tuple[int, int, int]], special: dict[str, int], remembered: int = 250_000):
        self.special, self.remembered = special, remembered
        self.split = regex.compile(PATTERN).findall
        self.cut = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        plain = [i for i in range(len(tokens)) if tokens[i] and i not in set(special.values())]
        made = {m: rank for rank, (_, _, m) in enumerate(merges)}
        self.rank = {i: made.get(i, -1) for i in plain}  # single bytes come before every merge
        self.parts = {m: (a, b) for a, b, m in merges}
        self.joined = {(a, b): (rank, m) for rank, (a, b, m) in enumerate(merges)}
        self.size = [len(t) for t in tokens]
        by_bytes = {tokens[i]: i for i in plain}
        self.shorter = {}
        for word, i in by_bytes.items():
            self.shorter[i] = next((j for n in range(len(word) - 1, 0, -1) if (j := by_bytes.get(word[:n])) is not None), -1)
        self.machine = ahocorasick.Automaton()
        for word, i in by_bytes.items():
            self.machine.add_word(word.decode("latin-1"), (len(word), i))
        self.machine.make_automaton()
        self.fits: dict[tuple[int, int], bool] = {}
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        sizes = np.array(self.size, dtype=np.int64)
        self.lengths, self.offsets = sizes, np.concatenate([[0], np.cumsum(sizes)[:-1]])
        self.bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges keep the border between these two tokens. Unfolds whichever side was made last."""
        if (known := self.fits.get((left, right))) is not None:
            return known
        a, b, limit, result = left, right, len(self.joined), True
        while True:
            # (rank, side): at equal ranks the leftmost pair is merged first
            if (over := self.joined.get((a, b))) and over[0] < limit:
                result = False
                break
            ra, rb = self.rank[a], self.rank[b]
            if ra < 0 and rb < 0:
                break
            if ra > rb:
                a, limit = self.parts[a][1], ra
            else:
                b, limit = self.parts[b][0], rb + 1
        if len(self.fits) > self.remembered:
            self.fits.clear()
        self.fits[left, right] = result
        return result

    def encode_word(self, word: bytes) -> list[int]:
        """Ids of one piece between the pre-tokenizer's borders."""
        n, compatible, sizes = len(word), self.compatible, self.size
        longest = [-1] * (n + 1)
        for end, (size, i) in self.machine.iter(word.decode("latin-1")):
            longest[end + 1 - size] = i  # ends ascend, so the last one is the longest
        taken: list[int] = []
        closed = bytearray(n + 1)  # positions that were tried and given up
        at, token = 0, longest[0]
        while at < n:
            while token >= 0:
                end = at + sizes[token]
                if not closed[end] and (not taken or compatible(taken[-1], token)):
                    break
                token = self.shorter[token]
            if token >= 0:
                taken.append(token)
                at, token = end, longest[end]
            else:
                closed[at] = 1
                token = taken.pop()
                at -= sizes[token]
        return taken

    def _pack(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = np.array(self.encode_word(word.encode()), dtype="<u4").tobytes()
        if len(word) <= LONGEST_REMEMBERED:
            if 2 * len(self.words) >= self.remembered:
                self.words, self.older = {}, self.words
            self.words[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not self.cut or not self.cut.search(text):
            return self._segment(text)
        out, at = [], 0
        for hit in self.cut.finditer(text):
            out += [self._segment(text[at : hit.start()]), np.array([self.special[hit[0]]], dtype="<u4").tobytes()]
            at = hit.end()
        return b"".join([*out, self._segment(text[at:])])

    def _segment(self, text: str) -> bytes:
        pieces = (PLAIN_PATTERN.findall if PLAIN.fullmatch(text) else self.split)(text)
        packed = list(map(self.words.get, pieces))
        if None in packed:
            packed = [self.words.get(w) or self._pack(w) if p is None else p for w, p in zip(pieces, packed)]
        return b"".join(packed)

    def decode(self, ids: np.ndarray) -> str:
        """Text of the ids, through the offset table; broken UTF-8 becomes replacement characters."""
        sizes = self.lengths[ids]
        ends = np.cumsum(sizes)
        if not len(ids):
            return ""
        at = np.arange(ends[-1]) + np.repeat(self.offsets[ids] - (ends - sizes), sizes)
        return self.bytes[at].tobytes().decode("utf-8", "replace")


class Vocabulary:
    """What workers are sent: the lists of a vocabulary.

    A worker's copy turns into its codec when first asked.  Spark's workers go on to other
    tasks and let a broadcast go with the first that has no use for it; the codec and the
    words that it remembers, of the size of a stage's other memory, go with it.
    """

    def __init__(self, tokens: list[bytes], merges: list[tuple[int, int, int]], special: dict[str, int]):
        self.lists, self.made = (tokens, merges, special), None

    def codec(self) -> Codec:
        if self.made is None:
            self.made, self.lists = Codec(*self.lists), None
        return self.made


def encode(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, ids array<int>, n_tokens`` of each row; a null text counts as empty."""
    spec = docs.sparkSession.sparkContext.broadcast(Vocabulary(*read_vocabulary(vocabulary)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = spec.value.codec()
        for batch in (part for whole in batches for part in slices(whole, text_column, PIECE)):
            ids = [np.frombuffer(codec.encode(t or ""), dtype="<u4").astype(np.int32) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([len(i) for i in ids], pa.int64())], ["doc_id", "ids", "n_tokens"]
            )

    kind = docs.schema[id_column].dataType.simpleString()
    return by_batch(docs.select(id_column, text_column), run, f"doc_id {kind}, ids array<int>, n_tokens long")


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; null ids give an empty text."""
    spec = encoded.sparkSession.sparkContext.broadcast(Vocabulary(*read_vocabulary(vocabulary)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = spec.value.codec()
        for batch in batches:
            texts = [codec.decode(np.array(i or [], dtype=np.int64)) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return by_batch(encoded.select("doc_id", "ids"), run, f"doc_id {kind}, text string")


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Encode, decode from the ids, and digest both: ``doc_id, n_tokens, ids_sha256, decoded_sha256, exact``.

    ``exact``: the decoded text is the text. Both directions run in one pass, so the ids
    are not written out only to be read again.
    """
    spec = docs.sparkSession.sparkContext.broadcast(Vocabulary(*read_vocabulary(vocabulary)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = spec.value.codec()
        for batch in (part for whole in batches for part in slices(whole, "text", PIECE)):
            counts, id_sums, text_sums, same = [], [], [], []
            for text in batch.column(1).to_pylist():
                packed = codec.encode(text or "")
                back = codec.decode(np.frombuffer(packed, dtype="<u4"))
                counts.append(len(packed) // 4)
                id_sums.append(hashlib.sha256(packed).hexdigest())
                text_sums.append(hashlib.sha256(back.encode()).hexdigest())
                same.append(back == (text or ""))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(id_sums, pa.string()), pa.array(text_sums, pa.string()), pa.array(same, pa.bool_())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "exact"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return by_batch(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, exact boolean")
