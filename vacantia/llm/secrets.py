"""Secret scan: keyword automaton, anchored expressions near its hits, then checksums.

One Aho-Corasick pass over the lower-cased text finds every keyword; an expression is
tried only at a hit, anchored to it.  Kinds whose tokens carry a checksum are reported
only if it holds.  Runs of hex digits have no keyword; a run that is long enough covers
every position that is a multiple of its least length, so those positions alone are
probed and the run around a probe is matched.  No shuffle: each text is scanned where
it is read.

Base kinds: assign, access, hex.  Added kinds: github and npm (a CRC-32 of the token's
body in base 62 is its last six characters), jwt (the first part must decode to a JSON
object with "alg").

Defined results: a null or empty text has no spans; spans of one kind never overlap,
leftmost first; spans of different kinds may.  Positions are code points, the end is
exclusive.  A text of any length is scanned whole, in one task and in time proportional
to it.  Repeated rows are scanned each; an empty table gives no rows; other columns are
not looked at.
"""

from __future__ import annotations

import base64
import json
import re
import string
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vacantia.llm.common import by_batch, slices

# Kinds in order of report, keywords and patterns of the contract, and the
# public formats of the added kinds.
KINDS = ("assign", "access", "hex", "github", "npm", "jwt")
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "api_key": "assign", "apikey": "assign",
    "akia": "access", "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github", "npm_": "npm", "eyj": "jwt",
}
PATTERNS = {
    "assign": re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "github": re.compile(r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
    "npm": re.compile(r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
    "jwt": re.compile(r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
}
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
HEX_RUN, TOKEN_RUN = re.compile(r"[0-9a-f]+"), re.compile(r"[A-Za-z0-9_-]*")
BASE62 = string.digits + string.ascii_uppercase + string.ascii_lowercase


def crc_base62(body: str) -> str:
    """CRC-32 of the body in base 62, six characters."""
    n, out = zlib.crc32(body.encode()), ""
    while n:
        n, r = divmod(n, 62)
        out = BASE62[r] + out
    return out.rjust(6, "0")


def holds(kind: str, token: str) -> bool:
    """The embedded check of an added kind."""
    if kind in ("github", "npm"):
        body = token.partition("_")[2]
        return crc_base62(body[:-6]) == body[-6:]
    head = token.partition(".")[0]
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, TypeError):
        return False


def kept(kind: str, hit: re.Match) -> bool:
    """Whether a match is long enough, or passes its checksum."""
    if kind == "assign":
        return len(hit[1]) >= LEAST_ASSIGN
    if kind == "access":
        return len(hit[0]) >= LEAST_ACCESS
    return holds(kind, hit[0])


def automaton() -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        machine.add_word(word, (len(word), kind))
    machine.make_automaton()
    return machine


IS_HEX = np.zeros(0x110000, dtype=bool)
IS_HEX[[ord(c) for c in "0123456789abcdef"]] = True


def hex_runs(text: str) -> Iterator[tuple[int, int]]:
    """Maximal runs of LEAST_HEX or more hex digits, through probes LEAST_HEX apart."""
    probes = text[LEAST_HEX - 1 :: LEAST_HEX]
    if not probes:
        return
    done = 0
    hits = np.flatnonzero(IS_HEX[np.frombuffer(probes.encode("utf-32-le", "surrogatepass"), dtype="<u4")])
    for at in (hits * LEAST_HEX + LEAST_HEX - 1).tolist():
        if at < done:
            continue
        # leftwards no further than the probe before, which was no hex digit or in a shorter run
        start = at
        while start and text[start - 1] in "0123456789abcdef":
            start -= 1
        done = HEX_RUN.match(text, at).end()
        if done - start >= LEAST_HEX:
            yield start, done


def scan(text: str, machine: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """(start, rank of the kind, end) in order."""
    low = text.lower()
    if len(low) != len(text):  # a letter whose lower case is longer
        low = text.encode().lower().decode()
    hits = sorted({(end + 1 - size, kind) for end, (size, kind) in machine.iter(low)})
    done, spans = dict.fromkeys(KINDS, 0), []
    for start, kind in hits:
        if start >= done[kind] and (hit := PATTERNS[kind].match(text, start)):
            if kind in ("assign", "access") or kept(kind, hit):
                done[kind] = hit.end()
            if kept(kind, hit):
                spans.append((start, KINDS.index(kind), hit.end()))
        elif start >= done[kind] and kind == "jwt":
            done[kind] = TOKEN_RUN.match(text, start).end()  # what fails here fails from anywhere in the same run
    spans += [(a, KINDS.index("hex"), b) for a, b in hex_runs(text)]
    return sorted(spans)


def find_secrets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, spans array<struct<kind, start, end, value>>`` for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton()
        for batch in (part for whole in batches for part in slices(whole, text_column, 4 << 20)):
            out = []
            for text in batch.column(1).to_pylist():
                out.append([{"kind": KINDS[k], "start": a, "end": b, "value": text[a:b]} for a, k, b in scan(text or "", machine)])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], ["doc_id", "spans"])

    kind = docs.schema[id_column].dataType.simpleString()
    return by_batch(docs.select(id_column, text_column), run, f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint,value:string>>")
