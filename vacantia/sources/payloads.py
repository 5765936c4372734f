"""Landed answers of job boards as a batch source: ``spark.read.format("landed_payloads")``.

``land`` appends answers as lines of JSON under ``platform=<name>/day=<date>``; the source
reads any number of such runs back as ``platform, day, token, base_url, payload, malformed``.
Which platforms and days are read is an option of the load: folders that it rules out are not
even listed. It is no filter that Spark pushes down, as in Spark 4.1 all uses of one load share
what was pushed last, so that two branches with different filters lose rows. A slice holds
files of one platform only, many small ones together or a byte range of a large one, so a
platform with a third of all bytes has a third of the slices.

Defined results: a line that is no JSON object, or whose fields are no texts, is one row with
the line in ``malformed`` and nulls in ``token``, ``base_url`` and ``payload``; blank lines are
none; bytes that are no UTF-8 become U+FFFD; a folder without files has no rows, a missing one
raises. Files in the making (names that begin with ``_`` or ``.``) are left out; ``.gz`` and
``.zst`` files are read whole, by one task. Executors open the files by themselves, so the
folder must be of a kind that Arrow reads (local and shared paths, hdfs, s3, gs).
"""

from __future__ import annotations

import datetime
import io
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import DateType, StringType, StructField, StructType

FORMAT = "landed_payloads"
SCHEMA = StructType([StructField(c, DateType() if c == "day" else StringType()) for c in ("platform", "day", "token", "base_url", "payload", "malformed")])
FIELDS = ("token", "base_url", "payload")
SLICE_BYTES = 16 << 20  # of files in one slice, unless the option sliceBytes says otherwise; a Python function over its rows is given no more at once
OPEN_COST = 256 << 10  # what a file counts besides its bytes
BATCH_BYTES = 4 << 20  # of lines in one batch of rows
PACKED = (".gz", ".zst", ".bz2")


@dataclass
class Piece:
    """Bytes of one file, whose lines are those that begin in them."""

    path: str
    day: datetime.date | None
    start: int
    stop: int


class Slice(InputPartition):
    """What one task reads: pieces of one platform's files."""

    def __init__(self, platform: str | None, pieces: list[Piece]):
        super().__init__(None)
        self.platform, self.pieces = platform, pieces


class LandedPayloads(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        if [(f.name, f.dataType) for f in schema] != [(f.name, f.dataType) for f in SCHEMA]:
            raise ValueError(f"{FORMAT} has the columns {SCHEMA.simpleString()}")
        o = self.options
        platforms = json.loads(o["platforms"]) if "platforms" in o else None
        first, last = (datetime.date.fromisoformat(o[c]) if c in o else None for c in ("firstDay", "lastDay"))
        return PayloadReader(o["path"], int(o.get("sliceBytes", SLICE_BYTES)), platforms, first, last)


class PayloadReader(DataSourceReader):
    def __init__(self, path: str, slice_bytes: int, platforms: list[str] | None = None, first_day: datetime.date | None = None, last_day: datetime.date | None = None):
        self.path, self.slice_bytes = path, slice_bytes
        self.platforms, self.first_day, self.last_day = platforms, first_day, last_day

    def partitions(self) -> list[Slice]:
        store, root = _store(self.path)
        slices: list[Slice] = []
        for name, folder in _folders(store, root, "platform"):
            if self.platforms is None or name in self.platforms:
                slices += (Slice(name, pieces) for pieces in self._packed(self._pieces(store, folder)))
        return slices or [Slice(None, [])]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        store, _ = _store(self.path)
        for piece in partition.pieces:
            rows, held = [], 0
            for line in _lines(store, piece):
                if not line.strip():
                    continue
                rows.append(_fields(line))
                held += len(line)
                if held >= BATCH_BYTES:
                    yield _batch(partition.platform, piece.day, rows)
                    rows, held = [], 0
            if rows:
                yield _batch(partition.platform, piece.day, rows)

    def _asked(self, day: datetime.date | None) -> bool:
        if day is None:  # no day is neither after the first nor before the last
            return self.first_day is self.last_day is None
        return (self.first_day is None or day >= self.first_day) and (self.last_day is None or day <= self.last_day)

    def _pieces(self, store: fs.FileSystem, folder: str) -> Iterator[Piece]:
        for name, within in _folders(store, folder, "day"):
            day = datetime.date.fromisoformat(name) if name else None
            if not self._asked(day):
                continue
            for info in _visible(store, within):
                step = info.size if info.path.endswith(PACKED) else self.slice_bytes
                for start in range(0, info.size, max(1, step)):
                    yield Piece(info.path, day, start, min(info.size, start + step))

    def _packed(self, pieces: Iterator[Piece]) -> Iterator[list[Piece]]:
        held, cost = [], 0
        for piece in pieces:
            size = piece.stop - piece.start + OPEN_COST
            if held and cost + size > self.slice_bytes + OPEN_COST:
                yield held
                held, cost = [], 0
            held.append(piece)
            cost += size
        if held:
            yield held


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", path))


def _visible(store: fs.FileSystem, folder: str) -> list[fs.FileInfo]:
    return sorted((i for i in store.get_file_info(fs.FileSelector(folder)) if i.base_name[0] not in "_."), key=lambda i: i.path)


def _folders(store: fs.FileSystem, folder: str, column: str) -> Iterator[tuple[str | None, str]]:
    """Values of ``column`` with their folders."""
    for info in _visible(store, folder):
        name, _, value = info.base_name.partition("=")
        if info.type == fs.FileType.Directory and name == column:
            yield None if value == "__HIVE_DEFAULT_PARTITION__" else unquote(value), info.path


def _lines(store: fs.FileSystem, piece: Piece) -> Iterator[bytes]:
    if piece.path.endswith(PACKED):
        with store.open_input_stream(piece.path, compression="detect") as raw:
            yield from io.BufferedReader(raw, 1 << 20)
        return
    with store.open_input_file(piece.path) as raw:
        if piece.start:
            raw.seek(piece.start - 1)
        f, at = io.BufferedReader(raw, 1 << 20), piece.start
        if piece.start:  # what began before is the piece before's
            at += len(f.readline()) - 1
        while at < piece.stop and (line := f.readline()):
            at += len(line)
            yield line


def _fields(line: bytes) -> tuple[str | None, ...]:
    text = line.decode("utf-8", "replace").rstrip("\r\n")
    try:
        found = json.loads(text)
    except (ValueError, RecursionError):
        found = None
    values = [found.get(c) for c in FIELDS] if isinstance(found, dict) else [0]
    if not all(v is None or isinstance(v, str) for v in values):
        return None, None, None, text
    # a lone half of a pair is no text
    return *[v and v.encode("utf-16", "surrogatepass").decode("utf-16", "replace") if v and not v.isascii() else v for v in values], None


def _batch(platform: str | None, day: datetime.date | None, rows: list[tuple]) -> pa.RecordBatch:
    n, text = len(rows), pa.string()
    columns = [pa.array([platform] * n, text), pa.array([day] * n, pa.date32()), *(pa.array(c, text) for c in zip(*rows))]
    return pa.RecordBatch.from_arrays(columns, names=["platform", "day", *FIELDS, "malformed"])


def land(answers: DataFrame, folder: str) -> None:
    """Append answers ``platform, day, token, base_url, payload`` to a folder; no shuffle, each task writes where its rows belong."""
    line = F.to_json(F.struct(*FIELDS)).alias("value")
    answers.select("platform", "day", line).write.mode("append").partitionBy("platform", "day").text(folder)


def landed(spark: SparkSession, folder: str, platforms: list[str | None] | None = None, first_day: str | None = None, last_day: str | None = None, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Answers of a folder, of the platforms named and from the first day to the last; only their files are opened."""
    spark.dataSource.register(LandedPayloads)
    given = {"platforms": None if platforms is None else json.dumps(platforms), "firstDay": first_day, "lastDay": last_day, "sliceBytes": slice_bytes}
    return spark.read.format(FORMAT).options(**{k: v for k, v in given.items() if v is not None}).load(folder)
