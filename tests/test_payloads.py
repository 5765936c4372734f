"""Landed answers read back: slices, pushed filters, damaged lines, pages of boards."""

import datetime
import gzip
import pathlib

import pytest
from pyspark.sql import functions as F

from vacantia.durable import new_folder
from vacantia.sources import boards, payloads

ANSWER = "platform string, day date, token string, base_url string, payload string"
D = datetime.date


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def folder(spark):
    rows = [(f"p{i % 3}" if i % 7 else None, D(2026, 1, 1 + i % 4) if i % 5 else None, f"t{i}", None if i % 2 else "https://x/é", ["", None, "a\nb\r\u2028\"", "é" * 50, "x" * 3000][i % 5]) for i in range(60)]
    rows += [("sl/ash=%", D(2026, 1, 1), "t", None, "one")] * 2
    path = new_folder(spark)
    for part in (rows[:30], rows[30:]):
        payloads.land(spark.createDataFrame(part, ANSWER).repartition(2), path)
    return path, rows


def test_every_row_once(spark, folder):
    path, rows = folder
    for slice_bytes in (1000, 64 << 20):
        got = payloads.landed(spark, path, slice_bytes=slice_bytes).collect()
        assert sorted(map(repr, (tuple(r)[:5] for r in got))) == sorted(map(repr, rows))
        assert all(r["malformed"] is None for r in got)


@pytest.mark.parametrize("slice_bytes", [1, 7, 100, 3001])
def test_every_line_once_at_any_cut(folder, slice_bytes):
    path, rows = folder
    reader = payloads.PayloadReader(path, slice_bytes)
    got = [tuple(r.values()) for s in reader.partitions() for batch in reader.read(s) for r in batch.to_pylist()]
    assert sorted(map(repr, (r[:5] for r in got))) == sorted(map(repr, rows))


@pytest.mark.parametrize(
    ("platforms", "first", "last", "asked"),
    [
        (["p1"], None, None, "platform = 'p1'"), (["p1", "sl/ash=%"], None, None, "platform in ('p1', 'sl/ash=%')"), ([None], None, None, "platform is null"), (["none"], None, None, "false"), ([], None, None, "false"),
        (None, "2026-01-03", None, "day >= date'2026-01-03'"), (None, "2026-01-02", "2026-01-03", "day between date'2026-01-02' and date'2026-01-03'"), (["p2", None], None, "2026-01-02", "(platform = 'p2' or platform is null) and day <= date'2026-01-02'"),
    ],
)
def test_options_give_what_filters_give(spark, folder, platforms, first, last, asked):
    path, rows = folder
    want = sorted(map(repr, map(tuple, spark.createDataFrame(rows, ANSWER).where(asked).collect())))
    for got in (payloads.landed(spark, path, platforms, first, last), payloads.landed(spark, path).where(asked)):
        assert sorted(map(repr, (tuple(r)[:5] for r in got.collect()))) == want


def test_uses_of_one_load_keep_their_own_filters(spark, folder):
    path, rows = folder
    every = payloads.landed(spark, path)
    both = every.where("platform = 'p1'").unionByName(every.where("platform = 'p2'"))
    assert both.count() == sum(r[0] in ("p1", "p2") for r in rows)
    assert every.count() == len(rows)


def test_ruled_out_folders_are_not_opened(spark, folder):
    path, _ = folder
    slices = payloads.PayloadReader(path, 1000, ["p1"], D(2026, 1, 2), D(2026, 1, 2)).partitions()
    assert slices and all("platform=p1/day=2026-01-02/" in p.path for s in slices for p in s.pieces)
    assert payloads.landed(spark, path, ["p1"], "2026-01-02", "2026-01-02", slice_bytes=1000).rdd.getNumPartitions() == len(slices)


def test_small_files_share_a_slice(spark, folder):
    slices = payloads.PayloadReader(folder[0], 64 << 20).partitions()
    assert len(slices) == len({s.platform for s in slices}) == 5


def test_a_task_is_given_a_small_piece_of_a_large_file(tmp_path):
    place = pathlib.Path(tmp_path) / "platform=x" / "day=2026-02-01"
    place.mkdir(parents=True)
    with (place / "a.txt").open("wb") as f:
        f.truncate(40 << 20)
    slices = payloads.PayloadReader(str(tmp_path), payloads.SLICE_BYTES).partitions()
    assert len(slices) == 3 and all(p.stop - p.start <= 16 << 20 for s in slices for p in s.pieces)


def test_damaged_lines_packed_files_and_no_files(spark, tmp_path):
    place = pathlib.Path(tmp_path) / "platform=x" / "day=2026-02-01"
    place.mkdir(parents=True)
    good = b'{"token":"t","payload":"p","other":1}\n'
    (place / "a.txt").write_bytes(b'\n[1]\n{"token":1}\n{"token":"\xff"}\n{"token":"\\ud800","payload":"\xc3\xa9"}\n' + b"[" * 5000 + b"\n" + good.rstrip())
    (place / "b.txt.gz").write_bytes(gzip.compress(good * 3))
    (place / "_half.txt").write_bytes(good)
    (place / "c.txt").write_bytes(b"")
    for slice_bytes in (100, 64 << 20):
        rows = payloads.landed(spark, str(tmp_path), slice_bytes=slice_bytes).collect()
        assert len(rows) == 9 and sum(r["token"] == "t" for r in rows) == 4
        assert sorted(r["malformed"][:3] for r in rows if r["malformed"]) == ["[1]", "[[[", '{"t']
        assert sorted(r["token"] for r in rows if r["token"] and r["token"] != "t") == ["\ufffd", "\ufffd"]
        assert {r["day"] for r in rows} == {D(2026, 2, 1)}
    bare = pathlib.Path(tmp_path) / "bare"
    bare.mkdir()
    assert payloads.landed(spark, f"file:{bare}").collect() == []
    with pytest.raises(Exception, match="bad_place"):
        payloads.landed(spark, str(tmp_path / "bad_place")).collect()
    with pytest.raises(Exception, match="has the columns"):
        spark.read.format(payloads.FORMAT).schema("a int").load(str(tmp_path)).collect()


def test_pages_of_boards(spark):
    app = '<script>window.__appData = {"jobBoard":{"jobPostings":[{"id":"1","title":" QA ","locationName":"Oslo","departmentName":"D"}]}};</script>'
    links = '<a href="/en/job/A/T_R1?q=1">One</a><a href="https://h/en/job/A/T_R1#x">Apply</a><a href="job/rel_R2">Two</a><a href="/en/job/B/T_R3"> </a><a href="/en/job/C/T_R4"><b>Four</b></a>'
    rows = [("ashby", "t", None, app), ("ashby", "t", None, "<p>nothing</p>"), ("ashby", "t", None, '{"jobs":[{"id":"2","title":"PM","jobUrl":"https://u"}]}'), ("ashby", "t", None, None), ("workday", "co/site", "https://h/en", links), ("workday", "co/site", "https://h/en", links), ("workday", "co/site", None, links)]
    rows += [(p, "t", None, x) for p in boards.PARSERS for x in (None, "", "no json", "[", "{}", "[]", "<", "null")]
    raw = spark.createDataFrame(rows, "platform string, token string, base_url string, payload string")
    got = boards.postings(raw)
    assert got.columns == boards.COLUMNS
    found = sorted((r["platform"], r["source_job_id"], r["title"], r["location"], r["source_url"], r["department"]) for r in got.collect())
    assert found == [
        ("ashby", "1", "QA", "Oslo", "https://jobs.ashbyhq.com/t/1", "D"), ("ashby", "2", "PM", None, "https://u", None),
        ("workday", "R1", "One", None, "https://h/en/job/A/T_R1", None), ("workday", "R4", "Four", None, "https://h/en/job/C/T_R4", None),
    ]
    assert boards.postings(raw.drop("base_url")).where(F.col("title") == "QA").count() == 1
    path = new_folder(spark)
    payloads.land(raw.withColumn("day", F.lit("2026-01-01").cast("date")), path)
    again = boards.landed_postings(spark, path)
    assert again.exceptAll(got).count() == got.exceptAll(again).count() == 0 < again.count()
    assert boards.landed_postings(spark, path, first_day="2026-01-02").count() == 0
