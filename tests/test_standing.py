"""Kept states against the log, saved searches against a loop, dependent turns against a loop, spellings of JSON."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from vacantia.durable import new_folder
from vacantia.functions import canonical
from vacantia.operators import reverse, schedule
from vacantia.streaming import feed, standing

EVENT = "sequence long, job_id long, event_type string, ts timestamp"


def events(spark, rows):
    return spark.createDataFrame(rows, "sequence long, job_id long, event_type string, s long").select("sequence", "job_id", "event_type", F.timestamp_seconds("s").alias("ts"))


def test_feed_restarts_and_equals_deltas(spark):
    hour = 3600
    one = [(i, i % 5, "view", i * 60) for i in range(60)] + [(60, None, "view", 0), (None, 3, "view", 0), (61, 9, None, None)]
    two = [(100 + i, i % 3, "click", 20 * hour + i * 60) for i in range(30)] + [(99, 1, "older", 20 * hour), (129, 2, "click", 20 * hour + 29 * 60)]
    folder = new_folder(spark)
    for part in (one, two):
        events(spark, part).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        source = spark.readStream.schema(EVENT).parquet(f"{folder}/in")
        standing.run(spark, source, f"{folder}/out", f"{folder}/cp", 6 * hour * 1000).awaitTermination()
    got = standing.read_changes(spark, f"{folder}/out").cache()
    log = events(spark, one + two).where("job_id is not null and sequence is not null")
    for cursor in (-1, 30, 61, 99, 120, 500):
        want = feed.latest_per(log.where(F.col("sequence") > cursor), "job_id").select("job_id", "sequence")
        assert sorted(map(tuple, standing.since(got, cursor).collect())) == sorted(map(tuple, want.collect()))
    last = {r["job_id"]: r for r in standing.quiet_jobs(got).collect()}
    assert {j: r["n"] for j, r in last.items()} == {0: 22, 1: 23, 2: 23, 3: 12, 4: 12, 9: 1}
    assert {j for j, r in last.items() if r["quiet"]} == {3, 4}  # 9 has no time, so no timer
    assert last[9]["event_type"] is None and last[2]["sequence"] == 129
    moved = got.where("kind = 'changed' and batch > 0 and job_id = 1").first()
    assert (moved["previous"], moved["sequence"]) == (56, 128)
    assert standing.run(spark, source, f"{folder}/out", f"{folder}/cp", 6 * hour * 1000).awaitTermination() is None
    assert standing.read_changes(spark, f"{folder}/out").where("kind = 'changed'").count() == got.where("kind = 'changed'").count()


POSTINGS = "id long, title string, platform string, country string, is_active boolean, extra int"
SEARCHES = "search_id long, title string, exact boolean, platforms array<string>, country string, id int"


def met(posting, search):
    clean = lambda x: " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in (x or "").lower()).split())
    text, asked = clean(posting[1]), clean(search[1])
    return (
        posting[4] is not False and set(asked.split()) <= set(text.split()) and (not search[2] or f" {asked} " in f" {text} " or not asked)
        and (not [p for p in search[3] or [] if p] or posting[2] in [p for p in search[3] if p]) and (not clean(search[4]) or clean(search[4]) == clean(posting[3]))
    )


@pytest.mark.parametrize("per_salt", [reverse.PER_SALT, 3])
def test_saved_searches_equal_a_loop(spark, monkeypatch, per_salt):
    monkeypatch.setattr(reverse, "PER_SALT", per_salt)
    draw = random.Random(5)
    words = ["data", "engineer", "senior", "Red", "QA", "lead-dev"]
    pick = lambda n: " ".join(draw.choice(words) for _ in range(draw.randrange(n)))
    postings = [(i, pick(6), draw.choice(["a", "b", None, ""]), draw.choice(["France", "", None]), draw.choice([True, False, None]), 1) for i in range(80)] + [(80, None, None, None, None, 1), (81, "data " * 5000, "a", "France", True, 1)]
    searches = [(i, pick(3), draw.choice([True, False, None]), draw.choice([None, [], ["a"], ["a", "b", None, "", "a"]]), draw.choice(["france", "Peru", "", None]), 1) for i in range(60)] + [(60, None, None, None, None, 1), (61, "nobody", False, None, None, 1), (0, "data", False, None, None, 1)]
    p, s = spark.createDataFrame(postings, POSTINGS), spark.createDataFrame(searches, SEARCHES)
    want = sorted({(x[0], y[0]) for x, y in itertools.product(searches, postings) if met(y, x)})
    assert len(want) > 300
    assert sorted(map(tuple, reverse.matches(p, s).collect())) == want
    assert reverse.matches(p, s.limit(0)).count() == reverse.matches(p.limit(0), s).count() == 0


def test_counts_of_saved_searches_make_no_pairs(spark):
    draw = random.Random(6)
    words = ["data", "engineer", "senior", "Red", "QA"]
    pick = lambda n: " ".join(draw.choice(words) for _ in range(draw.randrange(n)))
    postings = [(i, pick(5), draw.choice(["a", "b", None, ""]), draw.choice(["France", "", None]), draw.choice([True, False, None]), 1) for i in range(80)]
    searches = [(i, pick(3), draw.choice([True, False, None]), draw.choice([None, [], ["a"], ["a", "b", None, "", "a"]]), draw.choice(["france", "Peru", "", None]), 1) for i in range(60)] + [(0, "data", False, None, None, 1)]
    want = {}
    for x, y in itertools.product(searches, postings):
        if met(y, x):
            want.setdefault(x[0], []).append(y[0])
    p, s = spark.createDataFrame(postings, POSTINGS), spark.createDataFrame(searches, SEARCHES)
    assert {tuple(r) for r in reverse.counted(p, s).collect()} == {(k, len(v), min(v), sum(v)) for k, v in want.items()}
    assert reverse.counted(p, s.limit(0)).count() == reverse.counted(p.limit(0), s).count() == 0
    # every search asks every posting for one word: 4 million pairs, but few rows in any step
    one = spark.range(2000).select("id", F.lit("data").alias("title"), F.lit("a").alias("platform"), F.lit("").alias("country"), F.lit(True).alias("is_active"))
    all_ask = spark.range(2000).select(F.col("id").alias("search_id"), F.lit("data").alias("title"), F.lit(False).alias("exact"), F.lit(None).cast("array<string>").alias("platforms"), F.lit("").alias("country"))
    assert reverse.counted(one, all_ask).agg(F.sum("n"), F.max("ids"), F.min("ids")).first() == (4_000_000, 1999000, 1999000)


def greedy(rows, n):
    """One source after the other, as the rules are told; rows: id, platform, priority, unsure, new, in order."""
    if n <= 0 or len(rows) <= n:
        return {r[0]: 0 for r in rows[: max(n, 0)]}
    names, have = list(dict.fromkeys(r[1] for r in rows)), {}
    for r in rows:
        have[r[1]] = have.get(r[1], 0) + 1
    budget = {}
    while sum(budget.values()) < n:
        for p in names:
            if sum(budget.values()) < n and budget.get(p, 0) < have[p]:
                budget[p] = budget.get(p, 0) + 1
    unsure = sum(r[3] for r in rows)
    cap = 0 if not unsure else n if unsure == len(rows) else min(unsure, max(1, int(n * 0.15)))
    firsts = [next(r for r in rows if r[1] == p) for p in names]
    pools = [[r for r in rows if r[2]][: -(-n // 2)], firsts, [r for r in rows if r[4]][: max(1, -(-n // 4))], rows, rows]
    taken = {}
    for turn, pool in enumerate(pools, 1):
        for r in pool:
            chosen = [x for x in rows if x[0] in taken]
            if len(taken) >= n or r[0] in taken or (turn > 1 and r[3] and sum(x[3] for x in chosen) >= cap):
                continue
            if turn in (2, 4) and r[1] in budget and sum(x[1] == r[1] for x in chosen) >= budget[r[1]]:
                continue
            taken[r[0]] = turn
    return taken


@pytest.mark.parametrize("seed", range(4))
def test_five_passes_equal_a_loop(spark, seed):
    draw = random.Random(seed)
    platforms = ["c"] * (1 + 4 * (seed % 2)) + list("abdefgh")[: 2 + 2 * seed]
    rows = []
    for i in range(40):
        p = draw.choice(platforms)
        rows.append((i, p, draw.random() < 0.3, p == "c" and draw.random() < 0.7, None if draw.random() < 0.4 else 5, draw.randrange(6)))
    df = spark.createDataFrame(rows, "source_id long, platform string, wanted boolean, unsure boolean, last_crawled_at long, rank int")
    told = [(r[0], r[1], r[2], r[3], r[4] is None) for r in sorted(rows, key=lambda r: (r[5], r[0]))]
    for n in (0, 3, 13, 40):
        got = schedule.five_passes(df, n, F.col("wanted"), F.col("unsure"), F.col("rank"), F.col("source_id"))
        assert {r["source_id"]: r["turn"] for r in got.collect()} == greedy(told, n), n


def test_one_spelling(spark):
    same = [['{"b":[1.0,{"z":null,"a":"x"}],"a":2.50}', ' {"a": 2.5, "b": [1, {"a": "\\u0078", "z": null}]} '], ["[]", " [ ]"], ['"s"', ' "s" '], ["{bad", "{bad"], ['{"a":1,"a":1}'] * 2]
    apart = ['{"a":null}', "{}", "[1,2]", "[2,1]", '{"a":{"b":1}}', '{"a":{"b":"1"}}', '["a,1.0"]', '["a,1"]', "", "{bad"]
    h = lambda texts: [r[0] for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(canonical.content_hash(F.col("t"))).collect()]
    for one, two in same:
        a, b = h([one, two])
        assert a == b
    assert len(set(h(apart))) == len(apart) and h([None]) == [None]
    long = '{"b":"' + "x" * 300_000 + '","a":' + "[" * 40 + "]" * 40 + "}"
    assert spark.createDataFrame([(long,)], "t string").select(canonical.canonical_json(F.col("t"))).first()[0].startswith('{"a":[[')
    nested = spark.createDataFrame([(1, '{"y":1,"x":2}')], "k int, props string")
    assert nested.select(canonical.stable_struct("props", "k", json=("props",))).first()[0] == '{"k":1,"props":"{\\"x\\":2,\\"y\\":1}"}'
