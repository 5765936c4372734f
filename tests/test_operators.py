"""Entities, merges, schedules, parsers, versions and streams on small tables."""

import datetime
import json
import random

from pyspark.sql import functions as F

from tests.conftest import SMALL
from vacantia.operators import resolve, schedule
from vacantia.operators.components import connected_components
from vacantia.sources import boards, pages, tables
from vacantia.streaming import feed

T0 = datetime.datetime(2024, 1, 1)
JOB = "pos long, platform string, company_slug string, source_job_id string, lookup_keys array<string>, source_url string, apply_url string, resolved_url string, canonical_url string, company string, title string, location string, fingerprint string, link_status string, validated_at string, posted_at timestamp, discovered_at timestamp"


def job(pos, platform="lever", slug="acme", job_id=None, keys=(), source=None, apply=None, canonical=None, title="Engineer", place="Paris", link="unknown"):
    return (pos, platform, slug, job_id or str(pos), list(keys), source or f"https://s/{pos}", apply or f"https://a/{pos}", None, canonical, "Acme", title, place, None, link, None, T0, T0 + datetime.timedelta(hours=pos))


def test_components(spark):
    rnd = random.Random(3)
    edges = [(rnd.randint(0, 80), rnd.randint(0, 80)) for _ in range(45)] + [(200 + i, 201 + i) for i in range(40)] + [(500, 500 + i) for i in range(1, 60)]
    parent = {n: n for e in edges for n in e}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        lo, hi = sorted((root(a), root(b)))
        parent[hi] = lo
    linked = {n for a, b in edges if a != b for n in (a, b)}
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: root(n) for n in linked}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_entities(spark):
    rows = [
        job(0, "lever", canonical="https://c/1"), job(1, "greenhouse", canonical="https://c/1", link="valid"), job(2, apply="https://same"), job(3, "ashby", apply="https://same"),
        job(4, title="Similar"), job(5, title="Similar"), job(6, job_id="x", slug="b1"), job(7, job_id="x", slug="b2"), job(8, "ashby", canonical="https://c/1", apply="https://same"),
    ]
    df = spark.createDataFrame(rows, JOB)
    entity = {r["pos"]: r["entity"] for r in resolve.entities(df).collect()}
    assert entity == {0: 0, 1: 0, 2: 0, 3: 0, 8: 0, 4: 4, 5: 5, 6: 6, 7: 7}
    best = {r["entity"]: r for r in resolve.dedupe(df).collect()}
    assert best[0]["pos"] == 1 and best[0]["records"] == 5 and best[0]["discovered_at"] == T0
    why = {r["pos"]: (r["kept_pos"], r["reason"]) for r in resolve.decisions(df).collect()}
    assert why[0] == (1, "dedupe:canonical_url") and why[2] == (1, "dedupe:apply_url") and 4 not in why
    shuffled = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), JOB)
    assert {r["pos"]: r["entity"] for r in resolve.entities(shuffled).collect()} == entity


def test_quotas_and_reserves(spark):
    caps = spark.createDataFrame([("a", 1), ("b", 5), ("c", 0)], "platform string, cap int")
    assert {r["platform"]: r["quota"] for r in schedule.quotas(caps, "platform", "cap", 4).collect()} == {"a": 1, "b": 3, "c": 0}


def test_boards(spark):
    payloads = [
        ("greenhouse", "acme-co", json.dumps({"jobs": [{"id": 7, "title": " Engineer ", "absolute_url": "https://boards.greenhouse.io/acme/jobs/7", "updated_at": "2024-01-02T00:00:00Z", "location": {"name": "Paris"}, "content": "&lt;p&gt;We sponsor&lt;/p&gt;"}]})),
        ("lever", "beta", json.dumps([{"id": "u1", "text": "Analyst", "hostedUrl": "https://jobs.lever.co/beta/u1", "createdAt": 1700000000000, "categories": {"location": "Berlin", "allLocations": ["Berlin", "Remote"], "commitment": "Full-time"}}])),
        ("ashby", "gamma", json.dumps({"jobs": [{"id": "z", "title": "", "location": "Oslo", "jobUrl": "https://jobs.ashbyhq.com/gamma/z", "employmentType": "FullTime"}]})),
        ("smartrecruiters", "delta", json.dumps({"content": [{"id": "9", "name": "Staff Engineer", "location": {"city": "Rome", "country": "it"}, "releasedDate": "2024-02-03T00:00:00Z"}]})),
        ("lever", "broken", "{not json"),
    ]
    rows = {r["token"]: r for r in boards.normalize(boards.postings(spark.createDataFrame(payloads, "platform string, token string, payload string"))).collect()}
    assert set(rows) == {"acme-co", "beta", "gamma", "delta"}
    g = rows["acme-co"]
    assert (g["title"], g["company"], g["location"], g["sponsorship_hint"], g["drop_reason"]) == ("Engineer", "Acme Co", "Paris", "unknown", None) and g["description"] == "We sponsor"
    assert rows["beta"]["location"] == "Berlin; Remote" and rows["beta"]["employment_type"] == "full_time" and rows["beta"]["remote_type"] == "remote"
    assert rows["gamma"]["drop_reason"] == "empty_title" and rows["delta"]["experience"]["level"] == "staff"


def test_pages(spark):
    html = '<a href="/jobs/1">Data <b>Engineer</b></a><a href="/about">About us</a><script id="__NEXT_DATA__" type="application/json">{"a": {"jobs": [1]}}</script><script type="application/ld+json">[{"@type": "JobPosting", "title": "A", "x": {"@type": "JobPosting", "title": "B"}}]</script><script type="application/ld+json">broken</script>'
    df = spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")
    assert sorted(json.loads(r["posting"])["title"] for r in pages.job_postings(df).collect()) == ["A", "B"]
    assert [(r["href"], r["label"]) for r in pages.anchors(df, "page_id", "html").orderBy("n").collect()] == [("/jobs/1", "Data Engineer"), ("/about", "About us")]
    assert df.select(F.to_json(pages.next_data(F.col("html"))).alias("j")).collect()[0]["j"] == '{"a":{"jobs":[1]}}'
    assert pages.json_payloads(df, "page_id", "html").count() == 2
    label = lambda f: [r[0] for r in spark.createDataFrame([("Senior Engineer",), ("Privacy policy",), ("ab",)], "x string").select(f(F.col("x"))).collect()]
    assert label(pages.looks_like_title) == [True, False, False]
    statuses = spark.createDataFrame([(404, 200, "", True), (200, 200, "This JOB is no longer available", True), (200, 503, None, True), (200, 200, "hi", True), (None, None, None, False)], "h int, g int, b string, ok boolean")
    assert [r[0] for r in statuses.select(pages.link_status(F.col("h"), F.col("g"), F.col("b"), F.col("ok"))).collect()] == ["invalid", "stale", "unknown", "valid", "invalid"]


def test_versions_and_imports(spark, tmp_path):
    folder = str(tmp_path / "table")
    tables.write_version(spark.range(3), folder, 1)
    tables.write_version(spark.range(5), folder, 2)
    assert tables.read_current(spark, folder).count() == 5
    csv = tmp_path / "p.csv"
    csv.write_text("companyName,aliases,domain,h1bSponsorLikely,confidence,evidenceSummary\nAcme,acme inc; ac ,a.com,true,high,yes\nBeta,,,maybe,low,no\n")
    rows = tables.imported_profiles(spark, str(csv)).orderBy("companyName").collect()
    assert rows[0]["aliases"] == ["acme inc", "ac"] and rows[0]["h1bSponsorLikely"] is True and rows[1]["h1bSponsorLikely"] is None
    both = tmp_path / "p.json"
    both.write_text('[{"companyName": "Acme", "aliases": ["x"], "h1bSponsorLikely": false}]')
    assert tables.imported_profiles(spark, str(both)).first()["h1bSponsorLikely"] is False


def test_stream_replays_to_the_batch_result(spark, tmp_path):
    """Micro-batches merged one after the other give what one merge of everything gives, and a replay changes nothing."""
    source, folder = tmp_path / "in", str(tmp_path / "stored")
    schema = "canonical_key string, title string, link_status string, resolved_url string, canonical_url string, validated_at string, first_seen timestamp, last_seen timestamp, is_active boolean"
    row = lambda k, title, link, h: (k, title, link, None, None, None, T0 + datetime.timedelta(hours=h), T0 + datetime.timedelta(hours=h), True)
    batches = [[row("a", "A1", "unknown", 1), row("b", "B1", "valid", 1)], [row("a", "A2", "valid", 2), row("b", "B2", "stale", 3)], [row("c", "C1", "stale", 4)]]
    tables.write_version(spark.createDataFrame([], schema), folder, 0)
    events = []

    def apply(batch, number):
        merged, changed = feed.upsert(tables.read_current(spark, folder), batch, ["title"])
        events.extend((r["canonical_key"], r["kind"]) for r in changed.collect())
        tables.write_version(merged, folder, number + 1)

    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{source}/{i}")
        stream = spark.readStream.schema(schema).parquet(f"{source}/*")
        feed.run_feed(spark, stream, apply, str(tmp_path / "checkpoint")).awaitTermination()
    final = {r["canonical_key"]: (r["title"], r["first_seen"], r["last_seen"]) for r in tables.read_current(spark, folder).collect()}
    hour = lambda h: T0 + datetime.timedelta(hours=h)
    assert final == {"a": ("A2", hour(1), hour(2)), "b": ("B1", hour(1), hour(3)), "c": ("C1", hour(4), hour(4))}
    assert events == [("a", "inserted"), ("b", "inserted"), ("a", "updated"), ("c", "inserted")] or sorted(events) == sorted([("a", "inserted"), ("b", "inserted"), ("a", "updated"), ("c", "inserted")])
    stream = spark.readStream.schema(schema).parquet(f"{source}/*")
    feed.run_feed(spark, stream, apply, str(tmp_path / "checkpoint")).awaitTermination()
    assert len(events) == 4


def test_sequences_have_no_gaps(spark):
    rows = spark.range(500).select((F.col("id") * 7 % 501).alias("k"))
    got = tables.next_sequences(rows, 10, F.col("k")).orderBy("k").collect()
    assert [r["sequence"] for r in got] == list(range(11, 511))
    assert tables.next_sequences(rows.limit(0), 10, F.col("k")).count() == 0


def test_phrase_index_gives_what_all_concepts_give(spark, monkeypatch):
    from vacantia.operators import titles

    ready = titles.prepare(spark, titles.standard())
    said = ["Senior Data Engineer", "Data Senior Engineer", "Cloud Solutions Consultant", "Growth Product Owner II", "data", "", "Head of Talent Acquisition", "Machine Learning Engineer", "Security", "Full-Stack Software Developer", None]
    rows = spark.createDataFrame([(s,) for s in said], "title string")
    met = sorted(map(repr, titles.analyze(rows, ready).collect()))
    monkeypatch.setattr(titles, "met_concepts", lambda rows, ready: rows.withColumn("pool", ready.column()))
    assert met == sorted(map(repr, titles.analyze(rows, ready).collect())) and len(met) == len(said) - 1


def test_tags_are_longest_first_then_leftmost(spark):
    import random

    from pyspark.sql import functions as F
    from vacantia.operators import tagging

    rnd = random.Random(4)
    phrases = {" ".join(rnd.choices("abc", k=rnd.randint(1, 4))) for _ in range(14)}
    rows = [(i, " ".join(rnd.choices("abcd", k=rnd.randint(0, 40)))) for i in range(60)] + [(100, None), (101, "")]
    expected = set()
    for i, text in rows:
        words, taken = (text or "").split(), []
        runs = sorted((-n, s) for n in range(1, 5) for s in range(len(words) - n + 1) if " ".join(words[s : s + n]) in phrases)
        for size, s in runs:
            if all(s - size <= a or b <= s for a, b in taken):
                taken.append((s, s - size))
        expected |= {(i, a, b - a) for a, b in taken}
    table = spark.createDataFrame([(p,) for p in phrases], "alias string")
    got = tagging.tag(spark.createDataFrame(rows, "id long, text string"), table, "id", F.split("text", " "))
    assert {(r["id"], r["start"], r["n"]) for r in got.collect()} == expected and got.count() == len(expected)


def test_words_of_a_text_are_cut_once_not_once_a_word(spark):
    from pyspark.sql import functions as F
    from vacantia.operators import tagging

    rows, table = spark.createDataFrame([(1, "a b")], "id long, text string"), spark.createDataFrame([("a b",)], "alias string")
    words = F.split(F.regexp_replace("text", "zzqq", " "), " ")
    plan = tagging.matches(rows, table, "id", words)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("zzqq") <= 2  # the filter of nulls has its own


def test_postings_give_the_candidates_of_a_whole_scan(spark):
    """Same rows and channels, from the files and row groups of the keys asked for."""
    from vacantia.operators import search_index as S
    from vacantia.operators import titles
    from vacantia.operators.filters import SearchFilters
    from vacantia.plans import found
    from vacantia.sources.tables import Catalog

    rows = found.indexed(Catalog(spark, SMALL))
    postings, ready = S.stored_postings(rows), titles.prepare(spark)
    for search, place in ((SearchFilters(title="Data Engineer"), []), (SearchFilters(title="Senior Software Engineer", platforms=["ashby"]), ["country:france"]), (SearchFilters(title="Full Stack Platform Web Developer"), []), (SearchFilters(title="Chef"), ["city:nowhere"])):
        plan = S.plan_of(spark, search, ready, place)
        for limit in (7, 1000):
            whole, fetched = (sorted((r["id"], tuple(r["channels"])) for r in df.select("id", "channels").collect()) for df in (S.candidates(rows, plan, limit), S.found_candidates(postings, rows, plan, limit)))
            assert whole == fetched
        if keys := S.channel_keys(plan):
            shown = S.probe(postings, keys)._jdf.queryExecution().executedPlan().toString()
            assert "PartitionFilters: [(" in shown and "PushedFilters: [" in shown and "In(key" in shown.replace("EqualTo(key", "In(key")


def test_any_split_into_batches_gives_the_entities_of_one_run(spark):
    from vacantia.operators import entities

    rnd = random.Random(9)
    rows = [(i, [rnd.choice([None, f"k{rnd.randrange(60)}"]) for _ in range(rnd.randint(0, 3))]) for i in range(120)]
    table = lambda some: spark.createDataFrame(some, "id long, keys array<string>")

    def resolved(batches):
        state = entities.nothing(spark)
        for batch in batches:
            state = entities.add_batch(state, table(batch))
        return {r["id"]: r["entity"] for r in entities.entities(state, table(rows)).collect()}

    whole = resolved([rows])
    reached = {i: {i} for i, _ in rows}
    for _ in rows:
        for i, keys in rows:
            for j, others in rows:
                if set(keys) & set(others) - {None}:
                    reached[i] |= reached[j]
    assert whole == {i: min(r) for i, r in reached.items()}
    mixed = rnd.sample(rows, len(rows))
    assert resolved([mixed[:40], mixed[40:41], [], mixed[30:90], mixed[90:]]) == whole


def test_a_commit_is_seen_whole_or_not_at_all(spark, tmp_path):
    from vacantia.sources import manifest

    newest = lambda old, new: new.unionByName(old.join(new.select("key"), "key", "left_anti"))
    at, table = str(tmp_path), lambda some: spark.createDataFrame(some, "key string, value long")
    put = lambda version, rows, merge=newest, run="r": manifest.put(at, version, table(rows), "key", ["value"], merge, run, "s")
    assert manifest.read_manifest(spark, at) is None
    first = put(1, [("a", 1), ("b", 2)])
    assert first["facts"] | {"last": 0} == {"inserted": 2, "updated": 0, "unchanged": 0, "linked": 2, "last": 0}

    def lost(old, new):
        raise OSError("the writer is gone")

    def twice(old, new):
        return newest(old, new).unionByName(new)

    for fault in (lost, twice):  # before anything is written, and after the records are, which repeat a key
        try:
            put(2, [("b", 3), ("c", 4)], fault)
        except (OSError, ValueError):
            pass
        else:
            raise AssertionError("a fault must not be committed")
        assert manifest.read_manifest(spark, at) == first
    second = put(2, [("a", 1), ("b", 3), ("c", 4)])
    assert second["facts"] == {"inserted": 1, "updated": 1, "unchanged": 1, "linked": 1, "last": {"changes": 4, "runs": 3, "sessions": 3}}
    assert put(2, [("z", 9)]) == second == manifest.read_manifest(spark, at)
    got = {r["key"]: r["value"] for r in manifest.read_table(spark, second, "records").collect()}
    assert got == {"a": 1, "b": 3, "c": 4}
    empty = put(3, [], run="r2")
    assert manifest.read_table(spark, empty, "records").count() == 3 and empty["facts"]["linked"] == 0


def test_equal_records_leave_the_field_of_the_first_to_arrive(spark):
    from pyspark.sql import functions as F
    from vacantia.operators import records

    rows = spark.createDataFrame([("a", 1, "x", 2), ("a", 1, "y", 1), ("a", 1, "z", 3), ("a", 1, None, 0)], "canonical_key string, pos long, mode string, arrival long")
    for order in (F.col("arrival"), F.desc("arrival"), F.col("mode")):
        (row,) = records.coalesced(rows.coalesce(1).sortWithinPartitions(order)).collect()
        assert row["mode"] == "y" and row["arrival"] == 0


def test_records_without_a_key_are_dealt_over_tasks(spark):
    from pyspark.sql import functions as F
    from vacantia.operators import records

    none = F.lit(None).cast("string")
    rows = spark.range(4000).select(F.when(F.col("id") % 4 == 0, F.concat(F.lit("k"), F.floor(F.col("id") / 8).cast("string"))).otherwise(none).alias("canonical_key"), F.col("id").alias("pos"))
    met, _ = records.marked(rows, "canonical_key")
    join = met.where("__blank").groupBy(F.spark_partition_id().alias("p")).count().collect()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        met, _ = records.marked(rows, "canonical_key")
        sizes = [r["count"] for r in met.where("__blank").groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(sizes) == sum(r["count"] for r in join) == 3000 and max(sizes) < 1500
    assert met.where("__n = 2").count() == 1000 and met.count() == 4000


def test_growing_entities_broadcast_nothing(spark, monkeypatch):
    from vacantia.operators import components, entities

    plans = []

    def recorded(df, *args, of=components.persist, **named):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return of(df, *args, **named)

    monkeypatch.setattr(components, "persist", recorded)
    monkeypatch.setattr(entities, "persist", recorded)
    records = spark.createDataFrame([(1, ["a", "b"]), (2, ["b", "c"]), (3, ["d"]), (4, ["c", "d"]), (5, None)], "id long, keys array<string>")
    state = entities.nothing(spark)
    for ids in ([2, 3], [4], [1, 5]):
        state = entities.add_batch(state, records.where(F.col("id").isin(ids)))
    found = entities.entities(state, records)
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert {tuple(r) for r in found.collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 5)}
    assert len(plans) > 10 and not any("Broadcast" in p for p in plans)
