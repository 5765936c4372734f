"""Queries over the remaining small operators: experience sources, guards, hydration, links, dates, streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.durable import new_folder, persist
from vacantia.functions import dates, experience, postings, sponsorship
from vacantia.functions import text as X
from vacantia.operators import evidence, intents, jobs, places, ranking
from vacantia.plans import board as B
from vacantia.plans import views as V
from vacantia.plans.registry import query
from vacantia.sources import pages as P
from vacantia.sources import manifest, tables
from vacantia.sources.tables import Catalog
from vacantia.streaming import feed


@query("""
    with s as (select o_orderkey as pos, (['senior', 'junior', null, 'staff'])[o_orderkey % 4 + 1] as level, o_orderkey // 4 % 2 = 0 as explicit, (['high', 'medium', 'low'])[o_orderkey // 8 % 3 + 1] as trust from orders),
    i as (select *, coalesce(level in ('senior', 'staff'), false) as inside from s)
    select pos, explicit and inside as strict, inside and (explicit or trust <> 'low') as balanced, inside as broad, (explicit and inside) or level is null as unsaid from i
""")
def flt_experience_modes(t: Catalog) -> DataFrame:
    """Explicit levels always, inferred ones unless strict, little trusted ones only where broad."""
    k = F.col("o_orderkey")
    part = lambda n: F.floor(k / n)
    level, explicit, trust = B.chosen(["senior", "junior", None, "staff"], k), part(4) % 2 == 0, V.pick(["high", "medium", "low"], part(8))
    test = lambda mode, unsaid=False: experience.matches(level, explicit, trust, ["senior", "staff"], mode, unsaid)
    return t["orders"].select(k.alias("pos"), test("strict").alias("strict"), test("balanced").alias("balanced"), test("broad").alias("broad"), test("strict", True).alias("unsaid"))


@query("""
    select p_partkey as pos, (['senior', 'staff', 'senior', 'senior', null])[p_partkey % 5 + 1] as level, (['structured_metadata', 'title', 'description', 'page_fetch', 'unknown'])[p_partkey % 5 + 1] as source, p_partkey % 5 < 2 as explicit from part
""")
def exp_sources(t: Catalog) -> DataFrame:
    """The level from a field, else the title, else the description's years, else the fetched page's."""
    k = F.col("p_partkey")
    field = F.when(k % 5 == 0, "Senior")
    title = F.when(k % 5 == 1, "Staff Engineer").otherwise("Engineer")
    years = lambda n: F.when(k % 5 == n, "at least 6 years of experience").otherwise("")
    c = experience.classify(title, explicit=field, hints=F.lit(""), description=years(2), page=years(3))
    return t["part"].select(k.alias("pos"), c["level"].alias("level"), c["source"].alias("source"), c["explicit"].alias("explicit"))


@query("select p_partkey as pos, case p_partkey % 3 when 0 then 'Minimum 5 years of Java|Senior level' when 1 then 'Entry level' else '' end as hints from part")
def exp_metadata_hints(t: Catalog) -> DataFrame:
    """Sentences in metadata of any shape that speak of experience; traces of the crawl are not read."""
    k = F.col("p_partkey")
    body = F.when(k % 3 == 0, '{"a":{"text":"Great team. Minimum 5 years of Java. We like dogs."},"b":["Senior level"],"crawlTraceId":"10 years"}').when(k % 3 == 1, '{"level":"Entry level","n":3}').otherwise('{"x":"nothing here"}')
    return t["part"].select(k.alias("pos"), F.array_join(jobs.experience_hints(body), "|").alias("hints"))


@query(f"""
    with b as ({B.SQL_BOARD}) select pos, case when pos % 16 = 11 then 'empty_title' when company is null then 'missing_company' end as reason, case when pos % 16 <> 11 and company is not null then sha256(trim(regexp_replace(lower(company), '[^a-z0-9]+', ' ', 'g')) || '|' || trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) || '|paris france') end as fingerprint,
        case when pos % 16 <> 11 and company is not null then platform || ':' || platform || ':' || pos end as lookup_key from b
""")
def nrm_hydrated(t: Catalog) -> DataFrame:
    """Seeds to stored jobs with keys, fingerprints and dates, or the reason why not."""
    url = F.concat(F.lit("https://example.com/"), F.col("pos").cast("string"))
    found = F.timestamp_seconds(F.lit(946684800))
    seeds = B.board(t).select("pos", "platform", "title", "company", F.col("platform").alias("company_slug"), F.col("pos").cast("string").alias("source_job_id"), url.alias("source_url"), url.alias("apply_url"), url.alias("canonical_url"), F.lit("Paris, France").alias("location"), "posted_at", found.alias("discovered_at"), "level", "remote_type")
    out = jobs.hydrated(seeds)
    sound = F.col("drop_reason").isNull()
    return out.select("pos", F.col("drop_reason").alias("reason"), F.when(sound, F.col("fingerprint")).alias("fingerprint"), F.when(sound, F.element_at("lookup_keys", 1)).alias("lookup_key"))


@query(f"with b as ({B.SQL_BOARD}) select pos, case when pos % 16 in (0, 2) then 'senior' end as level, pos % 4 = 0 as decorated from b where pos % 2 = 0 and pos % 16 in (0, 2, 4, 8)")
def flt_guard(t: Catalog) -> DataFrame:
    """Rows that still meet the search, with the verdicts beside them."""
    k = F.col("pos")
    out = jobs.guarded(B.board(t), "response_guard", F.when(k % 16 < 10, 900).otherwise(100), F.lit("exact"), (k % 16).isin(0, 2, 4, 8), F.when((k % 16).isin(0, 2), "senior"), k % 2 == 0)
    return out.select("pos", F.col("search_response.matched_level").alias("level"), (F.col("search_response.source") == "response_guard").alias("__s"), (k % 4 == 0).alias("decorated")).drop("__s")


@query("select event_id as pos, (['invalid', 'invalid', 'unknown', 'stale', 'valid', 'invalid', 'unknown'])[event_id % 7 + 1] as status from events")
def url_link_status(t: Catalog) -> DataFrame:
    """What landed responses say of a link."""
    k = F.col("event_id")
    head = F.element_at(F.array(*[F.lit(x) for x in (404, 200, 200, 200, 405, 200, 200)]), (k % 7 + 1).cast("int"))
    get = F.element_at(F.array(*[F.lit(x).cast("int") for x in (200, 403, 500, 200, 200, 200, None)]), (k % 7 + 1).cast("int"))
    body = F.when(k % 7 == 3, "Sorry, this POSITION HAS BEEN FILLED.").otherwise("Apply now")
    return t["events"].select(k.alias("pos"), P.link_status(head, get, body, k % 7 != 5).alias("status"))


@query("select c_custkey as pos, (['acme inc', 'acme widgets llc', 'globex corporation', ''])[c_custkey % 4 + 1] as company_key from customer")
def spn_company_key(t: Catalog) -> DataFrame:
    name = V.pick(["ACME, Inc.", "Acme   Widgets LLC", "Globex Corporation", " "], F.col("c_custkey"))
    return t["customer"].select(F.col("c_custkey").alias("pos"), sponsorship.company_key(name).alias("company_key"))


@query("select p_partkey as pos, (['ux designer|designer', 'data developer|engineer', 'engineer'])[p_partkey % 3 + 1] as kept, (['ux writer', 'data developer', 'engineer of engineer developer'])[p_partkey % 3 + 1] as swapped from part")
def txt_distinct_and_swap(t: Catalog) -> DataFrame:
    """Titles that are normally equal once, in order; the last head word exchanged."""
    k = F.col("p_partkey")
    values = F.when(k % 3 == 0, F.array(F.lit("UX  Designer"), F.lit("designer"), F.lit("ux designer"))).when(k % 3 == 1, F.array(F.lit("Data Developer"), F.lit(""), F.lit("Engineer"))).otherwise(F.array(F.lit("engineer"), F.lit("ENGINEER"), F.lit(None)))
    swapped = F.when(k % 3 == 0, X.replace_head(F.lit("ux designer"), "designer", "writer")).when(k % 3 == 1, X.replace_head(F.lit("data engineer"), "engineer", "developer")).otherwise(X.replace_head(F.lit("engineer of engineer engineer"), "engineer", "developer"))
    return t["part"].select(k.alias("pos"), F.array_join(jobs.distinct_normal(values), "|").alias("kept"), swapped.alias("swapped"))


@query("select p_partkey as pos, len(list_filter(['data', 'cloud', 'data'], lambda w: list_contains(string_split('small data ring cloud ' || p_name, ' '), w)))::int as shared from part")
def set_shared_terms(t: Catalog) -> DataFrame:
    """Words of a query that a title has, repeats of the query included."""
    title = F.split(F.concat(F.lit("small data ring cloud "), F.col("p_name")), " ")
    return t["part"].select(F.col("p_partkey").alias("pos"), F.size(jobs.shared_terms(["data", "cloud", "data"], title)).alias("shared"))


@query("select o_orderkey, case when o_orderkey % 5 = 0 then null else timestamp '2000-01-01' + to_hours(o_orderkey % 1000) end as at, case o_orderkey % 4 when 0 then timestamp '2000-06-01' when 1 then timestamp '1970-01-01' when 2 then timestamp '2000-01-02 02:00:00' else timestamp '2000-01-02 01:00:00' end as next_at from orders")
def dat_posted(t: Catalog) -> DataFrame:
    """Dates from milliseconds or text, and when a source may run again."""
    k, none = F.col("o_orderkey"), F.lit(None).cast("timestamp")
    millis = (F.lit(946684800000) + k % 1000 * 3600000).cast("string")
    text = F.date_format(F.timestamp_millis(F.lit(946684800000) + k % 1000 * 3600000), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    at = dates.posted_at(F.when(k % 5 == 0, "soon").when(k % 2 == 0, millis).otherwise(text))
    day = F.lit("2000-01-02").cast("timestamp")
    hour = F.lit(3_600_000).cast("long")
    due = dates.next_eligible(F.when(k % 4 > 1, day), none, none, F.when(k % 4 == 0, F.lit("2000-06-01").cast("timestamp")), hour, hour * 2, hour, k % 4 == 3)
    return t["orders"].select("o_orderkey", at.alias("at"), due.alias("next_at"))


@query(f"with b as ({B.SQL_BOARD}) select pos from b order by pos % 3 desc, posted_at desc nulls last, title, platform, pos limit 60")
def srt_persistence(t: Catalog) -> DataFrame:
    """The order in which results are stored."""
    return B.board(t).orderBy(*_stored_order(), "pos").limit(60).select("pos")


def _stored_order() -> list[Column]:
    return [(F.col("pos") % 3).desc(), F.col("posted_at").desc_nulls_last(), F.col("title"), F.col("platform")]


@query("""
    with l as (select event_id as sequence, user_id as job_id from events where event_id > 4000 and event_id <= 9000), w as (select job_id, max(sequence) as sequence from l group by job_id)
    select w.job_id, w.sequence from w join customer on c_custkey = w.job_id where c_mktsegment = 'BUILDING'
""")
def str_filtered_delta(t: Catalog) -> DataFrame:
    """Rows of a search that changed between two cursors."""
    rows = t["customer"].where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("job_id"))
    return feed.delta(V.log(t), rows, "job_id", 4000, 9000).select("job_id", "sequence")


@query("select user_id, count(*)::bigint as n, max(event_id) as last_event from events group by user_id")
def str_feed(t: Catalog) -> DataFrame:
    """The events as a stream whose batches are merged into a versioned table; a batch that comes again changes nothing."""
    spark = t.spark
    folder = new_folder(spark)
    t["events"].select("event_id", "user_id").repartition(3).write.parquet(f"{folder}/landed")
    source = spark.readStream.schema("event_id long, user_id long").option("maxFilesPerTrigger", 1).parquet(f"{folder}/landed")
    query_ = feed.run_counts(spark, source, f"{folder}/table", f"{folder}/checkpoint")
    query_.awaitTermination()
    return persist(tables.read_current(spark, f"{folder}/table").select("user_id", "n", "last_event"))


@query("select page_id, url as next_url, 2::int as payloads, 'deep' as found from pages")
def src_scripts(t: Catalog) -> DataFrame:
    """A page's data script, all its JSON scripts, and the first object under a key."""
    data = F.concat(F.lit('<script id="__NEXT_DATA__" type="application/json">{"props":'), F.to_json(F.struct("url")), F.lit('}</script><script type="application/json">{"a":[{"key":{"name":"deep"}},{"key":{"name":"late"}}]}</script><script type="application/json">{broken</script>'))
    rows = t["pages"].select("page_id", data.alias("html"))
    sums = P.json_payloads(rows, "page_id", "html").groupBy("page_id").agg(F.count("*").cast("int").alias("payloads"))
    second = F.element_at(P.scripts(F.col("html"), P.ANY_JSON), 2)
    read = rows.select("page_id", F.try_variant_get(P.next_data(F.col("html")), "$.props.url", "string").alias("next_url"), F.get_json_object(P.deep_find("key")(second), "$.name").alias("found"))
    return read.join(sums, "page_id").select("page_id", "next_url", "payloads", "found")


@query("select * from (values ('none', ''), ('city', 'Paris, France|Paris|France'), ('remote_country', 'Remote France|Remote in France|France Remote'), ('global_remote', 'Remote|Remote worldwide'), ('ambiguous', 'atlantis')) t(scope, terms)")
def geo_terms(t: Catalog) -> DataFrame:
    """Search phrases of a location intent."""
    I = places.Intent
    asked = [I(), I("France", None, "Paris"), I("France", remote=True), I(remote=True), I(text="atlantis")]
    return t.spark.createDataFrame([(i.scope, "|".join(evidence.location_terms(i))) for i in asked], "scope string, terms string")


@query("select * from (values ('', '', '', ''), ('Remote Asia', 'Remote', '', 'Asia'), ('Asia', '', '', 'Asia'), ('Nation_2', 'Nation_2', '', 'Asia'), ('Remote, Asia', 'Remote', '', 'Asia'), ('Oz, Asia', 'Oz', '', 'Asia'), ('Oz, West', 'Oz', 'West', ''), ('Oz, West, R2', 'Oz', 'West', 'Asia'), ('Oz', 'Oz', '', '')) t(typed, city, state, country)")
def geo_typed(t: Catalog) -> DataFrame:
    """City, state and country of what a reader types."""
    known = [r.asDict(recursive=True) for r in V.gazetteer(t).collect()]  # a row a place
    typed = ["", "Remote Asia", "Asia", "Nation_2", "Remote, Asia", "Oz, Asia", "Oz, West", "Oz, West, R2", "Oz"]
    read = [(x, *evidence.parse_location_input(x, known).values()) for x in typed]
    return t.spark.createDataFrame(read, "typed string, city string, state string, country string")


@query("select c_custkey as pos, array_to_string(list_filter([case when c_custkey % 3 = 0 then 'inactive' else 'active' end, 'link:' || (['valid', 'stale'])[c_custkey % 2 + 1], 'workplace:remote', case when c_custkey % 5 <> 0 then 'sponsorship:supported' end], lambda x: x is not null), ',') as keys from customer")
def nrm_status_keys(t: Catalog) -> DataFrame:
    k = F.col("c_custkey")
    keys = postings.status_keys(F.when(k % 3 == 0, False).when(k % 3 == 1, True), V.pick(["valid", "stale"], k), F.lit("remote"), F.when(k % 5 != 0, "supported"))
    return t["customer"].select(k.alias("pos"), F.array_join(keys, ",").alias("keys"))


@query("select s_suppkey % 10 as id, min(s_suppkey) as source_id from supplier group by 1")
def mrg_sources(t: Catalog) -> DataFrame:
    """Sources by id, the first wins."""
    from vacantia.operators.schedule import first_per

    return first_per(t["supplier"].select((F.col("s_suppkey") % 10).alias("id"), F.col("s_suppkey").alias("source_id")), "id", F.col("source_id"))


@query("select o_orderkey as pos, 900 - o_orderkey % 7 as score from orders where o_orderkey % 3 = 0 order by score desc, pos limit 25")
def joi_ranked(t: Catalog) -> DataFrame:
    """Ranked results with the matches they came from, in the ranking's order."""
    k = F.col("o_orderkey")
    matches = t["orders"].where(k % 3 == 0).select(k.alias("pos"), (900 - k % 7).alias("score"))
    ranked = matches.select("pos", F.col("score").alias("rank_score"))
    return jobs.with_matches(ranked, matches).orderBy(F.desc("rank_score"), "pos").limit(ranking.page_size(25)).select("pos", "score")


@query("select c_custkey as pos, (['required', 'preferred', 'none'])[c_custkey % 3 + 1] as remote, (['senior', '', 'junior,mid'])[c_custkey % 3 + 1] as preferred from customer")
def txt_intent(t: Catalog) -> DataFrame:
    k = F.col("c_custkey")
    i = intents.intent(V.pick(["Sr. Engineer", "Engineer", "Associate"], k), V.pick(["100% Remote", "Remote France", "Paris"], k), k % 3 != 2)
    return t["customer"].select(k.alias("pos"), i["remote"].alias("remote"), F.array_join(F.array_distinct(i["preferred"]), ",").alias("preferred"))


@query("""
    with one as (select o_orderkey as k from orders where o_orderkey % 3 <> 0),
    two as (select o_orderkey as k, case when o_orderkey % 3 = 0 then 'inserted' else 'updated' end as kind, o_orderkey % 5 = 0 or o_orderkey % 3 = 0 as differs from orders where o_orderkey % 3 = 0 or o_orderkey % 5 < 2),
    log as (select row_number() over (order by k) as sequence, k as key, 'inserted' as kind from one union all select (select count(*) from one) + row_number() over (order by k), k, kind from two where differs)
    select *, (select count(*) filter (kind = 'inserted') from two)::bigint as inserted, (select count(*) filter (kind = 'updated' and differs) from two)::bigint as updated,
        (select count(*) filter (not differs) from two)::bigint as unchanged, (select count(*) from two)::bigint as linked from log
""")
def snk_commit(t: Catalog) -> DataFrame:
    """The change log of two batches of orders, each one commit of records and three logs, and what the second brought; it is sent twice."""
    k = F.col("o_orderkey")
    rows = t["orders"].select(k.alias("key"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    one, two = rows.where("key % 3 <> 0"), rows.where("key % 3 = 0 or key % 5 < 2").withColumn("status", F.when(F.col("key") % 5 == 0, "closed").otherwise(F.col("status")))
    newest = lambda old, new: new.unionByName(old.join(new.select("key"), "key", "left_anti"))
    at = new_folder(t.spark)
    manifest.put(at, 1, one, "key", ["status", "price"], newest, "run 1", "session")
    made = manifest.put(at, 2, two, "key", ["status", "price"], newest, "run 2", "session")
    again = manifest.put(at, 2, one, "key", ["status", "price"], newest, "run 2", "session")
    facts = [F.lit(again["facts"][n]).cast("long").alias(n) for n in ("inserted", "updated", "unchanged", "linked")]
    return manifest.read_table(t.spark, made, "changes").select("sequence", "key", "kind", *facts)
