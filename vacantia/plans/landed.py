"""Queries over landed pages, feeds and result pages; each table's ids decide what a page holds, so the SQL knows it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.durable import new_folder
from vacantia.functions.text import decode_entities
from vacantia.plans import views as V
from vacantia.plans.registry import query
from vacantia.sources import boards, discovery, payloads, structured
from vacantia.sources import pages as P
from vacantia.sources.tables import Catalog, append_facts, imported_profiles

_HOST = "regexp_extract(url, '^[A-Za-z]+://[^/?#]*')"


def _k() -> Column:
    return F.col("page_id")


def _page(t: Catalog, *parts: Column) -> DataFrame:
    return t["pages"].select("page_id", "url", F.lit("Acme").alias("company"), F.concat(*parts).alias("html"))


def _id(text: str) -> Column:
    return F.replace(F.lit(text), F.lit("%d"), _k().cast("string"))


@query("select page_id, url from pages")
def src_job_postings(t: Catalog) -> DataFrame:
    """Wraps each page's URL in the scripts that a job page has, then reads them back at any depth."""
    body = F.concat(F.lit('{"@graph":[{"@type":"JobPosting","url":'), F.to_json(F.struct("url")), F.lit("}]}"))
    html = F.concat(F.lit('<script type="application/ld+json">'), body, F.lit("</script>"), F.col("html"))
    found = P.job_postings(t["pages"].select("page_id", html.alias("html")))
    return found.select("page_id", F.get_json_object("posting", "$.url.url").alias("url"))


@query(f"""
    select page_id, case page_id % 6 when 1 then 'Data Analyst' when 3 then 'Backend Engineer' else 'Senior Data Engineer' end as title,
        case page_id % 6 when 1 then 'Remote' when 3 then 'Lyon, France' else 'Location unavailable' end as location, case page_id % 6 when 3 then 'https://boards.greenhouse.io/x/' || page_id else {_HOST} || '/careers/' || page_id end as source_url,
        case page_id % 6 when 3 then 'x ' || page_id else 'careers ' || page_id end as job_id from pages where page_id % 6 in (0, 1, 3)
""")
def src_anchor_jobs(t: Catalog) -> DataFrame:
    """Links by their text, label or surroundings; links elsewhere, furniture and plain words are no jobs."""
    kinds = [
        '<p>x</p><a href="/careers/%d">Senior <b>Data</b> Engineer</a>', '<a href="/careers/%d" aria-label="Data Analyst"><i></i></a><span>Remote</span>', '<a href="https://other.example.org/about/%d">Data Engineer</a>',
        '<li><h3>Backend Engineer</h3><span>Lyon, France</span><a href="https://boards.greenhouse.io/x/%d">Apply</a></li>', '<a href="/careers/%d">View all jobs</a>', '<a href="/careers/%d">Hello there</a>',
    ]
    html = F.replace(V.pick(kinds, _k()), F.lit("%d"), _k().cast("string"))
    return P.anchor_jobs(_page(t, html)).select("page_id", "title", "location", "source_url", "job_id")


@query("""
    select page_id, case when page_id % 3 = 0 then 'Initech' else 'Acme' end as company, case page_id % 4 when 0 then 'Paris, IDF, FR' when 1 then 'Lyon' when 2 then 'Oslo, NO' else 'Location unavailable' end as location,
        'J' || page_id as source_job_id, case when page_id % 5 = 0 then 50000.0 when page_id % 5 = 1 then 20.0 end::double as low, case when page_id % 5 = 0 then 70000.0 when page_id % 5 = 1 then 30.0 end::double as high,
        case when page_id % 5 = 0 then 'EUR' end as currency, case when page_id % 5 = 0 then 'year' when page_id % 5 = 1 then 'hour' end as pay_interval from pages
""")
def src_ld_jobs(t: Catalog) -> DataFrame:
    """Company, place, id and pay of JSON-LD postings of several shapes."""
    place = V.pick(['"jobLocation":{"address":{"addressLocality":" Paris ","addressRegion":"IDF","addressCountry":"FR"}}', '"location":"Lyon","jobLocation":{"address":{"addressLocality":"Nice"}}', '"jobLocation":[{"jobLocation":{"address":{"addressLocality":"Oslo","addressCountry":"NO"}}}]', '"jobLocation":{"name":"HQ"}'], _k())
    company = F.when(_k() % 3 == 0, '"hiringOrganization":{"name":" Initech "}').otherwise('"hiringOrganization":"x"')
    pay = F.when(_k() % 5 == 0, '"baseSalary":{"currency":"EUR","value":{"minValue":50000,"maxValue":70000,"unitText":"YEAR"}}').when(_k() % 5 == 1, '"description":"Pay: $20 - $30 per hour"').otherwise('"description":"none"')
    name = F.concat(F.lit('"identifier":{"value":"J'), _k().cast("string"), F.lit('"}'))
    body = F.concat(F.lit('<script type="application/ld+json">[{"@type":"JobPosting","title":"Data Engineer",'), F.concat_ws(",", place, company, pay, name), F.lit("}]</script>"))
    out = structured.ld_jobs(_page(t, body))
    return out.select("page_id", "company", "location", "source_job_id", F.col("salary.min_amount").alias("low"), F.col("salary.max_amount").alias("high"), F.col("salary.currency").alias("currency"), F.col("salary.interval").alias("pay_interval"))


@query(f"""
    select page_id, 'Platform Engineer' as title, case page_id % 3 when 0 then 'Berlin' when 1 then 'Rome; Milan' else 'Porto, PT' end as location, case page_id % 2 when 0 then page_id::varchar else 'Acme-0' end as source_job_id, {_HOST} || '/jobs/' || page_id as source_url from pages where page_id % 7 <> 0
""")
def src_embedded_jobs(t: Catalog) -> DataFrame:
    """Job records in page scripts, told from other objects; repeated ones count once."""
    place = V.pick(['"location":"Berlin"', '"offices":[{"name":"Rome"},{"name":"Milan"}]', '"city":"Porto","country":"PT"'], _k())
    name = F.when(_k() % 2 == 0, F.concat(F.lit('"id":'), _k().cast("string"))).otherwise(F.lit('"x":1'))
    title = F.when(_k() % 7 == 0, "Our Culture").otherwise("Platform Engineer")
    record = F.concat(F.lit('{"title":"'), title, F.lit('","url":"/jobs/'), _k().cast("string"), F.lit('",'), place, F.lit(","), name, F.lit("}"))
    body = F.concat(F.lit('<script type="application/json">{"a":{"jobs":['), record, F.lit(","), record, F.lit(']},"nav":{"title":"Home","url":"/"}}</script>'))
    return structured.embedded_jobs(_page(t, body)).select("page_id", "title", "location", "source_job_id", "source_url")


@query(f"""
    select page_id, 'QA Analyst' as title, {_HOST} || '/jobs/a' || page_id as source_url from pages union all select page_id, 'Data Writer', {_HOST} || '/jobs/b' || page_id from pages where page_id % 2 = 0
""")
def src_feed_jobs(t: Catalog) -> DataFrame:
    """Feeds as arrays and as objects with the jobs somewhere inside."""
    first, second = _id('{"title":"QA Analyst","url":"/jobs/a%d"}'), _id('{"name":"Data Writer","jobPath":"/jobs/b%d"}')
    body = F.when(_k() % 2 == 0, F.concat(F.lit("["), first, F.lit(","), second, F.lit("]"))).otherwise(F.concat(F.lit('{"data":{"items":[{"job":'), first, F.lit("}]}}")))
    feeds = t["pages"].select("page_id", "url", body.alias("body"), F.lit("Acme").alias("company"))
    return structured.feed_jobs(feeds, "page_id", "url", "body", "company").select("page_id", "title", "source_url")


@query("select page_id, case when page_id % 2 = 0 then 'One|Two, three|four|b' else 'One|Two, three|é— x' end as segments, 'a é & \"b\" <' as decoded from pages")
def txt_segments(t: Catalog) -> DataFrame:
    """Texts of a fragment, cut at blocks, bars, bullets and dashes, comparably equal ones once; entities decoded."""
    html = F.when(_k() % 2 == 0, "<div>One</div><p>Two, three \u2022 </p><b>ONE!</b> | four - b").otherwise("<div>One</div><p>Two, three</p><b>ONE!</b><br>&#233;&#x2014; x")
    return t["pages"].select("page_id", F.array_join(P.segments_of(html), "|").alias("segments"), decode_entities(F.lit("a &#233; &amp; &quot;b&quot; &lt;")).alias("decoded"))


@query("""
    select page_id, 'https://jobs.lever.co/acme/' || page_id as url, 3::int as links from pages union all select page_id, 'https://example.org/a?b=1', 3 from pages
""")
def src_result_urls(t: Catalog) -> DataFrame:
    """Targets of a result page's links, through redirects; the page's own links are none."""
    html = F.concat(_id('<a href="//duckduckgo.com/l/?uddg=https%3A%2F%2Fjobs.lever.co%2Facme%2F%d&rut=1">'), F.lit('<a href="https://example.org/a?b=1"><a href="/about">'))
    return discovery.result_urls(t["pages"].select("page_id", html.alias("html")), "page_id", "html")


@query("select page_id, 'https://example.org/' || page_id as url, 2::int as links from pages")
def src_feed_urls(t: Catalog) -> DataFrame:
    xml = _id("<rss><item><title>x</title><link> https://example.org/%d#top </link></item><item><link>ftp://example.org/</link></item></rss>")
    return discovery.feed_urls(t["pages"].select("page_id", xml.alias("xml")), "page_id", "xml")


CANDIDATES = ["https://boards.greenhouse.io/acme/jobs/%d", "https://jobs.lever.co/acme", "https://example.com/careers/%d", "https://example.com/blog/jobs", "https://example.com/about", "not a url", "https://jobs.ashbyhq.com/acme/%d"]


@query("""
    select s_suppkey as source_id, (['greenhouse', 'lever', 'company_page', 'company_page', 'company_page', 'unknown', 'ashby'])[s_suppkey % 7 + 1] as platform, (['detail', 'source', 'source', 'other', 'other', 'other', 'detail'])[s_suppkey % 7 + 1] as kind from supplier
""")
def url_candidates(t: Catalog) -> DataFrame:
    k = F.col("s_suppkey")
    url = F.replace(V.pick(CANDIDATES, k), F.lit("%d"), k.cast("string"))
    return t["supplier"].select(k.alias("source_id"), discovery.candidate(url).alias("c")).select("source_id", "c.platform", "c.kind")


@query("""
    with e as (select s_suppkey as k, (['greenhouse', 'lever', 'ashby'])[s_suppkey % 3 + 1] as platform, (['registry', 'configured'])[s_suppkey % 2 + 1] as origin, 't' || (s_suppkey // 4) as token from supplier),
    r as (select *, k + case when origin = 'registry' then case platform when 'lever' then 10000 when 'ashby' then 20000 else 30000 end else case platform when 'lever' then 40000 when 'ashby' then 45000 else 0 end end as rank from e)
    select platform || ':' || token as id, arg_min(origin, rank) as origin, min(rank)::bigint as inventory_rank, 'T' || substr(token, 2) as company from r group by platform, token
""")
def src_inventory_seeds(t: Catalog) -> DataFrame:
    """Sources of registries and configuration in rank order, each id once."""
    k, none = F.col("s_suppkey"), F.lit(None).cast("string")
    entries = t["supplier"].select(V.pick(["registry", "configured"], k).alias("origin"), V.pick(["greenhouse", "lever", "ashby"], k).alias("platform"), F.concat(F.lit("t"), F.floor(k / 4).cast("string")).alias("token"), none.alias("company"), none.alias("url"), k.alias("n"))
    return discovery.inventory_seeds(entries).select("id", "origin", "inventory_rank", "company")


@query("""
    with s as (select s_suppkey as k, case when s_suppkey % 4 = 0 then 'greenhouse' else 'lever' end as platform from supplier)
    select 'id' || (k // 2) as id, 'inventory' as origin from s where k % 2 = 0 and k < 60 union all select 'id' || (k // 2 + 20), 'configured' from s where k % 2 = 0 and k % 4 <> 0 and k >= 20 and (k // 2 + 20) >= 30
""")
def src_baseline(t: Catalog) -> DataFrame:
    """Inventory before configured sources; the inventory's primary platform stands alone."""
    k = F.col("s_suppkey")
    made = lambda rows, shift, origin: rows.select(F.concat(F.lit("id"), (F.floor(k / 2) + shift).cast("string")).alias("id"), F.when(k % 4 == 0, "greenhouse").otherwise("lever").alias("platform"), F.lit(origin).alias("origin"))
    even = t["supplier"].where(k % 2 == 0)
    return discovery.baseline(made(even.where(k < 60), 0, "inventory"), made(even.where(k >= 20), 20, "configured"), made(even.limit(0), 0, "curated")).select("id", "origin")


@query("select 'id' || s_suppkey as id, case when s_suppkey % 3 = 0 then 'expanded' else 'public' end as origin from supplier where s_suppkey % 2 = 0 and (s_suppkey % 3 = 0 or s_suppkey % 5 = 0)")
def src_supplemental(t: Catalog) -> DataFrame:
    """What was found and is not known."""
    k = F.col("s_suppkey")
    made = lambda rows, origin: rows.select(F.concat(F.lit("id"), k.cast("string")).alias("id"), F.lit("lever").alias("platform"), F.lit(origin).alias("origin"))
    s = t["supplier"]
    return discovery.supplemental(made(s.where(k % 2 != 0), "known"), made(s.where(k % 3 == 0), "expanded"), made(s.where(k % 5 == 0), "public"), platforms=["lever"]).select("id", "origin")


@query("select page_id, 'lever:acme' as id, 'lever' as platform from pages where page_id % 2 = 0")
def src_expanded(t: Catalog) -> DataFrame:
    """Boards that company pages link to, each once a page."""
    html = F.when(_k() % 2 == 0, '<a href="https://jobs.lever.co/acme">x</a><a href="https://jobs.lever.co/acme/1">y</a>').otherwise('<a href="/about">z</a>')
    return discovery.expanded(_page(t, html)).select("page_id", "id", "platform")


@query("""
    with q as (select r.n_nationkey as r_at, r.n_name as role, p.r_regionkey as p_at, p.r_name as place, h.h as host, h.platform from nation r, region p, (values ('jobs.lever.co', 'lever'), ('jobs.ashbyhq.com', 'ashby')) h(h, platform) where r.n_nationkey < 4),
    t as (select platform, 'site:' || host || ' "' || role || '" "' || place || '"' as query, r_at * 100 + p_at as priority from q), n as (select *, row_number() over (partition by platform order by priority, query) as turn, min(query) over (partition by platform) as least_query from t),
    f as (select platform, arg_min(query, (priority, query)) as first_query from t group by platform)
    select query from n join f using (platform) order by turn, first_query limit 13
""")
def win_query_budget(t: Catalog) -> DataFrame:
    """Roles by places by hosts, and a budget of them taken in turn from the platforms."""
    roles = t["nation"].where("n_nationkey < 4").select(F.col("n_nationkey").alias("role_at"), F.col("n_name").alias("role"))
    places = t["region"].select(F.col("r_regionkey").alias("place_at"), F.col("r_name").alias("place"))
    hosts = t.spark.createDataFrame([("jobs.lever.co", "lever"), ("jobs.ashbyhq.com", "ashby")], "host string, platform string")
    return discovery.round_robin(discovery.query_plan(roles, places, hosts), "platform", 13).select("query")


@query(f"with i as ({V.SQL_INVENTORY}) select source_id, case platform when 'p1' then 'a' else 'b' end as provider from i where platform in ('p1', 'p2')")
def joi_providers(t: Catalog) -> DataFrame:
    """Sources with the provider of their platform, of the fast tier."""
    providers = t.spark.createDataFrame([("p1", "a", "fast"), ("p2", "b", "fast"), ("p3", "c", "slow")], "platform string, provider string, tier string")
    return discovery.routed(V.inventory(t), providers, "fast").select("source_id", "provider")


@query("""
    with d as (select doc_id as k, source from documents)
    select 'greenhouse' as platform, 'gh' as token, 'g' || k as source_job_id, 'Engineer ' || k as title, 'https://boards.greenhouse.io/gh/jobs/' || k as source_url, 'Paris' as location, null as drop_reason from d where k % 4 = 0
    union all select 'lever', 'lv', 'l' || k, 'Analyst ' || k, 'https://jobs.lever.co/lv/' || k, 'Rome; Milan', null from d where k % 4 = 1
    union all select 'ashby', 'as', 'a' || k, 'Designer ' || k, 'https://jobs.ashbyhq.com/as/' || k, 'Oslo', null from d where k % 4 = 2
    union all select 'smartrecruiters', 'sr', 's' || k, 'TBD', 'https://jobs.smartrecruiters.com/sr/s' || k, 'Bonn, DE', 'placeholder_title' from d where k % 4 = 3
""")
def src_boards(t: Catalog) -> DataFrame:
    """Payloads of four boards to one table of postings, with the quality gate's verdict."""
    k = F.col("doc_id")
    of = lambda n, text: F.when(k % 4 == n, F.replace(F.lit(text), F.lit("%d"), k.cast("string")))
    payload = F.coalesce(
        of(0, '{"jobs":[{"id":"g%d","title":" Engineer %d ","absolute_url":"https://boards.greenhouse.io/gh/jobs/%d","location":{"name":"Paris"}}]}'),
        of(1, '[{"id":"l%d","text":"Analyst %d","hostedUrl":"https://jobs.lever.co/lv/%d","categories":{"location":"Rome","allLocations":["Rome","Milan"]}}]'),
        of(2, '{"jobs":[{"id":"a%d","title":"Designer %d","jobUrl":"https://jobs.ashbyhq.com/as/%d","location":"Oslo"}]}'),
        of(3, '{"content":[{"id":"s%d","name":"TBD","location":{"city":"Bonn","country":"DE"}}]}'),
    )
    raw = t["documents"].select(V.pick(["greenhouse", "lever", "ashby", "smartrecruiters"], k).alias("platform"), V.pick(["gh", "lv", "as", "sr"], k).alias("token"), payload.alias("payload"))
    return boards.normalize(boards.postings(raw)).select("platform", "token", "source_job_id", "title", "source_url", "location", "drop_reason")


@query("select n_nationkey::varchar || ' ' || k as domain, case when k = 'json' then n_name else upper(n_name) end as company, case when k = 'json' then 2 else 1 end::int as aliases, n_nationkey % 2 = 0 as likely from nation, (values ('json'), ('csv')) v(k)")
def src_profiles(t: Catalog) -> DataFrame:
    """Sponsorship profiles from a JSON file and from a plain CSV file."""
    folder = new_folder(t.spark)
    n, key = t["nation"], F.col("n_nationkey").cast("string")
    entry = F.struct(F.col("n_name").alias("companyName"), F.array(F.lit("a"), F.lit("b")).alias("aliases"), F.concat(key, F.lit(" json")).alias("domain"), (F.col("n_nationkey") % 2 == 0).alias("h1bSponsorLikely"))
    n.agg(F.to_json(F.collect_list(entry)).alias("value")).coalesce(1).write.text(f"{folder}/json")  # a file of 25 entries
    line = F.concat_ws(",", F.upper("n_name"), F.lit("x;"), F.concat(key, F.lit(" csv")), (F.col("n_nationkey") % 2 == 0).cast("string"), F.lit("low"), F.lit("none"))
    head = t.spark.createDataFrame([("companyName,aliases,domain,h1bSponsorLikely,confidence,evidenceSummary", -1)], "value string, at int")
    head.unionByName(n.select(line.alias("value"), F.col("n_nationkey").alias("at"))).coalesce(1).sortWithinPartitions("at").select("value").write.text(f"{folder}/csv")
    both = [imported_profiles(t.spark, f"{folder}/{k}").select("domain", F.col("companyName").alias("company"), F.size("aliases").alias("aliases"), F.col("h1bSponsorLikely").alias("likely")) for k in ("json", "csv")]
    return both[0].unionByName(both[1])


@query(f"select page_id, 'Data Engineer' as title, {_HOST} || '/en-US/Site/job/Paris/Data-Engineer_R' || page_id as source_url, 'R' || page_id as source_job_id from pages")
def src_workday_links(t: Catalog) -> DataFrame:
    html = _id('<a href="/en-US/Site/job/Paris/Data-Engineer_R%d?x=1">Data Engineer</a><a href="/en-US/Site/job/Paris/Data-Engineer_R%d">Apply</a><a href="/about">x</a>')
    return P.workday_links(_page(t, html)).select("page_id", "title", "source_url", "source_job_id")


@query("select event_id as pos, 'u' || (event_id % 50) as url from events")
def snk_append_facts(t: Catalog) -> DataFrame:
    """Facts added in two writes are all there."""
    folder = new_folder(t.spark)
    facts = t["events"].select(F.col("event_id").alias("pos"), F.concat(F.lit("u"), (F.col("event_id") % 50).cast("string")).alias("url"))
    append_facts(facts.where("pos % 2 = 0"), folder)
    append_facts(facts.where("pos % 2 = 1"), folder)
    return t.spark.read.parquet(folder)


@query("""
    with d as (select doc_id as k, source, text, doc_id % 6 as kind from documents where doc_id % 5 <> 4)
    select 'greenhouse' as platform, 'g' || k as source_job_id, 'Engineer ' || k as title, 'https://boards.greenhouse.io/gh/jobs/' || k as source_url, 'Paris' as location, sha256('') as description_hash from d where kind = 0
    union all select 'lever', 'l' || k, 'Analyst ' || k, 'https://jobs.lever.co/lv/' || k, 'Rome; Milan', sha256(text) from d where kind = 1
    union all select 'ashby', 'a' || k, 'Designer ' || k, 'https://jobs.ashbyhq.com/as/' || k, 'Oslo', sha256(text) from d where kind = 2
    union all select 'ashby', 'p' || k, 'Writer ' || k, 'https://jobs.ashbyhq.com/b' || k || '/p' || k, 'Bergen', sha256(text) from d where kind = 3
    union all select 'workday', 'R' || k, 'Nurse ' || k, 'https://x.myworkdayjobs.com/en/job/Lyon/R' || k, 'Lyon', null from d where kind = 4
    union all select 'workday', 'R' || k, 'Data Engineer', 'https://x.myworkdayjobs.com/en/job/Nice/Data-Engineer_R' || k, null, null from d where kind = 5
""")
def src_landed(t: Catalog) -> DataFrame:
    """Answers of four boards, whole texts and pages among them, landed by platform and day, read back for the days asked, and parsed; no content is an empty description."""
    k, text = F.col("doc_id"), F.col("text")
    of = lambda pattern: F.replace(F.lit(pattern), F.lit("%d"), k.cast("string"))
    deep = lambda **f: F.struct(*[v.alias(c) for c, v in f.items()])
    job = deep(id=of("a%d"), title=of("Designer %d"), jobUrl=of("https://jobs.ashbyhq.com/as/%d"), location=F.lit("Oslo"), descriptionPlain=text)
    shown = deep(id=of("p%d"), title=of("Writer %d"), locationName=F.lit("Bergen"), descriptionPlain=text)
    told = deep(id=of("l%d"), text=of("Analyst %d"), hostedUrl=of("https://jobs.lever.co/lv/%d"), categories=deep(location=F.lit("Rome"), allLocations=F.array(F.lit("Rome"), F.lit("Milan"))), descriptionPlain=text)
    answers = [
        of('{"jobs":[{"id":"g%d","title":" Engineer %d ","absolute_url":"https://boards.greenhouse.io/gh/jobs/%d","location":{"name":"Paris"}}]}'),
        F.to_json(F.array(told)), F.to_json(deep(jobs=F.array(job))),
        F.concat(F.lit("<html><script>window.__appData = "), F.to_json(deep(jobBoard=deep(jobPostings=F.array(shown)))), F.lit("; let x = {};</script></html>")),
        of('{"total":1,"jobPostings":[{"title":"Nurse %d","externalPath":"/job/Lyon/R%d","locationsText":"Lyon","bulletFields":["R%d"]}]}'),
        of('<ul><a href="/en/job/Nice/Data-Engineer_R%d?x=1">Data Engineer</a><a href="https://x.myworkdayjobs.com/en/job/Nice/Data-Engineer_R%d">Apply</a><a href="/about">x</a></ul>'),
    ]
    kind = k % 6
    payload = F.coalesce(*[F.when(kind == n, a) for n, a in enumerate(answers)])
    platform = V.pick(["greenhouse", "lever", "ashby", "ashby", "workday", "workday"], k)
    raw = t["documents"].select(
        platform.alias("platform"), F.date_add(F.lit("2026-01-01").cast("date"), (k % 5).cast("int")).alias("day"), of("b%d").alias("token"), F.when(platform == "workday", "https://x.myworkdayjobs.com/en").alias("base_url"), payload.alias("payload"),
    )
    folder = new_folder(t.spark)
    payloads.land(raw, folder)
    return boards.landed_postings(t.spark, folder, last_day="2026-01-04").select("platform", "source_job_id", "title", "source_url", "location", F.sha2("description", 256).alias("description_hash"))
