"""Queries over scalar functions: texts, titles, hashes, URLs, HTML, dates, classifications."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.functions import dates, experience, postings, sponsorship, urls
from vacantia.functions import text as X
from vacantia.plans import views as V
from vacantia.plans.registry import query
from vacantia.sources import pages as P
from vacantia.sources.tables import Catalog

COMPARABLE = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
NORMAL = "trim(regexp_replace({0}, '[^a-z0-9]+', ' ', 'g'))"


def sql_title(x: str) -> str:
    """SQL of the normal form of a title."""
    out = f"lower(regexp_replace(strip_accents({x}), '[^\\x00-\\x7F]', '', 'g'))"
    for pattern, to in X.TITLE_REWRITES:
        out = f"regexp_replace({out}, '{pattern}', '{to}', 'g')"
    return NORMAL.format(out)


@query(f"select doc_id, {COMPARABLE.format('text')} as comparable_text from documents")
def txt_comparable(t: Catalog) -> DataFrame:
    return t["documents"].select("doc_id", X.comparable(F.col("text")).alias("comparable_text"))


@query(f"with t as ({V.SQL_TITLES}) select pos, {sql_title('title')} as normal from t union all select -1 - doc_id, {sql_title('text')} from documents")
def txt_title_normal(t: Catalog) -> DataFrame:
    docs = t["documents"].select((-1 - F.col("doc_id")).alias("pos"), F.col("text").alias("title"))
    return V.titles(t).unionByName(docs).select("pos", X.normal_title(F.col("title")).alias("normal"))


_WORDS = "[" + ", ".join(f"'{w}'" for w in X.SENIORITY_WORDS) + "]"
_PHRASES = "|".join(X.SENIORITY_PHRASES)


@query(f"""
    with n as (select pos, {sql_title('title')} as normal from ({V.SQL_TITLES}))
    select pos, array_to_string(list_filter(string_split(trim(regexp_replace(' ' || normal || ' ', ' ({_PHRASES}) ', ' ', 'g')), ' '), lambda w: not list_contains({_WORDS}, w) and w <> ''), ' ') as stripped,
        list_filter([case when normal like '%entry level%' then 'entry level' end, case when normal like '%new grad%' then 'new grad' end, list_filter(string_split(normal, ' '), lambda w: list_contains({_WORDS}, w))[1]], lambda x: x is not null)[1] as first_mark
    from n
""")
def txt_seniority(t: Catalog) -> DataFrame:
    n = V.titles(t).withColumn("normal", X.normal_title(F.col("title")))
    marked = n.select("pos", X.strip_seniority(F.col("normal")).alias("stripped"), X.seniority(F.col("normal")).alias("marks"))
    phrase = F.try_element_at(F.array_sort(F.filter("marks", lambda s: s.contains(" "))), F.lit(1))
    return marked.select("pos", "stripped", F.coalesce(phrase, F.try_element_at("marks", F.lit(1))).alias("first_mark"))


_HEADS = "[" + ", ".join(f"'{w}'" for w in X.HEAD_WORDS) + "]"
_STOPS = "[" + ", ".join(f"'{w}'" for w in X.STOP_WORDS) + "]"


@query(f"""
    with n as (select pos, string_split({sql_title('title')}, ' ') as w from ({V.SQL_TITLES})), h as (select *, list_filter(w, lambda x: list_contains({_HEADS}, x))[-1] as head from n)
    select pos, head, array_to_string(list_filter(w, lambda x: not list_contains({_STOPS}, x) and x is distinct from head), ' ') as words from h
""")
def txt_head_and_words(t: Catalog) -> DataFrame:
    n = V.titles(t).withColumn("normal", X.normal_title(F.col("title")))
    return n.select("pos", X.head_word(F.col("normal")).alias("head"), F.array_join(X.meaningful(F.col("normal")), " ").alias("words"))


@query(f"""
    with n as (select pos, string_split({sql_title('title')}, ' ') as w from ({V.SQL_TITLES}))
    select pos, count(distinct p)::bigint as n_phrases, count(distinct case when p like '% % %' then p end)::bigint as n_longest
    from (select pos, array_to_string(w[i:i + k - 1], ' ') as p from n, unnest(range(1, 4)) k(k), unnest(range(1, len(w) + 1)) i(i) where i + k - 1 <= len(w)) group by pos
""")
def txt_phrases(t: Catalog) -> DataFrame:
    # a column a step: what a lambda uses is worked out again for each element, a column once a row
    words = V.titles(t).select("pos", X.tokens(X.normal_title(F.col("title"))).alias("words"))
    p = F.col("phrases")
    return words.select("pos", X.phrases(F.col("words"), 1, 3).alias("phrases")).select("pos", F.size(p).cast("long").alias("n_phrases"), F.size(F.filter(p, lambda x: x.like("% % %"))).cast("long").alias("n_longest"))


@query(f"select doc_id, sha256({COMPARABLE.format('source')} || '|' || {COMPARABLE.format('text')} || '|' || {COMPARABLE.format('lang')}) as fingerprint from documents")
def hsh_fingerprint(t: Catalog) -> DataFrame:
    return t["documents"].select("doc_id", urls.content_fingerprint(F.col("source"), F.col("text"), F.col("lang")).alias("fingerprint"))


@query(f"""
    with n as (select page_id, {COMPARABLE.format('url')} as u from pages)
    select page_id, list_reduce(list_transform(string_split(u, ''), lambda c: ascii(c)::bigint), lambda h, c: (h * 33 + c) % 4294967296, 5381::bigint) as hash from n
""")
def hsh_url(t: Catalog) -> DataFrame:
    return t["pages"].select("page_id", F.conv(F.upper(urls.url_hash(F.col("url"))), 36, 10).cast("long").alias("hash"))


@query("""
    select page_id, regexp_matches(trim(url), '(?i)^https?://[^\\s/?#]+([/?#].*)?$') as valid, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)) as host,
        case when regexp_matches(trim(url), '(?i)^https?://[^\\s/?#]+([/?#].*)?$') then lower(regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1)) || case when regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') = '' then '/' else regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') end end as canonical
    from pages
""")
def url_canonical(t: Catalog) -> DataFrame:
    u = F.col("url")
    return t["pages"].select("page_id", urls.is_http(u).alias("valid"), F.coalesce(urls.host(u), F.lit("")).alias("host"), urls.canonical(u).alias("canonical"))


BOARDS = ["https://boards.greenhouse.io/acme/jobs/%d", "https://jobs.lever.co/acme/%d", "https://jobs.ashbyhq.com/acme/%d", "https://jobs.smartrecruiters.com/acme/%d-x", "https://acme.wd5.myworkdayjobs.com/en-US/Site/job/%d", "https://example.com/careers/%d", "not a url %d"]


@query(f"""
    select s_suppkey as source_id, ([{", ".join(repr(x) for x in ["greenhouse", "lever", "ashby", "smartrecruiters", "workday", "company_page"])}, null])[s_suppkey % 7 + 1] as platform,
        (['acme', 'acme', 'acme', 'acme', 'acme/site', 'example.com', null])[s_suppkey % 7 + 1] as token, case when s_suppkey % 7 < 5 then s_suppkey::varchar end as job_id from supplier
""")
def url_boards(t: Catalog) -> DataFrame:
    k = F.col("s_suppkey")
    url = F.replace(V.pick(BOARDS, k), F.lit("%d"), k.cast("string"))
    return t["supplier"].select(k.alias("source_id"), urls.classify(url).alias("b")).select("source_id", "b.platform", "b.token", "b.job_id")


@query("""
    select page_id, len(regexp_extract_all(html, '(?is)<a\\b[^>]*\\bhref=["'']([^"''#][^"'']*)["''][^>]*>(.*?)</a>'))::bigint as n_links,
        len(regexp_extract_all(html, '(?is)<script[^>]+type=["'']application/ld\\+json["''][^>]*>(.*?)</script>'))::bigint as n_scripts, length(html)::bigint as size from pages
""")
def src_page_parts(t: Catalog) -> DataFrame:
    links = F.regexp_extract_all("html", F.lit(P.ANCHOR), F.lit(1))
    return t["pages"].select("page_id", F.size(links).cast("long").alias("n_links"), F.size(P.scripts(F.col("html"), P.LD_JSON)).cast("long").alias("n_scripts"), F.length("html").cast("long").alias("size"))


def _plain_sql() -> str:
    out = "regexp_replace(regexp_replace(html, '(?is)<(script|style)\\b[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g')"
    for entity, plain in [('&nbsp;', ' '), ('&amp;', '&'), ('&lt;', '<'), ('&gt;', '>'), ('&quot;', '"'), ('&#39;', "'"), ('&apos;', "'")]:
        out = f"replace({out}, '{entity}', '{plain.replace(chr(39), chr(39) * 2)}')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


@query(f"select page_id, {_plain_sql()} as plain from pages")
def txt_strip_html(t: Catalog) -> DataFrame:
    return t["pages"].select("page_id", X.strip_html(F.col("html")).alias("plain"))


@query("""
    with p as (select doc_id, trim(regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) as s from documents)
    select doc_id, case when s = '' then null when length(s) <= 280 then s else rtrim(s[1:277]) || '...' end as snippet from p
""")
def txt_snippet(t: Catalog) -> DataFrame:
    return t["documents"].select("doc_id", X.snippet(F.col("text")).alias("snippet"))


@query("select s_suppkey, array_to_string(list_transform(list_filter(string_split_regex(s_name, '[-_#\\s]+'), lambda p: p <> ''), lambda p: upper(p[1]) || p[2:]), ' ') as label from supplier")
def txt_slug_label(t: Catalog) -> DataFrame:
    return t["supplier"].select("s_suppkey", X.slug_to_label(F.replace("s_name", F.lit("#"), F.lit("-"))).alias("label"))


@query(f"""
    with o as (select o_orderkey, case when o_orderkey % 3 = 0 then o_orderdate end as posted, case when o_orderkey % 3 = 1 then o_orderdate end as crawled, o_orderdate + interval 36 hour as discovered from orders),
    a as (select *, coalesce(posted, crawled, discovered) as at_, floor(greatest(0, epoch_ms(timestamp '{V.NOW}') - epoch_ms(coalesce(posted, crawled, discovered))) / 86400000)::bigint as age from o)
    select o_orderkey, case when posted is not null then 'postingDate' when crawled is not null then 'crawledAt' else 'discoveredAt' end as source, age as age_days,
        case when posted is not null then case when age <= 3 then 180 when age <= 7 then 165 when age <= 14 then 145 when age <= 30 then 120 when age <= 60 then 85 when age <= 120 then 45 else 15 end
            else case when age <= 3 then 55 when age <= 7 then 45 when age <= 14 then 35 when age <= 30 then 25 when age <= 60 then 15 else 5 end end as score from a
""")
def dat_effective(t: Catalog) -> DataFrame:
    k, at = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    date = dates.effective(F.when(k % 3 == 0, at), F.when(k % 3 == 1, at), at + F.expr("interval 36 hours"), V.now())
    return t["orders"].select("o_orderkey", date.alias("d")).select("o_orderkey", "d.source", "d.age_days", "d.score")


@query(f"""
    select o_orderkey, o_orderdate >= timestamp '{V.NOW}' - interval 30 day as month, coalesce(epoch_ms(timestamp '{V.NOW}') - epoch_ms(o_orderdate) > 60 * 24 * 400 * 60000::bigint, true) as stale from orders
""")
def dat_windows(t: Catalog) -> DataFrame:
    at = F.col("o_orderdate").cast("timestamp")
    return t["orders"].select("o_orderkey", dates.posted_within(at, "30d", V.now()).alias("month"), dates.is_stale(at, F.lit(60 * 24 * 400).cast("long"), V.now()).alias("stale"))


@query(f"""
    with i as ({V.SQL_INVENTORY}), c as (select *, 3600000::bigint as step, consecutive_failures > 0 or health in ('degraded', 'failing') as backs_off from i),
    b as (select *, least(greatest(step * (case when crawl_priority <= 100 then 2 when crawl_priority <= 10000 then 3 when crawl_priority <= 30000 then 4 else 6 end
        + case when source_type in ('ats_board', 'feed') then 0 when source_type = 'career_site' then 1 when source_type = 'company_page' then 2 else 3 end
        + case confidence when 'high' then 0 when 'medium' then 1 else 2 end + case health when 'healthy' then 0 when 'unknown' then 1 else 2 end), step), 86400000)::bigint as refresh_ms,
        least(greatest(round(step * pow(2, least(5, consecutive_failures)) * case health when 'failing' then 2.0 when 'degraded' then 1.5 else 1.0 end), step * 2), 7 * 86400000::bigint)::bigint as backoff_ms from c)
    select source_id, refresh_ms, backoff_ms, case when last_crawled_at is null then 'never_crawled' when next_eligible_at <= timestamp '{V.NOW}' then 'eligible_due' when backs_off then 'retry_backoff' else 'cooling_down' end as bucket from b
""")
def dat_schedule(t: Catalog) -> DataFrame:
    c, step = F.col, F.lit(3_600_000).cast("long")
    backs_off = dates.backing_off(c("consecutive_failures"), c("health"))
    return V.inventory(t).select(
        "source_id", dates.refresh_ms(step, c("crawl_priority"), c("source_type"), c("confidence"), c("health")).alias("refresh_ms"),
        dates.backoff_ms(step, c("consecutive_failures"), c("health")).alias("backoff_ms"), dates.freshness(c("last_crawled_at"), c("next_eligible_at"), backs_off, V.now()).alias("bucket"),
    )


def _level_sql(normal: str) -> str:
    order = [r for level in reversed(experience.LEVELS) for r in experience.TITLE_RULES if r.level == level]
    return "case " + " ".join(f"when regexp_matches({normal}, '{r.pattern}') then '{r.level}'" for r in order) + " end"


@query(f"with n as (select pos, {COMPARABLE.format('title')} as normal from ({V.SQL_TITLES})), l as (select pos, {_level_sql('normal')} as level from n) select pos, level, case " + " ".join(f"when level = '{k}' then '{v}'" for k, v in experience.BANDS.items()) + " else 'unknown' end as band from l")
def exp_title_level(t: Catalog) -> DataFrame:
    level = experience.classify(F.col("title"))
    return V.titles(t).select("pos", level["level"].alias("level"), level["band"].alias("band"))


@query(f"with o as ({V.SQL_OFFERS}) select pos, (['mid', 'staff', 'principal', 'junior', null, 'senior'])[pos % 6 + 1] as level from o")
def exp_years(t: Catalog) -> DataFrame:
    return V.offers(t).select("pos", experience.years_level(F.col("years")).alias("level"))


@query(f"""with n as (select pos, {COMPARABLE.format('title')} as normal from ({V.SQL_TITLES})) select pos, case {' '.join(f"when regexp_matches(normal, '{p}') then '{k}'" for k, p in experience.FIELD_RULES)} end as level from n""")
def exp_field_level(t: Catalog) -> DataFrame:
    return V.titles(t).select("pos", experience.field_level(F.col("title")).alias("level"))


_LEVELS = ["senior", "staff"]


@query(f"with n as (select pos, {COMPARABLE.format('title')} as normal from ({V.SQL_TITLES})) select pos, coalesce({_level_sql('normal')} in ('senior', 'staff'), false) or {_level_sql('normal')} is null as taken from n")
def flt_experience(t: Catalog) -> DataFrame:
    e = experience.classify(F.col("title"))
    return V.titles(t).select("pos", experience.matches(e["level"], e["explicit"], e["confidence"], _LEVELS, "strict", True).alias("taken"))


@query(f"""
    with o as ({V.SQL_OFFERS}) select pos, (['supported', 'not_supported', case when sponsors then 'supported' else 'unknown' end, case when sponsors then 'supported' else 'unknown' end, 'supported', 'not_supported'])[pos % 6 + 1] as hint,
        (['high', 'high', case when sponsors then 'medium' else 'low' end, case when sponsors then 'medium' else 'none' end, 'high', 'high'])[pos % 6 + 1] as confidence, (['supported', 'not_supported', 'unknown', 'unknown', 'supported', 'unknown'])[pos % 6 + 1] as ingest from o
""")
def spn_decide(t: Catalog) -> DataFrame:
    d = sponsorship.decide(sponsorship.evidence(F.col("visa")), F.col("sponsors"), F.lit("high"))
    return V.offers(t).select("pos", d["hint"].alias("hint"), d["confidence"].alias("confidence"), sponsorship.ingest_hint(F.col("visa")).alias("ingest"))


@query(f"""
    with o as ({V.SQL_OFFERS}) select pos, case when regexp_matches(location, '(?i)\\bhybrid\\b') then 'hybrid' when regexp_matches(location, '(?i)\\b(remote|work from home|distributed)\\b') then 'remote' when location <> '' then 'onsite' else 'unknown' end as remote_type,
        (['full_time', 'part_time', 'contract', 'temporary', 'internship', 'seasonal', null, 'freelance', 'unknown'])[pos % 9 + 1] as employment_type, ([90000.0, 25.0, null, 1000.0])[pos % 4 + 1]::double as min_amount, ([120500.0, 40.0, null, 2000.0])[pos % 4 + 1]::double as max_amount,
        (['year', 'hour', null, 'week'])[pos % 4 + 1] as pay_interval from o
""")
def nrm_fields(t: Catalog) -> DataFrame:
    pay = postings.salary(F.col("pay"))
    return V.offers(t).select(
        "pos", postings.remote_type(F.col("location"), F.lit(False), F.lit(None).cast("string")).alias("remote_type"), postings.employment_type(F.col("employment")).alias("employment_type"),
        pay["min_amount"].alias("min_amount"), pay["max_amount"].alias("max_amount"), pay["interval"].alias("pay_interval"),
    )


@query("""
    select doc_id, case when trim(text) = '' then 'empty_title' when doc_id % 17 = 0 then 'placeholder_title' when doc_id % 13 = 0 then 'missing_company' when doc_id % 11 = 0 then 'missing_source_job_id'
        when doc_id % 7 = 0 then 'invalid_source_url' when doc_id % 5 = 0 then 'invalid_apply_url' when lang is null then 'empty_location' end as reason from documents
""")
def flt_quality_gate(t: Catalog) -> DataFrame:
    k = F.col("doc_id")
    title = F.when(k % 17 == 0, F.when(F.trim("text") == "", "").otherwise("Untitled role")).otherwise(F.col("text"))
    url = lambda n: F.when(k % n == 0, "ftp:/nowhere").otherwise("https://example.com/x")
    reason = postings.drop_reason(title, F.when(k % 13 == 0, "Unknown").otherwise("Acme"), F.when(k % 11 != 0, k.cast("string")), url(7), url(5), F.col("lang"), F.col("source"))
    return t["documents"].select("doc_id", reason.alias("reason"))


@query("select page_id, url from pages")
def src_window_object(t: Catalog) -> DataFrame:
    html = F.concat(F.lit("<script>window.__appData = "), F.to_json(F.struct(F.col("url"), F.lit('a "{" brace').alias("x"))), F.lit("; more {}</script>"), F.col("html"))
    return t["pages"].select("page_id", F.get_json_object(P.window_object("window.__appData")(html), "$.url").alias("url"))


@query("select page_id, regexp_extract(url, '^[A-Za-z]+://[^/?#]*') || '/jobs/7?x=1' as absolute from pages")
def src_resolve_url(t: Catalog) -> DataFrame:
    return t["pages"].select("page_id", P.resolve_url(F.lit(" /jobs/7?x=1 "), F.col("url")).alias("absolute"))
