"""Queries over searches and what is decided about them: intents, seniority, coverage, gates, validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.functions import experience
from vacantia.operators import intents as I
from vacantia.operators import titles
from vacantia.plans import board as B
from vacantia.plans import views as V
from vacantia.plans.registry import query
from vacantia.sources.tables import Catalog

SEARCHES = [
    "data engineer jobs in Canada", "greenhouse software roles at the US", "  QA ", "jobs", "Lever/Ashby designer positions for", "workday united states of america analyst", "smart recruiters company pages nurse openings", "in the USA",
]


@query("""
    select c_custkey as pos, (['data engineer', 'software', 'QA', 'jobs', 'designer', 'analyst', 'nurse', 'in the USA'])[c_custkey % 8 + 1] as title,
        (['', 'greenhouse', '', '', 'lever,ashby', 'workday', 'smartrecruiters,company_page', ''])[c_custkey % 8 + 1] as platforms, (['Canada', 'United States', null, null, null, 'United States', null, 'United States'])[c_custkey % 8 + 1] as country from customer
""")
def txt_search_intent(t: Catalog) -> DataFrame:
    got = I.peeled(V.pick(SEARCHES, F.col("c_custkey")))
    return t["customer"].select(F.col("c_custkey").alias("pos"), got.alias("g")).select("pos", "g.title", F.array_join("g.platforms", ",").alias("platforms"), "g.country")


ROLES = ["senior software engineer", "Tech Lead", "software engineer iii", "staff engineer", "Principal Architect", "data analyst ii", "VP of Sales", "Junior Clerk", "Nurse", "graduate analyst", "internship", "engineering manager", "Sr. Painter"]


@query("""
    select p_partkey as pos, (['senior', 'lead', 'senior', 'staff', 'principal', 'mid', 'director', 'junior', 'unknown', 'new_grad', 'intern', 'manager', 'senior'])[p_partkey % 13 + 1] as level,
        (['high', 'high', 'high', 'high', 'high', 'high', 'high', 'medium', 'low', 'medium', 'high', 'high', 'medium'])[p_partkey % 13 + 1] as confidence,
        (['senior', 'lead', '', 'staff', 'principal', '', 'manager,director,executive', 'junior,mid', '', 'intern,new_grad', '', 'manager,director', 'senior'])[p_partkey % 13 + 1] as preferred from part
""")
def txt_seniority_ladder(t: Catalog) -> DataFrame:
    title = V.pick(ROLES, F.col("p_partkey"))
    s, preferred = I.seniority(title), F.array_join(F.array_distinct(I.preferred_seniorities(title)), ",")
    return t["part"].select(F.col("p_partkey").alias("pos"), s["level"].alias("level"), s["confidence"].alias("confidence"), preferred.alias("preferred"))


@query("""
    with s as (select o_orderkey as pos, (['fast', 'balanced', 'deep', null])[o_orderkey % 4 + 1] as mode, (['product', 'writing'])[o_orderkey // 4 % 2 + 1] as family, o_orderkey // 8 % 2 as levels, o_orderkey // 16 % 5 + 1 as words, (['country', 'state', 'city', 'unspecified'])[o_orderkey // 80 % 4 + 1] as place from orders),
    b as (select *, coalesce(mode, 'balanced') as m, levels = 0 and words <= 3 as broad, family = 'product' as demanded from s),
    g as (select *, case m when 'fast' then 40 when 'deep' then 200 else 100 end as goal from b),
    p as (select *, case place when 'country' then greatest(goal, 250) when 'state' then greatest(goal, 140) when 'city' then least(goal, case when m = 'deep' then case when broad then 30 else 27 end else 16 end) else goal end as g2 from g),
    d as (select *, case when demanded and place = 'country' then greatest(g2, 400) when demanded and place = 'state' then greatest(g2, 200) else g2 end as g3 from p),
    w as (select *, case when broad and place <> 'city' then greatest(g3, 125) else g3 end as g4 from d)
    select pos, (case when m = 'deep' then greatest(g4, 160) else g4 end)::bigint as target, case when broad then 'broad' else 'specific' end as title_breadth, place as place_breadth, demanded from w
""")
def txt_coverage(t: Catalog) -> DataFrame:
    """What coverage a search needs; a city's target falls below the mode's."""
    k = F.col("o_orderkey")
    part = lambda n: F.floor(k / n)
    scope = part(80) % 4
    out = I.coverage(B.chosen(["fast", "balanced", "deep", None], k), V.pick(["product", "writing"], part(4)), part(8) % 2, part(16) % 5 + 1, F.when(scope != 3, "France"), F.when(scope == 1, "X"), F.when(scope == 2, "Paris"), 100)
    return t["orders"].select(k.alias("pos"), out.alias("c")).select("pos", "c.target", "c.title_breadth", "c.place_breadth", "c.demanded")


@query("""
    with s as (select o_orderkey as pos, o_orderkey % 7 * 20 as matched, o_orderkey % 3 = 0 as reused, (['completed', 'failed', null])[o_orderkey % 5 % 3 + 1] as status, o_orderkey % 11 * 12 as visible, case when o_orderkey % 4 <> 0 then o_orderkey % 13 * 1000 end as age, (['deep', 'fast'])[o_orderkey % 2 + 1] as mode, o_orderkey % 9 = 0 as explicit, o_orderkey % 8 = 0 as recovery from orders),
    r as (select *, case when matched > 0 and matched >= 100 then 'indexed_coverage_sufficient' when coalesce(reused and status = 'completed' and visible > 0 and matched >= visible and visible >= 100, false) then 'reused_completed_coverage'
        when coalesce(reused and status <> 'completed' and not recovery, false) then 'retry_incomplete_previous_run' when coalesce(matched > 0 and age >= 6000 and mode = 'deep' and recovery, false) then 'freshness_recovery' when explicit and matched < 100 then 'explicit_request_time_recovery'
        else 'insufficient_indexed_coverage_targeted_replenishment' end as reason from s)
    select pos, reason, reason not in ('indexed_coverage_sufficient', 'reused_completed_coverage') as queue, reason in ('retry_incomplete_previous_run', 'insufficient_indexed_coverage_targeted_replenishment') as targeted, reason in ('freshness_recovery', 'explicit_request_time_recovery') as at_once from r
""")
def txt_supplemental(t: Catalog) -> DataFrame:
    k = F.col("o_orderkey")
    out = I.supplemental(k % 7 * 20, F.lit(100), k % 3 == 0, B.chosen(["completed", "failed", None], k % 5), k % 11 * 12, F.when(k % 4 != 0, k % 13 * 1000), V.pick(["deep", "fast"], k), 6000, k % 9 == 0, k % 8 == 0)
    return t["orders"].select(k.alias("pos"), out.alias("d")).select("pos", "d.reason", "d.queue", "d.targeted", "d.at_once")


@query("""
    with s as (select o_orderkey as pos, o_orderkey % 90 as found, o_orderkey % 50 as fresh, (o_orderkey % 10) / 10.0 as dup from orders), c as (select *, found < 40 or (dup > 0.5 and found < 80) or fresh < 20 as crawl from s)
    select pos, crawl, case when not crawl then 'return_db_results' when found < 12 then 'trigger_crawl' else 'trigger_background_ingestion' end as action, case when not crawl then 'database' when found = 0 then 'crawl' when found < 12 then 'mixed' else 'database' end as served_from from c
""")
def txt_decision(t: Catalog) -> DataFrame:
    k = F.col("o_orderkey")
    crawl = I.needs_crawl(k % 90, k % 50, (k % 10) / 10, 40, F.lit("balanced"))
    out = I.decision(k % 90, crawl, 40)
    return t["orders"].select(k.alias("pos"), crawl.alias("crawl"), out.alias("d")).select("pos", "crawl", "d.action", "d.served_from")


@query("""
    select * from (values ('data engineer', 1.0::double, 'anchor'), ('data platform engineer', 0.9, 'core'), ('etl developer', 0.9, 'core'), ('data analyst', 0.8, 'adjacent'), ('product manager', 0.6, 'supplemental')) t(phrase, relevance, tier)
""")
def txt_expansions(t: Catalog) -> DataFrame:
    """A role's names, neighbours and further roles with their relevance."""
    listed = I.expansions("data_engineer", ["data_analyst", "product_manager"], "Data Engineer", titles.SAMPLE)
    assert I.retrieval_filter(listed, {"country": "France", "city": None}, "required", [])["remote_type"] == "remote"
    return t.spark.createDataFrame(listed, "phrase string, relevance double, tier string")


@query("""
    with b as (select p_partkey as pos, case when p_partkey % 5 = 0 then 'missing_company' when p_partkey % 7 = 0 then 'empty_title' end as reason from part) select reason, count(*)::bigint as n, (list_sort(list(pos)))[1:5] as samples from b where reason is not null group by 1
""")
def flt_gate_batch(t: Catalog) -> DataFrame:
    """Reasons of a batch's quality gate with samples."""
    k = F.col("p_partkey")
    rows = t["part"].select(k.alias("pos"))
    reason = F.when(F.col("pos") % 5 == 0, "missing_company").when(F.col("pos") % 7 == 0, "empty_title")
    return I.gated(rows, reason)[1].select("reason", "n", "samples")


@query("select p_partkey as pos, p_partkey % 2 = 0 as title, case when p_partkey % 2 = 0 then p_partkey % 3 = 0 end as location, case when p_partkey % 6 = 0 then p_partkey % 5 = 0 end as experience, case when p_partkey % 2 <> 0 then 'title' when p_partkey % 3 <> 0 then 'location' when p_partkey % 5 <> 0 then 'experience' end as failed from part")
def flt_traced(t: Catalog) -> DataFrame:
    """The three verdicts of a search, later ones left open once one failed."""
    k = F.col("pos")
    out = I.traced(t["part"].select(F.col("p_partkey").alias("pos")), k % 2 == 0, k % 3 == 0, k % 5 == 0)
    return out.select("pos", "trace.title", "trace.location", "trace.experience", "trace.failed")


@query("""
    with r as (select o_orderkey as pos, 'u' || (o_orderkey % 500) as u, case when o_orderkey % 3 <> 0 then o_orderdate::timestamp end as posted, o_orderdate::timestamp + interval 1 hour as found from orders),
    c as (select pos, row_number() over (order by coalesce(posted, found) desc, pos) <= 5 as chosen from r), e as (select 'u' || (event_id % 700) as u, case when event_id % 2 = 0 then 'valid' else 'stale' end as status, ts, event_id from events),
    k as (select u, arg_max(status, ts) as status from e where ts >= (select max(ts) from events) - interval 20 day group by u)
    select r.pos, case when chosen and k.status is not null then k.status else 'unknown' end as link_status from r join c using (pos) left join k on k.u = r.u
""")
def str_inline_validation(t: Catalog) -> DataFrame:
    """The newest five are checked at once, by checks that are recent enough."""
    k = F.col("o_orderkey")
    at = F.col("o_orderdate").cast("timestamp")
    rows = t["orders"].select(k.alias("pos"), F.concat(F.lit("u"), (k % 500).cast("string")).alias("apply_url"), F.lit("unknown").alias("link_status"), F.lit(None).cast("timestamp").alias("validated_at"), F.when(k % 3 != 0, at).alias("posted_at"), (at + F.expr("interval 1 hour")).alias("discovered_at"))
    e = F.col("event_id")
    checks = t["events"].select(F.concat(F.lit("u"), (e % 700).cast("string")).alias("apply_url"), F.when(e % 2 == 0, "valid").otherwise("stale").alias("status"), F.col("ts").cast("timestamp").alias("checked_at"))
    since = checks.agg(F.max("checked_at")).first()[0]
    return I.inline_validated(rows, checks, "inline_top_n", F.lit(since) - F.expr("interval 20 days")).select("pos", "link_status")


@query("with s as (select c_custkey as id, c_custkey % 4 = 0 as own, case when c_custkey % 5 = 0 then 'Background Inventory Refresh' else 'x' end as title from customer order by c_custkey desc limit 6) select id as search_id from s where not own and title = 'x'")
def srt_recent_searches(t: Catalog) -> DataFrame:
    k = F.col("c_custkey")
    rows = t["customer"].select(k.alias("search_id"), k.alias("created_at"), F.when(k % 4 == 0, "system").alias("system_profile"), F.when(k % 5 == 0, "Background Inventory Refresh").otherwise("x").alias("title"))
    return I.recent_searches(rows).select("search_id")


@query("select * from (values ('ashby', true), ('greenhouse', true), ('workday', false)) t(platform, selected)")
def flt_tiers(t: Catalog) -> DataFrame:
    providers = t.spark.createDataFrame([("greenhouse", "fast"), ("lever", "fast"), ("ashby", "fast"), ("workday", "slow")], "platform string, tier string")
    return I.provider_tiers(providers, False, ["greenhouse", "ashby", "workday"]).select("platform", "selected")


@query("select p_partkey as pos, case p_partkey % 3 when 0 then 'staff' when 1 then 'junior' else 'senior' end as level, case p_partkey % 3 when 0 then 'title' when 1 then 'unknown' else 'title' end as source from part")
def exp_resolved(t: Catalog) -> DataFrame:
    """A stored classification, else the legacy field, else what the title says."""
    k, none = F.col("p_partkey"), F.lit(None).cast("string")
    stored = F.struct(F.when(k % 3 == 0, "staff").alias("level"), F.when(k % 3 == 0, "title").otherwise(none).alias("source"))
    out = I.resolved_level(stored, F.when(k % 3 == 1, "junior"), experience.classify(F.lit("Senior Engineer")))
    return t["part"].select(k.alias("pos"), out["level"].alias("level"), out["source"].alias("source"))
