"""Queries over relations: filters, joins, entities, aggregates, rankings, schedules, feeds, places."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vacantia.functions.text import comparable, contains_phrase, distinct_texts
from vacantia.operators import filters, metrics, places, ranking, resolve, schedule, titles
from vacantia.operators.identity import with_identity
from vacantia.plans import views as V
from vacantia.plans.registry import query
from vacantia.plans.texts import COMPARABLE
from vacantia.sources.tables import Catalog, merge_profiles, next_sequences
from vacantia.streaming import feed

TREE = {"$or": [{"link_status": {"$in": ["valid", "unknown"]}}, {"n_chars": {"$gt": 4000, "$lte": 9000}}], "is_active": True, "country": {"$exists": True}, "platform": {"$regex": "^SRC1", "$options": "i"}}


@query(f"""
    with j as ({V.SQL_LISTING}), s as (
        select pos, platform, link_status, country, n_chars, 900 * (regexp_matches(' ' || {COMPARABLE.format('title')} || ' ', ' (the|la|der|que) '))::int as relevance,
            case when pos % 3 = 0 then timestamp '1999-12-31' - to_days((pos % 4 * 9)::int) end as posted, timestamp '1999-12-31' - to_days((pos % 3 * 20)::int) as crawled from j where is_active and n_chars > 0),
    r as (select *, coalesce(posted, crawled) as at_, floor((epoch_ms(timestamp '{V.NOW}') - epoch_ms(coalesce(posted, crawled))) / 86400000) as age from s),
    f as (select *, relevance + case when posted is not null then case when age <= 3 then 180 when age <= 7 then 165 when age <= 14 then 145 when age <= 30 then 120 when age <= 60 then 85 when age <= 120 then 45 else 15 end
        else case when age <= 3 then 55 when age <= 7 then 45 when age <= 14 then 35 when age <= 30 then 25 when age <= 60 then 15 else 5 end end as final_score from r where relevance > 0)
    select pos, final_score::int as final_score, row_number() over (order by final_score desc, relevance desc, posted is not null desc, at_ desc, coalesce(country, ''), coalesce(link_status, ''), coalesce(platform, ''), lpad((pos * 7919 % 10007)::varchar, 5, '0'), pos)::int as place from f qualify place <= 50
""")
def search_ranked(t: Catalog) -> DataFrame:
    """The flagship: active postings that hold a word, best first, with the final score; dates tie often, so the texts decide."""
    k = F.col("pos")
    day = lambda n, width: F.timestamp_seconds(F.lit(946598400) - (k % n) * width * 86400)
    rows = V.listing(t).where(F.col("is_active") & (F.col("n_chars") > 0))
    title = comparable(F.col("title"))
    hit = contains_phrase(title, "the") | contains_phrase(title, "la") | contains_phrase(title, "der") | contains_phrase(title, "que")
    job_id = F.lpad((k * 7919 % 10007).cast("string"), 5, "0")
    rows = rows.where(hit).select("pos", "platform", F.col("link_status").alias("title"), F.when(k % 3 == 0, day(4, 9)).alias("posted_at"), day(3, 20).alias("crawled_at"), F.lit(None).cast("timestamp").alias("discovered_at"), F.col("country").alias("company"), job_id.alias("source_job_id"), F.lit("u").alias("url"))
    best = ranking.top(ranking.ranked(rows, F.lit(900), V.now()), 50).withColumn("one", F.lit(1))
    order = Window.partitionBy("one").orderBy(*ranking.rank_order(F.col("ranking")))
    return best.select("pos", F.col("ranking.final_score").alias("final_score"), F.row_number().over(order).alias("place"))


@query(f"with j as ({V.SQL_LISTING}) select pos from j where (link_status in ('valid', 'unknown') or (n_chars > 4000 and n_chars <= 9000)) and is_active and country is not null and regexp_matches(platform, '(?i)^SRC1')")
def flt_tree(t: Catalog) -> DataFrame:
    rows = V.listing(t)
    return rows.where(filters.compile_filter(TREE, rows.schema)).select("pos")


@query(f"with j as ({V.SQL_LISTING}) select pos from j where is_active and platform in ('src1', 'src2', 'src3') and country = 'en' and regexp_matches(' ' || {COMPARABLE.format('title')} || ' ', ' (the|of|was) ')")
def flt_candidates(t: Catalog) -> DataFrame:
    f = filters.SearchFilters(title="the of", country="EN", platforms=["src1", "src3", "src2"]).clean()
    return V.listing(t).where(filters.candidates(f, ["the", "of", "was"])).select("pos")


@query(f"with j as ({V.SQL_LISTING}) select case when pos % 5 = 0 then 'title' when country <> 'en' then 'location' when pos % 2 = 0 then 'experience' end as reason, count(*)::bigint as n from j group by 1")
def flt_exclusions(t: Catalog) -> DataFrame:
    reason = filters.exclusion(F.when(F.col("pos") % 5 == 0, 100).otherwise(900), F.col("country") == "en", F.col("pos") % 2 == 1)
    return filters.with_counts(V.listing(t), reason)[1].select("reason", F.col("count").alias("n"))


@query("select e.event_id as sequence, c.c_name as name from events e join customer c on e.user_id = c.c_custkey")
def joi_events_to_jobs(t: Catalog) -> DataFrame:
    rows = t["customer"].select(F.col("c_custkey").alias("job_id"), F.col("c_name").alias("name"))
    return V.log(t).join(rows, "job_id").select("sequence", "name")


@query("select c_custkey as pos from customer where c_custkey in (select user_id from events where event_type = 'purchase')")
def joi_semi(t: Catalog) -> DataFrame:
    return t["customer"].join(t["events"].where("event_type = 'purchase'").select(F.col("user_id").alias("c_custkey")), "c_custkey", "left_semi").select(F.col("c_custkey").alias("pos"))


@query("select c_custkey as pos from customer where not exists (select 1 from events where user_id = c_custkey)")
def joi_anti(t: Catalog) -> DataFrame:
    return t["customer"].join(t["events"].select(F.col("user_id").alias("c_custkey")), "c_custkey", "left_anti").select(F.col("c_custkey").alias("pos"))


@query(f"""
    with l as ({V.SQL_LOG}), c as (select max(ts) - interval 10 day as cutoff from l)
    select job_id, max(ts) as checked_at, arg_max(sequence, (ts, sequence)) as sequence from l, c where ts >= cutoff group by job_id
""")
def joi_latest_since(t: Catalog) -> DataFrame:
    """The newest check of each job that is not older than a cutoff."""
    log = V.log(t)
    cutoff = log.agg((F.max("ts") - F.expr("interval 10 days")).alias("cutoff"))
    recent = log.join(F.broadcast(cutoff), F.col("ts") >= F.col("cutoff"))  # one row
    return recent.groupBy("job_id").agg(F.max(F.struct("ts", "sequence")).alias("m")).select("job_id", F.col("m.ts").alias("checked_at"), "m.sequence")


@query("""
    with p as (select n_nationkey as id, lower(n_name) as k from nation union all select n_nationkey, lower(substr(n_name, 1, 3)) from nation)
    select c_custkey as pos, min(p.id) as profile from customer join p on p.k = case when c_custkey % 2 = 0 then lower((select n_name from nation where n_nationkey = c_nationkey)) else lower(substr((select n_name from nation where n_nationkey = c_nationkey), 1, 3)) end group by c_custkey
""")
def joi_company_alias(t: Catalog) -> DataFrame:
    """Companies to profiles by name or alias, the first profile."""
    n = t["nation"]
    profiles = n.select(F.col("n_nationkey").alias("id"), F.lower("n_name").alias("name"), F.array(F.lower(F.substring("n_name", 1, 3))).alias("aliases"))
    named = t["customer"].join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("pos"), F.when(F.col("c_custkey") % 2 == 0, F.lower("n_name")).otherwise(F.lower(F.substring("n_name", 1, 3))).alias("k"))
    return resolve.first_profile(named, profiles, "k").select("pos", "profile")


@query("select doc_id as pos, case when doc_id % 3 <> 0 then 'platform:' || source || ':' || (case when doc_id % 3 = 1 then 'b' else source end) || ':' || doc_id else 'fallback:' || md5(lower(text)) end as canonical_key, doc_id % 3 <> 0 as has_strong from documents")
def mrg_identity(t: Catalog) -> DataFrame:
    return with_identity(V.postings(t)).select("pos", "canonical_key", "has_strong")


_GROUPS = "with g as (select doc_id as pos, min(doc_id) over (partition by doc_id % 3 = 0, md5(lower(text))) as entity, doc_id % 2 as odd from documents)"


@query(f"{_GROUPS} select pos, entity from g")
def mrg_entities(t: Catalog) -> DataFrame:
    """Postings that share a URL or, without one, a fingerprint."""
    return resolve.entities(V.postings(t)).select("pos", "entity")


@query(f"{_GROUPS} select entity, arg_max(pos, (case odd when 0 then 3 else 2 end, pos)) as pos, count(*)::bigint as records, max(pos * 3600)::bigint as posted, min(pos * 60)::bigint as discovered, count(*) filter (pos % 3 = 1)::bigint as n_keys from g group by entity")
def mrg_dedupe(t: Catalog) -> DataFrame:
    d = resolve.dedupe(V.postings(t))
    return d.select("entity", "pos", "records", F.unix_seconds("posted_at").alias("posted"), F.unix_seconds("discovered_at").alias("discovered"), F.size("lookup_keys").cast("long").alias("n_keys"))


@query(f"{_GROUPS}, w as (select entity, arg_max(pos, (case odd when 0 then 3 else 2 end, pos)) as kept_pos from g group by entity) select pos, kept_pos, case when pos % 3 = 0 then 'dedupe:content_fingerprint' else 'dedupe:canonical_url' end as reason from g join w using (entity) where pos <> kept_pos")
def mrg_decisions(t: Catalog) -> DataFrame:
    return resolve.decisions(V.postings(t)).select("pos", "kept_pos", "reason")


@query("""
    with d as (select doc_id as pos, md5(lower(text)) as k, doc_id % 3 <> 0 as strong from documents), e as (select * from d where pos % 2 = 0), i as (select * from d where pos % 2 = 1)
    select i.pos, min(e.pos) as existing_id, case when i.strong then 'canonical' else 'canonical_key' end as "by" from i join e on i.k = e.k and i.strong = e.strong group by i.pos, i.strong
    union all select i.pos, min(e.pos), 'fallback' from i join e on i.k = e.k where i.pos not in (select i2.pos from i i2 join e e2 on i2.k = e2.k and i2.strong = e2.strong) group by i.pos
""")
def mrg_match_existing(t: Catalog) -> DataFrame:
    known = with_identity(V.postings(t))
    old = known.where("pos % 2 = 0").withColumn("id", F.col("pos"))
    return resolve.match_existing(known.where("pos % 2 = 1"), old).select("pos", "existing_id", "by")


_STORED = "select o_orderkey as k, case when o_orderkey % 2 = 0 then 'valid' else 'unknown' end as s, o_orderpriority as p, o_orderdate as f from orders"


@query(f"""
    with a as ({_STORED}), o as (select * from a where k % 3 <> 0), n as (select k, case when k % 5 = 0 then 'valid' else 'stale' end as s, 'new' as p, f + interval 1 day as f from a where k % 3 <> 1)
    select coalesce(o.k, n.k)::varchar as canonical_key, case when o.k is null then n.p when n.k is null then o.p when (case n.s when 'valid' then 3 else 1 end) > (case o.s when 'valid' then 3 else 2 end) then n.p else o.p end as priority,
        least(o.f, n.f) as first_seen, greatest(o.f, n.f) as last_seen, n.k is not null as is_active from o full join n on o.k = n.k
""")
def snk_merge(t: Catalog) -> DataFrame:
    """Stored orders with incoming ones: the better record gives the fields, dates widen."""
    old, new = _stored(t)
    return resolve.merge_stored(old, new).select("canonical_key", "priority", "first_seen", "last_seen", "is_active")


def _stored(t: Catalog) -> tuple[DataFrame, DataFrame]:
    k, none = F.col("o_orderkey"), F.lit(None).cast("string")
    day = F.col("o_orderdate").cast("timestamp")
    rows = lambda status, priority, at, active: t["orders"].select(k.cast("string").alias("canonical_key"), status.alias("link_status"), priority.alias("priority"), none.alias("resolved_url"), none.alias("canonical_url"), none.alias("validated_at"), at.alias("first_seen"), at.alias("last_seen"), F.lit(active).alias("is_active"))
    old = rows(F.when(k % 2 == 0, "valid").otherwise("unknown"), F.col("o_orderpriority"), day, False).where(F.col("canonical_key").cast("long") % 3 != 0)
    new = rows(F.when(k % 5 == 0, "valid").otherwise("stale"), F.lit("new"), day + F.expr("interval 1 day"), True).where(F.col("canonical_key").cast("long") % 3 != 1)
    return old, new


@query(f"with a as ({_STORED}), o as (select * from a where k % 3 <> 0), n as (select k, case when k % 5 = 0 then 'valid' else 'stale' end as s from a where k % 3 <> 1) select n.k::varchar as canonical_key, case when o.k is null then 'inserted' else 'updated' end as kind from n left join o on o.k = n.k where o.k is null or (case n.s when 'valid' then 3 else 1 end) > (case o.s when 'valid' then 3 else 2 end)")
def snk_changes(t: Catalog) -> DataFrame:
    """Only rows whose watched fields change make events."""
    return feed.upsert(*_stored(t), ["priority"])[1].select("canonical_key", "kind")


@query("select event_id, 1000 + row_number() over (order by ts, event_id) as sequence from events where event_type <> 'view'")
def snk_sequences(t: Catalog) -> DataFrame:
    rows = t["events"].where("event_type <> 'view'").select("event_id", "ts")
    return next_sequences(rows, 1000, F.col("ts"), F.col("event_id")).select("event_id", "sequence")


@query("select user_id, event_type, 50 + row_number() over (order by user_id, event_type) as sequence from (select distinct user_id, event_type from events where event_id % 2 = 1 and (user_id, event_type) not in (select (user_id, event_type) from events where event_id % 2 = 0))")
def snk_append_missing(t: Catalog) -> DataFrame:
    pairs = t["events"].select("event_id", "user_id", "event_type")
    return feed.append_missing(pairs.where("event_id % 2 = 0"), pairs.where("event_id % 2 = 1").select("user_id", "event_type"), ["user_id", "event_type"], 50)


@query("select n_regionkey as region, list_sort(list_distinct(list(left(n_name, 2)) || list(right(n_name, 2)))) as aliases, max(n_nationkey)::bigint as seen_count, (select max(m.n_name) from nation m where m.n_nationkey = (select max(x.n_nationkey) from nation x where x.n_regionkey = nation.n_regionkey)) as summary from nation group by n_regionkey")
def mrg_profiles(t: Catalog) -> DataFrame:
    rows = t["nation"].select(F.col("n_regionkey").alias("company_key"), F.array(F.substring("n_name", 1, 2), F.expr("right(n_name, 2)")).alias("aliases"), F.col("n_nationkey").cast("long").alias("seen_count"), F.col("n_name").alias("summary"))
    last = rows.groupBy("company_key").agg(F.max_by(F.struct(*rows.columns), "seen_count").alias("r")).select("r.*")
    old = rows.join(last.select("company_key", "seen_count"), ["company_key", "seen_count"], "left_anti").select(rows.columns)
    return merge_profiles(old, last).select(F.col("company_key").alias("region"), "aliases", "seen_count", "summary")


@query(f"""
    with l as ({V.SQL_LOG}), w as (select job_id, max(sequence) as sequence from l where sequence > 5000 group by job_id)
    select w.job_id, w.sequence, c_name as name from w join customer on c_custkey = w.job_id
""")
def str_delta(t: Catalog) -> DataFrame:
    rows = t["customer"].select(F.col("c_custkey").alias("job_id"), F.col("c_name").alias("name"))
    return feed.delta(V.log(t), rows, "job_id", 5000)


@query(f"with l as ({V.SQL_LOG}) select coalesce(max(sequence), 0)::bigint as cursor from l")
def str_cursor(t: Catalog) -> DataFrame:
    return feed.cursor(V.log(t))


@query(f"""
    with l as ({V.SQL_LOG}), a as (select job_id, max(sequence) as sequence from l where event_type = 'purchase' and sequence > 3000 group by job_id), b as (select job_id, max(sequence) as sequence from l where sequence > 9000 group by job_id)
    select c_custkey as job_id, coalesce(a.sequence, b.sequence) as sequence, case when a.job_id is not null then 'session' else 'index' end as origin from customer left join a on a.job_id = c_custkey left join b on b.job_id = c_custkey where a.job_id is not null or b.job_id is not null
""")
def str_two_deltas(t: Catalog) -> DataFrame:
    rows, log = t["customer"].select(F.col("c_custkey").alias("job_id")), V.log(t)
    return feed.two_deltas(log.where("event_type = 'purchase'"), log, rows, "job_id", 3000, 9000).select("job_id", "sequence", "origin")


@query("select event_id as sequence, user_id as job_id from events where event_id > 777 order by event_id limit 100")
def srt_keyset_page(t: Catalog) -> DataFrame:
    return ranking.after(V.log(t), 777, 100).select("sequence", "job_id")


@query("select o_orderkey from orders order by o_orderdate desc, o_orderkey limit 20 offset 40")
def srt_offset_page(t: Catalog) -> DataFrame:
    return t["orders"].orderBy(F.desc("o_orderdate"), "o_orderkey").offset(40).limit(ranking.page_size(20)).select("o_orderkey")


_SCORE = f"""inventory_rank + crawl_priority * 0.5 + case when status = 'active' then 0 else 100000 end + case health when 'healthy' then 0 when 'unknown' then 250 when 'degraded' then 2500 else 8000 end
    + case when next_eligible_at > timestamp '{V.NOW}' then 20000 + least(30000, ceil((epoch_ms(next_eligible_at) - epoch_ms(timestamp '{V.NOW}')) / 60000.0)) else 0 end
    - 10000 * list_contains(tags, 'tag1')::int - 1500 * list_contains(tags, 'geo2')::int + case confidence when 'high' then -50 when 'low' then 150 else 0 end"""


@query(f"with i as ({V.SQL_INVENTORY}) select source_id, ({_SCORE})::double as score from i")
def srt_inventory_score(t: Catalog) -> DataFrame:
    return V.inventory(t).select("source_id", ranking.inventory_score(V.now(), ["tag1"], ["geo2"]).alias("score"))


_YIELD = "case when source_type in ('ats_board', 'feed') then (health in ('degraded', 'failing'))::int when source_type = 'job_detail' then 2 when source_type = 'career_site' then 3 when source_type = 'company_page' then case when health = 'unknown' then 6 else 4 end else 5 end"
_ORDER = f"{_YIELD}, case health when 'healthy' then 0 when 'unknown' then 1 when 'degraded' then 2 else 3 end, consecutive_failures, greatest(0, epoch_ms(timestamp '{V.NOW}') - epoch_ms(next_eligible_at)) desc, crawl_priority, inventory_rank, next_eligible_at, source_id"


@query(f"with i as ({V.SQL_INVENTORY}) select source_id, platform from i qualify row_number() over (partition by platform order by {_ORDER}) = 1")
def win_first_per_platform(t: Catalog) -> DataFrame:
    rows = V.inventory(t)
    order = ranking.schedule_order(V.now())
    keyed = rows.withColumn("__late", F.greatest(F.lit(0), F.unix_millis(V.now()) - F.unix_millis("next_eligible_at")))
    ascending = [*order[:3], -F.col("__late"), *order[4:]]
    return schedule.first_per(keyed, "platform", *ascending).select("source_id", "platform")


@query(f"with i as ({V.SQL_INVENTORY}), r as (select *, row_number() over (partition by platform order by {_ORDER}) as rn from i) select source_id, rn::int as place from r where rn <= 3")
def srt_schedule(t: Catalog) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("platform").orderBy(*ranking.schedule_order(V.now())))
    return V.inventory(t).withColumn("place", place).where("place <= 3").select("source_id", "place")


@query(f"with l as ({V.SQL_LOG}), r as (select *, row_number() over (partition by event_type order by ts desc, sequence desc) as rn from l), f as (select * from r qualify row_number() over (partition by job_id order by rn, event_type) = 1) select job_id, event_type as channel, rn::int as place from f order by rn, event_type, job_id limit 60")
def win_interleave(t: Catalog) -> DataFrame:
    out = schedule.interleave(V.log(t), "event_type", "job_id", 60, F.desc("ts"), F.desc("sequence"))
    return out.select("job_id", F.col("event_type").alias("channel"), "place")


@query(f"with i as ({V.SQL_INVENTORY}), r as (select source_id, row_number() over (partition by platform order by source_id) as rn, min(source_id) over (partition by platform) as f from i) select source_id from r order by rn, f, source_id limit 25")
def win_diverse(t: Catalog) -> DataFrame:
    return schedule.diverse(V.inventory(t), "platform", 25, "source_id").select("source_id")


@query(f"with i as ({V.SQL_INVENTORY}), c as (select platform, case when platform = 'p1' then 2 else count(*) end as cap from i group by platform), u as (select platform, u from c, unnest(range(1, 40)) t(u) where u <= cap order by u, platform limit 40) select c.platform, coalesce(count(u.u), 0)::bigint as quota from c left join u on c.platform = u.platform group by c.platform")
def win_quotas(t: Catalog) -> DataFrame:
    caps = V.inventory(t).groupBy("platform").agg(F.count("*").alias("n")).select("platform", F.when(F.col("platform") == "p1", 2).otherwise(F.col("n")).alias("cap"))
    return schedule.quotas(caps, "platform", "cap", 40)


@query(f"""
    with i as ({V.SQL_INVENTORY}), r as (select *, row_number() over (partition by platform order by inventory_rank, source_id) as ip, case when last_crawled_at is null then row_number() over (partition by last_crawled_at is null order by inventory_rank, source_id) end as fr from i)
    select source_id, case when coalesce(fr <= 6, false) and ip <= 9 then 0 when ip <= 9 then 1 else 2 end as turn from r order by turn, inventory_rank, source_id limit 30
""")
def win_reserves(t: Catalog) -> DataFrame:
    return schedule.select_with_reserves(V.inventory(t), 30, 0.2, 0.3, F.col("inventory_rank"), F.col("source_id")).select("source_id", "turn")


@query(f"with i as ({V.SQL_INVENTORY}) select source_id, ((source_id - 7) % n + n) % n as distance from i, (select count(*) as n from i) order by distance, consecutive_failures, crawl_priority, epoch_ms(next_eligible_at), source_id limit 10")
def win_rotate(t: Catalog) -> DataFrame:
    rows = V.inventory(t).select(F.col("source_id").alias("idx"), F.col("consecutive_failures").alias("failures"), F.col("crawl_priority").alias("priority"), "next_eligible_at", F.col("source_id").alias("profile_id"))
    return schedule.rotate(rows, 7, 10, V.now()).select(F.col("profile_id").alias("source_id"), "distance")


@query(f"with l as ({V.SQL_LOG}) select job_id, max(sequence) as sequence from l group by job_id")
def win_latest_event(t: Catalog) -> DataFrame:
    return feed.latest_per(V.log(t), "job_id").select("job_id", "sequence")


@query("select doc_id, md5(lower(text)) || case when row_number() over (partition by md5(lower(text)) order by doc_id) = 1 then '' else '#' || row_number() over (partition by md5(lower(text)) order by doc_id) end as render_key from documents")
def win_render_keys(t: Catalog) -> DataFrame:
    rows = t["documents"].select("doc_id", F.md5(F.lower("text")).alias("identity"))
    return ranking.render_keys(rows, "identity", F.col("doc_id")).select("doc_id", "render_key")


@query(f"with i as ({V.SQL_INVENTORY}), c as (select *, source_id % 3 = 0 and (lease_owner is null or lease_expires_at <= timestamp '{V.NOW}' or lease_owner = 'worker-2') as claimed from i) select source_id, claimed, case when claimed then 'worker-2' else lease_owner end as lease_owner, case when claimed then timestamp '{V.NOW}' + interval 900 second else lease_expires_at end as lease_expires_at from c")
def str_claim(t: Catalog) -> DataFrame:
    rows = V.inventory(t)
    out = schedule.claim(rows, rows.where("source_id % 3 = 0"), "worker-2", V.now(), 900)
    return out.select("source_id", "claimed", "lease_owner", "lease_expires_at")


@query(f"with i as ({V.SQL_INVENTORY}) select source_id, case when lease_owner = 'worker-1' then null else lease_owner end as lease_owner from i")
def str_release(t: Catalog) -> DataFrame:
    return schedule.release(V.inventory(t), "worker-1").select("source_id", "lease_owner")


@query(f"with j as ({V.SQL_LISTING}) select link_status as key, count(*)::bigint as n from j group by 1")
def agg_count_by(t: Catalog) -> DataFrame:
    return metrics.count_by(V.listing(t), F.col("link_status"))


@query("select l_returnflag as flag, l_linestatus as status, sum(l_quantity)::double as fetched, sum(l_linenumber)::double as saved, sum(case when l_tax > 0.04 then 1 else 0 end)::double as duplicates, count(*)::bigint as runs, round(coalesce(sum(case when l_tax > 0.04 then 1 else 0 end) / nullif(sum(l_linenumber) + sum(case when l_tax > 0.04 then 1 else 0 end), 0), 0.0), 9) as duplicate_ratio from lineitem group by 1, 2")
def agg_totals(t: Catalog) -> DataFrame:
    rows = t["lineitem"].select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.col("l_quantity").alias("fetched"), F.col("l_linenumber").cast("double").alias("saved"), F.when(F.col("l_tax") > 0.04, 1.0).otherwise(0.0).alias("duplicates"))
    return metrics.totals(rows, ["flag", "status"]).withColumn("duplicate_ratio", F.round("duplicate_ratio", 9)).select("flag", "status", "fetched", "saved", "duplicates", "runs", "duplicate_ratio")


@query("select md5(lower(text)) as k, count(*)::bigint as n from documents group by 1 having count(*) > 1")
def agg_repeated(t: Catalog) -> DataFrame:
    return metrics.repeated(t["documents"].select(F.md5(F.lower("text")).alias("k")), "k")


@query(f"with i as ({V.SQL_INVENTORY}) select platform, count(*)::bigint as sources, count(*) filter (coalesce(next_eligible_at <= timestamp '{V.NOW}', true))::bigint as eligible, count(*) filter (health = 'failing')::bigint as failing, max(last_crawled_at) as heartbeat, count(*) filter (epoch_ms(timestamp '{V.NOW}') - epoch_ms(last_crawled_at) <= 86400000)::bigint as last_day from i group by platform")
def agg_health(t: Catalog) -> DataFrame:
    return metrics.health(V.inventory(t), V.now())


@query("with d as (select lower(text) as k, n_chars > 2000 as fresh from documents), s as (select count(*)::bigint as n, count(*) filter (fresh)::bigint as fresh, count(distinct k)::bigint as titles from d) select n, fresh, titles, round(1.0 * (n - titles) / n, 9)::double as duplicate_rate, round(0.4 * least(1.0, n / 5000.0) + 0.3 * fresh / n + 0.3 * (1 - 1.0 * (n - titles) / n), 9)::double as score from s")
def agg_quality(t: Catalog) -> DataFrame:
    q = metrics.result_quality(t["documents"], 5000, F.col("n_chars") > 2000, F.lower("text"))
    return q.select("n", "fresh", "titles", F.round("duplicate_rate", 9).alias("duplicate_rate"), F.round("score", 9).alias("score"))


@query(f"select epoch_ms(timestamp '{V.NOW}') - max(epoch_ms(o_orderdate)) as age_ms from orders")
def agg_index_age(t: Catalog) -> DataFrame:
    at = F.col("o_orderdate").cast("timestamp")
    rows = t["orders"].select(F.when(F.col("o_orderkey") % 2 == 0, at).alias("indexed_at"), at.alias("crawled_at"), at.alias("discovered_at"))
    return metrics.index_age_ms(rows, V.now())


@query("with r as (select l_orderkey as run, (['success', 'partial', 'failed', 'unsupported', 'success', 'success', 'success'])[(l_partkey % 7) + 1] as status from lineitem), a as (select run, bool_or(status = 'failed') as f, bool_or(status = 'partial') as p, bool_or(status = 'success') as s from r group by run) select run, case when f and not s and not p then 'failed' when f or p then 'partial' when s then 'completed' else 'unsupported' end as run_status from a")
def agg_run_status(t: Catalog) -> DataFrame:
    rows = t["lineitem"].select(F.col("l_orderkey").alias("run"), V.pick(["success", "partial", "failed", "unsupported", "success", "success", "success"], F.col("l_partkey")).alias("status"))
    return metrics.run_status(rows, "run")


@query("select count(*) filter (event_type = 'click')::bigint as click, count(*) filter (event_type = 'purchase')::bigint as purchase, count(*)::bigint as total from events")
def agg_channels(t: Catalog) -> DataFrame:
    return metrics.channels(t["events"], "event_type", ["click", "purchase"])


@query(f"with i as ({V.SQL_INVENTORY}) select platform, health, count(*)::bigint as n, (list_sort(list(source_id)))[1:12] as samples from i group by 1, 2")
def agg_samples(t: Catalog) -> DataFrame:
    return metrics.samples(V.inventory(t), ["platform", "health"], "source_id")


@query(f"with j as ({V.SQL_LISTING}) select count(*) filter (country = 'en')::bigint as place, count(*) filter (n_chars > 1000)::bigint as title, count(*) filter (country = 'en' and n_chars > 1000)::bigint as combined, count(*)::bigint as total from j")
def agg_coverage(t: Catalog) -> DataFrame:
    return metrics.coverage(V.listing(t), {"place": F.col("country") == "en", "title": F.col("n_chars") > 1000})


@query("select doc_id, list_reduce(list_filter(list_transform(string_split(text, '.'), lambda x: trim(x)), lambda x: x <> ''), lambda a, x: case when contains('.' || a || '.', '.' || x || '.') then a else a || '.' || x end, '') as joined from documents")
def set_distinct_ordered(t: Catalog) -> DataFrame:
    parts = distinct_texts(F.split("text", r"\."))
    return t["documents"].select("doc_id", F.concat(F.when(F.size(parts) > 0, F.lit(".")).otherwise(F.lit("")), F.array_join(parts, ".")).alias("joined"))


@query(f"with i as ({V.SQL_INVENTORY}) select source_id, len(list_intersect(tags, ['tag1', 'geo2', 'geo3']))::bigint as shared from i")
def set_shared_keys(t: Catalog) -> DataFrame:
    return V.inventory(t).select("source_id", F.size(F.array_intersect("tags", F.array(*map(F.lit, ["tag1", "geo2", "geo3"])))).cast("long").alias("shared"))


_PLACES = "with g as (select n_name, upper(n_name[1]) || lower(n_name[2:]) as city, r_name, upper(r_name[1]) || lower(r_name[2:]) as country, r_regionkey, n_nationkey from nation join region on n_regionkey = r_regionkey)"


@query("select n.n_nationkey as id, ['country:' || lower(r_name), 'country_code:r' || r_regionkey, 'city:' || lower(r_name) || ':' || trim(regexp_replace(lower(n_name), '[^a-z0-9]+', ' ', 'g'))] as keys from nation n join region r on n.n_regionkey = r.r_regionkey")
def geo_keys(t: Catalog) -> DataFrame:
    none = F.lit(None).cast("string")
    rows = t["nation"].join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select(F.col("n_nationkey").alias("id"), places.point_keys(F.col("r_name"), F.concat(F.lit("R"), F.col("r_regionkey")), none, none, F.col("n_name")).alias("keys"))


@query("""
    select c_custkey as pos, case when c_custkey % 3 = 0 then 'remote' else 'unknown' end as workplace, case when c_custkey % 5 = 4 then null when c_custkey % 2 = 0 then lower(n_name) end as city, case when c_custkey % 5 <> 4 then lower(r_name) end as country
    from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
""")
def geo_resolve(t: Catalog) -> DataFrame:
    """Location texts, some remote, some unknown, against a gazetteer."""
    k = F.col("c_custkey")
    rows = t["customer"].join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey")).join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    place = F.when(k % 5 == 4, "Nowhere").when(k % 2 == 0, F.concat_ws(", ", "n_name", "r_name")).otherwise(F.col("r_name"))
    texts = rows.select(k.alias("pos"), F.concat(F.when(k % 3 == 0, "Remote - ").otherwise(""), place).alias("location"))
    found = places.resolve(texts, V.gazetteer(t), "pos", "location")
    first = F.try_element_at("points", F.lit(1))
    return found.select("pos", "workplace", F.lower(first["city"]).alias("city"), F.lower(first["country"]).alias("country"))


@query("select c_custkey as pos from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where r_name = 'ASIA' and c_custkey % 5 <> 4 and c_custkey % 3 <> 0")
def flt_geo_country(t: Catalog) -> DataFrame:
    """Postings with a physical place in a country; remote ones count only where nothing physical is known."""
    k = F.col("c_custkey")
    rows = t["customer"].join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey")).join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    place = F.when(k % 5 == 4, "Nowhere").otherwise(F.concat_ws(", ", "n_name", "r_name"))
    found = places.resolve(rows.select(k.alias("pos"), place.alias("location")), V.gazetteer(t), "pos", "location")
    none = F.slice("points", 1, 0)
    physical = F.when(F.col("pos") % 3 == 0, none).otherwise(F.col("points"))
    intent = places.parse_intent("Asia", [{"country": "Asia", "country_code": "R2"}])
    return found.where(places.matches(intent, physical, none, F.col("workplace"), F.col("global_remote"), F.lit(""))).select("pos")


@query(f"""
    with t as (select distinct title, pos % 7 as k from ({V.SQL_TITLES}))
    select title, (['software_engineering', 'data_analytics', 'product', null, null, 'data_platform', 'software_engineering'])[k + 1] as family, null::varchar as concept,
        case when k = 0 then 'same_family_related' else 'none' end as tier, case when k = 0 then 440 + 55 + 40 + 35 else 0 end as score, k = 0 as matches from t
""")
def txt_title_match(t: Catalog) -> DataFrame:
    """Every distinct title against "software engineer": tier, score, verdict."""
    ready = titles.prepare(t.spark)
    found = titles.match(titles.analyze(V.titles(t), ready), "software engineer", ready)
    return found.select("title", "family", "concept", "tier", "score", "matches")


@query("select date_trunc('hour', ts) as start, event_type, count(*)::bigint as n, round(sum(value), 6) as total from events group by 1, 2")
def ext_windowed_counts(t: Catalog) -> DataFrame:
    """Extension: hourly event-time windows."""
    return feed.windowed_counts(t["events"].withColumn("ts", F.col("ts").cast("timestamp"))).withColumn("total", F.round("total", 6))


@query("select n_regionkey, count(*)::bigint as n, sum(c_acctbal > 0)::bigint as positive, grouping(n_regionkey)::int as everything from customer join nation on c_nationkey = n_nationkey group by rollup (n_regionkey)")
def ext_rollup(t: Catalog) -> DataFrame:
    """Extension: totals by region and over all."""
    rows = t["customer"].join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.rollup("n_regionkey").agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") > 0).alias("positive"), F.grouping("n_regionkey").cast("int").alias("everything"))


@query(f"select count(*)::bigint as n, count(distinct {COMPARABLE.format('title')})::bigint as titles from ({V.SQL_TITLES})")
def agg_distinct_titles(t: Catalog) -> DataFrame:
    return V.titles(t).agg(F.count("*").alias("n"), F.count_distinct(comparable(F.col("title"))).alias("titles"))
