"""Queries over search results and the write path: display filters, tags, folds, inventory, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.functions.text import comparable
from vacantia.operators import display, records
from vacantia.operators.filters import SearchFilters
from vacantia.plans import views as V
from vacantia.plans.registry import query
from vacantia.sources.tables import Catalog

TITLES = [
    "Senior Data Engineer", "ML Engineer", "Analytics Engineer", "Database Developer", "Product Manager", "Data Scientist", "Data Platform Developer", "Engineer, Big Data",
    "Data Analyst", "Engineer", "Sr. QA Tester", "", "ETL Specialist", "Data Warehouse Administrator", "Solutions Engineer (Data)", "Staff Software Engineer",
]
COMPANIES = ["Acme Corp", "Globex, Inc.", "ACME-Labs", None, "Umbrella & Sons"]
SNIPPETS = ["We offer visa sponsorship.", "No visa sponsorship", "A distributed team.", "Work from home, H-1B welcome", "Visa sponsorship is not available here; h1b", "", "We will sponsor", "We cannot provide sponsorship; will sponsor later"]
REMOTE = ["remote", "hybrid", "onsite", "unknown", None]
HINTS = ["supported", "not_supported", "unknown", None]
KINDS = ["full_time", "part_time", "contract", None, "internship"]
LEVELS = ["senior", "staff", None, "junior", "lead", "principal"]
PLATFORMS = ["greenhouse", "lever", "ashby", "smartrecruiters", "workday", "company_page"]


def chosen(values: list, index: Column) -> Column:
    """As ``pick``, for values that may be null."""
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (index % len(values) + 1).cast("int"))


def sql_chosen(values: list, index: str) -> str:
    quoted = ", ".join("null" if v is None else "'" + v.replace("'", "''") + "'" for v in values)
    return f"([{quoted}])[({index}) % {len(values)} + 1]"


def board(t: Catalog) -> DataFrame:
    """Orders as search results."""
    k = F.col("o_orderkey")
    part = lambda n: F.floor(k / n)
    rows = t["orders"].select(
        k.alias("pos"), chosen(TITLES, k).alias("title"), chosen(COMPANIES, part(2)).alias("company"), chosen(SNIPPETS, part(3)).alias("snippet"), chosen(REMOTE, part(5)).alias("remote_type"),
        chosen(HINTS, part(7)).alias("sponsorship_hint"), chosen(KINDS, part(11)).alias("employment_type"), chosen(LEVELS, part(13)).alias("level"), chosen(PLATFORMS, part(17)).alias("platform"),
        F.when(k % 6 != 0, F.timestamp_seconds(F.lit(946684800) - (k * 37 % 1500) * 3600)).alias("posted_at"), (k % 4 != 0).alias("near"),
    )
    return rows.withColumn("text", display.searchable(F.col("title"), F.col("company"), F.col("snippet")))


SQL_BOARD = f"""select o_orderkey as pos, {sql_chosen(TITLES, 'o_orderkey')} as title, {sql_chosen(COMPANIES, 'o_orderkey // 2')} as company, {sql_chosen(SNIPPETS, 'o_orderkey // 3')} as snippet,
    {sql_chosen(REMOTE, 'o_orderkey // 5')} as remote_type, {sql_chosen(HINTS, 'o_orderkey // 7')} as sponsorship_hint, {sql_chosen(KINDS, 'o_orderkey // 11')} as employment_type,
    {sql_chosen(LEVELS, 'o_orderkey // 13')} as level, {sql_chosen(PLATFORMS, 'o_orderkey // 17')} as platform,
    case when o_orderkey % 6 <> 0 then timestamp '2000-01-01' - to_hours(o_orderkey * 37 % 1500) end as posted_at, o_orderkey % 4 <> 0 as near,
    array_to_string(list_filter([title, company, snippet], lambda x: x is not null and x <> ''), ' ') as text from orders"""

# Expected values, written out: which titles "data engineer" finds, which texts speak of remote work or visas.
_BOARD_RULES = r"""select *, case when remote_type in ('remote', 'hybrid') then true when remote_type = 'onsite' then false else regexp_matches(text, '(?i)\b(remote|work from home|distributed)\b') end as remote,
    case when sponsorship_hint = 'supported' then true when sponsorship_hint = 'not_supported' then false
        when text like '%No visa sponsorship%' or text like '%sponsorship is not available%' or text like '%cannot provide sponsorship%' then false
        else text like '%offer visa sponsorship%' or text like '%H-1B%' or text like '%will sponsor%' end as visa from b"""


@query(f"""
    with b as ({SQL_BOARD}), r as ({_BOARD_RULES}),
    p as (select pos, pos % 16 in (0, 2, 3, 6, 7, 9, 13, 14) as title, near as location, platform in ('greenhouse', 'ashby', 'workday') as platform, coalesce(level in ('senior', 'staff'), false) or level is null as experience,
        remote as workplace, coalesce(employment_type in ('full_time', 'contract'), false) as employment, visa as sponsorship, coalesce(company in ('Acme Corp', 'ACME-Labs'), false) as company,
        coalesce(posted_at >= timestamp '1999-12-02', false) as posted from r)
    select *, title and location and platform and experience and workplace and employment and sponsorship and company and posted as shown from p
""")
def flt_display(t: Catalog) -> DataFrame:
    """The nine display tests of every result, and whether all hold."""
    search = SearchFilters(title="Data Engineer", platforms=["greenhouse", "ashby", "workday"], levels=["senior", "staff"], level_mode="broad")
    result = display.ResultFilters(workplace="remote", employment_types=["full_time", "contract"], sponsorship="supported", company="acme!", posted="30d")
    tests = display.predicates(search, result, F.col("near"), V.now())
    shown = display.display(board(t), search, result, F.col("near"), V.now()).select(F.col("pos").alias("__pos"), F.lit(True).alias("__shown"))
    rows = board(t).select("pos", *[c.alias(name) for name, c in tests.items()])
    return rows.join(shown, F.col("pos") == F.col("__pos"), "left").select("pos", *tests, F.coalesce("__shown", F.lit(False)).alias("shown"))


@query(f"with b as ({SQL_BOARD}) select pos, coalesce(posted_at >= timestamp '1999-12-31', false) as day, coalesce(posted_at >= timestamp '1999-12-25', false) as week, coalesce(remote_type = 'hybrid', false) as hybrid, coalesce(sponsorship_hint = 'unknown', false) as unsaid from b")
def flt_display_windows(t: Catalog) -> DataFrame:
    """The other windows and exact choices."""
    from vacantia.functions.dates import posted_within

    at = F.col("posted_at")
    return board(t).select(
        "pos", posted_within(at, "24h", V.now()).alias("day"), posted_within(at, "7d", V.now()).alias("week"), display.workplace(F.col("remote_type"), F.col("text"), "hybrid").alias("hybrid"),
        display.sponsorship(F.col("sponsorship_hint"), F.col("text"), "unknown").alias("unsaid"),
    )


@query(f"""
    with b as ({SQL_BOARD}), r as ({_BOARD_RULES})
    select pos, array_to_string(list_filter([case remote_type when 'hybrid' then 'Hybrid' when 'remote' then 'Remote' when 'onsite' then 'On-site' else case when remote then 'Remote' end end, case when visa then 'Visa' end,
            case level when 'senior' then 'Senior' when 'staff' then 'Staff' when 'junior' then 'Junior' when 'lead' then 'Lead' when 'principal' then 'Principal' end, case when posted_at >= timestamp '1999-12-29' then 'New' end], lambda x: x is not null), ',') as tags,
        case sponsorship_hint when 'supported' then 'Sponsorship available' when 'not_supported' then 'No sponsorship' else case when visa then 'Sponsorship likely' else 'Sponsorship not specified' end end as sponsorship,
        case employment_type when 'full_time' then 'Full-time' when 'part_time' then 'Part-time' when 'contract' then 'Contract' when 'internship' then 'Internship' else 'Not specified' end as employment,
        coalesce(strftime(posted_at, '%b %-d, %Y'), 'Date unavailable') as posted from r
""")
def nrm_tags(t: Catalog) -> DataFrame:
    c = F.col
    return board(t).select(
        "pos", F.array_join(display.tags(c("remote_type"), c("sponsorship_hint"), c("level"), c("posted_at"), c("text"), V.now()), ",").alias("tags"),
        display.sponsorship_label(c("sponsorship_hint"), c("text")).alias("sponsorship"), display.employment_label(c("employment_type")).alias("employment"), display.posted_label(c("posted_at")).alias("posted"),
    )


@query(f"with b as ({SQL_BOARD}) select pos, posted_at from b order by posted_at desc nulls last, platform, title, pos limit 100")
def srt_display(t: Catalog) -> DataFrame:
    return board(t).orderBy(*display.display_order(), "pos").limit(100).select("pos", "posted_at")


@query("""
    select case when c_custkey % 4 = 3 then case when c_custkey % 5 = 0 then 'country:cote_d_ivoire' when c_custkey % 7 = 0 then 'unknown' else 'country:france' end
        when c_custkey % 3 = 0 then 'remote_us' when c_custkey % 5 = 1 then 'city_state_us' when c_custkey % 5 = 2 then 'state_us' else 'united_states' end as bucket, count(*)::bigint as n from customer group by 1
""")
def agg_place_categories(t: Catalog) -> DataFrame:
    k = F.col("c_custkey")
    country = F.when(k % 5 == 0, " Cote d'Ivoire ").when(k % 7 == 0, None).otherwise("France")
    bucket = display.category(k % 4 != 3, k % 3 == 0, F.when(k % 5 == 1, "Austin"), F.when((k % 5).isin(1, 2), "TX"), F.when(k % 2 == 0, country), country)
    return t["customer"].select(bucket.alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


# ---- the write path


def _lines(t: Catalog, *more: Column) -> DataFrame:
    """Line items as records of their order, several a key."""
    l, none = F.col("l_linenumber"), F.lit(None).cast("string")  # noqa: E741
    ship = F.col("l_shipdate").cast("timestamp")
    return t["lineitem"].select(
        F.col("l_orderkey").cast("string").alias("canonical_key"), (F.col("l_orderkey") * 10 + l).alias("pos"), V.pick(["valid", "unknown", "stale", "invalid"], F.col("l_suppkey")).alias("link_status"),
        F.when(l % 2 == 0, "r").alias("resolved_url"), none.alias("canonical_url"), none.alias("apply_url"), F.when(l % 3 != 0, "s").alias("source_url"), none.alias("validated_at"),
        F.when(F.col("l_partkey") % 3 != 0, F.col("l_suppkey").cast("string")).alias("mode"), F.array(F.col("l_returnflag"), F.col("l_linestatus")).alias("lookup_keys"),
        ship.alias("first_seen"), (ship + F.expr("interval 1 day")).alias("last_seen"), ((F.col("l_orderkey") + l) % 3 == 0).alias("is_active"), F.when(l % 4 == 0, ship).alias("closed_at"), *more,
    )


_SQL_LINES = """select l_orderkey::varchar as canonical_key, l_orderkey * 10 + l_linenumber as pos, (case l_suppkey % 4 when 0 then 3 when 1 then 2 when 2 then 1 else 0 end) + (l_linenumber % 2 = 0)::int as score,
    (l_linenumber % 2 = 0)::int + (l_linenumber % 3 <> 0)::int as urls, case when l_partkey % 3 <> 0 then l_suppkey::varchar end as mode, [l_returnflag, l_linestatus] as keys, l_shipdate::timestamp as first_seen,
    l_shipdate::timestamp + interval 1 day as last_seen, (l_orderkey + l_linenumber) % 3 = 0 as is_active, case when l_linenumber % 4 = 0 then l_shipdate::timestamp end as closed_at from lineitem"""
_RANK = "row(score, urls, len(keys), epoch_ms(last_seen), -epoch_ms(first_seen), -pos)"
_FOLD = f"""select canonical_key, arg_max(pos, {_RANK}) as pos, count(*)::bigint as records, arg_max(mode, {_RANK}) filter (mode is not null) as mode, min(first_seen) as first_seen, max(last_seen) as last_seen,
    list_sort(list_distinct(flatten(list(keys)))) as keys"""


@query(f"with l as ({_SQL_LINES}), f as ({_FOLD}, arg_max(is_active, pos) as is_active, max(closed_at) as closed from l group by canonical_key) select canonical_key, pos, records, mode, first_seen, last_seen, keys, is_active, case when not is_active then coalesce(closed, last_seen) end as closed_at from f")
def snk_coalesce(t: Catalog) -> DataFrame:
    """A batch with one record a key: the best record's fields, gaps filled, dates widened, states of the last.

    Lines that agree in all that ranks them may differ in ``mode``; the first of the table stays, as in a loop over it.
    """
    file = F.shiftleft(F.pmod(F.xxhash64("_metadata.file_name"), F.lit(1 << 22)), 40)  # of several files, one after the other by their names' hash
    out = records.coalesced(_lines(t, (file + F.col("_metadata.row_index")).alias("arrival")))
    return out.select("canonical_key", "pos", "records", "mode", "first_seen", "last_seen", F.col("lookup_keys").alias("keys"), "is_active", "closed_at")


@query(f"with l as (select * replace (case when pos % 7 = 0 then 'fixed:' || (pos // 20) else canonical_key end as canonical_key), canonical_key as given from ({_SQL_LINES})), c as (select canonical_key as k, count(*) as n from l where pos % 7 <> 0 group by 1), m as (select l.* replace (case when pos % 7 = 0 or c.n > 1 then 'fixed:' || (pos // 20) else canonical_key end as canonical_key) from l left join c on l.canonical_key = c.k and pos % 7 <> 0), f as ({_FOLD}, bool_or(is_active) as is_active from m group by canonical_key) select canonical_key, pos, records, is_active from f")
def snk_migrate(t: Catalog) -> DataFrame:
    """Keys that are missing or repeated are made anew, and what then shares one is folded."""
    rows = _lines(t).withColumn("canonical_key", F.when(F.col("pos") % 7 == 0, None).otherwise(F.col("canonical_key")))
    survivors, _, _ = records.migrated(rows, F.concat(F.lit("fixed:"), F.floor(F.col("pos") / 20).cast("string")))
    return survivors.select("canonical_key", "pos", "records", "is_active")


@query("select s_suppkey as source_id, case when s_suppkey % 2 = 0 then 'new' else 'old' end as label, case when s_suppkey % 2 = 0 then least(s_suppkey * 3, 500) else s_suppkey * 3 end as crawl_priority, case when s_suppkey % 3 = 0 and s_suppkey % 2 <> 0 then null when s_suppkey % 3 = 0 then timestamp '2000-01-02' else timestamp '2000-01-01' end as next_eligible_at, case when s_suppkey % 2 = 0 then 'a=1,b=3,c=4' else 'a=1,b=2' end as metadata, 'paused' as status from supplier where s_suppkey % 5 <> 0 union all select s_suppkey, 'new', 500, timestamp '2000-01-02', 'b=3,c=4', 'active' from supplier where s_suppkey % 5 = 0 and s_suppkey % 2 = 0")
def snk_inventory(t: Catalog) -> DataFrame:
    """Stored sources with incoming descriptions."""
    k = F.col("s_suppkey")
    day = lambda d: F.lit(f"2000-01-0{d}").cast("timestamp")
    made = lambda rows, label, priority, at, status, *entries: rows.select(k.alias("source_id"), F.lit(label).alias("label"), priority.cast("long").alias("crawl_priority"), at.alias("next_eligible_at"), F.create_map(*map(F.lit, entries)).alias("metadata"), F.lit(status).alias("status"))
    old = made(t["supplier"].where(k % 5 != 0), "old", k * 3, F.when(k % 3 != 0, day(1)), "paused", "a", "1", "b", "2")
    new = made(t["supplier"].where(k % 2 == 0), "new", F.lit(500), day(2), "active", "b", "3", "c", "4")
    entries = F.array_sort(F.transform(F.map_entries("metadata"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return records.upserted_inventory(old, new).select("source_id", "label", "crawl_priority", "next_eligible_at", F.array_join(entries, ",").alias("metadata"), "status")


@query(f"""
    with i as ({V.SQL_INVENTORY}), o as (select *, source_id % 3 <> 2 as seen, source_id % 3 = 0 as ok from i),
    h as (select *, case when ok then 0 else consecutive_failures + 1 end as failures from o), g as (select *, case when source_id % 10 = 0 then 'unknown' when ok then 'healthy' when failures >= 3 then 'failing' else 'degraded' end as h2 from h)
    select source_id, case when seen then h2 else health end as health, case when seen then failures else consecutive_failures end as consecutive_failures, case when seen then null else lease_owner end as lease_owner,
        case when seen then timestamp '2000-01-01' else last_crawled_at end as last_crawled_at,
        case when not seen then next_eligible_at when ok then timestamp '2000-01-01' + to_milliseconds(least(86400000, 3600000 * (case when crawl_priority <= 100 then 2 when crawl_priority <= 10000 then 3 when crawl_priority <= 30000 then 4 else 6 end
                + case when source_type in ('ats_board', 'feed') then 0 when source_type = 'career_site' then 1 when source_type = 'company_page' then 2 else 3 end + case confidence when 'high' then 0 when 'medium' then 1 else 2 end + case h2 when 'healthy' then 0 when 'unknown' then 1 else 2 end)))
            else timestamp '2000-01-01' + to_milliseconds(least(greatest(round(3600000 * pow(2, least(5, failures)) * case h2 when 'failing' then 2.0 when 'degraded' then 1.5 else 1.0 end), 7200000), 604800000)::bigint) end as next_eligible_at from g
""")
def snk_observe(t: Catalog) -> DataFrame:
    """Sources after their runs."""
    none = F.lit(None).cast("string")
    inventory = V.inventory(t).select("*", F.lit(0).cast("long").alias("failure_count"), none.alias("last_failure"), *[none.cast("timestamp").alias(c) for c in ("last_seen", "last_succeeded_at", "last_failed_at")])
    k = F.col("source_id")
    runs = inventory.where(k % 3 != 2).select(k, (k % 3 == 0).alias("succeeded"), V.now().alias("observed_at"), F.when(k % 10 == 0, "unknown").alias("health"), none.alias("status"), none.alias("reason"), none.cast("timestamp").alias("next_eligible_at"))
    return records.observed(inventory, runs, 3_600_000).select("source_id", "health", "consecutive_failures", "lease_owner", "last_crawled_at", "next_eligible_at")


@query("""
    with u as (select user_id as k, count(*) as n, sum(case when event_type = 'click' then 1 else 0 end) as clicks, arg_max(event_type, event_id) as last_kind, arg_min(event_type, event_id) as first_kind from events where event_id % 2 = 0 group by 1)
    select coalesce(c_custkey, k) as k, coalesce(c_nationkey, 0) + coalesce(n, 0) as n, case when c_custkey is null then clicks else coalesce(clicks, 0) end::bigint as clicks, case when u.k is not null then last_kind else 'stored' end as last_kind, case when c_custkey is not null then 'stored' else first_kind end as first_kind
    from (select * from customer where c_custkey % 3 <> 0) c full join u on c_custkey = u.k
""")
def snk_increment(t: Catalog) -> DataFrame:
    """Counters of customers raised by events; new ones begin with theirs."""
    stored = t["customer"].where("c_custkey % 3 <> 0").select(F.col("c_custkey").cast("long").alias("k"), F.col("c_nationkey").cast("long").alias("n"), F.lit(0).cast("long").alias("clicks"), F.lit("stored").alias("last_kind"), F.lit("stored").alias("first_kind"))
    e = F.col("event_type")
    updates = t["events"].where("event_id % 2 = 0").select(F.col("user_id").cast("long").alias("k"), F.col("event_id").alias("pos"), F.lit(1).cast("long").alias("n"), F.when(e == "click", 1).otherwise(0).cast("long").alias("clicks"), e.alias("last_kind"), e.alias("first_kind"))
    return records.incremented(stored, updates, "k", ["n", "clicks"], ["last_kind"], ["first_kind"])


@query("select p_partkey as pos, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) as normal, case when p_partkey % 3 = 0 then 'normal' when p_partkey % 5 = 0 then 'kind' else '' end || case when p_partkey % 15 = 0 then ',kind' else '' end as changed from part")
def snk_backfill(t: Catalog) -> DataFrame:
    """Derived columns worked out anew, and which of them were out of date."""
    k = F.col("p_partkey")
    normal = comparable(F.col("p_name"))
    rows = t["part"].select(k.alias("pos"), "p_name", F.when(k % 3 == 0, None).otherwise(normal).alias("normal"), F.when(k % 5 == 0, "?").otherwise("part").alias("kind"))
    out = records.repaired(rows, {"normal": normal, "kind": F.lit("part")})
    return out.select("pos", "normal", F.array_join("changed_fields", ",").alias("changed"))


@query("""
    with d as (select doc_id as pos, md5(lower(text)) as k, doc_id % 3 = 0 as weak from documents), g as (select *, pos * 2 + (pos % 2) as p, pos % 2 as s from d),
    e as (select *, min(p) over (partition by weak, k) as entity from g) select entity, count(*)::bigint as records, count(*) filter (s = 0)::bigint as indexed from e group by entity
""")
def mrg_results(t: Catalog) -> DataFrame:
    """Indexed and supplemental postings as one list without duplicates."""
    rows = V.postings(t)
    out = records.merged_results(rows.where("pos % 2 = 0"), rows.where("pos % 2 = 1"))
    from vacantia.operators.resolve import entities

    both = rows.where("pos % 2 = 0").withColumn("pos", F.col("pos") * 2).unionByName(rows.where("pos % 2 = 1").withColumn("pos", F.col("pos") * 2 + 1))
    indexed = entities(both).groupBy("entity").agg(F.count_if(F.col("pos") % 4 == 0).alias("indexed"))
    return out.select("entity", "records").join(indexed, "entity")


@query("select max(c_custkey) as search_id from customer where c_nationkey = 7 and c_mktsegment = 'BUILDING'")
def joi_saved_search(t: Catalog) -> DataFrame:
    """The newest saved search with the same filters."""
    saved = t["customer"].select(F.col("c_custkey").alias("search_id"), F.col("c_custkey").alias("created_at"), F.struct(F.col("c_nationkey").cast("string").alias("nation"), F.col("c_mktsegment").alias("segment"), F.lit("").alias("city")).alias("filters"))
    return records.searched_before(saved, {"segment": "BUILDING", "nation": "7", "city": ""}).select("search_id")
