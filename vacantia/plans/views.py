"""The tables at hand seen as postings, sources and logs; the same in SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.sources.tables import Catalog

NOW = "2000-01-01 00:00:00"
LEVEL_WORDS = ["Senior", "Junior", "", "Staff", "Lead", "Principal", "Entry Level", "New Grad", "II", "Sr."]
ROLE_WORDS = ["Software Engineer", "Data Analyst", "Product Manager", "Back-End Developer", "QA Tester", "Data Engineer", "Full Stack Engineer"]
EMPLOYMENT_WORDS = ["Full-time", "Part time", "Contractor", "Temp", "Internship", "Seasonal", "", "Freelance", "Other"]
PLACE_WORDS = ["Remote", "Hybrid, Paris", "Lyon", "", "Distributed team"]
VISA_TEXTS = [
    "We sponsor visas and H1B transfer is welcome.", "No visa sponsorship.", "You must be authorized to work here.", "Great team.", "Visa sponsorship available", "We cannot sponsor now.",
]
PAY_TEXTS = ["$90,000 - $120,500 per year", "25 to 40 per hour", "competitive", "$1,000-2,000 / week"]
YEARS_TEXTS = ["3 to 5 years of experience", "at least 8+ years", "12 yrs in the field", "1 year", "no number", "2-4 yrs and minimum 6 years"]
HEALTHS = ["healthy", "unknown", "degraded", "failing"]
KINDS = ["ats_board", "feed", "job_detail", "career_site", "company_page", "other"]


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def pick(values: list[str], index: Column) -> Column:
    """The value at ``index`` modulo their number."""
    return F.element_at(F.array(*map(F.lit, values)), (index % len(values) + 1).cast("int"))


def sql_pick(values: list[str], index: str) -> str:
    quoted = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"([{quoted}])[({index}) % {len(values)} + 1]"


def titles(t: Catalog) -> DataFrame:
    """``pos, title`` from parts."""
    title = F.concat_ws(" ", pick(LEVEL_WORDS, F.col("p_size")), pick(ROLE_WORDS, F.col("p_partkey")), F.element_at(F.split("p_name", " "), 1))
    return t["part"].select(F.col("p_partkey").alias("pos"), title.alias("title"))


SQL_TITLES = f"select p_partkey as pos, concat_ws(' ', {sql_pick(LEVEL_WORDS, 'p_size')}, {sql_pick(ROLE_WORDS, 'p_partkey')}, string_split(p_name, ' ')[1]) as title from part"


def offers(t: Catalog) -> DataFrame:
    """``pos`` and the free texts of an offer, from customers."""
    k = F.col("c_custkey")
    return t["customer"].select(
        k.alias("pos"), F.col("c_name").alias("company"), pick(EMPLOYMENT_WORDS, k).alias("employment"), pick(PLACE_WORDS, k).alias("location"), pick(VISA_TEXTS, k).alias("visa"),
        pick(PAY_TEXTS, k).alias("pay"), pick(YEARS_TEXTS, k).alias("years"), (k % 7 == 0).alias("sponsors"), F.col("c_nationkey").alias("nation"),
    )


SQL_OFFERS = f"""select c_custkey as pos, c_name as company, {sql_pick(EMPLOYMENT_WORDS, 'c_custkey')} as employment, {sql_pick(PLACE_WORDS, 'c_custkey')} as location,
    {sql_pick(VISA_TEXTS, 'c_custkey')} as visa, {sql_pick(PAY_TEXTS, 'c_custkey')} as pay, {sql_pick(YEARS_TEXTS, 'c_custkey')} as years, c_custkey % 7 = 0 as sponsors, c_nationkey as nation from customer"""


def listing(t: Catalog) -> DataFrame:
    """Documents as postings: the text as title, the source as platform, state from the labels."""
    d = t["documents"].join(t["labels"], "doc_id", "left")
    status = F.when(F.col("quality") == 1, "valid").when(F.col("quality") == 0, "stale").otherwise("unknown")
    return d.select(
        F.col("doc_id").alias("pos"), F.col("text").alias("title"), F.col("source").alias("platform"), F.col("lang").alias("country"), status.alias("link_status"),
        (F.coalesce(F.col("toxic"), F.lit(0)) == 0).alias("is_active"), F.col("n_chars").alias("n_chars"), F.col("text"),
    )


SQL_LISTING = """select d.doc_id as pos, text as title, source as platform, lang as country,
    case quality when 1 then 'valid' when 0 then 'stale' else 'unknown' end as link_status, coalesce(toxic, 0) = 0 as is_active, n_chars, text
    from documents d left join labels l on d.doc_id = l.doc_id"""


def postings(t: Catalog) -> DataFrame:
    """Documents with identity columns; copies of a text share a URL, and each posting has one of its own."""
    d = t["documents"]
    key = F.md5(F.lower("text"))
    url = lambda k: F.concat(F.lit(f"https://jobs.example.com/{k}/"), key)
    none = F.lit(None).cast("string")
    return d.select(
        F.col("doc_id").alias("pos"), F.col("source").alias("platform"), F.when(F.col("doc_id") % 3 != 0, F.col("source")).alias("company_slug"), F.when(F.col("doc_id") % 3 != 0, F.col("doc_id").cast("string")).alias("source_job_id"),
        F.when(F.col("doc_id") % 3 == 1, F.array(F.concat_ws(":", F.col("source"), F.lit("b"), F.col("doc_id").cast("string")))).otherwise(F.array().cast("array<string>")).alias("lookup_keys"),
        F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("https://s.example.com/"), F.col("doc_id").cast("string"))).alias("source_url"), none.alias("apply_url"), none.alias("resolved_url"),
        F.when(F.col("doc_id") % 3 != 0, url("c")).alias("canonical_url"), F.col("source").alias("company"), F.col("text").alias("title"), F.col("lang").alias("location"), key.alias("fingerprint"),
        F.when(F.col("doc_id") % 2 == 0, "valid").otherwise("unknown").alias("link_status"), none.alias("validated_at"),
        F.timestamp_seconds(F.col("doc_id") * 3600).alias("posted_at"), F.timestamp_seconds(F.col("doc_id") * 60).alias("discovered_at"),
    )


def inventory(t: Catalog) -> DataFrame:
    """Suppliers as sources with health, rank, failures and dates."""
    k = F.col("s_suppkey")
    at = lambda h: F.timestamp_seconds(F.lit(946684800) + h * 3600)
    return t["supplier"].select(
        k.alias("source_id"), F.concat(F.lit("p"), (k % 6).cast("string")).alias("platform"), pick(HEALTHS, k).alias("health"), pick(KINDS, k).alias("source_type"), pick(["high", "medium", "low"], k).alias("confidence"),
        F.when(k % 11 == 0, "paused").otherwise("active").alias("status"), (k * 37 % 500).cast("long").alias("inventory_rank"), (k * 91 % 40000).cast("long").alias("crawl_priority"),
        (k % 7).cast("long").alias("consecutive_failures"), F.when(k % 5 != 0, at(-(k % 90))).alias("last_crawled_at"), at(k % 49 - 24).alias("next_eligible_at"),
        F.when(k % 4 == 0, "worker-1").when(k % 4 == 1, "worker-2").alias("lease_owner"), F.when(k % 4 < 2, at(k % 9 - 4)).alias("lease_expires_at"),
        F.array(F.concat(F.lit("tag"), (k % 3).cast("string")), F.concat(F.lit("geo"), (k % 5).cast("string"))).alias("tags"),
    )


SQL_INVENTORY = f"""select s_suppkey as source_id, 'p' || (s_suppkey % 6) as platform, {sql_pick(HEALTHS, 's_suppkey')} as health, {sql_pick(KINDS, 's_suppkey')} as source_type, {sql_pick(['high', 'medium', 'low'], 's_suppkey')} as confidence,
    case when s_suppkey % 11 = 0 then 'paused' else 'active' end as status, s_suppkey * 37 % 500 as inventory_rank, s_suppkey * 91 % 40000 as crawl_priority, s_suppkey % 7 as consecutive_failures,
    case when s_suppkey % 5 <> 0 then timestamp '2000-01-01' - to_hours(s_suppkey % 90) end as last_crawled_at, timestamp '2000-01-01' + to_hours(s_suppkey % 49 - 24) as next_eligible_at,
    case s_suppkey % 4 when 0 then 'worker-1' when 1 then 'worker-2' end as lease_owner, case when s_suppkey % 4 < 2 then timestamp '2000-01-01' + to_hours(s_suppkey % 9 - 4) end as lease_expires_at,
    ['tag' || (s_suppkey % 3), 'geo' || (s_suppkey % 5)] as tags from supplier"""


def log(t: Catalog) -> DataFrame:
    """Events as a change log: the id as sequence, the user as job."""
    return t["events"].select(F.col("event_id").alias("sequence"), F.col("user_id").alias("job_id"), "ts", "event_type", "value", "props")


SQL_LOG = "select event_id as sequence, user_id as job_id, ts, event_type, value, props from events"


def gazetteer(t: Catalog) -> DataFrame:
    """Nations as cities of their region's country, regions as countries."""
    place = lambda c: F.initcap(F.lower(c))
    r = t["region"].select(F.col("r_regionkey").alias("k"), place(F.col("r_name")).alias("country"), F.concat(F.lit("R"), F.col("r_regionkey")).alias("country_code"))
    none = F.lit(None).cast("string")
    cities = t["nation"].join(r, F.col("n_regionkey") == F.col("k")).select("country", "country_code", none.alias("region"), none.alias("region_code"), place(F.col("n_name")).alias("city"), F.array(F.concat(F.lit("n"), F.col("n_nationkey"))).alias("aliases"))
    return r.select("country", "country_code", none.alias("region"), none.alias("region_code"), none.alias("city"), F.array().cast("array<string>").alias("aliases")).unionByName(cities)
