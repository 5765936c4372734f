"""Queries over titles' variants and the search index with its channels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.durable import persist
from vacantia.operators import entities as E
from vacantia.operators import search_index as S
from vacantia.operators import titles
from vacantia.operators.filters import SearchFilters
from vacantia.plans import board as B
from vacantia.plans import views as V
from vacantia.plans.registry import query
from vacantia.sources.tables import Catalog


@query("""
    select * from (values ('data engineer', 'original', 1, 0), ('data platform engineer', 'synonym', 1, 1), ('etl developer', 'synonym', 1, 2), ('etl engineer', 'synonym', 1, 3), ('data developer', 'synonym', 1, 4),
        ('data analyst', 'adjacent_concept', 1, 5), ('reporting analyst', 'adjacent_concept', 1, 6), ('analytics analyst', 'adjacent_concept', 1, 7), ('reporting engineer', 'adjacent_concept', 1, 8)) t(query, kind, tier, priority)
""")
def txt_variants(t: Catalog) -> DataFrame:
    """What "Data Engineer" stands for, best first."""
    found = S.variants(t.spark, "Data Engineer", titles.prepare(t.spark))
    return t.spark.createDataFrame([(v.query, v.kind, v.tier, v.priority) for v in found], "query string, kind string, tier int, priority int")


def indexed(t: Catalog) -> DataFrame:
    rows = B.board(t)
    k, none = F.col("pos"), F.lit(None).cast("timestamp")
    jobs = rows.select(
        k.alias("id"), "title", "level", F.when(k % 2 == 0, "explicit").otherwise("inferred").alias("level_source"), F.when(k % 9 != 0, k % 7 != 0).alias("is_active"), V.pick(["valid", "stale"], k).alias("link_status"), "platform",
        F.when(F.floor(k / 16) % 4 != 0, F.array(F.lit("country:france"), F.lit("country_code:fr"), F.lit("city:france:paris"))).alias("location_keys"), F.col("posted_at").alias("posting_date"), *[none.alias(c) for c in ("posted_at", "last_seen", "crawled_at", "discovered_at")],
    )
    return persist(S.with_index(jobs, titles.prepare(t.spark)))


@query(f"""
    with b as ({B.SQL_BOARD}) select pos, (['data engineer', 'ml engineer', 'analytics engineer', 'database developer', 'product manager', 'data scientist', 'data platform developer', 'engineer big data', 'data analyst', 'engineer', 'qa tester', null, 'etl specialist', 'data warehouse administrator', 'solutions engineer data', 'software engineer'])[pos % 16 + 1] as stripped,
        case pos % 16 when 0 then 'data_engineer' when 4 then 'product_manager' when 5 then 'data_analyst' when 6 then 'data_engineer' when 8 then 'data_analyst' when 15 then 'software_engineer' end as concept, case when (pos // 16) % 4 <> 0 then 2 else 0 end as country_keys,
        case when level is null then 'experience:unspecified' else 'experience:' || level end as level_key, case when pos % 9 = 0 then '' when pos % 7 <> 0 then 'status:active,' else 'status:inactive,' end || 'link_status:' || case when pos % 2 = 0 then 'valid' else 'stale' end || ',platform:' || platform as status from b
""")
def nrm_search_index(t: Catalog) -> DataFrame:
    i = lambda n: F.col(f"index.{n}")
    return indexed(t).select(
        F.col("id").alias("pos"), F.nullif(i("title_stripped"), F.lit("")).alias("stripped"), F.try_element_at(i("title_concepts"), F.lit(1)).alias("concept"), F.size(i("country_keys")).alias("country_keys"),
        F.element_at(i("experience_keys"), 1).alias("level_key"), F.array_join(i("status_keys"), ",").alias("status"),
    )


@query(f"""
    with b as ({B.SQL_BOARD}), r as (select *, pos % 16 as k, (pos % 9 = 0 or pos % 7 <> 0) and platform in ('ashby', 'greenhouse', 'workday') and (coalesce(level in ('senior', 'staff') and pos % 2 = 0, false) or level is null) and (pos // 16) % 4 <> 0 as base from b)
    select pos, k in (0, 6) as exact, k in (0, 5, 6, 8) as alias, k in (0, 5, 6, 8) as concept, k in (0, 2, 6) as family_role, k in (0, 5, 6, 7, 8, 13, 14) as phrase from r where base
""")
def flt_channels(t: Catalog) -> DataFrame:
    """Which channels of a search for data engineers in France take a posting."""
    plan = S.plan_of(t.spark, SearchFilters(title="Data Engineer", platforms=["greenhouse", "ashby", "workday"], levels=["senior", "staff"], level_mode="strict", unspecified_levels=True), titles.prepare(t.spark), ["country:france"])
    rows = indexed(t).where(S.base_clause(plan) & S.place_clause(plan))
    return rows.select(F.col("id").alias("pos"), *[c.alias(n) for n, c in S.channel_clauses(plan).items()])


@query(f"with b as ({B.SQL_BOARD}) select pos from b where (pos % 9 = 0 or pos % 7 <> 0) and pos % 16 in (0, 6) order by posted_at desc nulls last, title, pos limit 40")
def srt_candidates(t: Catalog) -> DataFrame:
    """The newest 40 of the exact channel."""
    plan = S.plan_of(t.spark, SearchFilters(title="Data Engineer"), titles.prepare(t.spark))
    rows = indexed(t)
    return S.found_candidates(S.stored_postings(rows), rows, plan, 40).where(F.array_contains("channels", "exact")).select(F.col("id").alias("pos"))


_ROLES = [(said, c.name, c.family) for c in titles.standard().concepts for said in (c.title, *c.aliases)]


@query(f"""
    with roles(said, concept, family) as (values {", ".join(f"('{s}', '{c}', '{f}')" for s, c, f in _ROLES)}),
    r as (select *, row_number() over () - 1 as spot from roles),
    t as (select distinct {V.sql_pick(V.LEVEL_WORDS, 'p_size')} || ' ' || upper(said) as title, concept, family from part join r on p_partkey % {len(_ROLES)} = spot)
    select title, concept, family from t
""")
def txt_roles(t: Catalog) -> DataFrame:
    """Role and family of every distinct title of ten families and fifty roles, under all their names and levels."""
    said = F.concat(V.pick(V.LEVEL_WORDS, F.col("p_size")), F.lit(" "), F.upper(V.pick([s for s, _, _ in _ROLES], F.col("p_partkey"))))
    found = titles.analyze(t["part"].select(said.alias("title")), titles.prepare(t.spark, titles.standard()))
    return found.select("title", "concept", "family")


@query("""
    with recursive k as (
        select doc_id, unnest([md5(lower(text)), source || ':' || n_chars, case when doc_id % 3 = 0 then 'group:' || (doc_id // 40) end]) as key from documents
    ), links as materialized (
        select distinct a.doc_id as a, b.first as b from k as a join (select key, min(doc_id) as first from k where key is not null group by key) as b using (key)
    ), reach as (
        select doc_id, doc_id as other from documents union select doc_id, n.b from reach join (select a, b from links union select b, a from links) as n on n.a = other
    )
    select doc_id, min(other) as entity from reach group by doc_id
""")
def mrg_incremental(t: Catalog) -> DataFrame:
    """Entities of all documents by three keys each, resolved in four batches."""
    d = t["documents"]
    k = F.col("doc_id")
    keys = F.array(F.md5(F.lower("text")), F.concat_ws(":", F.col("source"), F.col("n_chars").cast("string")), F.when(k % 3 == 0, F.concat(F.lit("group:"), F.floor(k / 40).cast("string"))))
    rows = d.select(k.alias("id"), keys.alias("keys"))
    state = E.nothing(t.spark)
    for batch in range(4):
        state = E.add_batch(state, rows.where(F.pmod(F.xxhash64("id"), F.lit(4)) == batch))
    return E.entities(state, rows).select(F.col("id").alias("doc_id"), "entity")
