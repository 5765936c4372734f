"""Queries over places: weighted evidence, conflicts, split texts, intents of every scope."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.operators import evidence, places, tagging
from vacantia.plans import views as V
from vacantia.plans.registry import query
from vacantia.sources.tables import Catalog


def _sites(t: Catalog) -> DataFrame:
    """Customers with country, state, city, location and metadata in turn; regions are countries, nations cities."""
    k = F.col("c_custkey")
    rows = t["customer"].join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey")).join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    none = F.lit(None).cast("string")
    city, country = F.col("n_name"), F.col("r_name")
    body = F.when(k % 4 == 1, F.to_json(F.struct(F.array(F.struct(city.alias("name"), F.struct(city.alias("city"), country.alias("country")).alias("address"))).alias("offices"), F.lit("remote").alias("workplaceType")))).when(
        k % 4 == 2, F.to_json(F.struct(F.concat(F.lit("Nice team. Remote within "), country, F.lit(". Good pay.")).alias("description")))
    )
    return rows.select(
        k.alias("pos"), F.when(k % 4 == 0, country).when(k % 4 == 3, "Atlantis").otherwise(none).alias("country"), none.alias("state"), F.when(k % 4 == 0, city).otherwise(none).alias("city"),
        F.when(k % 4 == 0, "Office in ASIA").when(k % 4 == 1, "Somewhere").when(k % 4 == 2, "EUROPE").otherwise(none).alias("location"), body.alias("metadata"),
    )


_PLACES = "select c_custkey as k, lower(n_name) as city, lower(r_name) as country, n_regionkey as r from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey"


@query(f"""
    with p as ({_PLACES})
    select k as pos, case k % 4 when 2 then 'europe' when 3 then 'atlantis' else country end as country, case when k % 4 < 2 then city end as city, k % 4 = 2 as remote,
        case k % 4 when 0 then 'high' when 1 then 'high' when 2 then 'medium' else 'low' end as confidence, case k % 4 when 0 then 3 when 1 then 3 when 2 then 2 else 0 end as pieces from p
""")
def geo_evidence(t: Catalog) -> DataFrame:
    """Stated fields outweigh texts, offices in metadata count as places, remote sentences as eligibility."""
    found = evidence.resolve_evidence(_sites(t), V.gazetteer(t), "pos", home="Nowhere")
    return found.select("pos", F.lower("country").alias("country"), F.lower("city").alias("city"), "remote", "confidence", F.size("evidence").alias("pieces"))


@query(f"""
    with p as ({_PLACES}) select k as pos, case when k % 4 = 2 and country <> 'europe' then 'physical_remote_conflict:' || 'europe,' || country else '' end as conflicts from p
""")
def geo_conflicts(t: Catalog) -> DataFrame:
    """Eligibility beyond the physical countries."""
    found = evidence.resolve_evidence(_sites(t).where("pos % 4 <> 0 or country = 'ASIA'").unionByName(_sites(t).where("pos % 4 = 0 and country <> 'ASIA'").withColumn("location", F.lit(None).cast("string"))), V.gazetteer(t), "pos", home="Nowhere")
    shown = F.array_join(F.transform(F.coalesce("conflicts", F.array().cast("array<struct<kind:string,countries:array<string>>>")), lambda c: F.concat(c["kind"], F.lit(":"), F.lower(F.array_join(c["countries"], ",")))), ";")
    return found.select("pos", shown.alias("conflicts"))


@query("""
    with p as (select c_custkey as k, n_name, upper(n_name[1]) || lower(n_name[2:]) as city, r_name, upper(r_name[1]) || lower(r_name[2:]) as country from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)
    select k as pos, case k % 6 when 0 then case when r_name = 'ASIA' then city else n_name end when 2 then case when r_name = 'ASIA' then city end when 4 then case when r_name = 'ASIA' then city else n_name end end as city,
        case k % 6 when 4 then 'West' end as state, case k % 6 when 0 then case when r_name = 'ASIA' then 'Asia' else r_name end when 1 then case when r_name = 'ASIA' then 'Asia' else r_name end when 2 then case when r_name = 'ASIA' then 'Asia' end
            when 4 then case when r_name = 'ASIA' then 'Asia' else r_name end end as country,
        case k % 6 when 0 then n_name || ', ' || r_name when 1 then 'Remote, ' || r_name when 2 then n_name when 3 then 'Location unavailable' when 4 then n_name || ', West, ' || r_name else 'Nowhere' end as location_text from p
""")
def geo_text_split(t: Catalog) -> DataFrame:
    """Texts of one, two and three parts; those of the home country (here Asia) by what they resolve to."""
    k = F.col("c_custkey")
    rows = t["customer"].join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey")).join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    text = F.when(k % 6 == 0, F.concat_ws(", ", "n_name", "r_name")).when(k % 6 == 1, F.concat(F.lit("Remote, "), F.col("r_name"))).when(k % 6 == 2, F.col("n_name")).when(k % 6 == 3, " ").when(k % 6 == 4, F.concat_ws(", ", "n_name", F.lit("West"), "r_name")).otherwise("Nowhere")
    texts = rows.select(k.alias("pos"), text.alias("text"))
    found = places.resolve(texts, V.gazetteer(t), "pos", "text").select("pos", F.try_element_at("points", F.lit(1)).alias("p"), (F.col("workplace") == "remote").alias("remote"))
    place = F.struct(F.col("p.country").alias("country"), F.col("p.region").alias("region"), F.col("p.city").alias("city"), F.col("remote").alias("remote"))
    out = texts.join(found, "pos").withColumn("s", evidence.split_location(F.col("text"), place, lambda part: F.lit(None).cast("string"), home="Asia"))
    return out.select("pos", "s.city", "s.state", "s.country", "s.location_text")


@query("select n_nationkey as id, (['AS', 'ca', ' Or ', 'TX', null])[n_nationkey % 5 + 1] as code, n_nationkey % 5 < 3 as ambiguous from nation")
def geo_codes(t: Catalog) -> DataFrame:
    k = F.col("n_nationkey")
    code = F.element_at(F.array(*[F.lit(c).cast("string") for c in ("AS", "ca", " Or ", "TX", None)]), (k % 5 + 1).cast("int"))
    return t["nation"].select(k.alias("id"), code.alias("code"), evidence.is_ambiguous_code(code).alias("ambiguous"))


INTENTS = ["", "Asia", "Nation_2", "Nation_2, Asia", "Remote", "Remote Asia", "Remote worldwide", "Remote in Nation_2", "Atlantis", "Remote Europe", "r2"]


@query("""
    with s as (select unnest(['', 'Asia', 'Nation_2', 'Nation_2, Asia', 'Remote', 'Remote Asia', 'Remote worldwide', 'Remote in Nation_2', 'Atlantis', 'Remote Europe', 'r2']) as asked),
    c as (select c_custkey as k, n_name, r_name, c_custkey % 3 = 0 as remote from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)
    select asked, count(*) filter (case asked when '' then true when 'Asia' then r_name = 'ASIA' when 'r2' then r_name = 'ASIA' when 'Nation_2' then n_name = 'NATION_2' and not remote when 'Nation_2, Asia' then n_name = 'NATION_2' and not remote
        when 'Remote' then remote when 'Remote worldwide' then remote when 'Remote Asia' then remote and r_name = 'ASIA' when 'Remote in Nation_2' then remote and n_name = 'NATION_2' when 'Remote Europe' then remote and r_name = 'EUROPE' else false end)::bigint as n from c, s group by asked
""")
def flt_geo_scopes(t: Catalog) -> DataFrame:
    """How many customers each kind of location intent takes; a third of them are remote, eligible where they live."""
    k = F.col("c_custkey")
    rows = t["customer"].join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey")).join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    found = places.resolve(rows.select(k.alias("pos"), F.concat_ws(", ", "n_name", "r_name").alias("location")), V.gazetteer(t), "pos", "location").withColumn("there", F.col("points"))
    gazetteer = [r.asDict(recursive=True) for r in V.gazetteer(t).collect()]  # a row a place
    none, remote = F.slice("there", 1, 0), F.col("pos") % 3 == 0
    physical, eligible = F.when(remote, none).otherwise(F.col("there")), F.when(remote, F.col("there")).otherwise(none)
    tests = [places.matches(places.parse_intent(x, gazetteer), physical, eligible, F.when(remote, "remote").otherwise("onsite"), F.lit(False), F.lit("")) for x in INTENTS]
    sums = found.agg(*[F.count_if(c).alias(f"n{i}") for i, c in enumerate(tests)])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(x).alias("asked"), F.col(f"n{i}").alias("n")) for i, x in enumerate(INTENTS)])).alias("r")).select("r.asked", "r.n")


# ---- places in running text

CODES = ["OR", "CA", "IN", "ME", "HI", "TX", "NY", "WA"]


def atlas(t: Catalog) -> DataFrame:
    """Countries, regions with codes, and metropolitan areas: regions, nations, and a port and an old town of each nation."""
    place = lambda c: F.initcap(F.lower(c))
    n = t["nation"].join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    none, empty = F.lit(None).cast("string"), F.array().cast("array<string>")
    country, code = place(F.col("r_name")).alias("country"), F.concat(F.lit("R"), F.col("r_regionkey")).alias("country_code")
    region, short = F.regexp_replace(place(F.col("n_name")), "_", " ").alias("region"), F.when(F.col("n_nationkey") < 8, V.pick(CODES, F.col("n_nationkey"))).alias("region_code")
    lands = t["region"].select(country, code, none.alias("region"), none.alias("region_code"), none.alias("city"), empty.alias("aliases"))
    areas = n.select(country, code, region, short, none.alias("city"), F.array(F.concat(F.lit("state of "), region)).alias("aliases"))
    towns = n.select(country, code, region, short, F.explode(F.array(F.concat(F.lit("Port "), region), F.concat(F.lit("Old "), region, F.lit(" town")))).alias("city"), empty.alias("aliases"))
    return lands.unionByName(areas).unionByName(towns)


SITES = [
    "Our team in Port {n} and elsewhere", "{n}, {r}", "Work in or near the office", "Somewhere nice, OR", "Remote within {r} only", "Old {n} Town; state of {n}", "no place named", "{r} or Port {n}", "New York office, TX or NY", "",
]


def _sited(t: Catalog) -> DataFrame:
    """Customers with running texts that name their nation and region in ten ways."""
    rows = t["customer"].join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey")).join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    text = F.replace(F.replace(V.pick(SITES, F.col("c_custkey")), F.lit("{n}"), F.regexp_replace("n_name", "_", " ")), F.lit("{r}"), F.col("r_name"))
    return rows.select(F.col("c_custkey").alias("pos"), text.alias("text"))


@query("""
    with p as (select c_custkey as k, upper(n_name[1]) || lower(replace(n_name, '_', ' '))[2:] as region, upper(r_name[1]) || lower(r_name)[2:] as country from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
    w as (select *, array_to_string(list_transform(string_split(region, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') as area, array_to_string(list_transform(string_split(country, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') as land from p),
    c as (select max(case when n_nationkey = 0 then upper(r_name[1]) || lower(r_name)[2:] end) as o, max(case when n_nationkey = 0 then 'Nation 0' end) as orr, max(case when n_nationkey = 5 then upper(r_name[1]) || lower(r_name)[2:] end) as x from nation join region on n_regionkey = r_regionkey)
    select k as pos, case when k % 10 in (0, 1, 4, 5, 7) then land when k % 10 = 3 then (select land from w where area = 'Nation 0' limit 1) when k % 10 = 8 then (select land from w where area = 'Nation 5' limit 1) end as country,
        case when k % 10 in (0, 1, 5, 7) then area when k % 10 = 3 then 'Nation 0' when k % 10 = 8 then 'Nation 5' end as region,
        case when k % 10 in (0, 7) then 'Port ' || area when k % 10 = 5 then 'Old ' || area || ' Town' end as city, k % 10 = 4 as remote from w
""")
def geo_located(t: Catalog) -> DataFrame:
    """Running texts of all customers: metropolitan areas over regions over countries, codes that are words at the end only."""
    found = tagging.locate(_sited(t), atlas(t), "pos", "text")
    return found.select("pos", "country", "region", F.initcap("city").alias("city"), "remote")


def passages(t: Catalog) -> DataFrame:
    """A gazetteer out of the benchmark's own words: of each item three words name a town, two its region, one its country."""
    words = F.split(places.normal_place(F.col("text")), " ")
    some = t["benchmark"].select("item_id", words.alias("w")).where(F.size("w") >= 6)
    none, empty = F.lit(None).cast("string"), F.array().cast("array<string>")
    run = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    land, area = run(6, 1).alias("country"), run(4, 2).alias("region")
    code = none.alias("country_code"), none.alias("region_code")
    return (
        some.select(land, *code, none.alias("region"), none.alias("city"), empty.alias("aliases"))
        .unionByName(some.select(land, *code, area, none.alias("city"), empty.alias("aliases")))
        .unionByName(some.select(land, *code, area, run(1, 3).alias("city"), empty.alias("aliases")))
    )


_NORMAL = r"trim(regexp_replace(lower(regexp_replace(strip_accents({}), '[^\x00-\x7F]', '', 'g')), '[^a-z0-9]+', ' ', 'g'))"


@query(f"""
    with w as (select string_split({_NORMAL.format('text')}, ' ') as w from benchmark),
    names as (select distinct array_to_string(w[a : a + n - 1], ' ') as alias, n from w, (values (1, 3), (4, 2), (6, 1)) as cut(a, n) where len(w) >= 6 and array_to_string(w[a : a + n - 1], ' ') <> ''),
    d as (select doc_id, string_split({_NORMAL.format('text')}, ' ') as words from documents),
    s as (select doc_id, i - 1 as start, n, array_to_string(words[i : i + n - 1], ' ') as alias from d, unnest(range(1, len(words) + 1)) as spot(i), (values (1), (2), (3)) as sizes(n) where i + n - 1 <= len(words)),
    h as (select doc_id, list([{{'start': start, 'n': n}}] order by n desc, start) as hits from s join names using (alias, n) group by doc_id),
    k as (select doc_id, unnest(list_reduce(hits, lambda kept, s: case when len(list_filter(kept, lambda k: k.start < s[1].start + s[1].n and s[1].start < k.start + k.n)) > 0 then kept else list_concat(kept, s) end)) as tag from h)
    select doc_id, count(*)::bigint as tags, sum(tag.n)::bigint as words, sum(tag.start * tag.n)::bigint as places from k group by doc_id
""")
def geo_tagged(t: Catalog) -> DataFrame:
    """Longest-first tags of a gazetteer of towns, regions and countries in every whole document."""
    docs = t["documents"].select("doc_id", places.normal_place(F.col("text")).alias("normal"))
    names = tagging.place_names(passages(t)).select("alias").distinct()
    found = tagging.tag(docs, names, "doc_id", F.split("normal", " "))
    return found.groupBy("doc_id").agg(F.count("*").alias("tags"), F.sum("n").cast("long").alias("words"), F.sum(F.col("start") * F.col("n")).cast("long").alias("places"))
