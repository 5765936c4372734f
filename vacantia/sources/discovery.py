"""Sources found in landed result pages, registries and company pages.

Result pages are tables of HTML or feed text; their links are cut out, cleaned and
classified by the URL grammars.  Sources come together by union and are made distinct by
id, the first by order of origin; what is known already goes by an anti-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vacantia.functions.text import slug_to_label
from vacantia.functions.urls import canonical, classify, host, is_http, path
from vacantia.operators.schedule import interleave
from vacantia.sources import pages as P

# Words of career pages, and of pages that are none.
CAREER_NO = r"\b(blog|press|news|investors?|privacy|terms|support|docs?|developer|events?)\b"
CAREER_YES = r"\b(careers?|jobs?|join-us|join-our-team|open-roles?|opportunities|vacancies|positions)\b"
RESULT_HOST, RESULT_PARAMETER = "duckduckgo.com", "uddg"
BASES = {"greenhouse": "https://boards.greenhouse.io/", "lever": "https://jobs.lever.co/", "ashby": "https://jobs.ashbyhq.com/", "smartrecruiters": "https://jobs.smartrecruiters.com/"}
RANK_OFFSETS = {"registry:lever": 10_000, "registry:ashby": 20_000, "registry": 30_000, "configured:lever": 40_000, "configured:ashby": 45_000, "manual": 50_000, "catalog": 60_000}


def candidate_url(url: Column) -> Column:
    """A result's URL without fragment; null if it is no http URL or the result page's own."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    return F.when(is_http(bare) & ~F.coalesce(host(bare).contains(RESULT_HOST), F.lit(False)), bare)


def result_urls(pages: DataFrame, identity: str, html: str) -> DataFrame:
    """``identity, url, links``: distinct targets of a result page's links, through its redirects, with the number of all its links."""
    found = F.regexp_extract_all(F.col(html), F.lit(r"""(?i)href=["']([^"'#]+)["']"""), F.lit(1))
    rows = pages.select(identity, F.size(found).alias("links"), F.explode(found).alias("raw"))
    absolute = P.resolve_url(F.col("raw"), F.lit(f"https://html.{RESULT_HOST}/html/"))
    rows = rows.withColumn("absolute", absolute)
    inner = F.regexp_extract("absolute", rf"[?&]{RESULT_PARAMETER}=([^&#]*)", 1)
    url = F.when(inner != "", candidate_url(F.try_url_decode(inner))).otherwise(candidate_url(F.col("absolute")))
    return rows.select(identity, url.alias("url"), "links").where(F.col("url").isNotNull()).distinct()


def feed_urls(pages: DataFrame, identity: str, xml: str) -> DataFrame:
    """``identity, url, links``: the same of an RSS result feed."""
    found = F.regexp_extract_all(F.col(xml), F.lit(r"(?is)<item\b.*?<link>([^<]+)</link>"), F.lit(1))
    rows = pages.select(identity, F.size(found).alias("links"), F.explode(found).alias("raw"))
    return rows.select(identity, candidate_url(F.col("raw")).alias("url"), "links").where(F.col("url").isNotNull()).distinct()


def is_career_url(url: Column) -> Column:
    query = F.regexp_extract(url, r"(\?[^#]*)", 1)
    said = F.lower(F.concat_ws(" ", host(url), path(url), query))
    return ~said.rlike(CAREER_NO) & said.rlike(CAREER_YES)


def candidate(url: Column) -> Column:
    """Struct of platform, kind (detail, source or other), token and job id of a URL."""
    b = classify(url)
    board = b["platform"] != "company_page"
    kind = F.when(board & (F.coalesce(b["job_id"], F.lit("")) != ""), "detail").when(board, "source").when(is_career_url(url), "source").otherwise("other")
    return F.struct(F.coalesce(b["platform"], F.lit("unknown")).alias("platform"), F.when(b.isNull(), "other").otherwise(kind).alias("kind"), b["token"].alias("token"), b["job_id"].alias("job_id"))


def source_id(platform: Column, token: Column, url: Column) -> Column:
    return F.concat_ws(":", platform, F.coalesce(F.nullif(token, F.lit("")), canonical(url), url))


def classified(results: DataFrame, method: str, platforms: list[str] | None = None) -> DataFrame:
    """``id, platform, kind, token, job_id, url, method`` of results ``url``: each source once, those of no use left out."""
    rows = results.select("url", candidate(F.col("url")).alias("c")).select("url", "c.*").where("kind <> 'other'")
    if platforms:
        rows = rows.where(F.col("platform").isin(platforms))
    named = rows.select(source_id(F.col("platform"), F.when(F.col("platform") != "company_page", F.col("token")), F.col("url")).alias("id"), "platform", "kind", "token", "job_id", "url", F.lit(method).alias("method"))
    return named.groupBy("id", "job_id").agg(F.min_by(F.struct("platform", "kind", "token", "url", "method"), "url").alias("s")).select("id", "s.platform", "s.kind", "s.token", "job_id", "s.url", "s.method")


def registry(spark: SparkSession, text: str | None) -> DataFrame:
    """``platform, token, company, url`` in the order of a registry's JSON array; anything but a sound array gives no rows."""
    entry = "platform:string,token:string,company:string,url:string"
    read = spark.createDataFrame([(text or "",)], "text string").select(F.from_json("text", f"array<struct<{entry}>>", {"mode": "PERMISSIVE"}).alias("rows"))
    rows = read.select(F.posexplode(F.when(F.forall("rows", lambda r: r["platform"].isNotNull()), F.col("rows"))).alias("n", "r"))
    return rows.select("n", "r.*")


def inventory_seeds(entries: DataFrame) -> DataFrame:
    """Inventory of ``origin, platform, token, company, url, n``: ids, URLs and ranks by origin; of one id the lowest rank stays."""
    key = F.concat_ws(":", "origin", "platform")
    offset = F.coalesce(*[F.when(key == k, v).otherwise(F.when(F.col("origin") == k, v)) for k, v in RANK_OFFSETS.items()], F.lit(0))
    base = F.coalesce(*[F.when(F.col("platform") == k, v) for k, v in BASES.items()])
    url = F.coalesce(F.col("url"), F.concat(base, F.col("token")))
    rows = entries.select(
        source_id(F.col("platform"), F.col("token"), url).alias("id"), "platform", "token", F.coalesce("company", slug_to_label(F.col("token"))).alias("company"), url.alias("url"), "origin", (offset + F.col("n")).cast("long").alias("inventory_rank")
    )
    return rows.groupBy("id").agg(F.min_by(F.struct("platform", "token", "company", "url", "origin", "inventory_rank"), "inventory_rank").alias("s")).select("id", "s.*")


def expanded(pages: DataFrame, identity: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``identity, id, platform, token, url``: boards that company pages link to."""
    links = P.anchors(pages, identity, html).join(pages.select(F.col(identity).alias("__id"), F.col(url).alias("page_url")), F.col(identity) == F.col("__id"))
    absolute = links.select(identity, P.resolve_url(F.col("href"), F.col("page_url")).alias("url"))
    rows = absolute.select(identity, "url", candidate(F.col("url")).alias("c")).where(~F.col("c.platform").isin("company_page", "unknown"))
    return rows.select(identity, source_id(F.col("c.platform"), F.col("c.token"), F.col("url")).alias("id"), "c.platform", "c.token", "url").dropDuplicates([identity, "id"])


def of_platforms(sources: DataFrame, platforms: list[str] | None) -> DataFrame:
    """Sources of the platforms asked for; none asked for takes all."""
    return sources.where(F.col("platform").isin(platforms)) if platforms else sources


def baseline(inventory: DataFrame, configured: DataFrame, curated: DataFrame, platforms: list[str] | None = None, primary: str = "greenhouse") -> DataFrame:
    """Inventory, configured and curated sources, each id once in that order; where the inventory has the primary platform, the others' sources of it are left out."""
    own = inventory.where(F.col("platform") == primary).select("platform").limit(1)
    others = configured.withColumn("__at", F.lit(1)).unionByName(curated.withColumn("__at", F.lit(2))).join(F.broadcast(own), "platform", "left_anti")  # one row
    every = inventory.withColumn("__at", F.lit(0)).unionByName(others.select(*inventory.columns, "__at"))
    first = every.groupBy("id").agg(F.min_by(F.struct(*inventory.columns), "__at").alias("s")).select("s.*")
    return of_platforms(first, platforms)


def supplemental(known: DataFrame, *found: DataFrame, platforms: list[str] | None = None) -> DataFrame:
    """Sources that were found and are not known, each id once, the earliest table first."""
    columns, every = known.columns, None
    for i, f in enumerate(found):
        part = f.select(columns).withColumn("__at", F.lit(i))
        every = part if every is None else every.unionByName(part)
    first = every.groupBy("id").agg(F.min_by(F.struct(*columns), "__at").alias("s")).select("s.*")
    return of_platforms(first.join(known.select("id"), "id", "left_anti").select(columns), platforms)


def query_plan(roles: DataFrame, places: DataFrame, hosts: DataFrame) -> DataFrame:
    """``platform, role, place, query, priority``: every role at every place on every host of a platform.

    The three sides are what one search asks for, a few rows each; hosts meet by a cross
    join of those few.
    """
    few = roles.crossJoin(places).crossJoin(hosts)
    text = F.concat_ws(" ", F.concat(F.lit("site:"), "host"), F.concat(F.lit('"'), "role", F.lit('"')), F.when(F.col("place") != "", F.concat(F.lit('"'), "place", F.lit('"'))))
    return few.select("platform", "role", "place", text.alias("query"), (F.col("role_at") * 100 + F.col("place_at")).alias("priority"))


def round_robin(queries: DataFrame, by: str, budget: int) -> DataFrame:
    """The first ``budget`` queries, one of each group in turn, groups in order of their first priority."""
    own = Window.partitionBy(by).orderBy("priority", "query")
    placed = queries.withColumn("__turn", F.row_number().over(own)).withColumn("__group", F.first(F.struct("priority", "query")).over(own))
    return placed.orderBy("__turn", "__group").limit(budget).drop("__turn", "__group")


def routed(sources: DataFrame, providers: DataFrame, tier: str | None = None) -> DataFrame:
    """Sources with the provider of their platform, of one tier or of all; a small equi-join."""
    chosen = providers.where(F.col("tier") == tier) if tier else providers
    return sources.join(chosen, "platform")


def merged_channels(hits: DataFrame, channel: str, identity: str, limit: int, *order: Column) -> DataFrame:
    """Hits of several channels in turn, each id once."""
    return interleave(hits, channel, identity, limit, *order)
