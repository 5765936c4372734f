"""Structured job records in pages and feeds: JSON-LD, embedded scripts, feeds of any shape.

A record is JSON text; its fields are read as VARIANT, and only text counts as text.
Objects at any depth are collected by the walk of ``pages``; what then makes a record a
job is one column expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.functions.dates import posted_at
from vacantia.functions.postings import salary, salary_interval
from vacantia.sources import pages as P

# Names under which records hold their fields, by precedence.
TITLE_KEYS = ["title", "name", "jobTitle", "postingTitle", "positionTitle"]
URL_KEYS = ["url", "jobUrl", "absoluteUrl", "applyUrl", "hostedUrl", "canonicalUrl", "detailsUrl", "jobPostingUrl", "jobPath", "relativePath", "path"]
APPLY_KEYS = ["applyUrl", "applicationUrl", "url", "jobUrl", "hostedUrl"]
PLACE_KEYS = ["location", "locationName", "locationText", "jobLocationText"]
LD_PLACE_KEYS = ["jobLocationText", "location", "locationText"]
ID_KEYS = ["id", "jobId", "slug", "requisitionId", "externalJobId"]
DATE_KEYS = ["postedAt", "datePosted", "publishedAt", "createdAt", "updatedAt", "listedAt"]
TEXT_KEYS = ["description", "descriptionPlain", "descriptionHtml", "jobDescription", "summary", "overview", "qualifications", "requirements"]
NO_PLACE = "Location unavailable"


def text_at(record: Column, path: str) -> Column:
    """Trimmed text at a path of a VARIANT; null for anything but text that is not blank."""
    there = F.try_variant_get(record, path, "variant")
    return F.when(F.schema_of_variant(there) == "STRING", F.nullif(F.trim(F.try_variant_get(record, path, "string")), F.lit("")))


def first_string(record: Column, keys: list[str], under: str = "$") -> Column:
    """The first text that is not blank among the keys."""
    return F.coalesce(*[text_at(record, f"{under}.{k}") for k in keys])


def _kind(record: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(record, path, "variant"))


def joined_place(*parts: Column) -> Column:
    """Parts that are not blank, with commas between."""
    return F.array_join(F.filter(F.array(*[F.trim(p) for p in parts]), lambda p: p.isNotNull() & (p != "")), ", ")


def ld_place(record: Column) -> Column:
    """Place of a JSON-LD posting: a text, else the address of its location (of the first of several), else none."""
    address = lambda at: joined_place(*[text_at(record, f"{at}.address.{k}") for k in ("addressLocality", "addressRegion", "addressCountry")])
    there = lambda at: F.try_variant_get(record, at, "variant").isNotNull()
    first = F.coalesce(first_string(record, LD_PLACE_KEYS, "$.jobLocation[0]"), F.when(there("$.jobLocation[0].jobLocation.address"), address("$.jobLocation[0].jobLocation")), F.lit(NO_PLACE))
    nested = F.when(_kind(record, "$.jobLocation").startswith("ARRAY") & there("$.jobLocation[0]"), first).when(there("$.jobLocation.address"), address("$.jobLocation"))
    return F.coalesce(first_string(record, LD_PLACE_KEYS), nested, F.lit(NO_PLACE))


def ld_company(record: Column, fallback: Column) -> Column:
    return F.coalesce(text_at(record, "$.hiringOrganization.name"), fallback)


def base_salary(record: Column, free_text: Column) -> Column:
    """Struct of amounts, currency, raw text and interval from ``baseSalary``, else from the first range in the text."""
    at = "$.baseSalary"
    number = lambda *paths: F.coalesce(*[F.try_variant_get(record, f"{at}{p}", "double") for p in paths])
    nested = _kind(record, f"{at}.value").startswith("OBJECT")
    low = F.when(nested, number(".value.minValue", ".value.value")).otherwise(number(".minValue", ".value"))
    high = F.when(nested, number(".value.maxValue", ".value.value")).otherwise(number(".maxValue", ".value"))
    currency = F.coalesce(text_at(record, f"{at}.currency"), text_at(record, f"{at}.currencyCode"))
    raw = F.coalesce(text_at(record, f"{at}.value"), text_at(record, f"{at}.text"))
    unit = F.coalesce(*[F.when(nested, text_at(record, f"{at}.value.{k}")).otherwise(text_at(record, f"{at}.{k}")) for k in ("unitText", "interval")])
    said = salary(free_text)
    stated = F.struct(low.alias("min_amount"), high.alias("max_amount"), currency.alias("currency"), raw.alias("raw_text"), F.coalesce(salary_interval(unit), F.lit("unknown")).alias("interval"))
    spoken = F.struct(said["min_amount"].alias("min_amount"), said["max_amount"].alias("max_amount"), F.lit(None).cast("string").alias("currency"), said["raw_text"].alias("raw_text"), said["interval"].alias("interval"))
    some = low.isNotNull() | high.isNotNull() | currency.isNotNull() | raw.isNotNull()
    return F.when(_kind(record, at).startswith("OBJECT") & some, stated).when(said.isNotNull(), spoken)


def job_url(record: Column, keys: list[str] = URL_KEYS) -> Column:
    """The first text among the keys that looks like a URL or a path, not yet resolved."""
    fits = lambda t: F.when(t.contains("/") | t.startswith("http"), t)
    return F.coalesce(*[fits(text_at(record, f"$.{k}")) for k in keys])


def record_place(record: Column) -> Column:
    """Place of a record: a text, a JSON-LD location, the names in nested locations or offices, or its parts."""
    def nested(at: str) -> Column:
        parts = joined_place(*[first_string(record, keys, at) for keys in (["city", "addressLocality", "locality"], ["state", "region", "addressRegion", "administrativeArea"], ["country", "addressCountry", "countryCode"])])
        return F.coalesce(text_at(record, at), first_string(record, ["name", "displayName", "title", "location", "locationText"], at), F.nullif(parts, F.lit("")))

    several = lambda at: F.nullif(F.array_join(F.array_compact(F.array(*[nested(f"{at}[{i}]") for i in range(3)])), "; "), F.lit(""))
    ld = F.when(F.try_variant_get(record, "$.jobLocation", "variant").isNotNull(), ld_place(record))
    flat = joined_place(first_string(record, ["city", "addressLocality"]), first_string(record, ["state", "region", "addressRegion"]), first_string(record, ["country", "addressCountry"]))
    return F.coalesce(first_string(record, PLACE_KEYS), ld, *[x for at in ("$.location", "$.locations", "$.office", "$.offices") for x in (nested(at), several(at))], F.nullif(flat, F.lit("")), F.lit(NO_PLACE))


def record_id(record: Column) -> Column:
    """Id of a record: a text, an identifier of any shape, or a number."""
    number = lambda at: F.when(_kind(record, at).isin("BIGINT") | _kind(record, at).startswith("DECIMAL"), F.try_variant_get(record, at, "string"))
    return F.coalesce(
        first_string(record, ID_KEYS), number("$.identifier"), text_at(record, "$.identifier"), first_string(record, ["value", "name", "id"], "$.identifier"),
        text_at(record, "$.identifier['@id']"), *[number(f"$.{k}") for k in ("id", "jobId", "requisitionId")],
    )


def jobs_of(records: DataFrame, identity: str, strict: bool) -> DataFrame:
    """Jobs of ``identity, n, page_url, company, record`` (JSON text): those with a title and a URL; ``strict``: that also look like a job's."""
    v = F.try_parse_json("record")
    read = records.select(identity, "n", "page_url", "company", v.alias("v")).where(F.col("v").isNotNull())
    r = F.col("v")
    rows = read.select(identity, "n", "page_url", "company", "v", first_string(r, TITLE_KEYS).alias("title"), P.resolve_url(job_url(r), F.col("page_url")).alias("source_url"), P.resolve_url(job_url(r, APPLY_KEYS), F.col("page_url")).alias("applied"))
    rows = rows.where(F.col("title").isNotNull() & F.col("source_url").isNotNull())
    if strict:
        rows = rows.where(P.looks_like_title(F.col("title")) & P.likely_job_url(F.col("source_url"), F.col("page_url")))
    company = F.coalesce(first_string(r, ["company", "companyName", "hiringOrganizationName"]), ld_company(r, F.col("company")))
    posted = posted_at(F.coalesce(*[F.try_variant_get(r, f"$.{k}", "string") for k in DATE_KEYS]))
    return rows.select(
        identity, "n", "title", company.alias("company"), record_place(r).alias("location"), F.coalesce(record_id(r), F.concat_ws("-", "company", F.col("n").cast("string"))).alias("source_job_id"),
        "source_url", F.coalesce("applied", "source_url").alias("apply_url"), posted.alias("posted_at"), first_string(r, TEXT_KEYS).alias("description"), base_salary(r, first_string(r, TEXT_KEYS)).alias("salary"),
    )


def embedded_jobs(pages: DataFrame, identity: str = "page_id", url: str = "url", html: str = "html", company: str = "company") -> DataFrame:
    """Jobs among all objects in a page's JSON scripts."""
    bodies = pages.select(identity, F.col(url).alias("page_url"), F.col(company).alias("company"), F.explode(P.scripts(F.col(html), P.ANY_JSON)).alias("body"))
    collect = P.deep_collect(lambda o: any(isinstance(o.get(k), str) for k in TITLE_KEYS) and any(isinstance(o.get(k), str) for k in URL_KEYS))
    found = bodies.select(identity, "page_url", "company", F.posexplode(collect("body")).alias("n", "record"))
    return P.first_per_source(jobs_of(found, identity, strict=True), identity)


def feed_jobs(feeds: DataFrame, identity: str, url: str, body: str, company: str) -> DataFrame:
    """Jobs of a feed: the array's own objects, else all job-like objects at any depth."""
    rows = feeds.select(identity, F.col(url).alias("page_url"), F.col(company).alias("company"), F.col(body).alias("body"))
    collect = P.deep_collect(lambda o: any(isinstance(o.get(k), str) for k in TITLE_KEYS) and any(isinstance(o.get(k), str) for k in URL_KEYS))
    top = F.from_json("body", "array<string>")
    array = F.ltrim("body").startswith("[")
    found = rows.select(identity, "page_url", "company", F.posexplode(F.when(array, top).otherwise(collect("body"))).alias("n", "record"))
    return P.first_per_source(jobs_of(found, identity, strict=True), identity)


def ld_jobs(pages: DataFrame, identity: str = "page_id", url: str = "url", html: str = "html", company: str = "company") -> DataFrame:
    """Jobs among the JSON-LD postings of pages; titles and URLs may miss."""
    found = P.job_postings(pages, identity, html).withColumn("v", F.try_parse_json("posting"))
    base = pages.select(F.col(identity).alias("__id"), F.col(url).alias("page_url"), F.col(company).alias("company"))
    r = F.col("v")
    rows = found.join(base, F.col(identity) == F.col("__id"))
    return rows.select(
        identity, F.coalesce(first_string(r, ["title", "name"]), F.lit("")).alias("title"), ld_company(r, F.col("company")).alias("company"), ld_place(r).alias("location"), record_id(r).alias("source_job_id"),
        F.coalesce(P.resolve_url(text_at(r, "$.url"), F.col("page_url")), F.lit("")).alias("source_url"), posted_at(F.coalesce(*[F.try_variant_get(r, f"$.{k}", "string") for k in ("datePosted", "validFrom")])).alias("posted_at"),
        text_at(r, "$.employmentType").alias("employment"), first_string(r, ["level", "experienceLevel", "seniority", "careerLevel"]).alias("seniority"), first_string(r, ["description", "summary"]).alias("description"),
        base_salary(r, first_string(r, ["description", "summary"])).alias("salary"),
    )
