"""Landed payloads of hosted job boards to one table of postings.

Every parser takes ``payload`` (JSON text) with its board's ``token`` and gives the same
columns; schemas name only the fields that are read, so the rest is never parsed.  Two
boards may answer with a page instead, told by its first ``<``: the postings are then read
from the object in its scripts (ashby) or from its links (workday).  A payload that is
null, empty or neither gives no posting.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.functions import dates
from vacantia.functions.experience import classify
from vacantia.functions.postings import drop_reason, employment_type, remote_type, salary
from vacantia.functions.sponsorship import ingest_hint
from vacantia.functions.text import comparable, slug_to_label, snippet, strip_html
from vacantia.functions.urls import canonical, content_fingerprint
from vacantia.sources import payloads
from vacantia.sources.pages import anchors, window_object

COLUMNS = ["platform", "token", "source_job_id", "title", "company", "location", "source_url", "apply_url", "posted_at", "description", "department", "employment"]


def _records(listed: Column, schema: str) -> Column:
    """Records of a JSON array; null for what is no array, such as the object that a board answers with in error."""
    return F.filter(F.from_json(F.when(F.ltrim(listed).startswith("["), listed), schema), lambda j: j.isNotNull())


def _rows(raw: DataFrame, schema: str, platform: str, **fields: Column) -> DataFrame:
    parsed = raw.select("token", F.explode(_records(F.col("payload"), schema)).alias("j"))
    none = F.lit(None).cast("string")
    given = {c: fields.get(c, none) for c in COLUMNS} | {"platform": F.lit(platform), "token": F.col("token")}
    given["company"] = F.coalesce(F.nullif(F.trim(given["company"]), F.lit("")), slug_to_label(F.col("token")))
    given["apply_url"] = F.coalesce(given["apply_url"], given["source_url"])
    return parsed.select(*[given[c].alias(c) for c in COLUMNS])


def greenhouse(raw: DataFrame) -> DataFrame:
    """Payload: ``{"jobs": [...]}``."""
    inner = raw.withColumn("payload", F.get_json_object("payload", "$.jobs"))
    j = F.col("j")
    offices = F.array_join(F.transform(j["offices"], lambda o: o["name"]), "; ")
    return _rows(
        inner, "array<struct<id:string,title:string,absolute_url:string,updated_at:string,first_published:string,company_name:string,content:string,location:struct<name:string>,offices:array<struct<name:string>>,departments:array<struct<name:string>>>>",
        "greenhouse", source_job_id=j["id"], title=F.trim(j["title"]), company=j["company_name"], location=F.coalesce(F.nullif(F.trim(j["location"]["name"]), F.lit("")), F.nullif(offices, F.lit(""))),
        source_url=j["absolute_url"], posted_at=dates.posted_at(F.coalesce(j["first_published"], j["updated_at"])), description=strip_html(strip_html(j["content"])), department=F.try_element_at(j["departments"], F.lit(1))["name"],
    )


def lever(raw: DataFrame) -> DataFrame:
    """Payload: an array; all locations are kept."""
    j = F.col("j")
    places = F.array_distinct(F.concat(F.array_compact(F.array(j["categories"]["location"])), F.coalesce(j["categories"]["allLocations"], F.array().cast("array<string>"))))
    return _rows(
        raw, "array<struct<id:string,text:string,hostedUrl:string,applyUrl:string,createdAt:string,descriptionPlain:string,categories:struct<location:string,allLocations:array<string>,team:string,commitment:string>>>",
        "lever", source_job_id=j["id"], title=F.trim(j["text"]), location=F.array_join(places, "; "), source_url=j["hostedUrl"], apply_url=j["applyUrl"], posted_at=dates.posted_at(j["createdAt"]),
        description=j["descriptionPlain"], department=j["categories"]["team"], employment=j["categories"]["commitment"],
    )


def _is_page(payload: Column) -> Column:
    return F.ltrim(payload).startswith("<")


def ashby(raw: DataFrame) -> DataFrame:
    """Payload: ``{"jobs": [...]}``, or a page with ``window.__appData``."""
    j = F.col("j")
    in_page = F.get_json_object(window_object("window.__appData")(F.when(_is_page(F.col("payload")), F.col("payload"))), "$.jobBoard.jobPostings")
    return _rows(
        raw.withColumn("payload", F.coalesce(in_page, F.get_json_object("payload", "$.jobs"))),
        "array<struct<id:string,title:string,location:string,locationName:string,jobUrl:string,applyUrl:string,publishedAt:string,publishedDate:string,descriptionPlain:string,department:string,departmentName:string,employmentType:string>>",
        "ashby", source_job_id=j["id"], title=F.trim(j["title"]), location=F.coalesce(j["location"], j["locationName"]), source_url=F.coalesce(j["jobUrl"], F.concat(F.lit("https://jobs.ashbyhq.com/"), F.col("token"), F.lit("/"), j["id"])), apply_url=j["applyUrl"],
        posted_at=dates.posted_at(F.coalesce(j["publishedAt"], j["publishedDate"])), description=j["descriptionPlain"], department=F.coalesce(j["department"], j["departmentName"]), employment=F.regexp_replace(j["employmentType"], "([a-z])([A-Z])", "$1 $2"),
    )


def smartrecruiters(raw: DataFrame) -> DataFrame:
    """Payload: ``{"content": [...]}``."""
    j = F.col("j")
    place = F.array_join(F.array_compact(F.array(j["location"]["city"], j["location"]["region"], j["location"]["country"])), ", ")
    return _rows(
        raw.withColumn("payload", F.get_json_object("payload", "$.content")), "array<struct<id:string,name:string,ref:string,releasedDate:string,location:struct<city:string,region:string,country:string>,company:struct<name:string>,department:struct<label:string>,typeOfEmployment:struct<label:string>>>",
        "smartrecruiters", source_job_id=j["id"], title=F.trim(j["name"]), company=j["company"]["name"], location=place, source_url=F.concat(F.lit("https://jobs.smartrecruiters.com/"), F.col("token"), F.lit("/"), j["id"]),
        posted_at=dates.posted_at(j["releasedDate"]), department=j["department"]["label"], employment=j["typeOfEmployment"]["label"],
    )


def workday(raw: DataFrame) -> DataFrame:
    """Payload: ``{"jobPostings": [...]}``, or a page whose links hold jobs; the board's ``base_url`` is in the raw table.

    Of a board's links to one job the first counts; links that are neither absolute nor from the host's root are none.
    """
    j = F.col("j")
    none = F.lit(None).cast("string")

    def rows(of: DataFrame, job_id: Column, title: Column, location: Column, url: Column, posted_at: Column) -> DataFrame:
        company = slug_to_label(F.substring_index("token", "/", 1))
        given = [F.lit("workday"), F.col("token"), job_id, title, company, location, url, url, posted_at, none, none, none]
        return of.select(*[v.alias(c) for v, c in zip(given, COLUMNS)])

    schema = "array<struct<title:string,externalPath:string,locationsText:string,postedOn:string,bulletFields:array<string>>>"
    listed = raw.select("token", "base_url", F.explode(_records(F.get_json_object("payload", "$.jobPostings"), schema)).alias("j"))
    path_end = F.element_at(F.split(j["externalPath"], "/"), -1)
    told = rows(listed, F.coalesce(F.try_element_at(j["bulletFields"], F.lit(1)), path_end), F.trim(j["title"]), j["locationsText"], F.concat("base_url", j["externalPath"]), dates.posted_at(j["postedOn"]))

    pages = raw.where(_is_page(F.col("payload"))).select(F.struct("token", "base_url").alias("board"), "payload")
    root = F.regexp_extract("board.base_url", "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0)
    href = F.trim("href")
    url = F.regexp_replace(F.when(href.rlike("^https?://"), href).when(href.startswith("/") & (root != ""), F.concat(root, href)), "[?#].*$", "")
    links = anchors(pages, "board", "payload").where(F.col("href").contains("/job/")).select("board.token", "n", F.col("label").alias("title"), url.alias("url"))
    first = links.where("url is not null and title <> ''").groupBy("token", "url").agg(F.min(F.struct("n", "title"))["title"].alias("title"))
    return told.unionByName(rows(first, F.element_at(F.split("url", "[/_]"), -1), F.col("title"), none, F.col("url"), none.cast("timestamp")))


PARSERS = {"greenhouse": greenhouse, "lever": lever, "ashby": ashby, "smartrecruiters": smartrecruiters, "workday": workday}


def parsed(answers: Callable[[str], DataFrame], platforms: Iterable[str] = PARSERS) -> DataFrame:
    """Postings of several platforms under one schema; ``answers`` gives a platform's ``token, base_url, payload``."""
    return reduce(DataFrame.unionByName, [PARSERS[p](answers(p).select("token", "base_url", "payload")) for p in platforms])


def postings(raw: DataFrame) -> DataFrame:
    """All platforms of a raw table ``platform, token, payload`` and perhaps ``base_url``."""
    if "base_url" not in raw.columns:
        raw = raw.withColumn("base_url", F.lit(None).cast("string"))
    return parsed(lambda p: raw.where(F.col("platform") == p))


def landed_postings(spark: SparkSession, folder: str, first_day: str | None = None, last_day: str | None = None) -> DataFrame:
    """Postings of the answers that ``payloads.land`` has put into a folder; each platform's files are opened once, by its own parser."""
    return parsed(lambda p: payloads.landed(spark, folder, [p], first_day, last_day))


def normalize(jobs: DataFrame) -> DataFrame:
    """Add what is derived from a posting, and ``drop_reason`` for those that are not sound."""
    c = F.col
    level = classify(c("title"), description=c("description"))
    return jobs.select(
        "*", comparable(c("title")).alias("title_key"), comparable(c("company")).alias("company_key"), comparable(c("location")).alias("location_key"),
        canonical(c("source_url")).alias("canonical_url"), content_fingerprint(c("company"), c("title"), c("location")).alias("fingerprint"),
        remote_type(c("location"), F.lit(False), F.lit(None).cast("string")).alias("remote_type"), employment_type(c("employment")).alias("employment_type"), salary(c("description")).alias("salary"),
        ingest_hint(c("description")).alias("sponsorship_hint"), level.alias("experience"), snippet(c("description")).alias("snippet"),
        drop_reason(c("title"), c("company"), c("source_job_id"), c("source_url"), c("apply_url"), c("location"), c("platform")).alias("drop_reason"),
    )
