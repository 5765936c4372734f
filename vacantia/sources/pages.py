"""Parsers of landed web pages and board payloads.

Scripts are cut out with built-in regular expressions and parsed as VARIANT; only the
brace-balanced object behind a marker, which is no regular language, and the walk
through nested JSON use small Arrow functions.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacantia.functions.text import comparable, decode_entities, strip_html
from vacantia.functions.urls import host, is_http

LD_JSON = r"""(?is)<script[^>]+type=["']application/ld\+json["'][^>]*>(.*?)</script>"""
ANY_JSON = r"""(?is)<script[^>]+type=["']application/(?:json|[^"']+\+json)["'][^>]*>(.*?)</script>"""
NEXT_DATA = r"""(?is)<script[^>]+id=["']__NEXT_DATA__["'][^>]*>(.*?)</script>"""
ANCHOR = r"""(?is)<a\b[^>]*\bhref=["']([^"'#][^"']*)["'][^>]*>(.*?)</a>"""
LINK = r"""(?is)<a\b([^>]*?)href=["']([^"']+)["']([^>]*)>(.*?)</a>"""
CONTEXT = 240
# What job titles, places, job URLs and job hosts are like, and what titles are not.
TITLE_YES = r"(?i)\b(engineer|developer|designer|manager|scientist|analyst|architect|administrator|product|marketing|sales|support|security|recruit(?:er|ing)?|operations?|finance|account(?:ant| executive|ing)?|specialist|consultant|director|lead|qa|quality|data|platform|devops|intern|graduate|technician|writer|editor|counsel|officer|coordinator|partner|attorney|researcher|swe)\b"
TITLE_NO = r"(?i)\b(view all jobs?|all jobs?|open roles?|search jobs?|learn more|join our team|life at|benefits|culture|our values|candidate privacy|equal opportunity|read more|meet the team|our offices?|locations?|departments?)\b"
PLACE_YES = r"(?i)\b(remote|hybrid|on site|onsite|united states|usa|us|canada|united kingdom|uk)\b"
JOB_PATH = r"(?i)\b(job|jobs|career|careers|opening|openings|position|positions|role|roles|requisition|posting|opportunit|vacanc)\b"
JOB_HOST = r"(?i)(greenhouse|lever|ashbyhq|myworkdayjobs|smartrecruiters|jobvite|bamboohr|workable|recruitee|icims|dayforce|paylocity|oraclecloud|successfactors|adp)"
BREAKS = r"(?i)<(br|/p|/div|/li|/span|/section|/article|/h[1-6]|/td|/tr)[^>]*>"


def scripts(html: Column, pattern: str) -> Column:
    """Bodies of the scripts that fit; an empty array for none."""
    return F.coalesce(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)), F.array().cast("array<string>"))


def next_data(html: Column) -> Column:
    """The page's __NEXT_DATA__ as VARIANT; null if there is none or it is no JSON."""
    body = F.regexp_extract(html, NEXT_DATA, 1)
    return F.try_parse_json(F.when(body != "", body))


def json_payloads(pages: DataFrame, identity: str, html: str, pattern: str = ANY_JSON) -> DataFrame:
    """``identity, n, payload``: every script body that is JSON."""
    return (
        pages.select(identity, F.posexplode(scripts(F.col(html), pattern)).alias("n", "body"))
        .select(identity, "n", F.try_parse_json("body").alias("payload")).where(F.col("payload").isNotNull())
    )


def walk(value, keep: Callable[[dict], bool]) -> Iterator[dict]:
    """Every object in a JSON value that ``keep`` takes, outermost first."""
    if isinstance(value, list):
        for v in value:
            yield from walk(v, keep)
    elif isinstance(value, dict):
        if keep(value):
            yield value
        for v in value.values():
            yield from walk(v, keep)


def deep_collect(keep: Callable[[dict], bool]):
    """Column function: JSON texts to the JSON texts of the objects in them that ``keep`` takes."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(bodies: pd.Series) -> pd.Series:
        def one(body):
            try:
                return [json.dumps(o, ensure_ascii=False) for o in walk(json.loads(body), keep)] if body else []
            except ValueError:
                return []

        return bodies.map(one)

    return run


def deep_find(key: str):
    """Column function: JSON texts to the first object under ``key``, depth first."""

    @F.pandas_udf(T.StringType())
    def run(bodies: pd.Series) -> pd.Series:
        def one(body):
            try:
                found = next((o[key] for o in walk(json.loads(body), lambda o: isinstance(o.get(key), dict))), None) if body else None
            except ValueError:
                return None
            return json.dumps(found, ensure_ascii=False) if found is not None else None

        return bodies.map(one)

    return run


def job_postings(pages: DataFrame, identity: str = "page_id", html: str = "html") -> DataFrame:
    """``identity, posting``: the JSON-LD JobPosting objects of each page, at any depth."""
    collect = deep_collect(lambda o: o.get("@type") == "JobPosting")
    bodies = pages.select(identity, F.explode(scripts(F.col(html), LD_JSON)).alias("body")).where(F.col("body").contains("JobPosting"))
    return bodies.select(identity, F.explode(collect("body")).alias("posting"))


def window_object(marker: str):
    """Column function: the JSON object that follows ``marker``; null if what begins there is no object."""

    def cut(html: str | None) -> str | None:
        start = html.find("{", html.find(marker)) if html and marker in html else -1
        if start < 0:
            return None
        try:
            return html[start : json.JSONDecoder().raw_decode(html, start)[1]]
        except ValueError:
            return None

    @F.pandas_udf(T.StringType())
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(cut)

    return run


@F.pandas_udf(T.StringType())
def resolve_url(links: pd.Series, bases: pd.Series) -> pd.Series:
    """Links made absolute; null for blanks."""
    return pd.Series([urljoin(b or "", x.strip()) if isinstance(x, str) and x.strip() else None for x, b in zip(links, bases)])


def anchors(pages: DataFrame, identity: str, html: str) -> DataFrame:
    """``identity, n, href, label``: links in order with their texts."""
    found = F.arrays_zip(F.regexp_extract_all(F.col(html), F.lit(ANCHOR), F.lit(1)).alias("href"), F.regexp_extract_all(F.col(html), F.lit(ANCHOR), F.lit(2)).alias("label"))
    return pages.select(identity, F.posexplode(found).alias("n", "a")).select(identity, "n", "a.href", strip_html(F.col("a.label")).alias("label"))


def looks_like_title(value: Column) -> Column:
    """4 to 120 characters, 1 to 12 words, a word of a role and none of a site's furniture."""
    cleaned = F.regexp_replace(F.trim(F.coalesce(value, F.lit(""))), r"\s+", " ")
    normal = comparable(cleaned)
    words = F.size(F.filter(F.split(normal, " "), lambda w: w != ""))
    return F.length(cleaned).between(4, 120) & words.between(1, 12) & ~normal.rlike(TITLE_NO) & normal.rlike(TITLE_YES)


def looks_like_place(value: Column) -> Column:
    """At most 80 characters and a known word of place; or no role's word, and a comma."""
    cleaned = F.regexp_replace(F.trim(F.coalesce(value, F.lit(""))), r"\s+", " ")
    normal = comparable(cleaned)
    return (F.length(cleaned) <= 80) & (normal != "") & (normal.rlike(PLACE_YES) | (~normal.rlike(TITLE_YES) & cleaned.contains(",")))


def likely_job_url(url: Column, page_url: Column) -> Column:
    """An http URL on the page's own host, on a known host of jobs, or with a word of jobs in host, path or query."""
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^#]*)", 1)
    return is_http(url) & (F.coalesce(host(url) == host(page_url), F.lit(False)) | F.coalesce(host(url).rlike(JOB_HOST), F.lit(False)) | rest.rlike(JOB_PATH))


def distinct_comparable(values: Column) -> Column:
    """Trimmed texts in order, of those that are comparably equal the first; blanks go."""
    kept = F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v.isNotNull() & (comparable(v) != ""))
    keys = F.transform(kept, comparable)
    return F.filter(kept, lambda v, i: F.array_position(keys, comparable(v)) == i + 1)


def segments_of(fragment: Column) -> Column:
    """Texts of a piece of HTML, cut at block ends, bars, bullets and dashes between blanks."""
    apart = F.regexp_replace(F.regexp_replace(fragment, "><", ">\n<"), BREAKS, "\n")
    text = F.regexp_replace(decode_entities(F.regexp_replace(apart, "<[^>]+>", " ")), "[ \\t]{2,}", " ")
    return distinct_comparable(F.split(F.regexp_replace(text, r"\s*[|\u2022]\s*|[^\S\n]+[-\u2013\u2014][^\S\n]+", "\n"), r"\s*\n\s*"))


def _attribute(attributes: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(attributes, rf"""(?i)\b{name}=["']([^"']*)["']""", 1), F.lit(""))


def anchor_jobs(pages: DataFrame, identity: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``identity, n, title, location, source_url, job_id``: links that lead to jobs, named by their texts or by what stands around them.

    The surroundings are CONTEXT characters on both sides; they are cut out by splitting
    the page at its links, so no position is searched for twice.
    """
    whole = F.regexp_extract_all(F.col(html), F.lit(LINK), F.lit(0))
    between = F.split(F.regexp_replace(F.col(html), LINK, "\u0001"), "\u0001", -1)
    part = lambda i: F.regexp_extract_all(F.col(html), F.lit(LINK), F.lit(i))
    links = F.arrays_zip(whole.alias("whole"), part(1).alias("before"), part(2).alias("href"), part(3).alias("after"), part(4).alias("inner"))
    rows = pages.select(identity, F.col(url).alias("page_url"), between.alias("between"), F.posexplode(links).alias("n", "a"))
    left, right = F.col("between")[F.col("n")], F.col("between")[F.col("n") + 1]
    near = F.concat(F.expr(f"right(__left, {CONTEXT})"), F.col("a.whole"), F.expr(f"left(__right, {CONTEXT})"))
    rows = rows.withColumn("__left", left).withColumn("__right", right).select(identity, "n", "a", "page_url", near.alias("near"), resolve_url(F.col("a.href"), F.col("page_url")).alias("source_url"))
    rows = rows.where(likely_job_url(F.col("source_url"), F.col("page_url")))
    attributes = F.concat_ws(" ", "a.before", "a.after")
    said = distinct_comparable(F.concat(segments_of(F.col("a.inner")), F.array(_attribute(attributes, "aria-label"), _attribute(attributes, "title")), segments_of(F.col("near"))))
    rows = rows.withColumn("said", said)
    title = F.try_element_at(F.filter("said", looks_like_title), F.lit(1))
    rows = rows.withColumn("title", title).where(F.col("title").isNotNull())
    place = F.try_element_at(F.filter("said", lambda x: (x != F.col("title")) & looks_like_place(x)), F.lit(1))
    key = comparable(F.regexp_replace(F.regexp_extract(F.col("source_url"), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "/+$", ""))
    return rows.select(identity, "n", "title", F.coalesce(place, F.lit("Location unavailable")).alias("location"), "source_url", F.when(key != "", key).otherwise(F.col("n").cast("string")).alias("job_id"))


def workday_links(pages: DataFrame, identity: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``identity, title, source_url, source_job_id``: links of a hosted page whose path holds a job, each once; the id ends the path."""
    links = anchors(pages, identity, html).where(F.col("href").contains("/job/"))
    met = links.join(pages.select(F.col(identity).alias("__id"), F.col(url).alias("page_url")), F.col(identity) == F.col("__id"))
    absolute = met.select(identity, "n", F.col("label").alias("title"), F.regexp_replace(resolve_url(F.col("href"), F.col("page_url")), "[?#].*$", "").alias("source_url"))
    job_id = F.element_at(F.split("source_url", "[/_]"), -1)
    return first_per_source(absolute.where(F.col("title") != ""), identity).select(identity, "title", "source_url", job_id.alias("source_job_id"))


def first_per_source(jobs: DataFrame, identity: str = "page_id", order: str = "n") -> DataFrame:
    """Of a page's jobs with one canonical URL, else one source URL, else one company, title and place, the first."""
    c = lambda n: F.nullif(F.col(n), F.lit("")) if n in jobs.columns else F.lit(None).cast("string")
    shared = F.concat_ws("|", *[comparable(F.coalesce(c(n), F.lit(""))) for n in ("company", "title", "location")])
    keyed = jobs.withColumn("__key", F.coalesce(c("canonical_url"), c("source_url"), shared))
    return keyed.groupBy(identity, "__key").agg(F.min_by(F.struct(*jobs.columns), order).alias("j")).select("j.*")


def link_status(head_status: Column, get_status: Column, body: Column, url_ok: Column) -> Column:
    """Status of a posting's link from landed responses: malformed or gone, refused, closed by its text, valid."""
    # What a closed posting says.
    markers = ["job no longer available", "this job is no longer available", "position has been filled", "position closed", "role has been closed", "no longer accepting applications", "job expired"]
    low = F.lower(F.coalesce(body, F.lit("")))
    closed = F.exists(F.array(*map(F.lit, markers)), lambda m: F.contains(low, m))
    return (
        F.when(~url_ok, "invalid").when(head_status.isin(404, 410), "invalid").when(get_status.between(400, 499), "invalid")
        .when(get_status.isNull() | (get_status >= 500), "unknown").when(closed, "stale").otherwise("valid")
    )
