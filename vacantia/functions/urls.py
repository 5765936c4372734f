"""URLs: validity, canonical form, hashes, and the grammars of hosted job boards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vacantia.functions.text import comparable


def is_http(url: Column) -> Column:
    """Whether a text is an absolute http or https URL."""
    return F.coalesce(F.trim(url).rlike(r"(?i)^https?://[^\s/?#]+([/?#].*)?$"), F.lit(False))


def host(url: Column) -> Column:
    """Host in lower case, without port; null if there is none."""
    found = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(found != "", found)


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def segments(url: Column) -> Column:
    """Parts of the path, without empty ones."""
    return F.filter(F.split(path(url), "/"), lambda p: p != "")


def canonical(url: Column) -> Column:
    """Without query, fragment and trailing slashes; scheme and host in lower case; null if it is no URL."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    authority = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    trimmed = F.regexp_replace(path(url), "/+$", "")
    return F.when(is_http(url), F.concat(scheme, F.lit("://"), authority, F.when(trimmed == "", "/").otherwise(trimmed)))


def url_hash(value: Column) -> Column:
    """The 32-bit multiply-by-33 hash of the comparable text, in base 36; null if that is empty."""
    normal = comparable(value)
    codes = F.transform(F.filter(F.split(normal, ""), lambda c: c != ""), F.ascii)
    total = F.aggregate(codes, F.lit(5381).cast("long"), lambda h, c: (h * 33 + c) % (1 << 32))
    return F.when(normal != "", F.lower(F.conv(total.cast("string"), 10, 36)))


def content_fingerprint(company: Column, title: Column, location: Column) -> Column:
    """SHA-256 of the three comparable texts between bars."""
    return F.sha2(F.concat_ws("|", comparable(company), comparable(title), comparable(location)), 256)


def _query(url: Column, key: str) -> Column:
    found = F.regexp_extract(url, rf"[?&]{key}=([^&#]*)", 1)
    return F.when(found != "", found)


def classify(url: Column) -> Column:
    """Struct of platform, token and job id of a board URL; platform ``company_page`` for any other http URL, null if it is none.

    greenhouse: ``boards.greenhouse.io/TOKEN/jobs/ID`` and its API and embed forms; lever:
    ``jobs.lever.co/TOKEN/ID``; ashby: ``jobs.ashbyhq.com/TOKEN/ID``; smartrecruiters:
    ``{jobs,careers}.smartrecruiters.com/TOKEN/ID``; workday: ``TENANT.wdN.myworkdayjobs.com/[locale/]SITE/job/...``.
    """
    h, s = host(url), segments(url)
    at = lambda i: F.lower(F.try_element_at(s, F.lit(i)))
    raw = lambda i: F.try_element_at(s, F.lit(i))
    locale = raw(1).rlike("^[a-z]{2}-[A-Z]{2}$")
    api = at(1) == "v1"
    none = F.lit(None).cast("string")

    def board(platform: str, token: Column, job: Column) -> Column:
        return F.struct(F.lit(platform).alias("platform"), token.alias("token"), job.alias("job_id"))

    greenhouse = F.when(at(1) == "embed", _query(url, "for")).when(api & (at(2) == "boards"), at(3)).otherwise(at(1))
    greenhouse_job = F.coalesce(_query(url, "gh_jid"), _query(url, "token"), F.when(api, F.when(at(4) == "jobs", raw(5))).otherwise(F.when(at(2) == "jobs", raw(3))))
    lever_api = (at(1) == "v0") & (at(2) == "postings")
    return (
        F.when(~is_http(url), F.lit(None))
        .when(h.rlike(r"(^|\.)greenhouse\.io$") & greenhouse.isNotNull(), board("greenhouse", greenhouse, greenhouse_job))
        .when(h.isin("jobs.lever.co", "jobs.eu.lever.co", "api.lever.co", "api.eu.lever.co") & at(1).isNotNull(), board("lever", F.when(lever_api, at(3)).otherwise(at(1)), F.when(lever_api, raw(4)).otherwise(raw(2))))
        .when((h == "jobs.ashbyhq.com") & at(1).isNotNull(), board("ashby", at(1), raw(2)))
        .when(h.rlike(r"(^|\.)smartrecruiters\.com$") & at(1).isNotNull(), F.when((h == "api.smartrecruiters.com") & (at(2) == "companies"), board("smartrecruiters", at(3), raw(5))).otherwise(board("smartrecruiters", at(1), F.regexp_extract(raw(2), r"^(\d+)", 1))))
        .when(h.rlike(r"\.myworkday(jobs|site)\.com$"), board("workday", F.concat_ws("/", F.regexp_extract(h, r"^([^.]+)", 1), F.when(locale, at(2)).otherwise(at(1))), F.when(url.contains("/job/"), F.element_at(s, -1))))
        .otherwise(board("company_page", h, none))
    )
