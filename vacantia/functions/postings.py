"""Fields of a posting: workplace, employment, salary, quality gate, tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vacantia.functions.rules import first_match
from vacantia.functions.text import comparable
from vacantia.functions.urls import is_http

# Employment types, in this order; "temporary" needs no word border before "temp" at an end only.
EMPLOYMENT = [
    ("full_time", r"\bfull ?time\b"), ("part_time", r"\bpart ?time\b"), ("contract", r"\b(?:contract|contractor|consultant)\b"), ("temporary", r"\btemporary|temp\b"),
    ("internship", r"\b(?:intern|internship)\b"), ("apprenticeship", r"\b(?:apprentice|apprenticeship)\b"), ("seasonal", r"\bseasonal\b"), ("freelance", r"\b(?:freelance|freelancer)\b"),
]
INTERVALS = [("hour", "hour"), ("day", "day"), ("week", "week"), ("month", "month"), ("year", "year|yr|annual")]
SALARY = r"(?i)\$?\s?(\d[\d,]*(?:\.\d+)?)\s*(?:-|to)\s*\$?\s?(\d[\d,]*(?:\.\d+)?)\s*(?:per|/)\s*(hour|day|week|month|year|yr)?"
PLACEHOLDER_TITLES = ["untitled role", "untitled job", "untitled position", "untitled", "unknown role", "unknown title", "job title", "n a", "na", "tbd"]
PLACEHOLDER_COMPANIES = ["unknown", "unknown company", "company", "n a", "na"]


def remote_type(location: Column, is_remote: Column, metadata: Column) -> Column:
    """hybrid, remote, onsite or unknown, from the location's text and the raw metadata's."""
    place = F.coalesce(location, F.lit(""))
    said = F.concat_ws(" ", place, metadata)
    return (
        F.when(said.rlike(r"(?i)\bhybrid\b"), "hybrid").when(F.coalesce(is_remote, F.lit(False)) | said.rlike(r"(?i)\b(remote|work from home|distributed)\b"), "remote")
        .when(F.trim(place) != "", "onsite").otherwise("unknown")
    )


def employment_type(value: Column) -> Column:
    """Type that a field names; null if it is blank, unknown if nothing fits."""
    normal = comparable(value)
    return F.when(normal != "", first_match(normal, EMPLOYMENT, F.lit("unknown")))


def salary_interval(value: Column) -> Column:
    return first_match(comparable(value), INTERVALS, F.lit("unknown"))


def salary(value: Column) -> Column:
    """Struct of the first range "a - b per interval" in a text; null if there is none."""
    part = lambda i: F.regexp_extract(value, SALARY, i)
    amount = lambda i: F.regexp_replace(part(i), ",", "").try_cast("double")
    found = F.struct(amount(1).alias("min_amount"), amount(2).alias("max_amount"), salary_interval(part(3)).alias("interval"), F.trim(value).alias("raw_text"))
    return F.when(value.rlike(SALARY), found)


def is_placeholder(title: Column) -> Column:
    return comparable(title).isin(PLACEHOLDER_TITLES)


def drop_reason(title: Column, company: Column, job_id: Column, source_url: Column, apply_url: Column, location: Column, platform: Column) -> Column:
    """The first thing that is wrong with a posting; null if it is sound."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    return (
        F.when(blank(title), "empty_title").when(is_placeholder(title), "placeholder_title").when(blank(company) | comparable(company).isin(PLACEHOLDER_COMPANIES), "missing_company")
        .when(blank(job_id), "missing_source_job_id").when(~is_http(source_url), "invalid_source_url").when(~is_http(apply_url), "invalid_apply_url")
        .when(blank(location), "empty_location").when(blank(platform), "normalization_failed")
    )


def status_keys(active: Column, link_status: Column, remote: Column, sponsorship: Column) -> Column:
    """Search keys of a posting's states."""
    return F.array_compact(F.array(
        F.when(F.coalesce(active, F.lit(True)), "active").otherwise("inactive"), F.concat(F.lit("link:"), link_status),
        F.concat(F.lit("workplace:"), remote), F.concat(F.lit("sponsorship:"), sponsorship),
    ))


def is_new(posted: Column, now: Column, days: int = 3) -> Column:
    return F.coalesce(F.unix_millis(now) - F.unix_millis(posted) <= days * 86_400_000, F.lit(False))
