"""What a reader of search results narrows them by: display filters, tags, labels, order.

Every predicate is one column expression over stored columns; the query's side of a
title comparison is worked out once on the driver, as it is one short text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.functions import dates, experience, postings
from vacantia.functions.text import comparable
from vacantia.operators.filters import SearchFilters

# Words, families and rules of the title comparison, labels and patterns.
STOP_TERMS = ["and", "for", "in", "of", "the", "to", "with", "job", "jobs", "role", "roles", "senior", "sr", "junior", "jr", "lead", "staff", "principal", "associate", "ii", "iii", "iv", "v"]
HEADS = ["engineer", "developer", "scientist", "analyst", "manager", "owner", "designer", "writer", "architect", "consultant", "administrator", "specialist", "coordinator", "recruiter", "tester"]
HEAD_PAIRS = [("engineer", "developer"), ("manager", "owner"), ("architect", "consultant"), ("tester", "engineer"), ("designer", "writer")]
EXPANSIONS = [
    ("ml", "machine learning ml"), ("ai", "artificial intelligence ai"), ("llm", "large language model llm"), ("nlp", "natural language processing nlp"),
    ("sre", "site reliability engineer sre"), ("sdet", "software development engineer test sdet"), ("ux", "user experience ux"), ("ui", "user interface ui"),
    ("pm", "product manager pm"), ("tpm", "technical program manager tpm"),
]
FAMILIES = [
    ("software_engineering", ["software", "backend", "back end", "frontend", "front end", "full stack", "web", "mobile", "ios", "android", "platform", "api", "distributed systems"],
     ["software", "backend", "frontend", "fullstack", "developer", "web", "mobile", "ios", "android", "platform", "api", "systems"]),
    ("data_platform", ["data engineer", "analytics engineer", "data platform", "data warehouse", "etl", "database", "big data", "data integration"],
     ["data", "analytics", "warehouse", "etl", "database", "pipeline", "spark", "dbt", "bigquery"]),
    ("data_analytics", ["data analyst", "business analyst", "product analyst", "business intelligence", "reporting analyst", "financial analyst", "marketing analyst", "insights"],
     ["analyst", "analytics", "business", "product", "intelligence", "reporting", "financial", "marketing", "insights", "strategy"]),
    ("ai_ml_science", ["machine learning", "artificial intelligence", "applied scientist", "research scientist", "data scientist", "deep learning", "computer vision", "natural language", "generative ai", "large language model"],
     ["ml", "ai", "llm", "nlp", "vision", "scientist", "research", "applied", "learning", "model", "models", "mlops", "data"]),
    ("product", ["product manager", "technical product", "product owner", "growth product", "platform product", "associate product"], ["product", "pm", "apm", "owner", "growth", "platform"]),
    ("program_management", ["program manager", "technical program", "project manager", "delivery manager", "scrum master"], ["program", "project", "delivery", "scrum", "tpm"]),
    ("cloud_devops_security", ["devops", "site reliability", "cloud", "infrastructure", "security", "devsecops", "network"], ["devops", "sre", "cloud", "infrastructure", "security", "devsecops", "network", "reliability"]),
    ("architecture_solutions", ["solutions engineer", "solution engineer", "solutions architect", "sales engineer", "pre sales", "customer engineer"], ["solutions", "solution", "sales", "customer", "architect", "presales"]),
    ("design_content_marketing", ["product designer", "ux", "ui", "technical writer", "content designer", "documentation", "marketing"], ["designer", "design", "ux", "ui", "writer", "writing", "content", "documentation", "marketing"]),
    ("qa_support_it", ["qa", "quality assurance", "test engineer", "sdet", "support engineer", "it support"], ["qa", "quality", "test", "tester", "sdet", "support", "it"]),
    ("business_operations_people", ["business operations", "operations", "recruiter", "people", "hr", "talent"], ["business", "operations", "recruiter", "people", "hr", "talent"]),
]
REMOTE_WORDS = r"(?i)\b(remote|work from home|distributed)\b"
VISA_NO = r"(?i)\b(no|not|without|unable to|cannot)\s+(offer |provide |support )?(visa|immigration|sponsorship)\b"
VISA_NONE = r"(?i)\b(visa|immigration) sponsorship is not available\b"
VISA_YES = r"(?i)\b(visa sponsorship|immigration support|h-1b|h1b|will sponsor|can sponsor|sponsorship available|open to visa)\b"
WORKPLACE_LABELS = [("hybrid", "Hybrid"), ("remote", "Remote"), ("onsite", "On-site")]
LEVEL_LABELS = [
    ("intern", "Intern"), ("new_grad", "New grad"), ("junior", "Junior"), ("mid", "Mid"), ("senior", "Senior"), ("lead", "Lead"), ("manager", "Manager"),
    ("director", "Director"), ("executive", "Executive"), ("staff", "Staff"), ("principal", "Principal"),
]
EMPLOYMENT_LABELS = [
    ("full_time", "Full-time"), ("part_time", "Part-time"), ("contract", "Contract"), ("temporary", "Temporary"), ("internship", "Internship"), ("apprenticeship", "Apprenticeship"),
    ("seasonal", "Seasonal"), ("freelance", "Freelance"),
]


@dataclass
class ResultFilters:
    """What a reader narrows the results by; None and empty ask for nothing."""

    workplace: str | None = None
    remote_only: bool = False
    employment_types: list[str] = field(default_factory=list)
    sponsorship: str | None = None
    visa_only: bool = False
    company: str | None = None
    posted: str = "any"


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def _labelled(value: Column, labels: list[tuple[str, str]], other: Column) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for k, v in labels:
        out = out.when(value == k, v)
    return out.otherwise(other)


# ---- titles


def _expanded(text: str) -> str:
    for short, long in EXPANSIONS:
        text = re.sub(rf"\b{short}\b", long, text)
    return text


def _query_signal(text: str) -> tuple[str, list[str], str | None, str | None]:
    """Expanded form, meaningful words, head and family of the query."""
    whole = _expanded(text)
    words = [w for w in whole.split() if w not in STOP_TERMS]
    head = next((w for w in reversed(words) if w in HEADS), None)
    scored = [(3 * sum(p in whole for p in phrases) + sum(t in words for t in terms) + (head in terms), -i, name) for i, (name, phrases, terms) in enumerate(FAMILIES)]
    best = max(scored)
    return whole, list(dict.fromkeys(words)), head, best[2] if best[0] > 0 else None


def title_matches(title: Column, query: str) -> Column:
    """Whether a title fits the query: one holds the other, or family, head and words agree enough.

    A query without letters or digits fits every title, a title without any fits none.
    """
    wanted = " ".join(re.sub(r"[^a-z0-9]+", " ", (query or "").lower()).split())
    if not wanted:
        return F.lit(True)
    _, words, q_head, q_family = _query_signal(wanted)
    normal = comparable(F.coalesce(title, F.lit("")))
    whole = reduce(lambda c, e: F.regexp_replace(c, rf"\b{e[0]}\b", e[1]), EXPANSIONS, normal)
    tokens = F.filter(F.split(whole, " "), lambda w: w != "")
    meaningful = F.filter(tokens, lambda w: ~w.isin(STOP_TERMS))
    head = F.try_element_at(F.filter(meaningful, lambda w: w.isin(HEADS)), F.lit(-1))
    scored = []
    for i, (name, phrases, terms) in enumerate(FAMILIES):
        said = reduce(lambda a, b: a + b, [whole.contains(p).cast("int") for p in phrases])
        held = F.size(F.array_intersect(meaningful, F.array(*map(F.lit, terms))))
        score = said * 3 + held + F.coalesce(head.isin(terms), F.lit(False)).cast("int")
        scored.append(F.struct(score.alias("score"), F.lit(-i).alias("at"), F.lit(name).alias("family")))
    best = F.array_max(F.array(*scored))
    family = F.when(best["score"] > 0, best["family"])
    shared = [w for w in words if w != q_head]
    modifier = F.arrays_overlap(tokens, F.array(*map(F.lit, shared))) if shared else F.lit(False)
    mates = {q_head, *(b for a, b in HEAD_PAIRS if a == q_head), *(a for a, b in HEAD_PAIRS if b == q_head)} - {None}
    compatible = F.coalesce(head.isin(sorted(mates)), F.lit(False)) if mates else F.lit(False)
    same = F.coalesce(family == q_family, F.lit(False)) if q_family else F.lit(False)
    required = [w for w in words if len(w) > 2]
    complete = F.lit(bool(required)) & reduce(lambda a, b: a & b, [F.array_contains(tokens, w) for w in required], F.lit(True))
    fits = normal.contains(wanted) | F.lit(wanted).contains(normal) | (same & (compatible | modifier)) | (compatible & modifier) | complete
    return (normal != "") & fits


# ---- predicates


def searchable(*columns: Column) -> Column:
    """Title, company, places, snippet and metadata of a posting as one text; blanks and nulls leave no gap."""
    return F.array_join(F.filter(F.array(*columns), lambda x: x.isNotNull() & (x != "")), " ")


def is_remote(remote_type: Column, text: Column) -> Column:
    return (
        F.when(remote_type.isin("remote", "hybrid"), True).when(remote_type == "onsite", False).otherwise(text.rlike(REMOTE_WORDS))
    )


def is_visa_friendly(hint: Column, text: Column) -> Column:
    """As the hint says; else what the text says, a refusal before a promise."""
    return (
        F.when(hint == "supported", True).when(hint == "not_supported", False).when(text.rlike(VISA_NO) | text.rlike(VISA_NONE), False).otherwise(text.rlike(VISA_YES))
    )


def workplace(remote_type: Column, text: Column, wanted: str | None, remote_only: bool = False) -> Column:
    if remote_only or wanted == "remote":
        return is_remote(remote_type, text)
    return F.lit(True) if wanted in (None, "any") else F.coalesce(remote_type == wanted, F.lit(False))


def employment(kind: Column, wanted: list[str]) -> Column:
    return F.coalesce(kind.isin(wanted), F.lit(False)) if wanted else F.lit(True)


def sponsorship(hint: Column, text: Column, wanted: str | None, visa_only: bool = False) -> Column:
    if visa_only or wanted == "supported":
        return is_visa_friendly(hint, text)
    return F.lit(True) if wanted in (None, "any") else F.coalesce(hint == wanted, F.lit(False))


def company(name: Column, wanted: str | None) -> Column:
    normal = " ".join(re.sub(r"[^a-z0-9]+", " ", (wanted or "").lower()).split())
    return comparable(F.coalesce(name, F.lit(""))).contains(normal) if normal else F.lit(True)


def level(stated: Column, filters: SearchFilters) -> Column:
    """Stored level against the levels asked for; none asked for takes all."""
    if not filters.levels:
        return F.lit(True)
    broad = filters.unspecified_levels or filters.level_mode == "broad"
    return experience.matches(stated, stated.isNotNull(), F.lit("high"), filters.levels, filters.level_mode, broad)


def predicates(search: SearchFilters, result: ResultFilters, place: Column, now: Column) -> dict[str, Column]:
    """The nine tests by name, over title, company, platform, level, remote_type, employment_type, sponsorship_hint, text and posted_at; ``place`` is the test of the location."""
    text = F.col("text")
    return {
        "title": title_matches(F.col("title"), search.title), "location": place,
        "platform": F.coalesce(F.col("platform").isin(search.platforms), F.lit(False)) if search.platforms else F.lit(True),
        "experience": level(F.col("level"), search), "workplace": workplace(F.col("remote_type"), text, result.workplace, result.remote_only),
        "employment": employment(F.col("employment_type"), result.employment_types), "sponsorship": sponsorship(F.col("sponsorship_hint"), text, result.sponsorship, result.visa_only),
        "company": company(F.col("company"), result.company), "posted": dates.posted_within(F.col("posted_at"), result.posted, now),
    }


def display(jobs: DataFrame, search: SearchFilters, result: ResultFilters, place: Column, now: Column) -> DataFrame:
    """Rows that pass all nine tests."""
    return reduce(DataFrame.where, predicates(search, result, place, now).values(), jobs)


# ---- labels and order


def workplace_label(remote_type: Column, text: Column) -> Column:
    return _labelled(remote_type, WORKPLACE_LABELS, F.when(is_remote(remote_type, text), "Remote"))


def sponsorship_label(hint: Column, text: Column) -> Column:
    return (
        F.when(hint == "supported", "Sponsorship available").when(hint == "not_supported", "No sponsorship")
        .when(is_visa_friendly(hint, text), "Sponsorship likely").otherwise("Sponsorship not specified")
    )


def employment_label(kind: Column) -> Column:
    return _labelled(kind, EMPLOYMENT_LABELS, F.lit("Not specified"))


def level_label(stated: Column) -> Column:
    return _labelled(stated, LEVEL_LABELS, stated)


def tags(remote_type: Column, hint: Column, stated: Column, posted: Column, text: Column, now: Column) -> Column:
    """Workplace, visa, level and newness, as far as there is something to say."""
    return F.array_compact(F.array(
        workplace_label(remote_type, text), F.when(is_visa_friendly(hint, text), "Visa"), level_label(stated), F.when(postings.is_new(posted, now), "New"),
    ))


def posted_label(at: Column) -> Column:
    """Month, day and year, as in ``Jan 2, 2000``."""
    return F.coalesce(F.date_format(at, "MMM d, yyyy"), F.lit("Date unavailable"))


def display_order() -> list[Column]:
    """Newest first, undated last, then platform and title."""
    return [F.desc_nulls_last("posted_at"), F.asc("platform"), F.asc("title")]


def category(in_states: Column, remote: Column, city: Column, state: Column, country: Column, stated_country: Column) -> Column:
    """Bucket of a posting's resolved place: kinds of places in the United States, other countries by name, or unknown."""
    there = lambda c: F.coalesce(c != "", F.lit(False))
    name = lambda c: F.concat(F.lit("country:"), F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "_"), "^_+|_+$", ""), F.lit("")), F.lit("unknown")))
    home = F.when(F.coalesce(remote, F.lit(False)), "remote_us").when(there(city) & there(state), "city_state_us").when(there(state), "state_us").otherwise("united_states")
    return F.when(F.coalesce(in_states, F.lit(False)), home).when(there(country), name(country)).when(there(stated_country), name(stated_country)).otherwise("unknown")
