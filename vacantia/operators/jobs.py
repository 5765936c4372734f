"""Seeds to stored jobs, the guard over results, and small set operations on titles."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacantia.functions import postings
from vacantia.functions import text as X
from vacantia.functions.experience import classify
from vacantia.functions.urls import content_fingerprint
from vacantia.operators.identity import with_identity

# What speaks of experience in metadata and what only seems to, keys that are not read, limits.
HINT_WORDS = re.compile(r"\b(intern|internship|co op|cooperative education|apprentice|working student|student program|student opportunity|student role|student position|for students|new grad|new graduate|recent grad|recent graduate|entry level|early career|early talent|junior|associate|mid level|senior|staff|principal|distinguished|fellow|member of technical staff|mts|smts|lmts|pmts|lead|architect|manager|director|executive|head of|vice president|vp|chief|cto|cdo|cio|level [2-5]|ii|iii|iv|v|l[4-9]|ic[4-9]|e[4-9]|years|year|yrs|yoe|experience)\b")
HINT_YEARS = re.compile(r"\b\d+(?:\.\d+)?\s*(?:\+|plus)?\s*(?:-|to|–|—)?\s*\d*(?:\.\d+)?\s*(?:years?|yrs?|yoe)\b", re.I)
NO_HINT = [re.compile(p) for p in (
    r"\bif you are an? (?:intern|new grad|new graduate|staff|junior|senior|associate|working student|apprentice)\b", r"\bplease do not apply\b", r"\bdo not apply using this link\b",
    r"\bdoes not include internships?\b", r"\bnot for interns?\b", r"\bexcluding internships?\b",
)]
UNREAD_KEYS = {"crawlTraceId", "crawlTitleMatch", "crawlLocationMatch", "crawlExperienceMatch", "crawlResolvedLocation"}
MOST_HINTS, MOST_PER_TEXT, WHOLE_TEXT = 48, 6, 220


def _speaks(text: str) -> bool:
    normal = " ".join(re.findall("[a-z0-9]+", text.lower()))
    return bool(normal and (HINT_WORDS.search(normal) or HINT_YEARS.search(text)) and not any(p.search(normal) for p in NO_HINT))


def hints_of(text: str) -> list[str]:
    """Sentences of a text that speak of experience; a short text is one."""
    plain = " ".join(re.sub(r"&(nbsp|amp|quot|apos|#39|#x27);", " ", re.sub(r"<[^>]+>", " ", text)).split())
    if len(plain) <= WHOLE_TEXT and not re.search(r"[.!?;|]\s", plain) and _speaks(plain):
        return [plain]
    parts = (s.strip().rstrip(".") for s in re.split(r"(?<=[.!?])\s+|(?<=[;|])\s+", plain))
    return [s for s in parts if s and _speaks(s)][:MOST_PER_TEXT]


def _texts(node) -> Iterator[str]:
    if isinstance(node, str):
        yield node
    elif isinstance(node, list):
        for x in node:
            yield from _texts(x)
    elif isinstance(node, dict):
        for k, v in node.items():
            if k not in UNREAD_KEYS:
                yield from _texts(v)


@F.pandas_udf(T.ArrayType(T.StringType()))
def experience_hints(bodies: pd.Series) -> pd.Series:
    """What metadata (JSON text, of any depth) says of experience, in order; at most MOST_HINTS."""

    def one(body):
        try:
            return [h for t in (_texts(json.loads(body)) if body else ()) for h in hints_of(t)][:MOST_HINTS]
        except ValueError:
            return []

    return bodies.map(one)


def hydrated(seeds: DataFrame) -> DataFrame:
    """Seeds as stored jobs, with ``drop_reason`` for those that are not sound.

    Dates fall back on one another, the level is what the seed says or what its title
    does, keys and fingerprints come from the comparable texts; a new job is active and
    its link unknown.
    """
    c, none = F.col, F.lit(None).cast("string")
    reason = postings.drop_reason(c("title"), c("company"), c("source_job_id"), c("source_url"), c("apply_url"), c("location"), c("platform"))
    fingerprint = content_fingerprint(c("company"), c("title"), c("location"))
    board = F.concat_ws(":", "platform", "company_slug", "source_job_id")
    rows = seeds.withColumn("drop_reason", reason).withColumn("fingerprint", fingerprint).withColumn("lookup_keys", F.array(board)).withColumn("resolved_url", none)
    keyed = with_identity(rows)
    level = F.coalesce(c("level"), classify(c("title"))["level"])
    posted = c("posted_at")
    return keyed.select(
        *[x for x in keyed.columns if x not in ("level", "posted_at")], level.alias("level"), posted.alias("posting_date"), posted.alias("posted_at"), X.comparable(c("company")).alias("company_key"),
        X.comparable(c("title")).alias("title_key"), X.comparable(c("location")).alias("location_key"), F.coalesce("remote_type", F.lit("unknown")).alias("remote"), F.lit("unknown").alias("link_status"),
        c("discovered_at").alias("first_seen"), c("discovered_at").alias("last_seen"), c("discovered_at").alias("indexed_at"), F.lit(True).alias("is_active"), F.lit(None).cast("timestamp").alias("closed_at"),
    )


def guarded(rows: DataFrame, source: str, title_score: Column, tier: Column, place: Column, matched_level: Column, level: Column, least: int = 420) -> DataFrame:
    """Rows that still meet a search, with the struct ``search_response`` of the verdicts that let them through."""
    sure = lambda x: F.coalesce(x, F.lit(False))
    response = F.struct(F.lit(source).alias("source"), tier.alias("tier"), title_score.cast("int").alias("title_score"), sure(place).alias("location"), matched_level.alias("matched_level"))
    return rows.where(sure(title_score >= least) & sure(place) & sure(level)).withColumn("search_response", response)


def distinct_normal(values: Column) -> Column:
    """Normal forms of titles, in order, each once, without blanks."""
    return F.array_distinct(F.filter(F.transform(F.array_compact(values), X.normal_title), lambda v: v != ""))


def shared_terms(query: list[str], title: Column) -> Column:
    """Words of a query that a title has, in the query's order, repeats included."""
    return F.filter(F.array(*map(F.lit, query)), lambda w: F.array_contains(title, w))


def with_matches(ranked: DataFrame, matches: DataFrame, identity: str = "pos") -> DataFrame:
    """Ranked rows with the columns of the matches that they came from."""
    return ranked.join(matches, identity)
