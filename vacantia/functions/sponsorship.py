"""Visa sponsorship: evidence in texts, decisions, and the plainer rules used at ingest and on display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vacantia.functions.rules import all_matches

# What counts as evidence, over raw text.
POSITIVE = [
    ("we sponsor", r"(?i)\bwe\s+sponsor\b"), ("visa sponsorship available", r"(?i)visa\s+sponsorship\s+available"), ("H-1B transfer", r"(?i)H-?1B\s+transfer"),
    ("will sponsor", r"(?i)\bwill\s+sponsor\b"), ("employment visa", r"(?i)employment\s+visa"),
    ("work authorization sponsorship available", r"(?i)work\s+authorization\s+sponsorship\s+available"),
]
NEGATIVE = [
    ("we do not sponsor", r"(?i)\bwe\s+do\s+not\s+sponsor\b"), ("no visa sponsorship", r"(?i)no\s+visa\s+sponsorship"),
    ("must be authorized without sponsorship", r"(?i)must\s+be\s+authorized\s+to\s+work\s+without\s+sponsorship"),
    ("now or in the future require sponsorship", r"(?i)now\s+or\s+in\s+the\s+future\s+require\s+sponsorship"),
    ("cannot sponsor", r"(?i)\bcannot\s+sponsor\b"),
    ("work authorization required without sponsorship", r"(?i)US\s+work\s+authorization\s+required\s+without\s+sponsorship"),
]
AMBIGUOUS = [
    ("must be authorized to work", r"(?i)\bmust\s+be\s+authorized\s+to\s+work\b"), ("eligible to work", r"(?i)eligible\s+to\s+work\s+in\s+the\s+United\s+States"),
    ("work authorization required", r"(?i)work\s+authorization\s+required"),
]
INGEST_NO = r"(?i)\b(no|not|without|unable to|cannot)\s+(offer |provide |support )?(visa|immigration|sponsorship)\b|\b(visa|immigration) sponsorship is not available\b"
INGEST_YES = r"(?i)\b(visa sponsorship|immigration support|h-1b|h1b|will sponsor|can sponsor|sponsorship available|open to visa)\b"


def company_key(name: Column) -> Column:
    """Company name as matched: white space is collapsed before punctuation goes, in that order."""
    low = F.regexp_replace(F.lower(F.trim(F.coalesce(name, F.lit("")))), r"\s+", " ")
    return F.trim(F.regexp_replace(low, r"[.,/#!$%^&*;:{}=\-_`~()]", ""))


def evidence(*texts: Column) -> Column:
    """Struct of the positive, negative and ambiguous evidence that the texts hold."""
    joined = lambda rules: F.concat(*[all_matches(F.coalesce(t, F.lit("")), rules) for t in texts])
    return F.struct(joined(POSITIVE).alias("positive"), joined(NEGATIVE).alias("negative"), joined(AMBIGUOUS).alias("ambiguous"))


def decide(found: Column, company_sponsors: Column, company_confidence: Column) -> Column:
    """Struct of hint and confidence: refusal, offer, the company's history one step less sure, ambiguous words, unknown."""
    stepped = F.when(company_confidence == "high", "medium").otherwise("low")
    refused, offered, vague = (F.size(found[k]) > 0 for k in ("negative", "positive", "ambiguous"))
    history = F.coalesce(company_sponsors, F.lit(False))
    return F.struct(
        F.when(refused, "not_supported").when(offered | history, "supported").otherwise("unknown").alias("hint"),
        F.when(refused | offered, "high").when(history, stepped).when(vague, "low").otherwise("none").alias("confidence"),
    )


def ingest_hint(value: Column) -> Column:
    """The rule used while postings are read in."""
    text = F.coalesce(value, F.lit(""))
    return F.when(F.trim(text) == "", "unknown").when(text.rlike(INGEST_NO), "not_supported").when(text.rlike(INGEST_YES), "supported").otherwise("unknown")
