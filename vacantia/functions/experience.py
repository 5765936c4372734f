"""Seniority of a posting: rule tables over titles, hints and years of experience."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from vacantia.functions.rules import first_match, let
from vacantia.functions.text import comparable

# Levels by priority, and the band of each.
LEVELS = ["intern", "new_grad", "junior", "mid", "senior", "lead", "manager", "director", "executive", "staff", "principal"]
BANDS = {
    "intern": "entry", "new_grad": "entry", "junior": "entry", "mid": "mid", "senior": "senior", "lead": "leadership", "manager": "leadership",
    "director": "leadership", "executive": "leadership", "staff": "advanced", "principal": "advanced",
}
CONFIDENCE = ["none", "low", "medium", "high"]


@dataclass(frozen=True)
class Rule:
    name: str
    level: str
    kind: str
    pattern: str


_AREAS = "(?:engineering|software|data|machine learning|ml|ai|platform|infrastructure|security|it|devops|qa|quality|test|analytics)"
# What titles say about a level, over comparable text.
TITLE_RULES = [
    Rule("title_intern", "intern", "title_keyword", r"\b(?:intern|internship|co op|cooperative education|apprentice(?:ship)?|working student)\b"),
    Rule("title_new_grad", "new_grad", "title_keyword", r"\b(?:new grad(?:uate)?|recent grad(?:uate)?|entry level|early career|early talent|graduate program)\b"),
    Rule("title_junior", "junior", "title_keyword", r"\b(?:junior|jr|entry associate|associate)\b"),
    Rule("title_mid", "mid", "level_code", r"\b(?:mid(?: level)?|level 2|ii|l[- ]?4|ic[- ]?4|e[- ]?4)\b"),
    Rule("title_senior_keyword", "senior", "title_keyword", r"\b(?:senior|sr|architect)\b"),
    Rule("title_senior_level_code", "senior", "level_code", r"\b(?:level 3|iii|l[- ]?5|ic[- ]?5|e[- ]?5)\b"),
    Rule("title_leadership", "lead", "leadership_context", r"\blead\b"),
    Rule("title_manager_keyword", "manager", "leadership_context", rf"\b(?:{_AREAS}\s+manager|manager of {_AREAS})\b"),
    Rule("title_director_keyword", "director", "leadership_context", rf"\b(?:{_AREAS}\s+director|director of {_AREAS})\b"),
    Rule("title_executive_keyword", "executive", "leadership_context", rf"\b(?:(?:head|vp|vice president) of {_AREAS}|chief (?:technology|technical|data|information|product|engineering) officer|cto|cdo|cio)\b"),
    Rule("title_staff_keyword", "staff", "title_keyword", r"\b(?:staff|member of technical staff|mts|smts)\b"),
    Rule("title_staff_level_code", "staff", "level_code", r"\b(?:level 4|iv|l[- ]?6|ic[- ]?6|e[- ]?6)\b"),
    Rule("title_principal_keyword", "principal", "title_keyword", r"\b(?:principal|distinguished|fellow|lmts|pmts)\b"),
    Rule("title_principal_level_code", "principal", "level_code", r"\b(?:level 5|v|l[- ]?(?:7|8|9|10)|ic[- ]?(?:7|8|9|10)|e[- ]?(?:7|8|9|10))\b"),
]
STUDENT_RULE = Rule("structured_student_program", "intern", "title_keyword", r"\b(?:student (?:program|opportunity|role|position)|for students|campus|university recruiting)\b")
HINT_RULES = [STUDENT_RULE, *TITLE_RULES]
DESCRIPTION_RULES = [r for r in TITLE_RULES if r.kind != "leadership_context" and r.name not in ("title_senior_keyword", "title_junior")]
# A platform's own seniority field; manager and director count as lead here.
FIELD_RULES = [
    ("intern", r"\bintern"), ("new_grad", r"\b(?:new grad|graduate|entry level|early career)\b"), ("junior", r"\b(?:junior|jr)\b"),
    ("mid", r"\b(?:mid|ii|level 2)\b"), ("senior", r"\b(?:senior|sr|iii|level 3)\b"), ("lead", r"\b(?:lead|manager|director|head)\b"),
    ("staff", r"\b(?:staff|mts|smts|iv|level 4)\b"), ("principal", r"\b(?:principal|distinguished|fellow|pmts|lmts|v|level 5)\b"),
]
_UNIT = r"(?:years?|yrs?|yoe)\b"
RANGE = rf"\b(\d+(?:\.\d+)?)\s*\+?\s*(?:-|to|–|—)\s*(\d+(?:\.\d+)?)\s*\+?\s*{_UNIT}"
LEAST = rf"(?:\b(?:at least|minimum of|minimum|more than|over)\s*)?\b(\d+(?:\.\d+)?)\s*(?:\+|plus)?\s*{_UNIT}"


def priority(level: Column) -> Column:
    """Place of a level in the order, from 1; 0 for none."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, LEVELS)), level), F.lit(0)).cast("int")


def band(level: Column) -> Column:
    out = F.when(level.isNull(), "unknown")
    for name, value in BANDS.items():
        out = out.when(level == name, value)
    return out.otherwise("unknown")


def field_level(value: Column) -> Column:
    """Level that a platform's seniority field names; null if none."""
    return let(comparable(value), lambda normal: first_match(normal, FIELD_RULES))


def signals(value: Column, rules: list[Rule], source: str, confidence: int) -> Column:
    """A struct for every rule that a text meets: confidence, place of the level, level, source, rule."""

    def hits(normal: Column) -> Column:
        hit = lambda r: F.when(normal.rlike(r.pattern), _signal(F.lit(r.level), LEVELS.index(r.level) + 1, source, confidence, r.name))
        return F.array_compact(F.array(*map(hit, rules)))

    return let(comparable(value), hits)


def _signal(level: Column, place: int | Column, source: str, confidence: int, rule: str) -> Column:
    at = F.lit(place) if isinstance(place, int) else place
    return F.struct(F.lit(confidence).alias("confidence"), at.cast("int").alias("priority"), level.alias("level"), F.lit(source).alias("source"), F.lit(rule).alias("rule"))


def years_level(value: Column) -> Column:
    """Level for the years asked for: of ranges their middle, of minimums the number; the largest counts."""
    number = lambda a: F.transform(a, lambda x: x.cast("double"))

    def most(low: Column) -> Column:
        lows, highs = number(F.regexp_extract_all(low, F.lit(RANGE), F.lit(1))), number(F.regexp_extract_all(low, F.lit(RANGE), F.lit(2)))
        minimums = number(F.regexp_extract_all(F.regexp_replace(low, RANGE, " "), F.lit(LEAST), F.lit(1)))
        return F.array_max(F.concat(F.zip_with(lows, highs, lambda a, b: (a + b) / 2), minimums))

    level = lambda n: F.when(n >= 12, "principal").when(n >= 8, "staff").when(n >= 5, "senior").when(n >= 2, "mid").when(n.isNotNull(), "junior")
    return let(let(F.lower(F.coalesce(value, F.lit(""))), most), level)


def years_signal(value: Column, source: str, confidence: int) -> Column:
    """The years' level as an array of at most one signal."""
    return let(years_level(value), lambda level: F.filter(F.array(_signal(level, priority(level), source, confidence, "years")), lambda s: s["level"].isNotNull()))


def conservative(found: Column) -> Column:
    """The best signal, by confidence, then level; null if another level is as sure and nothing speaks for the best."""

    def judged(signals_: Column) -> Column:
        def against(best: Column) -> Column:
            peers = F.filter(signals_, lambda s: s["confidence"] == best["confidence"])
            return let(peers, lambda p: F.when(~(F.exists(p, lambda s: s["level"] != best["level"]) & (F.size(F.filter(p, lambda s: s["level"] == best["level"])) == 1)), best))

        return let(F.array_max(signals_), against)

    return let(found, judged)


def classify(title: Column, explicit: Column | None = None, hints: Column | None = None, description: Column | None = None, page: Column | None = None) -> Column:
    """Struct of level, explicit, source, confidence, band and rule: explicit field, title, structured hints, description, fetched page."""
    text_signals = lambda v, source, trust: F.concat(signals(v, DESCRIPTION_RULES, source, trust), years_signal(v, source, trust))
    ladder = [F.array_max(signals(title, TITLE_RULES, "title", 3))]  # a title needs nothing else to speak for it
    if hints is not None:
        ladder.append(conservative(signals(hints, HINT_RULES, "structured_metadata", 3)))
    if description is not None:
        ladder.append(conservative(text_signals(description, "description", 2)))
    if page is not None:
        ladder.append(conservative(text_signals(page, "page_fetch", 1)))
    given = field_level(explicit) if explicit is not None else F.lit(None).cast("string")

    def result(x: Column) -> Column:
        known, found = x["given"], x["found"]
        level = F.coalesce(known, found["level"])
        trust = F.element_at(F.array(*map(F.lit, CONFIDENCE)), F.coalesce(found["confidence"], F.lit(0)) + 1)
        return F.struct(
            level.alias("level"), F.coalesce(known.isNotNull() | (found["source"] == "title"), F.lit(False)).alias("explicit"),
            F.when(known.isNotNull(), "structured_metadata").otherwise(F.coalesce(found["source"], F.lit("unknown"))).alias("source"),
            F.when(known.isNotNull(), "high").otherwise(trust).alias("confidence"), band(level).alias("band"), F.when(known.isNull(), found["rule"]).alias("rule"),
        )

    return let(F.struct(given.alias("given"), F.coalesce(*ladder).alias("found")), result)


def matches(level: Column, explicit: Column, confidence: Column, selected: list[str], mode: str = "balanced", unspecified: bool = False) -> Column:
    """Whether a stored classification meets a filter: explicit levels always, inferred ones unless strict (low trust only if broad)."""
    if not selected:
        return F.lit(True)
    inside = F.coalesce(level.isin(selected), F.lit(False))
    trusted = F.lit(mode == "broad") | confidence.isin("high", "medium")
    inferred = F.lit(mode != "strict") & ~explicit & inside & trusted
    return (explicit & inside) | inferred | (F.lit(unspecified) & level.isNull())
