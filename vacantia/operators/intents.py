"""What a free-text search asks for, and what is done about it: intents, seniority, coverage, decisions.

Everything is a column expression over a table of searches with counts beside them, so a
log of millions of searches is judged in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantia.operators.titles import Catalog

# Phrases that stand for platforms and countries, words around a title, ladders of seniority, targets.
PLATFORM_PHRASES = [
    ("greenhouse", r"(?i)\bgreenhouse\b"), ("lever", r"(?i)\blever\b"), ("ashby", r"(?i)\bashby\b"), ("smartrecruiters", r"(?i)\bsmart ?recruiters?\b"),
    ("company_page", r"(?i)\bcompany(?: |-)?pages?\b"), ("workday", r"(?i)\bworkday\b"),
]
COUNTRY_PHRASES = [("United States", r"(?i)\b(?:united states(?: of america)?|u\.?\s*s\.?\s*a?\.?)\b"), ("Canada", r"(?i)\b(?:canada|canadian)\b")]
WRAPPERS = r"(?i)\b(?:jobs?|roles?|positions?|openings?|listings?)\b"
NOISE = [r"(?i)^(?:in|at|for|on|with)(?: the)?\b[\s,:-]*", r"(?i)[\s,:-]*(?:in|at|for|on|with)(?: the)?$", r"(?i)[\s,:-]*the$"]
REMOTE_ONLY = r"(?i)\b(remote only|fully remote|100% remote)\b"
SENIORITIES = ["intern", "new_grad", "junior", "mid", "senior", "lead", "staff", "principal", "manager", "director", "executive"]
SURE_LADDER = [
    ("executive", r"\b(distinguished engineer|fellow engineer|executive director|chief technology officer|cto|chief product officer|cpo)\b"),
    ("director", r"\b(director of engineering|engineering director|director of product|vp of|vice president of|head of engineering|head of product)\b"),
    ("principal", r"\b(principal engineer|principal scientist|principal architect|principal product manager|distinguished)\b"),
    ("staff", r"\b(staff engineer|staff scientist|staff product manager|staff data|staff software)\b"),
    ("lead", r"\b(lead engineer|lead developer|lead product|lead data|tech lead|technical lead|team lead)\b"),
    ("senior", r"\b(senior software|senior engineer|senior developer|senior product|senior data|senior manager|sr\. software|sr software)\b"),
    ("manager", r"\b(engineering manager|project manager|program manager)\b"), ("mid", r"\b(software engineer ii|software engineer 2|software developer ii|data analyst ii)\b"),
    ("senior", r"\b(software engineer iii|software engineer 3|software developer iii|data analyst iii|senior ii)\b"),
    ("junior", r"\b(software engineer i|software engineer 1|software developer i|data analyst i|associate software|associate product manager|associate engineer|associate developer)\b"),
    ("new_grad", r"\b(new grad|new graduate|university grad|campus hire|entry level|recent grad)\b"), ("intern", r"\b(intern|internship|co-op|co op)\b"),
]
LIKELY_LADDER = [
    ("director", r"\b(director)\b"), ("principal", r"\b(principal|architect)\b"), ("staff", r"\b(staff)\b"), ("lead", r"\b(lead)\b"), ("senior", r"\b(senior|sr\.?)\b"), ("senior", r"\b(ii|iii|iv|v)\b"),
    ("manager", r"\b(manager|head of|vp)\b"), ("junior", r"\b(junior|jr\.?|associate)\b"), ("new_grad", r"\b(entry.level|graduate|grad)\b"), ("intern", r"\b(intern)\b"),
]
PREFERRED = [
    (r"\b(senior|sr\.?|sr)\b", ["senior"]), (r"\b(staff)\b", ["staff"]), (r"\b(principal|distinguished)\b", ["principal"]), (r"\b(lead)\b", ["lead"]), (r"\b(manager|head of|vp of|director of)\b", ["manager", "director"]),
    (r"\b(director|head|vp|vice president)\b", ["director", "executive"]), (r"\b(junior|jr\.?|jr|associate)\b", ["junior", "mid"]), (r"\b(entry.level|new grad|graduate|intern)\b", ["intern", "new_grad"]),
]
DEMANDED = ["ai_ml_science", "software_engineering", "data_platform", "data_analytics", "product"]
LEAST_COVERAGE = {"fast": 40, "balanced": 80, "deep": 160}
COUNTRY_COVERAGE, DEMAND_COVERAGE = 200, 400


def _tidy(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(value, r"[|/]+", " "), r"\s+", " "))


def peeled(title: Column) -> Column:
    """Struct of title, platforms and country of a free text: names of platforms and countries, wrapper words and hanging prepositions come off."""
    plain = F.trim(title)
    rest, platforms = plain, []
    for name, pattern in PLATFORM_PHRASES:
        platforms.append(F.when(rest.rlike(pattern), F.lit(name)))
        rest = F.regexp_replace(rest, pattern, " ")
    countries = []
    for name, pattern in COUNTRY_PHRASES:
        countries.append(F.when(rest.rlike(pattern), F.lit(name)))
        rest = F.regexp_replace(rest, pattern, " ")
    rest = _tidy(F.regexp_replace(rest, WRAPPERS, " "))
    for pattern in NOISE:
        rest = _tidy(F.regexp_replace(rest, pattern, ""))
    return F.struct(F.when(F.length(rest) >= 2, rest).otherwise(plain).alias("title"), F.array_compact(F.array(*platforms)).alias("platforms"), F.coalesce(*countries).alias("country"))


def seniority(title: Column) -> Column:
    """Struct of level and confidence: sure phrases first, of several the longest, then the highest; then likely words in order; else unknown."""
    plain = F.trim(F.coalesce(title, F.lit("")))
    low = F.lower(plain)
    sure = F.array_compact(F.array(*[
        F.when(low.rlike(p), F.struct(F.length(F.regexp_extract(plain, p, 0)).alias("size"), F.lit(SENIORITIES.index(level)).alias("place"), F.lit(-i).alias("at"), F.lit(level).alias("level"))) for i, (level, p) in enumerate(SURE_LADDER)
    ]))
    likely = F.coalesce(*[F.when(low.rlike(p), F.lit(level)) for level, p in LIKELY_LADDER])
    best = F.array_max(sure)
    return F.struct(
        F.coalesce(best["level"], likely, F.lit("unknown")).alias("level"), F.when(best.isNotNull(), "high").when(likely.isNotNull(), "medium").otherwise("low").alias("confidence")
    )


def preferred_seniorities(title: Column) -> Column:
    """Levels that a query names, in order."""
    low = F.lower(F.coalesce(title, F.lit("")))
    return F.array_compact(F.array(*[F.when(low.rlike(p), F.lit(x)) for p, levels in PREFERRED for x in levels]))


def remote_preference(location: Column, remote: Column) -> Column:
    return F.when(~F.coalesce(remote, F.lit(False)), "none").when(F.coalesce(location, F.lit("")).rlike(REMOTE_ONLY), "required").otherwise("preferred")


def intent(title: Column, location: Column, remote: Column) -> Column:
    """Struct of what a search prefers."""
    return F.struct(
        F.trim(title).alias("raw_title"), preferred_seniorities(title).alias("preferred"), remote_preference(location, remote).alias("remote"), F.lit("none").alias("sponsorship"),
    )


def coverage(mode: Column, family: Column, seniority_words: Column, words: Column, country: Column, state: Column, city: Column, target: int) -> Column:
    """Struct of the coverage a search needs and why, from its mode, breadth of title and place, and demand for its family."""
    said = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    mode = F.coalesce(mode, F.lit("balanced"))
    place = F.when(said(city), "city").when(said(country) & ~said(state), "country").when(said(state), "state").otherwise("unspecified")
    broad = (seniority_words == 0) & (words <= 3)
    wanted = max(1, int(target))
    part = lambda x: F.ceil(F.lit(wanted * x)).cast("long")
    least = {k: F.lit(v).cast("long") for k, v in LEAST_COVERAGE.items()}
    goal = F.when(mode == "fast", F.greatest(least["fast"], part(0.4))).when(mode == "deep", F.greatest(least["deep"], part(2))).otherwise(F.greatest(least["balanced"], F.lit(wanted).cast("long")))
    ratio = F.when(mode == "deep", F.when(broad, part(0.3)).otherwise(part(0.27))).otherwise(part(0.16))
    goal = (
        F.when(place == "country", F.greatest(goal, F.lit(COUNTRY_COVERAGE).cast("long"), part(2.5))).when(place == "state", F.greatest(goal, part(1.4)))
        .when(place == "city", F.least(goal, F.greatest(F.lit(1).cast("long"), ratio))).otherwise(goal)
    )
    demanded = F.coalesce(family.isin(DEMANDED), F.lit(False))
    goal = F.when(demanded & (place == "country"), F.greatest(goal, F.lit(DEMAND_COVERAGE).cast("long"), part(4))).when(demanded & (place == "state"), F.greatest(goal, part(2))).otherwise(goal)
    goal = F.when(broad & (place != "city"), F.greatest(goal, part(1.25))).otherwise(goal)
    goal = F.when(mode == "deep", F.greatest(goal, least["deep"])).otherwise(goal)
    return F.struct(goal.alias("target"), F.when(broad, "broad").otherwise("specific").alias("title_breadth"), place.alias("place_breadth"), demanded.alias("demanded"))


def supplemental(matched: Column, target: Column, reused: Column, last_status: Column, last_visible: Column, age_ms: Column, mode: Column, stale_ms: int, explicit: Column, recovery: Column) -> Column:
    """Struct of the reason and what follows: nothing, a targeted run in the queue, or a run at once."""
    enough = (matched > 0) & (matched >= target)
    kept = reused & (last_status == "completed") & (last_visible > 0) & (matched >= last_visible) & (last_visible >= target)
    retry = reused & last_status.isNotNull() & (last_status != "completed") & ~recovery
    stale = (matched > 0) & age_ms.isNotNull() & (age_ms >= stale_ms)
    sure = lambda c: F.coalesce(c, F.lit(False))
    reason = (
        F.when(sure(enough), "indexed_coverage_sufficient").when(sure(kept), "reused_completed_coverage").when(sure(retry), "retry_incomplete_previous_run")
        .when(sure(stale & (mode == "deep") & recovery), "freshness_recovery").when(sure(explicit & (matched < target)), "explicit_request_time_recovery")
        .otherwise("insufficient_indexed_coverage_targeted_replenishment")
    )
    now = reason.isin("freshness_recovery", "explicit_request_time_recovery")
    nothing = reason.isin("indexed_coverage_sufficient", "reused_completed_coverage")
    return F.struct(reason.alias("reason"), (~nothing).alias("queue"), (~nothing & ~now).alias("targeted"), now.alias("at_once"))


def needs_crawl(found: Column, fresh: Column, duplicate_rate: Column, least: int, mode: Column) -> Column:
    """Whether stored results are too few, too stale or too repetitive."""
    return (found < least) | ((duplicate_rate > 0.5) & (found < 2 * least)) | (fresh < 0.5 * least)


def decision(found: Column, crawl: Column, least: int) -> Column:
    """Struct of action and of what the answer is served from."""
    few = found < 0.3 * least
    return F.struct(
        F.when(~crawl, "return_db_results").when((found == 0) | few, "trigger_crawl").otherwise("trigger_background_ingestion").alias("action"),
        F.when(~crawl, "database").when(found == 0, "crawl").when(few, "mixed").otherwise("database").alias("served_from"),
    )


def expansions(anchor: str | None, others: list[str], title: str, catalog: Catalog) -> list[tuple[str, float, str]]:
    """Phrases with relevance and tier for a title whose best role is ``anchor``: its names, neighbours, the family's broad words, further roles."""
    concepts = {c.name: c for c in catalog.concepts}
    own = concepts.get(anchor)
    if own is None:
        return [(title, 1.0, "anchor")]
    out = [(own.title, 1.0, "anchor"), *[(a, 0.9, "core") for a in own.aliases], *[(a, 0.85, "core") for a in own.abbreviations], *[(concepts[a].title, 0.8, "adjacent") for a in own.adjacent if a in concepts and a != anchor]]
    family = next((f for f in catalog.families if f.name == own.family), None)
    said = {p for p, _, _ in out}
    out += [(d, 0.7, "supplemental") for d in (family.discovery if family else []) if d not in said]
    reached = {anchor, *own.adjacent}
    return out + [(concepts[o].title, 0.6, "supplemental") for o in others if o in concepts and o not in reached]


def retrieval_filter(listed: list[tuple[str, float, str]], fields: dict[str, str | None], remote: str, platforms: list[str]) -> dict:
    """What a search asks of the store: phrases of relevance 0.7 or more, the fields that are said, remote where it is required."""
    out: dict = {"titles": [p for p, r, _ in listed if r >= 0.7]}
    out |= {k: v for k, v in fields.items() if v}
    return out | ({"remote_type": "remote"} if remote == "required" else {}) | ({"platforms": platforms} if platforms else {})


# ---- batches of postings


def gated(rows: DataFrame, reason: Column, samples: int = 5) -> tuple[DataFrame, DataFrame]:
    """Postings that pass the quality gate, and the reasons of the others with counts and the smallest ids."""
    marked = rows.withColumn("reason", reason)
    place = F.row_number().over(Window.partitionBy("reason").orderBy("pos"))  # Spark keeps only the first of each task
    ranked = marked.where(F.col("reason").isNotNull()).withColumn("__place", place).where(F.col("__place") <= samples)
    shown = ranked.groupBy("reason").agg(F.array_sort(F.collect_list("pos")).alias("samples"))  # at most ``samples`` a reason
    counts = marked.where(F.col("reason").isNotNull()).groupBy("reason").agg(F.count("*").alias("n"))
    return marked.where(F.col("reason").isNull()).drop("reason"), counts.join(shown, "reason")


def traced(rows: DataFrame, title: Column, place: Column, level: Column) -> DataFrame:
    """``rows`` with a struct of the three verdicts and the first that failed; a later one is not asked once one failed."""
    sure = lambda c: F.coalesce(c, F.lit(False))
    t, p, e = sure(title), sure(place), sure(level)
    failed = F.when(~t, "title").when(~p, "location").when(~e, "experience")
    return rows.withColumn("trace", F.struct(t.alias("title"), F.when(t, p).alias("location"), F.when(t & p, e).alias("experience"), failed.alias("failed")))


def to_validate(rows: DataFrame, mode: str, newest: int = 5) -> DataFrame:
    """Postings whose links are checked at once: none, the newest few, or all."""
    if mode == "full_inline":
        return rows
    if mode == "deferred" or newest <= 0:
        return rows.limit(0)
    return rows.orderBy(F.desc_nulls_last(F.coalesce("posted_at", "discovered_at")), "pos").limit(newest)


def inline_validated(rows: DataFrame, checks: DataFrame, mode: str, since: Column, newest: int = 5) -> DataFrame:
    """``rows`` with the newest check of each link not older than ``since`` applied to those chosen for validation."""
    chosen = to_validate(rows, mode, newest).select("pos", F.lit(True).alias("__chosen"))
    recent = checks.where(F.col("checked_at") >= since).groupBy("apply_url").agg(F.max_by(F.struct("status", "checked_at"), "checked_at").alias("__check"))
    met = rows.join(chosen, "pos", "left").join(recent, "apply_url", "left")
    use = F.coalesce("__chosen", F.lit(False)) & F.col("__check").isNotNull()
    fresh = {"link_status": F.when(use, F.col("__check.status")).otherwise(F.col("link_status")), "validated_at": F.when(use, F.col("__check.checked_at")).otherwise(F.col("validated_at"))}
    return met.select(*[fresh[c].alias(c) if c in fresh else F.col(c) for c in rows.columns])


def recent_searches(searches: DataFrame, limit: int = 6) -> DataFrame:
    """The newest searches; of those the system's own are left out."""
    newest = searches.orderBy(F.desc("created_at"), F.desc("search_id")).limit(limit)
    return newest.where(F.col("system_profile").isNull() & (F.coalesce("title", F.lit("")) != "Background Inventory Refresh"))


def provider_tiers(providers: DataFrame, slow: bool, platforms: list[str] | None = None) -> DataFrame:
    """``providers`` with whether each is selected: the fast ones, the slow ones only where asked for, of the platforms asked for."""
    allowed = F.col("platform").isin(platforms) if platforms else F.lit(True)
    return providers.where(allowed).withColumn("selected", F.lit(slow) | (F.col("tier") == "fast"))


def resolved_level(stored: Column, legacy: Column, classified: Column) -> Column:
    """Struct of level and source: the stored classification if it says anything, else the legacy field, else the title's."""
    kept = stored["level"].isNotNull()
    return F.struct(
        F.when(kept, stored["level"]).otherwise(F.coalesce(legacy, classified["level"])).alias("level"),
        F.when(kept, F.coalesce(stored["source"], F.lit("stored"))).when(legacy.isNotNull(), "unknown").otherwise(classified["source"]).alias("source"),
    )
