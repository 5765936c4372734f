"""The search index of a posting, and a search's candidates through several channels of it.

The index is a set of stored arrays of keys, so a search compares literals with columns
and nothing is normalised at query time.  What a query asks for is worked out once on
the driver from its one title and the catalog; each channel is a filter with an order
and a limit, and the channels' rows are united by id.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vacantia.durable import persist
from vacantia.functions import text as X
from vacantia.operators import titles as T
from vacantia.operators.filters import SearchFilters

# Order of kinds, tiers and words of a query's variants, limits.
KINDS = ["original", "normalized", "canonical", "synonym", "adjacent_concept", "family_broadening", "abbreviation", "fallback_variant"]
FIRST_TIER = ["software engineer", "software developer", "software development engineer", "backend engineer", "backend developer", "frontend engineer", "frontend developer", "full stack engineer", "full stack developer", "fullstack engineer", "fullstack developer"]
SECOND_TIER = ["application developer", "applications developer", "application engineer", "applications engineer", "application software engineer", "web application developer", "platform engineer", "platform developer", "java developer", "java engineer", "mobile engineer", "mobile developer", "member of technical staff", "mts", "api developer", "api engineer", "server engineer", "distributed systems engineer"]
SOFTWARE_ORDER = ["software engineer", "software developer", "software development engineer", "backend engineer", "frontend engineer", "full stack engineer", "application developer", "application engineer", "platform engineer", "java developer", "mobile engineer", "member of technical staff", "mts", "application software engineer", "web application developer", "api developer", "server engineer", "distributed systems engineer", "service engineer", "swe"]
LEAST_VARIANTS, LEAST_SOFTWARE_VARIANTS = 18, 20
ROLE_MATES = {"engineer": "developer", "developer": "engineer", "manager": "owner", "owner": "manager", "analyst": "scientist"}
GENERIC_WORDS = ["engineer", "developer", "manager", "analyst", "specialist", "designer", "architect", "consultant", "scientist", "administrator", "coordinator"]
CHANNELS = ["exact", "alias", "concept", "family_role", "phrase"]
CHANNEL_LIMIT = 5000
RUN = 4  # words of the longest run that is posted


@dataclass
class Variant:
    query: str
    kind: str
    tier: int
    family: str | None
    concept: str | None
    priority: int = 0


def tier_of(query: str, kind: str, family: str | None) -> int:
    if family == "software_engineering":
        return 1 if query in FIRST_TIER else 2 if query in SECOND_TIER else 3
    return 1 if kind in ("original", "normalized", "canonical", "synonym", "adjacent_concept") else 2 if kind in ("family_broadening", "abbreviation") else 3


def variant_order(v: Variant) -> tuple:
    kind = KINDS.index(v.kind)
    software = (SOFTWARE_ORDER.index(v.query) if v.query in SOFTWARE_ORDER else 100 + kind) if v.family == "software_engineering" else 1 << 53
    return v.tier, software, kind, v.priority, v.query


def swapped(base: str, groups: list[list[str]]) -> list[str]:
    """A title with words exchanged for others of their synonym groups."""
    tokens, out = base.split(), {}
    for group in (g for g in groups if len(g) > 1):
        met = [t for t in group if any(b == t or b in t or t in b for b in tokens)]
        for other in [s for s in group if s not in met][:3] if met else ():
            for old in met[:2]:
                made = " ".join(other if t == old or t in old else t for t in tokens)
                if made and made != base:
                    out[made] = None
    return list(out)


def analysis_of(spark: SparkSession, title: str, ready: T.Prepared):
    """The query's analysis: one row."""
    return T.analyze(spark.createDataFrame([(title,)], "title string"), ready).first()


def normalised(spark: SparkSession, phrases: list[str]) -> list[str]:
    """Normal forms of a query's few phrases, by the column function that the postings go through."""
    if not phrases:
        return []
    return [r["n"] for r in spark.createDataFrame(list(enumerate(phrases)), "i int, p string").select("i", X.normal_title(F.col("p")).alias("n")).orderBy("i").collect()]


def variants(spark: SparkSession, title: str, ready: T.Prepared, most: int = 16) -> list[Variant]:
    """Search phrases that a title stands for, best first: itself, its role's names, neighbours, words exchanged."""
    q, concepts = analysis_of(spark, title, ready), ready.plain()
    families = {f.name: f for f in ready.source.families}
    raw: list[tuple[str, str, str | None, str | None]] = [(q["normal"], "original", q["family"], q["concept"])]
    if q["stripped"] and q["stripped"] != q["normal"]:
        raw.append((q["stripped"], "normalized", q["family"], q["concept"]))
    base, own = q["stripped"] or q["normal"], concepts.get(q["concept"])
    spec = {c.name: c for c in ready.source.concepts}

    def names(c: dict, adjacent: bool) -> list[tuple[str, str, str, str]]:
        kind = lambda k: "adjacent_concept" if adjacent else k
        listed = [(c["title"], kind("canonical"))]
        if not adjacent:
            listed += [(d, broad_kind(c, d)) for d in spec[c["name"]].discovery]
        listed += [(a, kind("synonym")) for a in c["aliases"]] + [(a, kind("abbreviation")) for a in c["abbreviations"]] + [(s, kind("synonym")) for s in swapped(base, c["synonyms"])]
        return [(p, k, c["family"], c["name"]) for p, k in listed]

    def broad_kind(c: dict, phrase: str) -> str:
        if phrase == c["title"]:
            return "canonical"
        if phrase in c["aliases"] or phrase in c["abbreviations"]:
            return "synonym" if phrase in c["aliases"] else "abbreviation"
        return "adjacent_concept" if phrase in [concepts[a]["title"] for a in c["adjacent"] if a in concepts] else "family_broadening"

    if own:
        raw += names(own, False)
        for a in own["adjacent"] or []:
            raw += names(concepts[a], True) if a in concepts else []
        family = families.get(own["family"])
        raw += [(d, "family_broadening", own["family"], own["name"]) for d in (family.discovery if family and family.broadens else [])]
    else:
        raw += [(p, "fallback_variant", q["family"], None) for p in fallbacks(q, concepts, families)]
    normal = normalised(spark, [r[0] for r in raw])
    found: dict[str, Variant] = {}
    for phrase, (_, kind, family, concept) in zip(normal, raw):
        if phrase and phrase not in found:
            found[phrase] = Variant(phrase, kind, tier_of(phrase, kind, family or q["family"]), family, concept, len(found))
    kept = sorted(found.values(), key=variant_order)[: max(LEAST_SOFTWARE_VARIANTS if q["family"] == "software_engineering" else LEAST_VARIANTS, most)]
    for i, v in enumerate(kept):
        v.priority = i
    return kept


def fallbacks(q, concepts: dict[str, dict], families: dict[str, T.Family]) -> list[str]:
    """Phrases for a title without a role: modifiers with other head words, names of candidates that share a word, the family's anchor."""
    base, head, words = q["stripped"] or q["normal"], q["head"], list(q["words"] or [])
    mates = [b for a, b in T.STAND_INS if a == head]
    out: list[str] = []
    if head and words:
        for phrase in dict.fromkeys([" ".join(words), " ".join(words[1:])] if len(words) > 1 else [" ".join(words)]):
            out += [f"{phrase} {h}" for h in (head, *mates) if phrase]
    if head and mates:
        at = base.split()
        last = len(at) - 1 - at[::-1].index(head) if head in at else None
        out += [" ".join(mates[0] if i == last else t for i, t in enumerate(at))] if last is not None else []
    for name in (q["candidates"] or [])[:3]:
        c = concepts[name]
        if q["family"] and c["family"] != q["family"]:
            continue
        shares = lambda p: bool(set(p.split()) & set(words))
        out += [c["title"]] if not words or shares(c["title"]) else []
        out += [p for p in [*c["aliases"], *c["abbreviations"]] if shares(p)][:2]
    family = families.get(q["family"])
    if family and family.anchor and not (words and q["candidates"] and q["family"] == "software_engineering"):
        out.append(family.anchor)
    return [p for p in dict.fromkeys(out) if p and p != base]


def concept_ids(q, ready: T.Prepared) -> list[str]:
    """Roles of a title, their neighbours, and those of its family that share its group or touch one of them."""
    concepts, pairs = {c.name: c for c in ready.source.concepts}, set(T.adjacency(ready.source))
    seeds = [x for x in dict.fromkeys([q["concept"], *(q["concepts"] or []), *(q["candidates"] or [])[:6]]) if x]
    near = [a for s in seeds for a in concepts[s].adjacent]
    groups = {f.name: f.group for f in ready.source.families}
    kin = [c.name for c in concepts.values() if q["family"] and c.family == q["family"] and (not q["role_group"] or groups.get(c.family) == q["role_group"] or any(s == c.name or f"{s}>{c.name}" in pairs for s in seeds))]
    return list(dict.fromkeys([*seeds, *near, *kin]))


@dataclass
class Plan:
    """What a search asks of the index."""

    exact: list[str]
    alias: list[str]
    concepts: list[str]
    family: str | None
    role_group: str | None
    role_words: list[str]
    phrases: list[str]
    platforms: list[str] = field(default_factory=list)
    places: list[str] = field(default_factory=list)
    levels: list[str] = field(default_factory=list)
    mode: str = "balanced"
    unspecified: bool = False


def plan_of(spark: SparkSession, search: SearchFilters, ready: T.Prepared, places: list[str] = ()) -> Plan:
    """The plan of a search; ``places``: search keys of its location."""
    q = analysis_of(spark, search.title, ready)
    listed = variants(spark, search.title, ready, 64)
    canonical = ready.plain().get(q["concept"], {}).get("title")
    exact = [x for x in dict.fromkeys([q["normal"], q["stripped"], canonical]) if x]
    alias = [v.query for v in listed if v.kind in ("synonym", "abbreviation", "adjacent_concept")]
    phrases = [x for x in dict.fromkeys([*exact, *[v.query for v in listed][:24], *[w for w in q["words"] or [] if len(w) > 2 and w not in GENERIC_WORDS]]) if len(x) >= 2]
    words = [x for x in (q["head"], ROLE_MATES.get(q["head"])) if x]
    clean = search.clean()
    return Plan(exact, alias, concept_ids(q, ready), q["family"], q["role_group"], words, phrases, clean.platforms, list(places), clean.levels, clean.level_mode, clean.unspecified_levels)


def with_index(jobs: DataFrame, ready: T.Prepared) -> DataFrame:
    """``jobs`` (id, title, level, level_source, is_active, link_status, platform, location_keys) with a struct ``index`` of keys."""
    known = persist(T.analyze(jobs, ready))  # a row a distinct title
    concepts = ready.plain()
    named = F.create_map(*[x for k, c in concepts.items() for x in (F.lit(k), X.words([c["title"], *c["aliases"], *c["abbreviations"]]))]) if concepts else F.create_map().cast("map<string,array<string>>")
    none = F.array().cast("array<string>")
    parts = X.phrases(X.tokens(F.when(F.col("stripped") != "", F.col("stripped")).otherwise(F.col("normal"))), 1, 3)
    terms = F.array_distinct(F.filter(F.concat(F.array("normal", "stripped"), F.coalesce(F.try_element_at(named, F.col("concept")), none), parts), lambda t: t.isNotNull() & (t != "") & ~t.isin(GENERIC_WORDS)))
    ids = F.array_distinct(F.array_compact(F.concat(F.array("concept"), F.coalesce("concepts", none))))
    tagged = lambda tag, values: F.transform(values, lambda v: F.concat(F.lit(f"{tag}:"), v))
    keys = F.array_compact(F.concat(F.array(F.concat(F.lit("family:"), "family"), F.concat(F.lit("family_role:"), "family", F.lit(":"), "role_group")), tagged("concept", ids), tagged("term", terms)))
    titled = known.select(F.col("title").alias("__title"), F.struct(
        F.col("normal").alias("title_normalized"), F.when(F.col("stripped") != "", F.col("stripped")).otherwise(F.col("normal")).alias("title_stripped"), F.col("family").alias("title_family"),
        F.col("role_group").alias("title_role_group"), ids.alias("title_concepts"), terms.alias("title_terms"), keys.alias("title_keys"),
    ).alias("__titles"))
    level = F.array_compact(F.array(F.when(F.col("level").isNotNull(), F.concat(F.lit("experience:"), "level")).otherwise("experience:unspecified")))
    status = F.array_compact(F.array(F.when(F.col("is_active"), "status:active").when(~F.col("is_active"), "status:inactive"), F.concat(F.lit("link_status:"), "link_status"), F.concat(F.lit("platform:"), "platform")))
    of = lambda *tags: F.filter(F.coalesce("location_keys", none), lambda k: reduce(lambda a, b: a | b, [k.startswith(f"{t}:") for t in tags]))
    met = jobs.join(titled, F.col("title") == F.col("__title"), "left")
    index = F.struct(
        "__titles.*", of("country", "country_code").alias("country_keys"), of("region", "region_code").alias("region_keys"), of("city").alias("city_keys"),
        F.coalesce("location_keys", none).alias("location_keys"), level.alias("experience_keys"), status.alias("status_keys"),
    )
    return met.withColumn("index", index).drop("__title", "__titles")


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def base_clause(plan: Plan) -> Column:
    """Active or unsaid, of the platforms, and of the levels: stated ones, inferred ones unless strict, unsaid ones where asked for."""
    out = F.coalesce(F.col("is_active"), F.lit(True))
    if plan.platforms:
        out = out & _sure(F.col("platform").isin(plan.platforms))
    if plan.levels:
        stated = F.col("level").isin(plan.levels)
        usable = F.lit(plan.mode != "strict") | (F.col("level_source") == "explicit")
        unsaid = F.lit(plan.unspecified) & F.array_contains("index.experience_keys", "experience:unspecified")
        out = out & (_sure(stated & usable) | _sure(unsaid))
    return out


def place_clause(plan: Plan) -> Column:
    """A shared location key; none asked for takes all."""
    return _sure(F.arrays_overlap("index.location_keys", X.words(plan.places))) if plan.places else F.lit(True)


def channel_clauses(plan: Plan) -> dict[str, Column]:
    """The five ways in which a title may qualify; a channel without anything to look for takes nothing."""
    i = lambda n: F.col(f"index.{n}")

    def named(terms: list[str]) -> Column:
        if not terms:
            return F.lit(False)
        return i("title_normalized").isin(terms) | i("title_stripped").isin(terms) | F.arrays_overlap(i("title_terms"), X.words(terms))

    concept = F.arrays_overlap(i("title_concepts"), X.words(plan.concepts)) if plan.concepts else F.lit(False)
    role = F.lit(False)
    if plan.family and plan.role_group:
        words = i("title_stripped").isin(plan.role_words) | i("title_normalized").isin(plan.role_words) if plan.role_words else F.lit(False)
        role = (i("title_family") == plan.family) & ((i("title_role_group") == plan.role_group) | concept | words)
    pattern = "(^| )(" + "|".join(re.escape(p) for p in sorted(plan.phrases, key=lambda p: (-len(p), p))) + ")(?= |$)"
    phrase = i("title_normalized").rlike(pattern) if plan.phrases else F.lit(False)
    return {"exact": _sure(named(plan.exact)), "alias": _sure(named(plan.alias)), "concept": _sure(concept), "family_role": _sure(role), "phrase": _sure(phrase)}


def candidate_order() -> list[Column]:
    """Newest first by each date in turn, then the title."""
    return [*[F.desc_nulls_last(c) for c in ("posting_date", "posted_at", "last_seen", "crawled_at", "discovered_at")], F.asc("title")]


def candidates(indexed: DataFrame, plan: Plan, limit: int = CHANNEL_LIMIT) -> DataFrame:
    """Rows of all channels, each once, with the names of its channels; a channel takes its newest ``limit``.

    ``indexed`` is read once: a row goes to each of its channels, and a channel's place is
    limited before the shuffle, so that ``limit`` rows a task and channel leave it at most.
    """
    base = indexed.where(base_clause(plan) & place_clause(plan))
    names = F.array_compact(F.array(*[F.when(clause, F.lit(name)) for name, clause in channel_clauses(plan).items()]))
    row = F.struct(*indexed.columns).alias("__row")
    sent = base.select(row, F.explode(names).alias("__channel"))
    order = [*[F.desc_nulls_last(f"__row.{c}") for c in ("posting_date", "posted_at", "last_seen", "crawled_at", "discovered_at")], F.asc("__row.title"), F.asc("__row.id")]
    taken = sent.withColumn("__place", F.row_number().over(Window.partitionBy("__channel").orderBy(*order))).where(F.col("__place") <= limit)
    gathered = taken.groupBy(F.col("__row.id").alias("__id")).agg(F.any_value("__row").alias("__row"), F.array_sort(F.collect_set("__channel")).alias("channels"))  # at most five a row
    return gathered.select("__row.*", "channels")


def posting_rows(indexed: DataFrame) -> DataFrame:
    """``family, key, id``: what a posting can be found by, a row for each key; runs of up to RUN words of the normal title among them."""
    i = lambda n: F.col(f"index.{n}")
    none = F.array().cast("array<string>")
    tagged = lambda family, values: F.transform(F.coalesce(values, none), lambda v: F.struct(F.lit(family).alias("family"), v.alias("key")))
    kin = F.concat(
        F.array(F.concat_ws(":", F.lit("group"), "index.title_role_group"), F.concat_ws(":", F.lit("word"), "index.title_stripped"), F.concat_ws(":", F.lit("word"), "index.title_normalized")),
        F.transform(F.coalesce(i("title_concepts"), none), lambda c: F.concat(F.lit("concept:"), c)),
    )
    keys = F.concat(
        tagged("title", F.array_distinct(F.concat(F.array_compact(F.array(i("title_normalized"), i("title_stripped"))), F.coalesce(i("title_terms"), none)))), tagged("concept", i("title_concepts")),
        tagged("kin", F.transform(kin, lambda k: F.concat_ws("/", "index.title_family", k))), tagged("run", X.phrases(X.tokens(F.coalesce(i("title_normalized"), F.lit(""))), 1, RUN)), tagged("place", i("location_keys")),
    )
    return indexed.select("id", F.inline(F.filter(F.array_distinct(keys), lambda k: k["key"].isNotNull()))).select("family", "key", "id")


def stored_postings(indexed: DataFrame) -> DataFrame:
    """The postings as a table in folders by family, sorted by key, so that a probe reads the row groups of its keys only."""
    rows = posting_rows(indexed)
    return persist(rows.repartitionByRange("family", "key").sortWithinPartitions("family", "key"), partition_by=["family"]).select("family", "key", "id")


def channel_keys(plan: Plan) -> dict[str, list[str]]:
    """Keys by family of every posting that some channel can take; a long phrase by its first RUN words."""
    kin = []
    if plan.family and plan.role_group:
        kin = [f"{plan.family}/group:{plan.role_group}", *(f"{plan.family}/concept:{c}" for c in plan.concepts), *(f"{plan.family}/word:{w}" for w in plan.role_words)]
    found = {"title": [*plan.exact, *plan.alias], "concept": plan.concepts, "kin": kin, "run": [" ".join(p.split(" ")[:RUN]) for p in plan.phrases]}
    return {family: sorted(set(keys)) for family, keys in found.items() if keys}


def probe(postings: DataFrame, keys: dict[str, list[str]]) -> DataFrame:
    """``id`` of postings under any of the keys: a family is a folder, a key a range of its files."""
    if not keys:
        return postings.select("id").limit(0)
    return postings.where(reduce(lambda a, b: a | b, [(F.col("family") == f) & F.col("key").isin(k) for f, k in keys.items()])).select("id").distinct()


def found_candidates(postings: DataFrame, indexed: DataFrame, plan: Plan, limit: int = CHANNEL_LIMIT) -> DataFrame:
    """``candidates`` of the rows that the postings name: the same result, other rows are not tested."""
    ids = probe(postings, channel_keys(plan))
    if plan.places:
        ids = ids.join(probe(postings, {"place": list(plan.places)}), "id", "left_semi")
    return candidates(indexed.join(ids, "id", "left_semi"), plan, limit)
