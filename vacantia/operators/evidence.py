"""Where a job is, from weighted evidence: stated fields, the location's text, metadata, descriptions.

Every piece of evidence is a candidate ``source, value, priority``; candidates of all
rows are resolved together against the gazetteer in one join, scored, and brought
together per row.  A row's candidates are as many as its own fields and metadata have.
Metadata of any shape is walked by a small Arrow function, as its depth is not known.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacantia.operators import places as G
from vacantia.sources.structured import joined_place

# Keys, path words and weights of evidence.
DIRECT_KEYS = ["location", "locationName", "locationText", "jobLocationText", "formattedLocation", "formattedAddress", "address", "allLocations"]
CITY_KEYS, STATE_KEYS, COUNTRY_KEYS = ["city", "addressLocality", "locality"], ["state", "stateName", "region", "addressRegion"], ["country", "countryName", "addressCountry"]
PATH = re.compile(r"(location|address|city|state|country|region|office|workplace|remote)", re.I)
OFFICE = re.compile(r"(office|offices)", re.I)
DESCRIPTION = re.compile(r"(description|summary|overview|requirements|qualifications|content)", re.I)
HINT = re.compile(r"(remote|located|location|\bresid(?:e|es|ing)\b|eligible|eligibility|must be in|within|based\s+(?:in|out of|within|near))", re.I)
MODE_PATH, MODE = re.compile(r"\bworkplace(?:Type|Mode)?\b", re.I), re.compile(r"^(?:remote|hybrid|onsite|on site)$", re.I)
ELIGIBLE = r"(?i)\b(remote|remotely|eligible|eligibility|work within|within)\b"
STRUCTURED = [100, 96, 88, 82, 78]
TEXT_PRIORITY, LONGEST_HINT = 94, 180
PRIORITIES = {"office_record": 80, "office": 78, "record": 74, "metadata": 72, "remote_hint": 62, "description": 58}
CONFIDENCE = {"high": 48, "medium": 24, "low": 8, "none": 0}
CITY_POINTS, STATE_POINTS = 12, 14
AMBIGUOUS_CODES = ["AS", "CA", "HI", "ID", "IN", "ME", "OR"]

EVIDENCE = T.ArrayType(T.StructType([T.StructField("source", T.StringType()), T.StructField("value", T.StringType()), T.StructField("priority", T.IntegerType())]))


def is_ambiguous_code(value: Column) -> Column:
    """Codes of states that are words or countries as well."""
    return F.coalesce(F.upper(F.trim(value)).isin(AMBIGUOUS_CODES), F.lit(False))


def hints(text: str) -> list[str]:
    """Sentences of a description that may name a place."""
    parts = (p.strip() for p in re.split(r"[.\n;]+", text))
    return [p for p in parts if 0 < len(p) <= LONGEST_HINT and HINT.search(p)]


def _walk(node, path: str) -> Iterator[tuple[str, str, int]]:
    if isinstance(node, list):
        for x in node:
            yield from _walk(x, path)
    elif isinstance(node, str):
        if MODE_PATH.search(path) and MODE.match(node.strip()):
            return
        if DESCRIPTION.search(path):
            for h in hints(node):
                source = "remote_hint" if re.search(r"\bremote\b", h, re.I) else "description"
                yield source, h, PRIORITIES[source]
        elif PATH.search(path):
            office = bool(OFFICE.search(path))
            yield ("office_metadata" if office else "metadata"), node, PRIORITIES["office" if office else "metadata"]
    elif isinstance(node, dict):
        first = lambda keys: next((node[k].strip() for k in keys if isinstance(node.get(k), str) and node[k].strip()), None)
        whole = first(DIRECT_KEYS) or ", ".join(filter(None, map(first, (CITY_KEYS, STATE_KEYS, COUNTRY_KEYS))))
        office = bool(OFFICE.search(path))
        if whole:
            yield ("office_metadata" if office else "metadata"), whole, PRIORITIES["office_record" if office else "record"]
        for k, v in node.items():
            yield from _walk(v, f"{path}.{k}" if path else k)


@F.pandas_udf(EVIDENCE)
def metadata_evidence(bodies: pd.Series) -> pd.Series:
    """Candidates in metadata (JSON text), in the order of the walk."""

    def one(body):
        try:
            found = _walk(json.loads(body), "") if body else ()
            return [{"source": s, "value": v, "priority": p} for s, v, p in found]
        except ValueError:
            return []

    return bodies.map(one)


def candidates(rows: DataFrame, identity: str) -> DataFrame:
    """``identity, n, source, value, priority`` of rows with country, state, city, location and metadata; repeated values of a source once."""
    c = lambda n: F.nullif(F.trim(F.col(n)), F.lit(""))
    stated = [joined_place(c("city"), c("state"), c("country")), joined_place(c("city"), c("state")), c("country"), c("state"), c("city")]
    piece = lambda source, value, priority: F.struct(F.lit(source).alias("source"), F.nullif(value, F.lit("")).alias("value"), F.lit(priority).cast("int").alias("priority"))
    fixed = F.array(*[piece("structured_fields", v, p) for v, p in zip(stated, STRUCTURED)], piece("location_text", c("location"), TEXT_PRIORITY))
    every = F.concat(fixed, F.coalesce(metadata_evidence("metadata"), F.array().cast(EVIDENCE)))
    flat = rows.select(identity, F.posexplode(every).alias("n", "e")).select(identity, "n", "e.source", F.trim("e.value").alias("value"), "e.priority").where("value is not null and value <> ''")
    key = ["source", "__key"]
    first = flat.withColumn("__key", G.normal_place(F.col("value"))).groupBy(identity, *key).agg(F.min_by(F.struct("n", "value", "priority"), "n").alias("f"))
    return first.select(identity, "f.n", "source", "f.value", "f.priority")


def confidence(source: Column, city: Column, region: Column, remote: Column, whole_country: Column) -> Column:
    """How sure a candidate is, by where it comes from and what it names."""
    precise = city.isNotNull() | region.isNotNull() | whole_country
    return (
        F.when(source.isin("structured_fields", "location_text", "office_metadata") & precise, "high")
        .when(region.isNotNull() | whole_country | (remote & (source != "description")), "medium").when(source == "description", "low").otherwise("medium")
    )


def resolved_candidates(found: DataFrame, gazetteer: DataFrame, identity: str, home: str = "United States") -> DataFrame:
    """Candidates that name a place, with point, remote, role, confidence and score; ``home`` is the country whose bare name makes evidence firm."""
    keyed = found.withColumn("__c", F.struct(identity, "n"))
    placed = G.resolve(keyed, gazetteer, "__c", "value").where(F.size("points") > 0)
    met = keyed.join(placed.select("__c", F.element_at("points", 1).alias("point"), (F.col("workplace") == "remote").alias("remote")), "__c")
    p = F.col("point")
    bare = p["city"].isNull() & p["region"].isNull() & (p["country"] == home) & (G.normal_place(F.col("value")) == G.normal_place(F.lit(home)))
    sure = confidence(F.col("source"), p["city"], p["region"], F.col("remote"), F.coalesce(bare, F.lit(False)))
    eligible = (F.col("source") == "remote_hint") | ((F.col("source") == "description") & F.col("value").rlike(ELIGIBLE)) | F.col("remote")
    weight = F.coalesce(*[F.when(sure == k, v) for k, v in CONFIDENCE.items()])
    score = F.col("priority") + weight + F.when(p["city"].isNotNull(), CITY_POINTS).otherwise(0) + F.when(p["region"].isNotNull(), STATE_POINTS).otherwise(0)
    return met.select(identity, "n", "source", "value", "priority", "point", "remote", F.when(eligible, "eligibility").otherwise("physical").alias("role"), sure.alias("confidence"), score.cast("int").alias("score"))


def _distinct_by(items: Column, key) -> Column:
    """Items in order, of those with one key the first."""
    keys = F.transform(items, key)
    return F.filter(items, lambda x, i: F.array_position(keys, key(x)) == i + 1)


def conflicts(physical: Column, eligible: Column) -> Column:
    """``country_conflict`` for several physical countries, ``physical_remote_conflict`` where eligibility goes beyond them."""
    beyond = F.array_except(eligible, physical)
    return F.array_compact(F.array(
        F.when(F.size(physical) > 1, F.struct(F.lit("country_conflict").alias("kind"), physical.alias("countries"))),
        F.when((F.size(physical) > 0) & (F.size(beyond) > 0), F.struct(F.lit("physical_remote_conflict").alias("kind"), F.array_distinct(F.concat(physical, eligible)).alias("countries"))),
    ))


def resolve_evidence(rows: DataFrame, gazetteer: DataFrame, identity: str, home: str = "United States") -> DataFrame:
    """``identity, country, region, city, remote, confidence, evidence, points, eligible, conflicts`` of every row.

    The best physical candidate gives the place, else the best of any; with none, what is
    stated stands as it is, of low confidence. Evidence: the first four distinct pieces.
    """
    found = candidates(rows, identity)
    best_first = F.struct((-F.col("score")).alias("score"), (-F.col("priority")).alias("priority"), "n", "source", "value", "point", "remote", "role", "confidence")
    gathered = resolved_candidates(found, gazetteer, identity, home).groupBy(identity).agg(F.array_sort(F.collect_list(best_first)).alias("c"))  # a row's own evidence
    physical = F.filter("c", lambda x: x["role"] == "physical")
    as_point = lambda x: F.struct(x["point"]["country"].alias("country"), x["point"]["region"].alias("region"), x["point"]["city"].alias("city"), x["confidence"].alias("confidence"))
    points = _distinct_by(F.transform(physical, as_point), lambda p: F.concat_ws("|", *[F.coalesce(G.normal_place(p[k]), F.lit("")) for k in ("country", "region", "city")]))
    eligible = F.array_distinct(F.transform(F.filter("c", lambda x: x["role"] == "eligibility"), lambda x: x["point"]["country"]))
    evidence = F.slice(_distinct_by(F.transform("c", lambda x: F.struct(x["source"].alias("source"), x["value"].alias("value"))), lambda e: F.concat(e["source"], F.lit(":"), G.normal_place(e["value"]))), 1, 4)
    summed = gathered.select(
        F.col(identity).alias("__id"), points.alias("points"), eligible.alias("eligible"), evidence.alias("evidence"), F.exists("c", lambda x: x["remote"]).alias("remote"),
        F.coalesce(F.try_element_at(points, F.lit(1)), as_point(F.element_at("c", 1))).alias("best"),
    )
    c = lambda n: F.nullif(F.trim(F.col(n)), F.lit(""))
    known = F.col("best").isNotNull()
    stated = F.when(F.coalesce(c("country"), c("state"), c("city")).isNotNull(), "low").otherwise("none")
    said_remote = F.coalesce(F.concat_ws(" ", "location", "city", "metadata").rlike(r"(?i)\bremote\b"), F.lit(False))
    out = rows.select(identity, "country", "state", "city", "location", "metadata").join(summed, F.col(identity) == F.col("__id"), "left")
    pick = lambda field, column: F.when(known, F.col(f"best.{field}")).otherwise(c(column)).alias(field)
    countries = F.array_distinct(F.transform("points", lambda p: p["country"]))
    lone = F.when(c("country").isNotNull(), F.array(F.struct(c("country").alias("country"), c("state").alias("region"), c("city").alias("city"), F.lit("low").alias("confidence"))))
    return out.select(
        identity, pick("country", "country"), pick("region", "state"), pick("city", "city"), F.when(known, F.col("remote")).otherwise(said_remote).alias("remote"),
        F.when(known, F.col("best.confidence")).otherwise(stated).alias("confidence"), F.coalesce("evidence", F.array().cast("array<struct<source:string,value:string>>")).alias("evidence"),
        F.coalesce("points", lone, F.array().cast("array<struct<country:string,region:string,city:string,confidence:string>>")).alias("points"),
        F.coalesce("eligible", F.array().cast("array<string>")).alias("eligible"), F.when(known, conflicts(countries, F.col("eligible"))).alias("conflicts"),
    )


def split_location(text: Column, place: Column, is_region: Column, home: str = "United States") -> Column:
    """Struct of city, state, country and text of "city, state, country" texts.

    ``place``: what the text resolves to (struct of country, region, city, remote),
    ``is_region``: column function that names the home country's region of a part.
    """
    cleaned = F.trim(F.coalesce(text, F.lit("")))
    parts = F.filter(F.transform(F.split(cleaned, ","), lambda p: F.trim(p)), lambda p: p != "")
    n, at = F.size(parts), lambda i: F.try_element_at(parts, F.lit(i))
    remote, at_home = F.coalesce(place["remote"], F.lit(False)), F.coalesce(place["country"] == home, F.lit(False))
    region = F.when(at_home, place["region"])
    named = F.when(at_home, place["city"])
    second = is_region(at(2))
    none = F.lit(None).cast("string")
    city = F.when((n == 0) | remote, none).when(n == 1, named).when((n == 2) & (G.normal_place(at(1)) == "remote"), none).otherwise(F.coalesce(named, at(1)))
    state = F.when(n == 0, none).when(n == 1, region).when(n == 2, F.coalesce(region, second)).otherwise(F.coalesce(region, second, at(2)))
    country = F.when(n == 0, none).when(at_home | ((n == 2) & second.isNotNull()), home).when(n == 1, none).when(n == 2, at(2)).otherwise(at(3))
    shown = F.when(cleaned == "", "Location unavailable").when(n == 1, at(1)).otherwise(cleaned)
    return F.struct(city.alias("city"), state.alias("state"), country.alias("country"), shown.alias("location_text"))


def location_terms(intent: G.Intent, most: int = 32) -> list[str]:
    """Search phrases for a place, the narrowest first, remote forms where they are asked for; at most ``most``."""
    if intent.scope == "none":
        return []
    if intent.text:
        return [intent.text]
    levels = [x for x in (intent.city, intent.region, intent.country) if x]
    plain = [", ".join(levels), *([f"{intent.city}, {intent.country}"] if intent.city and intent.country else []), *levels]
    remote = ["Remote", "Remote worldwide"] if not levels else [f for x in levels for f in (f"Remote {x}", f"Remote in {x}", f"{x} Remote")]
    return list(dict.fromkeys(remote if intent.remote else plain))[:most]


def parse_location_input(value: str, places: list[dict]) -> dict[str, str]:
    """City, state and country of what a reader types; remote is a city, unknown words are a city."""
    parts = [p.strip() for p in (value or "").split(",") if p.strip()]
    if not parts:
        return {"city": "", "state": "", "country": ""}
    country_of = lambda p: next((x["country"] for x in places if not x.get("region") and not x.get("city") and p.lower() in {x["country"].lower(), (x.get("country_code") or "").lower(), *(a.lower() for a in x.get("aliases") or [])}), None)
    if len(parts) == 1:
        intent = G.parse_intent(parts[0], places)
        if intent.remote and not intent.city:
            return {"city": "Remote", "state": "", "country": intent.country or ""}
        if intent.scope == "country":
            return {"city": "", "state": "", "country": intent.country}
        return {"city": intent.city or parts[0], "state": intent.region or "", "country": intent.country or ""}
    if len(parts) == 2:
        if re.search(r"\bremote\b", parts[0], re.I):
            return {"city": "Remote", "state": "", "country": country_of(parts[1]) or parts[1]}
        if known := country_of(parts[1]):
            return {"city": parts[0], "state": "", "country": known}
        return {"city": parts[0], "state": parts[1], "country": ""}
    rest = ", ".join(parts[2:])
    return {"city": parts[0], "state": parts[1], "country": country_of(rest) or rest}


def intent_of(country: str | None, state: str | None, city: str | None, places: list[dict]) -> G.Intent:
    """Intent of a search's three fields."""
    return G.parse_intent(", ".join(x.strip() for x in (city, state, country) if x and x.strip()), places)
