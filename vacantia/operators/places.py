"""Places: search keys, resolution of location texts through a gazetteer, and matching.

The gazetteer is a parameter: a table ``country, country_code, region, region_code, city,
aliases``, one row a place, null where a level is missing.  Texts are cut at commas,
slashes, bars and dashes; the parts meet the gazetteer in one equi-join on the normal
form of the alias, whose size decides whether Spark broadcasts it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.functions.text import ascii_folded

REMOTE = r"(?i)\b(remote|remotely|work from home|distributed|anywhere)\b"
HYBRID = r"(?i)\bhybrid\b"
ONSITE = r"(?i)\b(onsite|on[- ]site|in[- ]office)\b"
WORKPLACE = r"(?i)\b(remote|remotely|work from home|in|within|only|onsite|on site|hybrid)\b"
POINT = ["country", "country_code", "region", "region_code", "city"]


def normal_place(value: Column) -> Column:
    """Without accents, lower case, everything but letters and digits a space."""
    return F.trim(F.regexp_replace(F.lower(ascii_folded(value)), "[^a-z0-9]+", " "))


def _key(*parts: Column | str) -> Column:
    """Parts joined by colons; null if one is missing or blank."""
    columns = [F.lit(p) if isinstance(p, str) else F.nullif(normal_place(p), F.lit("")) for p in parts]
    whole = columns[0]
    for c in columns[1:]:
        whole = F.concat(whole, F.lit(":"), c)
    return whole


def point_keys(country: Column, code: Column, region: Column, region_code: Column, city: Column, remote: bool = False) -> Column:
    """Search keys of a place, the widest first."""
    keys = [
        _key("country", country), _key("country_code", code), _key("region", country, region), _key("region_code", country, region_code),
        _key("city", country, region, city), _key("city", country, city),
    ]
    if remote:
        keys += [
            F.when(F.coalesce(normal_place(country), F.lit("")) == "", "remote_global"), _key("remote_country", country), _key("remote_region", country, region),
            _key("remote_city", country, region, city), _key("remote_city", country, city),
        ]
    return F.array_distinct(F.array_compact(F.array(*keys)))


def workplace(value: Column) -> Column:
    v = F.coalesce(value, F.lit(""))
    return F.when(v.rlike(REMOTE), "remote").when(v.rlike(HYBRID), "hybrid").when(v.rlike(ONSITE), "onsite").otherwise("unknown")


def aliases(gazetteer: DataFrame) -> DataFrame:
    """``alias, level`` and the place, one row an alias; level 3 city, 2 region, 1 country."""
    level = F.when(F.col("city").isNotNull(), 3).when(F.col("region").isNotNull(), 2).otherwise(1)
    name = F.coalesce("city", "region", "country")
    code = F.when(F.col("city").isNull(), F.coalesce(F.when(F.col("region").isNotNull(), F.col("region_code")), F.when(F.col("region").isNull(), F.col("country_code"))))
    every = F.array_distinct(F.filter(F.transform(F.array_compact(F.concat(F.array(name, code), F.coalesce("aliases", F.array().cast("array<string>")))), normal_place), lambda a: a != ""))
    return gazetteer.select(F.explode(every).alias("alias"), level.alias("level"), *POINT)


def resolve(rows: DataFrame, gazetteer: DataFrame, identity: str, text: str) -> DataFrame:
    """``identity, workplace, points, keys, global_remote, conflict`` of location texts.

    Of the places that the parts of a text name, one that agrees with a country and a
    region named beside it is kept; cities win over regions, regions over countries.
    """
    plain = F.regexp_replace(F.col(text), WORKPLACE, " ")
    parts = F.array_distinct(F.concat(F.transform(F.split(plain, r"[,/|;\n]|\s+-\s+"), normal_place), F.array(normal_place(plain))))
    split = rows.select(identity, F.explode(F.filter(parts, lambda p: p != "")).alias("alias"))
    hits = split.join(aliases(gazetteer), "alias").groupBy(identity).agg(F.collect_set(F.struct("level", *POINT)).alias("hits"))  # as many as a text has parts
    of = lambda n: F.filter("hits", lambda h: h["level"] == n)
    countries, regions = F.transform(of(1), lambda h: h["country"]), F.transform(of(2), lambda h: h["region"])
    fits = lambda h: ((F.size(countries) == 0) | F.array_contains(countries, h["country"])) & ((F.size(regions) == 0) | (h["level"] < 3) | F.coalesce(F.array_contains(regions, h["region"]), F.lit(False)))
    city, region, country = (F.filter(of(n), fits) for n in (3, 2, 1))
    points = F.when(F.size(city) > 0, city).when(F.size(region) > 0, region).otherwise(country)
    points = F.array_sort(F.transform(points, lambda h: F.struct(*[h[c].alias(c) for c in POINT])))
    out = rows.select(identity, text).join(hits, identity, "left").select(
        identity, workplace(F.col(text)).alias("workplace"), F.coalesce(points, F.expr("array()").cast(f"array<struct<{','.join(f'{c}:string' for c in POINT)}>>")).alias("points"),
        F.coalesce(F.col(text).rlike(REMOTE) & F.col(text).rlike(r"(?i)\b(worldwide|global|anywhere)\b"), F.lit(False)).alias("global_remote"),
    )
    remote = F.col("workplace") == "remote"
    keys = lambda flag: F.flatten(F.transform("points", lambda p: point_keys(*[p[c] for c in POINT], remote=flag)))
    return out.select(
        "*", F.array_distinct(F.concat(F.when(remote, keys(True)).otherwise(keys(False)), F.when(F.col("global_remote"), F.array(F.lit("remote_global"))).otherwise(F.array().cast("array<string>")))).alias("keys"),
        (F.size(F.array_distinct(F.transform("points", lambda p: p["country"]))) > 1).alias("conflict"),
    )


@dataclass
class Intent:
    """Where a search looks: a place, perhaps remote; nothing at all takes every row."""

    country: str | None = None
    region: str | None = None
    city: str | None = None
    remote: bool = False
    text: str | None = None

    @property
    def scope(self) -> str:
        if self.text:
            return "ambiguous"
        level = "city" if self.city else "region" if self.region else "country" if self.country else ""
        return (f"remote_{level}" if level else "global_remote") if self.remote else level or "none"


def parse_intent(value: str | None, places: list[dict]) -> Intent:
    """Intent of one location text; ``places``: gazetteer rows as dicts. Unknown texts must match word for word."""
    raw = (value or "").strip()
    remote = bool(re.search(REMOTE, raw))
    plain = lambda t: " ".join(re.findall("[a-z0-9]+", t.lower()))
    bare = re.sub(WORKPLACE, " ", raw)
    if not plain(bare) or remote and plain(bare) in ("global", "worldwide"):
        return Intent(remote=remote)
    parts = {plain(p) for p in re.split(r"[,/|;]|\s+-\s+", bare)} | {plain(bare)}
    names = lambda p, *keys: {plain(x) for k in keys if (x := p.get(k))} | ({plain(a) for a in p.get("aliases") or []})
    level = lambda p: 3 if p.get("city") else 2 if p.get("region") else 1
    keys = {1: ("country", "country_code"), 2: ("region", "region_code"), 3: ("city",)}
    hits = {n: [p for p in places if level(p) == n and names(p, *keys[n]) & parts] for n in (1, 2, 3)}
    countries, regions = {p["country"] for p in hits[1]}, {p["region"] for p in hits[2]}
    fit = [p for p in hits[3] if (not countries or p["country"] in countries) and (not regions or p["region"] in regions)]
    fit = fit or [p for p in hits[2] if not countries or p["country"] in countries] or hits[1]
    if not fit or len(fit) > 1 and not countries and not regions:
        return Intent(text=plain(bare), remote=remote)
    return Intent(fit[0]["country"], fit[0].get("region"), fit[0].get("city"), remote)


def matches(intent: Intent, points: Column, eligible: Column, workplace_: Column, global_remote: Column, text: Column) -> Column:
    """Whether a posting's places meet an intent.

    A remote intent needs eligibility there; a country also takes eligibility where no
    physical place is known; a text must stand in the location word for word.
    """
    same = lambda a, b: normal_place(a) == normal_place(F.lit(b))

    def at(places: Column) -> Column:
        wanted = [(n, getattr(intent, n)) for n in ("country", "region", "city") if getattr(intent, n)]
        test = lambda p: reduce(lambda a, b: a & b, [same(p[n], v) for n, v in wanted])
        return F.coalesce(F.exists(places, test), F.lit(False))

    if intent.scope == "none":
        return F.lit(True)
    if intent.scope == "ambiguous":
        return F.concat(F.lit(" "), normal_place(text), F.lit(" ")).contains(f" {intent.text} ")
    if intent.scope == "global_remote":
        return global_remote | (F.size(eligible) > 0) | (workplace_ == "remote")
    if intent.remote:
        return at(eligible)
    if intent.scope == "country":
        return at(points) | ((F.size(points) == 0) & at(eligible))
    return at(points)
