"""Search filters as a small declarative tree that becomes one column.

A tree is a dict as in document stores: ``{"field": value}``, ``{"field": {"$gt": 1}}``,
``{"$or": [...]}``, ``{"$and": [...]}``. It compiles to column expressions, so Catalyst
pushes what it can to the scan. Comparisons reject nulls.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacantia.functions import experience
from vacantia.functions.text import comparable, contains_phrase, normal_title


def _type_at(schema: T.StructType, path: str) -> T.DataType | None:
    kind: T.DataType = schema
    for part in path.split("."):
        if not isinstance(kind, T.StructType) or part not in kind.names:
            return None
        kind = kind[part].dataType
    return kind


def _sure(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def compile_filter(tree: dict, schema: T.StructType) -> Column:
    """Boolean column of a filter tree; never null."""
    parts = []
    for key, want in tree.items():
        if key in ("$and", "$or"):
            inner = [compile_filter(t, schema) for t in want]
            parts.append(reduce(lambda a, b: (a & b) if key == "$and" else (a | b), inner, F.lit(key == "$and")) if inner else F.lit(key == "$and"))
            continue
        kind = _type_at(schema, key)
        value = F.col(key) if kind is not None else F.lit(None)
        parts.append(_leaf(value, kind, want))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def _leaf(value: Column, kind: T.DataType | None, want) -> Column:
    many = isinstance(kind, T.ArrayType)
    if not isinstance(want, dict):
        return value.isNull() if want is None else _sure(F.array_contains(value, want) if many else value == want)
    tests = []
    for op, x in want.items():
        if op == "$in":
            tests.append(_sure(F.arrays_overlap(value, F.array(*map(F.lit, x))) if many else value.isin(list(x))) if x else F.lit(False))
        elif op in ("$gt", "$gte", "$lt", "$lte"):
            tests.append(_sure({"$gt": value > x, "$gte": value >= x, "$lt": value < x, "$lte": value <= x}[op]))
        elif op == "$exists":
            tests.append(value.isNotNull() if x else value.isNull())
        elif op == "$regex":
            flags = "".join(f for f in want.get("$options", "") if f in "imsx")
            pattern = (f"(?{flags})" if flags else "") + x
            tests.append(_sure(F.exists(value, lambda v: v.rlike(pattern)) if many else value.rlike(pattern)))
        elif op == "$type":
            tests.append(F.lit(kind is not None and kind.typeName() == x) & value.isNotNull())
        elif op != "$options":
            raise ValueError(f"no operator {op}")
    return reduce(lambda a, b: a & b, tests, F.lit(True))


@dataclass
class SearchFilters:
    """What a search asks for; empty parts ask for nothing."""

    title: str = ""
    country: str | None = None
    region: str | None = None
    city: str | None = None
    platforms: list[str] = field(default_factory=list)
    levels: list[str] = field(default_factory=list)
    level_mode: str = "balanced"
    unspecified_levels: bool = False

    def clean(self) -> SearchFilters:
        """Trimmed, without blanks; levels in their order, all of them the same as none."""
        strip = lambda v: (v or "").strip() or None
        levels = [x for x in experience.LEVELS if x in self.levels]
        return SearchFilters(
            (self.title or "").strip(), strip(self.country), strip(self.region), strip(self.city), sorted({p.strip() for p in self.platforms if p.strip()}),
            [] if len(levels) == len(experience.LEVELS) else levels, self.level_mode, self.unspecified_levels,
        )


def candidates(filters: SearchFilters, phrases: list[str]) -> Column:
    """Cheap test over stored columns: active, platform, any of the title's phrases, place.

    Without a phrase nothing qualifies.
    """
    title = normal_title(F.col("title"))
    by_title = reduce(lambda a, b: a | b, [contains_phrase(title, p) for p in phrases], F.lit(False))
    place = F.lit(True)
    for name in ("country", "region", "city"):
        if wanted := getattr(filters, name):
            place = place & (comparable(F.col(name)) == comparable(F.lit(wanted)))
    platform = F.col("platform").isin(filters.platforms) if filters.platforms else F.lit(True)
    return F.coalesce(F.col("is_active"), F.lit(True)) & _sure(platform) & by_title & _sure(place)


def exclusion(title_score: Column, place: Column, level: Column, least: int = 420) -> Column:
    """First reason to leave a row out: title, location, experience; null if it stays."""
    return F.when(~_sure(title_score >= least), "title").when(~_sure(place), "location").when(~_sure(level), "experience")


def with_counts(rows: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that stay, and how many were left out for which reason."""
    marked = rows.withColumn("reason", reason)
    return marked.where(F.col("reason").isNull()).drop("reason"), marked.groupBy("reason").count()
