"""Rule tables as columns: the first rule that holds, or all of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_match(value: Column, rules: list[tuple[str, str]], otherwise: Column | None = None) -> Column:
    """Label of the first (label, pattern) that occurs in ``value``."""
    out = None
    for label, pattern in rules:
        out = F.when(value.rlike(pattern), label) if out is None else out.when(value.rlike(pattern), label)
    return out if otherwise is None else out.otherwise(otherwise)


def all_matches(value: Column, rules: list[tuple[str, str]]) -> Column:
    """Labels of every (label, pattern) that occurs in ``value``, in order."""
    return F.array_compact(F.array(*[F.when(value.rlike(pattern), F.lit(label)) for label, pattern in rules]))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` mentions it."""
    return F.transform(F.array(value), lambda v: use(v)).getItem(0)
