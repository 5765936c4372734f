"""JSON under one spelling: names in order at any depth, no blanks, plain escapes.

A VARIANT keeps an object's fields by name in the order of their UTF-8 bytes, so writing
one out again orders every level in one pass on the JVM side; arrays keep their order.

Defined results: a number with a fraction of zeros is the whole number and trailing zeros
go (``1.0`` is ``1``); one with an exponent stays a double (``1e2`` is ``100.0``).  A null
stays a null, which is not the same as a name left out.  What is no JSON, repeats a name
within an object or is too large for a VARIANT has no canonical form; for ``stable`` and
``content_hash`` it stands for itself.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_json(text: Column) -> Column:
    """The one spelling of a JSON text; null if there is none."""
    return F.to_json(F.try_parse_json(text))


def stable(text: Column) -> Column:
    """The one spelling, or the text itself."""
    return F.coalesce(canonical_json(text), text)


def stable_struct(*columns: str, json: tuple[str, ...] = ()) -> Column:
    """Columns as one JSON object in one spelling; those in ``json`` hold JSON texts and count by their content."""
    fields = [(stable(F.col(c)) if c in json else F.col(c)).alias(c) for c in sorted(columns)]
    return stable(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}))


def content_hash(text: Column) -> Column:
    """SHA-256 (lowercase hex) of the one spelling."""
    return F.sha2(stable(text), 256)
