"""Identity keys of a posting.

Strong keys name one posting at its source (platform, board and job id, or a URL); the
weak key is a fingerprint that is used only where no board and job id are known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.functions.text import comparable
from vacantia.functions.urls import url_hash


def _nonempty(value: Column) -> Column:
    return F.when(value != "", value)


def _last_token(url: Column) -> Column:
    """The last part of a URL in comparable form, unless it is a number."""
    parts = F.filter(F.transform(F.split(url, "[/?#]"), comparable), lambda p: p != "")
    last = F.try_element_at(parts, F.lit(-1))
    return F.when(~last.rlike(r"^\d+$"), last)


def board_token(platform: Column, lookup_keys: Column, slug: Column, source_url: Column, apply_url: Column) -> Column:
    """Board of a posting: from a lookup key platform:board:id, its slug, or the end of its URLs."""
    split = F.transform(F.coalesce(lookup_keys, F.array().cast("array<string>")), lambda k: F.filter(F.transform(F.split(k, ":"), comparable), lambda p: p != ""))
    fitting = F.filter(split, lambda p: (F.size(p) >= 3) & (F.try_element_at(p, F.lit(1)) == comparable(platform)))
    named = F.try_element_at(F.transform(fitting, lambda p: F.element_at(p, 2)), F.lit(1))
    return F.coalesce(named, _nonempty(comparable(slug)), _last_token(source_url), _last_token(apply_url))


def with_identity(jobs: DataFrame) -> DataFrame:
    """Add ``canonical_key, strong_keys, weak_key, has_strong``.

    Reads platform, company_slug, source_job_id, lookup_keys, source_url, apply_url,
    resolved_url, canonical_url, company, title, location and fingerprint.
    """
    c = F.col
    board = board_token(c("platform"), c("lookup_keys"), c("company_slug"), c("source_url"), c("apply_url"))
    job_id = comparable(c("source_job_id"))
    named = _nonempty(job_id).isNotNull() & board.isNotNull()
    explicit = F.when(named, F.concat_ws(":", c("platform"), board, job_id))
    url = url_hash(F.coalesce("canonical_url", "resolved_url", "apply_url", "source_url"))
    parts = F.array(comparable(c("company")), comparable(c("title")), comparable(c("location")), F.concat(F.lit("url:"), url))
    fingerprint = F.coalesce(_nonempty(comparable(c("fingerprint"))), F.array_join(F.filter(F.array_compact(parts), lambda p: p != ""), "|"))
    lookups = F.filter(F.transform(F.coalesce("lookup_keys", F.array().cast("array<string>")), comparable), lambda k: k != "")
    platform_keys = F.concat(F.array_compact(F.array(explicit)), lookups)
    bare = F.array_compact(F.array(F.when(job_id != "", F.concat_ws(":", c("platform"), job_id))))
    platform_keys = F.when(F.size(platform_keys) > 0, platform_keys).otherwise(bare)
    canonical = F.when(named, F.concat(F.lit("platform:"), explicit)).otherwise(F.concat(F.lit("fallback:"), fingerprint))
    urls = [F.concat(F.lit(f"{k}:"), _nonempty(c(f"{k}_url"))) for k in ("canonical", "resolved", "apply", "source")]
    return (
        jobs.withColumn("canonical_key", canonical)
        .withColumn("strong_keys", F.array_distinct(F.concat(F.array_compact(F.array(c("canonical_key"), *urls)), F.transform(platform_keys, lambda k: F.concat(F.lit("platform_job:"), k)))))
        .withColumn("weak_key", F.concat(F.lit("fallback:"), fingerprint))
        .withColumn("has_strong", ~c("canonical_key").startswith("fallback:"))
    )
