"""The write path of stored records: folds of records with one key, inventory upserts, observations, counters, repairs.

A fold of many records is an aggregate, not a loop: the best record gives a field, the
next best fills its gaps, arrays are united, dates widen.  Partial aggregation keeps a
key with very many records from meeting in one task as rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.functions import dates
from vacantia.operators.identity import with_identity
from vacantia.operators.resolve import dedupe, quality

URLS = ["canonical_url", "resolved_url", "apply_url", "source_url"]
ARRAYS = ["lookup_keys", "run_ids", "provenance"]
EARLIEST, LATEST = ["first_seen", "discovered_at"], ["last_seen", "indexed_at", "crawled_at", "posting_date", "posted_at"]


def record_rank(columns: list[str]) -> Column:
    """Struct that orders records of one key, the best highest, over the columns that there are.

    In turn: link and URL score, number of URLs, of provenances, of lookup keys, of runs,
    later last sight, earlier first sight, smaller id; of records that agree in all of it
    the first to arrive, where ``arrival`` says so.
    """
    has = set(columns)
    at = lambda c: F.col(c) if c in has else F.lit(None).cast("string")
    n = lambda c: F.coalesce(F.size(c), F.lit(0)) if c in has else F.lit(0)
    urls = sum((F.coalesce((at(c) != "").cast("int"), F.lit(0)) for c in URLS), F.lit(0))
    millis = lambda c, otherwise: F.coalesce(F.unix_millis(at(c)), F.lit(otherwise)) if c in has else F.lit(0)
    return F.struct(
        quality(at("link_status"), at("resolved_url"), at("canonical_url"), at("validated_at")).alias("score"), urls.alias("urls"), n("provenance").alias("provenance"),
        n("lookup_keys").alias("keys"), n("run_ids").alias("runs"), millis("last_seen", -(1 << 62)).alias("last"), (-millis("first_seen", -(1 << 62))).alias("first"), (-F.col("pos")).alias("pos"),
        *([(-F.col("arrival")).alias("arrival")] if "arrival" in has else []),
    )


def folded(rows: DataFrame, key: str = "canonical_key", any_active: bool = True) -> DataFrame:
    """One record a key from all of its rows, which ``pos`` numbers in order of arrival.

    ``is_active`` holds if any is active, or as the last row has it; a closing date stays
    only where the record is not active, and is the last sight where none is known.
    """
    ranked = rows.withColumn("__rank", record_rank(rows.columns))
    special = {key, "pos", "arrival", "is_active", "closed_at", *ARRAYS, *EARLIEST, *LATEST}
    given = [c for c in rows.columns if c in special and c not in (key, "pos")]
    plain = [c for c in rows.columns if c not in special]
    first = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("__rank"))).alias(c)
    how = {c: F.min(c) for c in EARLIEST} | {c: F.max(c) for c in LATEST} | {"closed_at": F.max("closed_at"), "arrival": F.min("arrival")}
    how |= {c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))) for c in ARRAYS}  # distinct sets: what a key has, not its rows
    how["is_active"] = F.bool_or("is_active") if any_active else F.max_by("is_active", "pos")
    merged = ranked.groupBy(key).agg(
        F.max_by("pos", "__rank").alias("pos"), F.count("*").alias("records"), *map(first, plain), *[how[c].alias(c) for c in given]
    )
    if "closed_at" in given:
        last = F.col("last_seen") if "last_seen" in given else F.lit(None).cast("timestamp")
        merged = merged.withColumn("closed_at", F.when(~F.coalesce("is_active", F.lit(False)), F.coalesce("closed_at", last)))
    return merged.select(*rows.columns, "records")


def coalesced(batch: DataFrame, key: str = "canonical_key") -> DataFrame:
    """A batch with one record a key; the state is the last row's."""
    return folded(batch, key, any_active=False)


def marked(stored: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """``stored`` with ``__blank`` and, for a key that several rows have, their number ``__n``; and those keys with it.

    Rows without a key have nothing to meet: a value of their own deals them over all tasks,
    where the missing key would bring them into one.
    """
    blank = F.coalesce(F.trim(F.col(key)) == "", F.lit(True))
    counts = stored.where(~blank).groupBy(F.col(key).alias("__key")).agg(F.count("*").alias("__n")).where("__n > 1")
    dealt = F.when(F.col("__blank"), F.concat(F.lit("blank:"), F.col("pos").cast("string"))).otherwise(F.col(key))
    met = stored.withColumn("__blank", blank).withColumn("__at", dealt).join(counts, F.col("__at") == F.col("__key"), "left")
    return met.withColumn("__n", F.when(~F.col("__blank"), F.col("__n"))).drop("__at"), counts


def migrated(stored: DataFrame, repaired: Column, key: str = "canonical_key") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Records of a table whose keys may be missing or repeated: survivors, losers and a row of counts.

    A key that is blank or that several rows have is replaced by ``repaired``; rows that
    then share one are folded, and all but the best row's number are losers.
    """
    met, counts = marked(stored, key)
    keyed = met.withColumn(key, F.when(F.col("__blank") | F.col("__n").isNotNull(), repaired).otherwise(F.col(key)))
    survivors = folded(keyed.select(stored.columns), key)
    losers = keyed.select("pos", key).join(survivors.select(F.col(key).alias("__k"), F.col("pos").alias("kept_pos")), F.col(key) == F.col("__k")).where("pos <> kept_pos").select("pos", "kept_pos")
    report = met.agg(F.count("*").alias("scanned"), F.count_if("__blank").alias("backfilled")).crossJoin(counts.agg(F.count("*").alias("repeated_keys")))  # one row each
    sums = survivors.agg(F.count_if(F.col("records") > 1).alias("groups"), F.sum(F.col("records") - 1).alias("deleted"))
    return survivors, losers, report.crossJoin(sums)


def merged_results(indexed: DataFrame, supplemental: DataFrame) -> DataFrame:
    """Indexed and supplemental postings as one list without duplicates; ``pos`` is new, indexed rows come first."""
    both = indexed.withColumn("pos", F.col("pos") * 2).unionByName(supplemental.withColumn("pos", F.col("pos") * 2 + 1))
    return dedupe(both)


def upserted_inventory(stored: DataFrame, incoming: DataFrame, key: str = "source_id") -> DataFrame:
    """Stored sources with incoming descriptions: what was observed stays, what describes is renewed.

    The smaller priority wins; the next date stays where one is known; metadata maps are
    merged, the incoming entry first.
    """
    keeps = {"first_seen", "status", "health", "failure_count", "consecutive_failures", "last_crawled_at", "last_succeeded_at", "last_failed_at", "lease_owner", "lease_expires_at"}
    a, b = stored.alias("a"), incoming.alias("b")
    old, new = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    known, asked = old(key).isNotNull(), new(key).isNotNull()

    def pick(c: str) -> Column:
        if c == key:
            return F.coalesce(old(c), new(c))
        if c == "crawl_priority":
            return F.least(old(c), new(c))
        if c in ("next_eligible_at", "last_failure"):
            return F.coalesce(old(c), new(c))
        if c == "metadata":
            mine, theirs = (F.coalesce(x, F.create_map().cast("map<string,string>")) for x in (old(c), new(c)))
            return F.map_concat(F.map_filter(mine, lambda k, v: ~F.map_contains_key(theirs, k)), theirs)
        if c in keeps:
            return F.when(known, old(c)).otherwise(new(c))
        return F.when(asked, F.coalesce(new(c), old(c))).otherwise(old(c))

    return a.join(b, old(key) == new(key), "full").select(*[pick(c).alias(c) for c in stored.columns])


def observed(inventory: DataFrame, observations: DataFrame, interval_ms: int, key: str = "source_id") -> DataFrame:
    """Sources after their runs: counters, health, dates, and the lease given back.

    ``observations``: the key, succeeded, observed_at, and optional health, status, reason
    and next date of the run's own; unknown sources are left out; of several observations
    of a source the latest counts, as each starts from the stored record.
    """
    last = observations.groupBy(key).agg(F.max_by(F.struct("succeeded", "observed_at", "health", "status", "reason", "next_eligible_at"), "observed_at").alias("o"))
    met = inventory.alias("i").join(last.withColumnRenamed(key, "__key"), F.col(key) == F.col("__key"), "left")
    seen, ok, at = F.col("o").isNotNull(), F.col("o.succeeded"), F.col("o.observed_at")
    failures = F.when(ok, F.lit(0)).otherwise(F.col("consecutive_failures") + 1)
    health = F.coalesce("o.health", F.when(ok, "healthy").when(failures >= 3, "failing").otherwise("degraded"))
    step = F.lit(interval_ms).cast("long")
    refresh = dates.refresh_ms(step, F.col("crawl_priority"), F.col("source_type"), F.col("confidence"), health)
    backoff = dates.backoff_ms(step, F.greatest(F.lit(1), failures), health)
    after = F.timestamp_millis(F.unix_millis(at) + F.when(ok, refresh).otherwise(backoff))
    new = {
        "status": F.coalesce("o.status", "status"), "health": health, "failure_count": F.when(ok, F.col("failure_count")).otherwise(F.col("failure_count") + 1),
        "consecutive_failures": failures, "last_failure": F.when(~ok, F.coalesce("o.reason", "last_failure")), "last_seen": at, "last_crawled_at": at,
        "last_succeeded_at": F.when(ok, at).otherwise(F.col("last_succeeded_at")), "last_failed_at": F.when(ok, F.col("last_failed_at")).otherwise(at),
        "next_eligible_at": F.coalesce("o.next_eligible_at", after), "lease_owner": F.lit(None), "lease_expires_at": F.lit(None),
    }
    kinds = dict(inventory.dtypes)
    return met.select(*[F.when(seen, new[c].cast(kinds[c])).otherwise(F.col(f"i.{c}")).alias(c) if c in new else F.col(f"i.{c}") for c in inventory.columns])


def incremented(stored: DataFrame, updates: DataFrame, key: str, add: list[str], replace: list[str] = (), on_insert: list[str] = ()) -> DataFrame:
    """Counters of ``add`` raised by all updates of a key, ``replace`` set by the last (by ``pos``), ``on_insert`` set on new rows only, by the first."""
    sums = updates.groupBy(key).agg(
        *[F.sum(c).alias(c) for c in add], *[F.max_by(c, "pos").alias(c) for c in replace], *[F.min_by(c, "pos").alias(c) for c in on_insert]
    )
    a, b = stored.alias("a"), sums.alias("b")
    old, new = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    known, asked = old(key).isNotNull(), new(key).isNotNull()
    pick = {c: F.coalesce(old(c), F.lit(0)) + F.coalesce(new(c), F.lit(0)) for c in add} | {c: F.when(asked, new(c)).otherwise(old(c)) for c in replace} | {c: F.when(known, old(c)).otherwise(new(c)) for c in on_insert}
    pick[key] = F.coalesce(old(key), new(key))
    return a.join(b, old(key) == new(key), "full").select(*[pick.get(c, old(c)).alias(c) for c in stored.columns])


def repaired(rows: DataFrame, derived: dict[str, Column]) -> DataFrame:
    """``rows`` with derived columns worked out anew, and ``changed_fields``: the names of those that differ from what was stored."""
    changed = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(d), F.lit(c)) for c, d in derived.items()]))
    return rows.withColumn("changed_fields", changed).select(*[derived[c].alias(c) if c in derived else F.col(c) for c in rows.columns], "changed_fields")


def with_keys(jobs: DataFrame) -> DataFrame:
    """Identity columns, for rows that come without a canonical key."""
    return with_identity(jobs)


def searched_before(searches: DataFrame, filters: dict[str, str], at: str = "created_at") -> DataFrame:
    """The newest of the saved searches whose filters are the same as JSON with sorted names."""
    import json

    wanted = json.dumps({k: v for k, v in sorted(filters.items()) if v not in (None, "")}, separators=(",", ":"), ensure_ascii=False)
    names = sorted(searches.schema["filters"].dataType.names)
    stable = F.to_json(F.struct(*[F.nullif(F.col(f"filters.{n}"), F.lit("")).alias(n) for n in names]))
    return searches.where(stable == wanted).orderBy(F.desc(at), F.desc("search_id")).limit(1)
