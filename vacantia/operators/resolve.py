"""Entity resolution of postings and the merge of what belongs together.

Rows with a strong identity are one entity if a chain of shared strong keys connects
them; rows without are one entity if they share the weak key.  Keys are exploded and
meet in equi-joins on the key; chains are closed by distributed component rounds, so the
result doesn't depend on the order of rows, which only decides ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.operators.components import connected_components
from vacantia.operators.identity import with_identity

# What a match by this kind of key is called, by precedence.
REASONS = [
    ("canonical:", "dedupe:canonical_url"), ("resolved:", "dedupe:resolved_url"), ("apply:", "dedupe:apply_url"), ("source:", "dedupe:source_url"),
    ("platform_job:", "dedupe:platform_job"), ("fallback:", "dedupe:content_fingerprint"),
]


def quality(link_status: Column, resolved_url: Column, canonical_url: Column, validated_at: Column) -> Column:
    """Score of a record: link valid 3, unknown 2, stale 1, and one for each of the other three."""
    link = F.when(link_status == "valid", 3).when(link_status == "unknown", 2).when(link_status == "stale", 1).otherwise(0)
    there = lambda x: F.coalesce((x.cast("string") != "").cast("int"), F.lit(0))
    return (link + there(resolved_url) + there(canonical_url) + there(validated_at)).cast("int")


def drop_reason(keys: Column) -> Column:
    """Name of the match by the strongest kind of key."""
    out = None
    for prefix, reason in REASONS:
        hit = F.exists(keys, lambda k: k.startswith(prefix))  # noqa: B023  called at once
        out = F.when(hit, reason) if out is None else out.when(hit, reason)
    return out.otherwise("dedupe:matched")


def entities(jobs: DataFrame) -> DataFrame:
    """``pos, entity, strong_keys, weak_key, has_strong, matched_keys`` of every row; ``pos`` numbers the rows, entity is the smallest in it."""
    known = with_identity(jobs)
    keyed = known.select("pos", "has_strong", F.explode(F.when(F.col("has_strong"), F.col("strong_keys")).otherwise(F.array("weak_key"))).alias("key"))
    firsts = keyed.groupBy("has_strong", "key").agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1")
    met = keyed.join(firsts, ["has_strong", "key"]).select("pos", "first", "key")
    members = connected_components(met, "pos", "first").select(F.col("node").alias("pos"), F.col("component").alias("entity"))
    shared = met.groupBy("pos").agg(F.array_sort(F.collect_set("key")).alias("matched_keys"))  # a row's own keys: few
    return (
        known.select("pos", "strong_keys", "weak_key", "has_strong").join(members, "pos", "left").join(shared, "pos", "left")
        .withColumn("entity", F.coalesce("entity", "pos"))
    )


def dedupe(jobs: DataFrame) -> DataFrame:
    """One row an entity: the best record's columns, and what is merged from all of them.

    The record of the highest quality wins, of equal ones the later; posted_at is the
    latest, discovered_at the earliest; lookup keys are united in order of first sight.
    """
    placed = entities(jobs).select("pos", "entity")
    rows = jobs.join(placed, "pos").withColumn("quality", quality(F.col("link_status"), F.col("resolved_url"), F.col("canonical_url"), F.col("validated_at")))
    kept = [c for c in jobs.columns if c not in ("posted_at", "discovered_at", "lookup_keys")]
    best = rows.groupBy("entity").agg(
        F.max_by(F.struct(*kept), F.struct("quality", "pos")).alias("best"), F.max("posted_at").alias("posted_at"), F.min("discovered_at").alias("discovered_at"), F.count("*").alias("records")
    )
    # keys are made distinct before they are gathered: a group holds no more than it has keys
    seen = rows.select("entity", "pos", F.posexplode("lookup_keys").alias("i", "key")).groupBy("entity", "key").agg(F.min(F.struct("pos", "i")).alias("at"))
    united = seen.groupBy("entity").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "key"))), lambda x: x["key"]).alias("lookup_keys"))
    return best.join(united, "entity", "left").select("entity", "best.*", "posted_at", "discovered_at", "records", F.coalesce("lookup_keys", F.array().cast("array<string>")).alias("lookup_keys"))


def decisions(jobs: DataFrame) -> DataFrame:
    """``pos, kept_pos, matched_keys, reason`` of every row that was merged into another."""
    found = entities(jobs)
    rows = jobs.join(found.select("pos", "entity", "matched_keys"), "pos").withColumn(
        "quality", quality(F.col("link_status"), F.col("resolved_url"), F.col("canonical_url"), F.col("validated_at"))
    )
    winner = rows.groupBy("entity").agg(F.max(F.struct("quality", "pos")).getField("pos").alias("kept_pos"))
    return rows.join(winner, "entity").where("pos <> kept_pos").select("pos", "kept_pos", "matched_keys", drop_reason(F.coalesce("matched_keys", F.array().cast("array<string>"))).alias("reason"))


def match_existing(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """``pos, existing_id, by`` for the first way in which an incoming row meets a stored one.

    Both sides have identity columns; the ways, in order: canonical key, canonical,
    resolved, apply and source URL, platform key, weak key. Every way is an equi-join on
    one exploded key; the best way of a row is a minimum, not a sort.
    """
    ways = ["canonical_key", "canonical", "resolved", "apply", "source", "platform_job", "fallback"]

    def keys(df: DataFrame, number: str) -> DataFrame:
        """One row for each key and the place of its kind."""
        whole = F.struct(F.lit(0).alias("way"), F.concat(F.lit("key:"), F.col("canonical_key")).alias("key"))
        kind = lambda k: (F.array_position(F.array(*map(F.lit, ways)), F.substring_index(k, ":", 1)) - 1).cast("int")
        typed = F.filter(F.transform(F.concat("strong_keys", F.array("weak_key")), lambda k: F.struct(kind(k).alias("way"), k.alias("key"))), lambda x: x["way"] > 0)
        return df.select(number, F.explode(F.array_distinct(F.concat(F.array(whole), typed))).alias("k")).select(number, "k.way", "k.key")

    left, right = keys(incoming, "pos"), keys(existing, "id")
    first = right.groupBy("way", "key").agg(F.min("id").alias("existing_id"))
    best = left.join(first, ["way", "key"]).groupBy("pos").agg(F.min(F.struct("way", "existing_id")).alias("best"))
    return best.select("pos", "best.existing_id", F.element_at(F.array(*map(F.lit, ways)), F.col("best.way") + 1).alias("by"))


def merge_stored(old: DataFrame, new: DataFrame, key: str = "canonical_key") -> DataFrame:
    """Stored rows with incoming ones merged in by key.

    Of two records the better one gives the fields and the other fills its gaps, a tie
    goes to the stored one; first_seen is the earlier, last_seen the later, the state is
    the incoming one's. Rows of one side alone stay as they are.
    """
    special = {key, "first_seen", "last_seen", "is_active"}
    fields = [c for c in old.columns if c not in special]
    a, b = old.alias("a"), new.alias("b")
    score = lambda s: quality(*(F.col(f"{s}.{c}") for c in ("link_status", "resolved_url", "canonical_url", "validated_at")))
    newer = F.col(f"b.{key}").isNotNull() & (F.col(f"a.{key}").isNull() | (score("b") > score("a")))
    pick = lambda c: F.when(newer, F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}"))).otherwise(F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}"))).alias(c)
    merged = {c: pick(c) for c in fields} | {
        key: F.coalesce(f"a.{key}", f"b.{key}").alias(key), "first_seen": F.least("a.first_seen", "b.first_seen").alias("first_seen"),
        "last_seen": F.greatest("a.last_seen", "b.last_seen").alias("last_seen"), "is_active": F.coalesce("b.is_active", "a.is_active").alias("is_active"),
    }
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full").select(*[merged[c] for c in old.columns])


def first_profile(rows: DataFrame, profiles: DataFrame, key: str, identity: str = "id") -> DataFrame:
    """``rows`` with ``profile``: the first of the profiles whose ``name`` or one of whose ``aliases`` is the row's key; rows without one go."""
    named = profiles.select(F.col(identity).alias("profile"), F.explode(F.array_distinct(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("__key"))
    first = named.groupBy("__key").agg(F.min("profile").alias("profile"))
    return rows.join(first, F.col(key) == F.col("__key")).drop("__key")
