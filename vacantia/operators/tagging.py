"""Phrases of a table in running text: an n-gram equi-join and a longest-first cover.

A text's words each become one row with the few words ahead of them; those that begin no
phrase fall away in a join with the phrases' first words, the others meet the table by
equality at every length that a phrase with this beginning has.  So the work grows with
the words and the matches, never with words times phrases, and both joins are plain equi-
joins whose sides Spark broadcasts only if they are small.

Overlapping matches form clusters along the text (a running maximum of where they end);
within a cluster, which a few phrases bound, the longest phrase is taken first, then the
leftmost, and what overlaps a taken one goes.

Defined results: a null or empty text has no tags; a phrase that stands twice is tagged
twice; a phrase that several rows of the table give is tagged once a place, with each row's
columns; repeated texts are tagged each by their identity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantia.durable import persist
from vacantia.operators import places
from vacantia.operators.evidence import is_ambiguous_code
from vacantia.operators.places import POINT


def beginnings(phrases: DataFrame, phrase: str = "alias") -> DataFrame:
    """``word, reach``: first words, and how many words the longest phrase with this beginning has."""
    words = F.split(phrase, " ")
    return phrases.select(words[0].alias("word"), F.size(words).alias("n")).groupBy("word").agg(F.max("n").alias("reach"))


def matches(rows: DataFrame, phrases: DataFrame, identity: str, words: Column, phrase: str = "alias") -> DataFrame:
    """``identity, start, n, total`` and the columns of ``phrases``: every run of words that is one of them.

    ``start`` counts words from 0, ``total`` is the number of the text's words.
    """
    first = beginnings(phrases, phrase)
    longest = first.agg(F.max("reach")).first()[0] or 1
    # the words as a column: inside the lambda an expression would be worked out again for each word
    held = F.col("__words")
    ahead = F.transform(held, lambda w, i: F.struct(i.alias("start"), w.alias("word"), F.slice(held, i + 1, longest).alias("ahead")))
    texts = rows.select(identity, words.alias("__words")).where(held.isNotNull())
    at = texts.select(identity, F.size(held).alias("total"), F.inline(ahead)).where("word <> ''").join(first, "word")
    spans = F.transform(F.sequence(F.lit(1), F.least("reach", F.size("ahead"))), lambda n: F.struct(n.alias("n"), F.array_join(F.slice("ahead", 1, n), " ").alias(phrase)))
    return at.select(identity, "start", "total", F.inline(spans)).join(phrases, phrase)


def cover(found: DataFrame, identity: str) -> DataFrame:
    """``identity, start, n`` of matches that stay: longest first, then leftmost, none upon another."""
    spans = found.select(identity, "start", "n").distinct()
    along = Window.partitionBy(identity).orderBy("start", F.desc("n"))
    reached = F.max(F.col("start") + F.col("n")).over(along.rowsBetween(Window.unboundedPreceding, -1))
    fresh = spans.withColumn("fresh", F.when(F.col("start") < reached, 0).otherwise(1))
    clusters = fresh.withColumn("cluster", F.sum("fresh").over(along)).groupBy(identity, "cluster").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("size"), "start", "n"))).alias("spans"))
    upon = lambda a, b: (a["start"] < b["start"] + b["n"]) & (b["start"] < a["start"] + a["n"])
    none = F.slice("spans", 1, 0)
    taken = F.aggregate("spans", none, lambda kept, s: F.when(F.exists(kept, lambda k: upon(k, s)), kept).otherwise(F.concat(kept, F.array(s))))
    return clusters.select(identity, F.explode(taken).alias("s")).select(identity, "s.start", "s.n")


def tag(rows: DataFrame, phrases: DataFrame, identity: str, words: Column, phrase: str = "alias") -> DataFrame:
    """The matches that the longest-first cover keeps, with the columns of ``phrases``."""
    found = persist(matches(rows, phrases, identity, words, phrase))  # read twice, texts once
    return found.join(cover(found, identity), [identity, "start", "n"])


def place_names(gazetteer: DataFrame) -> DataFrame:
    """``alias, level, guarded`` and the place; guarded: a region's code that is a word or another place as well."""
    code = places.normal_place(F.col("region_code"))
    guarded = (F.col("level") == 2) & (F.col("alias") == code) & is_ambiguous_code(F.col("region_code"))
    return places.aliases(gazetteer).select("*", F.coalesce(guarded, F.lit(False)).alias("guarded"))


def locate(rows: DataFrame, gazetteer: DataFrame, identity: str, text: str) -> DataFrame:
    """``identity, country, region, city, remote`` of every row's running text.

    Of the tags that stay the longest metropolitan area counts, then the longest region of
    its country, then the longest country: what is missing of country and region comes
    from the narrower place.  A guarded code counts at the end of a text only.
    """
    # a text's words once, for texts that many rows share once in all
    normal = places.normal_place(F.col(text))
    distinct = rows.select(normal.alias("normal")).where("normal <> ''").distinct()
    words = F.split("normal", " ")
    found = persist(matches(distinct, place_names(gazetteer), "normal", words).where(~F.col("guarded") | (F.col("start") + F.col("n") == F.col("total"))))
    kept = found.join(cover(found, "normal"), ["normal", "start", "n"])
    best = lambda level: F.min(F.when(F.col("level") == level, F.struct((-F.length("alias")).alias("size"), "start", *POINT)))
    # the region must be of the metropolitan area's country, so areas are settled first
    metro = kept.groupBy("normal").agg(best(3).alias("metro"))
    fits = F.col("metro").isNull() | (F.col("level") != 2) | (F.col("country") == F.col("metro.country"))
    chosen = kept.join(metro, "normal").where(fits).groupBy("normal").agg(F.first("metro").alias("metro"), best(2).alias("area"), best(1).alias("land"))
    placed = chosen.select(
        "normal", F.coalesce("metro.country", "area.country", "land.country").alias("country"), F.coalesce("area.region", "metro.region").alias("region"), F.col("metro.city").alias("city")
    )
    remote = F.concat(F.lit(" "), F.col("normal"), F.lit(" ")).contains(" remote ")
    return rows.select(identity, normal.alias("normal")).join(placed, "normal", "left").select(identity, "country", "region", "city", F.coalesce(remote, F.lit(False)).alias("remote"))
