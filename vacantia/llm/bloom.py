"""Blocked Bloom filters as small tables, in DataFrame functions only.

A hash falls into one 64-bit word of the filter and sets three of its bits.  The table
``word, bits`` has at most MOST_WORDS rows of 16 bytes, whatever it was built from, which
is what makes its broadcast safe.  A probe may raise a false alarm, never miss.  A single
filter only spares work and lets more through the fuller it is; where every key has to
be told, keys are dealt to as many filters as hold them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_WORDS = 1 << 20
BITS_A_KEY = 16


def words_for(n: int) -> int:
    """Number of words for ``n`` keys, within the bound."""
    return min(MOST_WORDS, max(64, 1 << (n * BITS_A_KEY // 64).bit_length()))


def segments_for(n: int) -> int:
    """Number of filters of MOST_WORDS that hold ``n`` keys without filling up."""
    return max(1, -(-n * BITS_A_KEY // (64 * MOST_WORDS)))


def _word(key: Column, words: int) -> Column:
    return F.pmod(F.shiftright(key, 18), F.lit(words))


def _bits(key: Column) -> list[Column]:
    return [F.shiftright(key, at).bitwiseAND(63).cast("int") for at in (0, 6, 12)]


def build(keys: DataFrame, key: Column, words: int) -> DataFrame:
    """``word, bits`` of the keys, one row a word and task before the shuffle."""
    first, second, third = (F.call_function("shiftleft", F.lit(1).cast("long"), b) for b in _bits(key))
    return keys.select(_word(key, words).alias("word"), first.bitwiseOR(second).bitwiseOR(third).alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits"))


def probe(rows: DataFrame, key: Column, table: DataFrame, words: int, name: str) -> DataFrame:
    """``rows`` with a boolean column ``name``: false only if the filter never saw the key."""
    one = F.lit(1).cast("long")
    first, second, third = (F.call_function("shiftleft", one, b) for b in _bits(key))
    mask = first.bitwiseOR(second).bitwiseOR(third)
    small = F.broadcast(table.select(F.col("word").alias("__word"), F.col("bits").alias("__bits")))
    met = rows.withColumn("__mask", mask).withColumn("__at", _word(key, words)).join(small, F.col("__at") == F.col("__word"), "left")
    return met.withColumn(name, F.coalesce(F.col("__bits").bitwiseAND(F.col("__mask")) == F.col("__mask"), F.lit(False))).drop("__mask", "__at", "__word", "__bits")


def as_array(table: DataFrame, words: int) -> np.ndarray:
    """The filter as one number a word, on the driver: at most MOST_WORDS of them."""
    out, found = np.zeros(words, dtype=np.int64), table.select("word", "bits").toArrow()
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return out


def holds(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """``probe`` for an array of keys."""
    mask = np.zeros(len(keys), dtype=np.int64)
    for at in (0, 6, 12):
        mask |= np.int64(1) << ((keys >> np.int64(at)) & np.int64(63))
    return table[(keys >> np.int64(18)) & np.int64(len(table) - 1)] & mask == mask
