"""Bitmaps of a pack's entries: bit i of a pack's bitmap, from the lowest of byte 0 on, is its entry idx = i.

Bitmaps are binary columns that travel between operators; everything is said in built-in functions over 32-bit words, so that a bitmap
is made by an aggregate per word and never by a row that holds a pack's entries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = 32


def _little(word: Column) -> Column:
    """The 8 hex digits of a 32-bit word, its lowest byte first."""
    text = F.lpad(F.hex(word), 8, "0")
    return F.concat(*[F.substring(text, i, 2) for i in (7, 5, 3, 1)])


def marked_words(packs: DataFrame, marks: DataFrame) -> DataFrame:
    """packs(id, count), marks(id, idx) -> (id, word, bits): every 32-bit word of each pack; marks beyond its count are ignored."""
    words = packs.select("id", "count", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.floor((F.col("count") - 1) / WORD)))).alias("word"))
    bit = F.expr(f"shiftleft(1L, cast(pmod(idx, {WORD}) as int))")
    set_ = marks.where("idx >= 0").select("id", F.floor(F.col("idx") / WORD).alias("word"), "idx").distinct()
    bits = set_.join(packs.select("id", "count"), "id").where("idx < count").groupBy("id", "word").agg(F.sum(bit).alias("bits"))
    return words.join(bits, ["id", "word"], "left").select("id", "word", F.coalesce("bits", F.lit(0)).cast("long").alias("bits"))


def bitmaps(packs: DataFrame, marks: DataFrame) -> DataFrame:
    """(id, bitmap): as many bytes as the pack's entries need."""
    bytes_ = F.floor((F.col("count") + 7) / 8).cast("int")
    lists = marked_words(packs, marks).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("word", _little(F.col("bits")).alias("digits")))).alias("words"))
    return lists.join(packs.select("id", "count"), "id").select("id", F.unhex(F.substring(F.concat_ws("", "words.digits"), F.lit(1), 2 * bytes_)).alias("bitmap"))


def entries(maps: DataFrame) -> DataFrame:
    """(id, bitmap) -> (id, idx): the set bits."""
    each = maps.select("id", F.posexplode(F.sequence(F.lit(1), F.length("bitmap"))).alias("at", "n"), "bitmap").where(F.length("bitmap") > 0)
    byte = F.conv(F.hex(F.substring(F.col("bitmap"), F.col("n"), F.lit(1))), 16, 10).cast("int")
    bits = each.select("id", "at", byte.alias("byte")).select("id", "at", "byte", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("bit"))
    return bits.where(F.expr("(shiftright(byte, bit) & 1) = 1")).select("id", (F.col("at") * 8 + F.col("bit")).cast("long").alias("idx"))


def compared(packs: DataFrame, marks: DataFrame, built: DataFrame) -> DataFrame:
    """Per pack: set bits of marks and of built, whether all entries are marked, whether marks are within built (subset), and whether retiring
    the pack would lose marked entries (lossy)."""
    both = marked_words(packs, marks).join(marked_words(packs, built).withColumnRenamed("bits", "made"), ["id", "word"])
    lost = F.sum(F.bit_count(F.col("bits").bitwiseAND(F.bitwise_not("made"))))
    per = both.groupBy("id").agg(F.sum(F.bit_count("bits")).alias("marked"), F.sum(F.bit_count("made")).alias("built"), lost.alias("lost"))
    return per.join(packs.select("id", "count"), "id").select("id", "marked", "built", (F.col("marked") == F.col("count")).alias("all_set"), (F.col("lost") == 0).alias("subset"), (F.col("lost") > 0).alias("lossy"))
