"""Filters of fixed size that spare rows a shuffle. A full filter only sorts out less; it never loses a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bitmaps of 32,768 bits that make up a filter; its size, 4 KB each, is fixed.
FILTER_PAGES = 1024
_PAGE_BITS = 32768


def _slot(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(FILTER_PAGES * _PAGE_BITS))


def key_filter(keys: DataFrame, key: str) -> DataFrame:
    """A Bloom filter with one hash of the values of `key`: at most FILTER_PAGES rows (page, bits) of 4 KB."""
    slot = _slot(F.col(key))
    return keys.select((slot / _PAGE_BITS).cast("int").alias("_sw_page"), F.pmod(slot, F.lit(_PAGE_BITS)).alias("_sw_bit")).groupBy("_sw_page").agg(F.expr("bitmap_construct_agg(_sw_bit)").alias("_sw_bits"))


def maybe_in(df: DataFrame, key: str, pages: DataFrame) -> DataFrame:
    """df with a column _sw_maybe: false only where the value of `key` surely isn't in the filter. The filter is broadcast; its size is bounded."""
    slot = _slot(F.col(key))
    bit = F.pmod(slot, F.lit(_PAGE_BITS)).cast("int")
    byte = F.conv(F.hex(F.expr("substring(_sw_bits, _sw_at div 8 + 1, 1)")), 16, 10).cast("int")
    joined = df.withColumns({"_sw_page": (slot / _PAGE_BITS).cast("int"), "_sw_at": bit}).join(F.broadcast(pages), "_sw_page", "left")
    return joined.withColumn("_sw_maybe", F.coalesce(byte.bitwiseAND(F.expr("shiftleft(1, _sw_at % 8)")) != 0, F.lit(False))).drop("_sw_page", "_sw_at", "_sw_bits")


#: Keys that count as heavy, at most.
HEAVY_KEYS = 1000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined (`how`: inner or left) with a row for each key: `groups`, a stored table, with the number of a key's rows in `size`.

    Keys with a thousandth of all `total` rows or more number at most HEAVY_KEYS, so they are broadcast and their rows stay where
    they are; all other keys are too small to overload a task and meet by a shuffle.
    """
    bound = max(HEAVY_KEYS, total // HEAVY_KEYS + 1)
    heavy, light = groups.where(F.col(size) >= bound), groups.where(F.col(size) < bound)
    rest = rows.join(F.broadcast(heavy.select(key)), key, "left_anti")
    return rows.join(F.broadcast(heavy), key).unionByName(rest.join(light, key, how))
