"""A bitmap of hashed keys that tells, before a shuffle, which rows of a wide table a join can concern."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.session import stash

#: Bits for each key, and the most in all: 16 MB, whatever the number of keys.
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 1 << 20, 1 << 27


def _marked(wide: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """(_doc, _may): each row in one column, and whether its key may be among those of the one column of ``keys``."""
    name = keys.columns[0]
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_EACH * max(1, keys.count()) - 1).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits)) + 1
    own = keys.where(F.col(name).isNotNull()).select(place(F.col(name)).alias("p"))
    maps = own.groupBy(F.bitmap_bucket_number("p").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("_bits"))
    at = F.bitmap_bit_position("_place")
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.expr("mod(shiftright(_byte, cast(mod(bitmap_bit_position(_place), 8) as int)), 2) = 1")
    packed = wide.select(F.expr("struct(*)").alias("_doc"), F.when(key.isNotNull(), place(key)).alias("_place")).withColumn("_bucket", F.bitmap_bucket_number("_place"))
    return packed.join(F.broadcast(maps), "_bucket", "left").withColumn("_byte", byte).select("_doc", F.coalesce(is_set, F.lit(False)).alias("_may"))


def thin(wide: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """The rows of ``wide`` whose ``column`` may be among ``keys`` (same column): all that are, and few others.

    Follow it with the exact join. The broadcast bitmap has MOST_BITS bits at most; with far more keys than that it lets
    everything through, which costs a full shuffle and changes nothing else. Null keys are dropped.
    """
    return _marked(wide, F.col(column), keys.select(column)).where("_may").select("_doc.*")


def split(wide: DataFrame, key: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(those, others) of the rows of ``wide``, whose columns may have any name: all whose ``key`` is among ``keys`` (one
    column of the same type) are among those, and few more. Others, null keys with them, need no join and no shuffle."""
    marked = _marked(wide, key, keys)
    return marked.where("_may").select("_doc.*"), marked.where("not _may").select("_doc.*")


def distinct_rows(rows: DataFrame) -> DataFrame:
    """``rows.distinct()`` where few rows are equal: 64 bits of each are shuffled and counted, and whole rows only if
    another may be equal. ``rows`` is read three times and should be stashed."""
    key = F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns])
    twice = stash(rows.select(key.alias("_key")).groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_key"))
    some, others = split(rows, key, twice)
    return some.distinct().unionByName(others)
