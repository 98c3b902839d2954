"""Joins that survive a key with a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most this many keys are hot: a hot key holds more than one part in HOT_KEYS of the counted rows.
HOT_KEYS = 1000
#: Tables of more rows are joined by shuffle, however small their compressed files are.
MOST_SENT = 1_000_000


def not_sent(rows: DataFrame, n: int) -> DataFrame:
    """``rows``, which number ``n``, with a hint against their broadcast if that is more than MOST_SENT.

    Spark takes the bytes of Parquet files for the size of what they hold. Ids and numbers in order take one or two there and
    some 60 as a broadcast, so that files under its threshold of 10 MB can fill a driver."""
    return rows.hint("merge") if n > MOST_SENT else rows


def join_facts(rows: DataFrame, facts: DataFrame, key: str, count: str, how: str = "left", least: int = 0) -> DataFrame:
    """``rows`` with the columns of ``facts`` (one row per ``key``; ``count`` says how many rows have that key).

    Keys with more than 1/HOT_KEYS of all counted rows number HOT_KEYS at most, so their facts are broadcast; every
    other key is small enough for a shuffled join. A key of ``least`` rows or fewer is never hot: one task takes so many
    narrow rows, and groups of one size are then treated alike in tables of any size. Null keys match nothing; ``how``
    is left or inner. Both inputs are read twice and should be narrow or stashed.
    """
    total = facts.agg(F.sum(count)).first()[0] or 0
    is_hot = (F.col(count) * F.lit(HOT_KEYS) > F.lit(total)) & (F.col(count) > F.lit(least))
    hot = F.broadcast(facts.where(is_hot).where(F.col(key).isNotNull()))
    cold = facts.where(~is_hot)
    some = rows.where(F.col(key).isNotNull())
    out = some.join(hot, key).unionByName(some.join(hot.select(key), key, "left_anti").join(cold, key, how))
    if how == "inner":
        return out
    return out.unionByName(rows.where(F.col(key).isNull()), allowMissingColumns=True)
