"""Running sums over numbered parts of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.session import stash

#: Parts that one task of the first level sums.
FAN = 1024


def starts_of(totals: DataFrame, part: str, *values: str) -> DataFrame:
    """``totals`` (one row for each number ``part``) with each of ``values`` replaced by the sum of those of lower parts.

    Parts are summed in groups of FAN, and then the groups' totals, so no task sees more than a FAN-th of all parts (or
    FAN of them). The result is not broadcast here: its size follows the number of parts.
    """
    grouped = totals.select(part, *values).withColumn("_group", F.floor(F.col(part) / FAN))
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    sums = grouped.groupBy("_group").agg(*[F.sum(v).alias(v) for v in values])
    lower = sums.select("_group", *[F.coalesce(F.sum(v).over(before("_group")), F.lit(0)).alias(f"_{v}") for v in values])
    own = grouped.select(part, "_group", *[F.coalesce(F.sum(v).over(before("_group", part)), F.lit(0)).alias(v) for v in values])
    return own.join(lower, "_group").select(part, *[(F.col(v) + F.col(f"_{v}")).alias(v) for v in values])


def numbered(rows: DataFrame, place: str, *order: Column) -> DataFrame:
    """``rows`` with ``place``, from 0 in the order given, which must tell all rows apart.

    Range partitions are numbered where they are sorted, and counted; no task sorts more than its range, and rows move once."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = stash(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_part"), within.alias("_own")))
    starts = starts_of(ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")), "_part", "_n")  # one row for each range
    return ranged.join(F.broadcast(starts), "_part").select(*rows.columns, (F.col("_n") + F.col("_own")).cast("long").alias(place))
