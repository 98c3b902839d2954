"""Contiguous balanced shards by global byte-size prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.turns import CRC_TABLE
from weftgraph.session import stash

#: Rows a bucket of the prefix sums should hold, and the least and most buckets.
BUCKET_ROWS, LEAST_BUCKETS, MOST_BUCKETS = 20_000, 64, 20_000


def prefix_shards(rows: DataFrame, order: str, size: str, n_shards: int) -> DataFrame:
    """``rows`` with ``shard`` (0 to n_shards - 1) and ``slot`` (gapless from 0 in its shard), contiguous in ``order``.

    Rows are cut at equal targets of the running sum of ``size``: a row goes where the middle of its bytes falls, so a
    shard's bytes differ from total / n_shards by less than one row. Rows are ranged into buckets by
    ``order``; each bucket's total and row count are summed, the running sums of those few totals (one row for each
    of at most MOST_BUCKETS + 1 buckets) are broadcast, and each bucket adds its own running sums. No bucket is a
    function of the shard, and no task sees more than a bucket.

    Ties of ``order`` are broken by a hash of all other columns and then by where rows lie, so a third of all rows with
    one ``order``, or none, is split among buckets like any others; rows that differ in nothing are interchangeable. A
    null ``order`` comes first; a null size counts as 0. No rows give no rows. Other columns pass through (none may be a
    map), except that columns named ``shard``, ``slot`` or with the prefix ``_ps_`` are replaced.
    """
    rows = rows.drop("shard", "slot")
    n_rows = rows.agg(F.count(F.lit(1))).first()[0]
    n_buckets = max(LEAST_BUCKETS, min(MOST_BUCKETS, n_rows // BUCKET_ROWS))
    # the stash freezes which range each row fell into, so that totals and rows agree whatever is run again
    others = sorted(c for c in rows.columns if c != order)
    placed_by = [F.col(order).asc_nulls_first(), "_ps_tie", "_ps_at"]
    weighed = stash(
        rows.withColumn("_ps_size", F.coalesce(F.col(size).cast("long"), F.lit(0)))
        .withColumn("_ps_tie", F.xxhash64(*others) if others else F.lit(0))
        .withColumn("_ps_at", F.monotonically_increasing_id())
        .repartitionByRange(n_buckets, *placed_by)
        .withColumn("_ps_bucket", F.spark_partition_id())
    )
    totals = weighed.groupBy("_ps_bucket").agg(F.sum("_ps_size").alias("_ps_bytes"), F.count(F.lit(1)).alias("_ps_rows"))
    before = Window.orderBy("_ps_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = stash(totals.select(
        "_ps_bucket", F.coalesce(F.sum("_ps_bytes").over(before), F.lit(0)).alias("_ps_bytes0"),
        F.coalesce(F.sum("_ps_rows").over(before), F.lit(0)).alias("_ps_rows0"), "_ps_bytes"))
    total = starts.agg(F.sum("_ps_bytes")).first()[0] or 0
    own = Window.partitionBy("_ps_bucket").orderBy(*placed_by).rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        weighed.withColumn("_ps_own_bytes", F.coalesce(F.sum("_ps_size").over(own), F.lit(0)))
        .withColumn("_ps_own_rows", F.count(F.lit(1)).over(own))
        .join(F.broadcast(starts.drop("_ps_bytes")), "_ps_bucket")
        .withColumn("_ps_row", F.col("_ps_rows0") + F.col("_ps_own_rows"))
    )
    middle = 2 * (F.col("_ps_bytes0") + F.col("_ps_own_bytes")) + F.col("_ps_size")
    if total:  # by decimals: twice the bytes times the shards may pass 2 ** 63
        shard = F.floor(middle.cast("decimal(20,0)") * F.lit(n_shards) / F.lit(2 * total).cast("decimal(20,0)")).cast("int")
        shard = F.least(shard, F.lit(n_shards - 1))
    else:
        shard = F.floor(F.col("_ps_row") * F.lit(n_shards) / F.lit(max(1, n_rows))).cast("int")
    placed = stash(placed.withColumn("shard", shard).select(*rows.columns, "shard", "_ps_row"))
    firsts = placed.groupBy("shard").agg(F.min("_ps_row").alias("_ps_first"))  # n_shards rows
    return placed.join(F.broadcast(firsts), "shard").withColumn("slot", F.col("_ps_row") - F.col("_ps_first")).select(*rows.columns, "shard", "slot")


def shard_documents(documents: DataFrame, n_shards: int = 40) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``bytes``: sizes near equal, contiguous in doc_id. Size is the text's UTF-8 bytes (null: none) plus 16;
    text_crc32 of a null text is that of no bytes, 0. grown_shard is null under this law. Extra columns are ignored.
    """
    narrow = documents.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(16)).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    narrow = stash(narrow)
    return prefix_shards(narrow, "doc_id", "size", n_shards).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


#: The same sums over the whole table at once; the checksum goes byte by byte through the polynomial's table.
SHARD_SQL = f"""
WITH {CRC_TABLE},
sized AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0) + 16 AS size,
    list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS bytes FROM documents),
summed AS (
  SELECT doc_id, size, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes), lambda c, b: xor(c >> 8, crc_table.t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32,
    coalesce(sum(size) OVER (ORDER BY doc_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(size) OVER () AS total
  FROM sized, crc_table),
cut AS (SELECT *, CAST(least(39, (2 * before + size) * 40 // (2 * total)) AS INTEGER) AS shard FROM summed)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM cut
"""
