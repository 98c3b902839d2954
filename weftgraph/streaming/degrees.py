"""An extension beyond the batch pipeline: degrees kept up to date from a stream of edges, and windowed event counts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from weftgraph.session import drop_path


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts for each tumbling window and key; rows later than ``late`` behind the newest are dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")


def _fold(edges: DataFrame, old: DataFrame | None) -> DataFrame:
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("source_id").alias("id"), F.lit(0).cast("long").alias("inDegree"), F.lit(1).cast("long").alias("outDegree")),
        F.struct(F.col("target_id").alias("id"), F.lit(1).cast("long").alias("inDegree"), F.lit(0).cast("long").alias("outDegree")))).alias("e")).select("e.*")
    rows = ends if old is None else ends.unionByName(old)
    return rows.groupBy("id").agg(F.sum("inDegree").alias("inDegree"), F.sum("outDegree").alias("outDegree"))


def keep_degrees(edges: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Folds each batch of a stream of edges into the degrees under ``folder``.

    A batch reads the version that the one before named and writes one of its own, so one that is run again after a
    failure gives the same version; the version before the last is deleted."""

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = spark.read.parquet(f"{folder}/v={number - 1}").drop("v") if number else None
        _fold(batch, old).write.mode("overwrite").parquet(f"{folder}/v={number}")
        if number > 1:
            drop_path(spark, f"{folder}/v={number - 2}")

    return edges.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).queryName(f"degrees-{uuid.uuid4().hex[:8]}").trigger(availableNow=True).start()


def read_degrees(spark, folder: str) -> DataFrame:
    """The newest version."""
    rows = spark.read.parquet(folder)
    newest = rows.agg(F.max("v")).first()[0]
    return rows.where(F.col("v") == newest).drop("v")
