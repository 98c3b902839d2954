"""Versions of a graph that become visible at once, and ordered files: both by small manifests written by a rename."""

from __future__ import annotations

import json
import uuid
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.session import freeing, release, stash


def _file_system(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Names of what lies in ``folder``, sorted; none if it is not there."""
    fs, path = _file_system(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []


def read_small(spark: SparkSession, path: str) -> str:
    """A small file's text."""
    fs, at = _file_system(spark, path)
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def publish(spark: SparkSession, path: str, text: str) -> None:
    """Writes ``text`` beside ``path`` and renames it: readers see the whole file or none. A file that is there raises."""
    fs, final = _file_system(spark, path)
    _, hidden = _file_system(spark, f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}")
    stream = fs.create(hidden, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    if fs.exists(final) or not fs.rename(hidden, final):
        fs.delete(hidden, False)
        raise FileExistsError(path)


def drop(spark: SparkSession, path: str) -> None:
    fs, at = _file_system(spark, path)
    fs.delete(at, True)


class Versions:
    """Numbered versions under ``folder``: data in versions/<id>, and manifests/<number>.json says which is current.

    A version is written whole, then one rename of its manifest makes it and its log row visible. A load that dies
    before leaves the version before it, and files that no manifest names, which ``vacuum`` removes.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _numbers(self) -> list[int]:
        return [int(n[:-5]) for n in names_in(self.spark, f"{self.folder}/manifests") if n.endswith(".json") and not n.startswith(".")]

    def manifests(self) -> list[dict]:
        """All that were published, in order. One for each load, so few and small."""
        return [json.loads(read_small(self.spark, f"{self.folder}/manifests/{n:08d}.json")) for n in sorted(self._numbers())]

    def current(self) -> str | None:
        """The folder of the version that readers see; None without one, or after a clear."""
        numbers = self._numbers()
        version = json.loads(read_small(self.spark, f"{self.folder}/manifests/{max(numbers):08d}.json"))["version"] if numbers else None
        return version and f"{self.folder}/versions/{version}"

    def begin(self) -> tuple[str, str]:
        """A new version's id, and the folder to write it to."""
        version = uuid.uuid4().hex
        return version, f"{self.folder}/versions/{version}"

    def publish(self, version: str | None, **facts: object) -> int:
        """Makes ``version`` (None: no graph) the current one, with ``facts`` in its manifest; returns its number."""
        number = max(self._numbers(), default=-1) + 1
        text = json.dumps({"number": number, "version": version, "import_time": datetime.now(UTC).strftime("%Y-%m-%d %H:%M:%S.%f"), **facts})
        publish(self.spark, f"{self.folder}/manifests/{number:08d}.json", text)
        return number

    def vacuum(self, keep: int = 2) -> list[str]:
        """Removes the data of all versions but the last ``keep`` published ones; returns their ids. Manifests, which
        are the log, stay. Not for use while a load is running."""
        published = list(dict.fromkeys(m["version"] for m in reversed(self.manifests()) if m["version"]))  # the last first
        kept = published[:keep]
        gone = [v for v in names_in(self.spark, f"{self.folder}/versions") if v not in kept]
        for version in gone:
            drop(self.spark, f"{self.folder}/versions/{version}")
        return gone


def write_ordered(rows: DataFrame, path: str, *order: Column, separator: str = ",", place: str = "place", compression: str = "none") -> None:
    """A folder of CSV files that hold ``rows`` in ``order``: file by file by name, and row by row within.

    Each row has its ``place``, from 0, as first column, and ``_manifest.json`` lists the files in order with the first
    place and the number of rows of each. Ranges are sorted by their own tasks and counted once; no task sees more than
    its range, and rows that are equal in ``order`` stay in one. The files come first, the manifest last.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = stash(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    counts = {r["_part"]: r["n"] for r in ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row for each range
    first, starts = 0, {}
    for part in sorted(counts):
        starts[part], first = first, first + counts[part]
    begin = F.lit(0).cast("long")
    if starts:
        begin = F.create_map(*[F.lit(v) for pair in starts.items() for v in pair])[F.col("_part")].cast("long")
    dealt = ranged.repartitionById(parts, F.col("_part")).sortWithinPartitions("_part", *order)
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = dealt.select((begin + within).alias(place), *rows.columns)
    with freeing(spark):
        placed.write.mode("overwrite").option("header", True).option("sep", separator).option("compression", compression).csv(path)
    release(ranged)
    files = {int(n.split("-")[1]): n for n in names_in(spark, path) if n.startswith("part-")}
    listed = [{"file": files[p], "first": starts[p], "rows": counts[p]} for p in sorted(starts)]
    publish(spark, f"{path}/_manifest.json", json.dumps({"place": place, "rows": first, "files": listed}))


def ordered_files(spark: SparkSession, path: str) -> list[dict]:
    """The files of an ordered folder, in order: file, first (place), rows."""
    return json.loads(read_small(spark, f"{path}/_manifest.json"))["files"]
