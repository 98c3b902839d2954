"""Spark session, the folder all executors share, and lineage cuts."""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

#: Deletes a statement's shuffle files when it ends, not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Folders that were made inside each open ``staged``, the innermost last.
_OPEN: list[list[str]] = []
#: Rows that one of ``in_rounds`` shuffles, more or less, and the most rounds.
ROUND_ROWS, MOST_ROUNDS = 1_000_000, 8


def get_spark(app: str = "weftgraph", cpus: str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the engine relies on: UTC, AQE, Arrow."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Unset, a local session gets a temporary one; a cluster raises."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not (context.master == "local" or context.master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = getattr(context, "_weftgraph_dir", None)
    if own is None:
        own = tempfile.mkdtemp(prefix="weftgraph-")
        context._weftgraph_dir = own
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    return f"file://{own}"


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Python gets at most ``rows`` rows of texts at a time: a worker's memory then follows the text, not 10,000 rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, rows)


@contextmanager
def freeing(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files behind."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def stash(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage without a copy on one executor only: a lost executor costs nothing that was stashed. The
    shuffle files of the write go at its end. The folder goes by ``release``, at the end of the ``staged`` that it was
    made in, or when the driver's JVM ends. Rows go to files of their own for each value of ``by``, which has few, so that
    a filter on it reads no others.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stash-{uuid.uuid4().hex}"
    with freeing(spark):
        _parted(df.write, by).parquet(path)
    gone_with_driver(spark, path)
    found = spark.read.schema(df.schema).parquet(path)
    found = found.select(*df.columns) if by else found  # files' own columns come first
    found._stashed = path
    return found


def _parted(writer: DataFrameWriter, by: str | None) -> DataFrameWriter:
    writer = writer.option("compression", "zstd")
    return writer.partitionBy(by) if by else writer


def release(*stashed: DataFrame) -> None:
    """Delete what ``stash`` wrote, when nothing reads it any more. What was not stashed itself is left alone."""
    for df in stashed:
        path = getattr(df, "_stashed", None)
        if path:
            drop_path(df.sparkSession, path)


def staged(make: Callable[[], DataFrame]) -> DataFrame:
    """``stash(make())``; what was stashed meanwhile is read for the last time by this write, and goes after it.

    ``make`` must not hand out its tables by another way. Named rounds stay."""
    _OPEN.append([])
    try:
        out = stash(make())
    except BaseException:
        _OPEN.pop()
        raise
    made = _OPEN.pop()
    for path in made:
        if path != out._stashed:
            drop_path(out.sparkSession, path)
    if _OPEN:
        _OPEN[-1].append(out._stashed)
    return out


def in_rounds(make: Callable[..., DataFrame], key: str, rows: DataFrame, *others: DataFrame) -> DataFrame:
    """``make(rows, *others)``, stashed, by parts: all tables are dealt by the hash of their column ``key`` and ``make`` sees one
    part of each at a time, so that shuffle and spill files of one part lie there at once. ``make`` must give the same rows for
    the parts as for the whole. The tables are read once a round and should be stashed."""
    spark = rows.sparkSession
    rounds = max(1, min(MOST_ROUNDS, math.ceil(rows.count() / ROUND_ROWS)))
    path = f"{shared_dir(spark)}/stash-{uuid.uuid4().hex}"
    for number in range(rounds):
        _OPEN.append([])
        try:
            part = make(*[t.where(F.pmod(F.xxhash64(key), F.lit(rounds)) == number) for t in (rows, *others)])
            with freeing(spark):
                part.write.mode("append").option("compression", "zstd").parquet(path)
        finally:
            for inner in _OPEN.pop():
                drop_path(spark, inner)
    gone_with_driver(spark, path)
    return backed(spark.read.schema(part.schema).parquet(path), path)


def backed(df: DataFrame, by: DataFrame | str) -> DataFrame:
    """``df``, which reads nothing but what was stashed as ``by``: ``release`` of it deletes that."""
    df._stashed = by if isinstance(by, str) else by._stashed
    return df


def _file_system(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def gone_with_driver(spark: SparkSession, path: str) -> None:
    """Let the file system delete ``path``, which must be there, when the driver's JVM ends."""
    fs, hadoop = _file_system(spark, path)
    fs.deleteOnExit(hadoop)
    if _OPEN:
        _OPEN[-1].append(path)


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared one, which goes when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
    fs, hadoop = _file_system(spark, path)
    fs.mkdirs(hadoop)
    gone_with_driver(spark, path)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through Spark's file systems, wherever it lies."""
    fs, hadoop = _file_system(spark, path)
    fs.delete(hadoop, True)


class Rounds:
    """The rounds of a loop, recorded by name in the shared folder, so that a driver that dies can go on at the last one.

    A round's tables are written whole and then marked; a round without its mark is none. Once a round is marked, those
    before the one before it are dropped: the folder holds two at most. The same name must mean the same input. Without a
    name nothing outlives the driver.
    """

    def __init__(self, spark: SparkSession, name: str | None = None) -> None:
        self.spark, self.named = spark, name is not None
        self.path = f"{shared_dir(spark)}/rounds-{name or uuid.uuid4().hex}"

    def recorded(self) -> list[int]:
        """The marked rounds, ascending."""
        fs, folder = _file_system(self.spark, self.path)
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n[5:]) for n in names if n.startswith("done-"))

    def last(self) -> tuple[int, dict[str, DataFrame]]:
        """The last marked round and its tables; -1 and none before the first."""
        numbers = self.recorded()
        return (numbers[-1], self._tables(numbers[-1])) if numbers else (-1, {})

    def _tables(self, number: int) -> dict[str, DataFrame]:
        fs, folder = _file_system(self.spark, f"{self.path}/round-{number}")
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return {n: self.spark.read.parquet(f"{self.path}/round-{number}/{n}") for n in sorted(names)}

    def keep(self, number: int, **tables: DataFrame) -> dict[str, DataFrame]:
        """Records a round and returns its tables, read back."""
        with freeing(self.spark):
            for name, table in tables.items():
                table.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/round-{number}/{name}")
        fs, mark = _file_system(self.spark, f"{self.path}/done-{number}")
        fs.create(mark, True).close()
        if not self.named:
            gone_with_driver(self.spark, self.path)
        for old in self.recorded()[:-2]:
            drop_path(self.spark, f"{self.path}/done-{old}")  # the mark first
            drop_path(self.spark, f"{self.path}/round-{old}")
        return {n: self.spark.read.schema(t.schema).parquet(f"{self.path}/round-{number}/{n}") for n, t in tables.items()}

    def finish(self) -> None:
        """Forget all rounds, when the loop's result is somewhere else."""
        drop_path(self.spark, self.path)
