"""Readers and writers of observations, vocabularies, graphs, results and the import log."""

from __future__ import annotations

import re
import uuid
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.functions.columns import short_key
from weftgraph.operators.graph import PropertyGraph, between, matched
from weftgraph.session import freeing
from weftgraph.sources.store import Versions

# The columns of the observation and disease files, which have no header.
OBSERVATION_COLUMNS = ("ChemicalName", "ChemicalID", "CasRN", "GeneSymbol", "GeneID", "GeneForms", "Organism", "OrganismID", "Interaction", "InteractionActions", "PubMedIDs")
DISEASE_COLUMNS = ("ChemicalName", "ChemicalID", "CasRN", "DiseaseName", "DiseaseID", "DirectEvidence", "PubMedIDs")
NODE_COLUMNS = ("id", "name", "type", "chem_ID", "gene_ID", "action")
EDGE_COLUMNS = ("source_id", "target_id", "relationship", "reaction_id", "type")
LOG_SCHEMA = T.StructType([T.StructField(n, T.TimestampType() if n == "import_time" else T.StringType()) for n in ("id", "nodes_file", "edges_file", "organism", "status", "import_time")])


def _strings(columns: tuple[str, ...]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    """A headerless CSV with all columns as strings."""
    return spark.read.csv(path, schema=_strings(OBSERVATION_COLUMNS), header=False)


def read_diseases(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema=_strings(DISEASE_COLUMNS), header=False)


def read_chemicals(spark: SparkSession, path: str) -> DataFrame:
    """(chem_ID, chem_name) from a CSV with a header; other columns are not read."""
    return spark.read.csv(path, header=True).select(F.col("ChemicalID").alias("chem_ID"), F.col("ChemicalName").alias("chem_name"))


def read_genes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True).select(F.col("GeneID").alias("gene_ID"), F.col("GeneName").alias("gene_name"), F.col("GeneSymbol").alias("gene_symbol"))


def read_inferred(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header whose types are inferred, which reads it twice; results at hand need no reading back."""
    return spark.read.csv(path, header=True, inferSchema=True)


def write_csv(rows: DataFrame, path: str, separator: str = ",", single: bool = False, compression: str = "none") -> None:
    """A CSV with a header; ``single`` makes one file, by one task, and is for reports of one row. ``compression`` (gzip)
    is for large tables that Spark reads again; each file is then read by one task, as it was written by one."""
    with freeing(rows.sparkSession):
        (rows.coalesce(1) if single else rows).write.mode("overwrite").option("header", True).option("sep", separator).option("compression", compression).csv(path)


def write_quoteless(rows: DataFrame, path: str) -> None:
    """Values with ; between them and a backslash before one that holds it; no quotes."""
    escaped = [F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"([;\\])", r"\\$1") for c in rows.columns]
    rows.select(F.concat_ws(";", *escaped).alias("value")).write.mode("overwrite").text(path)


def suffixed(path: str, organism: str) -> str:
    """``name.ext`` to ``name_homo_sapiens.ext``."""
    p = PurePosixPath(path)
    return str(p.with_name(f"{p.stem}_{organism.lower().replace(' ', '_')}{p.suffix}"))


def bare_name(name: str) -> str:
    """``name`` if it is a file name and no path; else ValueError."""
    if not name or name in (".", "..") or re.search(r"[/\\]", name):
        raise ValueError(f"not a bare file name: {name!r}")
    return name


def read_graph_csv(spark: SparkSession, nodes: str, edges: str) -> PropertyGraph:
    return PropertyGraph(spark.read.csv(nodes, header=True).select(*NODE_COLUMNS), spark.read.csv(edges, header=True).select(*EDGE_COLUMNS))


def save_graph(graph: PropertyGraph, folder: str, overwrite: bool = True, nodes_file: str = "nodes", edges_file: str = "edges", organism: str = "", keep: int = 2) -> bool:
    """A new version of the graph in ``folder``: vertices and edges as Parquet, parted by type, so that a filter on it
    prunes files. False, and nothing written, if there is a graph and it may not be overwritten.

    Both tables and the log row become visible together, by the rename of one manifest; a load that fails or dies leaves
    the graph that was there. Versions before the last ``keep`` are removed. Repeated vertex ids raise; edges with an end
    that is no vertex are left out."""
    spark = graph.vertices.sparkSession
    if not overwrite and graph_exists(spark, folder):
        return False
    with freeing(spark):
        unique = graph.vertices.groupBy(short_key(F.col("id"))).count().where("count > 1").isEmpty()
    if not unique:
        raise ValueError("vertex ids are not unique")
    store = Versions(spark, folder)
    version, path = store.begin()
    kept = matched(graph)
    with freeing(spark):
        for name, rows in (("vertices", kept.vertices), ("edges", kept.edges)):
            rows.write.partitionBy("type").option("compression", "zstd").parquet(f"{path}/{name}")
    store.publish(version, **_log_row(nodes_file, edges_file, organism, "COMPLETED"))
    store.vacuum(keep)
    return True


def clear_graph(spark: SparkSession, folder: str) -> None:
    """No graph any more, at once; its data go afterwards. The log stays, with a row that says so."""
    store = Versions(spark, folder)
    store.publish(None, **_log_row("", "", "", "CLEARED"))
    store.vacuum(0)


def graph_exists(spark: SparkSession, folder: str) -> bool:
    return Versions(spark, folder).current() is not None


def load_graph(spark: SparkSession, folder: str, types: list[str] | None = None) -> PropertyGraph:
    """The saved graph; with ``types`` only such vertices, and edges with both ends among them."""
    schema = lambda columns: _strings(columns)
    current = Versions(spark, folder).current()
    if current is None:
        raise FileNotFoundError(f"no graph in {folder}")
    vertices = spark.read.schema(schema(NODE_COLUMNS)).parquet(f"{current}/vertices").select(*NODE_COLUMNS)
    edges = spark.read.schema(schema(EDGE_COLUMNS)).parquet(f"{current}/edges").select(*EDGE_COLUMNS)
    if types is None:
        return PropertyGraph(vertices, edges)
    return between(PropertyGraph(vertices.where(F.col("type").isin(types)), edges))


def _log_row(nodes_file: str, edges_file: str, organism: str, status: str) -> dict[str, str]:
    return {"id": uuid.uuid4().hex, "nodes_file": nodes_file, "edges_file": edges_file, "organism": organism, "status": status}


def append_log(spark: SparkSession, folder: str, nodes_file: str, edges_file: str, organism: str, status: str = "COMPLETED") -> None:
    """A log row that changes no data, such as of a load that failed."""
    store = Versions(spark, folder)
    current = store.current()
    store.publish(current and current.rpartition("/")[2], **_log_row(nodes_file, edges_file, organism, status))


def read_log(spark: SparkSession, folder: str) -> DataFrame:
    """LOG_SCHEMA and ``number``: the manifests are the log, so it has what was published and nothing else."""
    schema = T.StructType([*LOG_SCHEMA.fields, T.StructField("number", T.LongType())])
    return spark.read.schema(schema).option("timestampFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").json(f"{folder}/manifests/*.json")


def latest_imports(log: DataFrame, n: int = 1) -> DataFrame:
    """The last ``n`` rows by time; of equal times the one that was published later, or has the larger id."""
    ties = [F.desc("number")] if "number" in log.columns else []
    return log.orderBy(F.desc("import_time"), *ties, F.desc("id")).limit(n)


def write_paths(paths: DataFrame, folder: str, target_id: str, organism: str) -> None:
    """Path results of one target and organism, as folders that reading discovers again."""
    paths.withColumns({"target_id": F.lit(target_id), "organism": F.lit(organism.lower().replace(" ", "_"))}).write.mode("append").partitionBy("target_id", "organism").parquet(folder)


def read_paths(spark: SparkSession, folder: str, organism: str) -> DataFrame:
    """All targets' paths for an organism, whatever its case and blanks."""
    return spark.read.parquet(folder).where(F.lower(F.regexp_replace(F.trim("organism"), r"\s+", "_")) == organism.strip().lower().replace(" ", "_"))


_PATH_FILE = r"shortest_path__([^/]+?)__([^/]+)\.csv(?:/[^/]+)?$"


def read_path_files(spark: SparkSession, folder: str, organism: str) -> DataFrame:
    """Path CSVs named shortest_path__<id>__<organism>.csv, files or folders of files, with the id as target_id."""
    rows = spark.read.option("header", True).option("sep", ";").csv(f"{folder}/shortest_path__*.csv")
    name = F.url_decode(F.input_file_name())
    named = rows.withColumn("_file", name).withColumn("target_id", F.regexp_extract("_file", _PATH_FILE, 1)).withColumn("_organism", F.regexp_extract("_file", _PATH_FILE, 2))
    return named.where(F.lower(F.replace(F.col("_organism"), F.lit(" "), F.lit("_"))) == organism.strip().lower().replace(" ", "_")).drop("_file", "_organism")
