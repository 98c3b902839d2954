"""Invariants of a finished graph, each as a DataFrame of what breaks it, and one table of verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.columns import blank
from weftgraph.operators.graph import PropertyGraph


def repeated_node_ids(graph: PropertyGraph) -> DataFrame:
    return graph.vertices.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def _ends(graph: PropertyGraph) -> DataFrame:
    return graph.edges.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct()


def dangling_ends(graph: PropertyGraph) -> DataFrame:
    """Ends of edges that are no vertex."""
    return _ends(graph).where("id is not null").join(graph.vertices.select("id"), "id", "left_anti")


def orphan_nodes(graph: PropertyGraph) -> DataFrame:
    return graph.vertices.select("id").distinct().join(_ends(graph), "id", "left_anti")


def blank_columns(rows: DataFrame, columns: list[str], table: str) -> DataFrame:
    """(table, column, blanks), one row for each column, from one pass."""
    counted = rows.agg(*[F.count_if(blank(F.col(c))).alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("blanks")) for c in columns])
    return counted.select(F.explode(pairs).alias("p")).select(F.lit(table).alias("table"), "p.column", "p.blanks")


def missing_types(graph: PropertyGraph) -> DataFrame:
    """Of the three vertex types, those that no vertex has."""
    spark = graph.vertices.sparkSession
    all_ = spark.range(1).select(F.explode(F.array(F.lit("chemical"), F.lit("protein"), F.lit("reaction"))).alias("type"))
    return all_.join(graph.vertices.select("type").distinct(), "type", "left_anti")


def unmapped_entities(graph: PropertyGraph) -> DataFrame:
    """Chemicals without chem_ID and proteins without gene_ID."""
    bad = ((F.col("type") == "chemical") & blank(F.col("chem_ID"))) | ((F.col("type") == "protein") & blank(F.col("gene_ID")))
    return graph.vertices.where(bad).select("id", "type")


def reactions_without_single_ends(graph: PropertyGraph) -> DataFrame:
    """Reactions that have not exactly one AGENT_OF and one TARGET_OF edge: (reaction_id, agents, targets)."""
    number = lambda r: F.count_if(F.col("relationship") == r)
    counts = graph.edges.where(F.col("relationship").isin("AGENT_OF", "TARGET_OF")).groupBy("reaction_id").agg(number("AGENT_OF").alias("agents"), number("TARGET_OF").alias("targets"))
    return counts.where("agents <> 1 or targets <> 1")


def verdicts(graph: PropertyGraph) -> DataFrame:
    """(check, broken): how many rows break each of the invariants."""
    number = lambda name, rows: rows.agg(F.count(F.lit(1)).alias("broken")).select(F.lit(name).alias("check"), "broken")
    blanks = lambda rows, cols, t: blank_columns(rows, cols, t).agg(F.sum("blanks").alias("broken")).select(F.lit(f"blank_{t}").alias("check"), "broken")
    parts = [
        number("unique_node_ids", repeated_node_ids(graph)), number("edge_ends_exist", dangling_ends(graph)), number("no_orphans", orphan_nodes(graph)),
        blanks(graph.edges, ["source_id", "target_id", "relationship"], "edges"), blanks(graph.vertices, ["id", "name"], "nodes"),
        number("all_types", missing_types(graph)), number("mapped_entities", unmapped_entities(graph)), number("single_agent_target", reactions_without_single_ends(graph))]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
