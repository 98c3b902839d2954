"""What the dashboards ask of a graph, as functions from a graph and parameters to DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.operators.graph import PropertyGraph


def _ids(graph: PropertyGraph, ids: list[str]) -> DataFrame:
    return graph.vertices.where(F.col("id").isin(ids))


def _end(vertices: DataFrame, side: str) -> DataFrame:
    return vertices.select(F.col("id").alias(f"{side}_id"), F.coalesce("name", "id").alias(f"{side}_name"), F.col("type").alias(f"{side}_type"))


def node_metadata(graph: PropertyGraph, ids: list[str]) -> DataFrame:
    """The properties of these vertices; N/A where there is none."""
    text = [F.coalesce(F.col(c), F.lit("N/A")).alias(c) for c in ("name", "type", "chem_ID", "gene_ID", "action")]
    return _ids(graph, ids).select("id", *text)


def find_by_name(graph: PropertyGraph, name: str) -> str:
    """The smallest id of the vertices with this name in any case; none raises LookupError."""
    row = graph.vertices.where(F.lower("name") == name.lower()).agg(F.min("id")).first()
    if row[0] is None:
        raise LookupError(name)
    return row[0]


def names_of(graph: PropertyGraph, ids: DataFrame, default: str | None = None) -> DataFrame:
    """``ids(id)`` with the vertex's name, or else ``default`` (None: the id itself)."""
    fallback = F.col("id") if default is None else F.lit(default)
    return ids.join(graph.vertices.select("id", "name"), "id", "left").select("id", F.coalesce("name", fallback).alias("name"))


def neighbourhood(graph: PropertyGraph, id_: str) -> DataFrame:
    """Edges that leave (out) or enter (in) a vertex: direction, neighbour_id, neighbour_name, neighbour_type, relationship, reaction_id, type."""
    leaving = graph.edges.where(F.col("source_id") == id_).select(F.lit("out").alias("direction"), F.col("target_id").alias("neighbour_id"), "relationship", "reaction_id", F.col("type"))
    entering = graph.edges.where(F.col("target_id") == id_).select(F.lit("in").alias("direction"), F.col("source_id").alias("neighbour_id"), "relationship", "reaction_id", F.col("type"))
    return leaving.unionByName(entering).join(_end(graph.vertices, "neighbour"), "neighbour_id").select("direction", "neighbour_id", "neighbour_name", "neighbour_type", "relationship", "reaction_id", "type")


def induced_subgraph(graph: PropertyGraph, ids: list[str]) -> DataFrame:
    """The edges between these vertices."""
    return graph.edges.where(F.col("source_id").isin(ids) & F.col("target_id").isin(ids))


def reaction_expansion(graph: PropertyGraph, ids: list[str]) -> DataFrame:
    """induced_subgraph, and what the reactions among the vertices have as agents and targets."""
    out = graph.edges.where(F.col("relationship").isin("HAS_AGENT", "HAS_TARGET") & F.col("source_id").isin(ids))
    reactions = graph.vertices.where(F.col("id").isin(ids) & (F.col("type") == "reaction")).select(F.col("id").alias("source_id"))
    return induced_subgraph(graph, ids).unionByName(out.join(reactions, "source_id", "left_semi").select(*graph.edges.columns)).distinct()


def path_edges_forward(graph: PropertyGraph, path: list[str]) -> DataFrame:
    """The edges between vertices of a path that run along it, one for each (source, target, relationship)."""
    order = F.array(*[F.lit(p) for p in path])
    rows = induced_subgraph(graph, path).where(F.array_position(order, F.col("source_id")) < F.array_position(order, F.col("target_id")))
    return rows.groupBy("source_id", "target_id", "relationship").agg(F.min("reaction_id").alias("reaction_id"), F.min("type").alias("type"))


def path_nodes(graph: PropertyGraph, path: list[str]) -> DataFrame:
    """The vertices of a path with their place on it."""
    spark = graph.vertices.sparkSession
    places = spark.range(1).select(F.posexplode(F.array(*[F.lit(p) for p in path])).alias("place", "id"))
    return places.join(graph.vertices.select("id", "name", "type"), "id").select("place", "id", "name", "type")


def predicted_link_subgraph(graph: PropertyGraph, source: str, target: str, score: float) -> DataFrame:
    """A predicted link in context: kind (real, predicted, expansion) and the edge's columns, with the score."""
    ids = [source, target]
    none = F.lit(None).cast("double")
    real = induced_subgraph(graph, ids).where("type = 'functional'").select(F.lit("real").alias("kind"), "source_id", "target_id", "relationship", "reaction_id", none.alias("score"))
    spark = graph.vertices.sparkSession
    virtual = spark.range(1).select(F.lit("predicted").alias("kind"), F.lit(source).alias("source_id"), F.lit(target).alias("target_id"), F.lit("PREDICTED").alias("relationship"), F.lit(None).cast("string").alias("reaction_id"), F.lit(float(score)).alias("score"))
    reactions = _ids(graph, ids).where("type = 'reaction'").select(F.col("id").alias("source_id"))
    more = graph.edges.where(F.col("relationship").isin("HAS_AGENT", "HAS_TARGET")).join(reactions, "source_id", "left_semi")
    more = more.select(F.lit("expansion").alias("kind"), "source_id", "target_id", "relationship", "reaction_id", none.alias("score"))
    return real.unionByName(virtual).unionByName(more).distinct()


def kpi_by_type(vertices: DataFrame) -> DataFrame:
    """One row: how many vertices of each type, and in all."""
    number = lambda t: F.count_if(F.col("type") == t)
    return vertices.agg(number("chemical").alias("chemicals"), number("protein").alias("proteins"), number("reaction").alias("reactions"), F.count(F.lit(1)).alias("total"))


def top_n(rows: DataFrame, by: str, n: int, tie: str = "id") -> DataFrame:
    """The n rows with the largest ``by``, the smallest ``tie`` of equals, with their rank."""
    ordered = rows.orderBy(F.desc(by), tie).limit(n)
    return ordered.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(by), tie)))  # of n rows


def top_n_with_others(rows: DataFrame, group: str, n: int, other: str = "Others") -> DataFrame:
    """Sizes of the n largest groups and of all others in one, with their share in percent (2 digits)."""
    counts = rows.groupBy(F.coalesce(F.col(group), F.lit("Unassigned")).alias(group)).agg(F.count(F.lit(1)).alias("n"))
    first = top_n(counts, "n", n, group).select(group).withColumn("_top", F.lit(True))
    named = counts.join(F.broadcast(first), group, "left").select(F.when(F.col("_top"), F.col(group)).otherwise(other).alias(group), "n")
    total = counts.agg(F.sum("n")).first()[0] or 1
    return named.groupBy(group).agg(F.sum("n").alias("n")).withColumn("percent", F.round(100 * F.col("n") / F.lit(total), 2))


def community_distribution(rows: DataFrame, component_id: str | None = None) -> DataFrame:
    """Vertices for each community, within a component if one is named; no community is Unassigned."""
    own = rows if component_id is None else rows.where(F.col("component_id") == component_id)
    return own.groupBy(F.coalesce("community", F.lit("Unassigned")).alias("community")).agg(F.count(F.lit(1)).alias("n"))


def communities_per_component(rows: DataFrame) -> DataFrame:
    return rows.groupBy("component_id").agg(F.countDistinct("community").alias("communities"), F.count(F.lit(1)).alias("vertices"))


def reachable_count(paths: DataFrame) -> DataFrame:
    """One row: vertices with a path of at least an edge; hops that are no number count as none."""
    return paths.agg(F.count_if(F.col("hops").try_cast("int") > 0).alias("reachable"))


def prediction_table(predictions: DataFrame, threshold: float | None = None) -> DataFrame:
    """Labels each prediction: by what exists alone (TP or FP), or, with a threshold, as a confusion matrix does."""
    exists = F.col("Actual_Exist") == "YES"
    if threshold is None:
        return predictions.withColumn("outcome", F.when(exists, "TP").otherwise("FP"))
    yes = F.col("Score") >= threshold
    return predictions.withColumn("outcome", F.when(exists & yes, "TP").when(exists, "FN").when(yes, "FP").otherwise("TN"))
