"""Canonical triples to a typed property graph."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.columns import relationship, short_key
from weftgraph.operators.bitmaps import distinct_rows, split, thin
from weftgraph.operators.canonical import entity_name, least_ids
from weftgraph.operators.skew import join_facts
from weftgraph.operators.triples import ACTION, AGENT, MAIN, NESTED, TARGET
from weftgraph.session import stash

ONTOLOGICAL = ("AGENT_OF", "TARGET_OF", "HAS_AGENT", "HAS_TARGET")


@dataclass(frozen=True)
class PropertyGraph:
    """vertices(id, name, type, chem_ID, gene_ID, action) and edges(source_id, target_id, relationship, reaction_id, type)."""

    vertices: DataFrame
    edges: DataFrame

    def only(self, kind: str) -> PropertyGraph:
        """All vertices, and the edges of one type."""
        return PropertyGraph(self.vertices, self.edges.where(F.col("type") == kind))


def _reaction_nodes(triples: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    subject = (F.col("subject").startswith(MAIN) | F.col("subject").contains(NESTED)) & (F.col("predicate") == ACTION)
    of_reactions = triples.where(subject).where("object is not null").select("subject", F.col("object").alias("action"))
    return distinct_rows(of_reactions).select(
        F.col("subject").alias("id"), F.col("subject").alias("name"), F.lit("reaction").alias("type"), none.alias("chem_ID"), none.alias("gene_ID"), "action")


def define_nodes(triples: DataFrame) -> DataFrame:
    """Reactions by their subjects (with their action) and entities by their objects; a reaction without an action is none."""
    of_entities = triples.where(F.col("triple_object_type").isin("chemical", "protein")).select(
        "id", F.col("object").alias("name"), F.col("triple_object_type").alias("type"), "chem_ID", "gene_ID", F.lit(None).cast("string").alias("action"))
    return of_entities.distinct().unionByName(_reaction_nodes(triples))


def nodes_of_named(named: DataFrame) -> DataFrame:
    """``define_nodes`` of the triples that ``canonical.of_named`` makes of ``named``: nodes are distinct, so neither all
    triples' entity ids nor distinct triples are needed. Entities are made distinct before they get the smallest ids."""
    least = least_ids(named)
    own = named.withColumn("_name", entity_name()).where("_name is not null").select("_name", "object", "triple_object_type", "chem_ID", "gene_ID").distinct()
    of_entities = own.join(least, "_name").select(
        F.col("_least").alias("id"), F.col("object").alias("name"), F.col("triple_object_type").alias("type"), "chem_ID", "gene_ID", F.lit(None).cast("string").alias("action"))
    return of_entities.unionByName(_reaction_nodes(named))


def named_by_id(triples: DataFrame, nodes: DataFrame) -> DataFrame:
    """Entities' names in object replaced by their node's id; actions, unknown names and reactions stay.

    A reaction's name is its id already, in subject and object alike, so only entities are looked up. Names of one type
    are unique once entities are unified, so this repeats no row. Names in more than a thousandth of the rows are
    broadcast, so one that a third of all statements mention is not one task's. ``triples`` should be stashed."""
    ids = nodes.where("type <> 'reaction'").groupBy(F.col("name").alias("object")).agg(F.min("id").alias("_id"))
    entity = F.col("triple_object_type").isin("chemical", "protein")
    own = triples.where(entity)
    named = own.where("object is not null").groupBy("object").agg(F.count(F.lit(1)).alias("_n")).join(ids, "object", "left")
    found = join_facts(own, stash(named), "object", "_n")
    rest = triples.where(~entity | F.col("triple_object_type").isNull())
    return found.select(*[F.coalesce("_id", "object").alias("object") if c == "object" else F.col(c) for c in triples.columns]).unionByName(rest)


def define_edges(named: DataFrame) -> DataFrame:
    """For each reaction agent -> target with its action, AGENT_OF and TARGET_OF into it, and their inverses out of it."""
    value = lambda p: F.min(F.when(F.col("predicate") == p, F.col("object")))
    whole = named.groupBy(F.col("subject").alias("reaction_id")).agg(value(AGENT).alias("agent"), value(ACTION).alias("action"), value(TARGET).alias("target"))
    return edges_of_reactions(whole)


def edges_of_reactions(whole: DataFrame) -> DataFrame:
    """As define_edges, from rows (reaction_id, agent, action, target) with one row for each reaction, so that no edge
    comes twice and none has to be compared with others."""
    def edge(source: str, target: str, label, kind: str):
        return F.struct(F.col(source).alias("source_id"), F.col(target).alias("target_id"), label.alias("relationship"), F.col("reaction_id"), F.lit(kind).alias("type"))

    five = F.array(
        edge("agent", "target", relationship(F.col("action")), "functional"),
        edge("agent", "reaction_id", F.lit("AGENT_OF"), "ontological"),
        edge("target", "reaction_id", F.lit("TARGET_OF"), "ontological"),
        edge("reaction_id", "agent", F.lit("HAS_AGENT"), "ontological"),
        edge("reaction_id", "target", F.lit("HAS_TARGET"), "ontological"))
    rows = whole.select(F.explode(five).alias("e")).select("e.*")
    return rows.where("source_id is not null and target_id is not null and relationship is not null")


def build_graph(triples: DataFrame) -> PropertyGraph:
    nodes = define_nodes(triples)
    return PropertyGraph(nodes, define_edges(named_by_id(triples, nodes)))


def matched(graph: PropertyGraph) -> PropertyGraph:
    """Edges with an end that is no vertex are left out, as a load by matching both ends does.

    The ends that are no vertex are found by keys of 16 bytes. Only edges that may have one are joined with those; a bitmap
    tells, so others stay where they are."""
    there = graph.edges.where("source_id is not null and target_id is not null")
    ends = there.select(F.explode(F.array(short_key(F.col("source_id")), short_key(F.col("target_id")))).alias("_end")).distinct()
    missing = stash(ends.join(graph.vertices.select(short_key(F.col("id")).alias("_end")), "_end", "left_anti"))
    if not missing.isEmpty():
        for end in ("source_id", "target_id"):
            some, others = split(there, short_key(F.col(end)), missing)
            some = some.withColumn("_end", short_key(F.col(end))).join(missing, "_end", "left_anti").drop("_end")
            there = some.unionByName(others)
    return PropertyGraph(graph.vertices, there.select(*graph.edges.columns))


def between(graph: PropertyGraph) -> PropertyGraph:
    """``matched`` where most edges have an end that is no vertex: a bitmap of the vertices' keys leaves those out before any
    end is compared or moved."""
    keys, edges = stash(graph.vertices.select(short_key(F.col("id")).alias("_end"))), graph.edges
    for end in ("source_id", "target_id"):
        edges = thin(edges.withColumn("_end", short_key(F.col(end))), keys, "_end").drop("_end")
    return matched(PropertyGraph(graph.vertices, stash(edges)))
