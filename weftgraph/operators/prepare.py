"""Observations to the statements that are parsed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.columns import content_key
from weftgraph.operators.bitmaps import distinct_rows


def of_organism(observations: DataFrame, organism: str) -> DataFrame:
    return observations.where(F.col("Organism") == organism)


def of_gene_form(observations: DataFrame, form: str) -> DataFrame:
    return observations.where(F.col("GeneForms") == form)


def canonical_only(observations: DataFrame, form: str = "protein") -> DataFrame:
    """For proteins, only statements that speak of no modified or alternative form; null statements go as well."""
    if form != "protein":
        return observations
    text = F.lower("Interaction")
    return observations.where(~text.contains("modified") & ~text.contains("alternative"))


def statements(observations: DataFrame, in_place: bool = False) -> DataFrame:
    """index, ChemicalName, GeneSymbol, Interaction, trimmed. The index is a hash of the row, so it is the same wherever
    and in whatever order rows are read; equal rows are one statement. ``in_place`` moves texts only where another row may
    be equal; it reads ``observations`` three times and keeps their partitions."""
    rows = observations.select(*[F.trim(c).alias(c) for c in ("ChemicalName", "GeneSymbol", "Interaction")])
    rows = distinct_rows(rows) if in_place else rows.distinct()
    return rows.select(content_key(F.col("ChemicalName"), F.col("GeneSymbol"), F.col("Interaction")).alias("index"), "ChemicalName", "GeneSymbol", "Interaction")


def report_counts(observations: DataFrame, organism: str, form: str) -> DataFrame:
    """One row: rows in all, of the organism, of the form as well, and canonical ones, in one pass."""
    a = F.col("Organism") == organism
    b = a & (F.col("GeneForms") == form)
    c = b if form != "protein" else b & ~F.lower("Interaction").contains("modified") & ~F.lower("Interaction").contains("alternative")
    return observations.agg(F.count(F.lit(1)).alias("total"), F.count_if(a).alias("of_organism"), F.count_if(b).alias("of_form"), F.count_if(c).alias("canonical"))


def distinct_by_type(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("type").agg(F.countDistinct("id").alias("n"))
