"""Counts over observations: species, pairs, action codes, and how texts agree with their columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.lexicon import ACTIONS, CONCEPTS, escaped


def species_counts(observations: DataFrame) -> DataFrame:
    return observations.groupBy("Organism").agg(F.count(F.lit(1)).alias("RecordCount"))


def gene_forms(observations: DataFrame, organism: str) -> DataFrame:
    """The organism's forms in upper case, without white space around them, each once."""
    return observations.where(F.col("Organism") == organism).select(F.upper(F.trim("GeneForms")).alias("gene_form")).distinct()


def value_counts(rows: DataFrame, *columns: str) -> DataFrame:
    """How often each combination without a null occurs."""
    return rows.dropna(subset=list(columns)).groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def common_values(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    return left.select(column).where(F.col(column).isNotNull()).intersect(right.select(column))


def species_statistics(observations: DataFrame, diseases: DataFrame, organism: str) -> DataFrame:
    """One row of figures about an organism's observations and the diseases of its chemicals."""
    both = observations.agg(F.count(F.lit(1)).alias("total_records"), F.count_if(F.col("Organism") == organism).alias("organism_records"))
    own = observations.where(F.col("Organism") == organism)
    distinct = own.agg(
        F.countDistinct(F.when(F.col("GeneForms") == "protein", F.col("GeneSymbol"))).alias("distinct_proteins"),
        F.countDistinct("ChemicalName").alias("distinct_molecules"), F.countDistinct("ChemicalID").alias("distinct_molecule_ids"))
    shared = common_values(own, diseases, "ChemicalID")
    of_shared = diseases.join(shared, "ChemicalID", "left_semi")
    illness = of_shared.agg(
        F.countDistinct("ChemicalID").alias("common_molecules"), F.count(F.lit(1)).alias("disease_records"),
        F.countDistinct("ChemicalName", "DiseaseName").alias("molecule_disease_pairs"))
    one = lambda rows: rows.withColumn("_one", F.lit(1))
    row = one(both).join(one(distinct), "_one").join(one(illness), "_one").drop("_one")  # one row each
    share = F.round(100 * F.col("organism_records") / F.greatest("total_records", F.lit(1)), 2)
    return row.select(F.lit(organism).alias("organism"), "total_records", "organism_records", share.alias("organism_percent"), "distinct_proteins", "distinct_molecules", "distinct_molecule_ids", "common_molecules", "disease_records", "molecule_disease_pairs")


def action_pairs(observations: DataFrame) -> DataFrame:
    """(predicate, object, n) of the action codes ``predicate^object|...``; a code is cut at its first ^."""
    codes = observations.select("InteractionActions").where("InteractionActions is not null").groupBy("InteractionActions").agg(F.count(F.lit(1)).alias("n"))
    one = codes.select(F.explode(F.split("InteractionActions", r"\|")).alias("code"), "n").where(F.col("code").contains("^"))
    return one.groupBy(F.split("code", r"\^", 2)[0].alias("predicate"), F.split("code", r"\^", 2)[1].alias("object")).agg(F.sum("n").alias("n"))


def action_code_lists(observations: DataFrame) -> DataFrame:
    """One row: the sorted predicates and objects that action codes use."""
    return action_pairs(observations).agg(F.sort_array(F.collect_set("predicate")).alias("predicates"), F.sort_array(F.collect_set("object")).alias("objects"))


def entity_in_text(observations: DataFrame, ignore_case: bool = False) -> DataFrame:
    """(both_present, n): whether the statement names its chemical and its gene; a null is the text nan."""
    text = lambda c: F.coalesce(F.col(c), F.lit("nan"))
    shape = (lambda c: F.lower(text(c))) if ignore_case else text
    both = shape("Interaction").contains(shape("ChemicalName")) & shape("Interaction").contains(shape("GeneSymbol"))
    return observations.groupBy(both.alias("both_present")).agg(F.count(F.lit(1)).alias("n"))


# Fixed value: endings cut off an action code's part to get at its stem.
_ENDINGS = r"(es|s|ed|ing|ion|ism|ity)$"


def actions_in_text(codes: Column, statement: Column) -> Column:
    """Whether all parts of the codes are found in the statement: as they are, by a stem of over three letters, or by a
    word for the same concept."""
    text = F.coalesce(F.lower(statement), F.lit("nan"))
    parts = F.split(F.coalesce(F.lower(codes), F.lit("nan")), r"[\^|]")
    by_concept = {k: text.rlike("|".join(map(escaped, words))) for k, words in CONCEPTS.items()}

    def meant(part: Column) -> Column:
        out = F.lit(False)
        for name, found in by_concept.items():
            out = F.when(part == name, found).otherwise(out)
        return out

    def verified(part: Column) -> Column:
        part = F.trim(part)
        stem = F.regexp_replace(part, _ENDINGS, "")
        return (part == "") | text.contains(part) | ((F.length(stem) > 3) & text.contains(stem)) | meant(part) | meant(stem)

    return F.forall(parts, verified)


def action_synonym_check(observations: DataFrame) -> DataFrame:
    return observations.groupBy(actions_in_text(F.col("InteractionActions"), F.col("Interaction")).alias("actions_present")).agg(F.count(F.lit(1)).alias("n"))


def lexicon_coverage(observations: DataFrame, actions: tuple[str, ...] = ACTIONS) -> DataFrame:
    """(found, n): whether a statement holds any action phrase."""
    pattern = "|".join(escaped(a) for a in actions)
    re.compile(pattern)
    return observations.groupBy(F.col("Interaction").rlike(pattern).alias("found")).agg(F.count(F.lit(1)).alias("n"))


def distinct_sorted(observations: DataFrame, column: str) -> DataFrame:
    """A column's values without quotes, each once, in order."""
    return observations.select(F.replace(F.col(column), F.lit('"'), F.lit("")).alias(column)).distinct().orderBy(column)
