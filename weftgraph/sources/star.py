"""Graph inputs out of star-schema tables: which lines sold stand for which statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.columns import reaction_key
from weftgraph.operators.graph import PropertyGraph, edges_of_reactions

#: Worlds that lines are dealt to by their order: a third of all orders to the first, the others evenly.
WORLDS = 997
_ACTION = {"AF": "results in increased expression of", "NF": "results in decreased activity of", "NO": "affects the localization of", "RF": "co-treated with"}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def action_column():
    out = F.lit("binds to")
    for flags, phrase in _ACTION.items():
        out = F.when(F.concat("l_returnflag", "l_linestatus") == flags, phrase).otherwise(out)
    return out


def _sold(spark: SparkSession, sf_dir: str, worlds: bool) -> DataFrame:
    """(l_partkey, l_suppkey, number, world): each once, the action as its number."""
    order = F.col("l_orderkey")
    world = F.when(order % 3 == 0, F.lit(0)).otherwise(1 + order % (WORLDS - 1)) if worlds else F.lit(0)
    number = F.array_position(_phrases(), action_column()).cast("int")  # phrases come back after the shuffle
    return read(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", number.alias("number"), world.cast("int").alias("world")).distinct()


def _phrases():
    return F.array(*[F.lit(p) for p in (*_ACTION.values(), "binds to")])


def _own(kind: str, key: str, worlds: bool):
    return F.concat(F.lit(f"{kind}_"), *([F.col("world").cast("string"), F.lit("_")] if worlds else []), F.col(key).cast("string"))


def reactions(spark: SparkSession, sf_dir: str, worlds: bool = False) -> DataFrame:
    """(reaction_id, agent, action, target, chem_key, gene_key): each distinct (part, action, supplier) of all lines.

    With ``worlds`` each world has parts and suppliers of its own: one component with a third of all rows, and many small
    ones, where all lines together are one component."""
    return _named(_sold(spark, sf_dir, worlds), worlds)


def _named(rows: DataFrame, worlds: bool) -> DataFrame:
    named = rows.select(
        _own("chemical", "l_partkey", worlds).alias("agent"), F.element_at(_phrases(), F.col("number")).alias("action"), _own("protein", "l_suppkey", worlds).alias("target"),
        F.col("l_partkey").alias("chem_key"), F.col("l_suppkey").alias("gene_key"))
    return named.select(reaction_key(F.col("agent"), F.col("action"), F.col("target")).alias("reaction_id"), "agent", "action", "target", "chem_key", "gene_key")


def graph(spark: SparkSession, sf_dir: str, worlds: bool = False) -> PropertyGraph:
    """Parts are chemicals, suppliers are proteins, what was sold how is a reaction. Ends are made distinct as numbers."""
    sold = _sold(spark, sf_dir, worlds)
    rows = _named(sold, worlds)
    none = F.lit(None).cast("string")
    ends = lambda key: sold.select(F.when(F.col(key).isNotNull(), F.col("world")).alias("world"), key).distinct()
    parts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    suppliers = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    chemicals = ends("l_partkey").join(parts, "l_partkey", "left").select(
        _own("chemical", "l_partkey", worlds).alias("id"), F.coalesce("p_name", F.lit("?")).alias("name"), F.lit("chemical").alias("type"), F.concat(F.lit("C"), F.col("l_partkey").cast("string")).alias("chem_ID"), none.alias("gene_ID"), none.alias("action"))
    proteins = ends("l_suppkey").join(suppliers, "l_suppkey", "left").select(
        _own("protein", "l_suppkey", worlds).alias("id"), F.concat(F.coalesce("s_name", F.lit("?")), F.lit(" protein")).alias("name"), F.lit("protein").alias("type"), none.alias("chem_ID"), F.concat(F.lit("G"), F.col("l_suppkey").cast("string")).alias("gene_ID"), none.alias("action"))
    of_reactions = rows.select(F.col("reaction_id").alias("id"), F.col("reaction_id").alias("name"), F.lit("reaction").alias("type"), none.alias("chem_ID"), none.alias("gene_ID"), "action")
    return PropertyGraph(chemicals.unionByName(proteins).unionByName(of_reactions), edges_of_reactions(rows))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines sold as observation rows; the line number decides the shape of the statement."""
    text = lambda c: F.col(c).cast("string")
    chemical, symbol = F.concat(F.lit("part "), text("l_partkey")), F.concat(F.lit("S"), text("l_suppkey"))
    other = F.concat(F.lit("part "), F.pmod(F.col("l_partkey") * 7, F.lit(90)).cast("string"))
    second = F.concat(F.lit("S"), (F.pmod(F.col("l_suppkey"), F.lit(9)) + 1).cast("string"))
    act, gene, gene2 = action_column(), F.concat(symbol, F.lit(" protein")), F.concat(second, F.lit(" protein"))
    kind = F.col("l_linenumber")
    shape = (
        F.when(kind == 1, F.concat_ws(" ", chemical, act, gene))
        .when(kind == 2, F.concat(other, F.lit(" inhibits the reaction ["), chemical, F.lit(" "), act, F.lit(" "), gene, F.lit("]")))
        .when(kind == 3, F.concat(F.lit("["), chemical, F.lit(" co-treated with "), gene, F.lit("] "), act, F.lit(" "), gene2))
        .when(kind == 4, F.concat(other, F.lit(" inhibits the reaction [["), chemical, F.lit(" co-treated with "), gene, F.lit("] results in increased expression of "), gene2, F.lit("]")))
        .when(kind == 5, F.concat(chemical, F.lit(" "), act, F.lit(" "), symbol, F.lit(" protein modified form")))
        .when(kind == 6, F.concat(chemical, F.lit(" resembles "), gene))
        .otherwise(F.concat_ws(" ", chemical, act, F.lit("some other thing")))
    )
    code = F.when(F.col("l_returnflag") == "A", "increases^expression|affects^binding").when(F.col("l_returnflag") == "N", "decreases^activity").otherwise("affects^cotreatment|affects^binding|increases^chemical synthesis")
    organism = F.when(F.col("l_returnflag") == "A", "Homo sapiens").when(F.col("l_returnflag") == "N", "Mus musculus").otherwise("Rattus norvegicus")
    return read(spark, sf_dir, "lineitem").select(
        chemical.alias("ChemicalName"), F.concat(F.lit("C"), text("l_partkey")).alias("ChemicalID"), F.lit(None).cast("string").alias("CasRN"), symbol.alias("GeneSymbol"),
        F.concat(F.lit("G"), text("l_suppkey")).alias("GeneID"), F.when(F.col("l_linestatus") == "F", "protein").otherwise("mRNA").alias("GeneForms"), organism.alias("Organism"),
        F.when(F.col("l_returnflag") == "A", "9606").otherwise("10090").alias("OrganismID"), shape.alias("Interaction"), code.alias("InteractionActions"), text("l_orderkey").alias("PubMedIDs"))


def chemicals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary of chemicals lacks every tenth part."""
    return read(spark, sf_dir, "part").where("p_partkey % 10 <> 0").select(F.concat(F.lit("C"), F.col("p_partkey").cast("string")).alias("chem_ID"), F.concat(F.lit("part "), F.col("p_partkey").cast("string")).alias("chem_name"))


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary of genes lacks every eleventh supplier."""
    return read(spark, sf_dir, "supplier").where("s_suppkey % 11 <> 0").select(F.concat(F.lit("G"), F.col("s_suppkey").cast("string")).alias("gene_ID"), F.col("s_name").alias("gene_name"), F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("gene_symbol"))


def diseases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a table of chemicals and diseases: the order's number picks the chemical, the customer's segment is the disease."""
    orders, customers = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    joined = orders.join(customers, orders.o_custkey == customers.c_custkey)
    number = F.pmod(F.col("o_orderkey"), F.lit(97)).cast("string")
    return joined.select(F.concat(F.lit("part "), number).alias("ChemicalName"), F.concat(F.lit("C"), number).alias("ChemicalID"), F.col("c_mktsegment").alias("DiseaseName"))
