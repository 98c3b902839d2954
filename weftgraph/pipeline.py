"""The four steps from observation files to scored links, each a function of its inputs, and all of them in a row."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.config import Settings
from weftgraph.functions import lexicon
from weftgraph.operators import algorithms, canonical, explore, graph, linkpred, prepare, resolve, triples, validate
from weftgraph.operators.graph import PropertyGraph
from weftgraph.session import stash
from weftgraph.sources import store, tables

log = logging.getLogger("weftgraph")


@dataclass(frozen=True)
class Prepared:
    graph: PropertyGraph
    triples: DataFrame
    report: DataFrame


@dataclass(frozen=True)
class Analysed:
    degrees: DataFrame | None = None
    components: DataFrame | None = None
    communities: DataFrame | None = None
    paths: DataFrame | None = None
    report: DataFrame | None = None
    target_id: str | None = None


@dataclass(frozen=True)
class Linked:
    predictions: DataFrame
    report: DataFrame
    roc: DataFrame
    precision_recall: DataFrame
    model_summary: str = field(repr=False, default="")


def prepare_graph(observations: DataFrame, chemicals: DataFrame, genes: DataFrame, settings: Settings | None = None, compat: bool | None = None) -> Prepared:
    """Filters, extraction, resolution, integrity, canonical ids, nodes and edges, and a one-row report of counts.

    What several later steps read is written once to the shared folder: parsed triples, mapped triples, canonical
    triples. Counts of the source come from one pass. The settings' lexicon replaces the built-in phrases; ``compat``,
    if it is given, replaces the settings'.
    """
    chosen = (settings or Settings()).preparation
    compat = chosen.compat if compat is None else compat
    phrases = lexicon.checked(chosen.lexicon) if chosen.lexicon else lexicon.ACTIONS
    own = prepare.canonical_only(prepare.of_gene_form(prepare.of_organism(observations, chosen.organism), chosen.gene_form), chosen.gene_form)
    parsed = stash(triples.extract_triples(prepare.statements(own), compat, phrases))
    mapped = stash(resolve.resolve_entities(parsed, chemicals, genes))
    whole = stash(resolve.whole_statements(mapped))
    done = stash(canonical.canonical_triples(whole, compat))
    built = graph.build_graph(done)
    built = PropertyGraph(stash(built.vertices), stash(built.edges))
    return Prepared(built, done, preparation_report(observations, parsed, mapped, whole, built, settings))


def preparation_report(observations: DataFrame, parsed: DataFrame, mapped: DataFrame, whole: DataFrame, built: PropertyGraph, settings: Settings | None = None) -> DataFrame:
    """One row: organism, source counts, triples at each step, depth, and the graph's size by type."""
    chosen = (settings or Settings()).preparation
    one = lambda rows: rows.withColumn("_one", F.lit(1))
    number = lambda rows, name: one(rows.agg(F.count(F.lit(1)).alias(name)))
    row = one(prepare.report_counts(observations, chosen.organism, chosen.gene_form))
    for part in (number(parsed, "triples"), number(mapped, "mapped_triples"), number(whole, "valid_triples"), one(triples.max_depth(whole)), one(explore.kpi_by_type(built.vertices).withColumnRenamed("total", "nodes")), number(built.edges, "edges")):
        row = row.join(part, "_one")  # one row each
    return row.select(F.lit(chosen.organism).alias("organism"), *[c for c in row.columns if c != "_one"])


def import_graph(built: PropertyGraph, folder: str, organism: str, nodes_file: str = "nodes", edges_file: str = "edges", overwrite: bool = True) -> bool:
    """Saves the graph and logs it; False, and nothing written, if one is there and may stay."""
    if not tables.save_graph(built, folder, overwrite, tables.bare_name(nodes_file), tables.bare_name(edges_file), organism):
        log.info("a graph is there already: %s", folder)
        return False
    return True


def analyse_graph(spark: SparkSession, folder: str, settings: Settings | None = None) -> Analysed:
    """Degrees, components, communities, paths and a report of the saved graph, as far as they are switched on."""
    settings = settings or Settings()
    chosen = settings.analysis
    algorithms.check_organism(tables.read_log(spark, folder), settings.preparation.organism)
    built = tables.load_graph(spark, folder)
    labels = stash(algorithms.label_propagation(built, chosen.label_rounds, chosen.exclude_ontological)) if chosen.community_detection else None
    degrees = algorithms.degree_centrality(built) if chosen.degree_centrality else None
    parts = stash(algorithms.components(built)) if chosen.connected_components else None
    communities = algorithms.communities(labels, parts) if labels is not None and parts is not None else None
    target = explore.find_by_name(built, chosen.target_name) if chosen.shortest_path else None
    paths = algorithms.shortest_paths(built, target, chosen.path_rounds) if target is not None else None
    report = algorithms.graph_report(built, settings.preparation.organism, parts) if parts is not None else None
    return Analysed(degrees, parts, communities, paths, report, target)


def predict_links(spark: SparkSession, folder: str, settings: Settings | None = None) -> Linked:
    settings = settings or Settings()
    algorithms.check_organism(tables.read_log(spark, folder), settings.preparation.organism)
    built = tables.load_graph(spark, folder)
    model, test = linkpred.train_links(built, settings.link_prediction)
    edges = built.only("functional").edges if settings.link_prediction.exclude_ontological else built.edges
    table = linkpred.result_table(test, edges)
    report = linkpred.link_report(settings.preparation.organism, built, test)
    return Linked(table, report, linkpred.roc_curve(test), linkpred.precision_recall_curve(test), model.summary())


def run(observations: DataFrame, chemicals: DataFrame, genes: DataFrame, folder: str, settings: Settings | None = None, steps: tuple[str, ...] = ("prepare", "import", "analyse", "link")) -> dict[str, object]:
    """The chosen steps in order; each reads what the ones before saved under ``folder``. A failing step raises."""
    settings = settings or Settings()
    spark = observations.sparkSession
    out: dict[str, object] = {}
    if "prepare" in steps:
        out["prepare"] = prepare_graph(observations, chemicals, genes, settings)
        if settings.preparation.save_triples:
            tables.write_csv(out["prepare"].triples, f"{folder}/triples", ";", single=False)
    if "import" in steps:
        prepared = out["prepare"]
        import_graph(prepared.graph, folder, settings.preparation.organism)
        out["checks"] = validate.verdicts(tables.load_graph(spark, folder))
    if "analyse" in steps:
        out["analyse"] = analyse_graph(spark, folder, settings)
    if "link" in steps:
        out["link"] = predict_links(spark, folder, settings)
    return out


def save_results(found: dict[str, object], folder: str, organism: str) -> None:
    """Every result as CSV whose name ends with the organism; path results with ; between values.

    Tables are folders of many files; those with an order have it file by file (``store.write_ordered``). Reports, and
    the hundred best predictions, are one file each."""
    at = lambda name: f"{folder}/{tables.suffixed(name, organism)}"

    def ordered(rows: DataFrame | None, name: str, *order, separator: str = ",") -> None:
        if rows is not None:
            store.write_ordered(rows, at(name), *order, separator=separator)

    def report(rows: DataFrame | None, name: str) -> None:
        if rows is not None:
            tables.write_csv(rows, at(name), single=True)

    if isinstance(done := found.get("prepare"), Prepared):
        tables.write_csv(done.graph.vertices, at("nodes.csv"))
        tables.write_csv(done.graph.edges, at("edges.csv"))
        report(done.report, "data_prep_report.csv")
    if isinstance(seen := found.get("analyse"), Analysed):
        for name, rows, first in (("degree_centrality", seen.degrees, "degree"), ("connected_components", seen.components, "component_count"), ("communities", seen.communities, "community_count")):
            ordered(rows, f"{name}.csv", F.desc(first), F.asc("id"))
        report(seen.report, "graph_analysis_report.csv")
        ordered(seen.paths, f"shortest_path__{seen.target_id}_.csv", F.desc("hops"), F.asc("id"), separator=";")  # the organism's part makes it two underscores
    if isinstance(linked := found.get("link"), Linked):
        ordered(linked.predictions, "predictions.csv", F.desc("Score"), F.asc("Source"), F.asc("Target"), F.asc("relationship"))
        report(linkpred.top_predictions(linked.predictions), "top_predictions.csv")
        report(linked.report, "link_prediction_report.csv")
        for name, rows, by in (("roc", linked.roc, "fpr"), ("precision_recall", linked.precision_recall, "recall")):
            ordered(rows, f"{name}.csv", F.desc("score"), F.asc(by))
        spark = linked.report.sparkSession
        spark.createDataFrame([(linked.model_summary,)], "value string").write.mode("overwrite").text(f"{folder}/model_summary")
