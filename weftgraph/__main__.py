"""``python -m weftgraph``: the pipeline's steps over files, with settings from YAML."""

from __future__ import annotations

import argparse
from dataclasses import replace

from weftgraph import pipeline
from weftgraph.config import Settings, load_lexicon, load_settings
from weftgraph.session import get_spark
from weftgraph.sources import tables

STEPS = ("prepare", "import", "analyse", "link")


def main(arguments: list[str] | None = None) -> None:
    """Runs the chosen steps and saves what they give; a step that fails raises, and nothing after it runs."""
    parser = argparse.ArgumentParser(prog="weftgraph", description=__doc__)
    parser.add_argument("observations")
    parser.add_argument("chemicals")
    parser.add_argument("genes")
    parser.add_argument("graph", help="folder of the saved graph")
    parser.add_argument("results", help="folder of the result tables")
    parser.add_argument("--settings", help="YAML file of settings")
    parser.add_argument("--lexicon", help="YAML file with the action phrases")
    parser.add_argument("--steps", nargs="+", choices=STEPS, default=list(STEPS))
    given = parser.parse_args(arguments)
    settings = load_settings(given.settings) if given.settings else Settings()
    if given.lexicon:
        settings = replace(settings, preparation=replace(settings.preparation, lexicon=load_lexicon(given.lexicon)))
    spark = get_spark()
    found = pipeline.run(
        tables.read_observations(spark, given.observations), tables.read_chemicals(spark, given.chemicals), tables.read_genes(spark, given.genes),
        given.graph, settings, tuple(given.steps))
    pipeline.save_results(found, given.results, settings.preparation.organism)


if __name__ == "__main__":
    main()
