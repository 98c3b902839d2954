import random

import pytest

from weftgraph import pipeline
from weftgraph.config import Analysis, LinkPrediction, Preparation, Settings, load_settings, lookup
from weftgraph.operators import linkpred, statistics
from weftgraph.sources import star, tables
from weftgraph.streaming import degrees

SF = "/root/testdata/sf0.001"


def test_metrics_with_ties(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(12) / 12, float(rng.random() < 0.4)) for _ in range(300)]
    scored = spark.createDataFrame(rows, "score double, label double")
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert linkpred.roc_auc(scored).first()[0] == pytest.approx(auc)
    ap = 0.0
    for s in sorted({s for s, _ in rows}, reverse=True):
        at = [y for t, y in rows if t >= s]
        ap += sum(y for t, y in rows if t == s) / len(pos) * sum(at) / len(at)
    assert linkpred.average_precision(scored).first()[0] == pytest.approx(ap)
    assert linkpred.roc_auc(scored.where("label = 1")).first()[0] is None
    last = linkpred.roc_curve(scored).orderBy("score").first()
    assert (last["fpr"], last["tpr"]) == (1.0, 1.0)


def test_negatives_are_free_pairs(spark):
    g = star.graph(spark, SF)
    edges = linkpred.labelled_edges(g)
    pairs = {(r["source"], r["target"]) for r in edges.select("source", "target").collect()}
    drawn = [(r["source"], r["target"]) for r in linkpred.negative_pairs(edges, linkpred.node_index(g)).collect()]
    assert not pairs & set(drawn) and all(a != b for a, b in drawn) and len(drawn) == len(set(drawn))
    assert len(drawn) > 0.95 * len(pairs)


def test_whole_pipeline(spark, tmp_path):
    rows = star.observations(spark, SF)
    settings = Settings(Preparation("Homo sapiens", "protein"), Analysis(target_name="s1 PROTEIN"), LinkPrediction(most_rounds=10))
    found = pipeline.run(rows, star.chemicals(spark, SF), star.genes(spark, SF), f"file://{tmp_path}/graph", settings)
    assert {r["check"] for r in found["checks"].collect() if r["broken"]} == set()
    report = found["prepare"].report.first().asDict()
    assert report["total"] == rows.count() and report["edges"] == found["prepare"].graph.edges.count() and report["max_depth"] == 2
    assert found["analyse"].paths.where("reachable").count() > 1
    link = found["link"].report.first()
    assert 0.5 < link["roc_auc"] <= 1 and 0.5 < link["avg_precision"] <= 1
    pipeline.save_results(found, f"file://{tmp_path}/out", "Homo sapiens")
    again = tables.read_graph_csv(spark, f"file://{tmp_path}/out/nodes_homo_sapiens.csv", f"file://{tmp_path}/out/edges_homo_sapiens.csv")
    assert again.vertices.count() == found["prepare"].graph.vertices.count()
    assert not pipeline.import_graph(found["prepare"].graph, f"file://{tmp_path}/graph", "Homo sapiens", overwrite=False)
    assert tables.latest_imports(tables.read_log(spark, f"file://{tmp_path}/graph")).first()["status"] == "COMPLETED"
    with pytest.raises(ValueError):
        pipeline.analyse_graph(spark, f"file://{tmp_path}/graph", Settings(Preparation("Mus musculus")))
    chemicals = tables.load_graph(spark, f"file://{tmp_path}/graph", ["chemical", "protein"])
    assert {r["type"] for r in chemicals.edges.select("type").distinct().collect()} == {"functional"}


def test_command_line(spark, tmp_path):
    from weftgraph.__main__ import main

    star.observations(spark, SF).select(*tables.OBSERVATION_COLUMNS).write.csv(f"file://{tmp_path}/obs.csv")
    star.chemicals(spark, SF).toDF("ChemicalID", "ChemicalName").write.csv(f"file://{tmp_path}/chem.csv", header=True)
    star.genes(spark, SF).toDF("GeneID", "GeneName", "GeneSymbol").write.csv(f"file://{tmp_path}/genes.csv", header=True)
    (tmp_path / "s.yml").write_text("preparation:\n  save_triples: true\n")
    (tmp_path / "lexicon.yml").write_text("actions: [binds to, results in increased expression of]\n")
    paths = [f"file://{tmp_path}/{n}" for n in ("obs.csv", "chem.csv", "genes.csv", "graph", "out")]
    main([*paths, "--settings", f"{tmp_path}/s.yml", "--lexicon", f"{tmp_path}/lexicon.yml", "--steps", "prepare", "import"])
    kinds = {r["relationship"] for r in tables.load_graph(spark, paths[3], None).edges.where("type = 'functional'").collect()}
    assert kinds and kinds <= {"BINDS_TO", "RESULTS_IN_INCREASED_EXPRESSION_OF"}
    assert tables.read_graph_csv(spark, f"{paths[4]}/nodes_homo_sapiens.csv", f"{paths[4]}/edges_homo_sapiens.csv").edges.count() > 0
    with pytest.raises(SystemExit):
        main(["obs.csv"])


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "obs.csv").write_text("Aspirin,C1,,PTGS2,G1,protein,Homo sapiens,9606,Aspirin binds to PTGS2 protein,affects^binding,1|2\n")
    row = tables.read_observations(spark, f"file://{tmp_path}/obs.csv").first()
    assert row["CasRN"] is None and row["Interaction"].startswith("Aspirin binds")
    (tmp_path / "genes.csv").write_text("GeneSymbol,GeneName,GeneID,x\nPTGS2,n,G1,y\n")
    assert tuple(tables.read_genes(spark, f"file://{tmp_path}/genes.csv").first()) == ("G1", "n", "PTGS2")
    (tmp_path / "chem.csv").write_text("ChemicalName,ChemicalID\nAspirin,C1\n")
    assert tuple(tables.read_chemicals(spark, f"file://{tmp_path}/chem.csv").first()) == ("C1", "Aspirin")
    assert tables.suffixed("out/nodes.csv", "Homo sapiens") == "out/nodes_homo_sapiens.csv"
    assert tables.bare_name("nodes.csv") == "nodes.csv"
    for bad in ("a/b", "..", "", "a\\b"):
        with pytest.raises(ValueError):
            tables.bare_name(bad)
    paths = spark.createDataFrame([("a", 1.0, 1), ("b", 2.0, 0)], "id string, dist double, hops int")
    tables.write_paths(paths, f"file://{tmp_path}/paths", "p1", "Homo sapiens")
    assert tables.read_paths(spark, f"file://{tmp_path}/paths", " homo SAPIENS ").count() == 2
    folder = tmp_path / "files"
    folder.mkdir()
    (folder / "shortest_path__p_1__homo_sapiens.csv").write_text("id;hops\na;1\n")
    (folder / "shortest_path__p_2__mus_musculus.csv").write_text("id;hops\na;1\n")
    assert [r["target_id"] for r in tables.read_path_files(spark, f"file://{folder}", "Homo Sapiens").collect()] == ["p_1"]
    tables.write_csv(paths.select("id", "hops"), f"file://{folder}/{tables.suffixed('shortest_path__p_3_.csv', 'Homo sapiens')}", ";")  # a folder
    assert sorted(r["target_id"] for r in tables.read_path_files(spark, f"file://{folder}", "Homo Sapiens").collect()) == ["p_1", "p_3", "p_3"]
    tables.write_quoteless(spark.createDataFrame([("a;b", "c\\d")], "x string, y string"), f"file://{tmp_path}/plain")
    assert spark.read.text(f"file://{tmp_path}/plain").first()[0] == r"a\;b;c\\d"


def test_settings(tmp_path):
    (tmp_path / "s.yml").write_text("analysis:\n  label_rounds: 3\n")
    assert lookup(load_settings(tmp_path / "s.yml"), "analysis.label_rounds") == 3
    (tmp_path / "s.yml").write_text("analysis:\n  rounds: 3\n")
    with pytest.raises(KeyError):
        load_settings(tmp_path / "s.yml")
    with pytest.raises(FileNotFoundError):
        load_settings(tmp_path / "none.yml")
    with pytest.raises(AttributeError):
        lookup(Settings(), "analysis.none")


def test_statistics(spark):
    rows = spark.createDataFrame([("affects^binding|x|increases^chemical synthesis^y", "A binds B; synthesis promotes", "A", "B"), (None, None, "A", "B")], "InteractionActions string, Interaction string, ChemicalName string, GeneSymbol string")
    assert {(r["predicate"], r["object"]) for r in statistics.action_pairs(rows).collect()} == {("affects", "binding"), ("increases", "chemical synthesis^y")}
    assert {r["both_present"]: r["n"] for r in statistics.entity_in_text(rows).collect()} == {True: 1, False: 1}
    assert {r["actions_present"]: r["n"] for r in statistics.action_synonym_check(rows).collect()} == {False: 1, True: 1}  # the text nan holds nan


def test_streamed_degrees(spark, tmp_path):
    source = tmp_path / "in"
    edges = star.graph(spark, SF).edges
    edges.coalesce(1).write.parquet(f"file://{source}/a")
    stream = spark.readStream.schema(edges.schema).parquet(f"file://{source}/*")
    degrees.keep_degrees(stream, f"file://{tmp_path}/deg", f"file://{tmp_path}/cp").awaitTermination(120)
    edges.coalesce(1).write.parquet(f"file://{source}/b")
    degrees.keep_degrees(stream, f"file://{tmp_path}/deg", f"file://{tmp_path}/cp").awaitTermination(120)
    got = degrees.read_degrees(spark, f"file://{tmp_path}/deg").selectExpr("sum(inDegree) i", "sum(outDegree) o").first()
    assert (got["i"], got["o"]) == (2 * edges.count(), 2 * edges.count())


def test_windowed_counts(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").selectExpr("cast(ts as timestamp) ts", "event_type")
    counts = degrees.windowed_counts(events, "ts", "event_type")
    assert counts.selectExpr("sum(n)").first()[0] == events.count()


def test_entry_without_the_llm_folder(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    repo = Path(__file__).resolve().parents[1]
    shutil.copytree(repo / "weftgraph", tmp_path / "weftgraph", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(repo / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, any(n.startswith('op') for n in q), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path), "HOME": str(tmp_path)})
    assert out.returncode == 0, out.stderr
    assert out.stdout.split()[1:3] == ["False", "False"] and int(out.stdout.split()[0]) > 60
