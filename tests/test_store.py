"""Versions that become visible at once, ordered files, and loops that go on after a driver dies."""

import random

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import algorithms, graph, resolve
from weftgraph.session import Rounds, stash
from weftgraph.sources import star, store, tables

SF = "/root/testdata/sf0.001"


def small_graph(spark, n, kind="protein"):
    vertices = spark.createDataFrame([(f"v{k}", f"name {k}", kind, None, f"G{k}", None) for k in range(n)], "id string, name string, type string, chem_ID string, gene_ID string, action string")
    edges = spark.createDataFrame([(f"v{k}", f"v{(k + 1) % n}", "R", "r", "functional") for k in range(n)], "source_id string, target_id string, relationship string, reaction_id string, type string")
    return graph.PropertyGraph(vertices, edges)


def test_a_load_that_dies_leaves_the_graph_that_was_there(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/g"
    assert not tables.graph_exists(spark, folder)
    with pytest.raises(FileNotFoundError):
        tables.load_graph(spark, folder)
    assert tables.save_graph(small_graph(spark, 3), folder, organism="a")
    broken = small_graph(spark, 7)
    broken = graph.PropertyGraph(broken.vertices, broken.edges.withColumn("relationship", F.raise_error(F.lit("the driver dies here")).cast("string")))
    with pytest.raises(Exception, match="dies here"):
        tables.save_graph(broken, folder)  # vertices were written, edges were not
    assert len(store.names_in(spark, f"{folder}/versions")) == 2
    real = store.publish
    monkeypatch.setattr(store, "publish", lambda *a: (_ for _ in ()).throw(OSError("before the rename")))
    with pytest.raises(OSError):
        tables.save_graph(small_graph(spark, 5), folder)
    monkeypatch.setattr(store, "publish", real)
    loaded = tables.load_graph(spark, folder)
    assert (loaded.vertices.count(), loaded.edges.count(), tables.read_log(spark, folder).count()) == (3, 3, 1)
    assert not tables.save_graph(small_graph(spark, 4), folder, overwrite=False)
    assert tables.save_graph(small_graph(spark, 4), folder, organism="b")
    assert len(store.names_in(spark, f"{folder}/versions")) == 2  # the two that died are gone, the one before is kept
    assert loaded.vertices.count() == 3  # who reads it goes on reading
    assert tables.load_graph(spark, folder).vertices.count() == 4
    tables.append_log(spark, folder, "n", "e", "c", "FAILED")
    assert tables.load_graph(spark, folder).vertices.count() == 4
    tables.clear_graph(spark, folder)
    assert not tables.graph_exists(spark, folder) and store.names_in(spark, f"{folder}/versions") == []
    log = [(r.number, r.organism, r.status) for r in tables.read_log(spark, folder).orderBy("number").collect()]
    assert log == [(0, "a", "COMPLETED"), (1, "b", "COMPLETED"), (2, "c", "FAILED"), (3, "", "CLEARED")]
    assert tables.latest_imports(tables.read_log(spark, folder)).first()["status"] == "CLEARED"


def test_a_manifest_is_never_overwritten(spark, tmp_path):
    path = f"file://{tmp_path}/m/0.json"
    store.publish(spark, path, "é")
    with pytest.raises(FileExistsError):
        store.publish(spark, path, "x")
    assert store.read_small(spark, path) == "é" and store.names_in(spark, f"file://{tmp_path}/m") == ["0.json"]


@pytest.mark.parametrize("n", [0, 1, 500])
def test_files_are_in_order(spark, tmp_path, n):
    rng = random.Random(n)
    rows = [(rng.randrange(40), f"k{rng.randrange(1000):03d}") for _ in range(n)]
    path = f"file://{tmp_path}/o"
    for _ in range(2):  # a second write replaces the first
        store.write_ordered(spark.createDataFrame(rows, "score int, id string"), path, F.desc("score"), F.asc("id"), separator=";")
    files = store.ordered_files(spark, path)
    got = []
    for f in files:
        own = [line.split(";") for line in (tmp_path / "o" / f["file"]).read_text().splitlines()[1:]]
        assert len(own) == f["rows"] and int(own[0][0]) == f["first"] == len(got)
        got += [(int(p), int(s), i) for p, s, i in own]
    assert [g[0] for g in got] == list(range(n)) and [g[1:] for g in got] == sorted(rows, key=lambda r: (-r[0], r[1]))
    assert [f["file"] for f in files] == sorted(f["file"] for f in files) and (n < 500 or len(files) > 1)


def test_rounds_go_on_where_they_stopped(spark, monkeypatch):
    g = star.graph(spark, SF)
    g = graph.PropertyGraph(stash(g.vertices), stash(g.edges))
    whole = {tuple(r) for r in algorithms.label_propagation(g, 5).collect()}
    keep = Rounds.keep

    def dies(self, number, **frames):
        if number == 2:
            frames["labels"].write.mode("overwrite").parquet(f"{self.path}/round-{number}/labels")  # written, never marked
            raise KeyboardInterrupt
        return keep(self, number, **frames)

    record = Rounds(spark, f"labels-{random.randrange(10**12)}")
    name = record.path.rpartition("rounds-")[2]
    monkeypatch.setattr(Rounds, "keep", dies)
    with pytest.raises(KeyboardInterrupt):
        algorithms.label_propagation(g, 5, name=name)
    assert record.recorded() == [0, 1]
    seen = []
    monkeypatch.setattr(Rounds, "keep", lambda self, number, **frames: seen.append(number) or keep(self, number, **frames))
    assert {tuple(r) for r in algorithms.label_propagation(g, 5, name=name).collect()} == whole
    assert seen == [2, 3, 4] and record.recorded() == [3, 4]
    assert sorted(store.names_in(spark, record.path)) == ["done-3", "done-4", "round-3", "round-4"]
    record.finish()
    assert record.recorded() == []


def test_paths_go_on_where_they_stopped(spark, monkeypatch):
    g = small_graph(spark, 9)
    whole = sorted(tuple(r) for r in algorithms.shortest_paths(g, "v0", 20).collect())
    assert max(r[2] for r in whole) == 8
    name = f"paths-{random.randrange(10**12)}"
    algorithms.shortest_paths(g, "v0", 3, name=name)
    rest = algorithms.shortest_paths(g, "v0", 20, name=name)
    assert sorted(tuple(r) for r in rest.collect()) == whole
    Rounds(spark, name).finish()


def test_one_join_maps_both_vocabularies(spark):
    rows = spark.createDataFrame(
        [(k, o, t, "c", "g") for k, (o, t) in enumerate([("binds to", "action")] * 50 + [("A", "chemical"), ("A", "other"), ("B", "chemical"), ("X protein", "protein"), ("Y protein", "protein"), ("X", "other"), (None, "other"), ("T", "chemical")])],
        "index long, object string, triple_object_type string, ChemicalName string, GeneSymbol string")
    chemicals = spark.createDataFrame([("C1", "A"), ("C2", "T"), ("C3", "T")], "chem_ID string, chem_name string")
    genes = spark.createDataFrame([("G1", "x", "X"), ("G2", "x2", "X")], "gene_ID string, gene_name string, gene_symbol string")
    want = resolve.map_genes(resolve.map_chemicals(rows, chemicals), genes)
    got = resolve.map_entities(rows, chemicals, genes)
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert sorted(map(repr, got.select(*columns).collect())) == sorted(map(repr, want.select(*columns).collect()))
    rows = rows.withColumn("id", F.concat_ws("_", "triple_object_type", "index"))
    recovered = resolve.recover(rows, chemicals)
    assert {r["triple_object_type"] for r in recovered.where("object = 'A'").collect()} == {"chemical"}
    want = resolve.map_genes(resolve.map_chemicals(recovered, chemicals), genes)
    got = resolve.resolve_entities(rows, chemicals, genes)
    assert sorted(map(repr, got.select(*sorted(want.columns)).collect())) == sorted(map(repr, want.select(*sorted(want.columns)).collect()))
