"""What is stashed and shuffled on the way goes when nothing reads it any more."""

import os
from collections import Counter
from urllib.parse import urlparse

from pyspark.sql import functions as F

from weftgraph import session
from weftgraph.functions.columns import packed, reaction_key, unpacked
from weftgraph.operators import algorithms, canonical, graph, linkpred, prepare, triples
from weftgraph.operators import components as cc
from weftgraph.operators.algorithms import components
from weftgraph.operators.bitmaps import distinct_rows
from weftgraph.operators.components import connected_components
from weftgraph.operators.graph import PropertyGraph, edges_of_reactions
from weftgraph.operators.prefix import numbered
from weftgraph.session import release, shared_dir, staged, stash
from weftgraph.sources import tables


def _folders(spark):
    folder = urlparse(shared_dir(spark)).path
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def _shuffle_files(spark):
    top = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(top.apply(i).getName().startswith("shuffle_") for i in range(top.size()))


def test_a_stash_leaves_no_shuffle_files(spark):
    before = _shuffle_files(spark)
    kept = stash(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    assert _shuffle_files(spark) <= before and kept.count() == 7


def test_staged_drops_what_was_stashed_meanwhile(spark):
    before = _folders(spark)
    out = staged(lambda: staged(lambda: stash(spark.range(10)).where("id > 2")).join(stash(spark.range(5)), "id"))
    assert sorted(r[0] for r in out.collect()) == [3, 4]
    assert len(_folders(spark) - before) == 1
    release(out, out.where("id > 3"))  # what is not stashed itself is left alone
    assert _folders(spark) == before


def test_components_of_texts_keep_few_tables(spark):
    rows = [(f"v{i:03d}", f"v{i + 1:03d}") for i in range(40) if i % 10 != 9] + [("z", "z"), (None, "a"), ("b", None)]
    before = _folders(spark)
    found = connected_components(spark.createDataFrame(rows, "src string, dst string"))
    assert {tuple(r) for r in found.collect()} == {(f"v{i:03d}", f"v{i // 10 * 10:03d}") for i in range(40)} | {("z", "z")}
    assert len(_folders(spark) - before) <= 2  # the named vertices and the components' smallest


def test_distinct_rows_is_distinct(spark):
    rows = stash(spark.createDataFrame([("a", None), ("a", None), (None, "a"), ("b", "c"), ("b", "c"), ("d", "e")], "x string, y string"))
    assert sorted(map(str, distinct_rows(rows).collect())) == sorted(map(str, rows.distinct().collect()))


def _stashed_bytes(spark):
    folder = urlparse(shared_dir(spark)).path
    return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(folder) for f in files)


def test_components_of_a_graph_stash_no_ids_of_reactions(spark):
    rows = spark.range(20_000).select(F.concat(F.lit("c"), F.col("id") % 3000).alias("agent"), F.lit("binds to").alias("action"), F.concat(F.lit("p"), F.col("id") % 7000).alias("target"))
    rows = stash(rows.select(reaction_key(F.col("agent"), F.col("action"), F.col("target")).alias("reaction_id"), "*"))
    ids = rows.select(F.explode(F.array("agent", "target", "reaction_id")).alias("id")).distinct()
    vertices = ids.select("id", F.col("id").alias("name"), F.lit("x").alias("type")).unionByName(spark.createDataFrame([("lone", None, "x"), (None, "n", "x")], "id string, name string, type string"))
    before = _stashed_bytes(spark)
    found = components(PropertyGraph(stash(vertices), edges_of_reactions(rows)))
    vertex_bytes = _stashed_bytes(spark) - before
    got = {r["id"]: (r["name"], r["component_id"], r["component_count"]) for r in found.collect()}
    n = ids.count()
    own = {f"c{k}": f"c{k % 1000}" for k in range(3000)}  # gcd(3000, 7000) components
    assert all(got[c] == (c, min(f"c{k}" for k in range(int(of[1:]), 3000, 1000)), n // 1000) for c, of in own.items())
    assert got["lone"] == (None, "lone", 1) and len(got) == n + 1 and all(v[0] == k for k, v in got.items() if k != "lone")
    assert vertex_bytes < 150 * n  # the vertices' own 90 among them; ids of reactions in the result were another 50


def test_components_over_stretches_and_packed_texts(spark, monkeypatch):
    monkeypatch.setattr(cc, "STRETCH", 50)
    rows = [(f"v{i:04d}", f"v{i + 7:04d}") for i in range(3000)] + [("é", "z"), ("z", "\U0001f600"), ("é", "é")]
    monkeypatch.setattr(cc, "_contracted", lambda batches: (cc._stars([b.slice(k, 50)]) for b in batches for k in range(0, b.num_rows, 50)))
    found = connected_components(spark.createDataFrame(rows, "src string, dst string"))
    own = {f"v{i:04d}": f"v{i % 7:04d}" for i in range(3007)} | {"é": "z", "z": "z", "\U0001f600": "z"}
    assert {r["vertex"]: r["component"] for r in found.collect()} == own
    texts = ["", "a", "f" * 64, "F" * 64, "n_" + "0a" * 32, "0a" * 32 + "\n", "x\n" + "9" * 65, "é" + "1" * 63, None]
    back = spark.createDataFrame([(t,) for t in texts], "t string").select("t", unpacked(packed(F.col("t"))).alias("u"))
    assert all(r["t"] == r["u"] for r in back.collect())


def test_ends_of_edges_move_as_short_keys(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(linkpred, "stash", lambda df: seen.append(df.schema) or stash(df))
    nodes = spark.createDataFrame([("a", 0), ("n_" + "0f" * 32, 1), ("c", 2)], "id string, node_index long")
    edges = spark.createDataFrame([("a", "n_" + "0f" * 32, "x"), ("c", "a", "y"), (None, "a", "z"), ("a", "gone", "z")], "source string, target string, kind string")
    found = linkpred.numbered_ends(edges, nodes)
    assert {(r["kind"], r["source_index"], r["target_index"]) for r in found.collect()} == {("x", 0, 1), ("y", 2, 0)}
    assert seen[0]["target"].dataType.typeName() == "binary"
    pairs = edges.where("kind in ('x', 'y')").select("source", "target")
    free = {(r["source"], r["target"]) for r in linkpred.negative_pairs(pairs, nodes).collect()}
    assert free == {("a", "c"), ("c", "n_" + "0f" * 32)}


def test_communities_and_sizes_move_no_ids(spark, monkeypatch):
    ids = [(i, f"name of {i}", "x") for i in ("a", "b", "c", "d", "e", "lone", "n_" + "0f" * 32)] + [("a", "again", "x"), (None, "none", "x"), ("lone", "more", "x")]
    links = [("a", "b", "functional"), ("c", "b", "functional"), ("d", "gone", "functional"), ("n_" + "0f" * 32, "c", "ontological"), ("e", "e", "ontological")]
    edges = spark.createDataFrame([(s, t, "R", "r", k) for s, t, k in links], "source_id string, target_id string, relationship string, reaction_id string, type string")
    g = PropertyGraph(spark.createDataFrame(ids, "id string, name string, type string"), edges)
    labels = algorithms.label_propagation(g, 5)
    assert sorted(r["id"] or "" for r in labels.collect()) == sorted(i or "" for i, *_ in ids)
    parts = algorithms.components(g)
    whole = algorithms.communities(labels, parts).drop("community_count").collect()
    sizes = Counter(r["community"] for r in whole)  # with a vertex's rows times its labels
    kept = []
    monkeypatch.setattr(algorithms, "stash", lambda df: kept.append(df.columns) or stash(df))
    found = algorithms.communities_of_graph(g, 5).collect()
    assert not any("id" in c and "label" not in c and "_rows" not in c and c != ["id"] for c in kept)
    assert Counter(map(tuple, found)) == Counter((*r, sizes[r["community"]]) for r in whole)
    assert {tuple(r) for r in algorithms.sizes_of_components(g).collect()} == Counter(r["component_id"] for r in parts.collect()).items()
    per = {c: (len({r["community"] for r in whole if r["component_id"] == c}), n) for c, n in Counter(r["component_id"] for r in whole).items()}
    assert {r["component_id"]: (r["communities"], r["vertices"]) for r in algorithms.communities_per_component(g, 5).collect()} == per
    first = min(per)
    assert dict(map(tuple, algorithms.first_component_communities(g, 5).collect())) == Counter(r["community"] for r in whole if r["component_id"] == first)
    assert tuple(algorithms.largest_of_graph(g).first()) == tuple(algorithms.largest_component(parts).first())


def test_labels_of_rounds_are_numbers(spark, monkeypatch):
    kept = []
    keep = algorithms.Rounds.keep
    monkeypatch.setattr(algorithms.Rounds, "keep", lambda self, number, **tables: kept.append(tables["labels"].schema) or keep(self, number, **tables))
    edges = spark.createDataFrame([("a", "b", "functional"), ("c", "b", "functional")], "source_id string, target_id string, type string")
    labels = algorithms.label_propagation(PropertyGraph(spark.createDataFrame([("a",), ("b",), ("c",), ("z",)], "id string"), edges), 1)
    assert {tuple(r) for r in labels.collect()} == {("a", "b"), ("b", "a"), ("c", "b"), ("z", "z")}
    assert kept and all(f.dataType.typeName() == "long" for schema in kept for f in schema)


def test_rounds_see_each_key_once_and_leave_one_table(spark, monkeypatch):
    monkeypatch.setattr(session, "ROUND_ROWS", 100)
    before, seen = _folders(spark), []
    rows = stash(spark.range(450).select((F.col("id") % 50).cast("string").alias("k")).unionByName(spark.createDataFrame([(None,)], "k string")))

    def make(part):
        seen.append(_shuffle_files(spark))
        return stash(part).groupBy("k").count()

    found = session.in_rounds(make, "k", rows)
    assert {tuple(r) for r in found.collect()} == {(str(k), 9) for k in range(50)} | {(None, 1)}
    assert len(seen) == 5 and max(seen) == seen[0]
    release(rows)
    assert len(_folders(spark) - before) == 1
    release(found)
    assert _folders(spark) == before


def test_folded_texts_come_back(spark):
    index = "0f" * 16
    rows = [(index, f"main-action_{index}", f"chemical_{index}_1", "S1 protein", "S1"), ("1", "a1\x1f1\x1e", "\x1em1\x1ee", "\x1f", "x"), (None, None, "\x1f", None, None), ("", "s", "i", "", ""), ("e", "\x1ee\x1em", "me", "o", "\x1f")]
    table = spark.createDataFrame([(*r, r[3]) for r in rows], "index string, subject string, id string, object string, gene_symbol string, chem_name string")
    small = triples.slim_names(triples.slim(table))
    assert sorted(map(str, triples.full(small).collect())) == sorted(map(str, table.collect()))
    first = small.where("object = 'S1 protein'").first()
    assert len(first["index"]["key"]) == 16 and (first["subject"], first["id"], first["gene_symbol"], first["chem_name"]) == ("main-action_\x1f", "chemical_\x1f_1", "\x1f", "\x1f")


def test_triples_are_named_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(session, "ROUND_ROWS", 3)
    text = lambda a: [("m", "has_agent", a, "chemical"), ("m", "has_action", "binds to", "action"), ("m", "has_target", "S1 protein", "protein")]
    rows = [(i, f"main-action_{i}", p, o, k, n, f"{k}_{i}_{n}", f"text {o}") for i, a in (("s1", "x"), ("s2", "x"), ("s3", "y")) for n, (_, p, o, k) in enumerate(text(a))]
    rows.append(("s4", "main-action_s4", "has_agent", "x", "chemical", 0, "chemical_0", "bad"))  # no whole statement
    table = spark.createDataFrame(rows, "index string, subject string, predicate string, object string, triple_object_type string, pred_numb int, id string, Interaction string")
    table = stash(table.withColumns({c: F.lit(None).cast("string") for c in ("chem_ID", "chem_name", "gene_ID", "gene_name", "gene_symbol")}))
    named = canonical.named_triples(table, whole=True)
    nodes = sorted(map(str, graph.nodes_of_named(named).collect()))
    found = stash(canonical.of_named(named))
    assert found.count() == 7 and {r["id"] for r in found.where("object = 'S1 protein'").collect()} == {"protein_s1_2"}
    assert nodes == sorted(map(str, graph.define_nodes(found).collect())) and len(nodes) == 5


def test_repeated_main_actions_meet_no_texts(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(canonical, "stash", lambda df: kept.append(df.schema) or stash(df))
    rows = [("t", f"main-action_{k}", "has_agent", o) for k, o in enumerate(("a", "a", "b"))] + [(None, "main-action_5", "p", None), (None, "main-action_4", "p", None), ("t", "n_reaction", "p", "o"), ("u", "main-action_1", "p", "z")]
    table = stash(spark.createDataFrame(rows, "Interaction string, subject string, predicate string, object string"))
    got = sorted(r["subject"] for r in canonical.drop_repeated_main_actions(table).collect())
    assert got == ["main-action_0", "main-action_1", "main-action_1", "main-action_2", "main-action_4", "n_reaction"]  # one that stays with one text stays with all
    assert not any(f.name == "Interaction" for schema in kept for f in schema)


def test_statements_in_place_are_the_same(spark):
    rows = stash(spark.createDataFrame([("a", "b", "c "), ("a", "b", "c"), (None, "b", "d"), ("x", "y", "z")], "ChemicalName string, GeneSymbol string, Interaction string"))
    found = prepare.statements(rows, in_place=True)
    assert sorted(map(str, found.collect())) == sorted(map(str, prepare.statements(rows).collect())) and found.count() == 3


def test_edges_between_vertices_are_those_of_the_joins(spark, monkeypatch):
    vertices = spark.createDataFrame([("a", "x"), ("b", "x"), ("b", "y"), ("c", "x"), (None, "x")], "id string, type string")
    ends = [("a", "b"), ("b", "b"), ("a", "c"), ("a", "c"), ("gone", "a"), ("c", "gone"), (None, "a"), ("c", None)]
    edges = spark.createDataFrame([(s, t, "R", "r", "functional") for s, t in ends], "source_id string, target_id string, relationship string, reaction_id string, type string")
    for rows in (vertices, vertices.where("id is not null and type = 'x'")):
        g = PropertyGraph(rows, edges)
        kept = []
        monkeypatch.setattr(linkpred, "stash", lambda df: kept.append(df.columns) or stash(df))  # noqa: B023
        got = linkpred.edges_between(g).collect()
        monkeypatch.undo()
        assert kept == [["_end", "_v"]]  # no edge is stashed
        assert sorted(map(str, got)) == sorted(map(str, linkpred.labelled_edges(g).select("source", "target", "relationship", "type").collect()))


def test_ranks_of_relationships_need_no_edges_stashed(spark, monkeypatch):
    edges = spark.createDataFrame([("a", "b", "R", "functional"), ("a", "c", "S", "other"), ("a", "d", None, "ontological")], "source_id string, target_id string, relationship string, type string")
    ranks = linkpred.relation_ranks(edges)
    few = sorted(map(str, linkpred.edge_features(edges, ranks).collect()))
    monkeypatch.setattr(linkpred, "MOST_NAMES", 1)
    assert few == sorted(map(str, linkpred.edge_features(edges, ranks).collect())) and len(few) == 3


def test_numbered_moves_rows_once(spark):
    rows = stash(spark.range(500).select((F.col("id") * 7 % 500).alias("v")))
    found = numbered(rows, "place", F.desc("v"))
    assert {tuple(r) for r in found.collect()} == {(499 - k, k) for k in range(500)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Window" in line and "v#" in line for line in plan.splitlines())  # the window is over ranges


def test_result_table_keeps_parallel_edges_and_null_ends(spark):
    scored = spark.createDataFrame([("a", "b", 0.5, 1.0), ("a|b", "c", 0.25, 0.0), (None, "b", 0.1, 0.0)], "source string, target string, score double, label double")
    edges = spark.createDataFrame([("a", "b", "R"), ("a", "b", "S"), ("a", "b|c", "T"), (None, "b", "U"), ("a", "b", None)], "source_id string, target_id string, relationship string")
    got = {(r["Source"], r["Target"], r["relationship"]) for r in linkpred.result_table(scored, edges).collect()}
    assert got == {("a", "b", "R"), ("a", "b", "S"), ("a", "b", "-"), ("a|b", "c", "-"), (None, "b", "-")}


def _shuffle_bytes(spark):
    top = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(top.apply(i).length() for i in range(top.size()) if top.apply(i).getName().startswith("shuffle_"))


def test_undirected_pairs_move_once_and_packed(spark):
    rows = spark.range(5000).select(F.concat(F.lit("c"), F.col("id") % 300).alias("agent"), F.lit("binds to").alias("action"), F.concat(F.lit("p"), F.col("id") % 701).alias("target"))
    edges = stash(edges_of_reactions(rows.select(reaction_key(F.col("agent"), F.col("action"), F.col("target")).alias("reaction_id"), "*")))
    odd = [(None, "b"), ("b", None), (None, None), ("x", "x"), ("x", "y"), ("y", "x"), ("", "x"), ("F" * 64, "f" * 64)]
    more = spark.createDataFrame(odd, "source_id string, target_id string")
    pairs = [tuple(r) for r in edges.select("source_id", "target_id").collect()]
    before = _shuffle_bytes(spark)
    got = algorithms.undirected(edges).collect()
    moved = _shuffle_bytes(spark) - before
    assert sorted(map(tuple, got)) == sorted(set(pairs) | {(b, a) for a, b in pairs})
    assert moved < 100 * 3 * 5000  # three pairs of a reaction; both ways as texts were over 200 each
    got = [tuple(r) for r in algorithms.undirected(more).collect()]
    assert len(got) == len(set(got)) and set(got) == set(odd) | {(b, a) for a, b in odd}
    numbers = spark.createDataFrame([(1, 2), (2, 1), (3, 3), (None, 1)], "source_id long, target_id long")
    assert sorted(map(str, algorithms.undirected(numbers).collect())) == sorted(map(str, [*spark.createDataFrame([(1, 2), (2, 1), (3, 3), (None, 1), (1, None)], "src long, dst long").collect()]))


def test_a_graph_of_few_types_is_loaded_without_moving_its_edges(spark):
    folder = session.scratch(spark)
    rows = spark.range(5000).select(F.concat(F.lit("c"), F.col("id") % 300).alias("agent"), F.lit("binds to").alias("action"), F.concat(F.lit("p"), F.col("id") % 701).alias("target"))
    edges = stash(edges_of_reactions(rows.select(reaction_key(F.col("agent"), F.col("action"), F.col("target")).alias("reaction_id"), "*")))
    kind = F.when(F.col("id").startswith("c"), "chemical").when(F.col("id").startswith("p"), "protein").otherwise("reaction")
    ids = edges.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct().where("id <> 'p7'")
    none = F.lit(None).cast("string")
    vertices = stash(ids.select("id", F.col("id").alias("name"), kind.alias("type"), none.alias("chem_ID"), none.alias("gene_ID"), none.alias("action")))
    tables.save_graph(PropertyGraph(vertices, edges), folder)
    assert tables.load_graph(spark, folder).edges.count() == edges.where("source_id <> 'p7' and target_id <> 'p7'").count()
    before = _shuffle_bytes(spark)
    got = tables.load_graph(spark, folder, ["chemical", "protein"]).edges.collect()
    want = edges.where("type = 'functional' and target_id <> 'p7'").collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, want))
    assert _shuffle_bytes(spark) - before < 300_000  # edges as they are have over a million
