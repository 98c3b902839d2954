import itertools
import random

import pytest

from weftgraph.operators import algorithms, canonical, explore, graph, resolve, skew, triples, validate
from weftgraph.operators.components import connected_components
from weftgraph.session import stash

STATEMENTS = ["Aspirin binds to PTGS2 protein", "Aspirin inhibits the reaction [Glucose results in increased expression of INS protein]", "Caffeine binds to ADORA2A protein"]
R1 = "n_reaction_0_5354fafffb19b4f6b4d84da54fc23fb82f77de451e2fd732b0f5684e249cd72b"
R2 = "n_reaction_0_048bcbae4302228a3803d7f91affeccc0428fb9d5410a66fc1b50255366e97fb"
R3 = "n_reaction_0_b21cdc4ac4f6cf15f9cfecd3ac5f945c31d2158e90e8381a379de765b90c5dc3"
R4 = "n_reaction_0_93553e083d8c356ce9c070a6f0313e4b90e6b24cfffc1ced6bbfc7e22660111f"
NAMES = {"Aspirin": "c1", "Glucose": "c2", "Caffeine": "c3", "PTGS2 protein": "p1", "INS protein": "p2", "ADORA2A protein": "p3", R1: "r1", R2: "r2", R3: "r3", R4: "r4"}


def vocabularies(spark):
    chemicals = spark.createDataFrame([("C1", "Aspirin"), ("C2", "Glucose"), ("C3", "Caffeine")], "chem_ID string, chem_name string")
    genes = spark.createDataFrame([("G1", "g", "PTGS2"), ("G2", "g", "INS"), ("G3", "g", "ADORA2A")], "gene_ID string, gene_name string, gene_symbol string")
    return chemicals, genes


@pytest.fixture(scope="module")
def whole(spark):
    rows = spark.createDataFrame([(i, t, "Aspirin", "PTGS2") for i, t in enumerate(STATEMENTS)], "index long, Interaction string, ChemicalName string, GeneSymbol string")
    chemicals, genes = vocabularies(spark)
    mapped = resolve.map_genes(resolve.map_chemicals(resolve.recover(triples.extract_triples(rows), chemicals), chemicals), genes)
    return stash(resolve.whole_statements(mapped))


@pytest.fixture(scope="module")
def tiny(spark, whole):
    """The ten vertices, with short ids."""
    from pyspark.sql import functions as F

    built = graph.build_graph(canonical.canonical_triples(whole))
    assert {r["name"] for r in built.vertices.collect()} == set(NAMES)
    short = spark.createDataFrame([(r["id"], NAMES[r["name"]]) for r in built.vertices.select("id", "name").collect()], "old string, new string")
    lookup = F.create_map(*itertools.chain.from_iterable((F.lit(a), F.lit(b)) for a, b in short.collect()))
    vertices = built.vertices.withColumn("id", lookup[F.col("id")])
    edges = built.edges.withColumns({c: lookup[F.col(c)] for c in ("source_id", "target_id", "reaction_id")})
    return graph.PropertyGraph(stash(vertices), stash(edges))


def test_tree_hashes(whole):
    ids = {r["subject"]: r["reaction_id"] for r in canonical.reaction_signatures(whole).collect()}
    assert ids == {"main-action_0": R1, "main-action_1": R2, "reaction_1_0": R3, "main-action_2": R4}
    compat = {r["subject"]: r["reaction_id"] for r in canonical.reaction_signatures(whole, compat=True).collect()}
    assert compat == {**ids, "main-action_1": "main-action_1"}


def test_degrees(tiny):
    got = {r["id"]: (r["inDegree"], r["outDegree"], r["degree"], round(r["degree_centrality"], 6)) for r in algorithms.degree_centrality(tiny).collect()}
    want = {"c1": (2, 4), "c2": (1, 2), "c3": (1, 2), "p1": (2, 1), "p2": (2, 1), "p3": (2, 1), "r1": (2, 2), "r2": (2, 2), "r4": (2, 2), "r3": (4, 3)}
    assert got == {k: (i, o, i + o, round((i + o) / 9, 6)) for k, (i, o) in want.items()}


def test_components_and_communities(tiny):
    parts = stash(algorithms.components(tiny))
    got = {r["id"]: (r["component_id"], r["component_count"]) for r in parts.collect()}
    assert got == {v: ("c3", 3) if v in ("c3", "p3", "r4") else ("c1", 7) for v in NAMES.values()}
    assert tuple(algorithms.largest_component(parts).first()) == ("c1", 7, 2)
    labels = {r["id"]: r["label"] for r in algorithms.label_propagation(tiny, 5).collect()}
    assert labels == {"c1": "p1", "c2": "p2", "c3": "p3", "p1": "c1", "p2": "c2", "p3": "c3", "r1": "r1", "r2": "r2", "r3": "c1", "r4": "r4"}
    report = algorithms.graph_report(tiny, "x", parts).first().asDict()
    assert (report["node_count"], report["edge_count"], report["connected_component_count"]) == (10, 20, 2)


def test_paths(tiny):
    got = {r["id"]: (r["dist"], r["hops"], r["vertices_path"]) for r in algorithms.shortest_paths(tiny, "p2").collect()}
    assert got.pop("c2") == (1.0, 1, "c2, p2") and got.pop("r3") == (2.0, 1, "r3, p2")
    assert got.pop("c1") == (3.0, 2, "c1, r3, p2") and got.pop("p2") == (0.0, 0, "p2")
    assert set(got.values()) == {(999999.0, 0, "")}
    near = {r["id"]: (r["dist"], r["hops"]) for r in algorithms.shortest_paths(tiny, "p1").collect() if r["reachable"]}
    assert near == {"c1": (1.0, 1), "r1": (2.0, 1), "p1": (0.0, 0)}


def test_invariants_hold(tiny):
    assert {r["check"]: r["broken"] for r in validate.verdicts(tiny).collect() if r["broken"]} == {}


def test_exploration(tiny):
    assert explore.find_by_name(tiny, "aspirin") == "c1"
    with pytest.raises(LookupError):
        explore.find_by_name(tiny, "nothing")
    assert explore.kpi_by_type(tiny.vertices).first().asDict() == {"chemicals": 3, "proteins": 3, "reactions": 4, "total": 10}
    assert {(r["direction"], r["neighbour_id"]) for r in explore.neighbourhood(tiny, "p3").collect()} == {("in", "c3"), ("out", "r4"), ("in", "r4")}
    assert explore.induced_subgraph(tiny, ["c2", "p2"]).count() == 1
    forward = explore.path_edges_forward(tiny, ["c1", "r3", "p2"]).collect()
    assert {(r["source_id"], r["target_id"]) for r in forward} == {("c1", "r3"), ("r3", "p2")}
    top = explore.top_n(algorithms.degree_centrality(tiny), "degree", 2).collect()
    assert [(r["id"], r["rank"]) for r in top] == [("r3", 1), ("c1", 2)]


def test_integrity_drops_whole_statements(spark):
    chemicals, genes = vocabularies(spark)
    texts = [STATEMENTS[0], "Aspirin binds to something else", "Nothing binds to PTGS2 protein"]
    rows = spark.createDataFrame([(i, t, "Aspirin", "PTGS2") for i, t in enumerate(texts)], "index long, Interaction string, ChemicalName string, GeneSymbol string")
    parsed = triples.extract_triples(rows)
    recovered = resolve.recover(parsed, chemicals)
    mapped = resolve.map_genes(resolve.map_chemicals(recovered, chemicals), genes)
    assert {r["index"] for r in resolve.whole_statements(mapped).collect()} == {0}
    twice = chemicals.unionByName(chemicals)
    repeated = resolve.map_genes(resolve.map_chemicals(resolve.recover(parsed, twice), twice), genes)
    assert resolve.whole_statements(repeated).count() == 0  # a name twice in the vocabulary breaks the rule of three


@pytest.mark.parametrize("seed", range(3))
def test_random_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(200 + i, 201 + i) for i in range(40)] + [(300, 300), (None, 3)]
    got = {r["vertex"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    root: dict = {}

    def find(x):
        root.setdefault(x, x)
        return x if root[x] == x else find(root[x])

    for a, b in edges:
        if a is not None:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    assert got == {v: find(v) for v in list(root)}


@pytest.mark.parametrize("seed", range(2))
def test_random_paths(spark, seed):
    rng = random.Random(seed)
    ids = [f"v{i:02d}" for i in range(25)]
    edges = [(rng.choice(ids), rng.choice(ids), f"R{k % 3}", f"x{k}", "functional") for k in range(60)]
    built = graph.PropertyGraph(spark.createDataFrame([(i, i, "protein", None, "g", None) for i in ids], "id string, name string, type string, chem_ID string, gene_ID string, action string"), spark.createDataFrame(edges, "source_id string, target_id string, relationship string, reaction_id string, type string"))
    dist = {ids[0]: 0}
    for _ in ids:
        for a, b, *_ in edges:
            if b in dist and dist.get(a, 99) > dist[b] + 1:
                dist[a] = dist[b] + 1
    got = {r["id"]: r["dist"] for r in algorithms.shortest_paths(built, ids[0], 30).collect() if r["reachable"]}
    assert got == dist


def test_whole_graph_queries(spark, tmp_path):
    """All lines reach the graph; it has a component around a hub. With worlds, every world has components of its own."""
    from collections import Counter

    from weftgraph.plans import registry
    from weftgraph.sources import star

    found = registry.queries()
    rng = random.Random(5)
    pairs = sorted({(k, 1) for k in range(1, 31)} | {(rng.randrange(1, 31), rng.randrange(2, 8)) for _ in range(40)} | {(40, 9)})
    lines = [(3 * k, p, s, rng.choice("ANR"), rng.choice("FO")) for k, (p, s) in enumerate(pairs) for _ in range(2)]  # all in one world
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, f"part {k}") for k in range(1, 41)], "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(k, f"supplier {k}") for k in range(1, 10)], "s_suppkey long, s_name string").write.parquet(f"{tmp_path}/supplier.parquet")
    run = lambda n: found[n](spark, str(tmp_path)).collect()
    edges = [tuple(r) for r in run("lp_edges")]
    links: dict = {}
    for s, _, t, _, _, kind in edges:
        links.setdefault(s, {})[t] = links.setdefault(t, {})[s] = True
    own = {v: v for v in links}
    for _ in links:
        own = {v: min([own[v], *[own[w] for w in links[v]]]) for v in links}
    assert {r["id"]: r["component_id"] for r in algorithms.components(star.graph(spark, str(tmp_path))).collect()} == own
    assert sorted(r["component_count"] for r in run("component_sizes")) == sorted(Counter(own.values()).values()) and len(set(own.values())) == 2
    assert {r["id"] for r in run("connected_components") if r["type"] == "protein"} == {f"protein_0_{k}" for k in {s for _, s in pairs}}

    functional: dict = {v: set() for v in links}
    for s, _, t, _, _, kind in edges:
        if kind == "functional":
            functional[s].add(t)
            functional[t].add(s)
    labels = {v: v for v in links}
    for _ in range(5):
        heard = {v: Counter(labels[w] for w in functional[v]) for v in links}
        labels = {v: min(heard[v], key=lambda x: (-heard[v][x], x)) if heard[v] else labels[v] for v in links}
    assert {r["id"]: r["label"] for r in run("label_propagation")} == labels
    # only chemicals and the reactions into the hub lead to it
    into = {r["reaction_id"] for r in run("reactions_into_target")}
    reached = {r["id"]: r["dist"] for r in run("shortest_path") if r["reachable"]}
    assert reached == {"protein_1": 0.0, **{f"chemical_{k}": 1.0 for k in range(1, 31)}, **{r: 2.0 for r in into}}
    assert run("reachable_count")[0][0] == 30 + len(into) and {r["neighbour_id"] for r in run("neighbourhood")} == set(links["protein_1"])
    joined = {(s, t) for s, _, t, *_ in edges}
    free = {(r["source"], r["target"]) for r in run("lp_negatives")}
    assert free and not free & joined and all(s in links and t in links and s != t for s, t in free)


def test_labels_of_many_vertices_are_not_broadcast(spark, monkeypatch):
    edges = [(f"v{k % 40}", f"v{(k * 7) % 41}", "A", None, "functional") for k in range(200)]
    edges = spark.createDataFrame(edges, "source_id string, target_id string, relationship string, reaction_id string, type string")
    vertices = spark.createDataFrame([(f"v{k}", "n", "x") for k in range(45)], "id string, name string, type string")
    g = graph.PropertyGraph(vertices, edges)
    few = {tuple(r) for r in algorithms.label_propagation(g, 3).collect()}
    monkeypatch.setattr(skew, "MOST_SENT", 10)
    heard, _ = algorithms._labels(g, 3)
    plan = heard._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert {tuple(r) for r in algorithms.label_propagation(g, 3).collect()} == few and len(few) == 45
