import re

import pytest

from weftgraph.functions.lexicon import ACTIONS, action_group, any_of, escaped, grammar
from weftgraph.operators.triples import extract_triples, max_depth

#: Statement, and its reactions as subject | agent | action | target.
GOLDENS = [
    ("Aspirin binds to PTGS2 protein", ["main-action_0|Aspirin|binds to|PTGS2 protein"]),
    ("Aspirin inhibits the reaction [Glucose results in increased expression of INS protein]", ["main-action_1|Aspirin|inhibits the reaction|reaction_1_0", "reaction_1_0|Glucose|results in increased expression of|INS protein"]),
    ("[Glucose co-treated with INS protein] results in increased expression of PTEN protein", ["main-action_2|Glucose|co-treated with|INS protein", "reaction_2_0|main-action_2|results in increased expression of|PTEN protein"]),
    ("Sirolimus inhibits the reaction [[Glucose co-treated with INS protein] results in increased expression of PTEN protein]",
     ["main-action_3|Sirolimus|inhibits the reaction|reaction_3_1", "reaction_3_0|Glucose|co-treated with|INS protein", "reaction_3_1|reaction_3_0|results in increased expression of|PTEN protein"]),
    ("A inhibits the reaction [B promotes the reaction [[C co-treated with D] results in increased expression of E protein]]",
     ["main-action_4|A|inhibits the reaction|reaction_4_0", "reaction_4_0|B|promotes the reaction|reaction_4_2", "reaction_4_1|C|co-treated with|D", "reaction_4_2|reaction_4_1|results in increased expression of|E protein"]),
    ("[A results in decreased activity of B protein] inhibits the reaction [[C co-treated with D protein] results in increased expression of E protein]",
     ["main-action_5|A|results in decreased activity of|B protein] inhibits the reaction [[C co-treated with D protein", "reaction_5_0|main-action_5|results in increased expression of|E protein]"]),
    ("[Smoke results in increased activity of X] which results in increased activity of EGFR protein", ["main-action_6|Smoke|results in increased activity of|X", "reaction_6_0|main-action_6|which results in increased activity of|EGFR protein"]),
    ("A binds to and results in increased activity of B protein", ["main-action_7|A|binds to|and results in increased activity of B protein"]),
    ("A affects the hydrolysis of B protein", []),
    ("[A protein analog] results in increased activity of B protein", ["reaction_9_0|main-action_9|results in increased activity of|B protein"]),
    ("A which binds to B protein", ["main-action_10|A|which binds to|B protein"]),
    ("no verb here", []), ("", []), (None, []),
]


def found(spark, statements, **options):
    rows = spark.createDataFrame([(i, t, "Aspirin", "PTGS2") for i, t in enumerate(statements)], "index long, Interaction string, ChemicalName string, GeneSymbol string")
    out: dict = {}
    for r in extract_triples(rows, **options).collect():
        out.setdefault((r["index"], r["subject"]), {})[r["predicate"]] = r["object"]
    made = [[] for _ in statements]
    for (i, s), t in out.items():
        made[i].append("|".join([s, t["has_agent"], t["has_action"], t["has_target"]]))
    return [sorted(m) for m in made]


def test_goldens(spark):
    assert found(spark, [t for t, _ in GOLDENS]) == [sorted(w) for _, w in GOLDENS]


def test_compat_numbers_targets_by_position(spark):
    got = found(spark, [t for t, _ in GOLDENS], compat=True)
    assert "main-action_3|Sirolimus|inhibits the reaction|reaction_3_1" in got[3]
    assert "main-action_4|A|inhibits the reaction|reaction_4_1" in got[4] and "reaction_4_0|B|promotes the reaction|reaction_4_1" in got[4]


@pytest.mark.parametrize("depth", [1, 5, 30])
def test_any_depth(spark, depth):
    text = "Z binds to Y"
    for k in range(depth):
        text = f"a{k} inhibits the reaction [{text}]"
    got = found(spark, [text])[0]
    assert len(got) == depth + 1 and f"reaction_0_{depth - 1}|Z|binds to|Y" in got


def test_depth_and_types(spark):
    rows = spark.createDataFrame([(0, GOLDENS[0][0], "Aspirin", "PTGS2"), (4, GOLDENS[4][0], "A", "E")], "index long, Interaction string, ChemicalName string, GeneSymbol string")
    triples = extract_triples(rows)
    assert max_depth(triples).first()[0] == 3
    kinds = {(r["index"], r["object"]): (r["triple_object_type"], r["pred_numb"]) for r in triples.collect()}
    assert kinds[0, "Aspirin"] == ("chemical", 0) and kinds[0, "PTGS2 protein"] == ("protein", 2) and kinds[0, "binds to"] == ("action", 1)
    assert kinds[4, "reaction_4_0"] == ("reaction", 2) and kinds[4, "D"] == ("other", 2)
    assert max_depth(triples.limit(0)).first()[0] is None


def test_lexicon():
    assert len(ACTIONS) == 115 and len(set(ACTIONS)) == 115
    assert all(re.compile(p) for p in grammar().values())
    assert re.fullmatch(action_group(), "which binds to").group(1) == "which binds to"
    plain = "(?:" + "|".join(map(escaped, ACTIONS)) + ")"
    for text in [a + e for a in ACTIONS for e in ("", " x", "x")] + ["results in", "affects the", "Caproate binds", "co-treated with binds to"]:
        both = [re.match(p, text) for p in (plain, any_of(ACTIONS))]
        assert (both[0] and both[0].group()) == (both[1] and both[1].group())
    assert any_of(("a b", "a b c", "d")) == "(?:a b|a b c|d)"


def test_a_lexicon_of_ones_own(spark, tmp_path):
    """Phrases from a YAML file, one the beginning of another, with signs of regular expressions in them."""
    from weftgraph import pipeline
    from weftgraph.config import Preparation, Settings, load_lexicon, load_settings

    (tmp_path / "lexicon.yml").write_text('actions: ["docks (at)", "docks", "stops the reaction", "glues "]\n')
    phrases = load_lexicon(tmp_path / "lexicon.yml")
    assert phrases == ("docks (at)", "docks", "stops the reaction", "glues ")
    texts = ["A docks (at) B protein", "A docks B protein", "A which docks B", "A stops the reaction [C docks B protein]", "A binds to B", "A glues  B", "A docks \x1f B"]
    rows = spark.createDataFrame([(i, t, "A", "B") for i, t in enumerate(texts)], "index long, Interaction string, ChemicalName string, GeneSymbol string")
    got = {}
    for r in extract_triples(rows, actions=phrases).collect():
        got.setdefault(r["index"], []).append((r["predicate"], r["object"]))
    three = lambda *v: list(zip(("has_agent", "has_action", "has_target"), v))
    assert got == {
        0: three("A", "docks (at)", "B protein"), 1: three("A", "docks", "B protein"), 2: three("A", "which docks", "B"),
        3: three("A", "stops the reaction", "reaction_3_0") + three("C", "docks", "B protein"), 5: three("A", "glues", "B"), 6: three("A", "docks", "B")}
    for bad in ("verbs: [a]", "actions: []", "actions: ['']", "actions: [1]", "[a]"):
        (tmp_path / "bad.yml").write_text(bad)
        with pytest.raises((KeyError, ValueError)):
            load_lexicon(tmp_path / "bad.yml")

    (tmp_path / "s.yml").write_text("preparation:\n  lexicon: [docks]\n  compat: true\n")
    settings = load_settings(tmp_path / "s.yml")
    assert settings == Settings(Preparation(lexicon=("docks",), compat=True))
    columns = "ChemicalName string, ChemicalID string, CasRN string, GeneSymbol string, GeneID string, GeneForms string, Organism string, OrganismID string, Interaction string, InteractionActions string, PubMedIDs string"
    seen = spark.createDataFrame([("A", "C1", None, "B", "G1", "protein", "Homo sapiens", "9606", t, None, None) for t in ("A docks B protein", "A binds to B protein")], columns)
    chemicals, genes = spark.createDataFrame([("C1", "A")], "chem_ID string, chem_name string"), spark.createDataFrame([("G1", "b", "B")], "gene_ID string, gene_name string, gene_symbol string")
    done = pipeline.prepare_graph(seen, chemicals, genes, settings)
    assert {r["relationship"] for r in done.graph.edges.where("type = 'functional'").collect()} == {"DOCKS"}
