"""Statements to subject-predicate-object triples, without Python in the plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.columns import folded, packed_key, spread, stripped, unpacked_key, without_protein
from weftgraph.functions.lexicon import ACTIONS, grammar

MAIN, NESTED = "main-action_", "reaction_"
AGENT, ACTION, TARGET = "has_agent", "has_action", "has_target"
_APART = "\x1f"
_TRIPLES = "array<struct<subject:string,predicate:string,object:string>>"


def _triple(subject: Column, predicate: str, value: Column) -> Column:
    return F.struct(subject.alias("subject"), F.lit(predicate).alias("predicate"), value.alias("object"))


def _reaction(subject: Column, agent: Column, action: Column, target: Column) -> Column:
    return F.array(_triple(subject, AGENT, agent), _triple(subject, ACTION, action), _triple(subject, TARGET, target))


def parse(text: Column, index: Column, compat: bool = False, actions: tuple[str, ...] = ACTIONS) -> Column:
    """The triples of one statement, outermost reaction first.

    The statement is folded: each step reads one level of ``A act [B]`` and goes on with B. There are as many steps as
    brackets open, so depth has no bound and no level costs a Python call. A step tries inverse, nested, simple, in
    this order, and the leftmost action wins; text of no shape ends the fold with what there is. One match of a shape
    gives its three parts, which a control character keeps apart; one that a text holds is read as a blank. Null and
    empty texts have no triples.

    A nested reaction's target is the reaction that the brackets hold: for [[B act C] act D] that is the outer one.
    ``compat`` numbers targets by position only: the main action's by whether any "[[" occurs, others by their subject's
    number plus one; beyond one level this skips reactions.
    """
    shapes = grammar(actions)
    number = lambda k: F.concat(F.lit(NESTED), index.cast("string"), F.lit("_"), k.cast("string"))
    steps = F.length(text) - F.length(F.replace(text, F.lit("["), F.lit("")))
    start = F.struct(
        F.translate(text, _APART, " ").alias("text"), F.concat(F.lit(MAIN), index.cast("string")).alias("subject"), F.lit(0).alias("k"),
        F.lit(False).alias("done"), F.array().cast(_TRIPLES).alias("out"))

    def parts(value: Column, shape: str) -> Column:
        """The three parts of ``value`` by one match; one part, the value, if it has not this shape."""
        return F.split(F.regexp_replace(value, shapes[shape], f"$1{_APART}$2{_APART}$3"), _APART)

    def once(value: Column, use: Callable[[Column], Column]) -> Column:
        return F.get(F.transform(F.array(value), use), F.lit(0))

    def of_parts(subject: Column, three: Column) -> Column:
        return _reaction(subject, *[stripped(F.get(three, F.lit(k))) for k in range(3)])

    def step(acc: Column, _: Column) -> Column:
        now, own, k = acc["text"], acc["subject"], acc["k"]
        found = lambda three: F.size(three) == 3
        ended = lambda out: F.struct(now.alias("text"), own.alias("subject"), k.alias("k"), F.lit(True).alias("done"), out.alias("out"))
        nothing = F.array().cast(_TRIPLES)

        def inverse(three: Column) -> Column:
            inner = once(parts(stripped(F.get(three, F.lit(0))), "inner"), lambda held: F.when(found(held), of_parts(own, held)).otherwise(nothing))
            return ended(F.concat(acc["out"], inner, _reaction(number(k), own, *[stripped(F.get(three, F.lit(j))) for j in (1, 2)])))

        def nested(three: Column) -> Column:
            content = stripped(F.get(three, F.lit(2)))
            if compat:
                aim = F.when(k == 0, number(F.when(text.rlike(r"\[\["), F.lit(1)).otherwise(F.lit(0)))).otherwise(number(k))
            else:
                aim = F.when(content.startswith("[") & content.rlike(shapes["inverse"]), number(k + 1)).otherwise(number(k))
            outer = _reaction(own, *[stripped(F.get(three, F.lit(j))) for j in (0, 1)], aim)
            return F.struct(content.alias("text"), number(k).alias("subject"), (k + 1).alias("k"), F.lit(False).alias("done"), F.concat(acc["out"], outer).alias("out"))

        simple = lambda three: F.when(found(three), ended(F.concat(acc["out"], of_parts(own, three)))).otherwise(ended(acc["out"]))
        closed = now.endswith("]")  # what the patterns ask for at the ends, asked first
        bracketed = once(parts(now, "nested"), lambda three: F.when(found(three), nested(three)).otherwise(ended(acc["out"])))
        plain = once(parts(now, "simple"), simple)
        other = F.when(closed, bracketed).otherwise(plain)
        opened = once(parts(now, "inverse"), lambda three: F.when(found(three), inverse(three)).otherwise(other))
        return F.when(acc["done"], acc).when(now.startswith("["), opened).otherwise(other)

    folded = F.aggregate(F.sequence(F.lit(0), steps), start, step)["out"]
    return F.when(F.length(text) > 0, folded).otherwise(F.array().cast(_TRIPLES))


def object_type(chemical: Column, gene: Column, predicate: Column, value: Column) -> Column:
    """action, reaction, chemical, protein or other; chemical wins over protein."""
    return (
        F.when(predicate == ACTION, "action")
        .when(value.contains(NESTED) | value.contains(MAIN), "reaction")
        .when(value == chemical, "chemical")
        .when(without_protein(value) == gene, "protein")
        .otherwise("other")
    )


def predicate_number(predicate: Column) -> Column:
    return F.when(predicate == AGENT, 0).when(predicate == ACTION, 1).otherwise(2)


def extract_triples(statements: DataFrame, compat: bool = False, actions: tuple[str, ...] = ACTIONS) -> DataFrame:
    """``statements(index, Interaction, ChemicalName, GeneSymbol)`` to one row for each triple.

    Columns: index, Interaction, subject, predicate, object, ChemicalName, GeneSymbol, triple_object_type, pred_numb,
    id. An entity's id is its type, the index and the triple's place in the statement; a reaction's is the reaction it
    names, except that an agent row has its subject's number plus one, which names nothing.
    """
    parsed = statements.select("index", "Interaction", "ChemicalName", "GeneSymbol", F.posexplode(parse(F.col("Interaction"), F.col("index"), compat, actions)).alias("_at", "_t"))
    rows = parsed.select("index", "Interaction", "_at", "_t.subject", "_t.predicate", "_t.object", "ChemicalName", "GeneSymbol")
    kind = object_type(F.col("ChemicalName"), F.col("GeneSymbol"), F.col("predicate"), F.col("object"))
    rows = rows.withColumn("triple_object_type", kind).withColumn("pred_numb", predicate_number(F.col("predicate")))
    main = F.col("subject").startswith(MAIN)
    after = F.when(main, F.when(F.col("Interaction").rlike(r"\[\["), F.lit(1)).otherwise(F.lit(0))).otherwise(F.try_element_at(F.split("subject", "_"), F.lit(-1)).try_cast("int") + 1)
    phantom = F.concat(F.lit(NESTED), F.col("index").cast("string"), F.lit("_"), after.cast("string"))
    aimed = phantom if compat else F.when(F.col("predicate") == AGENT, phantom).otherwise(F.col("object"))
    own = F.concat_ws("_", F.col("triple_object_type"), F.col("index").cast("string"), F.col("_at").cast("string"))
    rows = rows.withColumn("id", F.when(F.col("triple_object_type") == "reaction", aimed).otherwise(own))
    moved = (F.col("triple_object_type") == "reaction") & (F.col("predicate") != AGENT)
    return rows.withColumn("object", F.when(moved, F.col("id")).otherwise(F.col("object"))).drop("_at")


def _names() -> dict[str, Column]:
    return {"chem_name": F.col("object"), "gene_symbol": without_protein(F.col("object"))}


def slim(triples: DataFrame) -> DataFrame:
    """``triples`` to be stashed or shuffled: subject and id don't repeat the index, and an index of text is 16 bytes.
    ``full`` of it, or of ``slim_names`` of it, gives them back."""
    index = F.col("index").cast("string")
    new = {c: folded(F.col(c), index) for c in ("subject", "id")}
    if dict(triples.dtypes)["index"] == "string":
        new["index"] = packed_key(F.col("index"))
    return triples.select(*[new[c].alias(c) if c in new else F.col(c) for c in triples.columns])


def slim_names(slimmed: DataFrame) -> DataFrame:
    """Vocabularies' names don't repeat the object."""
    return slimmed.select(*[folded(F.col(c), _names()[c]).alias(c) if c in _names() else F.col(c) for c in slimmed.columns])


def full(slimmed: DataFrame) -> DataFrame:
    rows = slimmed.withColumn("index", unpacked_key(F.col("index"))) if dict(slimmed.dtypes)["index"].startswith("struct") else slimmed
    held = dict.fromkeys(("subject", "id"), F.col("index").cast("string")) | _names()
    return rows.select(*[spread(F.col(c), held[c]).alias(c) if c in held else F.col(c) for c in rows.columns])


def max_depth(triples: DataFrame) -> DataFrame:
    """One row, ``max_depth``: the most triples of a statement by three, less one; null without triples."""
    counts = triples.groupBy("index").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg((F.floor(F.max("n") / 3) - 1).cast("int").alias("max_depth"))
