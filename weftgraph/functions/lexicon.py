"""The action phrases of interaction statements, and patterns made of them."""

from __future__ import annotations

import re

# The phrases that statements use, in the order in which they are tried. The blank that ends "affects the
# hydrolysis of " is part of the phrase: it is only found before two blanks.
ACTIONS = (
    "binds to",
    "which binds to",
    "Caproate binds to",
    "co-treated with",
    "inhibits the reaction",
    "promotes the reaction",
    "catalyzed by",
    "results in increased phosphorylation of",
    "results in decreased phosphorylation of",
    "affects the phosphorylation of",
    "results in increased methylation of",
    "results in decreased methylation of",
    "affects the methylation of",
    "results in increased acetylation of",
    "results in decreased acetylation of",
    "affects the acetylation of",
    "results in increased cleavage of",
    "results in decreased cleavage of",
    "affects the cleavage of",
    "results in increased sumoylation of",
    "results in decreased sumoylation of",
    "affects the sumoylation of",
    "results in increased ubiquitination of",
    "results in decreased ubiquitination of",
    "affects the ubiquitination of",
    "results in increased expression of",
    "results in decreased expression of",
    "affects the expression of",
    "results in increased abundance of",
    "results in decreased abundance of",
    "affects the abundance of",
    "results in increased stability of",
    "results in decreased stability of",
    "affects the stability of",
    "results in increased localization of",
    "results in decreased localization of",
    "affects the localization of",
    "results in increased activity of",
    "results in decreased activity of",
    "affects the activity of",
    "results in increased metabolism of",
    "results in decreased metabolism of",
    "affects the metabolism of",
    "results in increased oxidation of",
    "results in decreased oxidation of",
    "affects the oxidation of",
    "results in increased reduction of",
    "results in decreased reduction of",
    "affects the reduction of",
    "results in increased hydrolysis of",
    "results in decreased hydrolysis of",
    "affects the hydrolysis of ",
    "results in increased glucuronidation of",
    "results in decreased glucuronidation of",
    "affects the glucuronidation of",
    "results in increased glycosylation of",
    "results in decreased glycosylation of",
    "affects the glycosylation of",
    "results in increased farnesylation of",
    "results in decreased farnesylation of",
    "affects the farnesylation of",
    "results in increased lipidation of",
    "results in decreased lipidation of",
    "affects the lipidation of",
    "results in increased sulfation of",
    "results in decreased sulfation of",
    "affects the sulfation of",
    "results in increased hydroxylation of",
    "results in decreased hydroxylation of",
    "affects the hydroxylation of",
    "results in increased carboxylation of",
    "results in decreased carboxylation of",
    "affects the carboxylation of",
    "results in increased glutathionylation of",
    "results in decreased glutathionylation of",
    "affects the glutathionylation of",
    "results in increased glycation of",
    "results in decreased glycation of",
    "affects the glycation of",
    "results in increased alkylation of",
    "results in decreased alkylation of",
    "affects the alkylation of",
    "results in increased degradation of",
    "results in decreased degradation of",
    "affects the degradation of",
    "results in increased folding of",
    "results in decreased folding of",
    "affects the folding of",
    "results in increased susceptibility to",
    "results in decreased susceptibility to",
    "affects the susceptibility to",
    "results in increased chemical synthesis of",
    "results in decreased chemical synthesis of",
    "affects the chemical synthesis of",
    "results in increased secretion of",
    "results in decreased secretion of",
    "affects the secretion of",
    "results in increased uptake of",
    "results in decreased uptake of",
    "affects the uptake of",
    "results in increased transport of",
    "results in decreased transport of",
    "affects the transport of",
    "results in increased import of",
    "results in decreased import of",
    "affects the import of",
    "results in increased export of",
    "results in decreased export of",
    "affects the export of",
    "results in increased splicing of",
    "results in decreased splicing of",
    "affects the splicing of",
    "results in increased mutagenesis of",
    "results in decreased mutagenesis of",
    "affects the mutagenesis of",
)

# Words by which a statement may say what its action codes name.
CONCEPTS = {
    "affects": ["inhibits", "promotes", "induces", "activates", "modulates", "results in", "susceptibility", "affects", "binds", "impacts", "acts on"],
    "binding": ["binds", "bound", "binding", "complex", "associates", "interaction", "ligand", "docking", "attachment"],
    "decreases": ["decreased", "decreases", "inhibits", "reduction", "lower", "attenuates", "blocks", "suppresses", "downregulates", "diminishes", "depletes"],
    "increases": ["increased", "increases", "promotes", "induction", "higher", "upregulates", "activates", "stimulates", "augments", "elevates"],
    "metabolic processing": ["metabolism", "metabolized", "metabolic", "processing", "catabolism", "anabolism", "biotransformation", "degradation"],
    "chemical synthesis": ["synthesis", "synthesized", "production", "formation", "generation", "synthesizing"],
    "reaction": ["reaction", "process", "interaction", "transformation", "conversion", "pathway"],
    "expression": ["expression", "levels", "mrna", "protein levels", "transcript", "expressed"],
    "abundance": ["abundance", "levels", "concentration", "amount", "quantity", "presence"],
    "activity": ["activity", "active", "function", "catalytic", "enzymatic", "action"],
    "response to substance": ["susceptibility", "sensitivity", "resistance", "response", "reactivity", "effect of"],
    "cotreatment": ["co-treated", "cotreatment", "combination", "together with", "presence of", "addition of"],
    "cleavage": ["cleavage", "cleaved", "proteolysis", "hydrolysis", "breakdown", "fragmentation"],
    "phosphorylation": ["phosphorylation", "phosphorylated", "phospho", "kinase activity"],
}


def escaped(phrase: str) -> str:
    """``phrase`` with what regular expressions read as signs made plain, for Java, Python and RE2 alike."""
    return re.sub(r"([.\\+*?\[^\]$(){}=!<>|:#-])", r"\\\1", phrase)


def _folded(phrases: list[list[str]]) -> str:
    """One expression for phrases cut into words, with each common beginning written once."""
    by_word: dict[str, list[list[str]]] = {}
    for words in phrases:
        by_word.setdefault(words[0], []).append(words[1:])
    parts = [escaped(w) + (" " + _folded(rest) if rest != [[]] else "") for w, rest in by_word.items()]
    return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"


def any_of(actions: tuple[str, ...]) -> str:
    """Matches what the alternatives in their order do. Common beginnings are folded, so that a place in a text is tried
    against a few words instead of all phrases; that changes nothing unless a phrase goes on where another ends."""
    distinct = list(dict.fromkeys(actions))
    cut = [a.split(" ") for a in distinct]
    if any(x != y and y[: len(x)] == x for x in cut for y in cut):
        return "(?:" + "|".join(map(escaped, distinct)) + ")"
    return _folded(cut)


def action_group(actions: tuple[str, ...] = ACTIONS) -> str:
    """One group: a phrase, with "which " before it if it is there."""
    return r"((?:which\s+)?" + any_of(actions) + ")"


def checked(phrases: list[str] | tuple[str, ...]) -> tuple[str, ...]:
    """Phrases of a lexicon as the grammar takes them: none, an empty or blank one, or something else than text raises."""
    if not phrases or not all(isinstance(p, str) and p.strip() for p in phrases):
        raise ValueError("a lexicon needs phrases, and each must be text")
    return tuple(dict.fromkeys(phrases))


# Where brackets and blanks stand in the four shapes; the phrases between are the lexicon's.
def grammar(actions: tuple[str, ...] = ACTIONS) -> dict[str, str]:
    """The shapes of a statement: ``inverse`` [A] act B, ``nested`` A act [B], ``simple`` A act B; ``inner`` is what
    stands in the brackets of an inverse one."""
    act = action_group(actions)
    return {
        "inverse": r"^\[(.*)\]\s+" + act + r"\s+(.*)$",
        "nested": r"^(.*?)\s+" + act + r"\s+\[(.*)\]$",
        "simple": r"^(.*?)\s+" + act + r"\s+([^\[\]]+)$",
        "inner": r"^(.*?)\s+" + act + r"\s+(.*)$",
    }
