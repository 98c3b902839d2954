"""Language identification by string kernels: n-gram presence, Nystroem landmarks, one-versus-rest ridge regression."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.arrow import AT_ONCE, per_text, structs
from weftgraph.session import small_batches

#: n-grams of 1 to SPECTRUM characters, and the ridge.
SPECTRUM, RIDGE = 3, 1e-3
#: What bounds the sample that the driver fits on: training texts and landmarks for each language and in all, the shortest
#: and longest training text in characters, and languages (those with the most such texts).
PER_LANGUAGE, LANDMARKS, MOST_TEXTS, MOST_LANDMARKS, LEAST_CHARS, MOST_CHARS, MOST_LANGUAGES = 300, 60, 12_000, 1200, 20, 20_000, 200
#: A text is in no learned language if landmarks have less of its n-grams than this part of what they have of any training
#: text, or if its best score is lower by more than the second number than that of any training text.
SLACK, SCORE_SLACK = 0.5, 0.1
_BITS = 21  # of a code point
#: n-grams of a text whose weights are summed at a time.
HITS = 20_000


def spectrum(text: str) -> list[np.ndarray]:
    """For n = 1, 2, 3 the sorted set of the text's n-grams, lower case; three code points fit in 63 bits."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype("int64") + 1
    if not len(points):
        return [np.empty(0, "int64")] * SPECTRUM
    padded = np.concatenate([points, [0, 0]])
    grams = np.unique((padded[:-2] << 2 * _BITS) | (padded[1:-1] << _BITS) | padded[2:])
    out = []
    for n in range(1, SPECTRUM + 1):
        shift = (SPECTRUM - n) * _BITS
        part = grams >> shift
        if n > 1:  # the last places hold no full n-gram
            part = part[(part & ((1 << _BITS) - 1)) > 0]
        out.append(part[np.r_[True, part[1:] != part[:-1]]] << shift if len(part) else part)
    return out


@dataclass
class KernelModel:
    """languages, and for each n the landmarks' n-grams with what each adds to every language's score.

    The kernel is the mean over n of |G_n(x) & G_n(z)| / sqrt(|G_n(x)| |G_n(z)|). With presence rows P, the landmarks'
    scaled presence B and the ridge weights W, scores are (P B) W = P (B W); B W is held, so a batch of texts costs one
    product of its sparse P with the dense B W, and no landmark is looked at again. ``least`` is the share of a text's
    n-grams that landmarks must have, and ``least_score`` the score that one language must have, for any to be told.
    """

    languages: list[str]
    grams: list[np.ndarray]
    weights: list[np.ndarray]
    least: float = field(default=0.0)
    least_score: float = field(default=-np.inf)

    def scores(self, texts: list[str]) -> np.ndarray:
        return self.judge(texts)[0]

    def judge(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Every language's score for each text, and the share of its n-grams that any landmark has."""
        out, known, of = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts)), np.zeros(len(texts))
        sets = [spectrum(t) for t in texts]
        for n, (grams, weights) in enumerate(zip(self.grams, self.weights)):
            sizes = np.array([len(s[n]) for s in sets])
            of += sizes
            if not sizes.sum() or not len(grams):
                continue
            every = np.concatenate([s[n] for s in sets])
            at = np.minimum(np.searchsorted(grams, every), len(grams) - 1)
            hit = grams[at] == every
            ends = np.cumsum(hit)[np.cumsum(sizes)[sizes > 0] - 1]  # of each row's hits
            starts = np.r_[0, ends[:-1]]
            known[sizes > 0] += ends - starts
            scale = 1 / (SPECTRUM * np.sqrt(np.maximum(1, sizes)))
            found = at[hit]
            # rows in runs of HITS hits at most (or one row): what is summed at a time is bounded, whatever the texts
            for row, (first, last) in zip(np.flatnonzero(sizes), zip(starts, ends, strict=True), strict=True):
                for piece in range(first, last, HITS):
                    out[row] += weights[found[piece : min(last, piece + HITS)]].sum(axis=0) * scale[row]
        return out, known / np.maximum(of, 1)


def fit(texts: list[str], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> KernelModel:
    """``landmarks`` texts of each language, spread evenly over those given, carry the Nystroem approximation.

    Landmarks are held as sorted (n-gram, landmark, value) triples: the fit's memory follows their n-grams, not the
    product of n-grams and landmarks."""
    languages = sorted(set(labels))
    sets = [spectrum(t) for t in texts]
    marks: list[int] = []
    for language in languages:
        own = [i for i, x in enumerate(labels) if x == language]
        marks += own[:: max(1, len(own) // landmarks)][:landmarks]
    triples, kernel = [], np.zeros((len(texts), len(marks)))
    for n in range(SPECTRUM):
        sizes = np.array([len(sets[i][n]) for i in marks], "int64")
        gram = np.concatenate([sets[i][n] for i in marks] or [np.empty(0, "int64")])
        order = np.argsort(gram, kind="stable")
        mark = np.repeat(np.arange(len(marks)), sizes)[order]
        value = np.repeat(1 / np.sqrt(np.maximum(1, sizes)), sizes)[order]
        every, first = np.unique(gram[order], return_index=True)
        number = np.diff(np.r_[first, len(gram)])
        for i, s in enumerate(sets):
            at = np.minimum(np.searchsorted(every, s[n]), max(0, len(every) - 1))
            at = at[every[at] == s[n]] if len(every) else at[:0]
            many = number[at]
            each = np.repeat(first[at] - np.cumsum(many) + many, many) + np.arange(many.sum())
            kernel[i] += np.bincount(mark[each], value[each], len(marks)) / (SPECTRUM * np.sqrt(max(1, len(s[n]))))
        triples.append((every, first, mark, value))
    target = np.where(np.array(labels)[:, None] == np.array(languages)[None], 1.0, -1.0) if texts else np.zeros((0, 0))
    among = kernel[marks]
    normal = kernel.T @ kernel + ridge * len(texts) * (among + among.T) / 2 + 1e-9 * np.eye(len(marks))
    solved = np.linalg.lstsq(normal, kernel.T @ target, rcond=None)[0]
    weights = [np.stack([np.add.reduceat(v * solved[m, k], f) if len(f) else np.zeros(0) for k in range(len(languages))], axis=1) if languages else np.zeros((0, 0)) for _, f, m, v in triples]
    return KernelModel(languages, [t[0] for t in triples], weights)


def remainder(id_column: str, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``; a row without an id has none, which is -1 here and held out of nothing."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % by, F.lit(-1))


def train(documents: DataFrame, per_language: int = PER_LANGUAGE, most_chars: int = MOST_CHARS) -> KernelModel:
    """Fits on at most ``per_language`` different texts of each language, those with the smallest hashes of id and text
    among rows whose remainder by 5 is not 0 and whose text has LEAST_CHARS to ``most_chars`` characters. Ids may be
    null or all the same: a language with such rows always has texts.

    With many languages each has fewer texts, MOST_TEXTS in all; of more than MOST_LANGUAGES those with the most rows
    are learned, so what the driver holds is bounded whatever ``lang`` holds. ``least`` is SLACK times the smallest share
    of known n-grams that one of these texts has, ``least_score`` is SCORE_SLACK under the lowest best score."""
    rows = documents.where((remainder("doc_id", 5) != 0) & F.col("lang").isNotNull() & F.length("text").between(LEAST_CHARS, most_chars))
    # shares are of different rows: a third of the table that is one row counts as one
    different = F.approx_count_distinct(F.xxhash64("doc_id", "text"), 0.02).alias("n")
    tallies = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"), different).orderBy(F.desc("rows"), "lang").limit(MOST_LANGUAGES)
    counts = {r["lang"]: r["n"] for r in tallies.collect()}
    if not counts:
        return KernelModel([], [np.empty(0, "int64")] * SPECTRUM, [np.zeros((0, 0))] * SPECTRUM)
    per_language = min(per_language, MOST_TEXTS // len(counts))
    unit = F.pmod(F.xxhash64("doc_id", "text"), F.lit(2**30)) / F.lit(float(2**30))
    share = F.lit(0.0)
    for language, n in counts.items():
        share = F.when(F.col("lang") == language, F.lit(min(1.0, (1.5 * per_language + 30) / max(1, n)))).otherwise(share)
    few = rows.where(unit < share).select("lang", "text", unit.alias("u"), F.xxhash64("text").alias("h")).dropDuplicates(["lang", "h"])
    picked = few.orderBy("u", "h").limit(2 * (per_language + 30) * len(counts)).collect()
    seen: dict[str, int] = {}
    kept = []
    for r in picked:
        if seen.setdefault(r["lang"], 0) < per_language:
            seen[r["lang"]] += 1
            kept.append(r)
    texts = [r["text"] for r in kept]
    model = fit(texts, [r["lang"] for r in kept], max(1, min(LANDMARKS, MOST_LANDMARKS // len(counts))))
    judged = [model.judge(texts[i : i + AT_ONCE]) for i in range(0, len(texts), AT_ONCE)]
    if judged:
        model.least = SLACK * float(min(known.min() for _, known in judged))
        model.least_score = float(min(score.max(axis=1).min() for score, _ in judged)) - SCORE_SLACK
    return model


def _has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


def _judged(model: KernelModel, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text the best language (``und`` without a letter or a model), its score from 0 to 1, the known share, and
    the regression value of the best language."""
    pred, score, known, raw = np.full(len(texts), "und", object), np.zeros(len(texts)), np.zeros(len(texts)), np.full(len(texts), -np.inf)
    at = np.array([k for k, t in enumerate(texts) if _has_letter(t)], "int64")
    if model.languages and len(at):
        f, share = model.judge([texts[k] for k in at])
        best = f.argmax(axis=1)
        pred[at], known[at], raw[at] = np.array(model.languages, object)[best], share, f[np.arange(len(at)), best]
        score[at] = np.clip((raw[at] + 1) / 2, 0, 1)
    return pred, score, known, raw


def identify(documents: DataFrame, model: KernelModel | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document, from its whole text alone; no shuffle.

    The score is the regression value of the best language, brought from -1..1 to 0..1. A null text, or one with no
    letter, is ``und`` with score 0, as is everything when there is nothing to learn from. Null and repeated ids are
    kept; equal texts have equal predictions; other columns are ignored. Only texts go to Python.
    """
    small_batches(documents.sparkSession)
    model = train(documents) if model is None else model

    def made() -> Callable:
        def convert(texts: list) -> pa.Array:
            pred, score, _, _ = _judged(model, texts)
            return structs(lang_pred=pa.array(pred, pa.string()), score=pa.array(score, pa.float64()))

        return convert

    found = per_text("struct<lang_pred:string,score:double>", made)(F.col("text").cast("string")).alias("p")
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder("doc_id", 5) == 0).alias("held_out"), found).select("doc_id", "held_out", "p.lang_pred", "p.score")


def keep_identified(documents: DataFrame, languages: list[str] | None = None, least: float | None = None) -> DataFrame:
    """``documents`` in a learned language, with all their columns, of which only the text goes to Python.

    Dropped are texts without a letter, those predicted to be in none of ``languages`` (None: any that was learned),
    those whose best kernel score is under the model's ``least_score``, such as letters in no order of any language, and
    those of whose n-grams landmarks have a smaller share than ``least`` (None: the model's own bound), such as texts in
    a script that was never learned. The score decides on texts of LEAST_CHARS characters or more, as those it is fitted
    on. Where no label is known, nothing can be told and every text with a letter stays.
    """
    small_batches(documents.sparkSession)
    model = train(documents)
    bound = model.least if least is None else least

    def made() -> Callable:
        def convert(texts: list) -> pa.Array:
            if not model.languages:
                return pa.array([_has_letter(t) for t in texts], pa.bool_())
            pred, _, known, raw = _judged(model, texts)
            short = np.array([t is None or len(t) < LEAST_CHARS for t in texts])
            keep = (pred != "und") & (known >= bound) & (short | (raw >= model.least_score))
            if languages is not None:
                keep &= np.isin(pred, languages)
            return pa.array(keep.astype(bool), pa.bool_())

        return convert

    return documents.where(per_text("boolean", made)(F.col("text").cast("string")))
