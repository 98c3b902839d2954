"""Quality scores by positive-unlabelled learning with a non-negative unbiased risk."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.arrow import per_text
from weftgraph.llm.langid import remainder
from weftgraph.session import small_batches

#: The bounded sample that the driver fits on: positives and unlabelled texts at most. Only their features reach it.
POSITIVES, UNLABELLED = 4000, 8000
#: Bounds of the prior that is estimated, and what is taken without a positive or an unlabelled text.
LEAST_PRIOR, MOST_PRIOR, NO_PRIOR = 0.02, 0.98, 0.5
#: Bins of each feature, steps of Adam, its rate, and the penalty on squared weights.
BINS, STEPS, RATE, PENALTY = 10, 2000, 0.03, 1e-4
_PUNCTUATION = b"!#$%&*+,-./:;<=>?@[\\]^_`{|}~\"'()"


def features(text: str | None) -> np.ndarray:
    """What a text's bytes, words and lines look like; no word is looked up, so no language is favoured."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    count = np.bincount(np.frombuffer(raw, "uint8"), minlength=256).astype("float64")
    n = max(1.0, count.sum())
    upper, lower, digit = count[65:91].sum(), count[97:123].sum(), count[48:58].sum()
    wide, space, lines = count[192:].sum(), count[32] + count[9], count[10]
    marks = count[list(_PUNCTUATION)]
    words = raw.split()
    k = max(1, len(words))
    distinct = len(set(words))
    rows = [x for x in raw.split(b"\n") if x]
    shout = sum(map(bytes.isupper, words))
    bare = sum(map(bytes.isalpha, words))
    twice = sum(map(bytes.__eq__, words, words[1:]))
    odd = marks.sum() - count[44] - count[46]
    letters = max(1.0, upper + lower + wide)
    return np.array([
        np.log1p(n), np.log1p(len(words)), upper / letters, digit / n, wide / n, space / n, lines / n, odd / n,
        count[33] / n, count[124] / n, count[[35, 36, 37, 38, 42]].sum() / n, count[44] / n, count[46] / n,
        count[[60, 62, 47, 61]].sum() / n, marks.max() / n, len(raw) / k, distinct / k, np.log1p(k) - np.log1p(distinct),
        len(set(rows)) / max(1, len(rows)), np.log1p(len(rows)), shout / k, bare / k, twice / k, count[:32].sum() / n,
        max(map(len, rows), default=0) / n, np.log1p(max(map(len, words), default=0)), count.max() / n,
        count[[64, 95, 123, 125]].sum() / n])


@dataclass
class QualityModel:
    """Edges of each feature's bins, one weight for each bin, and a bias; the score is the sigmoid of their sum."""

    edges: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for k, edges in enumerate(self.edges):
            total += self.weights[k, np.searchsorted(edges, x[:, k], side="left")]
        return _sigmoid(total)


def _binned(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """One bit for each feature's bin, and a last column of ones."""
    out = np.zeros((len(x), len(edges) * BINS + 1))
    for k, own in enumerate(edges):
        out[np.arange(len(x)), k * BINS + np.searchsorted(own, x[:, k], side="left")] = 1
    out[:, -1] = 1
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def risk(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, float]:
    """prior * E_p[l(f)], and E_u[l(-f)] - prior * E_p[l(-f)], with f = x @ w and the logistic loss l."""
    loss = lambda z: np.logaddexp(0, -z)
    fp, fu = p @ w, u @ w
    return prior * loss(fp).mean(), loss(-fu).mean() - prior * loss(-fp).mean()


def slopes(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """The gradients of both parts of the risk."""
    fp, fu = p @ w, u @ w
    return -prior * (p.T @ _sigmoid(-fp)) / len(p), u.T @ _sigmoid(fu) / len(u) - prior * (p.T @ _sigmoid(fp)) / len(p)


def fit_non_negative(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = STEPS, rate: float = RATE, penalty: float = PENALTY) -> QualityModel:
    """Minimises prior * E_p[l(f)] + max(0, E_u[l(-f)] - prior * E_p[l(-f)]) by Adam.

    Where the estimated risk of negatives falls under 0, the step goes up its slope instead, which undoes overfitting.
    """
    every = np.concatenate([unlabelled, positive])
    edges = np.array([np.quantile(np.unique(every[:, k]), np.linspace(0, 1, BINS + 1)[1:-1]) for k in range(every.shape[1])])
    p, u = _binned(positive, edges), _binned(unlabelled, edges)
    w = np.zeros(p.shape[1])
    first, second = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        slope_p, slope_n = slopes(w, p, u, prior)
        slope = slope_p + slope_n if risk(w, p, u, prior)[1] >= 0 else -slope_n
        slope = slope + penalty * np.r_[w[:-1], 0]
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        w = w - rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return QualityModel(edges, w[:-1].reshape(-1, BINS), float(w[-1]))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, folds: int = 4, turns: int = 2, steps: int = 300, penalty: float = 1e-3) -> float:
    """The share of positives among unlabelled texts, from these two samples alone.

    Classifiers score the fold of both samples that they were not fitted on. Over every threshold c, the share of
    unlabelled texts at or over c is at least prior times that of positives, so the prior is at most their ratio. The
    least ratio, each raised by what sampling may hide, is the lower envelope of the two distributions and is taken as
    the prior; the next turn's classifiers are fitted with it, and the smaller estimate stays.
    """
    if min(len(positive), len(unlabelled)) < 2 * folds:
        return NO_PRIOR
    prior = NO_PRIOR
    found = []
    for _ in range(turns):
        scores: tuple[list, list] = ([], [])
        for k in range(folds):
            own = [np.arange(len(x)) % folds == k for x in (positive, unlabelled)]
            model = fit_non_negative(positive[~own[0]], unlabelled[~own[1]], prior, steps, RATE, penalty)
            scores[0].append(model.score(positive[own[0]]))
            scores[1].append(model.score(unlabelled[own[1]]))
        p, u = (np.sort(np.concatenate(s)) for s in scores)
        cuts = np.unique(p)
        over_p, over_u = 1 - np.searchsorted(p, cuts) / len(p), 1 - np.searchsorted(u, cuts) / len(u)
        slack = 2 / np.sqrt(len(u)) + 2 / np.sqrt(len(p))  # where few positives are left the raised ratio is no guide
        at = np.argmin((over_u + slack) / over_p)
        prior = float(np.clip(over_u[at] / over_p[at], LEAST_PRIOR, MOST_PRIOR))
        found.append(prior)
    return min(found)


def train(documents: DataFrame, labels: DataFrame) -> QualityModel:
    """Labels and texts of rows whose remainder by 4 is 2 are never looked at, nor is any label but 1.

    Positives are label-1 texts, the unlabelled are any texts, each by the smallest hashes: a bounded sample, of which
    the workers make the features from whole texts. Without positives, or without any text, every score is NO_PRIOR.
    """
    known = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull() & (remainder("doc_id", 4) != 2)).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    usable = documents.where((remainder("doc_id", 4) != 2) & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    unit = F.pmod(F.xxhash64("doc_id", "text", F.lit(5)), F.lit(2**30)) / F.lit(float(2**30))  # ids alone may be null or all the same
    total, ones = usable.count(), known.count()
    share = lambda most, n: F.lit(min(1.0, (1.2 * most + 50) / max(1, n)))
    crowd = _sampled(usable.where(unit < share(UNLABELLED, total)), unit, UNLABELLED)
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(2**30)) / F.lit(float(2**30)) < share(1.5 * POSITIVES, ones))
    trusted = usable.join(F.broadcast(chosen.orderBy(F.xxhash64("doc_id", F.lit(9))).limit(2 * POSITIVES)), "doc_id", "left_semi")
    trusted = _sampled(trusted, F.xxhash64("text"), POSITIVES)
    if not len(trusted) or not len(crowd):
        k = len(features(""))
        return QualityModel(np.zeros((k, BINS - 1)), np.zeros((k, BINS)), float(np.log(NO_PRIOR / (1 - NO_PRIOR))))
    return fit_non_negative(trusted, crowd, estimate_prior(trusted, crowd))


def _features(text: Column) -> Column:
    def made() -> Callable:
        return lambda texts: pa.array([features(t).tolist() for t in texts], pa.list_(pa.float64()))

    return per_text("array<double>", made)(text)


def _sampled(rows: DataFrame, by: Column, most: int) -> np.ndarray:
    """Features of the ``most`` rows with the smallest ``by``, in an order that depends on the texts alone."""
    found = rows.select(by.alias("b"), F.xxhash64("text").alias("h"), _features(F.col("text")).alias("f")).orderBy("b", "h").limit(most).collect()
    return np.array([r["f"] for r in found]).reshape(len(found), len(features("")))


def score_quality(documents: DataFrame, labels: DataFrame, least: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted (1 if score >= ``least``) for every document, from its whole text alone.

    Null texts score as empty ones. Without positive labels, or where no positive has a text, every score is 0.5. Null
    and repeated ids are kept; equal texts have equal scores; other columns are ignored. No shuffle but for the bounded
    training sample; only texts go to Python.
    """
    small_batches(documents.sparkSession)
    model = train(documents, labels)

    def made() -> Callable:
        return lambda texts: pa.array(model.score(np.array([features(t) for t in texts]).reshape(len(texts), -1)) if texts else [], pa.float64())

    scored = documents.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder("doc_id", 4) == 2).alias("held_out"), per_text("double", made)(F.col("text").cast("string")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= least).cast("int"))
