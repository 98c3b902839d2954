import zlib

import numpy as np

from weftgraph.llm import quality

SF = "/root/testdata/sf0.1"


def test_held_out_labels(spark):
    documents, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = {r["doc_id"]: r for r in quality.score_quality(documents, labels).collect()}
    assert len(got) == documents.count()
    held = [(got[r["doc_id"]], r["quality"]) for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert all(r["held_out"] for r, _ in held)
    assert np.mean([r["predicted"] == q for r, q in held]) > 0.96
    assert all(r["predicted"] == (r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r, _ in held)


def test_risk_never_uses_negatives_and_learns_the_boundary():
    rng = np.random.default_rng(0)
    positive = rng.normal(1.5, 1, (2000, 3))
    crowd = np.concatenate([rng.normal(1.5, 1, (1200, 3)), rng.normal(-1.5, 1, (800, 3))])
    model = quality.fit_non_negative(positive, crowd, 0.6)
    assert model.score(rng.normal(1.5, 1, (500, 3))).mean() > 0.9
    assert model.score(rng.normal(-1.5, 1, (500, 3))).mean() < 0.2


def test_features_by_plain_counting(prose):
    for text in (prose(60, 1), "", "ÀÉ x!! x!!\n\nAB  {a}@b <c>/d=1\x01\tz", "a\na\nb"):
        raw, words = text.encode(), text.encode().split()
        n, k = max(1, len(raw)), max(1, len(words))
        share = lambda signs: sum(raw.count(c.encode()) for c in signs) / n  # noqa: B023, E731
        upper, lower, wide = (sum(a <= b <= z for b in raw) for a, z in ((65, 90), (97, 122), (192, 255)))
        marks = "!#$%&*+,-./:;<=>?@[\\]^_`{|}~\"'()"
        lines = [x for x in raw.split(b"\n") if x]
        want = [
            np.log1p(n), np.log1p(len(words)), upper / max(1, upper + lower + wide), share("0123456789"), wide / n, share(" \t"), share("\n"), share(marks) - share(",."), share("!"), share("|"), share("#$%&*"),
            share(","), share("."), share("<>/="), max(raw.count(c.encode()) for c in marks) / n, len(raw) / k, len(set(words)) / k, np.log1p(k) - np.log1p(len(set(words))), len(set(lines)) / max(1, len(lines)), np.log1p(len(lines)),
            sum(w.isupper() for w in words) / k, sum(w.isalpha() for w in words) / k, sum(a == b for a, b in zip(words, words[1:])) / k, sum(b < 32 for b in raw) / n, max(map(len, lines), default=0) / n,
            np.log1p(max(map(len, words), default=0)), max((raw.count(bytes([b])) for b in set(raw)), default=0) / n, share("@_{}")]
        assert np.allclose(quality.features(text), want)


def test_slopes_of_the_risk_and_scores():
    rng = np.random.default_rng(3)
    p, u, w, prior = rng.random((7, 5)), rng.random((11, 5)), rng.normal(size=5), 0.4
    loss = lambda z: np.log(1 + np.exp(-z))
    parts = lambda w: (prior * np.mean([loss(x @ w) for x in p]), np.mean([loss(-(x @ w)) for x in u]) - prior * np.mean([loss(-(x @ w)) for x in p]))
    assert np.allclose(quality.risk(w, p, u, prior), parts(w))
    for k, slope in enumerate(quality.slopes(w, p, u, prior)):
        assert np.allclose(slope, [(parts(w + d)[k] - parts(w - d)[k]) / 2e-6 for d in 1e-6 * np.eye(5)], atol=1e-6)
    model = quality.fit_non_negative(rng.normal(1, 1, (60, 2)), rng.normal(0, 1, (90, 2)), 0.4, steps=50)
    for x, got in zip(x := rng.normal(size=(20, 2)), model.score(x)):
        total = model.bias + sum(model.weights[k][sum(e < x[k] for e in model.edges[k])] for k in range(2))
        assert np.isclose(got, 1 / (1 + np.exp(-total)))


def test_prior_from_positives_and_unlabelled_alone():
    rng = np.random.default_rng(1)
    draw = lambda centre, n: rng.normal(centre, 1, (n, 3))
    for prior in (0.3, 0.7):
        found = quality.estimate_prior(draw(2, 1500), np.concatenate([draw(2, int(3000 * prior)), draw(-2, 3000 - int(3000 * prior))]))
        assert abs(found - prior) < 0.05
    assert quality.estimate_prior(draw(0, 3), draw(0, 3)) == quality.NO_PRIOR


def test_positives_without_texts_and_long_ones(spark, prose):
    documents = spark.createDataFrame([(i, prose(20, i)) for i in range(8)] + [(50, None)], "doc_id long, text string")
    far = spark.createDataFrame([(i, 1) for i in (500, 501, 502, 503, 50)], "doc_id long, quality int")
    got = quality.score_quality(documents, far).collect()
    assert len(got) == 9 and {(r["score"], r["predicted"]) for r in got} == {(0.5, 0)}
    long = spark.createDataFrame([(i, prose(6000, i)) for i in range(4)], "doc_id long, text string")
    own = spark.createDataFrame([(i, 1) for i in range(4)], "doc_id long, quality int")
    assert all(r["score"] is not None and r["predicted"] is not None for r in quality.score_quality(documents.unionByName(long), own).collect())


def test_odd_rows(spark, prose):
    rows = [(None, None), (1, ""), (1, ""), (2, "\x00\x01"), (3, prose(30_000, 2))] + [(i, prose(30, i)) for i in range(10, 40)]
    documents = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, 1 if i % 3 else 0) for i in range(10, 40)] + [(None, 1), (10, None), (10, 1), (77, 0)], "doc_id long, quality int")
    got = quality.score_quality(documents, labels).collect()
    assert len(got) == len(rows) and len({r["score"] for r in got if r["doc_id"] in (None, 1)}) == 1
    assert {r["score"] for r in quality.score_quality(documents, labels.limit(0)).collect()} == {0.5}
    assert quality.score_quality(documents.limit(0), labels).count() == 0
