import zlib

import pytest

from weftgraph.llm import langid

SF = "/root/testdata/sf0.01"


def test_spectrum_is_the_set_of_n_grams():
    for text in ("", "a", "ab", "aba", "ÄbÄ b", "x" * 50, "日本語テキスト日本"):
        low = text.lower()
        for n, got in enumerate(langid.spectrum(text), 1):
            assert len(got) == len({low[i : i + n] for i in range(len(low) - n + 1)})


def test_folded_scores_equal_the_kernel():
    texts = ["the cat and the dog", "der hund und die katze", "a cat or dog", "ein hund oder eine katze", "le chat et le chien"]
    labels = ["en", "de", "en", "de", "fr"]
    model = langid.fit(texts, labels, landmarks=9)
    import numpy as np

    def kernel(x, z):
        parts = [(set(a), set(b)) for a, b in zip(map(list, langid.spectrum(x)), map(list, langid.spectrum(z)))]
        return sum(len(a & b) / np.sqrt(max(1, len(a)) * max(1, len(b))) for a, b in parts) / 3

    marks = [i for lang in model.languages for i in range(5) if labels[i] == lang]
    k = np.array([[kernel(x, texts[m]) for m in marks] for x in texts])
    y = np.where(np.array(labels)[:, None] == np.array(model.languages)[None], 1.0, -1.0)
    among = k[marks]
    w = np.linalg.lstsq(k.T @ k + langid.RIDGE * 5 * among + 1e-9 * np.eye(5), k.T @ y, rcond=None)[0]
    assert np.allclose(model.scores(texts), k @ w, atol=1e-6)


def test_held_out_accuracy(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: r for r in langid.identify(documents).collect()}
    truth = {r["doc_id"]: r["lang"] for r in documents.select("doc_id", "lang").collect()}
    assert got.keys() == truth.keys()
    held = [d for d in truth if zlib.crc32(str(d).encode()) % 5 == 0]
    assert {d for d, r in got.items() if r["held_out"]} == set(held)
    assert sum(got[d]["lang_pred"] == truth[d] for d in held) / len(held) > 0.96
    assert all(0 <= r["score"] <= 1 for r in got.values())


@pytest.fixture
def odd(spark, prose):
    rows = [(None, None, None), (1, None, "en"), (2, "", "en"), (3, "123 !?\n", None), (4, "x", None), (4, "x", None)]
    rows += [(i, prose(40, i) if i % 2 else "ñandú leía " * 20, "en" if i % 2 else "es") for i in range(10, 40)] + [(99, prose(30_000, 1), None)]
    return spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")


def test_odd_rows(odd):
    got = langid.identify(odd).collect()
    assert len(got) == odd.count()
    und = [r["doc_id"] for r in got if r["lang_pred"] == "und"]
    assert sorted(und, key=str) == [1, 2, 3, None]
    assert {r["lang_pred"] for r in got if r["doc_id"] == 99} == {"en"}
    kept = langid.keep_identified(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 6  # x is in no learned text


def test_rejects_by_language(odd, spark):
    """What was never learned goes, and what is predicted decides."""
    strange = spark.createDataFrame([(200, "日本語の文章です。これは長い文です", "ja", 0.5), (201, "Это русский текст", None, 0.5), (202, "ñandú leía leía ñandú", None, 0.5)], odd.schema)
    docs = odd.unionByName(strange).where("lang is null or lang <> 'ja'").unionByName(strange.where("doc_id = 200").selectExpr("doc_id", "text", "cast(null as string) lang", "score"))
    ids = lambda rows: {r["doc_id"] for r in rows.collect()}
    kept = ids(langid.keep_identified(docs))
    assert 202 in kept and not kept & {200, 201}
    predicted = {r["doc_id"] for r in langid.identify(docs).where("lang_pred = 'es'").collect()}
    assert ids(langid.keep_identified(docs, ["es"])) == predicted & kept and {202, 10} <= predicted and 11 not in predicted
    assert ids(langid.keep_identified(docs, least=0.0)) >= {200, 201, 202}
    unlabelled = odd.selectExpr("doc_id", "text", "cast(null as string) lang", "score")
    assert langid.keep_identified(unlabelled).count() == odd.count() - 4


def test_many_languages_are_bounded(spark, prose, monkeypatch):
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 3)
    monkeypatch.setattr(langid, "MOST_LANDMARKS", 30)
    docs = spark.createDataFrame([(i, prose(30, i), f"l{i % 9}") for i in range(200)] + [(300 + i, prose(30, i), "l0") for i in range(20)], "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert len(model.languages) == 3 and "l0" in model.languages


def test_nothing_to_learn_and_empty(odd):
    assert {r["lang_pred"] for r in langid.identify(odd.where("lang is null")).collect()} == {"und"}
    assert langid.identify(odd.limit(0)).count() == 0


@pytest.mark.parametrize("doc_id", [None, 3, 7])
def test_ids_that_tell_nothing_apart(spark, doc_id):
    """All ids null or equal: the languages are learned all the same, and one row that is a third of the table takes no place."""
    documents = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("cast(null as bigint) doc_id" if doc_id is None else f"{doc_id}L doc_id", "text", "lang")
    more = documents.limit(1).crossJoin(spark.range(500)).drop("id")
    model = langid.train(documents.unionByName(more))
    assert set(model.languages) == {r["lang"] for r in documents.select("lang").distinct().collect()}
    got = langid.identify(documents.withColumn("truth", documents["lang"]), model)
    assert got.where("lang_pred = 'und'").count() < 20


def test_letters_in_no_language_go_by_their_score(spark):
    """They have letters and n-grams that landmarks know, and are rejected by the kernel's score alone."""
    from weftgraph.llm.langid import KernelModel

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    model: KernelModel = langid.train(docs)
    strange = "asdkjh qweoiu zxmcnb poiqwe lkjhg mnbvc trewq"
    score, known = model.judge([strange])
    assert known[0] >= model.least and score.max() < model.least_score
    both = docs.unionByName(spark.createDataFrame([(10**9, strange, None)], docs.schema))
    kept = {r["doc_id"] for r in langid.keep_identified(both).collect()}
    assert 10**9 not in kept
    every = {r["doc_id"] for r in docs.collect() if r["text"] and any(c.isalpha() for c in r["text"])}
    assert len(every - kept) <= 0.002 * len(every)


def test_pieces_of_a_long_text_add_up(monkeypatch):
    model = langid.fit(["the cat and the dog", "der hund und die katze"], ["en", "de"], landmarks=2)
    texts = ["a dog and a cat " * 30, "", "katze"]
    whole = model.judge(texts)
    monkeypatch.setattr(langid, "HITS", 3)
    for a, b in zip(whole, model.judge(texts), strict=True):
        assert abs(a - b).max() < 1e-12
