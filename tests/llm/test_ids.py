"""Ids beyond 2 ** 53, beside a null one in the same batch, come back as they went."""

import pytest

from weftgraph.llm import langid, media, neardup, packing, quality, warc

IDS = [None, 2**53 + 1, 2**53 + 3, -(2**62) - 1, 7]


@pytest.fixture
def documents(spark, prose):
    return spark.createDataFrame([(d, prose(30, k), "en", "s") for k, d in enumerate(IDS)], "doc_id long, text string, lang string, source string").coalesce(1)


def found(rows, name="doc_id"):
    return sorted((r[name] for r in rows.select(name).collect()), key=str)


def test_ids_of_documents(spark, documents):
    import public_tokenizers

    labels = spark.createDataFrame([(d, 1) for d in IDS[1:]], "doc_id long, quality int")
    for rows in (
        langid.identify(documents), langid.keep_identified(documents), media.media_query(documents), quality.score_quality(documents, labels), neardup.near_duplicates(documents, 3, 85),
        neardup.keep_one(documents), packing.pack_documents(documents, public_tokenizers.path("word_bpe_49k.json")),
    ):
        assert found(rows) == sorted(IDS, key=str)
    pairs = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(documents, 3, 85).collect()}
    assert all(a == b for a, b in pairs.items())


def test_ids_of_pages(spark):
    big = "<p>" + "x" * 200
    pages = spark.createDataFrame([(d, f"http://a/{k}", big) for k, d in enumerate(IDS)], "page_id long, url string, html string").coalesce(1)
    rows = warc.archive_round_trip(pages)
    assert found(rows, "page_id") == sorted(IDS, key=str)
    assert {r["refers_to"] for r in rows.collect()} == {None, -(2**62) - 1}
