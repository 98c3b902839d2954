from collections import Counter

import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"


def test_stages_agree_with_their_input(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    docs, columns = documents, documents.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = corpus_pipeline.stash(stage(spark, docs, SF))
        if k < 4:
            assert docs.columns == columns, name
        if name == "language_id":
            letters = {r["doc_id"] for r in before.collect() if r["text"] and any(c.isalpha() for c in r["text"])}
            assert {r["doc_id"] for r in docs.collect()} == letters
        elif name == "minhash_dedup":
            assert kept_ids(docs) == one_of_each(before.collect())
        elif name == "secret_redaction":
            assert kept_ids(docs) == kept_ids(before)
            found = __import__("weftgraph.llm.secrets", fromlist=["x"]).secret_query(docs).collect()
            assert not any(r["n_access"] or r["n_hex"] for r in found)
        elif name == "source_mixing":
            known = {r["doc_id"]: r["text"] for r in before.collect()}
            assert all(known[r["doc_id"]] == r["text"] for r in docs.collect())
            mixed = docs.collect()
        else:
            tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            want = Counter()
            for r in mixed:
                want[r["doc_id"]] += len(tokenizer.encode(r["text"], add_special_tokens=False).ids) + 1
            got = Counter()
            for r in docs.collect():
                got[r["doc_id"]] += r["length"]
            assert got == want


def kept_ids(docs):
    return {r["doc_id"] for r in docs.select("doc_id").collect()}


def one_of_each(rows):
    def shingles(text):
        w = text.encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}

    sets = {r["doc_id"]: shingles(r["text"]) for r in rows}
    ids, root = sorted(sets), {}
    for i in ids:
        root[i] = i
    find = lambda x: x if root[x] == x else find(root[x])
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i for i in ids if find(i) == i}


def test_registered():
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    names = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, spans int, copy int, held_out string, id long, digest string"


def test_odd_rows_in_every_stage(spark, prose, tmp_path):
    rows = [(i, prose(30, i), "en", "s1", 5) for i in range(30)] + [(100 + i, prose(60, 77) + f" {i}", "en", "s2", None) for i in range(6)]
    rows += [(None, None, None, None, None), (200, None, "en", "s1", 0), (201, "", None, None, 0), (202, "12 34", "en", "s1", 5), (0, prose(30, 0), "en", "s1", 5), (0, prose(30, 0), "en", "s1", 5)]
    rows += [(None, prose(25, 500), "en", None, 1), (203, prose(15_000, 9), None, "s3", 9), (204, "password = hunter2hunter2 " + prose(20, 3), "en", "s1", 3)]
    spark.createDataFrame([(*r, "x", 1, 2, "y", 3, "z") for r in rows], SCHEMA).write.parquet(f"file://{tmp_path}/documents.parquet")
    docs = documents = spark.read.parquet(f"file://{tmp_path}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = corpus_pipeline.stash(stage(spark, docs, str(tmp_path)))
        assert docs.columns == documents.columns, name
        assert {(r["score"], r["spans"], r["copy"], r["held_out"], r["id"], r["digest"]) for r in docs.collect()} == {("x", 1, 2, "y", 3, "z")}
        seen.append(docs.toPandas())
    assert len(seen[0]) == len(rows) - 4
    assert sorted(seen[1]["doc_id"].dropna()) == [*range(30), 100, 203, 204] and len(seen[1]) == 34
    assert "[secret]" in seen[2].set_index("doc_id").loc[204, "text"] and len(seen[2]) == 34
    assert corpus_pipeline.STAGES[4][1](spark, docs, str(tmp_path)).count() >= len(seen[3]) > 10


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"file://{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
