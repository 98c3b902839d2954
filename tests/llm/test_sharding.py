import zlib

from weftgraph.llm.sharding import prefix_shards, shard_documents

SCHEMA = "doc_id long, text string, shard string, _ps_size string"


def expected(rows, shards):
    """Sizes, and where the middle of each row's bytes falls."""
    sized = sorted(((-1 if d is None else d), len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), d) for d, t in rows)
    total, before, out = sum(s[1] for s in sized), 0, []
    for _, size, crc, d in sized:
        out.append((d, size, crc, min(shards - 1, (2 * before + size) * shards // (2 * total))))
        before += size
    return out


def test_matches_brute_force_with_nulls_ties_and_clashing_columns(spark, prose):
    rows = [(i * 7 % 300, prose(i % 50, i)) for i in range(300)] + [(None, "a"), (None, None), (5, None), (5, ""), (1000, "é" * 5000)]
    table = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA)
    got = shard_documents(table, 40).collect()
    assert len(got) == len(rows) and {r["law"] for r in got} == {"bytes"} and all(r["grown_shard"] is None for r in got)
    want = expected(rows, 40)
    assert sorted((r["size"], r["text_crc32"]) for r in got) == sorted(w[1:3] for w in want)
    plain = {d for d, _ in rows if d is not None and d != 5}
    assert {r["doc_id"]: r["shard"] for r in got if r["doc_id"] in plain} == {w[0]: w[3] for w in want if w[0] in plain}
    for shard in {r["shard"] for r in got}:
        own = sorted((r["slot"], -1 if r["doc_id"] is None else r["doc_id"]) for r in got if r["shard"] == shard)
        assert [s for s, _ in own] == list(range(len(own)))
        assert [d for _, d in own] == sorted(d for _, d in own)


def test_shards_are_contiguous_and_balanced(spark, prose):
    table = spark.createDataFrame([(i, prose(30 + i % 20, i)) for i in range(2000)], "doc_id long, text string")
    got = shard_documents(table, 10).toPandas()
    sums = got.groupby("shard")["size"].sum()
    assert list(sums.index) == list(range(10))
    assert (sums - got["size"].sum() / 10).abs().max() <= got["size"].max()
    spans = got.groupby("shard")["doc_id"].agg(["min", "max"])
    assert (spans["min"].to_numpy()[1:] > spans["max"].to_numpy()[:-1]).all()


def test_empty_and_sizeless(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert shard_documents(empty).count() == 0
    rows = spark.createDataFrame([(i, None) for i in range(8)], "k long, s long")
    assert sorted(r["shard"] for r in prefix_shards(rows, "k", "s", 4).collect()) == [0, 0, 1, 1, 2, 2, 3, 3]
