import hashlib
import math
from collections import Counter

from pyspark.sql import functions as F

from weftgraph.llm import mixing
from weftgraph.llm.mixing import mix_rows, poisson_copies, poisson_sums, replicate


def uniform(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:13], 16)


def poisson(rate, u):
    k, term = 0, math.exp(-rate)
    cdf = term
    while cdf <= u:
        k += 1
        term *= rate / k
        cdf += term
    return k


def test_matches_brute_force(spark):
    rows = [(i, "hot" if i % 3 else f"s{i % 7}") for i in range(600)] + [(None, None), (None, "s1"), (3, ""), (3, "")]
    table = spark.createDataFrame([(d, s, f"text {d}", 1, 2) for d, s in rows], "doc_id long, source string, text string, copy int, _mx_n int")
    got = replicate(table, seed=0)
    assert got.columns == ["doc_id", "source", "text", "_mx_n", "n_copies", "copy", "mix_key", "rate"]
    plain = mix_rows(table, seed=0)
    assert plain.columns == table.columns and plain.count() == got.count() and plain.first()["copy"] == 1
    counts = Counter(s for _, s in rows)
    weights = {s: math.sqrt(n) for s, n in counts.items()}
    want, places = Counter(), Counter()
    for d, s in rows:
        rate = len(rows) * (weights[s] / sum(weights.values())) / counts[s]
        name = f"{'' if d is None else d}:{hashlib.md5(f'text {d}'.encode()).hexdigest()}:{places[d, s]}"
        places[d, s] += 1
        for c in range(poisson(rate, uniform(f"0:u:{name}") / 2**52)):
            want[d, s, c, uniform(f"0:k:{name}:{c}")] += 1
    found = got.collect()
    assert Counter((r["doc_id"], r["source"], r["copy"], r["mix_key"]) for r in found) == want


def test_global_order(spark):
    keys = [r["mix_key"] for r in replicate(spark.range(500).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"))).collect()]
    assert keys == sorted(keys)


def test_weights_total_and_high_rates(spark):
    table = spark.createDataFrame([(i, "a" if i < 5 else "b") for i in range(1000)], "doc_id long, source string")
    got = replicate(table, weights={"a": 3.0, "b": 1.0}, total=8000).groupBy("source").count().collect()
    n = {r["source"]: r["count"] for r in got}
    assert abs(n["a"] - 6000) < 300 and abs(n["b"] - 2000) < 200  # rate 1200 is over most_rate
    assert replicate(table, weights={"c": 1.0}).count() == 0
    assert replicate(table.limit(0)).count() == 0


def test_inversion(spark):
    made = spark.range(400).select((F.col("id") % 20 / 2.0).alias("rate"), ((F.col("id") + 0.5) / 400).alias("u"))
    for r in made.select("rate", "u", poisson_copies(poisson_sums(F.col("rate")), F.col("u")).alias("k")).collect():
        assert r["k"] == poisson(r["rate"], r["u"])


def test_rows_of_one_id_and_equal_rows_draw_numbers_of_their_own(spark, monkeypatch):
    """A third of the rows have no id, a third are equal: their copies are spread over all partitions, in Poisson numbers."""
    monkeypatch.setattr(mixing, "BLOCK", 100)
    rows = [(i, f"text {i}", "a") for i in range(2000)] + [(None, f"other {i}", "a") for i in range(2000)] + [(7, "same", "a")] * 2000
    got = replicate(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    for part in ("doc_id is null", "text = 'same'"):
        own = got.where(part)
        by_part = [r["count"] for r in own.groupBy(F.spark_partition_id()).count().collect()]
        assert len(by_part) == 4 and max(by_part) < 1.3 * min(by_part)
        assert abs(own.count() - 2000) < 200
        drawn = Counter(r["n_copies"] for r in own.where("copy = 0").collect())
        assert abs(drawn[1] - 2000 * math.exp(-1)) < 120 and abs(drawn[2] - 1000 * math.exp(-1)) < 90
        assert own.select("mix_key").distinct().count() == own.count()


def test_query_mixes_whole_documents(spark, monkeypatch):
    """A cold source is replicated at a rate over 1: each of its long texts is written once for each copy."""
    rows = [(i, "hot" if i % 20 else "cold", f"text {i} " * (1 if i % 20 else 3000)) for i in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, source string, text string")
    written, stash = [], mixing.stash
    monkeypatch.setattr(mixing, "stash", lambda frame: written.append(stash(frame)) or written[-1])
    got = [tuple(r) for r in mixing.mix_query(table).collect()]
    whole = [frame for frame in written if "text" in frame.columns]
    assert len(whole) == 1
    texts = {d: t for d, _, t in rows}
    mixed = whole[0].collect()
    assert all(r["text"] == texts[r["doc_id"]] for r in mixed)
    assert Counter((r["doc_id"], r["source"], r["n_copies"], r["copy"], r["mix_key"]) for r in mixed) == Counter(r[:5] for r in got)
    assert [r[4] for r in got] == sorted(r[4] for r in got) and max(r[2] for r in got if r[1] == "cold") > 1
