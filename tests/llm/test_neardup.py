import os
import random
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from weftgraph.llm import neardup
from weftgraph.llm.shingles import overlap, shingle_set
from weftgraph.session import stash


def words(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}


def brute(rows, n, percent):
    sets = [words(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    out = {}
    for i, (d, _) in enumerate(rows):
        out[d] = (len(sets[i]), min(rows[j][0] for j in range(len(rows)) if find(j) == find(i)))
    return out


def variants(rng, base, count, least, most):
    w = base.split()
    for _ in range(count):
        v = list(w)
        for _ in range(rng.randint(least, most)):
            v[rng.randrange(len(v))] = f"new{rng.randrange(10**6)}"
        yield " ".join(v)


def table(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, component_id string")


@pytest.mark.parametrize(("n", "percent", "block"), [(3, 85, 512), (3, 85, 8), (5, 80, 16)])
def test_matches_brute_force(spark, prose, monkeypatch, n, percent, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = random.Random(n * block)
    texts = [prose(rng.randint(1, 90), i) for i in range(60)]
    for k in range(4):  # crowds that hang together only in part
        texts += variants(rng, prose(100, 1000 + k), 45, 0, 9)
    texts += [texts[70]] * 40 + ["", "  \n", "one", "ONE", "one two", "One  Two", "é É", "a b c", "a b c a b c a b c"]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(table(spark, rows), n, percent).collect()}
    assert got == {d: (k, c, c == d) for d, (k, c) in brute(rows, n, percent).items()}


def test_hot_keys_and_crowds_round_one_leader(spark, prose, monkeypatch):
    """Every key with more than its share is hot, leaders meet a few members at a time: the same rows, and groups stay small."""
    monkeypatch.setattr(neardup, "TASK_ROWS", 0)
    monkeypatch.setattr(neardup, "LED", 5)
    grouped = neardup._like_leader

    def spied(steps):
        compare = grouped(steps)

        def run(group):
            if len(group) > 40:  # five on average
                raise ValueError(f"{len(group)} rows in a group")
            return compare(group)

        return run

    monkeypatch.setattr(neardup, "_like_leader", spied)
    rng = random.Random(11)
    texts = [prose(rng.randint(5, 60), i) for i in range(30)] + list(variants(rng, prose(3000, 77), 150, 0, 40)) + list(variants(rng, prose(120, 78), 60, 0, 12))
    rows = list(enumerate(texts))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(table(spark, rows), 5, 80).collect()}
    assert got == {d: (k, c, c == d) for d, (k, c) in brute(rows, 5, 80).items()}


def test_odd_rows(spark, prose):
    long = prose(20_000, 9)
    rows = [(None, "same text of some words"), (1, "same text of some words"), (1, "same text of some words"), (2, None), (3, None), (4, long), (5, long + " end"), (6, "same text of some words")]
    got = neardup.near_duplicates(table(spark, rows), 3, 85)
    assert sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in got.collect()) == sorted(
        [("None", "None", True), ("1", "1", True), ("1", "1", True), ("2", "2", True), ("3", "3", True), ("4", "4", True), ("5", "4", False), ("6", "1", False)])
    kept = neardup.keep_one(table(spark, rows), 3, 85)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "3", "4", "None"]
    assert kept.columns == ["doc_id", "text", "component_id"]
    assert neardup.near_duplicates(table(spark, []), 3, 85).count() == 0


def test_sequential_test_and_bands():
    assert (1 - 0.85**neardup.BAND) ** neardup.bands_for(0.85, 1e-6) <= 1e-6
    steps = neardup.least_matches(0.85, 1e-6, 125)
    assert [n for n, _ in steps] == [25, 50, 75, 100, 125] and all(m < 0.85 * n for n, m in steps)


def test_shingles():
    a, b = shingle_set("A b c d", 3), shingle_set("x a B c", 3)
    assert len(a) == 2 and overlap(a, b) == 1 and len(shingle_set(" ", 3)) == 0
    assert overlap(shingle_set("a b", 3), shingle_set("a  B", 3)) == 1 and overlap(shingle_set("b a", 3), shingle_set("a b", 3)) == 0


def test_lineage_is_in_shared_files(spark, prose):
    got = neardup.near_duplicates(table(spark, [(i, prose(20, i % 3)) for i in range(9)]), 3, 85)
    assert "LocalCheckpoint" not in got._jdf.queryExecution().toString() and got.agg(F.count_if("kept")).first()[0] == 3


def test_signatures_and_sets_go_when_read(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(neardup, "stash", lambda df: kept.append(stash(df)) or kept[-1])
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abcdefgh") * 3 + str(rng.randrange(40)) for _ in range(30))) for i in range(20)]
    rows += [(100 + i, t + " more") for i, (_, t) in enumerate(rows[:8])]
    got = neardup.near_duplicates(table(spark, rows), 3, 85)
    want = brute(rows, 3, 85)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == want
    wide = [df for df in kept if {"sig", "band", "shingles"} & set(df.columns)]
    assert len(wide) > 5 and not any(os.path.exists(urlparse(df._stashed).path) for df in wide)
