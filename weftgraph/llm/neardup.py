"""Near-duplicate documents: banded minhash, sequential Bayesian pruning, exact verification."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.arrow import per_text, structs
from weftgraph.llm.shingles import overlap, permutations, shingle_set, signature
from weftgraph.operators.bitmaps import split, thin
from weftgraph.operators.components import connected_components
from weftgraph.operators.skew import join_facts
from weftgraph.session import release, small_batches, staged, stash

#: Hashes in a band and in a batch of the sequential test; documents in a block of a crowded bucket,
#: and further leaders that a bucket over one block is compared with first.
BAND, BATCH, BLOCK, LEADERS = 5, 25, 256, 3
#: Members that meet their leader at a time.
LED = 256
#: Rows of a bucket, or of a set, that one task can take: only larger ones are hot.
TASK_ROWS = 100_000


def bands_for(similarity: float, miss: float, band: int = BAND) -> int:
    """Bands after which a pair of this similarity shares none with probability ``miss`` at most."""
    return math.ceil(math.log(miss) / math.log(1 - similarity**band))


def least_matches(similarity: float, miss: float, hashes: int, batch: int = BATCH) -> list[tuple[int, int]]:
    """(n, m): after n hashes, a pair with under m matches has posterior probability under ``miss`` of being similar.

    With a uniform prior the similarity after m matches of n is Beta(m + 1, n - m + 1); its upper tail is a binomial sum.
    """
    out = []
    for n in [*range(batch, hashes, batch), hashes]:
        tail, m = 0.0, -1
        while tail < miss:
            m += 1
            tail += math.comb(n + 1, m) * similarity**m * (1 - similarity) ** (n + 1 - m)
        out.append((n, m))
    return out


def survives(a: np.ndarray, b: np.ndarray, steps: list[tuple[int, int]]) -> np.ndarray:
    """Which rows of two signature matrices pass every step; each step looks only at the rows still alive."""
    alive, matches, start = np.arange(len(a)), np.zeros(len(a), "int64"), 0
    for n, least in steps:
        matches[alive] += (a[alive, start:n] == b[alive, start:n]).sum(axis=1)
        alive, start = alive[matches[alive] >= least], n
        if not len(alive):
            break
    keep = np.zeros(len(a), bool)
    keep[alive] = True
    return keep


def _sketch(words: int, hashes: int) -> Callable:
    def made() -> Callable:
        flips, factors = permutations(hashes)

        def convert(texts: list) -> pa.Array:
            sets = [shingle_set(t, words) for t in texts]
            signatures = [signature(s, flips, factors).tobytes() for s in sets]
            return structs(n_shingles=pa.array(map(len, sets), pa.int64()), digest=pa.array([hashlib.md5(s).digest() for s in sets], pa.binary()), sig=pa.array(signatures, pa.binary()))

        return convert

    return made


def _bands(count: int) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        factors = permutations(BAND, 2)[1]
        for batch in batches:
            if not len(batch):
                continue
            sigs = np.frombuffer(b"".join(batch["sig"]), "<u2").reshape(len(batch), -1).astype("uint64")
            keys = np.zeros((len(batch), count), "uint64")
            for k in range(BAND):  # a polynomial in each band's values, started with its number
                keys = (keys ^ (keys >> np.uint64(29))) * factors[k] + sigs[:, k : count * BAND : BAND] + np.arange(count, dtype="uint64")[None, :] * factors[0]
            keys ^= keys >> np.uint64(32)
            yield pd.DataFrame({"key": keys.view("int64").ravel(), "id": np.repeat(batch["id"].to_numpy("int64"), count), "band": np.tile(np.arange(count, dtype="int16"), len(batch))})

    return run


def _grouped(compare: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable:
    """Rows come sorted by (key, low, high): ``compare`` gets one such group, a block or two, after the other."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            if not len(rows):
                continue
            names = rows[["key", "low", "high"]].to_numpy()
            cuts = [0, *(np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1).tolist(), len(rows)]
            for start, end in zip(cuts[:-2], cuts[1:]):
                yield compare(rows.iloc[start:end])
            held = rows.iloc[cuts[-2] :]
        if held is not None:
            yield compare(held)

    return run


def _hopeful(steps: list[tuple[int, int]]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The rows of a group that have a partner: of another component, past the test, and meeting in no earlier band."""

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        comps, own, band = group["comp"].to_numpy(), group["block"].to_numpy(), int(group["band"].iloc[0])
        sigs = np.frombuffer(b"".join(group["sig"]), "<u2").reshape(len(group), -1)
        apart = comps[:, None] != comps[None]
        if group["low"].iloc[0] != group["high"].iloc[0]:
            apart &= own[:, None] != own[None]
        i, j = np.nonzero(np.triu(apart, 1))
        for k in range(band):
            if not len(i):
                break
            earlier = (sigs[i, k * BAND : (k + 1) * BAND] == sigs[j, k * BAND : (k + 1) * BAND]).all(axis=1)
            i, j = i[~earlier], j[~earlier]
        keep = np.zeros(len(group), bool)
        for start in range(0, len(i), 4096):
            a, b = i[start : start + 4096], j[start : start + 4096]
            fine = survives(sigs[a], sigs[b], steps)
            keep[a[fine]] = keep[b[fine]] = True
        return group.loc[keep, ["key", "low", "high", "id", "comp"]]

    return compare


def _linked_in_block(percent: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Edges that span the verified links of a group: whole sets are compared, no pair leaves."""

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        ids, comps = group["id"].to_numpy(), group["comp"].to_numpy()
        sets = [np.frombuffer(x, "uint64") for x in group["shingles"]]
        sizes = np.array([len(x) for x in sets])
        every, at = np.unique(np.concatenate(sets), return_inverse=True)
        row = np.repeat(np.arange(len(sets)), sizes)
        shared = np.bincount(at, minlength=len(every)) > 1
        place = np.cumsum(shared) - 1
        hit = shared[at]
        row, at = row[hit], place[at[hit]]
        order = np.argsort(at, kind="stable")
        row, at = row[order], at[order]
        both = np.zeros((len(sets), len(sets)), "float32")
        for start in range(0, int(shared.sum()), 4096):  # exact: counts stay far under 2 ** 24
            low, high = np.searchsorted(at, [start, start + 4096])
            has = np.zeros((len(sets), 4096), "float32")
            has[row[low:high], at[low:high] - start] = 1
            both += has @ has.T
        links = (100 * both >= percent * (sizes[:, None] + sizes[None] - both)) & (comps[:, None] != comps[None])
        i, j = np.nonzero(links)
        root = np.arange(len(sets))
        while len(i):
            before = root.copy()
            low = np.minimum(root[i], root[j])
            np.minimum.at(root, i, low)
            np.minimum.at(root, j, low)
            root = root[root]
            if (before == root).all():
                break
        moved = np.flatnonzero(root != np.arange(len(sets)))
        return pd.DataFrame({"src": ids[root[moved]], "dst": ids[moved]}, dtype="int64")

    return compare


def _like_leader(steps: list[tuple[int, int]]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The members of a group that pass the sequential test against its first row, the leader."""

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        sigs = np.frombuffer(b"".join(group["sig"]), "<u2").reshape(len(group), -1)
        keep = np.zeros(len(group), bool)
        if not group["member"].iloc[0]:
            keep[1:] = survives(np.broadcast_to(sigs[0], sigs[1:].shape), sigs[1:], steps)
        return group.loc[keep, ["key", "low", "high", "id"]]

    return compare


def _linked_to_leader(percent: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Links (src, dst) from a group's first row, the leader, to its members, by whole sets."""

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        lead, *members = (np.frombuffer(x, "uint64") for x in group["shingles"])
        keep = [False]
        for own in members:
            both = overlap(lead, own)
            keep.append(not group["member"].iloc[0] and 100 * both >= percent * (len(lead) + len(own) - both))
        found = group.loc[np.array(keep, bool), ["key", "id"]]
        return pd.DataFrame({"src": found["key"], "dst": found["id"]}, dtype="int64")

    return compare


def _sets(words: int) -> Callable:
    def convert(texts: list) -> pa.Array:
        sets = [shingle_set(t, words) for t in texts]
        return structs(digest=pa.array([hashlib.md5(s).digest() for s in sets], pa.binary()), shingles=pa.array([s.tobytes() for s in sets], pa.binary()))

    return lambda: convert


def near_duplicates(documents: DataFrame, words: int = 5, percent: int = 80, miss: float = 1e-6) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept.

    Documents link when 100 * |A & B| >= percent * |A | B| over their full sets of ``words``-word shingles. Documents
    with equal sets are one representative from the start. Representatives sharing a band of their signatures are
    candidates; ``bands_for`` makes the chance to share none ``miss`` at the threshold. In each bucket all are first
    compared with one leader, so that a crowd of copies costs its size; buckets whose members are then one component
    are settled, for no further link could change the result. In the others every pair of different components is
    compared, in blocks of BLOCK rows and where the pair first meets; what leaves a block are rows with a hope and, once
    their sets are there, edges that span the links, never pairs. Candidates pass the sequential test of
    ``least_matches``, and only survivors are verified, on their whole sets. These are made again from the texts of
    documents that share a bucket with another; a bitmap thins the others out, so most texts are never shuffled.

    A null text or one without words has an empty set, links with nothing and stays. A null doc_id stays with a null
    component. Repeated rows have the same result; rows that share a doc_id but not a text are one vertex. Empty input
    gives an empty result. Columns but doc_id and text are ignored.
    """
    small_batches(documents.sparkSession)
    similarity = percent / 100
    bands = bands_for(similarity, miss)
    hashes = bands * BAND
    steps = least_matches(similarity, miss, hashes)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = per_text("struct<n_shingles:bigint,digest:binary,sig:binary>", _sketch(words, hashes))(F.col("text"))
    sketch = stash(docs.select("doc_id", made.alias("s")).select("doc_id", "s.*"))
    real = sketch.where("n_shingles > 0 and doc_id is not null")
    facts = stash(real.groupBy("digest").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("n"), F.first("sig").alias("sig")))  # equal sets, equal signatures
    sigs = facts.select("id", "digest", "sig")
    repeated = not real.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    rows = stash(sketch.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("digest")).alias("digest")))
    release(sketch)  # signatures are in the facts, once for equal texts
    banded = stash(sigs.select("id", "sig").mapInPandas(_bands(bands), "key long, id long, band short"))
    crowded = stash(banded.groupBy("key").agg(F.min("id").alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    shared = stash(thin(banded, crowded.select("key"), "key"))
    release(banded)
    buckets = stash(join_facts(shared, crowded, "key", "n", "inner", TASK_ROWS))
    release(shared, crowded)
    crowd = stash(buckets.select("id").distinct())
    core = stash(thin(sigs, crowd, "id").join(crowd, "id", "left_semi"))  # what may link with anything
    digests = stash(facts.select("digest", "id", "n"))
    release(facts)
    whole = per_text("struct<digest:binary,shingles:binary>", _sets(words))(F.col("text"))
    again = thin(docs, crowd.select(F.col("id").alias("doc_id")), "doc_id").select(F.col("doc_id").alias("id"), whole.alias("s")).select("id", "s.*")
    if repeated:
        again = again.join(core.select("id", "digest"), ["id", "digest"], "left_semi").dropDuplicates(["id"])
    sets = stash(again.select("id", "shingles"))  # and a few that no pair asks for

    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def met(rows: DataFrame, values: DataFrame, compare: Callable, schema: str) -> DataFrame:
        """Groups of members with their leader first, each with its value: a leader's is sent once for each group."""
        heads = rows.select("key", "low", "high").distinct().select("key", "low", "high", F.col("key").alias("id"), F.lit(False).alias("member"))
        both = rows.select("key", "low", "high", "id", F.lit(True).alias("member")).unionByName(heads)
        sorted_ = both.join(values, "id").repartition(parts, "key", "low", "high").sortWithinPartitions("key", "low", "high", "member")
        return stash(sorted_.mapInPandas(_grouped(compare), schema))

    def led(pairs: DataFrame) -> DataFrame:
        """Links (src, dst) among distinct pairs (lead, id): the sequential test on signatures, then the whole sets.

        A leader's members are dealt to groups of LED, so a crowd round one text is no one task's, and neither the
        leader's signature nor its set is written once for each member."""
        counts = stash(pairs.groupBy("lead").agg(F.count(F.lit(1)).alias("n")))
        group = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / LED)).cast("int")
        dealt = stash(join_facts(pairs, counts, "lead", "n", "inner", TASK_ROWS).select(F.col("lead").alias("key"), group.alias("low"), F.lit(0).alias("high"), "id"))
        release(pairs, counts)
        tested = met(dealt, core.select("id", "sig"), _like_leader(steps), "key long, low int, high int, id long")
        release(dealt)
        asked = tested.select("id").unionByName(tested.select(F.col("key").alias("id"))).distinct()
        found = met(tested, thin(sets, asked, "id"), _linked_to_leader(percent), "src long, dst long")
        release(tested)
        return found

    links = led(stash(buckets.where("id <> lead").select("lead", "id").distinct()))
    components = staged(lambda: connected_components(links))
    mixed = _mixed(buckets, components)
    for turn in range(LEADERS):  # further leaders for the crowds, before what is left is compared in blocks
        crowds = mixed.where(F.col("n") > BLOCK)
        if crowds.isEmpty():
            break
        lead = crowds.groupBy("key").agg(F.min_by(F.struct("id", "comp"), F.xxhash64("id", F.lit(turn))).alias("lead"), F.max("n").alias("n"))
        apart = join_facts(crowds.drop("n"), stash(lead), "key", "n", "inner", TASK_ROWS).where("comp <> lead.comp")
        links = links.unionByName(led(stash(apart.select(F.col("lead.id").alias("lead"), "id").distinct())))
        release(components)
        components = staged(lambda: connected_components(links))
        mixed = _mixed(mixed, components)
    if not mixed.isEmpty():
        n_blocks = F.ceil(F.col("n") / BLOCK).cast("int")
        dealt = mixed.join(core.select("id", "sig"), "id").withColumn("block", F.pmod(F.xxhash64("id", "key"), n_blocks).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), n_blocks - 1)))
        dealt = dealt.select("key", "band", "id", "comp", "sig", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
        dealt = dealt.repartition(parts, "key", "low", "high").sortWithinPartitions("key", "low", "high")
        hopeful = stash(dealt.mapInPandas(_grouped(_hopeful(steps)), "key long, low int, high int, id long, comp long"))
        whole = hopeful.join(thin(sets, hopeful.select("id").distinct(), "id"), "id").repartition(parts, "key", "low", "high").sortWithinPartitions("key", "low", "high")
        links = links.unionByName(stash(whole.mapInPandas(_grouped(_linked_in_block(percent)), "src long, dst long")))
        release(hopeful, components)
        components = staged(lambda: connected_components(links))
    release(mixed, core, sets)
    found = digests.join(components.select(F.col("vertex").alias("id"), "component"), "id", "left")
    found = stash(found.select("digest", F.coalesce("component", "id").alias("component_id"), "n"))
    release(digests, components)
    whole = join_facts(rows, found, "digest", "n", "left", TASK_ROWS)
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return whole.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def _mixed(buckets: DataFrame, components: DataFrame) -> DataFrame:
    """(key, band, id, comp, n) of the buckets that still hold more than one component; the tables before go."""
    labelled = buckets.select("key", "band", "id").join(components.select(F.col("vertex").alias("id"), "component"), "id", "left")
    labelled = stash(labelled.select("key", "band", "id", F.coalesce("component", "id").alias("comp")))
    open_ = labelled.groupBy("key").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi"), F.count(F.lit(1)).alias("n")).where("_lo < _hi")
    open_ = stash(open_.select("key", "n"))
    out = stash(join_facts(labelled, open_, "key", "n", "inner", TASK_ROWS).select("key", "band", "id", "comp", "n"))
    release(buckets, labelled, open_)
    return out


def keep_one(documents: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``documents`` without those that near_duplicates does not keep; repeated rows of one kept id become one.

    Only documents that may go are shuffled: a bitmap of the ids that go lets all others pass where they are."""
    result = stash(near_duplicates(documents, words, percent))
    gone = stash(result.where(~F.col("kept")).select("doc_id").distinct())
    those, others = split(documents, F.col("doc_id").cast("long"), gone)
    kept = those.join(gone, "doc_id", "left_anti").select(*documents.columns).unionByName(others)
    again = result.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1")
    return kept if again.isEmpty() else kept.where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(kept.where("doc_id is null"))


NEAR_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, list_slice(w, i, i + 2) AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 1))) AS i FROM w WHERE len(w) > 0)
), k AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), l AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL)
    JOIN k p ON p.doc_id = a JOIN k q ON q.doc_id = b WHERE 100 * common >= 85 * (p.n + q.n - common)
), r AS (SELECT DISTINCT a AS id, a AS root FROM l UNION SELECT r.id, l.b FROM r JOIN l ON r.root = l.a
), c AS (SELECT id, min(root) AS component FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component, d.doc_id) AS component_id, coalesce(d.doc_id = coalesce(component, d.doc_id), TRUE) AS kept
FROM documents d LEFT JOIN k USING (doc_id) LEFT JOIN c ON d.doc_id = c.id
"""
