"""The trie of conversations' beginnings, with totals of every subtree sent from its leaves to its root."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.turns import CRC_TABLE, crc_sql, in_order, stream, text_of
from weftgraph.operators.skew import join_facts
from weftgraph.session import stash

#: Conversations that share their first turns, and the most turns they share.
FAMILY, SHARED = 20, 4
PATHS = "conv_id long, depth long, node binary, parent binary, words long, ends boolean"
_EMPTY = hashlib.sha256(b"").hexdigest()
_ROOT = b"\0" * 16


def digests(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 0, by turn with null first, then by the turn's digest), said (the digest) and words.

    Texts stay where they are read: rows of digests are what is shuffled. Rows without conv_id are no conversation's.
    """
    role, text = text_of("role"), text_of("text")
    said = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    words = F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", said.alias("said"), words.alias("words"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "said")) - 1
    return rows.select("conv_id", place.cast("long").alias("place"), "said", "words")


def rebuild(turns: DataFrame) -> DataFrame:
    """Each conversation c with the first h turns of c - c % 20 in place of its own first h, h = crc32(c) % 4; and a row
    with place -1 and no digest for each conversation, so that one without turns is known.

    At most FAMILY conversations take turns from one, and SHARED - 1 turns each, so that join has no hot key.
    """
    share = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED).alias("h")
    turns = stash(turns)
    own = turns.select("*", share).where("place >= h").drop("h")
    takers = turns.where("place = 0").select("conv_id", share, (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("of"))
    first = turns.where(F.col("place") < SHARED - 1).where(F.col("conv_id") % FAMILY == 0)
    taken = takers.where("h > 0").join(first.withColumnRenamed("conv_id", "of"), "of").where("place < h").select("conv_id", "place", "said", "words")
    known = takers.select("conv_id", F.lit(-1).cast("long").alias("place"), F.lit(None).cast("binary").alias("said"), F.lit(0).cast("long").alias("words"))
    return own.unionByName(taken).unionByName(known)


def paths(rebuilt: DataFrame) -> DataFrame:
    """One row of PATHS for each conversation and each of its beginnings: the node's key is a digest of all turns up to
    it, ``ends`` says whether the conversation has no further turn. ``rebuilt(conv_id, place, said, words)`` has one row
    with a place below all others for each conversation; a conversation is read turn by turn."""

    def step(rows: Iterator[tuple]) -> Iterator[tuple]:
        held = None
        for conv_id, _, said, words in rows:
            if held is not None and held[0] == conv_id:
                yield (*held, False)
                node = hashlib.blake2b(held[2] + said, digest_size=16).digest()
                held = (conv_id, held[1] + 1, node, held[2], words)
            else:
                if held is not None:
                    yield (*held, True)
                held = (conv_id, 0, _ROOT, None, 0)
        if held is not None:
            yield (*held, True)

    return stream(in_order(rebuilt, "conv_id", "place"), PATHS, step)


def trie_nodes(path: DataFrame) -> DataFrame:
    """node, parent, conv_id (the smallest member), depth, words, n_convs, n_ends and first_end, by combined aggregates."""
    return path.groupBy("node").agg(
        F.min("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.max("words").alias("words"),
        F.count(F.lit(1)).alias("n_convs"), F.count_if("ends").alias("n_ends"), F.min(F.when(F.col("ends"), F.col("conv_id"))).alias("first_end"))


def end_digests(path: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and ends_sha256 where several conversations end: their ids are read in order, one by one, into the digest."""
    several = nodes.where("n_ends > 1").select("node", "n_ends")
    ends = join_facts(path.where("ends").select("node", "conv_id"), several, "node", "n_ends", "inner").select("node", "conv_id")

    def step(rows: Iterator[tuple]) -> Iterator[tuple]:
        node, sha = None, None
        for at, conv_id in rows:
            if at == node:
                sha.update(b",%d" % conv_id)
            else:
                if sha:
                    yield node, sha.hexdigest()
                node, sha = at, hashlib.sha256(b"%d" % conv_id)
        if sha:
            yield node, sha.hexdigest()

    return stream(in_order(ends, "node", "conv_id"), "node binary, ends_sha256 string", step)


def peel_leaves(tree: DataFrame) -> DataFrame:
    """``tree(id, parent, remaining, leaves, saved)`` with leaves and saved summed over each subtree: (id, leaves, saved).

    Rows with no remaining child are complete and send their totals to their parents, whose counters go down by as many;
    rounds go on until the root, whose parent is null, has finished. Messages to one parent are combined before the shuffle, so a
    node with very many children gets one row from each task. Each round writes what is still open, so a lost
    executor costs a round at most; the rounds are as many as the tree is high.
    """
    spark = tree.sparkSession
    open_, done = stash(tree), []
    while True:
        complete = open_.where("remaining = 0")
        done.append(complete.select("id", "leaves", "saved"))
        waiting = open_.where("remaining > 0")
        if waiting.isEmpty():
            break
        messages = complete.groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("_n"), F.sum("leaves").alias("_leaves"), F.sum("saved").alias("_saved"))
        zero = lambda c: F.coalesce(F.col(c), F.lit(0))
        open_ = stash(waiting.join(messages, "id", "left").select(
            "id", "parent", (F.col("remaining") - zero("_n")).alias("remaining"), (F.col("leaves") + zero("_leaves")).alias("leaves"), (F.col("saved") + zero("_saved")).alias("saved")))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The query: one row for each node of the trie of ``conversations(conv_id, turn, role, text)``, rebuilt by ``rebuild``.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. A
    stretch of nodes with the same members, one below the other, is one node while leaves are peeled; its members are
    told apart by smallest member and number. Conversations that are alone from some turn on are complete at once.

    Null roles and texts are empty, rows without conv_id belong to no conversation, null turns come first, ties go by
    the digest of role and text; an empty table gives no row; other columns are left aside.
    """
    path = stash(paths(rebuild(digests(conversations))))
    nodes = stash(trie_nodes(path))
    parents = nodes.where("parent is not null").groupBy("parent").agg(F.count(F.lit(1)).alias("n_children"))
    facts = stash(parents.join(nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_convs").alias("parent_convs")), "parent"))
    counted = nodes.join(facts.select(F.col("parent").alias("node"), "n_children"), "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    rows = join_facts(stash(counted), facts.withColumnRenamed("n_children", "_n"), "parent", "_n").drop("_n")
    id_, parent = F.struct("conv_id", "n_convs"), F.struct(F.col("parent_conv_id").alias("conv_id"), F.col("parent_convs").alias("n_convs"))
    top = F.col("parent").isNull() | (F.col("parent_convs") != F.col("n_convs"))
    rows = stash(rows.select("*", id_.alias("id"), top.alias("top"), F.when(top & F.col("parent").isNotNull(), parent).alias("above"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved")))

    shared, alone = rows.where("n_convs > 1"), rows.where("n_convs = 1")
    stretches = shared.groupBy("id").agg(F.max("above").alias("parent"), F.max_by("n_children", "depth").alias("remaining"), F.sum("saved").alias("saved"))
    leaves = F.when(F.col("remaining") == 0, 1).otherwise(0).cast("long")
    ends = alone.where("top").select("id", F.col("above").alias("parent"), F.lit(0).cast("long").alias("remaining"), F.lit(1).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"))
    totals = peel_leaves(stretches.select("id", "parent", "remaining", leaves.alias("leaves"), "saved").unionByName(ends))

    higher = F.coalesce(F.sum("saved").over(Window.partitionBy("id").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    below = totals.where("id.n_convs > 1").select("id", F.col("leaves").alias("n_leaves"), F.col("saved").alias("_all"))
    summed = shared.withColumn("_higher", higher).join(below, "id").withColumn("saved_tokens", F.col("_all") - F.col("_higher"))
    summed = summed.unionByName(alone.withColumn("n_leaves", F.lit(1).cast("long")).withColumn("saved_tokens", F.lit(0).cast("long")), allowMissingColumns=True)
    one = F.when(F.col("n_ends") == 0, F.lit(_EMPTY)).otherwise(F.sha2(F.col("first_end").cast("string").cast("binary"), 256))
    out = summed.join(end_digests(path, nodes), "node", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", one).alias("ends_sha256"))


TRIE_SQL = f"""
WITH {CRC_TABLE},
turns AS (
  SELECT conv_id, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS said,
    length(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words, turn
  FROM conversations WHERE conv_id IS NOT NULL),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, said) - 1 AS place FROM turns),
convs AS (SELECT conv_id, conv_id - conv_id % {FAMILY} AS of, {crc_sql("CAST(conv_id AS VARCHAR)")} % {SHARED} AS h
  FROM (SELECT DISTINCT conv_id FROM turns) AS c, crc_table),
rebuilt AS (
  SELECT c.conv_id, p.place, p.said, p.words FROM convs AS c JOIN placed AS p ON p.conv_id = c.conv_id AND p.place >= c.h
  UNION ALL SELECT c.conv_id, p.place, p.said, p.words FROM convs AS c JOIN placed AS p ON p.conv_id = c.of AND p.place < c.h),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY place) AS depth FROM rebuilt),
beginnings AS (
  SELECT conv_id, depth, words, string_agg(said, '') OVER (PARTITION BY conv_id ORDER BY depth) AS path, count(*) OVER (PARTITION BY conv_id) AS n FROM numbered
  UNION ALL SELECT c.conv_id, 0, 0, '', (SELECT count(*) FROM rebuilt AS r WHERE r.conv_id = c.conv_id) FROM convs AS c),
nodes AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(words) AS saved,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256
  FROM beginnings GROUP BY path, depth),
families AS (SELECT left(path, length(path) - 32) AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
childless AS (SELECT n.path, CASE WHEN f.path IS NULL THEN 1 ELSE 0 END AS leaf FROM nodes AS n LEFT JOIN families AS f ON f.path = n.path),
subtrees AS (
  SELECT a.path, sum(c.leaf) AS n_leaves, sum(b.saved) AS saved_tokens
  FROM nodes AS a JOIN nodes AS b ON starts_with(b.path, a.path) JOIN childless AS c ON c.path = b.path GROUP BY a.path)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, CAST(n.n_convs AS BIGINT) AS n_convs,
  CAST(coalesce(f.n_children, 0) AS BIGINT) AS n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes AS n JOIN subtrees AS s ON s.path = n.path LEFT JOIN families AS f ON f.path = n.path
LEFT JOIN nodes AS p ON n.depth > 0 AND p.path = left(n.path, length(n.path) - 32)
"""
