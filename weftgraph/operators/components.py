"""Connected components by repeated min-label contraction."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.functions.columns import short_key
from weftgraph.operators.skew import join_facts
from weftgraph.session import release, staged, stash

#: Edges that a task contracts at a time, more or less.
STRETCH = 200_000


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(vertex, component) for every endpoint of ``edges(src, dst)``; component is the smallest vertex reachable.

    Edges are undirected; loops give their vertex its own component, rows with a null end are skipped, and an empty
    input gives an empty result. Each round points every vertex at its smallest neighbour, shortens the pointers by
    one jump and rewrites the edges between what they point at, so the edges that are left shrink by a factor each
    time. A group's smallest vertex never points elsewhere, which makes it the label. Every join reads stashed tables
    on both sides, so a hub with very many edges is split by AQE's skew join, and goes when the next one is written.
    Texts are contracted as keys of 128 bits, and named again at the end.
    """
    kind = edges.schema["src"].dataType
    if kind == T.StringType():
        return _of_texts(edges, max_rounds)
    edges = edges.where("src is not null and dst is not null").select(F.col("src").cast(kind).alias("a"), F.col("dst").cast(kind).alias("b"))
    every = stash(edges)
    loops = stash(every.where("a = b").select(F.col("a").alias("vertex")).distinct())
    live, held = every.where("a <> b"), every
    pointers: list[DataFrame] = []
    for _ in range(max_rounds):
        if live.isEmpty():
            break
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = stash(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("p")))
        jump = first.select(F.col("v").alias("p"), F.col("p").alias("q"))
        second = stash(first.join(jump, "p").select("v", F.col("q").alias("p")))
        release(first)
        pointers.append(second)
        ends = second.select(F.col("v").alias("a"), F.col("p").alias("na"))
        other = second.select(F.col("v").alias("b"), F.col("p").alias("nb"))
        pointed = stash(live.join(ends, "a").select(F.col("na").alias("a"), "b"))  # one shuffle of the edges at a time
        release(held)
        live = held = stash(pointed.join(other, "b").where("a <> nb").select("a", F.col("nb").alias("b")).distinct())
        release(pointed)
    else:
        raise RuntimeError("components did not settle; raise max_rounds")
    release(held)
    if not pointers:
        return loops.select("vertex", F.col("vertex").alias("component"))
    found = pointers[-1].select(F.col("v").alias("vertex"), F.col("p").alias("component"))
    last = pointers[-1]
    for earlier in reversed(pointers[:-1]):
        on = found.select(F.col("vertex").alias("p"), "component")
        found = stash(earlier.join(on, "p", "left").select(F.col("v").alias("vertex"), F.coalesce("component", "p").alias("component")))
        release(earlier, last)
        last = found
    alone = loops.join(found, "vertex", "left_anti").select("vertex", F.col("vertex").alias("component"))
    return found.unionByName(alone)


def _of_texts(edges: DataFrame, max_rounds: int) -> DataFrame:
    """``connected_components`` of texts: edges hold 16 bytes an end, and a component's smallest text is found once."""
    there = edges.where("src is not null and dst is not null").select("src", F.col("dst").cast("string").alias("dst"))
    found, least = of_keys(there, max_rounds)
    ends = there.select(F.explode(F.array("src", "dst")).alias("vertex")).distinct().withColumn("_key", short_key(F.col("vertex")))
    named = stash(ends.join(found, "_key").select("vertex", "_of"))
    release(found)
    return join_facts(named, least, "_of", "_n", "inner").select("vertex", "component")


def of_keys(edges: DataFrame, max_rounds: int = 100) -> tuple[DataFrame, DataFrame]:
    """(found, least) for ``edges(src, dst)`` of texts: found(_key, _of) has each end's and its component's ``short_key``,
    least(_of, component, _n) each component's smallest text and its number of ends.

    Tasks first contract stretches of edges on their own, so that of each only one row an end is shuffled, and texts only
    of the stretches' smallest ends. An end then points at the smallest of its stretches' roots, and what remains are the
    edges between roots.
    """
    there = edges.where("src is not null and dst is not null").select("src", F.col("dst").cast("string").alias("dst"))
    stars = stash(there.mapInArrow(_contracted, "v binary, r binary, name string"))
    # an end has as many roots as stretches at the most
    near = stars.groupBy("v").agg(F.min("r").alias("p"), F.collect_set("r").alias("all"), F.max("name").alias("name"))
    near = stash(near.select("v", "p", F.array_remove("all", F.col("p")).alias("others"), "name"))
    release(stars)
    roots = staged(lambda: connected_components(near.select(F.explode("others").alias("src"), F.col("p").alias("dst")), max_rounds))
    to = roots.select(F.col("vertex").alias("p"), "component")
    found = stash(near.join(to, "p", "left").select(F.col("v").alias("_key"), F.coalesce("component", "p").alias("_of"), "name"))
    release(near, roots)
    least = stash(found.groupBy("_of").agg(F.min("name").alias("component"), F.count(F.lit(1)).alias("_n")))
    kept = found.select("_key", "_of")
    kept._stashed = found._stashed
    return kept, least


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(v, r, name): for each end in a stretch of edges the smallest end that it is linked to there, as keys; a root's own
    row, where both are equal, has its text."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= STRETCH:
            yield _stars(held)
            held, rows = [], 0
    if rows:
        yield _stars(held)


def _stars(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches(batches)
    coded = pa.chunked_array(table["src"].chunks + table["dst"].chunks).combine_chunks().dictionary_encode()
    texts, codes = coded.dictionary.cast(pa.binary()), coded.indices.to_numpy()
    order = pc.array_sort_indices(texts).to_numpy()  # bytes' order, as Spark's
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    a, b = rank[codes[: table.num_rows]], rank[codes[table.num_rows :]]
    root = np.arange(len(order))
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        open_ = low < high
        if not open_.any():
            break
        a, b = low[open_], high[open_]
        np.minimum.at(root, b, a)
        while (root != root[root]).any():
            root = root[root]
    texts = texts.take(pa.array(order))
    keys = pa.array([hashlib.md5(t, usedforsecurity=False).digest() for t in texts.to_pylist()], pa.binary())
    names = pc.if_else(pa.array(root == np.arange(len(root))), texts, None).cast(pa.string())
    return pa.RecordBatch.from_arrays([keys, keys.take(pa.array(root)), names], ["v", "r", "name"])
