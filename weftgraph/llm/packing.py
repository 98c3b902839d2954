"""Best-fit packing of documents into token sequences, certified by lower bounds."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.arrow import per_text, structs
from weftgraph.llm.tokens import tokenizer
from weftgraph.session import small_batches, stash

#: Pieces in a partition, rounds of exchange at most, the part of a bin's capacity whose room opens the bin again, and the
#: largest k of the second family of bounds.
PART_PIECES, MOST_ROUNDS, LOOSE, MOST_K = 30_000, 8, 32, 32
_PIECE = "piece int, start long, length long, ids_crc32 long"
_COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32"]


def _cut(path: str, capacity: int, end_id: int) -> Callable:
    """Of each text its pieces: an array of structs."""

    def made() -> Callable:
        encoder = tokenizer(path)
        last = np.array([end_id], "<u4")

        def convert(texts: list) -> pa.Array:
            counts, piece, start, length, crc = [0], [], [], [], []
            for ids in encoder.encode(["" if t is None else t for t in texts]):
                whole = np.concatenate([ids, last])
                for k, at in enumerate(range(0, len(whole), capacity)):
                    part = whole[at : at + capacity]
                    piece.append(k)
                    start.append(at)
                    length.append(len(part))
                    crc.append(zlib.crc32(part))
                counts.append(len(piece))
            rows = structs(piece=pa.array(piece, pa.int32()), start=pa.array(start, pa.int64()), length=pa.array(length, pa.int64()), ids_crc32=pa.array(crc, pa.int64()))
            return pa.ListArray.from_arrays(pa.array(counts, pa.int32()), rows)

        return convert

    return made


def cut_pieces(documents: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): a document's ids and ``end_id``, cut only where they pass ``capacity``.

    No text is without a piece; the outer explode keeps a filter away that would encode every text once more."""
    small_batches(documents.sparkSession)
    pieces = per_text(f"array<struct<{_PIECE.replace(' ', ':').replace(',:', ',')}>>", _cut(tokenizer_path, capacity, end_id))
    found = documents.select(F.col("doc_id").cast("long").alias("doc_id"), pieces(F.col("text").cast("string")).alias("p"))
    return found.select("doc_id", F.explode_outer("p").alias("p")).select("doc_id", "p.*")


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Best-fit decreasing: (bin, offset) of each piece and the room left in each bin. Fixed for given lengths.

    Bins stand in a stack for each amount of room; a bit mask over the amounts finds the least that fits at once.
    """
    bins, offsets = np.zeros(len(lengths), "int64"), np.zeros(len(lengths), "int64")
    room: list[int] = []
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = mask >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            own = stacks[left].pop()
            if not stacks[left]:
                mask &= ~(1 << left)
        else:
            own, left = len(room), capacity
            room.append(capacity)
        bins[i], offsets[i] = own, capacity - left
        left -= size
        room[own] = left
        if left:
            stacks[left].append(own)
            mask |= 1 << left
    return bins, offsets, room


def lower_bound(lengths: np.ndarray, capacity: int, most_k: int = MOST_K) -> int:
    """No packing has fewer bins: the best of two families of dual feasible functions.

    f_k, k up to half the capacity, counts pieces over capacity - k as whole bins and drops those under k; u_k rounds
    (k + 1) x / capacity down to whole k-ths. Both are evaluated on the histogram of lengths.
    """
    sizes, counts = np.unique(lengths, return_counts=True)
    return lower_bound_of(dict(zip(sizes.tolist(), counts.tolist())), capacity, most_k)


def lower_bound_of(histogram: dict[int, int], capacity: int, most_k: int = MOST_K) -> int:
    """lower_bound of the lengths that the histogram counts."""
    if not histogram:
        return 0
    count = np.zeros(capacity + 1, "int64")
    count[list(histogram)] = list(histogram.values())
    x = np.arange(capacity + 1)
    n, total = np.cumsum(count), np.cumsum(count * x)
    k = np.arange(0, capacity // 2 + 1)
    big = n[-1] - n[capacity - k]
    middle = total[capacity - k] - np.where(k > 0, total[np.maximum(k - 1, 0)], 0)
    best = int((big + -(-middle // capacity)).max())
    for j in range(1, most_k + 1):
        scaled = (j + 1) * x
        whole = scaled % capacity == 0
        units = np.where(whole, j * x, scaled // capacity * capacity)  # capacity * j to a bin
        best = max(best, -(-int((count * units).sum()) // (capacity * j)))
    return best


_PACKED = "sequence_id long, offset long, part int, bins int, bound int, room long"


def _pack(capacity: int, turn: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        rows = pa.Table.from_batches(parts)
        rows = rows.sort_by([("length", "descending"), ("ids_crc32", "ascending"), ("doc_id", "ascending"), ("piece", "ascending")])
        lengths = rows["length"].to_numpy()
        own, offsets, room = best_fit(lengths, capacity)
        part, n = rows["part"][0].as_py(), len(lengths)
        added = {"sequence_id": (turn << 56) + (part << 32) + own, "offset": offsets, "part": np.full(n, part, "int32"), "bins": np.full(n, len(room), "int32"),
                 "bound": np.full(n, lower_bound(lengths, capacity), "int32"), "room": np.asarray(room, "int64")[own]}
        out = rows.select(_COLUMNS)
        for name, values in added.items():
            out = out.append_column(name, pa.array(values))
        yield from out.combine_chunks().to_batches(max_chunksize=10_000)

    return run


def _packed(pieces: DataFrame, n: int, capacity: int, turn: int) -> DataFrame:
    parts = max(1, -(-n // PART_PIECES))
    dealt = pieces.select(*_COLUMNS).repartition(parts).withColumn("part", F.spark_partition_id())
    return stash(dealt.mapInArrow(_pack(capacity, turn), f"doc_id long, {_PIECE}, {_PACKED}"))


def pack(pieces: DataFrame, capacity: int = 2048, rounds: int = MOST_ROUNDS) -> DataFrame:
    """``pieces`` (as cut_pieces gives them) with sequence_id and offset; no sequence passes ``capacity``.

    Pieces are dealt evenly to partitions of about PART_PIECES (bounded memory), each packed best-fit decreasing and
    certified by dual feasible functions. Rounds follow while there are more bins than the bound of all lengths together
    (a histogram of at most ``capacity`` rows). In a round partitions with more bins than their own bound exchange the
    pieces of bins that are not full, and every partition those of bins with a LOOSE-th of room or more, which its own
    bound can't tell from need. These pieces are dealt anew, among as many fewer partitions as they fill, and packed
    again. A round that saves no bin is dropped and ends them; each reads and writes only what the last left open.

    Every row also has ``bins``, the number of all sequences, and ``bound``, under which no packing gets: where they are
    equal the packing is certified to be the best, else their difference is what it may be short of that.
    """
    columns = [*_COLUMNS, "sequence_id", "offset"]
    histogram = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()
    n = sum(r["n"] for r in histogram)
    least = lower_bound_of({r["length"]: r["n"] for r in histogram}, capacity)
    done: list[DataFrame] = []
    now = _packed(pieces, n, capacity, 0)
    count = lambda rows: rows.groupBy("part").agg(F.max("bins").alias("b")).agg(F.coalesce(F.sum("b"), F.lit(0))).first()[0]
    total = count(now)
    loose = F.expr(f"room > 0 and (bins > bound or room * {LOOSE} >= {capacity})")
    for turn in range(1, rounds + 1):
        if total <= least:
            break
        open_ = now.where(loose)
        n, used = open_.agg(F.count(F.lit(1)), F.countDistinct("sequence_id")).first()
        if not n:
            break
        again = _packed(open_, n, capacity, turn)
        saved = used - count(again)
        if saved <= 0:
            break
        done.append(now.where(~loose).select(*columns))
        now, total = again, total - saved
    out = now.select(*columns)
    for part in done:
        out = out.unionByName(part)
    return out.withColumns({"bins": F.lit(total).cast("long"), "bound": F.lit(least).cast("long")})


def pack_documents(documents: DataFrame, tokenizer_path: str, capacity: int = 2048, rounds: int = MOST_ROUNDS) -> DataFrame:
    """Every document's pieces with their sequence: doc_id, piece, start, length, ids_crc32, sequence_id, offset,
    bins and bound of the whole packing.

    Null and empty texts are the end id alone. Repeated rows are packed as often as they come; a null doc_id is kept.
    No rows give no rows. Columns but doc_id and text are ignored. offset counts tokens from the sequence's start.
    """
    return pack(stash(cut_pieces(documents, tokenizer_path, capacity)), capacity, rounds)
