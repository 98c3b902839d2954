"""PNG images in binary columns: chunks with checksums, row filters, and a hash of low cosine frequencies."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.arrow import per_text, structs
from weftgraph.session import small_batches

_SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Image width in samples, bytes in an IDAT chunk, and deflate's level.
WIDTH, IDAT_BYTES, LEVEL = 64, 65_536, 6
#: The image is brought to SIDE x SIDE, of whose frequencies LOW x LOW count.
SIDE, LOW = 32, 8
_k, _n = np.meshgrid(np.arange(LOW), np.arange(SIDE), indexing="ij")
_COSINES = np.cos(np.pi * (2 * _n + 1) * _k / (2 * SIDE))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(samples: np.ndarray) -> bytes:
    """A grey 8-bit PNG of ``samples`` (rows x width). Each row takes the filter of none, sub and up whose bytes, read
    as signed, have the least absolute sum; the first of equals."""
    height, width = samples.shape
    sub, up = samples.copy(), samples.copy()
    sub[:, 1:] -= samples[:, :-1]
    up[1:] -= samples[:-1]
    choices = np.stack([samples, sub, up])
    cost = np.abs(choices.view("int8").astype("int16")).sum(axis=2, dtype="int64")
    kind = cost.argmin(axis=0)
    rows = np.empty((height, width + 1), "uint8")
    rows[:, 0], rows[:, 1:] = kind, choices[kind, np.arange(height)]
    data = zlib.compress(rows.tobytes(), LEVEL)
    parts = [_chunk(b"IDAT", data[i : i + IDAT_BYTES]) for i in range(0, len(data), IDAT_BYTES)]
    return _SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + b"".join(parts) + _chunk(b"IEND", b"")


def decode_png(data: bytes) -> np.ndarray:
    """The samples of a grey 8-bit PNG. A wrong signature, checksum, length or filter raises ValueError."""
    if data[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, size, body, ended = 8, None, [], False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise ValueError("cut chunk")
        (length,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        chunk = data[at + 8 : at + 8 + length]
        if len(chunk) != length or data[at + 8 + length : at + 12 + length] != struct.pack(">I", zlib.crc32(kind + chunk)):
            raise ValueError(f"checksum of {kind!r}")
        if kind == b"IHDR":
            width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", chunk)
            if (depth, colour, interlaced) != (8, 0, 0):
                raise ValueError("not grey with 8 bits in plain order")
            size = height, width
        elif kind == b"IDAT":
            body.append(chunk)
        ended = kind == b"IEND"
        at += 12 + length
    if size is None or not ended:
        raise ValueError("cut image")
    flat = np.frombuffer(zlib.decompress(b"".join(body)), "uint8")
    if flat.size != size[0] * (size[1] + 1):
        raise ValueError("wrong length")
    rows = flat.reshape(size[0], size[1] + 1)
    return _unfilter(rows[:, 0], rows[:, 1:])


def _unfilter(kinds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Runs of rows with one filter at a time: sums along a row undo sub, sums down the rows undo up."""
    out = rows.copy()
    if kinds.size and kinds.max() > 4:
        raise ValueError("unknown filter")
    subs = kinds == 1
    out[subs] = np.cumsum(rows[subs], axis=1, dtype="uint8")
    cuts = np.flatnonzero(np.diff(kinds)) + 1
    for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(kinds)]):
        kind = kinds[start] if end > start else 0
        if kind == 2:
            if start:
                out[start] += out[start - 1]
            out[start:end] = np.cumsum(out[start:end], axis=0, dtype="uint8")
        elif kind > 2:
            for r in range(start, end):
                _unfilter_by_sample(int(kind), out[r], out[r - 1] if r else np.zeros_like(out[r]))
    return out


def _unfilter_by_sample(kind: int, row: np.ndarray, above: np.ndarray) -> None:
    """Average and Paeth, which need each sample before the next; other writers use them."""
    line, up, left, corner = row.tolist(), above.tolist(), 0, 0
    for i, b in enumerate(up):
        if kind == 3:
            guess = (left + b) >> 1
        else:
            p = left + b - corner
            d = abs(p - left), abs(p - b), abs(p - corner)
            guess = (left, b, corner)[d.index(min(d))]
        left, corner = (line[i] + guess) & 255, b
        line[i] = left
    row[:] = line


def cosine_hash(samples: np.ndarray) -> bytes:
    """64 bits: which low cosine frequencies of the image, brought to SIDE x SIDE, lie over their median.

    Axes shorter than SIDE repeat their samples, longer ones take means of even cuts."""
    small = _resize(_resize(samples.astype("float64"), 0), 1)
    low = _COSINES @ small @ _COSINES.T
    flat = np.round(low.ravel(), 6)
    return np.packbits(flat > np.median(flat[1:])).tobytes()


def _resize(a: np.ndarray, axis: int) -> np.ndarray:
    n = a.shape[axis]
    if n < SIDE:
        return a.take(np.arange(SIDE) * n // SIDE, axis=axis)
    cuts = np.arange(SIDE) * n // SIDE
    sums = np.add.reduceat(a, cuts, axis=axis)
    counts = np.diff([*cuts, n])
    return sums / (counts[:, None] if axis == 0 else counts[None, :])


def _store() -> Callable:
    def convert(texts: list) -> pa.Array:
        raw = [b"" if t is None else t.encode() for t in texts]
        images = [encode_png(np.frombuffer(b.ljust(max(WIDTH, -(-len(b) // WIDTH) * WIDTH), b"\0"), "uint8").reshape(-1, WIDTH)) for b in raw]
        return structs(n_bytes=pa.array(map(len, raw), pa.int64()), png=pa.array(images, pa.binary()))

    return convert


_FEATURES = {"payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "cosine_hash": pa.binary()}


def _describe() -> Callable:
    def convert(images: list) -> pa.Array:
        rows = []
        for data in images:
            samples = decode_png(data)
            payload = samples.tobytes()
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), cosine_hash(samples)))
        return structs(**{name: pa.array([r[k] for r in rows], kind) for k, (name, kind) in enumerate(_FEATURES.items())})

    return convert


def to_images(documents: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, png): each text's UTF-8 bytes, with zeros up to a positive multiple of WIDTH, as a PNG of that width."""
    small_batches(documents.sparkSession)
    image = per_text("struct<n_bytes:bigint,png:binary>", _store)(F.col("text").cast("string"))
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), image.alias("i")).select("doc_id", "i.n_bytes", "i.png")


def describe_images(images: DataFrame) -> DataFrame:
    """Reads the PNGs back, with every checksum tested, and describes what they hold. Any broken image raises."""
    kinds = {pa.int64(): "bigint", pa.string(): "string", pa.binary(): "binary"}
    found = per_text(f"struct<{','.join(f'{n}:{kinds[k]}' for n, k in _FEATURES.items())}>", _describe)(F.col("png"))
    return images.select("doc_id", "n_bytes", found.alias("f")).select("doc_id", "n_bytes", "f.*")


def media_query(documents: DataFrame) -> DataFrame:
    """One row for each document, in no shuffle: its image's sizes, digests and, as hex, the cosine hash.

    Null and empty texts are one row of 64 zero bytes. Equal texts give equal values; repeated rows and null ids are
    kept; no rows give no rows. Columns but doc_id and text are ignored.
    """
    return describe_images(to_images(documents)).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", F.lower(F.hex("cosine_hash")).alias("feature"))
