import hashlib
import struct
import zlib

import numpy as np
import pytest

from weftgraph.llm import media


def payload(text):
    data = (text or "").encode()
    return data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")


def test_query_matches_the_texts(spark, prose):
    texts = [None, "", "a", "é" * 32, "x" * 64, "x" * 65, "\0", prose(30_000, 3), prose(50, 1), prose(50, 1)]
    table = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "n", 1)], "doc_id long, text string, feature int")
    got = {r["doc_id"]: r for r in media.media_query(table).collect()}
    assert len(got) == len(texts) + 1
    for i, t in enumerate(texts):
        p, r = payload(t), got[i]
        assert (r["n_bytes"], r["payload_bytes"]) == (len((t or "").encode()), len(p))
        assert (r["payload_sha256"], r["tail_crc32"]) == (hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    assert tuple(got[8])[1:] == tuple(got[9])[1:]
    images = media.to_images(table).collect()
    assert {(r["media_bytes"], r["media_sha256"]) for r in got.values()} == {(len(r["png"]), hashlib.sha256(r["png"]).hexdigest()) for r in images}
    assert media.media_query(table.limit(0)).count() == 0


def test_all_filters_are_undone():
    rng = np.random.default_rng(1)
    image = rng.integers(0, 256, (40, 64), "uint8")
    kinds = np.array([0, 1, 2, 3, 4] * 8)
    rows = []
    for r in range(40):
        line, up = image[r].astype(int), (image[r - 1] if r else np.zeros(64, "uint8")).astype(int)
        left, corner = np.r_[0, line[:-1]], np.r_[0, up[:-1]]
        p = left + up - corner
        nearest = np.where((abs(p - left) <= abs(p - up)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - up) <= abs(p - corner), up, corner))
        guess = [0 * line, left, up, (left + up) // 2, nearest][kinds[r]]
        rows.append(bytes([kinds[r]]) + ((line - guess) % 256).astype("uint8").tobytes())
    head = struct.pack(">IIBBBBB", 64, 40, 8, 0, 0, 0, 0)
    data = b"\x89PNG\r\n\x1a\n" + media._chunk(b"IHDR", head) + media._chunk(b"IDAT", zlib.compress(b"".join(rows))) + media._chunk(b"IEND", b"")
    assert (media.decode_png(data) == image).all()


def test_broken_images_raise():
    data = media.encode_png(np.zeros((2, 64), "uint8"))
    for broken in (data[:-1], data[:40] + bytes([data[40] ^ 1]) + data[41:], b"no", data[:33]):
        with pytest.raises((ValueError, zlib.error)):
            media.decode_png(broken)


def test_hash_is_of_low_frequencies():
    rng = np.random.default_rng(2)
    waves = np.cos(np.pi * np.outer(np.arange(8), 2 * np.arange(64) + 1) / 128)  # every low frequency has a part
    smooth = waves.T @ rng.normal(scale=12, size=(8, 8)) @ waves + 128
    noisy = smooth + rng.normal(scale=4, size=smooth.shape)
    bits = lambda a: np.unpackbits(np.frombuffer(media.cosine_hash(a.clip(0, 255).astype("uint8")), "uint8"))
    assert (bits(smooth) != bits(noisy)).sum() < 8
