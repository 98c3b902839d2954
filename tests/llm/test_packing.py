import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from weftgraph.llm import packing
from weftgraph.llm.tokens import TextTokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
PLAIN = Tokenizer.from_file(PATH)
FAST = TextTokenizer(PATH)


def ids(text):
    return np.array(PLAIN.encode(text, add_special_tokens=False).ids, "<u4")


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aAbBÉéßÿ×÷ΣσİrRvVeElLsStTmMdD'.,!?0 9²\n\t\x1c\x01\x02\x03\x85\xa0̱ †日<|>endoftx", max_size=80))
def test_marked_texts_give_the_tokenizers_ids(text):
    assert np.array_equal(FAST.encode([text])[0], ids(text))


def test_many_texts_at_once():
    rng = random.Random(7)
    signs = "ab'stmdrevl', .1é×"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(30))) for _ in range(3000)]
    texts += ["a<|endoftext|>b", "<|STARTOFTEXT|>", "don't IT'S we'LL, 'tis ''s 's's", "", " ", "'", "x" * 5000, "é" * 3000 + " a", "日本 " * 50, "a\x01b \x02 \x03"]
    rng.shuffle(texts)
    assert FAST.table.sound and all(np.array_equal(a, ids(t)) for a, t in zip(FAST.encode(texts), texts))


def test_a_file_without_a_sound_table_is_read_by_the_general_encoder(monkeypatch):
    fresh = TextTokenizer(PATH)
    monkeypatch.setattr(fresh.table, "sound", False)
    assert np.array_equal(fresh.encode(["some words"])[0], ids("some words"))


def test_query_holds_every_token_once(spark, prose, monkeypatch):
    monkeypatch.setattr(packing, "PART_PIECES", 40)
    rng = random.Random(4)
    rows = [(i, prose(rng.randint(0, 400), i)) for i in range(150)] + [(None, None), (200, ""), (201, prose(3000, 5)), (202, prose(8, 1)), (202, prose(8, 1))]
    table = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, piece int")
    got = packing.pack_documents(table, PATH, 512).collect()
    want = []
    for d, t in rows:
        whole = np.append(ids(t or ""), np.uint32(0)).astype("<u4")
        want += [(str(d), k, 512 * k, len(p), zlib.crc32(p.tobytes())) for k, p in enumerate(np.split(whole, range(512, len(whole), 512)))]
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512
    bound = packing.lower_bound(np.array([w[3] for w in want]), 512)
    assert bound <= len(sequences) <= bound * 1.02 + 1
    assert {(r["bins"], r["bound"]) for r in got} == {(len(sequences), bound)}
    assert packing.pack_documents(table.limit(0), PATH).count() == 0


def test_bound_and_fit_against_exhaustive_search():
    rng = random.Random(1)

    def best(sizes, room):
        if not sizes:
            return len(room)
        least = len(sizes) + len(room)
        for i, r in enumerate(room):
            if r >= sizes[0] and r not in room[:i]:
                least = min(least, best(sizes[1:], room[:i] + [r - sizes[0]] + room[i + 1 :]))
        return min(least, best(sizes[1:], [*room, 10 - sizes[0]]))

    for _ in range(60):
        sizes = sorted((rng.randint(1, 10) for _ in range(rng.randint(1, 7))), reverse=True)
        exact = best(sizes, [])
        bins, offsets, room = packing.best_fit(np.array(sizes), 10)
        assert packing.lower_bound(np.array(sizes), 10) <= exact <= len(room)
        assert all(sum(s for s, b in zip(sizes, bins) if b == k) == 10 - room[k] for k in range(len(room)))
    assert packing.lower_bound(np.array([6, 6, 6, 4]), 10) == 3 and packing.lower_bound(np.array([], "int64"), 10) == 0
