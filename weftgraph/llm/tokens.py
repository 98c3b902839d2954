"""Token ids of whole texts by a tokenizer file, many texts to a call."""

from __future__ import annotations

import json

import numpy as np

#: What ends a token, parts two texts, and stands for a chunk that the general encoder reads; no plain text holds them.
_END, _PART, _HOLE = b"\x01", b"\x02", b"\x03"
#: Special tokens begin so, and combining marks U+0300 to U+036F begin so in UTF-8: such texts are encoded as they are.
_AS_IS = (b"<|", b"\xcc", b"\xcd")
#: Bytes encoded at a time, and the longest token that the rank table merges.
GROUP_BYTES, MOST_LENGTH = 1 << 18, 1000
_SPACE, _LETTER, _DIGIT, _OTHER = range(4)
_HIGH = bytes(range(128, 256))


def _classes() -> np.ndarray:
    """Of bytes; those over 127 are of letters U+00C0 to U+00FF."""
    kinds = np.full(256, _OTHER, "uint8")
    kinds[[9, 10, 11, 12, 13, 32]] = _SPACE
    kinds[97:123] = kinds[65:91] = kinds[128:] = _LETTER
    kinds[48:58] = _DIGIT
    return kinds


_CLASS = _classes()


def _byte_symbols() -> dict[str, int]:
    """The printable characters that byte-level vocabularies write bytes with."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def plain(raw: bytes) -> bool:
    """ASCII and letters U+00C0 to U+00FF (with two signs among them), and none of the marks above."""
    if _END in raw or _PART in raw or _HOLE in raw:
        return False
    return raw.isascii() or len(raw) - len(raw.translate(None, _HIGH)) == 2 * raw.count(b"\xc3")


def with_ends(raw: bytes) -> tuple[bytes, int]:
    """A plain text in lower case with a mark after each token, and the longest token's bytes.

    Tokens are contractions ('s 't 'm 'd 're 've 'll, not after another sign), runs of letters, single digits and runs of
    other signs; all bytes are cut at once."""
    b = np.frombuffer(raw.lower(), "uint8")
    if not len(b):
        return raw, 0
    kind = _CLASS[b]
    if not raw.isascii():
        follows = np.flatnonzero(b == 0xC3) + 1
        second = b[follows]
        sign = (second == 0x97) | (second == 0xB7)
        kind[follows[sign]] = kind[follows[sign] - 1] = _OTHER
        upper = follows[(second < 0x9F) & ~sign]
        b = b.copy()
        b[upper] += 0x20
    end = kind != _SPACE
    end[:-1] &= (kind[:-1] != kind[1:]) | (kind[:-1] == _DIGIT)
    quotes = np.flatnonzero(b[:-1] == 39)
    if len(quotes):
        quotes = quotes[(quotes == 0) | (kind[quotes - 1] != _OTHER)]
        first, second = b[quotes + 1], b[np.minimum(quotes + 2, len(b) - 1)] * (quotes + 2 < len(b))
        one = np.isin(first, np.frombuffer(b"stmd", "uint8"))
        two = ((first == 114) | (first == 118)) & (second == 101) | (first == 108) & (second == 108)
        end[quotes[one | two]] = False
        end[quotes[one] + 1] = True
        end[quotes[two] + 2] = True
    ends = np.flatnonzero(end)
    out = np.repeat(b, end.view("uint8") + np.uint8(1))
    out[ends + np.arange(1, len(ends) + 1)] = _END[0]
    return out.tobytes(), int(np.diff(ends, prepend=-1).max(initial=0))


class RankTable:
    """Byte-pair merges of whole texts by a rank table.

    Ranks are looked up by what a merge makes. That is the same as by its pair if every token, merged on its own, comes
    out whole: two tokens side by side can only be the pair that its own merging ends with. ``sound`` says whether this
    holds for the file; else the table must not be used. A mark stands for the end of a word.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        self.sound = model["type"] == "BPE" and model.get("end_of_word_suffix") == "</w>" and not model.get("dropout")
        if not self.sound:
            return
        symbols = _byte_symbols()

        def raw(token: str) -> bytes:
            word = token.endswith("</w>")
            return bytes(symbols[c] for c in (token[:-4] if word else token)) + (_END if word else b"")

        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        made = [raw(a) + raw(b) for a, b in merges]
        order = [bytes([b]) for b in range(256)] + [bytes([b]) + _END for b in range(256)] + made
        ranks = {token: k for k, token in enumerate(order)}
        by_pair = {pair: k for k, pair in enumerate(merges)}
        self.sound = len(ranks) == len(order) and all(self._whole(a, b, by_pair) for a, b in merges)
        ids = {raw(t): i for t, i in model["vocab"].items() if all(c in symbols for c in t.removesuffix("</w>"))}
        self.ids = np.array([ids.get(token, 0) for token in order], "<u4")
        self.part, self.hole = ranks[_PART + _END], ranks[_HOLE + _END]
        never = "\x02\x02never\x02"  # the encoder wants a special token; no text holds this one
        self.encode = tiktoken.Encoding("ends", pat_str=r"[^ \t\n\x0b\x0c\r\x01]+\x01", mergeable_ranks=ranks, special_tokens={never: len(order)})._core_bpe.encode_to_tiktoken_buffer

    @staticmethod
    def _whole(a: str, b: str, by_pair: dict[tuple[str, str], int]) -> bool:
        word = b.endswith("</w>")
        parts = [*a, *(b[:-4] if word else b)]
        if word:
            parts[-1] += "</w>"
        while len(parts) > 1:
            rank, at = min((by_pair.get(pair, len(by_pair)), i) for i, pair in enumerate(zip(parts, parts[1:])))
            if rank == len(by_pair):
                return False
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return True

    def ranks(self, marked: bytes) -> np.ndarray:
        return np.frombuffer(self.encode(marked.decode(), set()), "uint32")


class TextTokenizer:
    """encode(texts) gives each text's ids (little-endian, unsigned, 32 bits).

    For tokenizers that lower-case, drop white space and never join what stands on both sides of it: a text's ids are
    then those of its chunks between ASCII white space, one after the other. Plain chunks go through the rank table, all
    of a group of texts in one call; others, and very long ones, through the general encoder.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.table = RankTable(path)

    def _general(self, texts: list[bytes]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False) if texts else []
        return [np.array(x.ids, "<u4") for x in found]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        raw = [t.encode() for t in texts]
        if not self.table.sound:
            return self._general(raw)
        out: list[np.ndarray] = []
        group: list[bytes] = []
        size = 0
        for t in raw:
            group.append(t)
            size += len(t)
            if size >= GROUP_BYTES:
                out += self._encode(group)
                group, size = [], 0
        return out + self._encode(group) if group else out

    def _encode(self, raw: list[bytes], by_chunk: bool = False) -> list[np.ndarray]:
        parts: list[bytes] = []
        holes: list[bytes] = []
        for t in raw:
            if any(x in t for x in _AS_IS):
                parts.append(_HOLE)
                holes.append(t)
            elif plain(t) and not by_chunk:
                parts.append(t)
            else:
                chunks = t.lower().split()
                odd = [len(c) > MOST_LENGTH or not plain(c) for c in chunks]
                holes += [c for c, x in zip(chunks, odd) if x]
                parts.append(b" ".join(_HOLE if x else c for c, x in zip(chunks, odd)))
        marked, longest = with_ends((b" " + _PART + b" ").join(parts))
        if longest > MOST_LENGTH and not by_chunk:
            return self._encode(raw, by_chunk=True)
        ranks = self.table.ranks(marked)
        cuts = np.flatnonzero(ranks == self.table.part)
        starts, ends = [0, *(cuts + 1).tolist()], [*cuts.tolist(), len(ranks)]
        ids = self.table.ids[ranks]
        if not holes:
            return [ids[a:b] for a, b in zip(starts, ends)]
        distinct = list(dict.fromkeys(holes))
        known = dict(zip(distinct, self._general(distinct)))
        filled = iter(holes)
        at = np.flatnonzero(ranks == self.table.hole)
        out = []
        for a, b in zip(starts, ends):
            own = at[np.searchsorted(at, a) : np.searchsorted(at, b)].tolist()
            pieces = []
            for h in own:
                pieces += [ids[a:h], known[next(filled)]]
                a = h + 1
            out.append(np.concatenate([*pieces, ids[a:b]]) if own else ids[a:b])
        return out


_LOADED: dict[str, TextTokenizer] = {}


def tokenizer(path: str) -> TextTokenizer:
    """One for each worker process and file."""
    if path not in _LOADED:
        _LOADED[path] = TextTokenizer(path)
    return _LOADED[path]
