"""Byte-level BPE encoding by dynamic programming over prefixes, and decoding."""

from __future__ import annotations

import functools
import json
import sys
from array import array
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import blocks, lean, need

#: Fixed value: how the byte-level kind of tokenizer cuts a text into units before it merges.
UNIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Results of so many units, twice, are kept in a worker, of units up to so many characters; and of so many pairs of tokens.
KEPT, KEPT_CHARS, KEPT_PAIRS = 300_000, 128, 1_000_000
#: Pieces of more characters are cut into units bit by bit.
AT_ONCE = 1_000_000
NEVER = 1 << 62
LITTLE = sys.byteorder == "little" and array("I").itemsize == 4


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it can be seen, else the next beyond 255."""
    seen = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in seen]
    return [chr(b) if b in seen else chr(256 + hidden.index(b)) for b in range(256)]


class Vocabulary:
    """A byte-level BPE tokenizer file: tokens, merges by rank, and the automaton of all tokens that end at a place.

    Raises ValueError on a file of another kind: what is read here is a BPE model without normalizer, prefix space, dropout or affixes, whose merges
    each make a token of their own out of earlier ones."""

    def __init__(self, path: str):
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre, decoder = spec["model"], spec["pre_tokenizer"] or {}, spec["decoder"] or {}
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
        added = spec["added_tokens"]
        if model["type"] != "BPE" or odd or spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or decoder.get("type") != "ByteLevel":
            raise ValueError(f"not a plain byte-level BPE file: {path} {odd}")
        if any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that take in what is beside them aren't supported")
        ids = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        #: rank by pair of ids; of a merged token its rank and its parts
        self.rank_of = {(ids[a], ids[b]): r for r, (a, b) in enumerate(pairs)}
        self.rank = {ids[a + b]: r for r, (a, b) in enumerate(pairs)}
        self.parts = {ids[a + b]: (ids[a], ids[b]) for a, b in pairs}
        early = all(self.rank.get(x, -1) < r for (a, b), r in self.rank_of.items() for x in (a, b))
        if not early or len(self.parts) != len(pairs):
            raise ValueError("merges must each make a new token out of earlier ones")
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        self.spoken = {i: bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode() for t, i in [*ids.items(), *((t["content"], t["id"]) for t in added)]}
        self.added = {t["content"]: t["id"] for t in added}
        names = sorted(map(regex.escape, self.added), key=len, reverse=True)
        self.special = regex.compile(f"({'|'.join(names)})") if names else None
        self.right, self.left, self.fits = {}, {}, {}
        # A token that merging its own letters doesn't give is in no encoding.
        whole = {i for i in ids.values() if i not in self.parts}
        for i in sorted(self.parts, key=self.rank.get):
            if whole.issuperset(self.parts[i]) and self.first_crossing(*self.parts[i]) == self.parts[i]:
                whole.add(i)
        self.size = {i: len(t) for t, i in ids.items()}
        self.ends = ahocorasick.Automaton()  # over bytes, as letters below 256
        for i in whole:
            self.ends.add_word(self.spoken[i].decode("latin-1"), (i, self.size[i]))
        self.ends.make_automaton()

    def spine(self, token: int, side: int) -> list[int]:
        """What stands at one end of a token (0: its left) while it is merged: from a single letter up to the token."""
        known = (self.left, self.right)[side]
        if token not in known:
            out = [token]
            while out[-1] in self.parts:
                out.append(self.parts[out[-1]][side])
            known[token] = out[::-1]
        return known[token]

    def first_crossing(self, a: int, b: int) -> tuple[int, int] | None:
        """The first merge across the border of two neighbouring tokens, or none. Merges go by rank, of equal ones the left first; what the border has
        on each side grows along a's right and b's left spine."""
        x, y, i, j = self.spine(a, 1), self.spine(b, 0), 0, 0
        while True:
            left = self.rank[x[i + 1]] if i + 1 < len(x) else NEVER
            right = self.rank[y[j + 1]] if j + 1 < len(y) else NEVER
            across = self.rank_of.get((x[i], y[j]), NEVER)
            if across < left and across <= right:
                return (x[i], y[j]) if across < NEVER else None
            if left == right == NEVER:
                return None
            if left <= right:
                i += 1
            else:
                j += 1

    def compatible(self, a: int, b: int) -> bool:
        """Whether b may follow a in an encoding."""
        key = a << 32 | b
        if key not in self.fits:
            if len(self.fits) >= KEPT_PAIRS:
                self.fits.clear()
            self.fits[key] = self.first_crossing(a, b) is None
        return self.fits[key]

    def encode_units(self, units: list[str]) -> list[list[int]]:
        """Ids of units, each by itself. For every prefix the one token that ends its encoding is stored: of the tokens that the automaton finds there, the one
        that is compatible with the last token of what is before it. The ids are read off from a unit's end. The automaton runs over all units at once, with a
        letter between them that is in no token."""
        told = [u if u.isascii() else u.encode("utf-8", "surrogatepass").decode("latin-1") for u in units]
        last = array("i", [-1]) * (sum(map(len, told)) + len(told) + 1)
        at = 0
        for t in told:
            last[at] = -2  # a unit begins
            at += len(t) + 1
        fits, compatible = self.fits.get, self.compatible
        for end, (token, size) in self.ends.iter(chr(256).join(told)):
            end += 1
            if last[end] == -1:
                before = last[end - size]
                if before >= 0:
                    fit = fits(before << 32 | token)
                    if compatible(before, token) if fit is None else fit:
                        last[end] = token
                elif before == -2:
                    last[end] = token
        out, at, size = [], 0, self.size
        for t in told:
            ids, k = [], at + len(t)
            while k > at:
                ids.append(last[k])
                k -= size[ids[-1]]
            out.append(ids[::-1])
            at += len(t) + 1
        return out

    def encode_unit(self, unit: str) -> list[int]:
        return self.encode_units([unit])[0]


@functools.lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder:
    """Encodes texts; remembers units, as most come again and again: those of late and, until these are as many again, those before."""

    def __init__(self, path: str):
        self.v, self.known, self.before = vocabulary(path), {}, {}

    def learn(self, units: list[str]) -> None:
        """Makes all of the units known."""
        known, before = self.known, self.before
        new = [u for u in set(units) if u not in known]
        for u in new:
            if u in before:
                known[u] = before[u]
        new = [u for u in new if u not in known]
        for u, ids in zip(new, self.v.encode_units(new), strict=True):
            known[u] = array("I", ids).tobytes() if LITTLE else np.array(ids, "<u4").tobytes()

    def forget(self) -> None:
        if len(self.known) > KEPT:
            self.before, self.known = {u: x for u, x in self.known.items() if len(u) <= KEPT_CHARS}, {}

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned integers of 32 bits. Added tokens in a text are what they stand for."""
        v, out, ready = self.v, [], []
        for text in texts:
            cut = []
            for piece in v.special.split(text) if v.special else [text]:
                if piece in v.added:
                    cut.append(np.array([v.added[piece]], "<u4").tobytes())
                elif len(piece) <= AT_ONCE:
                    cut.append(UNIT.findall(piece))
                else:
                    found = UNIT.finditer(piece)
                    while some := [m[0] for m in islice(found, 100_000)]:
                        self.learn(some)
                        cut.append(b"".join(map(self.known.__getitem__, some)))
                        self.forget()
            ready.append(cut)
        self.learn([u for cut in ready for x in cut if isinstance(x, list) for u in x])
        get = self.known.__getitem__
        for cut in ready:
            out.append(b"".join(b"".join(map(get, x)) if isinstance(x, list) else x for x in cut))
        self.forget()
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


@functools.lru_cache(2)
def encoder_of(path: str) -> Encoder:
    """A worker's own; it serves all of its tasks."""
    return Encoder(path)


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of every whole text as the tokenizers library gives them with the file at `path`, which must exist on every executor, without added tokens.

    A text is cut at added tokens and into units; each unit is encoded by dynamic programming over its prefixes: an automaton gives the tokens that end at each place,
    a test of neighbouring tokens picks the only one that can be the last, and pointers back from the end give the ids. So a unit of any length takes time and memory in
    proportion. Results of short units are kept up to a fixed number.

    Returns one row per input row: id, ids (binary: little-endian unsigned 32-bit integers). A null text is empty: no ids. Rows that repeat, null ids
    and other columns make no difference; an empty table gives no rows; nothing is shuffled.
    """
    need(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        encoder = encoder_of(path)
        for batch in batches:
            for piece, texts in blocks(batch, 1, 1_000_000):
                ids = pa.array(encoder.encode_all(texts.to_pylist()), pa.binary())
                yield pa.RecordBatch.from_arrays([piece.column(0), ids], names=["id", "ids"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return out.mapInArrow(lean(run), f"id {kind}, ids binary").withColumnRenamed("id", id_col)


def bpe_decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The texts of ids (binary: little-endian unsigned 32-bit integers) with the file at `path`: the bytes of all tokens, special ones too, one after the other, read as
    UTF-8, and replacement characters for what is none.

    Returns one row per input row: id, ids, text. Null ids are none and give an empty text; unknown ids are left out. Rows that repeat, null row ids
    and other columns make no difference; an empty table gives no rows; nothing is shuffled.
    """
    need(encoded, id_col, ids_col)
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches):
        spoken = vocabulary(path).spoken.get
        for batch in batches:
            for piece, ids in blocks(batch, 1, empty=b""):
                texts = [b"".join(spoken(i, b"") for i in np.frombuffer(x, "<u4").tolist()).decode("utf-8", "replace") for x in ids.to_pylist()]
                yield pa.RecordBatch.from_arrays([piece.column(0), ids, pa.array(texts, pa.string())], names=["id", "ids", "text"])

    out = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return out.mapInArrow(lean(run), f"id {kind}, ids binary, text string").withColumnRenamed("id", id_col)
