"""Token counts of whole texts, huge ones by overlap resynchronisation."""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import blocks, need

#: Texts of more characters are encoded in chunks of so many.
CHUNK = 1 << 16
#: Characters that a chunk repeats of the one before; doubled as long as no boundary in them is proven.
OVERLAP = 256
LIMIT = 4096


@functools.lru_cache(2)
def processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@functools.lru_cache(2)
def joints(path: str) -> frozenset[str]:
    """Every pair of adjacent characters inside some piece of the vocabulary. A merge only ever makes pieces of the
    vocabulary, so none crosses a place whose two characters aren't among these pairs: on either side of it the
    text is encoded as if the other side were not there. That proves a boundary stable."""
    sp = processor(path)
    pairs = set()
    for i in range(sp.get_piece_size()):
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)):
            piece = sp.id_to_piece(i)
            pairs.update(piece[k : k + 2] for k in range(len(piece) - 1))
    return frozenset(pairs)


@functools.lru_cache(2)
def splits_at_spaces(path: str) -> bool:
    """Whether a space after another character is a proven boundary everywhere: no piece has one inside."""
    return not any(a != "▁" and b == "▁" for a, b in joints(path))


#: A run of spaces with the characters up to the next one. Spaces at the end of a text stay with what is before them.
UNIT = re.compile(r"[ ▁]*[^ ▁]+(?:[ ▁]+\Z)?")


class Units:
    """Counts short texts as the sum over their units between proven boundaries; a unit is encoded once and remembered."""

    def __init__(self, path: str, most: int = 200_000):
        self.path, self.most, self.known = path, most, {}

    def count(self, texts: list[str]) -> list[int]:
        sp, known = processor(self.path), self.known
        if not splits_at_spaces(self.path):
            return [len(x) for x in sp.encode(texts, num_threads=1)]
        # The library puts one space before a text; so a unit is given to it without its first space.
        parts = [UNIT.findall(f" {t}") for t in texts]
        new = list({u for x in parts for u in x if u not in known})
        for u, ids in zip(new, sp.encode([u[1:] for u in new], num_threads=1), strict=True):
            known[u] = len(ids)
        # Empty texts and texts of spaces alone have no unit.
        out = [sum(map(known.__getitem__, x)) if x else len(sp.encode(t)) for t, x in zip(texts, parts, strict=True)]
        if len(known) > self.most:
            known.clear()
        return out


def boundaries(path: str, text: str) -> tuple[list[int], int]:
    """Character offsets in `text` at which tokens begin, and the number of tokens."""
    tokens = processor(path).encode(text, return_type="proto").pieces
    begins = np.fromiter((t.begin for t in tokens), np.int64, len(tokens))  # in bytes
    lead = (np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80
    return np.concatenate([[0], np.cumsum(lead)])[begins].tolist(), len(tokens)


def count_by_chunks(path: str, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of `text`. Chunk i + 1 begins inside chunk i; both encodings are spliced at a place in the overlap where
    each has a token boundary and no piece of the vocabulary could join the characters at its sides. Where there is
    none, the overlap is doubled, up to the whole of both chunks; then the chunks are made one."""
    sp, pairs = processor(path), joints(path)
    shown = lambda c: "▁" if c == " " else c
    total, at, size = 0, 0, chunk  # `at`: a proven boundary; what lies before it has been counted
    lead = 0  # characters before `at` that this chunk repeats
    while True:
        begin, end = at - lead, min(len(text), at + size)
        starts, n = boundaries(path, text[begin:end])
        before = sum(1 for s in starts if begin + s < at)
        if end == len(text):
            return total + n - before
        # The next chunk begins `wide` before the end of this one.
        wide, found = overlap, None
        starts_here = {begin + s for s in starts}
        while found is None:
            new = max(at + 1, end - wide)
            far = min(len(text), end + wide)
            theirs = {new + s for s in boundaries(path, text[new:far])[0]}
            for x in range(end - 1, new, -1):
                if x in starts_here and x in theirs and shown(text[x - 1]) + shown(text[x]) not in pairs:
                    found = (x, x - new)
                    break
            if found is None and new == at + 1:
                break
            wide *= 2
        if found is None:  # nothing proven in all of this chunk: a longer one
            size *= 2
            continue
        splice, lead_next = found
        total += sum(1 for s in starts if at <= begin + s < splice)
        at, lead, size = splice, lead_next, chunk


def count_tokens(docs: DataFrame, model_path: str, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every whole text as the sentencepiece library gives them, without added tokens.

    Texts of up to `chunk` characters are cut at spaces where the vocabulary proves a boundary, and each distinct unit is
    encoded once (whole, if the vocabulary proves nothing); longer ones chunk by chunk with overlaps that are spliced at
    proven boundaries, so memory is bounded by a few chunks. Returns one row per document: id, n_bytes, n_tokens,
    over_limit. A null text is empty: 0 bytes, 0 tokens. Rows that repeat are counted each by itself, a null id stays null, an
    empty table gives no rows, other columns are ignored. Nothing is shuffled; `model_path` must exist on every executor.
    """
    need(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()

    def scan(batches):
        units = Units(model_path)
        for batch in batches:
            for piece, texts in blocks(batch, 1, 1_000_000):
                values = texts.to_pylist()
                counts = [0] * len(values)
                short = [i for i, t in enumerate(values) if len(t) <= chunk]
                for i, n in zip(short, units.count([values[i] for i in short]), strict=True):
                    counts[i] = n
                for i, t in enumerate(values):
                    if len(t) > chunk:
                        counts[i] = count_by_chunks(model_path, t, chunk, overlap)
                n = pa.array(counts, pa.int64())
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.compute.binary_length(texts).cast(pa.int64()), n, pa.compute.greater(n, limit)], names=["id", "n_bytes", "n_tokens", "over_limit"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(scan, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("id", id_col)
