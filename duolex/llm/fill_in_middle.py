"""Fill-in-middle transformation: texts are cut at whole units that a sparse checkpoint index finds."""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import blocks, lean, need

#: What stands before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: A checkpoint is recorded every so many units.
EVERY = 256
#: Bytes that one step of counting looks at.
STEP = 1 << 16
#: Of 100 documents so many stay plain; of 100 others so many begin with the suffix.
PLAIN, SUFFIX_FIRST = 10, 20

_LETTER = np.zeros(256, bool)
_LETTER[ord("A") : ord("Z") + 1] = _LETTER[ord("a") : ord("z") + 1] = True


def begins(part: np.ndarray, after_letter: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of UTF-8 bytes, which begin a unit (`[A-Za-z]+` or any other code point) and which begin a code point. `after_letter`: what is before them."""
    letter, point = _LETTER[part], (part & 0xC0) != 0x80
    unit = point.copy()
    unit[1:] &= ~(letter[1:] & letter[:-1])
    if after_letter and len(part) and letter[0]:
        unit[0] = False
    return unit, point


class Checkpoints:
    """The number of units and code points of a text, counted step by step, and of every `every`-th unit the byte and code point at which it
    begins. Any other unit is found by a binary search among these and a scan of fewer than `every` units behind."""

    def __init__(self, data: bytes, every: int = EVERY, step: int = STEP):
        self.raw, self.units, self.points = np.frombuffer(data, np.uint8), 0, 0
        self.at_unit, self.at_byte, self.at_point = [], [], []
        letter = False
        for at in range(0, len(self.raw), step):
            part = self.raw[at : at + step]
            unit, point = begins(part, letter)
            places = np.flatnonzero(unit)
            due = places[-self.units % every :: every]
            if len(due):
                self.at_unit += range(self.units + -self.units % every, self.units + len(places), every)
                self.at_byte += (at + due).tolist()
                self.at_point += (self.points + np.cumsum(point)[due] - 1).tolist()
            self.units += len(places)
            self.points += int(point.sum())
            letter = bool(_LETTER[part[-1]])

    def find(self, k: int) -> tuple[int, int]:
        """The byte and the code point at which unit k begins; those of the text's end if there are k units."""
        if k == self.units:
            return len(self.raw), self.points
        i = bisect_right(self.at_unit, k) - 1
        end = self.at_byte[i + 1] if i + 1 < len(self.at_byte) else len(self.raw)
        unit, point = begins(self.raw[self.at_byte[i] : end], False)
        place = int(np.flatnonzero(unit)[k - self.at_unit[i]])
        return self.at_byte[i] + place, self.at_point[i] + int(point[:place].sum())


def draws(seed: int, ident) -> list[int]:
    """Four numbers of 32 bits that seed and id decide."""
    told = hashlib.sha256(f"{seed}:{'' if ident is None else ident}".encode()).hexdigest()
    return [int(told[k : k + 8], 16) for k in range(0, 32, 8)]


def transform(data: bytes, ident, seed: int = 1, every: int = EVERY, step: int = STEP) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, code points of the prefix, of the middle, output) of one text."""
    index, (h1, h2, h3, h4) = Checkpoints(data, every, step), draws(seed, ident)
    if not data or h3 % 100 >= 100 - PLAIN or any(m.encode() in data for m in (PREFIX, SUFFIX, MIDDLE)):
        return index.units, "plain", None, None, data
    first, last = sorted((h1 % (index.units + 1), h2 % (index.units + 1)))
    (a, p), (b, q) = index.find(first), index.find(last)
    before, middle, behind = PREFIX.encode() + data[:a], MIDDLE.encode() + data[a:b], SUFFIX.encode() + data[b:]
    if h4 % 100 < SUFFIX_FIRST:
        return index.units, "spm", p, q - p, behind + before + middle
    return index.units, "psm", p, q - p, before + behind + middle


def fill_in_middle(docs: DataFrame, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", every: int = EVERY, step: int = STEP) -> DataFrame:
    """Each whole text in the order prefix, suffix, middle (psm) or suffix, prefix, middle (spm), or as it is (plain).

    A text is cut at units (`[A-Za-z]+` or any other code point). While they are counted, a sparse index keeps byte and code-point offsets of every
    `every`-th unit; a cut is a binary search in it and a short scan. Seed and id decide cuts and form, so reruns agree and nothing is shuffled. Texts that are
    empty or hold a marker stay plain, and so do some by chance.

    Returns one row per input row: id, n (units), form, prefix_chars, middle_chars (code points; null if plain), output. A null text is empty, a null id
    counts as an empty one, rows that repeat give equal rows, other columns are ignored, an empty table gives no rows. A text needs a few times its own size.
    """
    need(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for piece, texts in blocks(batch, 1):
                made = [transform(t, i, seed, every, step) for t, i in zip(texts.cast(pa.binary()).to_pylist(), piece.column(0).to_pylist(), strict=True)]
                n, form, prefix, middle, output = zip(*made, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).view(pa.string())],
                    names=["id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return out.mapInArrow(lean(run), f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string").withColumnRenamed("id", id_col)


def restored(form: str = "form", output: str = "output") -> Column:
    """The text that an output was made of, by its form alone. The parts hold no marker, so the first one of each kind is the one that was put there."""
    cut = lambda a, b: f"substring({output}, {a}, {b})"
    size = max(map(len, (PREFIX, SUFFIX, MIDDLE)))
    s, p = f"locate('{SUFFIX}', {output})", f"locate('{PREFIX}', {output})"
    m = f"locate('{MIDDLE}', {output})"
    tail = f"substring({output}, {m} + {size})"
    psm = f"concat({cut(size + 1, f'{s} - {size + 1}')}, {tail}, {cut(f'{s} + {size}', f'{m} - {s} - {size}')})"
    spm = f"concat({cut(f'{p} + {size}', f'{m} - {p} - {size}')}, {tail}, {cut(size + 1, f'{p} - {size + 1}')})"
    return F.expr(f"case {form} when 'psm' then {psm} when 'spm' then {spm} else {output} end")
