"""Tokens of both sides with code-point offsets."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import PIECE, PROTECTED, TOKEN, is_content, is_protected, is_punctuation, segmented

TOKEN_TYPE = "array<struct<index: int, text: string, start: int, `end`: int, is_protected: boolean>>"


#: Tokens whose lengths are added up one by one; the sums of so many are added up in turn.
_RUN = 64


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def _ends(sizes: Column) -> Column:
    """Running sums of an array, in a number of steps that grows with its length: a sum over the runs before, and one inside the run."""
    last = F.greatest(F.size(sizes) - 1, F.lit(0))
    runs = F.transform(F.sequence(F.lit(0), (last / _RUN).cast("int")), lambda c: _sum(F.slice(sizes, c * _RUN + 1, _RUN)))
    before = _let(runs, lambda r: F.transform(r, lambda _, c: _sum(F.slice(r, 1, c))))
    place = lambda i: (i / _RUN).cast("int")
    return _let(before, lambda b: F.transform(sizes, lambda _, i: F.get(b, place(i)) + _sum(F.slice(sizes, place(i) * _RUN + 1, i % _RUN + 1))))


def token_texts(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def token_array(text: Column) -> Column:
    """Tokens of a text as structs; Catalyst only. Each piece is a token with the white space before it, so pieces adjoin and their
    lengths give the offsets."""
    pieces = F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))
    ended = _let(pieces, lambda p: F.arrays_zip(p.alias("piece"), _let(F.transform(p, lambda x: F.length(x)), _ends).alias("end")))

    def token(x, i):
        word = F.regexp_replace(x["piece"], r"(?U)\A[\s\x1c-\x1f]+", "")
        return _let(word, lambda w: F.struct(i.alias("index"), w.alias("text"), (x["end"] - F.length(w)).alias("start"), x["end"].alias("end"), is_protected(w).alias("is_protected")))

    return F.transform(ended, token)


def segment_array(pairs: DataFrame, column: str, segmenter: Callable[[str], Iterable[tuple[str, int, int]]], to: str) -> DataFrame:
    """Tokens by an injected segmenter, which gives (word, start, end) of a fragment. Protected spans are kept whole, words of
    white space are dropped. The segmenter runs in the Python workers."""
    protected = re.compile(PROTECTED.replace(r"\p{Nd}", r"\d"))
    kind = pa.list_(pa.struct([("index", pa.int32()), ("text", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("is_protected", pa.bool_())]))

    def one(text: str | None):
        if text is None:
            return None
        found, at = [], 0
        for m in [*protected.finditer(text), None]:
            stop = m.start() if m else len(text)
            found += [(w, a + at, b + at, False) for w, a, b in segmenter(text[at:stop]) if w.strip()]
            if m:
                found.append((m[0], m.start(), m.end(), True))
                at = m.end()
        found.sort(key=lambda x: (x[1], x[2]))
        return [{"index": i, "text": w, "start": a, "end": b, "is_protected": p} for i, (w, a, b, p) in enumerate(found)]

    @F.arrow_udf(TOKEN_TYPE)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([one(t) for t in texts.to_pylist()], kind)

    return pairs.withColumn(to, run(F.col(column)))


def load_segmenter() -> Callable[[str], Iterable[tuple[str, int, int]]]:
    """The usual Chinese segmenter, imported in the worker that needs it."""
    try:
        import jieba
    except ImportError as e:
        raise RuntimeError("Chinese text needs the jieba package or an injected segmenter") from e
    return lambda text: jieba.tokenize(text, mode="default")


def usual_segmenter(text: str) -> Iterable[tuple[str, int, int]]:
    """The segmenter where none is injected; it is looked for when the first segmented text comes, and fails there if it is missing."""
    return load_segmenter()(text)


def tokenize(pairs: DataFrame, segmenter: Callable | None = None) -> DataFrame:
    """Adds source_tokens and target_tokens. Sides whose language is segmented go to the segmenter (the usual one unless another is given);
    without languages, with a null language, or for any other one, the pattern is used."""
    for side in ("source", "target"):
        to, lang = f"{side}_tokens", f"{side}_language"
        if lang not in pairs.columns:
            pairs = pairs.withColumn(to, token_array(F.col(side)))
            continue
        other = F.coalesce(segmented(F.col(lang)), F.lit(False))
        # The pattern runs where the segmenter doesn't: rows stay where they are.
        plain = pairs.withColumn(to, F.when(~other, token_array(F.col(side))))
        pairs = segment_array(plain.withColumn("_cut", F.when(other, F.col(side))), "_cut", segmenter or usual_segmenter, "_words")
        pairs = pairs.withColumn(to, F.coalesce(to, "_words")).drop("_cut", "_words")
    return pairs


def token_rows(tokenized: DataFrame, following: bool = False) -> DataFrame:
    """Long form, with the token classes; with `following` also the text of the next token where that isn't protected, which is at hand as long as
    tokens stand in an array."""

    def side(s):
        tokens = F.col(f"{s}_tokens")
        if following:
            ahead = lambda i: F.get(tokens, i + 1)
            tokens = F.transform(tokens, lambda x, i: F.struct(*[x[c].alias(c) for c in ("index", "text", "start", "end", "is_protected")], F.when(~ahead(i)["is_protected"], ahead(i)["text"]).alias("following")))
        return F.struct(F.lit(s).alias("side"), tokens.alias("tokens"))

    rows = tokenized.select("pair_id", F.explode(F.array(side("source"), side("target"))).alias("x")).select("pair_id", "x.side", F.explode("x.tokens").alias("t"))
    more = [F.col("t.following").alias("following")] if following else []
    rows = rows.select("pair_id", "side", F.col("t.index").alias("idx"), "t.text", "t.start", "t.end", "t.is_protected", *more)
    return rows.withColumns({"is_content": is_content(F.col("text"), F.col("is_protected")), "is_punctuation": is_punctuation(F.col("text"))})
