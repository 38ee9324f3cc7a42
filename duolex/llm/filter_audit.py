"""Filter interaction audit: what each filter removes in every order of the filters, by first-failure lookup."""

from __future__ import annotations

import hashlib
import re
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Tables, blocks, lean, need

#: The filters by letter: few words, few distinct words, many capitals, odd signs, a copy of a smaller id's text.
FILTERS = "ABCDE"
LEAST_WORDS = 50
#: Least share of distinct words and greatest share of capitals, in hundredths.
LEAST_DISTINCT, MOST_CAPITALS = 65, 5
SIGNS = b"#$%&*|"
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = len(FILTERS) + 1
#: Labels: 1 if good, plus 2 if toxic.
LABELS = 4
#: Parts that one task holds counts of; beyond that it hands them on and begins anew.
PARTS_HELD = 1000


def first_failures() -> np.ndarray:
    """For each set of failing filters (a bit each) and each order the step (from 0) that removes it; behind the last if none does."""
    out = np.full((1 << len(FILTERS), len(ORDERS)), len(FILTERS), np.int64)
    for mask in range(len(out)):
        for k, order in enumerate(ORDERS):
            steps = [i for i, f in enumerate(order) if mask >> FILTERS.index(f) & 1]
            if steps:
                out[mask, k] = steps[0]
    return out


def own_failures(data: bytes) -> int:
    """Bits of the filters A to D that a text of these bytes fails."""
    words = data.split()  # bytes split at \\x20 and \\x09 to \\x0D only
    points = len(data) - len(re.findall(rb"[\x80-\xBF]", data)) if not data.isascii() else len(data)
    capitals = len(data) - len(data.translate(None, CAPITALS))
    return (
        (len(words) < LEAST_WORDS)
        | (100 * len(set(words)) < LEAST_DISTINCT * len(words)) << 1
        | (100 * capitals > MOST_CAPITALS * points) << 2
        | (len(data.translate(None, SIGNS)) < len(data)) << 3
    )


def failures(docs: DataFrame, tables: Tables, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """Of each row (id, part, mask): the bits of all filters that its whole text fails. Texts are told by the 256 bits of their SHA-256; equal ones meet as one
    row of ids and digests, of which the least id is found by an aggregate, so a text with very many copies makes no large group."""
    kind = docs.schema[id_col].dataType.simpleString()

    def look(batches):
        for batch in batches:
            for piece, texts in blocks(batch, 2):
                data = texts.cast(pa.binary()).to_pylist()
                masks = pa.array([own_failures(t) for t in data], pa.int32())
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), masks, pa.array([hashlib.sha256(t).digest() for t in data], pa.binary())], names=["id", "part", "mask", "digest"])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = tables.put(rows.mapInArrow(lean(look), f"id {kind}, part string, mask int, digest binary"), "failures")
    least = rows.where("id is not null").groupBy("digest").agg(F.min("id").alias("id")).withColumn("least", F.lit(True))
    known = rows.where("id is not null").join(least, ["digest", "id"], "left")
    known = known.select("id", "part", F.when(F.col("least"), F.col("mask")).otherwise(F.col("mask") + (1 << FILTERS.index("E"))).alias("mask"))
    return known.unionByName(rows.where("id is null").select("id", "part", "mask"))


def count_removals(rows: DataFrame) -> DataFrame:
    """(part, at, n): removals of rows (part, mask, label) by order, step and label, `at` numbering the orders and n[STEPS x LABELS] flat."""
    table = first_failures()
    size = len(ORDERS) * STEPS * LABELS
    offset = np.arange(len(ORDERS)) * STEPS * LABELS

    def count(batches):
        parts: list[str] = []
        number: dict[str, int] = {}
        sums = np.zeros(0, np.int64)

        def told():
            whole = sums.reshape(len(parts) * len(ORDERS), STEPS * LABELS)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, whole.size + 1, STEPS * LABELS, dtype=np.int32)), pa.array(whole.ravel()))
            names = pa.array(np.repeat(np.array(parts, object), len(ORDERS)), pa.string())
            return pa.RecordBatch.from_arrays([names, pa.array(np.tile(np.arange(len(ORDERS), dtype=np.int32), len(parts))), flat], names=["part", "at", "n"])

        for batch in batches:
            for i in range(0, batch.num_rows, 4096):  # 120 places for each row
                some = batch.slice(i, 4096)
                coded = some.column(0).dictionary_encode()
                for x in coded.dictionary.to_pylist():
                    if x not in number:
                        number[x] = len(parts)
                        parts.append(x)
                own = np.array([number[x] for x in coded.dictionary.to_pylist()])[coded.indices.to_numpy()]
                mask, label = some.column(1).to_numpy(), some.column(2).to_numpy()
                places = own[:, None] * size + offset + table[mask] * LABELS + label[:, None]
                more = np.bincount(places.ravel(), minlength=len(parts) * size)
                more[: len(sums)] += sums
                sums = more
                if len(parts) >= PARTS_HELD:
                    yield told()
                    parts, number, sums = [], {}, np.zeros(0, np.int64)
        if parts:
            yield told()

    partial = rows.select("part", "mask", "label").mapInArrow(lean(count), "part string, at int, n array<bigint>")
    sums = partial.groupBy("part", "at").agg(*[F.sum(F.col("n")[i]).alias(f"n{i}") for i in range(STEPS * LABELS)])
    return sums.select("part", "at", F.array(*[f"n{i}" for i in range(STEPS * LABELS)]).alias("n"))


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """What each of five filters removes at each step of each of their 120 orders, by part.

    A text fails A if it has under 50 words, B if under 65 of 100 are distinct, C if over 5 of 100 code points are A-Z, D if it holds any of #$%&*|, E if a smaller id
    has the same text. Each row's set of failures is looked up in a table of 32 sets by 120 orders, which has the step that removes it; the places of part, order, step and
    label are counted by np.bincount in each task, and the partial arrays are summed. All other columns follow from these sums: what fails a filter is what it removes
    first of all, what fails it alone what it removes last of all.

    Returns one row per part, order and step: part, filter_order, step (from 1), kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley (its filter's
    removals over all orders). Null texts are empty, null parts are the empty string, null ids have no labels and are no copies, and no row is a copy of theirs; rows that repeat an id are
    rows each, and no copies of each other; a row is good or toxic if any label of its id says so, null labels say nothing. Other columns are ignored. Without
    documents there are no rows. Only ids, digests and sets are shuffled.
    """
    need(docs, id_col, text_col, part_col)
    need(labels, id_col, "quality", "toxic")
    tables = Tables(docs.sparkSession)
    rows = failures(docs, tables, id_col, text_col, part_col)
    told = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
    told = told.agg((F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)) + 2 * F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0))).alias("label"))
    known = rows.where("id is not null").join(told, "id", "left").select("part", "mask", F.coalesce("label", F.lit(0)).cast("int").alias("label"))
    rows = known.unionByName(rows.where("id is null").select("part", "mask", F.lit(0).alias("label")))
    sums = tables.put(count_removals(rows), "sums")
    orders = F.element_at(F.array(*map(F.lit, ORDERS)), F.col("at") + 1)
    at = lambda i, k: F.element_at("n", (i * LABELS + k + 1).cast("int"))
    step = F.col("step") - 1
    each = sums.select("part", orders.alias("filter_order"), F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"), "n")
    each = each.withColumns({
        "filter": F.substring(F.col("filter_order"), F.col("step"), F.lit(1)),
        "removed": at(step, 0) + at(step, 1) + at(step, 2) + at(step, 3),
        "good_lost": at(step, 1) + at(step, 3),
        "toxic_lost": at(step, 2) + at(step, 3),
        "kept": F.expr(f"aggregate(slice(n, step * {LABELS} + 1, {STEPS * LABELS}), 0L, (a, x) -> a + x)"),
    })
    own = Window.partitionBy("part", "filter")
    fails = F.max(F.when(F.col("step") == 1, F.col("removed"))).over(own)
    alone = F.max(F.when(F.col("step") == len(FILTERS), F.col("removed"))).over(own)
    return each.select("part", "filter_order", "step", "kept", "removed", (fails - F.col("removed")).alias("redundant"), alone.alias("unique_fails"), "good_lost", "toxic_lost", F.sum("removed").over(own).alias("shapley"))
