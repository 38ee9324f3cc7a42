"""Benchmark decontamination by Wu-Manber search over words."""

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Tables, Words, blocks, byte_class, grams, lean, need

WINDOW = 13
#: Words are what these bytes separate, once A-Z is lower-cased.
CLASSES = byte_class([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)], lower=True)
#: Bytes of item text in one block of patterns, but for a single longer item. A compiled block takes some 20 times as much in a task.
BLOCK_BYTES = 8_000_000


class WuManber:
    """The windows of items, in classes of equal length m. For each class: SHIFT by the hash of a block of two words (one where m is 1),
    and buckets, runs of equal suffix blocks in a sorted array, with the first block of each window; a direct comparison of words
    confirms. Windows stay places in the items' words; equal windows are one."""

    def __init__(self, items: list[tuple[str | None, str]], window: int = WINDOW):
        w = self.words = Words(pa.array([t for _, t in items], pa.large_string()), CLASSES)
        self.names = [name for name, _ in items]
        h, count = w.hashes(), np.diff(w.row)
        self.classes = []
        for m in np.unique(np.minimum(count, window)).tolist():
            if not m:
                continue
            mine = np.flatnonzero(np.minimum(count, window) == m)
            first = np.concatenate([np.arange(w.row[i], w.row[i + 1] - m + 1) for i in mine])
            item = np.repeat(mine, count[mine] - m + 1)
            block = min(2, m)
            tails, whole = grams(h, block), grams(h, m)
            order = np.lexsort((item, whole[first], tails[first + m - block]))
            first, item = first[order], item[order]
            # A window that equals the one before it, word by word, is the same pattern of another item.
            new = np.ones(len(first), bool)
            for k in np.flatnonzero(whole[first[1:]] == whole[first[:-1]]) + 1:
                new[k] = w.text(first[k], first[k] + m) != w.text(first[k - 1], first[k - 1] + m)
            start = np.flatnonzero(new)
            place, owner = first[start], np.append(start, len(first))
            bits = min(22, max(12, int(len(place) * (m - block + 1)).bit_length() + 2))
            shift = np.full(1 << bits, m - block + 1, np.int32)
            for j in range(m - block + 1):
                slot = (tails[place + j] >> np.uint64(64 - bits)).astype(np.int64)
                shift[slot] = np.minimum(shift[slot], m - block - j)
            self.classes.append((m, block, bits, shift, tails[place + m - block], tails[place], place, owner, item))

    def search(self, w: Words) -> tuple[np.ndarray, dict[int, set]]:
        """Which words lie inside an occurrence, and by text the items that occur."""
        h = w.hashes()
        hit, found = np.zeros(len(h) + 1, np.int32), defaultdict(set)
        for m, block, bits, shift, suffix, prefix, place, owner, item in self.classes:
            tails = grams(h, block)
            steps = shift[(tails >> np.uint64(64 - bits)).astype(np.int64)]
            # Where the search may stop: buckets that aren't empty and begin with the right block.
            ends = np.flatnonzero(steps == 0)
            ends = ends[ends >= m - block]
            low, high = np.searchsorted(suffix, tails[ends]), np.searchsorted(suffix, tails[ends], "right")
            fits = (high - low > 1) | ((high > low) & (prefix[np.minimum(low, len(prefix) - 1)] == tails[ends - m + block]))
            stops = dict(zip(ends[fits].tolist(), zip(low[fits].tolist(), high[fits].tolist(), strict=True), strict=True))
            steps = steps.tolist()
            for i in range(len(w.row) - 1):
                at, end = int(w.row[i]) + m - block, int(w.row[i + 1]) - block
                while at <= end:  # `at`: first word of the last block of a window
                    step = steps[at]
                    if step:
                        at += step
                        continue
                    first = at - m + block
                    for k in range(*stops.get(at, (0, 0))):
                        if prefix[k] == tails[first] and w.text(first, first + m) == self.words.text(place[k], place[k] + m):
                            hit[first] += 1
                            hit[first + m] -= 1
                            found[i].update(self.names[x] for x in item[owner[k] : owner[k + 1]])
                    at += 1
        return np.cumsum(hit[:-1]) > 0, found


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Finds in every whole text the windows of `window` words of every benchmark item (an item of fewer words is one window).

    Wu-Manber over words: a shift table on blocks of two words tells how far the search may skip; where it may
    not, the bucket of the suffix block lists the windows to compare, and only an equal run of words counts.
    Patterns are sent to the executors in blocks of about `block_bytes` of item text; a benchmark of one block
    needs no shuffle, a larger one is searched block by block and the hits are merged per document.

    Returns one row per document: id, n_words, n_hit (words inside an occurrence), items (sorted strings), n_items,
    items_sha256, contaminated (n_hit > 0 and 20 * n_hit >= n_words). A null text has no words. Items with the
    same words all count; an item without an id marks words, but is not listed. Repeated documents are judged
    each by itself. An empty benchmark leaves all clean.
    """
    need(docs, id_col, text_col)
    need(benchmark, item_id, item_text)
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("string").alias("id"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = max(1, -(-int(size) // block_bytes))
    part = F.pmod(F.xxhash64("id", "text"), F.lit(n))
    kind = docs.schema[id_col].dataType.simpleString()
    if n == 1:
        out = _scan(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), [tuple(r) for r in items.collect()], window, kind)
        out = out.withColumns({"n_hit": F.expr("cast(aggregate(hits, 0, (a, x) -> a + x.e - x.s) as long)")})
    else:
        tables = Tables(spark)
        rows = tables.put(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), "rows")
        total = None
        for k in range(n):
            found = _scan(rows.select(F.col("row").alias("id"), "text"), [tuple(r) for r in items.where(part == k).collect()], window, "bigint")
            found = tables.put(found.withColumnRenamed("id", "row"), "hits")
            total = found if total is None else total.unionByName(found)
        merged = total.groupBy("row").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("hits")).alias("hits"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
        # Covered words of overlapping runs: each run adds what lies beyond the runs before it.
        merged = merged.withColumn("n_hit", F.expr("aggregate(array_sort(hits), named_struct('n', 0L, 'to', 0L), (a, x) -> named_struct('n', a.n + greatest(0L, x.e - greatest(a.to, cast(x.s as long))), 'to', greatest(a.to, cast(x.e as long))), a -> a.n)"))
        out = rows.select("row", "id").join(merged, "row")
    names = F.array_sort("items")
    return out.select(
        F.col("id").alias(id_col), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"),
        F.expr("n_hit > 0 and 20 * n_hit >= n_words").alias("contaminated"), names.alias("items"), F.col("hits").alias("hit_runs"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents, with all their columns, that aren't contaminated. With one block of patterns each row is judged where it
    stands; with more, rows are numbered once, in a written table, and joined to the judgement. A null text has no words and is clean; rows
    that repeat are judged each by itself, ids aren't looked at; an empty benchmark keeps all rows, an empty table gives none."""
    need(docs, id_col, text_col)
    items = benchmark.select(F.col(item_id).cast("string").alias("id"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    if size > block_bytes:
        numbered = docs.select(F.monotonically_increasing_id().alias("_row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
        numbered = Tables(docs.sparkSession).put(numbered, "numbered")
        judged = decontaminate(numbered.select("_row", F.col(f"_doc.`{text_col}`").alias("text")), benchmark, window, block_bytes, "_row", "text", item_id, item_text)
        return numbered.join(judged.where("not contaminated").select("_row"), "_row", "left_semi").select("_doc.*")
    sent = docs.sparkSession.sparkContext.broadcast(WuManber([tuple(r) for r in items.collect()], window))

    @F.arrow_udf("boolean")
    def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        def judged(batches):
            for batch in batches:
                out = [np.zeros(0, bool)]
                for _, piece in blocks(pa.record_batch([batch], names=["t"]), 0):
                    w = Words(piece, CLASSES)
                    hit, _ = sent.value.search(w)
                    total = np.concatenate([[0], np.cumsum(hit)])
                    n, k = np.diff(w.row), total[w.row[1:]] - total[w.row[:-1]]
                    out.append(~((k > 0) & (20 * k >= n)))
                yield pa.array(np.concatenate(out))

        yield from lean(judged)(batches)

    return docs.where(clean(F.col(text_col).cast("string")))


def _scan(docs: DataFrame, items: list[tuple], window: int, kind: str) -> DataFrame:
    """Of each row: words, runs of hit words as [s, e), items that occur."""
    sent = docs.sparkSession.sparkContext.broadcast(WuManber(items, window))

    def scan(batches):
        matcher = sent.value
        for batch in batches:
            for piece, texts in blocks(batch, 1):
                w = Words(texts, CLASSES)
                hit, found = matcher.search(w)
                runs = []
                for i in range(len(w.row) - 1):
                    a, b = int(w.row[i]), int(w.row[i + 1])
                    if i not in found:
                        runs.append([])
                        continue
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit[a:b].astype(np.int8), [0]])))
                    runs.append([{"s": int(s), "e": int(e)} for s, e in zip(edge[::2], edge[1::2], strict=True)])
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array(np.diff(w.row).astype(np.int64)), pa.array(runs, pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))), pa.array([sorted(x for x in found.get(i, ()) if x is not None) for i in range(len(w.row) - 1)], pa.list_(pa.string()))],
                    names=["id", "n_words", "hits", "items"],
                )

    return docs.mapInArrow(lean(scan), f"id {kind}, n_words long, hits array<struct<s: int, e: int>>, items array<string>")

