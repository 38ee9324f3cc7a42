"""Sharding by a Feistel permutation of global row numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Tables, need, text_or_empty

PRIME = (1 << 31) - 1
ROUNDS = 6


def round_keys(seed: int) -> list[tuple[int, int, int]]:
    """Three numbers below PRIME for each round, by a linear congruence from the seed."""
    keys, x = [], seed % PRIME
    for _ in range(ROUNDS):
        three = []
        for _ in range(3):
            x = (x * 48271 + 11) % PRIME
            three.append(x or 1)
        keys.append(tuple(three))
    return keys


def half_bits(n: int) -> int:
    """Bits of each half, so that both together number at least n rows."""
    return max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)


def permute(index: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The place of each row number below n: a Feistel network, walked until it falls below n again."""
    bits = half_bits(n)
    if bits > 30:
        raise ValueError("more than 2**60 rows")
    mask, keys = (1 << bits) - 1, round_keys(seed)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> bits, x & mask
        for a, b, c in keys:
            t = (right * a + b) % PRIME
            left, right = right, left ^ (((t * t + c) % PRIME) & mask)
        return left << bits | right

    out = once(index.astype(np.int64))
    while len(astray := np.flatnonzero(out >= n)):
        out[astray] = once(out[astray])
    return out


def number_rows(rows: DataFrame, order: list[str], tables: Tables, name: str = "n") -> tuple[DataFrame, int]:
    """Numbers all rows from 0 in the given order: range partitions sorted each by itself, plus the number of rows before each."""
    spark = rows.sparkSession
    by = [F.col(c).asc_nulls_last() for c in order]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    at = F.monotonically_increasing_id()
    local = tables.put(ranged.withColumns({"_part": F.shiftright(at, 33), "_at": at.bitwiseAND((1 << 33) - 1)}), "ranged")
    sizes = local.groupBy("_part").agg(F.count("*").alias("_rows"))
    # One row for each range partition, so a single task may add them up.
    before = sizes.withColumn("_before", F.coalesce(F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    total = sizes.agg(F.sum("_rows")).first()[0] or 0
    out = local.join(F.broadcast(before.select("_part", "_before")), "_part").withColumn(name, F.col("_before") + F.col("_at"))
    return out.drop("_part", "_at", "_before", "_rows"), total


def shard_rows(docs: DataFrame, shards: int = 8, seed: int = 20240229, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deals all rows to shards under the `rows` law: shard sizes in rows are at most one apart.

    Rows are numbered globally by (id, crc32, size), nulls last; the number goes through a Feistel network over
    the next even power of two, cycle-walked into range. From place p, the shard is p mod shards and the slot
    p div shards, so both can be computed for any row number without a look at the data, and a rerun gives the
    same. Only id, size and crc32 are shuffled, never the text.

    Returns one row per input row: id, size (UTF-8 bytes plus 1), text_crc32, law, shard, slot, grown_shard (null:
    another shard count deals all rows anew under this law), row_number. A null text has size 1 and the crc32 of
    nothing. Rows equal in id, crc32 and size get different slots, in any order. An empty table gives no rows.
    """
    need(docs, id_col, text_col)
    if shards < 1:
        raise ValueError("shards must be positive")
    tables = Tables(docs.sparkSession)
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"))
    numbered, total = number_rows(rows, ["id", "crc", "size"], tables)

    def place(batches):
        for b in batches:
            p = permute(b.column(3).to_numpy(), total, seed)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array((p % shards).astype(np.int32)), pa.array(p // shards)], names=["id", "size", "crc", "n", "shard", "slot"])

    schema = f"id {rows.schema['id'].dataType.simpleString()}, size long, crc long, n long, shard int, slot long"
    out = numbered.select("id", "size", "crc", "n").mapInArrow(place, schema)
    return out.select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), F.col("n").alias("row_number"),
    )


def shard_documents(docs: DataFrame, shards: int = 8, seed: int = 20240229, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with all their columns, their shard and their slot (columns of these names are replaced). Rows are
    numbered once, in a written table, so that rows which repeat an id keep apart; null ids and null texts are placed like any
    others (a null text has size 1), other columns go along, an empty table gives no rows."""
    tables = Tables(docs.sparkSession)
    packed = docs.select(F.monotonically_increasing_id().alias("_row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    packed = tables.put(packed, "rows")
    keyed = packed.select(F.struct(F.col(f"_doc.`{id_col}`").alias("d"), F.col("_row").alias("r")).alias("key"), F.col(f"_doc.`{text_col}`").alias("text"))
    placed = shard_rows(keyed, shards, seed, "key", "text").select(F.col("key.r").alias("_row"), "shard", "slot")
    placed = tables.put(placed, "placed")
    columns = [F.col(f"_doc.`{c}`") for c in docs.columns if c.lower() not in ("shard", "slot")]
    return packed.join(placed.hint("merge"), "_row").select(*columns, "shard", "slot")
