"""Exact dedup by distributed MSD radix partitioning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Tables, need, text_or_empty

#: Bytes of the first digit; each later digit is GROWTH times as wide, up to WIDEST.
FIRST, GROWTH, WIDEST = 64, 64, 1 << 20


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of the rows with equal texts the one with the largest id stays.

    Texts are split by successive bytes: a round deals the rows of a group by their next run of bytes (a wide
    digit), and a group is done when it has one row or its texts have ended. Rows are equal only when every
    byte was equal; no digest takes part. A round counts the digits of all groups (combined before the
    shuffle), then joins the counts to the rows, so a hot group is a skewed join that Spark splits. Only rows
    of unfinished groups go to the next round, with the bytes they have left.

    Returns one row per input row: id, keep_id (id of the row that stays), group_size, kept, text_sha256.
    A null text counts as empty; a null id is smaller than any other. Where rows repeat an id and a text, one
    of them stays (they can't be told apart). An empty table gives an empty result. Other columns are ignored.
    """
    need(docs, id_col, text_col)
    tables = Tables(docs.sparkSession)
    longest = docs.agg(F.max(F.octet_length(text_or_empty(text_col)))).first()[0] or 0
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).cast("binary").alias("rest"), F.lit(0).cast("long").alias("grp"))
    rows = rows.withColumn("sha", F.sha2("rest", 256))
    depth, width, done = 0, FIRST, []
    while True:
        digit = F.substring("rest", 1, width)
        dealt = rows.withColumns({"digit": digit, "ended": F.octet_length("rest") <= width})
        counts = dealt.groupBy("grp", "digit", "ended").agg(F.count("*").alias("n"))
        counts = tables.put(counts.where("n > 1").withColumn("next", F.monotonically_increasing_id()), "digits")
        key = ["grp", "digit", "ended"]
        # The counts grow with the input: merged at every size, never broadcast.
        split = dealt.join(counts.hint("merge"), key, "left").select(
            "id", "sha", F.col("next").alias("grp"), "n", F.expr("n is null").alias("single"),
            F.coalesce("ended", F.lit(True)).alias("ended"), F.when(F.expr("n > 1 and not ended"), F.expr(f"substring(rest, {width + 1})")).alias("rest"),
        )
        split = tables.put(split.withColumn("row", F.monotonically_increasing_id()), "split")
        tables.sweep()
        alone = split.where("single").select("id", "sha", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
        over = split.where("not single and ended")
        stay = tables.put(over.groupBy("grp").agg(F.max(F.struct("id", "row")).alias("stay"), F.count("*").alias("group_size")), "stay")
        same = over.join(stay, "grp").select("id", "sha", F.col("stay.id").alias("keep_id"), "group_size", (F.col("stay.row") == F.col("row")).alias("kept"))
        done += [alone, same]
        depth += width
        if depth >= longest:
            break
        rows = split.where("not single and not ended").select("id", "rest", "grp", "sha")
        width = min(width * GROWTH, WIDEST)
    out = reduce(DataFrame.unionByName, done)
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))
