"""Cells of a pair's matrix: similarity, relative similarity, probabilities both ways. All windows share one hash partitioning by pair."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TEMPERATURE = 0.1
NEIGHBOURS = 3
ROW, COLUMN = ("pair_id", "s"), ("pair_id", "t")


def similarity(vectors: DataFrame) -> DataFrame:
    """(cos + 1) / 2 of every source and target token of a pair, clipped to [0, 1]. Norms are found once per token."""
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
    v = vectors.withColumn("norm", norm)
    s = v.where("side = 'source'").select("pair_id", F.col("idx").alias("s"), F.col("vec").alias("a"), F.col("norm").alias("na"))
    t = v.where("side = 'target'").select("pair_id", F.col("idx").alias("t"), F.col("vec").alias("b"), F.col("norm").alias("nb"))
    dot = F.aggregate(F.zip_with("a", "b", lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    sim = (F.when((F.col("na") > 0) & (F.col("nb") > 0), dot / (F.col("na") * F.col("nb"))).otherwise(0.0) + 1) / 2
    return s.join(t, "pair_id").select("pair_id", "s", "t", F.greatest(F.lit(0.0), F.least(F.lit(1.0), sim)).alias("sim"))


def _top(by: tuple[str, str]):
    other = "t" if by[1] == "s" else "s"
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("sim"), other))
    return rank, Window.partitionBy(*by)


def relative(cells: DataFrame, temperature: float = TEMPERATURE) -> DataFrame:
    """Adds rank_st, rank_ts and rel: how far a cell stands above the best neighbours of its row and column."""
    out = cells
    for by, rank, mean in ((ROW, "rank_st", "_row"), (COLUMN, "rank_ts", "_column")):
        r, w = _top(by)
        out = out.withColumn(rank, r).withColumn(mean, F.avg(F.when(F.col(rank) <= NEIGHBOURS, F.col("sim"))).over(w))
    z = (2 * F.col("sim") - F.col("_row") - F.col("_column")) / temperature
    z = F.greatest(F.lit(-60.0), F.least(F.lit(60.0), z))
    return out.withColumn("rel", 1 / (1 + F.exp(-z))).drop("_row", "_column")


def probabilities(cells: DataFrame, value: str = "rel", temperature: float = TEMPERATURE) -> DataFrame:
    """Adds p_st and p_ts: softmax of `value` over the row and over the column."""
    out = cells
    for by, name in ((ROW, "p_st"), (COLUMN, "p_ts")):
        w = Window.partitionBy(*by)
        e = F.exp((F.col(value) - F.max(value).over(w)) / temperature)
        out = out.withColumn("_e", e).withColumn(name, F.col("_e") / F.sum("_e").over(w)).drop("_e")
    return out


def cells(vectors: DataFrame, temperature: float = TEMPERATURE) -> DataFrame:
    return probabilities(relative(similarity(vectors), temperature), "rel", temperature)


def check_cells(cells: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Fails on the first cell with a score that isn't a number in [0, 1]; with `sizes` (pair_id, n_s, n_t) also on a pair whose cells aren't
    those of a whole matrix."""
    bad = F.lit(False)
    for c in ("sim", "rel", "p_st", "p_ts"):
        if c in cells.columns:
            bad = bad | F.col(c).isNull() | F.isnan(c) | ~F.col(c).between(0, 1)
    fail = lambda what: F.raise_error(F.concat(F.lit(f"ProcessingError: {what} in pair "), "pair_id"))
    out = cells.withColumn("sim", F.when(bad, fail("invalid score")).otherwise(F.col("sim")))
    if sizes is None:
        return out
    counted = out.withColumn("_n", F.count("*").over(Window.partitionBy("pair_id"))).join(sizes, "pair_id")
    outside = (F.col("_n") != F.col("n_s") * F.col("n_t")) | ~F.col("s").between(0, F.col("n_s") - 1) | ~F.col("t").between(0, F.col("n_t") - 1)
    return counted.withColumn("sim", F.when(outside, fail("wrong number of cells")).otherwise(F.col("sim"))).select(*cells.columns)
