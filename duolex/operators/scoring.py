"""Similarity and confidence of links."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cells import COLUMN, ROW


def bounded(c: Column) -> Column:
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), c)), 6)


def position(index: str, count: str) -> Column:
    return (F.col(index) + 0.5) / F.col(count)


def margins(cells: DataFrame, value: str = "rel") -> DataFrame:
    """Adds margin: mean over row and column of a cell's lead on its best competitor, 0 if it doesn't lead or has none."""
    out = cells
    for by, other, name in ((ROW, "t", "_mr"), (COLUMN, "s", "_mc")):
        w = Window.partitionBy(*by)
        out = out.withColumn("_rk", F.row_number().over(w.orderBy(F.desc(value), other)))
        out = out.withColumn("_second", F.max(F.when(F.col("_rk") == 2, F.col(value))).over(w))
        out = out.withColumn(name, F.when((F.col("_rk") == 1) & F.col("_second").isNotNull(), F.col(value) - F.col("_second")).otherwise(0.0))
    return out.withColumn("margin", (F.col("_mr") + F.col("_mc")) / 2).drop("_rk", "_second", "_mr", "_mc")


def dominated(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """For each point (whole numbers) how many have a smaller s and a smaller t. All points go down the bits of t at once: at each bit those before a point (by s)
    whose bit is 0 where its own is 1 are counted, and the points part into zeros and ones, each in their order. So n log n."""
    if not len(s):
        return np.zeros(0, np.int64)
    by_s = np.argsort(s, kind="stable")
    value = np.unique(t, return_inverse=True)[1]
    low, high = np.zeros(len(s), np.int64), np.searchsorted(s[by_s], s)  # the range of points that count, as it moves
    now, out = value[by_s], np.zeros(len(s), np.int64)
    for bit in range(max(1, int(value.max()).bit_length()) - 1, -1, -1):
        one = (now >> bit & 1).astype(bool)
        zeros = np.concatenate([[0], np.cumsum(~one)])
        mine = (value >> bit & 1).astype(bool)
        a, b = zeros[low], zeros[high]
        out += np.where(mine, b - a, 0)
        low, high = np.where(mine, zeros[-1] + low - a, a), np.where(mine, zeros[-1] + high - b, b)
        now = np.concatenate([now[~one], now[one]])
    return out


def kept_order(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """For each link (distinct ones) the share of those with both ends different that keep its order; 0.5 where there is none."""
    others = len(s) + 1 - np.bincount(s)[s] - np.bincount(t)[t]
    kept = dominated(s, t) + dominated(-s, -t)
    return np.where(others > 0, kept / np.maximum(others, 1), 0.5)


def order_scores(method_links: DataFrame) -> DataFrame:
    """For each link the mean over its methods of the share of other links (with both ends different) that keep its order; and
    in how many methods it is. One row per pair, its links, goes to a kernel that takes n log n steps."""
    packed = method_links.groupBy("pair_id").agg(F.collect_set(F.struct("method", F.col("s").cast("int").alias("s"), F.col("t").cast("int").alias("t"))).alias("links"))

    def run(batches):
        for b in batches:
            out = []
            for pair, items in zip(b.column(0), b.column(1), strict=True):
                items = items.values
                s, t = (items.field(k).to_numpy().astype(np.int64) for k in ("s", "t"))
                method = items.field("method").dictionary_encode().indices.to_numpy()
                share = np.zeros(len(s))
                for m in np.unique(method):
                    at = np.flatnonzero(method == m)
                    share[at] = kept_order(s[at], t[at])
                keys, at, n = np.unique(s * (t.max() + 1) + t, return_inverse=True, return_counts=True)
                ends = np.divmod(keys, t.max() + 1)
                out.append(pa.RecordBatch.from_arrays([pa.array([pair.as_py()] * len(keys), pa.string()), *(pa.array(x.astype(np.int32)) for x in ends), pa.array(np.bincount(at, weights=share) / n), pa.array(n.astype(np.int64))], names=["pair_id", "s", "t", "order_score", "n_in"]))
            if out:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()

    return packed.mapInArrow(run, "pair_id string, s int, t int, order_score double, n_in long")


def scores(n_methods: int) -> tuple[Column, Column]:
    """Similarity and confidence of links with sim, p_st, p_ts, margin, order_score, n_in, n_s, n_t."""
    away = 1 - F.abs(position("s", "n_s") - position("t", "n_t"))
    steady = bounded(0.7 * F.coalesce("order_score", F.lit(0.0)) + 0.3 * away)
    agreement = F.coalesce(F.col("n_in"), F.lit(0)) / n_methods if n_methods else F.lit(0.0)
    confidence = 0.35 * F.sqrt(F.col("p_st") * F.col("p_ts")) + 0.30 * F.col("margin") + 0.20 * agreement + 0.15 * steady
    return bounded(F.col("sim")), bounded(confidence)


def score_links(links: DataFrame, cells: DataFrame, method_links: DataFrame, sizes: DataFrame, n_methods: int, value: str = "rel") -> DataFrame:
    """Adds similarity and confidence to model links (pair_id, s, t, ...). sizes: pair_id, n_s, n_t."""
    key = ["pair_id", "s", "t"]
    out = links.join(cells if "margin" in cells.columns else margins(cells, value), key).join(order_scores(method_links), key, "left").join(sizes, "pair_id")
    similarity, confidence = scores(n_methods)
    return out.select(*links.columns, similarity.alias("similarity"), confidence.alias("confidence"))
