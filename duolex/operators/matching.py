"""Links of a pair by matching methods; ties go to the lowest index."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cells import _top, COLUMN, ROW

ALPHA, ROUNDS = 0.9, 2


def _ranked(cells: DataFrame) -> DataFrame:
    if "rank_st" in cells.columns:
        return cells
    return cells.withColumn("rank_st", _top(ROW)[0]).withColumn("rank_ts", _top(COLUMN)[0])


def forward(cells: DataFrame) -> DataFrame:
    return _ranked(cells).where("rank_st = 1").select("pair_id", "s", "t")


def reverse(cells: DataFrame) -> DataFrame:
    return _ranked(cells).where("rank_ts = 1").select("pair_id", "s", "t")


def inter(cells: DataFrame) -> DataFrame:
    """Mutual best cells."""
    return _ranked(cells).where("rank_st = 1 and rank_ts = 1").select("pair_id", "s", "t")


def itermax(cells: DataFrame, alpha: float = ALPHA, rounds: int = ROUNDS) -> DataFrame:
    """Mutual best cells in rounds: later rounds weigh cells with one linked end by alpha and leave out cells with two."""
    out = _ranked(cells).select("pair_id", "s", "t", "sim", ((F.col("rank_st") == 1) & (F.col("rank_ts") == 1)).alias("linked"))
    row, column = Window.partitionBy(*ROW), Window.partitionBy(*COLUMN)
    for _ in range(rounds - 1):
        ends = F.max(F.col("linked").cast("int")).over(row) + F.max(F.col("linked").cast("int")).over(column)
        out = out.withColumn("ends", ends).withColumn("w", F.when(F.col("ends") == 2, 0.0).when(F.col("ends") == 1, alpha * F.col("sim")).otherwise(F.col("sim")))
        best = F.row_number().over(row.orderBy(F.desc("w"), "t")) + F.row_number().over(column.orderBy(F.desc("w"), "s"))
        out = out.withColumn("best", best).withColumn("linked", F.col("linked") | ((F.col("best") == 2) & (F.col("w") > 0))).select("pair_id", "s", "t", "sim", "linked")
    return out.where("linked").select("pair_id", "s", "t")


def solve(weight: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    """(a matching of greatest weight, potentials of rows, of columns), every row or column of the shorter side used: shortest augmenting paths. The potentials prove
    it: no cell weighs more than the sum of its two, a matched one exactly that, and on the longer side none is negative and unmatched ones are 0; so the matching weighs
    what all potentials add up to, and none weighs more."""
    if weight.size == 0:
        return [], np.zeros(weight.shape[0]), np.zeros(weight.shape[1])
    flip = weight.shape[0] > weight.shape[1]
    cost = -(weight.T if flip else weight)
    n, m = cost.shape
    u, v = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)
    for i in range(n):
        best, via, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        row, last, low = i, -1, 0.0
        while True:
            reach = low + cost[row] - u[row] - v
            nearer = ~done & (reach < best)
            best[nearer], via[nearer] = reach[nearer], last
            column = int(np.argmin(np.where(done, np.inf, best)))
            low, last = best[column], column
            if owner[column] < 0:
                break
            done[column] = True
            row = owner[column]
        u[i] += low
        for j in np.flatnonzero(done):
            u[owner[j]] += low - best[j]
            v[j] -= low - best[j]
        while last >= 0:
            before = via[last]
            owner[last] = owner[before] if before >= 0 else i
            last = before
    ends = sorted((int(j), int(owner[j])) if flip else (int(owner[j]), int(j)) for j in range(m) if owner[j] >= 0)
    return (ends, -v, -u) if flip else (ends, -u, -v)


def assign(weight: np.ndarray) -> list[tuple[int, int]]:
    return solve(weight)[0]


_SOLVED = "pair_id string, side string, s int, t int, potential double"


def solved(cells: DataFrame) -> DataFrame:
    """Links of the maximum-weight matching (side null: s, t) and the potential of each token (side source: s, target: t): one row per pair goes to a kernel, no group is larger than
    a pair's matrix."""
    packed = cells.groupBy("pair_id").agg(F.collect_list(F.struct("s", "t", "sim")).alias("cells"))
    kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.float64())
    names = [x.split(" ")[0] for x in _SOLVED.split(", ")]

    def run(batches):
        for b in batches:
            rows = []
            for pair, items in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                s, t, sim = (items.values.field(k).to_numpy() for k in ("s", "t", "sim"))
                m = np.zeros((1 + s.max(), 1 + t.max()))
                m[s, t] = sim
                ends, row, column = solve(m)
                rows += [(pair, None, i, j, None) for i, j in ends if m[i, j] > 0]
                rows += [(pair, "source", i, None, x) for i, x in enumerate(row.tolist())]
                rows += [(pair, "target", None, j, x) for j, x in enumerate(column.tolist())]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return packed.mapInArrow(run, _SOLVED)


def mwmf(cells: DataFrame) -> DataFrame:
    """Maximum-weight matching."""
    return solved(cells).where("side is null").select("pair_id", "s", "t")


def certificate(cells: DataFrame, found: DataFrame, slack: float = 1e-9) -> DataFrame:
    """(pair_id, n_links, weight, dual, violated): whether the links and potentials of `found` (as of `solved`) prove each other. `violated` counts cells that weigh more than their
    potentials, links that weigh less, tokens with two links, and tokens of the longer side with a negative potential or, unlinked, with one; with none of them, and weight and dual
    the same, no matching weighs more. Every cell is looked at by joins with the potentials; the kernel isn't asked."""
    links = found.where("side is null").select("pair_id", "s", "t", F.lit(1).alias("linked"))
    potential = lambda side, c: found.where(F.col("side") == side).select("pair_id", c, F.col("potential").alias(f"p_{c}"))
    both = cells.select("pair_id", "s", "t", "sim").join(potential("source", "s"), ["pair_id", "s"]).join(potential("target", "t"), ["pair_id", "t"]).join(links, ["pair_id", "s", "t"], "left")
    over, under = F.col("sim") > F.col("p_s") + F.col("p_t") + slack, F.col("linked").isNotNull() & (F.col("sim") < F.col("p_s") + F.col("p_t") - slack)
    by_cell = both.groupBy("pair_id").agg(F.count("linked").alias("n_links"), F.sum(F.when(F.col("linked").isNotNull(), F.col("sim"))).alias("weight"), F.count_if(over | under).alias("bad_cells"), (F.count_distinct("s") >= F.count_distinct("t")).alias("s_longer"), (F.count_distinct("t") >= F.count_distinct("s")).alias("t_longer"))
    tokens = found.where("side is not null").select("pair_id", "side", F.coalesce("s", "t").alias("idx"), "potential")
    used = links.select("pair_id", F.explode(F.expr("array(struct('source' as side, s as idx), struct('target' as side, t as idx))")).alias("x")).groupBy("pair_id", "x.side", "x.idx").agg(F.count("*").alias("n"))
    by_token = tokens.join(used, ["pair_id", "side", "idx"], "left").join(by_cell, "pair_id")
    longer = F.when(F.col("side") == "source", F.col("s_longer")).otherwise(F.col("t_longer")) & ~(F.col("s_longer") & F.col("t_longer"))
    bad = (F.coalesce("n", F.lit(0)) > 1) | (longer & ((F.col("potential") < -slack) | (F.col("n").isNull() & (F.col("potential") > slack))))
    out = by_token.groupBy("pair_id", "n_links", "weight", "bad_cells").agg(F.sum("potential").alias("dual"), F.count_if(bad).alias("bad_tokens"))
    return out.select("pair_id", "n_links", "weight", "dual", (F.col("bad_cells") + F.col("bad_tokens")).alias("violated"))


MATCHERS = {"fwd": forward, "rev": reverse, "inter": inter, "itermax": itermax, "mwmf": mwmf}


def method_links(cells: DataFrame, methods: tuple[str, ...] = ("mwmf", "inter", "itermax")) -> DataFrame:
    out = None
    for m in methods:
        one = MATCHERS[m](cells).select("pair_id", F.lit(m).alias("method"), "s", "t")
        out = one if out is None else out.unionByName(one)
    return out


def normalise(links: DataFrame, sizes: DataFrame) -> DataFrame:
    """Whole indices inside the pair, each link once. sizes: pair_id, n_s, n_t."""
    typed = links.withColumns({"s": F.col("s").cast("int"), "t": F.col("t").cast("int")})
    return typed.join(sizes, "pair_id").where("s >= 0 and t >= 0 and s < n_s and t < n_t").drop("n_s", "n_t").distinct()
