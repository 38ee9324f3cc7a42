"""Long pairs without their matrix: blocks of tokens meet tile by tile, and each row and column keeps a small state that merges.

A tile is WIDTH source tokens by WIDTH target tokens of a pair. It is made, looked at and dropped in one task; what leaves it is a state for each of
its rows and columns, in any order merged to the same result. So a pair's texts may have any length: a task holds one tile and one state."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.staging import staged
from .cells import NEIGHBOURS, TEMPERATURE
from .matching import ALPHA, ROUNDS

WIDTH = 256
#: What a cell's similarity is multiplied by if none, one or both of its ends are linked.
_FACTORS = lambda alpha: np.array([1.0, alpha, 0.0])


# ---------------------------------------------------------------- states
def best_of(m: np.ndarray, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
    """The k greatest values of each row, falling, and their columns; the lower column first of equal ones. -inf and -1 where there are fewer."""
    m, rows = m.copy(), np.arange(len(m))
    value, at = np.full((len(m), k), -np.inf), np.full((len(m), k), -1)
    for j in range(min(k, m.shape[1])):
        at[:, j] = m.argmax(axis=1)
        value[:, j] = m[rows, at[:, j]]
        m[rows, at[:, j]] = -np.inf
    return value, at


def merge_best(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The state of both sets of columns together."""
    k = a[0].shape[1]
    value, at = np.concatenate([a[0], b[0]], axis=1), np.concatenate([a[1], b[1]], axis=1)
    order = np.lexsort((at, -value), axis=1)[:, :k]
    return np.take_along_axis(value, order, axis=1), np.take_along_axis(at, order, axis=1)


def total_of(m: np.ndarray, temperature: float) -> tuple[np.ndarray, np.ndarray]:
    """Of each row its maximum and the sum of exponentials below it."""
    top = m.max(axis=1)
    return top, np.exp((m - top[:, None]) / temperature).sum(axis=1)


def merge_total(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], temperature: float) -> tuple[np.ndarray, np.ndarray]:
    top = np.maximum(a[0], b[0])
    return top, a[1] * np.exp((a[0] - top) / temperature) + b[1] * np.exp((b[0] - top) / temperature)


# ---------------------------------------------------------------- tiles
def similarity_tile(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(cos + 1) / 2, clipped. Products are added dimension by dimension, so equal vectors give equal cells in whatever tile they stand."""
    dot, na, nb = np.zeros((len(a), len(b))), np.zeros(len(a)), np.zeros(len(b))
    for k in range(a.shape[1]):
        dot += a[:, k, None] * b[None, :, k]
        na += a[:, k] * a[:, k]
        nb += b[:, k] * b[:, k]
    norm = np.sqrt(na)[:, None] * np.sqrt(nb)
    return np.clip((np.divide(dot, norm, out=np.zeros_like(dot), where=norm > 0) + 1) / 2, 0.0, 1.0)


def relative_tile(sim: np.ndarray, row_mean: np.ndarray, column_mean: np.ndarray, temperature: float) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip((2 * sim - row_mean[:, None] - column_mean) / temperature, -60.0, 60.0)))


_BLOCK = "pair_id string, side int, block int"
_KINDS = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "array<double>": pa.list_(pa.float64()), "array<int>": pa.list_(pa.int32())}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split(" ") for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, (_, k) in zip(list(zip(*rows, strict=True)) or [()] * len(fields), fields, strict=True)], names=[n for n, _ in fields])


def token_blocks(vectors: DataFrame, width: int | None = WIDTH) -> DataFrame:
    """(pair_id, side, block, n, vec): the vectors of up to `width` tokens (null: all of a side) one after the other; side 0 is the source."""
    side = (F.col("side") == "target").cast("int")
    block = F.floor(F.col("idx") / width).cast("int") if width else F.lit(0)
    held = F.array_sort(F.collect_list(F.struct("idx", "vec")))
    return vectors.groupBy("pair_id", side.alias("side"), block.alias("block")).agg(F.count("*").cast("int").alias("n"), F.flatten(F.transform(held, lambda x: x["vec"])).alias("vec"))


def _by_tile(blocks: DataFrame, links: DataFrame | None = None, width: int | None = None) -> DataFrame:
    """Rows sorted by tile (pair_id, x, y): its source block, its target block and, if given, the links in it. A block goes to all tiles of its row or column."""
    number = lambda side: F.max(F.when(F.col("side") == side, F.col("block") + 1))
    counts = blocks.groupBy("pair_id").agg(number(0).alias("xs"), number(1).alias("ys")).where("xs is not null and ys is not null")
    met = blocks.join(counts, "pair_id").withColumn("other", F.explode(F.expr("sequence(0, if(side = 0, ys, xs) - 1)")))
    place = [F.expr("if(side = 0, block, other)").alias("x"), F.expr("if(side = 0, other, block)").alias("y")]
    columns = [c for c in blocks.columns if c not in ("pair_id", "side", "block")]
    out = met.select("pair_id", *place, "side", *columns)
    if links is not None:
        at = lambda c: (F.floor(F.col(c) / width) if width else F.lit(0)).cast("int")
        within = links.groupBy("pair_id", at("s").alias("x"), at("t").alias("y")).agg(F.lit(2).alias("side"), F.collect_set(F.struct(F.col("s").cast("int").alias("s"), F.col("t").cast("int").alias("t"))).alias("links"))
        out = out.unionByName(within, allowMissingColumns=True)
    return out.repartition("pair_id", "x", "y").sortWithinPartitions("pair_id", "x", "y", "side")


def _tiles(batches, columns: list[str]):
    """Of rows sorted by tile, each tile's key and its rows by side. Holds one tile."""
    now, held = None, {}
    for b in batches:
        for i in range(b.num_rows):
            row = b.slice(i, 1)
            key = tuple(row.column(k)[0].as_py() for k in range(3))
            if key != now:
                if held:
                    yield now, held
                now, held = key, {}
            held[row.column(3)[0].as_py()] = {c: row.column(4 + k) for k, c in enumerate(columns)}
    if held:
        yield now, held


def _values(x: pa.Array) -> np.ndarray:
    return x[0].values.to_numpy(zero_copy_only=False)


_BEST = f"{_BLOCK}, value array<double>, at array<int>"


def _extremes(blocks: DataFrame, width: int | None, alpha: float) -> DataFrame:
    """(pair_id, side, block, value, at): the merged state of each token's NEIGHBOURS best cells, flat, by similarity; if blocks have `linked`, by what is left
    of it for cells with linked ends."""
    flags = "linked" in blocks.columns
    columns = ["n", "vec", *(["linked"] if flags else [])]

    def scan(batches):
        out, size = [], 0
        for (pair, x, y), tile in _tiles(batches, columns):
            if not {0, 1} <= tile.keys():
                continue
            a, b = (_values(tile[k]["vec"]).reshape(tile[k]["n"][0].as_py(), -1) for k in (0, 1))
            m = similarity_tile(a, b)
            if flags:
                ends = [_values(tile[k]["linked"]) for k in (0, 1)]
                m = m * _FACTORS(alpha)[ends[0][:, None] + ends[1]]
            for side, block, other, state in ((0, x, y, best_of(m)), (1, y, x, best_of(m.T))):
                value, at = state
                out.append((pair, side, block, value.ravel(), np.where(at >= 0, at + other * (width or 0), -1).ravel()))
                size += at.size
            if size > 200_000:
                yield _batch(out, _BEST)
                out, size = [], 0
        yield _batch(out, _BEST)

    def merge(batches):
        yield from _merged(batches, lambda r: tuple(_values(r.column(k)).reshape(-1, NEIGHBOURS) for k in (3, 4)), merge_best, lambda s: (s[0].ravel(), s[1].ravel()), _BEST)

    states = _by_tile(blocks).select("pair_id", "x", "y", "side", *columns).mapInArrow(scan, _BEST)
    return states.repartition("pair_id", "side", "block").sortWithinPartitions("pair_id", "side", "block").mapInArrow(merge, _BEST)


def _merged(batches, read, merge, write, schema: str):
    """Folds the states of rows sorted by block; holds one state."""
    now, state, out = None, None, []
    for b in batches:
        for i in range(b.num_rows):
            row = b.slice(i, 1)
            key = tuple(row.column(k)[0].as_py() for k in range(3))
            mine = read(row)
            if key != now:
                if now:
                    out.append((*now, *write(state)))
                now, state = key, mine
            else:
                state = merge(state, mine)
        if len(out) > 1000:
            yield _batch(out, schema)
            out = []
    if now:
        out.append((*now, *write(state)))
    yield _batch(out, schema)


def _by_token(states: DataFrame, width: int | None) -> DataFrame:
    """(pair_id, side, idx, at): each token's best column or row."""
    first = F.expr(f"transform(sequence(0, size(at) - 1, {NEIGHBOURS}), i -> at[i])")
    return states.select("pair_id", "side", "block", F.posexplode(first).alias("k", "at")).select("pair_id", "side", (F.col("block") * (width or 0) + F.col("k")).alias("idx"), "at")


def tiled_links(vectors: DataFrame, width: int | None = WIDTH, alpha: float = ALPHA, rounds: int = ROUNDS) -> DataFrame:
    """(pair_id, method, s, t): best columns (fwd), best rows (rev), mutual ones (inter) and those in rounds (itermax), as `matching` finds them in the whole matrix."""
    blocks = staged(token_blocks(vectors, width), "blocks")
    out, linked = None, None
    for k in range(rounds):
        told = blocks
        if linked is not None:
            at = lambda c: (F.floor(F.col(c) / width) if width else F.lit(0)).cast("int")
            ends = linked.select("pair_id", F.explode(F.expr("array(struct(0 as side, s as idx), struct(1 as side, t as idx))")).alias("x")).select("pair_id", "x.side", "x.idx").distinct()
            ends = ends.groupBy("pair_id", "side", at("idx").alias("block")).agg(F.collect_set(F.expr(f"idx % {width}" if width else "idx")).alias("on"))
            told = blocks.join(ends, ["pair_id", "side", "block"], "left").withColumn("linked", F.expr("transform(sequence(0, n - 1), i -> if(coalesce(array_contains(`on`, i), false), 1, 0))")).drop("on")
        best = _by_token(_extremes(told, width, alpha), width)
        if k == 0:
            best = staged(best, "best")
        forward = best.where("side = 0").select("pair_id", F.col("idx").alias("s"), F.col("at").alias("t"))
        reverse = best.where("side = 1").select("pair_id", F.col("at").alias("s"), F.col("idx").alias("t"))
        mutual = forward.join(reverse, ["pair_id", "s", "t"])
        named = lambda df, m: df.select("pair_id", F.lit(m).alias("method"), "s", "t")
        if k == 0:
            out = named(forward, "fwd").unionByName(named(reverse, "rev")).unionByName(named(mutual, "inter"))
            linked = mutual
        else:
            # Cells with two linked ends weigh nothing: where such a cell is a row's best, the row is done.
            used = lambda c: linked.select("pair_id", c).distinct().withColumn(f"{c}_used", F.lit(True))  # noqa: B023, E731
            mutual = mutual.join(used("s"), ["pair_id", "s"], "left").join(used("t"), ["pair_id", "t"], "left").where("s_used is null or t_used is null").select("pair_id", "s", "t")
            if alpha <= 0:
                mutual = mutual.limit(0)
            linked = linked.unionByName(mutual)
        linked = staged(linked, "linked")
    return out.unionByName(named(linked, "itermax"))


_SECOND = f"{_BLOCK}, at array<int>, lead array<double>, top array<double>, total array<double>"
_CELL = f"{_SECOND}, s int, t int, sim double, rel double"


def tiled_cells(vectors: DataFrame, links: DataFrame, width: int | None = WIDTH, temperature: float = TEMPERATURE) -> DataFrame:
    """(pair_id, s, t, sim, rel, p_st, p_ts, margin) of the cells of `links` (pair_id, s, t) alone, as `cells` and `margins` find them in the whole matrix. Two passes over the
    tiles: the first one finds the means of each token's best neighbours, the second one the states of rows and columns of the relative matrix."""
    blocks = staged(token_blocks(vectors, width), "blocks")
    mean = F.expr(f"transform(sequence(0, size(value) - 1, {NEIGHBOURS}), i -> aggregate(filter(slice(value, i + 1, {NEIGHBOURS}), x -> x >= 0D), named_struct('n', 0, 'x', 0D), (a, x) -> named_struct('n', a.n + 1, 'x', a.x + x), a -> a.x / a.n))")
    told = blocks.join(_extremes(blocks, width, ALPHA).select("pair_id", "side", "block", mean.alias("mean")), ["pair_id", "side", "block"])
    columns = ["n", "vec", "mean", "links"]

    def scan(batches):
        out, size = [], 0
        for (pair, x, y), tile in _tiles(batches, columns):
            if not {0, 1} <= tile.keys():
                continue
            a, b = (_values(tile[k]["vec"]).reshape(tile[k]["n"][0].as_py(), -1) for k in (0, 1))
            sim = similarity_tile(a, b)
            rel = relative_tile(sim, _values(tile[0]["mean"]), _values(tile[1]["mean"]), temperature)
            for side, block, other, m in ((0, x, y, rel), (1, y, x, rel.T)):
                value, at = best_of(m, 2)
                top, total = total_of(m, temperature)
                out.append((pair, side, block, np.where(at >= 0, at + other * (width or 0), -1).ravel(), value.ravel(), top, total, None, None, None, None))
                size += at.size
            if 2 in tile:
                for link in tile[2]["links"][0].as_py():
                    i, j = link["s"] - x * (width or 0), link["t"] - y * (width or 0)
                    out.append((pair, None, None, None, None, None, None, link["s"], link["t"], sim[i, j], rel[i, j]))
                    size += 1
            if size > 200_000:
                yield _batch(out, _CELL)
                out, size = [], 0
        yield _batch(out, _CELL)

    def merge(batches):
        read = lambda r: ((_values(r.column(4)).reshape(-1, 2), _values(r.column(3)).reshape(-1, 2)), (_values(r.column(5)), _values(r.column(6))))
        both = lambda a, b: (merge_best(a[0], b[0]), merge_total(a[1], b[1], temperature))
        # What a token's best cell leads by; no lead without a second one.
        write = lambda s: (s[0][1][:, 0], np.where(s[0][1][:, 1] >= 0, s[0][0][:, 0] - np.where(s[0][1][:, 1] >= 0, s[0][0][:, 1], 0.0), 0.0), *s[1])
        yield from _merged(batches, read, both, write, _SECOND)

    made = staged(_by_tile(told, links, width).select("pair_id", "x", "y", "side", *columns).mapInArrow(scan, _CELL), "tiles")
    names = _SECOND.split(", ")
    states = made.where("side is not null").select(*[x.split(" ")[0] for x in names])
    states = states.repartition("pair_id", "side", "block").sortWithinPartitions("pair_id", "side", "block").mapInArrow(merge, _SECOND)
    token = states.select("pair_id", "side", "block", F.posexplode(F.arrays_zip("at", "lead", "top", "total")).alias("k", "x"))
    token = staged(token.select("pair_id", "side", (F.col("block") * (width or 0) + F.col("k")).alias("idx"), "x.*"), "states")
    end = lambda side, c: token.where(F.col("side") == side).select("pair_id", F.col("idx").alias(c), *[F.col(v).alias(f"{c}_{v}") for v in ("at", "lead", "top", "total")])
    cells = made.where("s is not null").select("pair_id", "s", "t", "sim", "rel").join(end(0, "s"), ["pair_id", "s"]).join(end(1, "t"), ["pair_id", "t"])
    p = lambda c: F.exp((F.col("rel") - F.col(f"{c}_top")) / temperature) / F.col(f"{c}_total")
    lead = lambda c, other: F.when(F.col(f"{c}_at") == F.col(other), F.col(f"{c}_lead")).otherwise(0.0)
    return cells.select("pair_id", "s", "t", "sim", "rel", p("s").alias("p_st"), p("t").alias("p_ts"), ((lead("s", "t") + lead("t", "s")) / 2).alias("margin"))
