"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, Tables, need, text_or_empty

WEIGHTS = (1, 2, 3)
MOST_REPEATS = 3
#: A block is the documents of a source whose hashes share so many leading bits.
BLOCK_BITS = 8
#: Leading bits by which the one block that is taken in part is looked through, before its documents are.
FINE_BITS = 20


def _hash(seed: int, *columns):
    return F.xxhash64(F.lit(seed), *columns)


def targets(sources: DataFrame) -> DataFrame:
    """(source, source_size) with weight and target. Sources are weighed in code-point order, null last; what exceeds the cap is
    reshared by weight. Sorted by cap over weight, a source is capped when the level that is left before it exceeds its ratio,
    so one running sum replaces the repeated resharing. Windows here run over one row per source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*map(F.lit, WEIGHTS))
    out = sources.withColumn("idx", F.row_number().over(order) - 1).withColumn("weight", F.element_at(weights, (F.col("idx") % len(WEIGHTS) + 1).cast("int")))
    out = out.withColumn("cap", F.col("source_size") * MOST_REPEATS)
    filled = Window.orderBy(F.col("cap") / F.col("weight"), "idx").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sum_ = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    out = out.withColumns({"all_size": sum_("source_size", every), "all_weight": sum_("weight", every), "cap_before": sum_("cap", filled), "weight_before": sum_("weight", filled)})
    out = out.withColumn("capped", (F.col("all_size") - F.col("cap_before")) / (F.col("all_weight") - F.col("weight_before")) > F.col("cap") / F.col("weight"))
    out = out.withColumns({"held": sum_(F.when(F.col("capped"), F.col("cap")), every), "open_weight": sum_(F.when(~F.col("capped"), F.col("weight")), every)})
    level = (F.col("all_size") - F.col("held")) * F.col("weight") / F.col("open_weight")
    return out.withColumn("target", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(level)).select("source", "source_size", "idx", "weight", "target")


#: In a draw from N of which K are marked, n drawn: the weight of k + 1 marked ones over that of k.
_RATIO = "(cast(x.own - k as double) * (x.drawn - k) / (cast(k + 1 as double) * (x.pool - x.own - x.drawn + k + 1)))"


def _split(nodes: DataFrame, seed: int, tables: Tables) -> DataFrame:
    """Each node's quotas, dealt to two children: the left one gets half of the blocks, its composition drawn source by source.

    A draw is hypergeometric, by inversion: weights run from 8 standard deviations below the mean to 8 above it, each from
    the one before, first for their sum, then up to the share u of it. N, K and n depend on the draws before, hence one fold. A node without blocks sends none."""
    whole = "aggregate(sequence(r.a, r.b), named_struct('w', 1D, 't', 0D), (q, k) -> named_struct('w', q.w * {ratio}, 't', q.t + q.w), q -> q.t)".format(ratio=_RATIO)
    draw = """
element_at(transform(transform(array(named_struct(
    'a', greatest(0L, x.drawn - (x.pool - x.own), cast(floor(x.drawn / x.pool * x.own - 8 * x.sd - 4) as long)),
    'b', least(x.drawn, x.own, cast(ceil(x.drawn / x.pool * x.own + 8 * x.sd + 4) as long)))),
  r -> named_struct('a', r.a, 'b', r.b, 'goal', x.u * {whole})),
  r -> aggregate(sequence(r.a, r.b), named_struct('w', 1D, 't', 0D, 'k', -1L),
    (s, k) -> named_struct('w', s.w * {ratio}, 't', s.t + s.w, 'k', if(s.k < 0 and s.t + s.w >= r.goal, k, s.k)),
    s -> if(s.k < 0, r.b, s.k))), 1)""".format(whole=whole, ratio=_RATIO)
    left = f"""
aggregate(sequence(1, size(quotas)), named_struct('pool', total, 'drawn', total div 2, 'out', cast(array() as array<bigint>)),
  (a, i) -> element_at(transform(array(named_struct('pool', a.pool, 'drawn', a.drawn, 'own', element_at(quotas, i), 'out', a.out,
      'u', shiftrightunsigned(xxhash64({seed}L, node, i), 11) / 9007199254740992D,
      'sd', sqrt(greatest(0D, cast(a.drawn as double) / greatest(1L, a.pool) * element_at(quotas, i) * (a.pool - element_at(quotas, i)) / greatest(1L, a.pool) * (a.pool - a.drawn) / greatest(1L, a.pool - 1))))),
    x -> element_at(transform(array(if(x.pool = 0 or x.own = 0 or x.drawn = 0, 0L, {draw})),
      d -> named_struct('pool', x.pool - x.own, 'drawn', x.drawn - d, 'out', concat(x.out, array(d)))), 1)), 1),
  a -> a.out)"""
    halves = nodes.withColumn("total", F.expr("aggregate(quotas, 0L, (a, x) -> a + x)"))
    halves = tables.put(halves.withColumn("left", F.expr(left)), "left")  # used three times
    sides = F.array(
        F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("quotas")),
        F.struct((F.col("node") * 2 + 1).alias("node"), F.zip_with("quotas", "left", lambda a, b: a - b).alias("quotas")),
    )
    return halves.select(F.explode(sides).alias("x")).select("x.node", "x.quotas")


def _prefix(bits: int, h: str = "hash"):
    return F.shiftright(h, 64 - bits)


def _running(*by: str, order: tuple):
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _edge(rows: DataFrame, turned: DataFrame, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """What a source's last, partial epoch takes of the block that its rest ends in: (source, idx, block, below, fit), documents of a hash under
    `below` or up to `fit`; and (source, idx, block, only), further documents. Documents go in by hash while they fit; what then is
    missing is filled from all that are left, largest first, until no document fits; one more is taken if the target is nearer so."""
    same = F.expr("a.source <=> b.source")
    edge = turned.where("upto - words < rest and upto > rest").select("source", "idx", "block", F.col("block").alias("prefix"), (F.col("upto") - F.col("words")).alias("before"), "rest")
    edge = tables.put(edge, "edge")
    fine = rows.alias("a").join(edge.alias("b"), same & F.expr("a.block = b.block")).groupBy("idx", "b.source", "b.block", "before", "rest", _prefix(FINE_BITS).alias("prefix")).agg(F.sum("size").alias("words"))
    fine = fine.withColumn("upto", F.col("before") + F.sum("words").over(_running("idx", order=("prefix",)))).where("upto - words < rest and upto >= rest")
    fine = tables.put(fine.select("source", "idx", "block", "prefix", (F.col("upto") - F.col("words")).alias("before"), "rest"), "fine")
    near = rows.alias("a").join(fine.alias("b"), same & (_prefix(FINE_BITS, "a.hash") == F.col("b.prefix"))).groupBy("idx", "b.source", "b.block", "prefix", "before", "rest", "hash").agg(F.sum("size").alias("words"))
    near = near.withColumn("upto", F.col("before") + F.sum("words").over(_running("idx", order=("hash",))))
    last = near.groupBy("source", "idx", "block", "prefix", "before", "rest").agg(F.max(F.when(F.col("upto") <= F.col("rest"), F.struct("upto", "hash"))).alias("fit"))
    last = last.select("source", "idx", "block", F.shiftleft("prefix", 64 - FINE_BITS).alias("below"), F.col("fit.hash").alias("fit"), (F.col("rest") - F.coalesce("fit.upto", "before")).alias("gap"))
    last = tables.put(last, "fits")
    # Left are the blocks behind the edge in the source's order, and what of the edge doesn't fit.
    open_ = turned.alias("a").join(last.alias("b"), same).where("upto > rest").select("a.source", "a.block", "b.idx", F.when(F.expr("a.block = b.block"), F.col("below")).alias("below"), F.when(F.expr("a.block = b.block"), F.col("fit")).alias("fit"), "gap")
    left = rows.alias("a").join(tables.put(open_, "open").alias("b"), same & F.expr("a.block = b.block")).where("size > 0 and size < 2 * gap and not coalesce(hash < below, false) and not coalesce(hash <= fit, false)")
    left = left.groupBy("b.source", "idx", "gap", "hash").agg(F.sum("size").alias("size")).where("size < 2 * gap")
    left = tables.put(left.withColumn("block", _prefix(BLOCK_BITS)), "left")
    # Largest first, as many of each size as still fit; at last one of the smallest that are left, if that is nearer. Sizes of twice the gap are out, so
    # an array has two entries at most for each word of the gap.
    sizes = left.groupBy("source", "idx", "gap", "size").agg(F.count("*").alias("k"))
    sizes = sizes.groupBy("source", "idx", "gap").agg(F.sort_array(F.collect_list(F.struct("size", "k")), asc=False).alias("sizes"))
    fill = """aggregate(sizes, named_struct('gap', cast(gap as double), 'least', 0L, 'out', cast(array() as array<struct<size: bigint, k: bigint>>)),
        (a, x) -> if(x.size > a.gap, named_struct('gap', a.gap, 'least', x.size, 'out', a.out), named_struct('gap', a.gap - x.size * least(x.k, floor(a.gap / x.size)),
            'least', if(x.k > floor(a.gap / x.size), x.size, a.least), 'out', concat(a.out, array(named_struct('size', x.size, 'k', least(x.k, floor(a.gap / x.size))))))),
        a -> if(a.least > 0 and a.least < 2 * a.gap, concat(a.out, array(named_struct('size', a.least, 'k', 1L))), a.out))"""
    wanted = sizes.select("idx", F.explode(F.expr(fill)).alias("x")).groupBy("idx", "x.size").agg(F.sum("x.k").alias("take"))
    wanted = tables.put(wanted, "wanted")
    # Of a size those of least hash: first within each block, then of what the blocks send on.
    for by in (("idx", "size", "block"), ("idx", "size")):
        left = left if "take" in left.columns else left.join(wanted, ["idx", "size"])
        left = left.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy("hash"))).where("nth <= take").drop("nth")
    more = tables.put(left.select("source", "idx", "block", F.col("hash").alias("only")), "extras")
    return last.drop("gap"), more


def deal(quotas: DataFrame, entries: DataFrame, levels: int, seed: int, tables: Tables) -> DataFrame:
    """Deals the entries (idx, epoch, block, ...) of each source to 2**levels shards, by a tree over `quotas` (idx, n: entries of a source), and adds `shard`.
    The leaves say how many a shard draws of each source; it draws them from the source's entries in a permuted order, where the shard before stopped."""
    nodes = quotas.agg(F.array_sort(F.collect_list(F.struct("idx", "n"))).alias("q")).where("size(q) > 0")
    names = nodes.select(F.posexplode(F.expr("transform(q, x -> x.idx)")).alias("at", "idx"))
    nodes = nodes.select(F.lit(1).cast("long").alias("node"), F.expr("transform(q, x -> x.n)").alias("quotas"))
    for _ in range(levels):
        nodes = tables.put(_split(nodes, seed, tables), "nodes")
    leaves = nodes.select((F.col("node") - (1 << levels)).cast("int").alias("shard"), F.posexplode("quotas").alias("at", "n")).join(names, "at")
    upto = leaves.withColumn("upto", F.sum("n").over(_running("idx", order=("shard",)))).groupBy("idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("shard", "upto"))), lambda x: x["upto"]).alias("ends"))
    turn = F.row_number().over(Window.partitionBy("idx").orderBy(F.xxhash64(F.lit(seed), "idx", "epoch", "block"), "epoch", "block", F.col("only").asc_nulls_first()))
    drawn = entries.withColumn("turn", turn).join(tables.put(upto, "leaves"), "idx")
    # An entry past the last leaf is drawn by no shard.
    return drawn.withColumn("shard", F.expr("size(filter(ends, e -> e < turn))")).where(f"shard < {1 << levels}").drop("turn", "ends")


def mixing_plan(docs: DataFrame, levels: int = 3, seed: int = 20240229, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", tables: Tables | None = None) -> tuple[DataFrame, DataFrame]:
    """(one row per block: source, block, what its source has and its target, its dealt draws; one row per document: id, source, size, hash, block)."""
    need(docs, id_col, text_col, source_col)
    tables = tables or Tables(docs.sparkSession)
    size = F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long")
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), _hash(seed, F.col(id_col)).alias("hash"))
    rows = tables.put(rows.withColumn("block", _prefix(BLOCK_BITS)), "sizes")
    blocks = tables.put(rows.groupBy("source", "block").agg(F.sum("size").alias("words")), "blocks")
    aims = targets(blocks.groupBy("source").agg(F.sum("words").alias("source_size")))
    # A source of no words takes none.
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    aims = aims.withColumn("full", full.cast("long")).withColumn("rest", F.col("target") - F.col("full") * F.col("source_size"))
    aims = tables.put(aims, "targets")
    # All blocks in each whole epoch, then in an order of the source's own as many as its rest holds.
    told = blocks.alias("a").join(aims.alias("b"), F.expr("a.source <=> b.source")).select("a.source", "a.block", "words", "idx", "source_size", "target", "full", "rest")
    told = tables.put(told.withColumn("upto", F.sum("words").over(_running("idx", order=(F.xxhash64(F.lit(seed + 2), "idx", "block"), "block")))), "told")
    turned = told.where("words > 0")
    edge, extra = _edge(rows, turned, tables)
    no = F.lit(None).cast("long")
    entry = lambda df, epoch, whole, below=no, fit=no, only=no: df.select("source", "idx", "block", epoch.cast("int").alias("epoch"), F.lit(whole).alias("whole"), below.alias("below"), fit.alias("fit"), only.alias("only"))
    with_full = lambda df: df.join(aims.select("idx", "full"), "idx")
    entries = entry(turned.where("full > 0").withColumn("e", F.explode(F.expr("sequence(0L, full - 1)"))), F.col("e"), True)
    entries = entries.unionByName(entry(turned.where("upto <= rest"), F.col("full"), True))
    entries = entries.unionByName(entry(with_full(edge), F.col("full"), False, F.col("below"), F.col("fit")))
    entries = tables.put(entries.unionByName(entry(with_full(extra), F.col("full"), False, only=F.col("only"))), "entries")
    dealt = deal(entries.groupBy("idx").agg(F.count("*").alias("n")), entries, levels, seed, tables)
    dealt = dealt.groupBy("idx", "block").agg(F.collect_list(F.struct("epoch", "shard", "whole", "below", "fit", "only")).alias("dealt"))
    plan = told.select("idx", "source", "block", "source_size", "target").join(dealt, ["idx", "block"], "left").drop("idx")
    return tables.put(plan, "plan"), rows


#: A hash as a fraction of the range of hashes, in order.
_UNIT = "({h} / 18446744073709551616D + 0.5D)"


def with_draws(rows: DataFrame, plan: DataFrame, hash_col: str, source_col: str, seed: int = 20240229) -> DataFrame:
    """Adds `draws`, an entry with epoch, shard and place for each dealt block that the row is in, and what the plan says of its source.
    The plan has a row for each block, which Spark broadcasts where its size is small; beyond that a source's blocks are keys of their own."""
    p = plan.select(F.struct(*plan.columns).alias("_plan"))
    out = rows.join(p, F.col(source_col).eqNullSafe(F.col("_plan.source")) & (_prefix(BLOCK_BITS, hash_col) == F.col("_plan.block")), "left")
    mine = "coalesce(_plan.dealt, cast(array() as array<struct<epoch: int, shard: int, whole: boolean, below: bigint, fit: bigint, only: bigint>>))"
    mine = f"filter({mine}, x -> x.whole or coalesce({hash_col} < x.below, false) or coalesce({hash_col} <= x.fit, false) or {hash_col} <=> x.only)"
    return out.withColumn("draws", F.expr(f"array_sort(transform({mine}, x -> named_struct('epoch', x.epoch, 'shard', x.shard, 'place', xxhash64({seed + 1}L, {hash_col}, x.epoch))))"))


def mix_sources(docs: DataFrame, levels: int = 3, seed: int = 20240229, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """What a mix of all documents takes of each, with 2**levels output shards.

    Targets: sources in code-point order (null last) weigh 1, 2, 3, 1, ... and share all words; a source's target
    stops at 3 times its words. A source's documents are cut into blocks by hash. Its quota is exact: all its blocks as often as the target
    allows, then blocks in an order of its own while they fit, then of one more block the documents that fit by hash, then of all others the
    largest that fit until none does, and one more if the target is nearer so: no document that a source could still take would bring it nearer. The quotas go down a tree: at each node half of the entries go left, of each source a multivariate-hypergeometric
    number; leaves are the output shards. A shard draws as many of each source's permuted entries as its leaf says, disjoint from all others, and
    orders their rows by `place`. What a row is taken is what the shards have drawn of its block. Only ids, sizes and sums per block are
    shuffled; the hash of the id alone decides, so reruns agree and copies of a row are treated alike.

    Returns one row per input row: id, source, size, source_size, target, draws. No document is drawn more than 3
    times. Texts that are null or have no words have size 0; null sources form one source; an empty table gives none. Other columns are ignored.
    Plans are arrays over sources, so there may be as many sources as one row holds, not one for each document.
    """
    plan, rows = mixing_plan(docs, levels, seed, id_col, text_col, source_col)
    out = with_draws(rows.drop("block"), plan, "hash", "source", seed)
    return out.select(F.col("id").alias(id_col), rows["source"], "size", F.col("_plan.source_size").alias("source_size"), F.col("_plan.target").alias("target"), "draws")


def mixed_documents(docs: DataFrame, levels: int = 3, seed: int = 20240229, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents themselves with all their columns, once for each draw, in their output shards and shuffled there: each shard is
    a run of partitions, the same number for each, of consecutive ranges of `place`, sorted by it. Draws of equal place, which are
    copies of an id, stand by the hash of their text. A null text has no words and adds nothing to a target, a null source is a source of
    its own, null ids hash alike and rows that repeat an id are drawn together; an empty table gives no rows."""
    plan, _ = mixing_plan(docs, levels, seed, id_col, text_col, source_col)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col(source_col).alias("_source"), _hash(seed, F.col(id_col)).alias("_hash"), F.xxhash64(F.col(text_col)).alias("_tie"))
    drawn = with_draws(packed, plan, "_hash", "_source", seed).select("_doc", "_tie", F.explode("draws").alias("_draw"))
    shards = 1 << levels
    ranges = -(-int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // shards)
    at = F.expr(f"_draw.shard * {ranges} + least({ranges - 1}, cast(floor({_UNIT.format(h='_draw.place')} * {ranges}) as int))")
    return drawn.repartitionById(shards * ranges, at).sortWithinPartitions("_draw.shard", "_draw.place", "_tie").select("_doc.*")
