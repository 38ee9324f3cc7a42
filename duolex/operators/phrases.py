"""Phrase candidates of regions as relations: reversed runs, bounded gaps and their merging, soft anchors, expansions.

Regions are (pair_id, s0, s1, t0, t1), half-open; s0 tells regions of a pair apart. Links are (pair_id, s, t, confidence, rule)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.staging import staged
from ..options import Repair
from . import cells as C
from . import matrices
from .groups import link_components
from .packed import each_batch, packed_pairs
from .partition import partitions
from .refine import LOCAL_TOKENS, TINY, Pair, Refiner, rising_chain
from .scoring import bounded
from .spans import matrix_span_score, mean_similarity, range_similarity
from .tokens import token_rows

REGION = ("pair_id", "s0")
BOX = ("s0", "s1", "t0", "t1")
SEGMENT = "pair_id string, region int, s0 int, s1 int, t0 int, t1 int"


def firm(repair: Repair) -> str:
    return f"(rule or confidence >= {max(0.55, repair.min_confidence + 0.10)})"


def own_links(regions: DataFrame, links: DataFrame) -> DataFrame:
    """The links inside each region, with `single`: neither end has another link there."""
    own = regions.select("pair_id", *BOX).join(links, "pair_id").where("s >= s0 and s < s1 and t >= t0 and t < t1")
    count = lambda c: F.count("*").over(Window.partitionBy(*REGION, c))
    return own.withColumn("single", (count("s") == 1) & (count("t") == 1))


def reverse_runs(regions: DataFrame, links: DataFrame, repair: Repair) -> DataFrame:
    """(pair_id, s0, run_s0, run_s1, run_t0, run_t1): runs of single links in which targets fall as sources rise, three links at least or two neighbours swapped.

    Gaps and islands: a link breaks with the one before it if its target doesn't fall, if it falls by more than one from one source to the next, or if a locked
    token lies between; a running count of breaks numbers the islands. Only islands of two links and more go on to a fold that keeps their boxes within the limits."""
    wide = [min(LOCAL_TOKENS, 2 * k) for k in (repair.max_source_span, repair.max_target_span)]
    locked = lambda c: F.sum(F.col("rule").cast("int")).over(Window.partitionBy("pair_id").orderBy(c).rangeBetween(Window.unboundedPreceding, 0))
    chain = own_links(regions, links.withColumns({"lock_s": locked("s")}).withColumns({"lock_t": locked("t")})).where("single and not rule")
    w = Window.partitionBy(*REGION).orderBy("s")
    lag = lambda c: F.lag(c).over(w)
    step, drop = F.col("s") - lag("s"), lag("t") - F.col("t")
    goes_on = (drop > 0) & ((step > 1) | (drop == 1)) & (lag("lock_s") == F.col("lock_s")) & (lag("lock_t") == F.col("lock_t"))
    chain = chain.withColumn("breaks", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("island", F.sum("breaks").over(w))
    packed = chain.groupBy(*REGION, "island").agg(F.array_sort(F.collect_list(F.struct("s", "t"))).alias("x")).where("size(x) > 1")
    ok = "(size(a.run) > 2 or (size(a.run) = 2 and a.run[1].s = a.run[0].s + 1 and a.run[1].t = a.run[0].t - 1))"
    fits = lambda k: f"(x.s - a.run[{k}].s < {wide[0]} and a.run[{k}].t - x.t < {wide[1]})"
    out = f"if({ok}, concat(a.out, array(struct(a.run[0].s as s, element_at(a.run, -1).s + 1 as e, element_at(a.run, -1).t as t, a.run[0].t + 1 as f))), a.out)"
    fold = f"""aggregate(x, named_struct('run', cast(array() as array<struct<s: int, t: int>>), 'out', cast(array() as array<struct<s: int, e: int, t: int, f: int>>)),
        (a, x) -> if(size(a.run) = 0 or {fits(0)}, named_struct('run', concat(a.run, array(x)), 'out', a.out),
            named_struct('run', if(not {ok} and size(a.run) = 2 and {fits(1)}, array(a.run[1], x), array(x)), 'out', {out})), a -> {out})"""
    return packed.select(*REGION, F.explode(F.expr(fold)).alias("b")).select(*REGION, F.col("b.s").alias("run_s0"), F.col("b.e").alias("run_s1"), F.col("b.t").alias("run_t0"), F.col("b.f").alias("run_t1"))


def bounded_gaps(regions: DataFrame, links: DataFrame, vectors: DataFrame, repair: Repair) -> DataFrame:
    """(pair_id, region, s0, s1, t0, t1, similarity): stretches of both sides without links, within the span limits and similar enough, between neighbours of the greedy rising
    chain of single links (or a region's ends). `region` is the region's s0."""
    own = own_links(regions, links)
    packed = own.where("single").groupBy(*REGION).agg(F.array_sort(F.collect_list(F.struct(F.col("s").cast("int").alias("s"), F.col("t").cast("int").alias("t")))).alias("x"))
    chain = "aggregate(coalesce(x, array()), array(struct(cast(s0 - 1 as int) as s, cast(t0 - 1 as int) as t)), (a, x) -> if(x.s > element_at(a, -1).s and x.t > element_at(a, -1).t, concat(a, array(x)), a))"
    stops = regions.join(packed, [*REGION], "left").withColumn("stops", F.expr(f"concat({chain}, array(struct(cast(s1 as int) as s, cast(t1 as int) as t)))"))
    between = F.expr("transform(sequence(0, size(stops) - 2), i -> struct(stops[i].s + 1 as s0, stops[i + 1].s as s1, stops[i].t + 1 as t0, stops[i + 1].t as t1))")
    gaps = stops.select("pair_id", F.col("s0").alias("region"), F.explode(between).alias("g")).select("pair_id", "region", "g.*")
    gaps = gaps.where(f"s1 > s0 and t1 > t0 and s1 - s0 <= {repair.max_source_span} and t1 - t0 <= {repair.max_target_span}")
    used = own.select("pair_id", F.col("s0").alias("region"), "s", "t")
    gaps = gaps.join(used, (gaps.pair_id == used.pair_id) & (gaps.region == used.region) & F.expr("(s >= s0 and s < s1) or (t >= t0 and t < t1)"), "left_anti")
    gaps = staged(gaps.withColumn("span", F.concat_ws(":", "region", "s0")), "gaps")
    scored = range_similarity(gaps, vectors)
    return gaps.join(scored, ["pair_id", "span"]).where(F.col("similarity") >= repair.min_similarity).drop("span")


def merged_gaps(regions: DataFrame, links: DataFrame, vectors: DataFrame, repair: Repair) -> DataFrame:
    """(pair_id, region, s0, s1, t0, t1): the bounded gaps of each region, neighbours made one where their box is within twice the limits, holds links, none of them firm and none of
    them leaving it, and is similar enough beside its parts. From the left, a gap is merged once: of a run of gaps that could all be merged with the next, every other one is."""
    gaps = staged(bounded_gaps(regions, links, vectors, repair), "gaps")
    w = Window.partitionBy("pair_id", "region").orderBy("s0")
    lead = lambda c, name: F.lead(c).over(w).alias(name)
    pairs = gaps.select("pair_id", "region", "s0", lead("s1", "s1"), "t0", lead("t1", "t1"), F.col("s1").alias("a1"), F.col("t1").alias("b1"), "similarity", lead("similarity", "next"), ((F.col("s1") - F.col("s0")) + (F.col("t1") - F.col("t0"))).alias("weight"), F.lead(F.col("s1") - F.col("s0") + F.col("t1") - F.col("t0")).over(w).alias("next_weight"))
    pairs = staged(pairs.where(f"s1 - s0 <= {min(LOCAL_TOKENS, 2 * repair.max_source_span)} and t1 - t0 <= {min(LOCAL_TOKENS, 2 * repair.max_target_span)}"), "pairs")
    own = own_links(regions, links).select(F.concat_ws("|", "pair_id", "s0").alias("pair_id"), F.col("pair_id").alias("pair"), F.col("s0").alias("region"), "s", "t", "confidence", "rule")
    own = staged(link_components(own), "own").select(F.col("pair").alias("pair_id"), "region", "s", "t", "confidence", "rule", "comp")
    touch = pairs.select("pair_id", "region", *BOX).join(own, ["pair_id", "region"]).where("(s >= s0 and s < s1) or (t >= t0 and t < t1)")
    touch = staged(touch.withColumn("inside", F.expr("s >= s0 and s < s1 and t >= t0 and t < t1")), "touch")
    held = touch.groupBy("pair_id", "region", "s0").agg(F.min("inside").alias("closed"), F.max(F.expr(firm(repair))).alias("firm")).where("closed and not firm").select("pair_id", "region", "s0")
    # The parts: both gaps and what the links inside connect.
    ends = F.explode(F.array(F.struct(F.lit("source").alias("side"), F.col("s").alias("idx")), F.struct(F.lit("target").alias("side"), F.col("t").alias("idx")))).alias("x")
    members = touch.join(held, ["pair_id", "region", "s0"], "left_semi").select("pair_id", F.concat_ws(":", "region", "s0", "comp").alias("span"), "region", "s0", ends).select("pair_id", "span", "region", "s0", "x.*").distinct()
    members = staged(members, "members")
    inner = members.groupBy("pair_id", "span", "region", "s0").agg(F.count("*").alias("n")).join(mean_similarity(members.select("pair_id", "span", "side", "idx"), vectors), ["pair_id", "span"])
    inner = inner.groupBy("pair_id", "region", "s0").agg(F.sum(F.col("n") * F.col("similarity")).alias("inner"), F.sum("n").alias("n"))
    whole = pairs.withColumn("span", F.concat_ws(":", "region", "s0"))
    judged = whole.join(inner, ["pair_id", "region", "s0"]).join(range_similarity(whole, vectors).withColumnRenamed("similarity", "all"), ["pair_id", "span"])
    base = F.expr("(weight * similarity + inner + next_weight * next) / (weight + n + next_weight)")
    judged = judged.withColumn("base", base).where(f"if(all > base, (all - base) / greatest({TINY}D, 1 - base), 0D) >= {repair.min_score_gain}D")
    flags = gaps.join(judged.select("pair_id", "region", "s0", F.col("s1").alias("to_s"), F.col("t1").alias("to_t")), ["pair_id", "region", "s0"], "left")
    # Every other gap of a run that could be merged takes the next one in.
    run = F.sum(F.when(F.col("to_s").isNull(), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    flags = flags.withColumn("run", run)
    nth = F.sum(F.when(F.col("to_s").isNotNull(), 1).otherwise(0)).over(Window.partitionBy("pair_id", "region", "run").orderBy("s0").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    flags = flags.withColumn("takes", F.col("to_s").isNotNull() & (nth % 2 == 1)).withColumn("taken", F.coalesce(F.lag("takes").over(w), F.lit(False)))
    end = lambda c, to: F.when(F.col("takes"), F.col(to)).otherwise(F.col(c)).alias(c)
    return flags.where("not taken").select("pair_id", "region", "s0", end("s1", "to_s"), "t0", end("t1", "to_t"))


def partition_regions(tokenized: DataFrame, links: DataFrame, cells: DataFrame, vectors: DataFrame | None, repair: Repair) -> DataFrame:
    """(pair_id, region, s0, s1, t0, t1): the segments of each region's best partition; regions of too many tokens, or without one, give none. Regions are those between the hard anchors
    of `links` (with origin and similarity); all those of an Arrow batch go through the waves together."""
    return each_batch(packed_pairs(tokenized, links, cells, vectors), lambda pairs: _segments(pairs, repair), SEGMENT)


def partition_in_tasks(tokenized: DataFrame, links: DataFrame, embedder, repair: Repair) -> DataFrame:
    """What `partition_regions` gives, with matrices made in tasks; pairs of too many cells for that go there."""
    small, large = matrices.parted(tokenized)
    out = matrices.refined_pairs(small, links, embedder, lambda pairs: _segments([(row["pair_id"], pair) for row, pair in pairs], repair), StructType.fromDDL(SEGMENT))
    if large is None:
        return out
    v = staged(embedder.embed(token_rows(large)), "vectors")
    return out.unionByName(partition_regions(large, links, C.cells(v), v, repair))


def _segments(pairs: list[tuple[str, Pair]], repair: Repair):
    at, regions = [], []
    for pair_id, pair in pairs:
        r = Refiner(pair, repair)
        for box, _ in r.regions():
            if sum(box.shape) <= LOCAL_TOKENS:
                region = r.region(box, r.inside(box))
                if r.fits_whole(box, region):
                    yield pair_id, box.s0, *box
                else:
                    at.append((pair_id, box))
                    regions.append(region)
    for (pair_id, box), found in zip(at, partitions(regions, repair.max_source_span, repair.max_target_span), strict=True):
        for s0, s1, t0, t1 in found or ():
            yield pair_id, box.s0, box.s0 + s0, box.s0 + s1, box.t0 + t0, box.t0 + t1


def region_choices(regions: DataFrame, links: DataFrame, segments: DataFrame, cells: DataFrame, vectors: DataFrame, repair: Repair) -> DataFrame:
    """(pair_id, region, choice, s0, s1, t0, t1, similarity, confidence): what becomes of each region (with `support`) that is refined, and the groups it then has.

    Reversed runs come first. Else a region is looked at if both sides have two tokens and it two links, none of its tokens is linked beyond it, its links cover one side too little and the
    other well enough: then its gaps, if with them both sides are covered, or else the segments of its partition (`segments`, as of partition_regions) that links don't settle already. A
    group's confidence is of its block in the relative matrix, the mean confidence of the region's links that touch it, its similarity and the region's support."""
    region = ["pair_id", "region"]
    own = staged(own_links(regions, links).withColumnRenamed("s0", "region").drop("s1", "t0", "t1"), "own")
    runs = staged(reverse_runs(regions, links, repair).select("pair_id", F.col("s0").alias("region"), *[F.col(f"run_{c}").alias(c) for c in BOX]), "runs")
    gaps = staged(merged_gaps(regions, links, vectors, repair), "gaps")
    marked = regions.select("pair_id", F.col("s0").alias("region"), *BOX, "support")
    # Links with one end in the region are of the pair but not of the region.
    leaving = marked.join(links.select("pair_id", "s", "t"), "pair_id").where("(s >= s0 and s < s1) != (t >= t0 and t < t1)").select(*region).distinct().withColumn("leaves", F.lit(True))
    seen = own.groupBy(*region).agg(F.count("*").alias("n_links"), F.count_distinct("s").alias("on_s"), F.count_distinct("t").alias("on_t"))
    tokens = lambda df: df.select(*region, F.explode(F.expr("array(struct('s' as side, cast(s as int) as idx), struct('t' as side, cast(t as int) as idx))")).alias("x")).select(*region, "x.*")
    ranges = F.expr("concat(transform(sequence(s0, s1 - 1), i -> struct('s' as side, cast(i as int) as idx)), transform(sequence(t0, t1 - 1), i -> struct('t' as side, cast(i as int) as idx)))")
    with_gaps = tokens(own).unionByName(gaps.select(*region, F.explode(ranges).alias("x")).select(*region, "x.*")).distinct()
    with_gaps = with_gaps.groupBy(*region).agg(F.count_if(F.col("side") == "s").alias("all_s"), F.count_if(F.col("side") == "t").alias("all_t"))
    told = marked.join(seen, region, "left").join(leaving, region, "left").join(with_gaps, region, "left")
    told = told.join(runs.select(*region).distinct().withColumn("has_runs", F.lit(True)), region, "left").join(gaps.select(*region).distinct().withColumn("has_gaps", F.lit(True)), region, "left")
    least = repair.min_span_coverage
    shares = [F.coalesce(F.col(f"on_{c}"), F.lit(0)) / (F.col(f"{c}1") - F.col(f"{c}0")) for c in "st"]
    low = F.expr("s1 - s0 >= 2 and t1 - t0 >= 2 and coalesce(n_links, 0) >= 2 and leaves is null") & (F.least(*shares) < least) & (F.greatest(*shares) >= min(0.5, least))
    restored = F.col("has_gaps") & (F.least(F.col("all_s") / (F.col("s1") - F.col("s0")), F.col("all_t") / (F.col("t1") - F.col("t0"))) >= least)
    choice = F.when(F.col("has_runs"), "runs").when(~F.coalesce(low, F.lit(False)), None).when(restored, "gaps").otherwise("partition")
    told = staged(told.select(*region, "support", choice.alias("choice")).where("choice is not null"), "choices")
    # A segment is settled if it has links, none of them leaving it, on all of its tokens.
    touch = segments.select(*region, *BOX).join(own, region).where("(s >= s0 and s < s1) or (t >= t0 and t < t1)")
    settled = touch.groupBy(*region, *BOX).agg(F.min(F.expr("s >= s0 and s < s1 and t >= t0 and t < t1")).alias("closed"), F.count_distinct("s").alias("ks"), F.count_distinct("t").alias("kt")).where("closed and ks = s1 - s0 and kt = t1 - t0")
    open_ = segments.select(*region, *BOX).join(settled.select(*region, *BOX), [*region, *BOX], "left_anti")
    of = lambda df, name: df.select(*region, F.lit(name).alias("choice"), *[F.col(c).cast("int").alias(c) for c in BOX])
    boxes = of(runs, "runs").unionByName(of(gaps, "gaps")).unionByName(of(open_, "partition")).join(told, [*region, "choice"])
    boxes = staged(boxes.withColumn("span", F.concat_ws(":", *BOX)), "boxes")
    mean = boxes.select(*region, "span", *BOX).join(own, region).where("(s >= s0 and s < s1) or (t >= t0 and t < t1)").groupBy("pair_id", "span").agg(F.avg("confidence").alias("mean"))
    scored = boxes.join(range_similarity(boxes, vectors), ["pair_id", "span"]).join(matrix_span_score(boxes, cells, "rel"), ["pair_id", "span"]).join(mean, ["pair_id", "span"], "left")
    confidence = 0.40 * F.col("score") + 0.25 * F.coalesce("mean", F.lit(0.0)) + 0.20 * F.col("similarity") + 0.15 * F.col("support")
    return scored.select(*region, "choice", *BOX, "similarity", bounded(confidence).alias("confidence"))


def soft_anchors(links: DataFrame, tokens: DataFrame, repair: Repair) -> DataFrame:
    """(pair_id, s, t): of single, sure links between content tokens the heaviest chain that rises on both sides. Only a pair's candidates meet in a row."""
    count = lambda c: F.count("*").over(Window.partitionBy("pair_id", c))
    single = links.withColumn("_n", count("s")).withColumn("_m", count("t")).where(f"_n = 1 and _m = 1 and confidence >= {max(0.45, repair.min_confidence)}")
    content = lambda side, c: tokens.where((F.col("side") == side) & F.col("is_content")).select("pair_id", F.col("idx").alias(c))
    sure = single.join(content("source", "s"), ["pair_id", "s"]).join(content("target", "t"), ["pair_id", "t"])
    packed = sure.groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct(F.col("s").cast("int").alias("s"), F.col("t").cast("int").alias("t"), "confidence"))).alias("x"))

    def run(batches):
        for b in batches:
            pairs, s, t = [], [], []
            for pair, items in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                at = [items.values.field(k).to_pylist() for k in ("s", "t", "confidence")]
                chain = rising_chain(at[1], at[2])
                pairs += [pair] * len(chain)
                s += [at[0][k] for k in chain]
                t += [at[1][k] for k in chain]
            yield pa.RecordBatch.from_arrays([pa.array(pairs, pa.string()), pa.array(s, pa.int32()), pa.array(t, pa.int32())], names=["pair_id", "s", "t"])

    return packed.mapInArrow(run, "pair_id string, s int, t int")


def expansion_candidates(regions: DataFrame, links: DataFrame, cells: DataFrame, vectors: DataFrame, repair: Repair) -> DataFrame:
    """(pair_id, s0, s1, t0, t1, similarity, gain, confidence): connected links whose tokens are a box, widened on one side by tokens without links, within region and limits."""
    own = own_links(regions, links).select(F.concat_ws("|", "pair_id", "s0").alias("pair_id"), F.col("pair_id").alias("pair"), *[F.col(c).alias(f"r_{c}") for c in BOX], "s", "t", "confidence")
    own = staged(link_components(own), "own")
    ends = [F.min("s").alias("s0"), (F.max("s") + 1).alias("s1"), F.min("t").alias("t0"), (F.max("t") + 1).alias("t1"), F.count_distinct("s").alias("n_s"), F.count_distinct("t").alias("n_t")]
    boxes = own.groupBy(F.col("pair").alias("pair_id"), *[f"r_{c}" for c in BOX], "comp").agg(*ends, F.avg("confidence").alias("mean")).where("s1 - s0 = n_s and t1 - t0 = n_t")
    cover = own.groupBy(F.col("pair").alias("pair_id"), "r_s0").agg(F.count_distinct("s").alias("on_s"), F.count_distinct("t").alias("on_t"))
    boxes = boxes.join(cover, ["pair_id", "r_s0"])
    ranges = lambda lo, hi, a, c, most: F.expr(f"filter(flatten(transform(sequence(greatest({lo}, {c} - {most}), {a}), x -> transform(sequence({c}, least({hi}, {a} + {most})), y -> struct(x, y)))), z -> z.x < z.y and z.y - z.x > {c} - {a} and z.y - z.x <= {most})")
    of = lambda df, side, other: df.where(f"{other}1 - {other}0 <= {repair.max_target_span if other == 't' else repair.max_source_span}").withColumn("z", F.explode(ranges(f"r_{side}0", f"r_{side}1", f"{side}0", f"{side}1", repair.max_source_span if side == "s" else repair.max_target_span))).withColumn("side", F.lit(side))
    wide = of(boxes, "s", "t").unionByName(of(boxes, "t", "s"))
    new = lambda side, k, z: F.when(F.col("side") == side, F.col(f"z.{z}")).otherwise(F.col(f"{side}{k}")).cast("int").alias(f"w_{side}{k}")
    wide = wide.select("*", new("s", 0, "x"), new("s", 1, "y"), new("t", 0, "x"), new("t", 1, "y")).withColumn("added", F.expr("(w_s1 - w_s0) - (s1 - s0) + (w_t1 - w_t0) - (t1 - t0)"))
    share = F.expr("if(side = 's', (on_s + added) / (r_s1 - r_s0), (on_t + added) / (r_t1 - r_t0))")
    wide = wide.withColumn("cover", share).where(F.col("cover") >= repair.min_span_coverage)
    used = links.select("pair_id", F.explode(F.array(F.struct(F.lit("s").alias("on"), F.col("s").alias("at")), F.struct(F.lit("t").alias("on"), F.col("t").alias("at")))).alias("u")).select(F.col("pair_id").alias("up"), "u.*").distinct()
    free = wide.join(used, F.expr("pair_id = up and side = on and ((side = 's' and at >= w_s0 and at < w_s1 and (at < s0 or at >= s1)) or (side = 't' and at >= w_t0 and at < w_t1 and (at < t0 or at >= t1)))"), "left_anti")
    free = staged(free.drop("z"), "wider")
    key = lambda *c: F.concat_ws(":", *c)
    spans = free.select("pair_id", key(*[f"w_{c}" for c in BOX]).alias("span"), *[F.col(f"w_{c}").alias(c) for c in BOX]).unionByName(free.select("pair_id", key(*BOX).alias("span"), *BOX)).distinct()
    spans = staged(spans, "spans")
    scored = staged(range_similarity(spans, vectors), "scored")
    blocks = matrix_span_score(free.select("pair_id", key(*[f"w_{c}" for c in BOX]).alias("span"), *[F.col(f"w_{c}").alias(c) for c in BOX]), cells, "rel")
    out = free.withColumn("span", key(*[f"w_{c}" for c in BOX])).join(scored, ["pair_id", "span"]).join(blocks, ["pair_id", "span"])
    out = out.drop("span").withColumn("span", key(*BOX)).join(scored.withColumnRenamed("similarity", "base"), ["pair_id", "span"])
    out = out.withColumn("gain", F.col("similarity") - F.col("base")).where(F.col("gain") >= repair.min_score_gain)
    confidence = 0.45 * F.col("score") + 0.30 * F.col("mean") + 0.15 * F.col("cover") + 0.10 * F.least(F.lit(1.0), F.col("gain") / max(repair.min_score_gain, TINY))
    return out.select("pair_id", *[F.col(f"w_{c}").alias(c) for c in BOX], "similarity", "gain", bounded(confidence).alias("confidence"))


def without_conflict(boxes: DataFrame, *order) -> DataFrame:
    """What a greedy choice in this order takes, where no two boxes of a pair may share a source or a target.

    In rounds: each token names the first of the boxes on it; a box that all its tokens name goes in, and what shares a token with it goes out. Whatever is first among all that are
    left always goes in, and nothing goes in before a box ahead of it that it shares a token with has gone out; so the result is that of the loop over the sorted boxes, and rounds
    are as many as the longest chain of boxes that wait for each other."""
    left = staged(boxes.withColumn("_rank", F.row_number().over(Window.partitionBy("pair_id").orderBy(*order))), "left")
    out = None
    while not left.isEmpty():
        on = lambda side: F.expr(f"transform(sequence({side}0, {side}1 - 1), i -> struct('{side}' as side, i as idx))")
        tokens = left.select("pair_id", "_rank", F.explode(F.concat(on("s"), on("t"))).alias("x")).select("pair_id", "_rank", "x.*")
        named = tokens.withColumn("first", F.min("_rank").over(Window.partitionBy("pair_id", "side", "idx")))
        best = named.groupBy("pair_id", "_rank").agg(F.min(F.col("first") == F.col("_rank")).alias("all")).where("all").select("pair_id", "_rank")
        taken = staged(left.join(best, ["pair_id", "_rank"], "left_semi"), "taken")
        held = taken.select("pair_id", F.explode(F.concat(on("s"), on("t"))).alias("x")).select("pair_id", "x.*")
        gone = tokens.join(held, ["pair_id", "side", "idx"], "left_semi").select("pair_id", "_rank").distinct()
        left = staged(left.join(gone, ["pair_id", "_rank"], "left_anti").select(*left.columns), "left")
        out = taken if out is None else out.unionByName(taken)
    return boxes.limit(0) if out is None else out.drop("_rank")


def span_expansions(regions: DataFrame, links: DataFrame, cells: DataFrame, vectors: DataFrame, repair: Repair) -> DataFrame:
    """The expansions that are taken: by gain, confidence, few tokens, then from the left; a wider source before a wider target."""
    found = expansion_candidates(regions, links, cells, vectors, repair)
    return without_conflict(found, F.desc("gain"), F.desc("confidence"), F.expr("s1 - s0 + t1 - t0"), "s0", "t0", F.desc("s1"))
