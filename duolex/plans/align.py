"""The whole alignment of sentence pairs as one plan."""

from __future__ import annotations

from dataclasses import fields

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..errors import ProcessingError
from ..functions.staging import by_pair, staged
from ..operators import cells as C
from ..operators import groups as G
from ..operators import matching as M
from ..operators import repair as R
from ..operators import matrices, rules, scoring
from ..operators.packed import packed_pairs, read_pair, rows_of
from ..operators.refine import LOCAL_TOKENS, Pair, Refiner
from ..operators.tiles import tiled_cells, tiled_links
from ..operators.tokens import token_rows, tokenize
from ..operators.vectors import Embedder
from ..options import METHODS, Repair, Settings
from ..sources.pairs import accept


GROUP_TYPE = "array<struct<source_indices: array<int>, target_indices: array<int>, links: array<struct<s: int, t: int>>, similarity: double, confidence: double>>"
LINK_TYPE = "struct<s: int, t: int, origin: string, similarity: double, confidence: double>"
REFINED = f"pair_id string, links array<{LINK_TYPE}>, groups {GROUP_TYPE}"


def sizes_of(tokenized: DataFrame) -> DataFrame:
    return tokenized.select("pair_id", F.size("source_tokens").alias("n_s"), F.size("target_tokens").alias("n_t"))


def asked_of(pairs: DataFrame) -> DataFrame:
    """(pair_id, method, repair) of pairs with options of their own; options that aren't given have their defaults, `repair` is null where none is asked for."""
    given = F.col("repair")
    filled = F.struct(*[F.coalesce(given[f.name], F.lit(f.default)).alias(f.name) for f in fields(Repair)])
    return pairs.select("pair_id", "method", F.when(F.coalesce(given["enabled"], given.isNotNull()), filled).alias("repair"))


def refine_pairs(tokenized: DataFrame, links: DataFrame, cells: DataFrame, vectors: DataFrame | None, repair: Repair | DataFrame, local: int | None = LOCAL_TOKENS) -> DataFrame:
    """One row per pair that has links: the links that stay (`links`) and the refined `groups`. `repair`: the options of all, or those of each pair (pair_id, repair). `local`: tokens
    that a partition may span, None for any number."""
    link_kind = pa.struct([("s", pa.int32()), ("t", pa.int32()), ("origin", pa.string()), ("similarity", pa.float64()), ("confidence", pa.float64())])
    group_kind = pa.struct([("source_indices", pa.list_(pa.int32())), ("target_indices", pa.list_(pa.int32())), ("links", pa.list_(pa.struct([("s", pa.int32()), ("t", pa.int32())]))), ("similarity", pa.float64()), ("confidence", pa.float64())])

    each, packed = isinstance(repair, DataFrame), packed_pairs(tokenized, links, cells, vectors)
    if each:
        packed, repair = packed.join(repair, "pair_id"), None

    def run(batches):
        for b in batches:
            out = [_refined(r, read_pair(r, c), repair, local) for r, c in rows_of(b)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in out], pa.list_(link_kind)), pa.array([x[1] for x in out], pa.list_(group_kind))], names=["pair_id", "links", "groups"])

    return packed.mapInArrow(run, REFINED)


def _refined(row: dict, pair: Pair, repair: Repair | None, local: int | None) -> tuple[list, list]:
    """The links that stay and the groups of a pair, by its own options if there are no others."""
    done = Refiner(pair, Repair(**row["repair"]) if repair is None else repair, local).run()
    stay = [{**x} for x in row["links"] if done.links[x["s"], x["t"]]]
    return stay, [{"source_indices": g.sources, "target_indices": g.targets, "links": [{"s": a, "t": b} for a, b in g.links], "similarity": g.similarity, "confidence": g.confidence} for g in done.groups]


def refine_in_tasks(tokenized: DataFrame, links: DataFrame, embedder, repair: Repair | DataFrame, temperature: float = C.TEMPERATURE, local: int | None = LOCAL_TOKENS) -> DataFrame:
    """What `refine_pairs` gives, with matrices made in tasks; pairs of too many cells for that go there."""
    each = isinstance(repair, DataFrame)
    fixed = None if each else repair
    small, large = matrices.parted(tokenized)

    def find(pairs):
        for row, pair in pairs:
            yield row["pair_id"], *_refined(row, pair, fixed, local)

    out = matrices.refined_pairs(small, links, embedder, find, StructType.fromDDL(REFINED), temperature=temperature, more=repair if each else None)
    if large is None:
        return out
    v = staged(embedder.embed(token_rows(large)), "vectors")
    return out.unionByName(refine_pairs(large, links, C.cells(v, temperature), v, repair, local))


def align_cells(tokenized: DataFrame, cells: DataFrame, method_links: DataFrame, methods: tuple[str, ...], method: str = "itermax", repair: Repair | None = None, vectors: DataFrame | None = None, asked: DataFrame | None = None, local: int | None = LOCAL_TOKENS) -> DataFrame:
    """Alignment from given matrices: `cells` (pair_id, s, t, sim, p_st, p_ts and maybe rel), `method_links` (pair_id, method, s, t)
    and maybe `vectors`. One row per pair of `tokenized`, also where a side is empty. With `asked` (as of `asked_of`) each pair has a method and repair options of its own,
    and it's one plan whatever their number; `method` and `repair` aren't looked at."""
    if asked is None and method not in methods:
        raise ProcessingError(f"method {method} is not among those that run: {methods}")
    if asked is None and repair and repair.enabled and "mwmf" not in methods:
        raise ProcessingError("repair needs mwmf among the methods that run")
    value = "rel" if "rel" in cells.columns else "sim"
    key = ["pair_id", "s", "t"]
    sizes = sizes_of(tokenized)
    method_links = staged(M.normalise(method_links, sizes), "method-links")
    # Links of all methods are scored once; what rules and repair leave or add is picked from them.
    scored = staged(scoring.score_links(method_links.select(*key).distinct(), cells, method_links, sizes, len(methods), value), "scores")
    pick = lambda name: method_links.where(F.col("method") == name).select(*key).join(scored, key)
    chosen = method_links.where(F.col("method") == method) if asked is None else method_links.join(asked.select("pair_id", "method"), ["pair_id", "method"], "left_semi")
    mine = lambda df, wanted: df if wanted is None or df is None else df.join(wanted.select("pair_id"), "pair_id", "left_semi")
    refine = lambda tokenized, links, repair, wanted=None: refine_pairs(tokenized, links, mine(cells, wanted), mine(vectors, wanted), repair, local)
    return _finished(tokenized, chosen.select(*key).join(scored, key), pick, refine, methods, repair, asked)


def _finished(tokenized: DataFrame, chosen: DataFrame, pick, refine, methods: tuple[str, ...], repair: Repair | None, asked: DataFrame | None) -> DataFrame:
    """Rules, repair and refinement over the chosen links (pair_id, s, t, similarity, confidence). `pick` gives the scored links of a method, `refine` the refined rows of links."""
    key = ["pair_id", "s", "t"]
    tokens, sizes = token_rows(tokenized), sizes_of(tokenized)
    ruled = rules.override(chosen.select(*key, "similarity", "confidence"), token_rows(tokenized, following=True))
    sure = lambda c: F.when(F.col("rule"), 1.0).otherwise(F.col(c)).alias(c)
    links = staged(ruled.select(*key, sure("similarity"), sure("confidence"), F.when(F.col("rule"), "rule").otherwise("model").alias("origin")), "links")
    if asked is not None and "mwmf" in methods:
        wanted = asked.where("repair is not null").select("pair_id", "repair")
        mine = lambda df: df.join(wanted.select("pair_id"), "pair_id", "left_semi")
        found = R.one_to_one(R.candidates(links.select(*key), tokens, pick("mwmf"), sizes.join(wanted, "pair_id")))
        every = mine(links).unionByName(found.withColumn("origin", F.lit("repaired")))
        refined = staged(refine(mine(tokenized), every, wanted, wanted), "refined")
        rest = links.join(wanted.select("pair_id"), "pair_id", "left_anti")
        return assemble(tokenized, _flat(refined, "links").unionByName(rest), _flat(refined, "groups"))
    if asked is None and repair and repair.enabled:
        found = R.one_to_one(R.candidates(links.select(*key), tokens, pick("mwmf"), sizes, repair))
        every = links.unionByName(found.withColumn("origin", F.lit("repaired")))
        refined = staged(refine(tokenized, every, repair), "refined")
        return assemble(tokenized, _flat(refined, "links"), _flat(refined, "groups"))
    return assemble(tokenized, links, None)


def _flat(refined: DataFrame, part: str) -> DataFrame:
    return refined.select("pair_id", F.explode(part).alias("x")).select("pair_id", "x.*")


def assemble(tokenized: DataFrame, links: DataFrame, refined: DataFrame | None) -> DataFrame:
    """Links, groups and unaligned tokens of each pair in one row."""
    loose = links
    if refined is not None:
        inside = refined.select("pair_id", F.explode("links").alias("x")).select("pair_id", "x.s", "x.t").distinct()
        loose = links.join(inside, ["pair_id", "s", "t"], "left_anti").select(*links.columns)
    groups = G.link_groups(loose)
    if refined is not None:
        all_links = links.groupBy("pair_id").agg(F.collect_list(G.link_struct()).alias("all"))
        own = F.array_sort(F.filter(F.coalesce("all", F.array()), lambda x: F.exists("links", lambda y: (y["s"] == x["source_index"]) & (y["t"] == x["target_index"]))))
        r = refined.join(all_links, "pair_id", "left").select("pair_id", G.group_type(F.size("source_indices"), F.size("target_indices")).alias("type"), F.lit("refined").alias("origin"), "similarity", "confidence", "source_indices", "target_indices", own.alias("links"))
        groups = groups.unionByName(r)
    first = lambda c: F.col(c)[0]
    packed = groups.groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct(first("source_indices").alias("_s"), first("target_indices").alias("_t"), "type", "origin", "similarity", "confidence", "source_indices", "target_indices", "links"))).alias("g"))
    packed_links = links.groupBy("pair_id").agg(F.array_sort(F.collect_list(G.link_struct())).alias("links"))
    texts = lambda tokens, ids: F.transform(ids, lambda i: F.get(F.col(tokens), i)["text"])
    out = tokenized.join(packed_links, "pair_id", "left").join(packed, "pair_id", "left")
    shaped = F.transform(
        "g",
        lambda x: F.struct(
            *[x[c].alias(c) for c in ("type", "origin", "similarity", "confidence", "source_indices", "target_indices")],
            texts("source_tokens", x["source_indices"]).alias("source_tokens"), texts("target_tokens", x["target_indices"]).alias("target_tokens"), x["links"].alias("links"),
        ),
    )
    empty = lambda c: F.coalesce(c, F.array())

    def free(side: str) -> Column:
        """A side's tokens in no link and in no group; links stand in the pair's row, so nothing is joined."""
        used = F.concat(F.transform(empty("links"), lambda x: x[f"{side}_index"]), F.flatten(F.transform(empty("g"), lambda x: x[f"{side}_indices"])))
        return empty(F.array_except(F.transform(f"{side}_tokens", lambda x, i: i), used)).alias(f"unaligned_{side}_indices")

    return out.select(*tokenized.columns, empty(F.col("links")).alias("links"), empty(shaped).alias("alignment_groups"), free("source"), free("target"))


def align(pairs: DataFrame, embedder: Embedder, method: str | None = "itermax", repair: Repair | None = None, settings: Settings | None = None, segmenter=None, tile: int | None = None, local: int | None = LOCAL_TOKENS) -> DataFrame:
    """Aligns pairs (pair_id, source, target and maybe languages): every stage of the library in order, one row per pair. Pairs with
    languages are requests and are validated, which bounds their texts; the first invalid one fails the job (`accept` parts them before). Without a method each pair has its own, and
    repair options of its own, in columns `method` and `repair` (as of `read_requests`).

    With `tile` no pair's matrix is made: tokens meet in tiles of that width, so texts may have any length. That is for the methods that need no
    whole matrix (no mwmf) and without repair. `local`: tokens of both sides that a partition in repair may span; None for any number."""
    settings = settings or Settings()
    if method is None and tile:
        raise ValueError("pairs with options of their own need whole matrices: leave `tile` out")
    if method is not None and method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    if method is not None and method not in settings.methods:
        raise ProcessingError(f"method {method} is not enabled")
    if tile and ("mwmf" in settings.methods or (repair and repair.enabled)):
        raise ValueError("mwmf and repair need whole matrices: leave `tile` out, or switch them off")
    if settings.eager_load and hasattr(embedder, "warm_up"):
        embedder.warm_up(pairs.sparkSession)
    if {"source_language", "target_language"} <= set(pairs.columns):
        pairs = accept(pairs)[0]
    # Texts are dealt by pair before they grow into tokens and cells; all windows and joins below keep to pairs.
    tokenized = staged(tokenize(by_pair(pairs), segmenter), "tokens")
    if hasattr(embedder, "dealt") and not tile:
        return _in_tasks(tokenized, embedder, method, repair, settings, local)
    vectors = embedder.embed(token_rows(tokenized)).repartition("pair_id")
    if tile:
        vectors = staged(vectors, "vectors")
        links = staged(tiled_links(vectors, tile).where(F.col("method").isin(*settings.methods)), "links")
        cells = staged(C.check_cells(tiled_cells(vectors, links.select("pair_id", "s", "t").distinct(), tile, settings.confidence_temperature)), "cells")
        return align_cells(tokenized, cells, links, settings.methods, method)
    asked = asked_of(tokenized) if method is None else None
    if asked is not None or (repair and repair.enabled):
        vectors = staged(vectors, "vectors")
    cells = staged(C.check_cells(C.cells(vectors, settings.confidence_temperature), sizes_of(tokenized)), "cells")
    links = M.method_links(cells, settings.methods)
    return align_cells(tokenized, cells, links, settings.methods, method, repair, vectors, asked, local)


def _in_tasks(tokenized: DataFrame, embedder, method: str | None, repair: Repair | None, settings: Settings, local: int | None) -> DataFrame:
    """`align` with matrices made in tasks: links with their scores leave these, never cells."""
    methods, temperature = settings.methods, settings.confidence_temperature
    if method is not None and repair and repair.enabled and "mwmf" not in methods:
        raise ProcessingError("repair needs mwmf among the methods that run")
    found = matrices.links(tokenized, embedder, methods, temperature, check=True).withColumnRenamed("methods", "by")
    found = staged(found.select("pair_id", "s", "t", "by", *[c.alias(n) for c, n in zip(scoring.scores(len(methods)), ("similarity", "confidence"), strict=True)]), "scores")
    pick = lambda name: found.where(F.array_contains("by", name)).drop("by")
    asked = asked_of(tokenized) if method is None else None
    chosen = pick(method) if asked is None else found.join(asked.select("pair_id", "method"), "pair_id").where("array_contains(by, method)")
    refine = lambda tokenized, links, repair, wanted=None: refine_in_tasks(tokenized, links, embedder, repair, temperature, local)
    return _finished(tokenized, chosen, pick, refine, methods, repair, asked)


def with_envelope(result: DataFrame, source_language: str, target_language: str, method: str, settings: Settings | None = None) -> DataFrame:
    """Adds what holds for the whole request."""
    from ..options import CONFIDENCE_METHOD

    settings = settings or Settings()
    extra = {"source_language": source_language, "target_language": target_language, "model": settings.model, "embedding_layer": settings.layer, "method": method, "confidence_method": CONFIDENCE_METHOD}
    return result.withColumns({k: F.lit(v) for k, v in extra.items()})
