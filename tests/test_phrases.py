"""Tiles against whole matrices, phrase candidates as relations against the kernel's own choices, and their parts against plain versions."""

import itertools
import random
import time
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from duolex.functions.staging import staged
from duolex.operators import cells as C
from duolex.operators import groups, matching, phrases, regions, scoring, tiles
from duolex.operators.partition import Region, crossings, partitions, span_scores, block_scores
from duolex.operators.refine import Box, Pair, Refiner, block_score, rising_chain
from duolex.options import Repair, Settings
from duolex.plans.align import align
from duolex.operators.vectors import HashEmbedder

VECTORS = "pair_id string, side string, idx int, vec array<double>"


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    pool, rows = rng.normal(size=(12, 5)), []
    for pair, (n, m) in {"a": (9, 17), "b": (1, 1), "c": (20, 3), "d": (2, 0), "e": (16, 16)}.items():
        for side, k in (("source", n), ("target", m)):
            rows += [(pair, side, i, pool[rng.integers(12)].tolist()) for i in range(k)]
    return staged(spark.createDataFrame(rows, VECTORS), "vectors")


@pytest.mark.parametrize("width", [1, 7, None])
def test_tiles_give_what_the_whole_matrix_does(spark, vectors, width):
    """Equal vectors stand in many places, so ties are everywhere."""
    cells = staged(C.cells(vectors), "cells")
    want = sorted(map(tuple, matching.method_links(cells, ("fwd", "rev", "inter", "itermax")).collect()))
    found = staged(tiles.tiled_links(vectors, width), "links")
    assert sorted(map(tuple, found.collect())) == want
    exact = {(r.pair_id, r.s, r.t): r for r in scoring.margins(cells).collect()}
    got = tiles.tiled_cells(vectors, found.select("pair_id", "s", "t").distinct(), width).collect()
    assert len(got) == len({x[:1] + x[2:] for x in want})
    assert all(abs(r[c] - exact[r.pair_id, r.s, r.t][c]) < 1e-12 for r in got for c in ("sim", "rel", "p_st", "p_ts", "margin"))
    assert tiles.tiled_links(vectors.limit(0), width).count() == 0


def test_states_merge_in_any_order():
    rng = np.random.default_rng(2)
    for _ in range(60):
        m = rng.integers(0, 6, (4, 11)) / 6
        cuts = [0, *sorted(rng.choice(range(1, 11), 3, replace=False)), 11]
        parts = [(m[:, a:b], a) for a, b in itertools.pairwise(cuts)]
        rng.shuffle(parts := list(parts))
        best, total = None, None
        for x, a in parts:
            value, at = tiles.best_of(x)
            state = (value, np.where(at >= 0, at + a, -1))
            best = state if best is None else tiles.merge_best(best, state)
            total = tiles.total_of(x, 0.1) if total is None else tiles.merge_total(total, tiles.total_of(x, 0.1), 0.1)
        whole = tiles.best_of(m)
        assert (best[0] == whole[0]).all() and (best[1] == whole[1]).all()
        assert np.allclose(total, tiles.total_of(m, 0.1), rtol=1e-12)


def test_long_pairs_align_without_their_matrix(spark):
    table = HashEmbedder(spark.createDataFrame([(i, [float(x) for x in np.random.default_rng(i).normal(size=4)]) for i in range(50)], "vec_id long, embedding array<double>"))
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice(["red", "house", "sun", "sea", "old", "wind", ",", "and"]) + (str(rng.randint(0, 9)) if rng.random() < 0.5 else "") for _ in range(n))
    pairs = spark.createDataFrame([("long", text(150), text(170)), ("short", "a b.", "c d."), ("none", "a", "")], "pair_id string, source string, target string")
    few = Settings(matching_methods="ai")
    want, got = ({r.pair_id: r for r in align(pairs, table, settings=few, tile=t).collect()} for t in (None, 16))
    assert want == got and len(got["long"].links) > 20
    with pytest.raises(ValueError):
        align(pairs, table, tile=16)
    with pytest.raises(ValueError):
        align(pairs, table, repair=Repair(), settings=few, tile=16)


def test_dominance_counts():
    rng = np.random.default_rng(7)
    for _ in range(80):
        n = int(rng.integers(1, 60))
        s, t = rng.integers(0, 12, n), rng.integers(0, 12, n)
        want = ((s[None, :] < s[:, None]) & (t[None, :] < t[:, None])).sum(axis=1)
        assert scoring.dominated(s, t).tolist() == want.tolist()
    s, t = rng.permutation(1_000_000), rng.permutation(1_000_000)
    began = time.time()
    share = scoring.kept_order(s, t)
    assert time.time() - began < 60 and abs(share.mean() - 0.5) < 0.01


def test_links_that_cross_anchors(spark):
    rng = random.Random(5)
    links, anchors, want = [], [], []
    for p in range(60):
        a = sorted(zip(sorted(rng.sample(range(12), 3)), sorted(rng.sample(range(12), 3)), strict=True))
        anchors += [(str(p), s, t) for s, t in a]
        for _ in range(8):
            s, t, conf, rule = rng.randint(0, 12), rng.randint(0, 12), rng.choice([0.2, 0.7]), rng.random() < 0.2
            links.append((str(p), s, t, conf, rule))
            if rule or conf >= 0.55 or not any((s - x) * (t - y) < 0 for x, y in a):
                want.append(links[-1])
    links.append(("none", 3, 1, 0.1, False))
    got = regions.drop_crossing(spark.createDataFrame(links, "pair_id string, s int, t int, confidence double, rule boolean"), spark.createDataFrame(anchors, "pair_id string, s int, t int"), 0.35)
    assert sorted(map(tuple, got.collect())) == sorted([*want, links[-1]])


def test_component_numbers():
    rng = random.Random(4)
    for _ in range(100):
        links = sorted({(rng.randint(0, 8), rng.randint(0, 8)) for _ in range(rng.randint(1, 12))})
        rng.shuffle(links)
        label = {x: k for k, x in enumerate(sorted(links))}
        while any(label[a] != label[b] for a in links for b in links if a[0] == b[0] or a[1] == b[1]):
            for a, b in itertools.product(links, links):
                if a[0] == b[0] or a[1] == b[1]:
                    label[a] = label[b] = min(label[a], label[b])
        number = {x: k for k, x in enumerate(sorted(set(label.values())))}
        assert groups.component_numbers(*map(list, zip(*links, strict=True))) == [number[label[x]] for x in links]


def test_rising_chains():
    rng = random.Random(8)
    for _ in range(200):
        n = rng.randint(1, 9)
        t, w = rng.sample(range(20), n), [rng.choice([0.5, 0.25, 0.75, 0.123457]) for _ in range(n)]
        every = [c for k in range(1, n + 1) for c in itertools.combinations(range(n), k) if all(t[a] < t[b] for a, b in itertools.pairwise(c))]
        best = max((sum(round(w[k] * 1e6) for k in c), len(c)) for c in every)
        got = rising_chain(t, w)
        assert (sum(round(w[k] * 1e6) for k in got), len(got)) == best and all(t[a] < t[b] for a, b in itertools.pairwise(got))
    assert rising_chain([], []) == []
    began, many = time.time(), list(range(100_000))
    rng.shuffle(many)
    chain = rising_chain(many, [rng.random() for _ in many])
    assert time.time() - began < 30 and len(chain) > 100


def random_pair(rng, n, m, locks=False):
    have = rng.random((n, m)) < rng.choice([0.1, 0.25])
    if rng.random() < 0.5:  # a few swapped neighbours and falling runs
        for k in range(0, min(n, m) - 2, 3):
            have[k : k + 3, k : k + 3] = np.eye(3, dtype=bool)[::-1]
    sim = np.round(rng.random((n, m)), 2)
    locked = have & (rng.random((n, m)) < 0.15) if locks else np.zeros((n, m), bool)
    s_vec, t_vec = rng.integers(-1, 2, (n, 3)).astype(float), rng.integers(-1, 2, (m, 3)).astype(float)
    s_vec[:, 0], t_vec[:, 0] = 1.0, 1.0
    return Pair(sim, np.round(rng.random((n, m)), 2), have, np.where(have, np.round(rng.random((n, m)), 2), 0.0), locked, np.zeros((n, m), bool), np.ones(n, bool), np.ones(m, bool), s_vec, t_vec)


def plain_partition(region: Region, most_s: int, most_t: int):
    """All partitions, by trying every first segment; scores as the definition says."""
    n, m = region.own.shape

    def worth(s0, s1, t0, t1):
        ids = (list(range(s0, s1)), list(range(t0, t1)))
        if any(ids != lock and (set(ids[0]) & set(lock[0]) or set(ids[1]) & set(lock[1])) for lock in region.locks):
            return None
        at = np.argwhere(region.own[s0:s1, t0:t1]).tolist()
        if min(s1 - s0, t1 - t0) > 1 and ids not in region.locks and not any(a[0] < b[0] and a[1] > b[1] for a, b in itertools.product(at, at)):
            return None
        a, b = region.s_vec[s0:s1].mean(axis=0), region.t_vec[t0:t1].mean(axis=0)
        sim = round((a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) + 1) / 2, 6)
        long, short, n_long, n_short = (s1, t1, n, m) if n >= m else (t1, s1, m, n)
        even = max(0, 1 - abs(long - int(short * n_long / n_short + 0.5)) / n_long)
        return (0.45 * sim + 0.10 * block_score(region.rel, slice(s0, s1), slice(t0, t1)) + 0.45 * even) * (s1 - s0 + t1 - t0) - 0.02

    def ways(s, t):
        if (s, t) == (n, m):
            yield 0.0, []
        for a, b in itertools.product(range(1, min(most_s, n - s) + 1), range(1, min(most_t, m - t) + 1)):
            w = worth(s, s + a, t, t + b)
            if w is not None:
                for rest, path in ways(s + a, t + b):
                    yield w + rest, [(a, b), *path]

    best = max(ways(0, 0), key=lambda x: (round(x[0], 9), -len(x[1]), x[1]), default=None)
    if best is None:
        return None
    out, s, t = [], 0, 0
    for a, b in best[1]:
        out.append((s, s + a, t, t + b))
        s, t = s + a, t + b
    return out


def test_partitions_are_the_best_of_all():
    rng = np.random.default_rng(11)
    regions_, some = [], 0
    for k in range(60):
        p = random_pair(rng, int(rng.integers(1, 6)), int(rng.integers(1, 6)), locks=k % 2 == 0)
        regions_.append(Refiner(p, Repair()).region(Box(0, p.links.shape[0], 0, p.links.shape[1]), p.links))
    for most in ((2, 3), (3, 6), (1, 1)):
        for r, got in zip(regions_, partitions(regions_, *most), strict=True):
            assert got == plain_partition(r, *most)
            some += got is not None
    assert some > 60


def test_equal_scores_take_fewer_segments_then_larger_ones():
    even = lambda n, m: Region(np.ones((n, m)), np.ones((n, m)), np.ones((n, m), bool), np.ones((n, 2)), np.ones((m, 2)))
    for n, m in ((2, 4), (4, 2), (3, 5)):
        (got,) = partitions([even(n, m)], 3, 6)
        assert got == plain_partition(even(n, m), 3, 6)
    assert crossings(np.array([[0, 1], [1, 0]], bool), 2, 2).tolist() == [[False, False], [False, True]]


def test_window_scores():
    rng = np.random.default_rng(13)
    p = random_pair(rng, 6, 7)
    region = Refiner(p, Repair()).region(Box(0, 6, 0, 7), p.links)
    for a, b in itertools.product((1, 2, 3), (1, 2, 5)):
        for i, j in itertools.product(range(a, 7), range(b, 8)):
            s, t = slice(i - a, i), slice(j - b, j)
            assert abs(block_scores(region.rel, a, b)[i - 1, j - 1] - block_score(p.rel, s, t)) < 1e-12
            assert abs(span_scores(region, a, b)[i - 1, j - 1] - Refiner(p, Repair()).similarity(s, t)) < 2e-6


# ---------------------------------------------------------------- relations against the kernel
LOOSE = Repair(min_similarity=0.2, min_confidence=0.0, min_score_gain=0.0, min_span_coverage=0.1)


@pytest.fixture(scope="module")
def many(spark):
    """Random pairs, each one region; all as tables and as the kernel's own form."""
    rng = np.random.default_rng(21)
    pairs = {str(k): random_pair(rng, int(rng.integers(2, 12)), int(rng.integers(2, 14)), locks=k % 3 == 0) for k in range(90)}
    for k in range(24):  # falling runs, some of them long, some with a step to the side
        p, n = random_pair(rng, 16, 16), int(rng.integers(2, 15))
        p.links[:], p.locked[:] = False, False
        s, t = np.arange(16), np.arange(16)
        t[1 : 1 + n] = t[1 : 1 + n][::-1]
        stay = rng.random(16) < 0.85
        p.links[s[stay], t[stay]] = True
        p.locked[0, 0] = p.links[0, 0]
        pairs[f"r{k}"] = p
    gap = np.zeros((6, 6), bool)
    gap[0, 0] = gap[2, 2] = gap[5, 5] = True  # gaps on both sides of a weak link, to be merged
    for k in range(12):
        p = random_pair(rng, 6, 6)
        p.links, p.conf, p.locked = gap.copy(), np.where(gap, 0.3, 0.0), np.zeros_like(gap)
        p.s_vec[[1, 3]], p.t_vec[[1, 3]] = rng.normal(size=(2, 3)), rng.normal(size=(2, 3))
        pairs[f"m{k}"] = p
    for k in range(3):  # a gap that restores the coverage
        p = random_pair(rng, 5, 5)
        p.links[:], p.locked[:] = False, False
        p.links[[0, 3, 4], [0, 3, 4]] = True
        p.s_vec[:], p.t_vec[:] = 1.0, 1.0
        pairs[f"g{k}"] = p
    links = [(k, int(s), int(t), 0.5, float(p.conf[s, t]), bool(p.locked[s, t])) for k, p in pairs.items() for s, t in np.argwhere(p.links)]
    cells = [(k, s, t, float(p.sim[s, t]), float(p.rel[s, t])) for k, p in pairs.items() for s in range(p.sim.shape[0]) for t in range(p.sim.shape[1])]
    vec = [(k, side, i, v.tolist()) for k, p in pairs.items() for side, vs in (("source", p.s_vec), ("target", p.t_vec)) for i, v in enumerate(vs)]
    make = lambda rows, kind, name: staged(spark.createDataFrame(rows, kind), name)
    return pairs, {
        "regions": make([(k, 0, p.links.shape[0], 0, p.links.shape[1]) for k, p in pairs.items()], "pair_id string, s0 int, s1 int, t0 int, t1 int", "regions"),
        "links": make(links, "pair_id string, s int, t int, similarity double, confidence double, rule boolean", "links"),
        "cells": make(cells, "pair_id string, s int, t int, sim double, rel double", "cells"),
        "vectors": make(vec, VECTORS, "vectors"),
    }


def whole(p):
    return Box(0, p.links.shape[0], 0, p.links.shape[1])


def test_reverse_runs(many):
    pairs, t = many
    for o in (LOOSE, Repair(max_source_span=2, max_target_span=2)):
        want = [(k, 0, *b) for k, p in pairs.items() for b in Refiner(p, o).reversed_runs(p.links)]
        assert sorted(map(tuple, phrases.reverse_runs(t["regions"], t["links"], o).collect())) == sorted(want) and len(want) > 15


def test_gaps_and_their_merging(many):
    pairs, t = many
    plain, merged = [], []
    for k, p in pairs.items():
        r = Refiner(p, LOOSE)
        merged += [(k, 0, *b) for b in r.bounded_gaps(whole(p), p.links)]
        r.merge_gaps = lambda gaps, own: gaps
        plain += [(k, 0, *b, r.box_similarity(b)) for b in r.bounded_gaps(whole(p), p.links)]
    got = phrases.bounded_gaps(t["regions"], t["links"], t["vectors"], LOOSE).collect()
    assert sorted(tuple(r)[:6] for r in map(lambda r: (r.pair_id, r.region, r.s0, r.s1, r.t0, r.t1), got)) == sorted(x[:6] for x in plain)
    assert all(abs(r.similarity - next(x[6] for x in plain if x[:3] == (r.pair_id, 0, r.s0))) < 2e-6 for r in got)
    assert sorted(map(tuple, phrases.merged_gaps(t["regions"], t["links"], t["vectors"], LOOSE).collect())) == sorted(merged)
    assert 0 < len(merged) < len(plain)


def test_expansions(many):
    pairs, t = many
    want = []
    for k, p in pairs.items():
        want += [(k, min(g.sources), max(g.sources) + 1, min(g.targets), max(g.targets) + 1, g.confidence) for g in Refiner(p, LOOSE).expansions([whole(p)])]
    got = phrases.span_expansions(t["regions"], t["links"], t["cells"], t["vectors"], LOOSE).collect()
    assert sorted((r.pair_id, r.s0, r.s1, r.t0, r.t1) for r in got) == sorted(x[:5] for x in want) and len(want) > 20
    conf = {x[:5]: x[5] for x in want}
    assert all(abs(r.confidence - conf[r.pair_id, r.s0, r.s1, r.t0, r.t1]) < 2e-6 for r in got)


def test_choices_among_candidates(spark, many):
    """Each pair as one region: runs, gaps or partition, and the scores of its groups, as the kernel chooses."""
    pairs, t = many
    seen = set()
    for o in (replace(LOOSE, min_span_coverage=0.75), replace(LOOSE, min_span_coverage=0.4)):
        want, cut = {}, []
        for k, p in pairs.items():
            r = Refiner(p, o)
            cut += [(k, 0, *map(int, b)) for b in r.partition(whole(p), p.links) or []]
            for b in r.choose(whole(p), p.links):
                g = r.refined(b, 0.5, p.links)
                want[k, *map(int, b)] = (g.similarity, g.confidence)
        segments = spark.createDataFrame(cut, "pair_id string, region int, s0 int, s1 int, t0 int, t1 int")
        got = phrases.region_choices(t["regions"].withColumn("support", F.lit(0.5)), t["links"], segments, t["cells"], t["vectors"], o).collect()
        found = {(r.pair_id, r.s0, r.s1, r.t0, r.t1): (r.similarity, r.confidence) for r in got}
        assert found.keys() == want.keys() and all(abs(a - b) < 2e-6 for k in want for a, b in zip(found[k], want[k], strict=True))
        seen |= {r.choice for r in got}
    assert seen == {"runs", "gaps", "partition"}


def test_conflict_rounds_are_the_greedy_choice(spark):
    """With many ties in the first key; one pair in which each box waits for the one before it."""
    rng = random.Random(17)
    rows = [(str(p), s := rng.randint(0, 9), s + rng.randint(1, 3), t := rng.randint(0, 9), t + rng.randint(1, 3), rng.randint(0, 3), k) for p in range(40) for k in range(rng.randint(1, 25))]
    rows += [("row", k, k + 2, k, k + 2, 9, k) for k in range(9)]
    want = []
    for p in {r[0] for r in rows}:
        taken = []
        for r in sorted((r for r in rows if r[0] == p), key=lambda r: (-r[5], r[6])):
            if not any(a[1] < r[2] and r[1] < a[2] or a[3] < r[4] and r[3] < a[4] for a in taken):
                taken.append(r)
        want += taken
    boxes = spark.createDataFrame(rows, "pair_id string, s0 int, s1 int, t0 int, t1 int, gain int, k int")
    assert sorted(map(tuple, phrases.without_conflict(boxes, F.desc("gain"), "k").collect())) == sorted(want)
    assert phrases.without_conflict(boxes.limit(0), "k").count() == 0


def test_matching_certificates(spark):
    rng = np.random.default_rng(23)
    shapes = [(1, 1), (3, 5), (5, 3), (6, 6), (9, 2)]
    cells = staged(spark.createDataFrame([(str(k), s, t, float(x)) for k, shape in enumerate(shapes) for (s, t), x in np.ndenumerate(rng.random(shape).round(1) * 0.9 + 0.05)], "pair_id string, s int, t int, sim double"), "cells")
    found = staged(matching.solved(cells), "solved")
    rows = matching.certificate(cells, found).collect()
    assert len(rows) == 5 and all(r.violated == 0 and abs(r.weight - r.dual) < 1e-9 and r.n_links == min(shapes[int(r.pair_id)]) for r in rows)
    # A matching that isn't the heaviest, with the same potentials, is told.
    worse = found.where("side is null and pair_id = '3'").withColumn("t", (F.col("t") + 1) % 6).unionByName(found.where("side is not null and pair_id = '3'"))
    (r,) = matching.certificate(cells.where("pair_id = '3'"), worse).collect()
    assert r.violated > 0 and r.weight < r.dual - 1e-9
