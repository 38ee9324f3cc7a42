"""Small cases with given matrices and links, whose results follow from the rules by hand; tests run them through the whole assembly."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from duolex.operators.tokens import tokenize
from duolex.options import Repair
from duolex.plans.align import align_cells


def _pairs(text: str) -> list[tuple[int, int]]:
    return [tuple(map(int, x.split("-"))) for x in text.split()]


@dataclass(frozen=True)
class Case:
    """Texts; links of `itermax` (and of `mwmf`, where it has others); similarities other than 0.9 on links and 0.1 elsewhere; vectors of both sides;
    the groups that come out as (sources, targets, origin, similarity, links inside), and what stays unaligned on both sides."""

    source: str
    target: str
    links: str
    groups: tuple[tuple[str, str, str, float, int], ...]
    left: tuple[str, str] = ("", "")
    mwmf: str = ""
    sims: tuple[tuple[int, int, float], ...] = ()
    vectors: tuple[tuple, tuple] | None = None


def _each(*ends: str) -> tuple:
    """One-to-one groups of model links."""
    return tuple((s, t, "model", 0.9, 1) for s, t in (x.split("-") for x in ends))


PLAIN = {
    "order": Case("old ships sail far", "alte fahren weit hinaus", "0-0 1-0 2-1 3-2 3-3", (("0,1", "0", "model", 0.9, 2), ("2", "1", "model", 0.9, 1), ("3", "2,3", "model", 0.9, 2))),
    "left": Case("good extra", "gut mehr noch", "0-0 7-7 0-9", _each("0-0"), ("1", "1,2")),
    "empty": Case(" ", "x y", "", (), ("", "0,1")),
    "marks": Case("Put {{a}} near {{a}} or ${b}", "${b} {{a}} bei {{a}} {{c}}", "0-1 2-2 4-4", (("1", "1", "rule", 1.0, 1), ("2", "2", "model", 0.9, 1), ("3", "3", "rule", 1.0, 1), ("5", "0", "rule", 1.0, 1)), ("0,4", "4")),
    "date": Case("May 1999 report", "1999 年 5 月 Bericht heute", "0-0 1-4 2-4 2-5", (("0", "2,3", "rule", 1.0, 2), ("1", "0,1", "rule", 1.0, 2), ("2", "4,5", "model", 0.9, 2))),
    "share": Case("25 % of it", "es sind 25 % davon", "1-1 3-0", (("0,1", "2,3", "rule", 1.0, 4), ("3", "0", "model", 0.9, 1)), ("2", "1,4")),
}
ONE, OTHER = (1.0, 0.0), (0.0, 1.0)
REPAIRED = {
    "added": Case("we saw the small red boat .", "wir sahen das kleine rote Boot .", "0-0 1-1 2-2 3-3 5-5 6-6", (*_each("0-0", "1-1", "2-2", "3-3"), ("4", "4", "repaired", 0.9, 1), *_each("5-5", "6-6")), mwmf="0-0 1-1 2-2 3-3 4-4 5-5 6-6"),
    "far": Case("alpha beta", "eins zwei drei vier fuenf", "0-0", _each("0-0"), ("1", "1,2,3,4"), mwmf="0-0 1-1"),
    "taken": Case("gold coin", "Gold", "0-0", _each("0-0"), ("1", ""), mwmf="1-0"),
    "dim": Case("gold thing", "Gold Ding", "0-0", _each("0-0"), ("1", "1"), mwmf="0-0 1-1", sims=((1, 1, 0.3),)),
    "mark": Case("gold !", "Gold Ding", "0-0", _each("0-0"), ("1", "1"), mwmf="0-0 1-1"),
    "weak": Case("vor , nach", "before , later", "0-0 1-1 2-0", _each("0-0", "1-1"), ("2", "2"), sims=((2, 0, 0.6),)),
    "run": Case("x , a b c d .", "x , D C B A .", "0-0 1-1 2-5 3-4 4-3 5-2 6-6", (*_each("0-0", "1-1"), ("2,3,4,5", "2,3,4,5", "refined", 0.9, 0), *_each("6-6"))),
    "swap": Case("red house , big", "Haus rot , gross", "0-1 1-0 2-2 3-3", (("0,1", "0,1", "refined", 0.9, 0), *_each("2-2", "3-3"))),
    "holder": Case("{{n}} a b", "{{n}} B A", "1-2 2-1", (("0", "0", "rule", 1.0, 1), ("1,2", "1,2", "refined", 0.9, 0))),
    "gap": Case("a b c d .", "A B C D .", "0-0 3-3 4-4", (*_each("0-0"), ("1,2", "1,2", "refined", 0.8, 0), *_each("3-3", "4-4")), sims=((1, 1, 0.8), (2, 2, 0.8))),
    "parts": Case("a b c d e f .", "A B C .", "0-0 1-1 6-3", (*_each("0-0"), ("1,2,3", "1", "refined", 1.0, 0), ("4,5", "2", "refined", 1.0, 0), *_each("6-3")), vectors=((ONE,) * 7, (ONE,) * 4)),
    "island": Case("a b c d e f", "A B C D E F", "0-0 1-1 4-4 5-5", (*_each("0-0", "1-1"), ("2,3", "2,3", "refined", 0.1, 0), *_each("4-4", "5-5"))),
    "attach": Case("a b c d", "A B C", "0-0 1-1 3-2", (*_each("0-0"), ("1,2", "1", "refined", 1.0, 0), *_each("3-2")), vectors=(((-1.0, 0.0), ONE, OTHER, (1.0, -1.0)), ((-1.0, 0.0), (1.0, 1.0), (1.0, -1.0)))),
}
WIDENED = {
    "wider": Case("New York .", "Newyork .", "0-0 2-1", (("0,1", "0", "refined", 1.0, 1), *_each("2-1")), vectors=((ONE, OTHER, ONE), ((1.0, 1.0), ONE))),
    "kept": Case("New York .", "Neu .", "0-0 2-1", _each("0-0", "2-1"), ("1", ""), vectors=((ONE, OTHER, ONE), (ONE, ONE))),
}
SETS = {
    "golden_align": (PLAIN, ("itermax", "inter", "mwmf"), None),
    "golden_repaired": (REPAIRED, ("itermax", "mwmf"), Repair()),
    "golden_span_aware": (WIDENED, ("itermax", "mwmf"), Repair(strategy="span-aware")),
}
#: Matrices of weights for the maximum-weight matching.
MATRICES = {
    "swap": ((0.9, 0.8), (0.8, 0.1)), "wide": ((0.2, 0.9, 0.4), (0.3, 0.95, 0.1)), "tall": ((0.5, 0.1), (0.6, 0.55), (0.7, 0.2)), "chain": ((0.9, 0.85, 0.0), (0.88, 0.9, 0.86), (0.0, 0.87, 0.3)),
    "four": ((0.7, 0.6, 0.5, 0.1), (0.72, 0.3, 0.2, 0.65), (0.1, 0.61, 0.64, 0.66), (0.69, 0.2, 0.63, 0.6)), "lone": ((0.4,),),
}


def _softmax(values: list[float]) -> list[float]:
    e = [math.exp((x - max(values)) / 0.1) for x in values]
    return [x / sum(e) for x in e]


def aligned(spark: SparkSession, name: str) -> DataFrame:
    cases, methods, repair = SETS[name]
    texts = spark.createDataFrame([(k, c.source, c.target) for k, c in cases.items()], "pair_id string, source string, target string")
    cells, links, vectors = [], [], []
    for k, c in cases.items():
        by = {"itermax": _pairs(c.links), "mwmf": _pairs(c.mwmf or c.links)}
        n, m = (len(x.split()) for x in (c.source, c.target))
        sims = [[0.1] * m for _ in range(n)]
        for s, t in by["itermax"] + by["mwmf"]:
            if s < n and t < m:
                sims[s][t] = 0.9
        for s, t, x in c.sims:
            sims[s][t] = x
        p, q = [_softmax(r) for r in sims], [_softmax(list(r)) for r in zip(*sims, strict=True)]
        cells += [(k, s, t, sims[s][t], p[s][t], q[t][s]) for s in range(n) for t in range(m)]
        links += [(k, x, s, t) for x, ls in by.items() for s, t in ls]
        for side, vs in zip(("source", "target"), c.vectors or ((), ()), strict=True):
            vectors += [(k, side, i, list(v)) for i, v in enumerate(vs)]
    return align_cells(
        tokenize(texts),
        spark.createDataFrame(cells, "pair_id string, s int, t int, sim double, p_st double, p_ts double"),
        spark.createDataFrame(links, "pair_id string, method string, s int, t int"),
        methods, "itermax", repair,
        spark.createDataFrame(vectors, "pair_id string, side string, idx int, vec array<double>") if vectors else None,
    )


def matrices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, s, t, x) for k, m in MATRICES.items() for s, r in enumerate(m) for t, x in enumerate(r)], "pair_id string, s int, t int, sim double")
