"""Phrase refinement of one sentence pair: a bounded kernel over numpy matrices, run inside mapInArrow.

Links, confidences and locks are matrices of source x target tokens; a span is a box of two half-open ranges.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np

from ..options import Repair
from .partition import Region, partitions

#: Fixed value of the refinement: tokens of both sides that one partition may span.
LOCAL_TOKENS = 64
TINY = 1e-12


class Box(NamedTuple):
    s0: int
    s1: int
    t0: int
    t1: int

    @property
    def rows(self) -> slice:
        return slice(self.s0, self.s1)

    @property
    def cols(self) -> slice:
        return slice(self.t0, self.t1)

    @property
    def shape(self) -> tuple[int, int]:
        return self.s1 - self.s0, self.t1 - self.t0


@dataclass
class Group:
    sources: list[int]
    targets: list[int]
    links: list[tuple[int, int]]
    similarity: float
    confidence: float


@dataclass
class Pair:
    """What is known of a pair. `anchor` marks cells whose tokens may anchor each other: equal placeholders or two punctuation marks."""

    sim: np.ndarray
    rel: np.ndarray
    links: np.ndarray
    conf: np.ndarray
    locked: np.ndarray
    anchor: np.ndarray
    s_content: np.ndarray
    t_content: np.ndarray
    s_vec: np.ndarray | None = None
    t_vec: np.ndarray | None = None


def bounded(x: float) -> float:
    return round(min(1.0, max(0.0, float(x))), 6)


def headroom(new: float, old: float) -> float:
    """Share of what was missing to 1 that is gained."""
    return (new - old) / max(TINY, 1.0 - old) if new > old else 0.0


def block_score(m: np.ndarray, s, t) -> float:
    """Geometric mean of the mean row maximum and the mean column maximum of a sub-matrix."""
    sub = m[s][:, t]
    return math.sqrt(max(0.0, float(sub.max(axis=1).mean()) * float(sub.max(axis=0).mean())))


def components(cells: np.ndarray) -> list[np.ndarray]:
    """Connected components of a boolean matrix's cells (joined by row or column), by their first cell."""
    at = np.argwhere(cells)
    label = {}
    root = list(range(len(at)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, (s, t) in enumerate(at.tolist()):
        for key in (("s", s), ("t", t)):
            a, b = find(label.setdefault(key, i)), find(i)
            root[max(a, b)] = min(a, b)
    return [at[[i for i in range(len(at)) if find(i) == r]] for r in sorted({find(i) for i in range(len(at))})]


def rising_chain(t: list[int], weight: list[float]) -> list[int]:
    """Of items in order, with distinct t, the heaviest chain (their places) whose t rise; of equal ones the longest, then the one whose last item,
    and before it whose item before, comes first. Weights count to a millionth, so equal sums are equal. A Fenwick tree over t
    keeps for each prefix its best chain, as one number: weight, length, and how early it ends. n log n steps."""
    n = len(t)
    bits = max(1, n.bit_length())
    rank = {x: k + 1 for k, x in enumerate(sorted(t))}
    tree, before = [0] * (n + 1), [-1] * n
    best, last = 0, -1
    for k in range(n):
        i, under = rank[t[k]] - 1, 0
        while i:
            under = max(under, tree[i])
            i &= i - 1
        if under:
            before[k] = n - (under & ((1 << bits) - 1))
        own = ((under >> bits) + (round(weight[k] * 1e6) << bits) + 1) << bits | n - k
        if own > best:
            best, last = own, k
        i = rank[t[k]]
        while i <= n:
            tree[i] = max(tree[i], own)
            i += i & -i
    chain = []
    while last >= 0:
        chain.append(last)
        last = before[last]
    return chain[::-1]


class Refiner:
    def __init__(self, pair: Pair, repair: Repair, local: int | None = LOCAL_TOKENS):
        """`local`: tokens of both sides that a partition may span; None for any number."""
        self.p, self.o, self.local = pair, repair, local
        self.links = pair.links.copy()
        self.locked = pair.locked & pair.links
        self.groups: list[Group] = []
        self.grouped: set[tuple[int, int]] = set()
        self.wide = (min(LOCAL_TOKENS, 2 * repair.max_source_span), min(LOCAL_TOKENS, 2 * repair.max_target_span))

    # ------------------------------------------------------------ scores
    def similarity(self, s, t) -> float:
        p = self.p
        if p.s_vec is not None and p.t_vec is not None:
            a, b = p.s_vec[s].mean(axis=0), p.t_vec[t].mean(axis=0)
            norm = float(np.linalg.norm(a) * np.linalg.norm(b))
            if norm > 0:
                return bounded((float(a @ b) / norm + 1) / 2)
        return bounded(block_score(p.sim, s, t))

    def box_similarity(self, b: Box) -> float:
        return self.similarity(b.rows, b.cols)

    def mean_conf(self, cells: np.ndarray) -> float:
        return float(self.p.conf[cells].mean()) if cells.any() else 0.0

    def refined(self, b: Box, support: float, links: np.ndarray) -> Group:
        touch = np.zeros_like(links)
        touch[b.rows, :] = links[b.rows, :]
        touch[:, b.cols] = links[:, b.cols]
        sim = self.box_similarity(b)
        conf = 0.40 * block_score(self.p.rel, b.rows, b.cols) + 0.25 * self.mean_conf(touch) + 0.20 * sim + 0.15 * support
        return Group(list(range(b.s0, b.s1)), list(range(b.t0, b.t1)), [], sim, bounded(conf))

    # ------------------------------------------------------------ hard anchors and regions
    def anchors(self) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        for s, t in np.argwhere(self.links & self.p.anchor).tolist():
            if not out or (s > out[-1][0] and t > out[-1][1]):
                out.append((s, t))
        return out

    def drop_crossing(self) -> None:
        firm = self.locked | (self.p.conf >= max(0.55, self.o.min_confidence + 0.10))
        crossing = np.zeros_like(self.links)
        for s, t in self.anchors():
            crossing[:s, t + 1 :] = True
            crossing[s + 1 :, :t] = True
        self.links &= firm | ~crossing

    def regions(self) -> list[tuple[Box, float]]:
        n, m = self.links.shape
        s_ok = self.p.s_content | self.locked.any(axis=1)
        t_ok = self.p.t_content | self.locked.any(axis=0)
        stops = [(-1, -1, 0), *((s, t, 1) for s, t in self.anchors()), (n, m, 0)]
        out = []
        for (a, b, real), (c, d, also) in itertools.pairwise(stops):
            box = Box(a + 1, c, b + 1, d)
            if min(box.shape) > 0 and real + also and s_ok[box.rows].all() and t_ok[box.cols].all():
                out.append((box, (real + also) / 2))
        return out

    def inside(self, b: Box) -> np.ndarray:
        out = np.zeros_like(self.links)
        out[b.rows, b.cols] = self.links[b.rows, b.cols]
        return out

    def closed(self, b: Box, links: np.ndarray) -> bool:
        """No link has just one end in the box."""
        n = int(links[b.rows, b.cols].sum())
        return n == int(links[b.rows, :].sum()) == int(links[:, b.cols].sum())

    def low_coverage(self, b: Box, own: np.ndarray) -> bool:
        if min(b.shape) < 2 or own.sum() < 2 or not self.closed(b, self.links):
            return False
        cover = (own.any(axis=1)[b.rows].mean(), own.any(axis=0)[b.cols].mean())
        least = self.o.min_span_coverage
        return min(cover) < least and max(cover) >= min(0.5, least)

    @staticmethod
    def one_to_one(own: np.ndarray) -> list[tuple[int, int]]:
        return np.argwhere(own & (own.sum(axis=1, keepdims=True) == 1) & (own.sum(axis=0, keepdims=True) == 1)).tolist()

    # ------------------------------------------------------------ reversed runs
    def reversed_runs(self, own: np.ndarray) -> list[Box]:
        chain = [(s, t) for s, t in self.one_to_one(own) if not self.locked[s, t]]
        s_lock, t_lock = self.locked.any(axis=1), self.locked.any(axis=0)

        def follows(first, last, new) -> bool:
            step, drop = new[0] - last[0], last[1] - new[1]
            if drop <= 0 or (step == 1 and drop > 1):
                return False
            if new[0] - first[0] + 1 > self.wide[0] or first[1] - new[1] + 1 > self.wide[1]:
                return False
            return not (s_lock[first[0] : new[0] + 1].any() or t_lock[new[1] : first[1] + 1].any())

        out, i = [], 0
        while i < len(chain):
            j = i + 1
            while j < len(chain) and follows(chain[i], chain[j - 1], chain[j]):
                j += 1
            first, last = chain[i], chain[j - 1]
            swapped = j - i == 2 and last == (first[0] + 1, first[1] - 1)
            if j - i >= 3 or swapped:
                out.append(Box(first[0], last[0] + 1, last[1], first[1] + 1))
                i = j
            else:
                i += 1
        return out

    # ------------------------------------------------------------ gaps between anchors of a region
    def bounded_gaps(self, b: Box, own: np.ndarray) -> list[Box]:
        stops = [(b.s0 - 1, b.t0 - 1)]
        for s, t in self.one_to_one(own):
            if s > stops[-1][0] and t > stops[-1][1]:
                stops.append((s, t))
        stops.append((b.s1, b.t1))
        s_used, t_used = own.any(axis=1), own.any(axis=0)
        gaps = []
        for (a, c), (d, e) in itertools.pairwise(stops):
            g = Box(a + 1, d, c + 1, e)
            if min(g.shape) < 1 or s_used[g.rows].any() or t_used[g.cols].any():
                continue
            if g.shape[0] > self.o.max_source_span or g.shape[1] > self.o.max_target_span:
                continue
            if self.box_similarity(g) >= self.o.min_similarity:
                gaps.append(g)
        return self.merge_gaps(gaps, own)

    def merge_gaps(self, gaps: list[Box], own: np.ndarray) -> list[Box]:
        out, i = [], 0
        while i < len(gaps):
            whole = Box(gaps[i].s0, gaps[i + 1].s1, gaps[i].t0, gaps[i + 1].t1) if i + 1 < len(gaps) else None
            if whole and self.worth_merging(whole, gaps[i], gaps[i + 1], own):
                out.append(whole)
                i += 2
            else:
                out.append(gaps[i])
                i += 1
        return out

    def worth_merging(self, whole: Box, first: Box, second: Box, own: np.ndarray) -> bool:
        if whole.shape[0] > self.wide[0] or whole.shape[1] > self.wide[1] or not self.closed(whole, own):
            return False
        within = np.zeros_like(own)
        within[whole.rows, whole.cols] = own[whole.rows, whole.cols]
        if not within.any() or (within & (self.locked | (self.p.conf >= max(0.55, self.o.min_confidence + 0.10)))).any():
            return False
        parts = [(np.arange(first.s0, first.s1), np.arange(first.t0, first.t1))]
        parts += [(np.unique(c[:, 0]), np.unique(c[:, 1])) for c in components(within)]
        parts.append((np.arange(second.s0, second.s1), np.arange(second.t0, second.t1)))
        weights = [len(s) + len(t) for s, t in parts]
        base = sum(w * self.similarity(s, t) for w, (s, t) in zip(weights, parts, strict=True)) / sum(weights)
        return headroom(self.box_similarity(whole), base) >= self.o.min_score_gain

    def restores(self, b: Box, own: np.ndarray, gaps: list[Box]) -> bool:
        s, t = own.any(axis=1), own.any(axis=0)
        for g in gaps:
            s[g.rows] = True
            t[g.cols] = True
        return min(s[b.rows].mean(), t[b.cols].mean()) >= self.o.min_span_coverage

    # ------------------------------------------------------------ partition of a region
    def region(self, b: Box, own: np.ndarray) -> Region:
        held = np.zeros_like(self.locked)
        held[b.rows, b.cols] = self.locked[b.rows, b.cols]
        locks = [(sorted({s - b.s0 for s in c[:, 0].tolist()}), sorted({t - b.t0 for t in c[:, 1].tolist()})) for c in components(held)]
        p = self.p
        vec = (None, None) if p.s_vec is None or p.t_vec is None else (p.s_vec[b.rows], p.t_vec[b.cols])
        return Region(p.sim[b.rows, b.cols], p.rel[b.rows, b.cols], own[b.rows, b.cols], *vec, locks)

    def fits_whole(self, b: Box, region: Region) -> bool:
        """The region is within the limits and is, if anything of it is locked, one locked component."""
        within = b.shape[0] <= self.o.max_source_span and b.shape[1] <= self.o.max_target_span
        return within and (not region.locks or (list(range(b.shape[0])), list(range(b.shape[1]))) in region.locks)

    def partition(self, b: Box, own: np.ndarray) -> list[Box] | None:
        if self.local is not None and sum(b.shape) > self.local:
            return None
        region = self.region(b, own)
        if self.fits_whole(b, region):
            return [b]
        (found,) = partitions([region], self.o.max_source_span, self.o.max_target_span)
        return found and [Box(b.s0 + s0, b.s0 + s1, b.t0 + t0, b.t0 + t1) for s0, s1, t0, t1 in found]

    def stable(self, b: Box, own: np.ndarray) -> bool:
        sub = own[b.rows, b.cols]
        return bool(sub.any()) and self.closed(b, own) and bool(sub.any(axis=1).all() and sub.any(axis=0).all())

    # ------------------------------------------------------------ soft anchors
    def soft_anchors(self, least: float) -> list[tuple[int, int]]:
        """Of sure links between content tokens with no other link, the rising chain of greatest confidence; of equal ones the longest."""
        p = self.p
        at = [(s, t) for s, t in self.one_to_one(self.links) if p.conf[s, t] >= least and p.s_content[s] and p.t_content[t]]
        return [at[k] for k in rising_chain([t for _, t in at], [p.conf[x] for x in at])]

    def soft_islands(self) -> tuple[np.ndarray, np.ndarray]:
        n, m = self.links.shape
        s_claimed, t_claimed = np.zeros(n, bool), np.zeros(m, bool)
        least = max(0.45, self.o.min_confidence)
        if self.links.any(axis=1).all() and self.links.any(axis=0).all():
            return s_claimed, t_claimed
        chain = self.soft_anchors(least)
        if len(chain) < 2:
            return s_claimed, t_claimed
        firm = max(0.55, least + 0.10)
        real = lambda x: 0 <= x[0] < n and 0 <= x[1] < m
        for left, right in itertools.pairwise([(-1, -1), *chain, (n, m)]):
            if any(real(x) and (s_claimed[x[0]] or t_claimed[x[1]]) for x in (left, right)):
                continue
            gap = Box(left[0] + 1, right[0], left[1] + 1, right[1])
            if max(gap.shape) == 0 or not (self.p.s_content[gap.rows].all() and self.p.t_content[gap.cols].all()):
                continue
            sub = self.links[gap.rows, gap.cols]
            full = sub.any(axis=1).all() and sub.any(axis=0).all()  # never of a gap on one side
            if full or self.leaves(gap, left, right):
                continue
            span = None
            if min(gap.shape) > 0:
                span = self.island(gap, left if real(left) and self.p.conf[left] < firm else None, right if real(right) and self.p.conf[right] < firm else None)
            elif not sub.any():
                span = self.attach(gap, left if real(left) else None, right if real(right) else None)
            if span is None:
                continue
            self.groups.append(self.refined(span, 0.5, self.links))
            s_claimed[span.rows] = True
            t_claimed[span.cols] = True
            self.links &= ~s_claimed[:, None] & ~t_claimed[None, :]
        return s_claimed, t_claimed

    def leaves(self, gap: Box, left, right) -> bool:
        """A link of the gap's tokens ends outside the two anchors (these included)."""
        lo_s, hi_s, lo_t, hi_t = max(left[0], 0), right[0] + 1, max(left[1], 0), right[1] + 1
        rows, cols = self.links[gap.rows, :], self.links[:, gap.cols]
        return bool(rows[:, :lo_t].any() or rows[:, hi_t:].any() or cols[:lo_s, :].any() or cols[hi_s:, :].any())

    def attach(self, gap: Box, left, right) -> Box | None:
        """A gap on one side only joins the anchor that it suits better; left wins a tie."""
        found = []
        for anchor in (left, right):
            if anchor is None:
                continue
            s, t = anchor
            if gap.shape[0]:
                new = Box(min(s, gap.s0), max(s + 1, gap.s1), t, t + 1)
            else:
                new = Box(s, s + 1, min(t, gap.t0), max(t + 1, gap.t1))
            if new.shape[0] <= self.o.max_source_span and new.shape[1] <= self.o.max_target_span:
                score = self.box_similarity(new)
                if headroom(score, self.box_similarity(Box(s, s + 1, t, t + 1))) >= self.o.min_score_gain:
                    found.append((score, new))
        return max(found, key=lambda x: x[0])[1] if found else None

    def island(self, gap: Box, left, right) -> Box | None:
        """A gap on both sides, alone or with one weak neighbouring anchor."""
        if gap.shape[0] > self.wide[0] or gap.shape[1] > self.wide[1]:
            return None
        base = self.box_similarity(gap)
        found = [(base, gap)]
        for new in (left and gap._replace(s0=left[0], t0=left[1]), right and gap._replace(s1=right[0] + 1, t1=right[1] + 1)):
            if new and new.shape[0] <= self.wide[0] and new.shape[1] <= self.wide[1]:
                score = self.box_similarity(new)
                if headroom(score, base) >= self.o.min_score_gain:
                    found.append((score, new))
        return max(found, key=lambda x: x[0])[1]

    # ------------------------------------------------------------ expansions
    def expansions(self, regions: list[Box]) -> list[Group]:
        s_used, t_used = self.links.any(axis=1), self.links.any(axis=0)
        found = []
        for b in regions:
            for comp in components(self.inside(b)):
                s, t = np.unique(comp[:, 0]), np.unique(comp[:, 1])
                if s[-1] - s[0] + 1 != len(s) or t[-1] - t[0] + 1 != len(t):
                    continue
                own = Box(int(s[0]), int(s[-1]) + 1, int(t[0]), int(t[-1]) + 1)
                base, conf = self.box_similarity(own), float(self.p.conf[comp[:, 0], comp[:, 1]].mean())
                options = []
                if own.shape[1] <= self.o.max_target_span:
                    for a, c in self.wider(own.s0, own.s1, b.s0, b.s1, self.o.max_source_span, s_used):
                        options.append((own._replace(s0=a, s1=c), (s_used[b.rows].sum() + (~s_used[a:c]).sum()) / b.shape[0]))
                if own.shape[0] <= self.o.max_source_span:
                    for a, c in self.wider(own.t0, own.t1, b.t0, b.t1, self.o.max_target_span, t_used):
                        options.append((own._replace(t0=a, t1=c), (t_used[b.cols].sum() + (~t_used[a:c]).sum()) / b.shape[1]))
                for new, cover in options:
                    if cover < self.o.min_span_coverage:
                        continue
                    sim = self.box_similarity(new)
                    gain = sim - base
                    if gain < self.o.min_score_gain:
                        continue
                    score = 0.45 * block_score(self.p.rel, new.rows, new.cols) + 0.30 * conf + 0.15 * float(cover) + 0.10 * min(1.0, gain / max(self.o.min_score_gain, TINY))
                    found.append((new, gain, Group(list(range(new.s0, new.s1)), list(range(new.t0, new.t1)), [tuple(x) for x in comp.tolist()], sim, bounded(score))))
        found.sort(key=lambda x: (-x[1], -x[2].confidence, sum(x[0].shape), x[0].s0, x[0].t0))
        s_taken, t_taken, out = np.zeros_like(s_used), np.zeros_like(t_used), []
        for box, _, group in found:
            # A component's links lie in its box, so free ranges imply free links.
            if not (s_taken[box.rows].any() or t_taken[box.cols].any()):
                s_taken[box.rows] = True
                t_taken[box.cols] = True
                out.append(group)
        return out

    @staticmethod
    def wider(a: int, c: int, lo: int, hi: int, most: int, used: np.ndarray):
        """Ranges around [a, c) inside [lo, hi), of `most` at most, whose added tokens are free."""
        for x in range(lo, a + 1):
            for y in range(c, hi + 1):
                if c - a < y - x <= most and not used[x:a].any() and not used[c:y].any():
                    yield x, y

    # ------------------------------------------------------------ all of it
    def run(self) -> Refiner:
        self.drop_crossing()
        regions = self.regions()
        s_claimed, t_claimed = np.zeros(self.links.shape[0], bool), np.zeros(self.links.shape[1], bool)
        if not regions:
            s_claimed, t_claimed = self.soft_islands()
            regions = self.regions()
        left = []
        for b, support in regions:
            spans: list[Box] = []
            own = self.inside(b)
            if not (s_claimed[b.rows].any() or t_claimed[b.cols].any()):
                spans = self.choose(b, own)
            if not spans:
                left.append(b)
                continue
            self.groups += [self.refined(x, support, own) for x in spans]
            for x in spans:
                self.links[x.rows, :] = False
                self.links[:, x.cols] = False
        if self.o.strategy == "span-aware":
            more = self.expansions(left)
            self.groups += more
            self.grouped = {x for g in more for x in g.links}
        self.groups.sort(key=lambda g: (g.sources[0], g.targets[0]))
        return self

    def choose(self, b: Box, own: np.ndarray) -> list[Box]:
        low = self.low_coverage(b, own)
        runs = self.reversed_runs(own)
        if runs or not low:
            return runs
        gaps = self.bounded_gaps(b, own)
        if gaps and self.restores(b, own, gaps):
            return gaps
        return [x for x in self.partition(b, own) or [] if not self.stable(x, own)]
