"""The queries of the registry in DuckDB SQL, built from shared common table expressions."""

from __future__ import annotations

import re

from .functions.text import PROTECTED_RE2, TOKEN_RE2
from .operators.rules import MONTHS, NUMERALS
from .sources.pairs import MONTHS as WRITTEN


def _q(s: str) -> str:
    return s.replace("'", "''")


def _values(table: dict[str, int]) -> str:
    return ", ".join(f"('{_q(k)}', {v})" for k, v in table.items())


CTES = {
    **{
        name: (
            [],
            f"""SELECT conv_id, turn - {back} AS turn, unnest(range(len(x))) AS k, unnest(x) AS text FROM (SELECT conv_id, turn, regexp_extract_all(text, '[^.]*[.]|[^.]+') AS x FROM conversations WHERE role = '{side}')""",
        )
        for name, side, back in (("asked", "user", 0), ("given", "assistant", 1))
    },
    "talk": (["asked", "given"], "SELECT concat_ws(':', conv_id, turn, k) AS pair_id, coalesce(u.text, '') AS source, coalesce(a.text, '') AS target FROM asked u FULL JOIN given a USING (conv_id, turn, k)"),
    # Each turn beside the one behind it.
    "turns": ([], "SELECT concat_ws(':', conv_id, c.turn) AS pair_id, coalesce(c.text, '') AS source, coalesce(d.text, '') AS target FROM conversations c LEFT JOIN (SELECT conv_id, turn - 1 AS turn, text FROM conversations) d USING (conv_id, turn)"),
    "lit": (
        [],
        f"""SELECT 'o' || o_orderkey AS pair_id,
        'Keep [[' || o_orderkey || ']] from ' || ([{', '.join(f"'{m}'" for m in WRITTEN)}])[month(o_orderdate)] || ' ' || year(o_orderdate) || ' at ' || o_custkey % 100 || '% or ' || o_custkey % 100 || '％ , ${{x}} done' AS source,
        year(o_orderdate) || ' 年 ' || month(o_orderdate) || ' 月 0' || o_custkey % 100 || '% [[' || o_orderkey || ']] ${{x}} ' || year(o_orderdate) || '年 ok' AS target FROM orders""",
    ),
    "page": ([], "SELECT page_id::VARCHAR AS pair_id, html AS source, url AS target FROM pages"),
    **{
        f"{p}_tok": (
            [p],
            f"""SELECT pair_id, side, (unnest(range(len(x))))::INT AS idx, unnest(x) AS text FROM (SELECT pair_id, 'source' AS side, regexp_extract_all(source, '{_q(TOKEN_RE2)}') AS x FROM {p}
            UNION ALL SELECT pair_id, 'target', regexp_extract_all(target, '{_q(TOKEN_RE2)}') FROM {p})""",
        )
        for p in ("talk", "lit", "page", "turns")
    },
    **{f"{p}_tokens": ([f"{p}_tok"], f"SELECT *, regexp_matches(text, '{_q(PROTECTED_RE2)}') AS is_protected FROM {p}_tok") for p in ("talk", "lit", "page")},
    "sizes": (["talk_tok"], "SELECT pair_id, count(*) FILTER (side = 'source') AS n_s, count(*) FILTER (side = 'target') AS n_t FROM talk_tok GROUP BY pair_id"),
    "vec": (
        ["talk_tok"],
        "SELECT t.pair_id, t.side, t.idx, t.text, e.embedding::DOUBLE[] AS v FROM talk_tok t JOIN embeddings e ON e.vec_id = ('0x' || substr(md5(lower(t.text)), 1, 8))::BIGINT % (SELECT count(*) FROM embeddings)",
    ),
    "sim": (
        ["vec"],
        "SELECT a.pair_id, a.idx AS s, b.idx AS t, greatest(0, least(1, (list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) + 1) / 2)) AS sim FROM vec a JOIN vec b ON a.pair_id = b.pair_id AND a.side = 'source' AND b.side = 'target'",
    ),
    "ranked": (["sim"], "SELECT *, row_number() OVER (PARTITION BY pair_id, s ORDER BY sim DESC, t) AS rank_st, row_number() OVER (PARTITION BY pair_id, t ORDER BY sim DESC, s) AS rank_ts FROM sim"),
    "rel": (
        ["ranked"],
        """SELECT pair_id, s, t, sim, rank_st, rank_ts, 1 / (1 + exp(-greatest(-60, least(60, (2 * sim - r - c) / 0.1)))) AS rel FROM (SELECT *, avg(sim) FILTER (rank_st <= 3) OVER (PARTITION BY pair_id, s) AS r,
        avg(sim) FILTER (rank_ts <= 3) OVER (PARTITION BY pair_id, t) AS c FROM ranked)""",
    ),
    "cells": (
        ["rel"],
        """SELECT * EXCLUDE (e1, e2), e1 / sum(e1) OVER (PARTITION BY pair_id, s) AS p_st, e2 / sum(e2) OVER (PARTITION BY pair_id, t) AS p_ts FROM (SELECT *,
        exp((rel - max(rel) OVER (PARTITION BY pair_id, s)) / 0.1) AS e1, exp((rel - max(rel) OVER (PARTITION BY pair_id, t)) / 0.1) AS e2 FROM rel)""",
    ),
    "inter": (["ranked"], "SELECT pair_id, s, t, sim FROM ranked WHERE rank_st = 1 AND rank_ts = 1"),
    "iter": (
        ["ranked"],
        """SELECT pair_id, s, t, sim FROM (SELECT *, row_number() OVER (PARTITION BY pair_id, s ORDER BY w DESC, t) AS a, row_number() OVER (PARTITION BY pair_id, t ORDER BY w DESC, s) AS b FROM (SELECT *,
        CASE e WHEN 2 THEN 0 WHEN 1 THEN 0.9 * sim ELSE sim END::DOUBLE AS w FROM (SELECT *, max(l) OVER (PARTITION BY pair_id, s) + max(l) OVER (PARTITION BY pair_id, t) AS e
        FROM (SELECT *, (rank_st = 1 AND rank_ts = 1)::INT AS l FROM ranked)))) WHERE l = 1 OR (a = 1 AND b = 1 AND w > 0)""",
    ),
    "ml": (["inter", "iter"], "SELECT pair_id, 'inter' AS method, s, t FROM inter UNION ALL SELECT pair_id, 'itermax', s, t FROM iter"),
    "margins": (
        ["cells"],
        """SELECT *, (CASE WHEN k1 = 1 AND x1 IS NOT NULL THEN rel - x1 ELSE 0 END + CASE WHEN k2 = 1 AND x2 IS NOT NULL THEN rel - x2 ELSE 0 END) / 2 AS margin FROM (SELECT *,
        max(rel) FILTER (k1 = 2) OVER (PARTITION BY pair_id, s) AS x1, max(rel) FILTER (k2 = 2) OVER (PARTITION BY pair_id, t) AS x2 FROM (SELECT *, row_number() OVER (PARTITION BY pair_id, s ORDER BY rel DESC, t) AS k1,
        row_number() OVER (PARTITION BY pair_id, t ORDER BY rel DESC, s) AS k2 FROM cells))""",
    ),
    "orders_": (
        ["ml"],
        """SELECT pair_id, s, t, avg(share) AS order_score, count(*) AS n_in FROM (SELECT a.pair_id, a.method, a.s, a.t, coalesce(avg(CASE WHEN b.s IS NULL THEN NULL WHEN (b.s - a.s) * (b.t - a.t) > 0 THEN 1.0 ELSE 0.0 END), 0.5) AS share
        FROM ml a LEFT JOIN ml b ON a.pair_id = b.pair_id AND a.method = b.method AND a.s != b.s AND a.t != b.t GROUP BY ALL) GROUP BY ALL""",
    ),
    "scored": (
        ["margins", "orders_", "sizes", "iter"],
        """SELECT i.pair_id, i.s, i.t, round(m.sim, 6) AS similarity, round(least(1, greatest(0, 0.35 * sqrt(p_st * p_ts) + 0.30 * margin + 0.20 * coalesce(n_in, 0) / 2
        + 0.15 * round(least(1, greatest(0, 0.7 * coalesce(order_score, 0) + 0.3 * (1 - abs((i.s + 0.5) / n_s - (i.t + 0.5) / n_t)))), 6))), 6) AS confidence
        FROM iter i JOIN margins m USING (pair_id, s, t) LEFT JOIN orders_ USING (pair_id, s, t) JOIN sizes USING (pair_id)""",
    ),
    "nxt": (["lit_tokens"], "SELECT *, CASE WHEN NOT lead(is_protected) OVER w THEN lead(text) OVER w END AS nx FROM lit_tokens WINDOW w AS (PARTITION BY pair_id, side ORDER BY idx)"),
    "tspan": (
        ["nxt"],
        f"""SELECT pair_id, side, idx, kind, value, len, row_number() OVER (PARTITION BY pair_id, side, kind, value ORDER BY idx) AS occ FROM (SELECT pair_id, side, idx,
        CASE WHEN m.v IS NOT NULL THEN 'month' WHEN regexp_matches(text, '^[12][0-9]{{3}}年?$') THEN 'year' WHEN regexp_matches(text, '^[0-9]{{1,2}}月$') OR text LIKE '%月' OR nx = '月' THEN 'month' END AS kind,
        coalesce(m.v, CASE WHEN regexp_matches(text, '^[12][0-9]{{3}}年?$') THEN substr(text, 1, 4)::INT END, CASE WHEN regexp_matches(text, '^[0-9]{{1,2}}月$') THEN CASE WHEN replace(text, '月', '')::INT BETWEEN 1 AND 12 THEN replace(text, '月', '')::INT END END,
          u.v, CASE WHEN nx = '月' AND regexp_matches(text, '^[0-9]{{1,2}}$') AND TRY_CAST(text AS INT) BETWEEN 1 AND 12 THEN TRY_CAST(text AS INT) END, CASE WHEN nx = '月' THEN c.v END)::VARCHAR AS value,
        CASE WHEN m.v IS NULL AND (regexp_matches(text, '^[12][0-9]{{3}}$') AND nx = '年' OR nx = '月' AND (regexp_matches(text, '^[0-9]{{1,2}}$') OR c.v IS NOT NULL)) THEN 2 ELSE 1 END AS len
        FROM nxt LEFT JOIN (VALUES {_values(MONTHS)}) m(k, v) ON m.k = rtrim(lower(text), '.') LEFT JOIN (VALUES {_values({k + '月': v for k, v in NUMERALS.items()})}) u(k, v) ON u.k = text
        LEFT JOIN (VALUES {_values(NUMERALS)}) c(k, v) ON c.k = text WHERE NOT is_protected) WHERE value IS NOT NULL""",
    ),
    "qspan": (
        ["nxt"],
        """SELECT pair_id, side, idx, 'percent' AS kind, value, len, row_number() OVER (PARTITION BY pair_id, side, value ORDER BY idx) AS occ FROM (SELECT pair_id, side, idx, text::INT::VARCHAR AS value, 2 AS len FROM nxt
        WHERE NOT is_protected AND regexp_matches(text, '^[0-9]+$') AND nx IN ('%', '％'))""",
    ),
    "pspan": (["lit_tokens"], "SELECT pair_id, side, idx, 'protected' AS kind, text AS value, 1 AS len, row_number() OVER (PARTITION BY pair_id, side, text ORDER BY idx) AS occ FROM lit_tokens WHERE is_protected"),
    **{
        f"{x}links": (
            [f"{x}span"],
            f"""SELECT DISTINCT pair_id, s, t FROM (SELECT a.pair_id, unnest(range(a.idx, a.idx + a.len))::INT AS s, b.idx AS bi, b.len AS bl FROM {x}span a JOIN {x}span b ON a.pair_id = b.pair_id AND a.kind = b.kind AND a.value = b.value AND a.occ = b.occ
            AND a.side = 'source' AND b.side = 'target'), LATERAL (SELECT unnest(range(bi, bi + bl))::INT AS t)""",
        )
        for x in "tqp"
    },
    # Links that the rules override, one rule after the other: diagonal ones that stand in for a model's, and those of the matrix.
    "diag": (["lit_tokens"], "SELECT a.pair_id, a.idx AS s, b.idx AS t FROM lit_tokens a JOIN lit_tokens b ON a.pair_id = b.pair_id AND a.side = 'source' AND b.side = 'target' AND a.idx = b.idx"),
    **{
        f"{p}1": (
            [base, "lit_tokens", "plinks"],
            f"""SELECT d.pair_id, d.s, d.t FROM {base} d WHERE NOT EXISTS (FROM lit_tokens x WHERE x.pair_id = d.pair_id AND x.is_protected AND (x.side = 'source' AND x.idx = d.s OR x.side = 'target' AND x.idx = d.t)) UNION SELECT * FROM plinks""",
        )
        for p, base in (("o", "diag"), ("m", "lit_iter"))
    },
    **{
        f"{p}{n}": ([f"{p}{n - 1}", f"{x}links"], f"SELECT o.* FROM {p}{n - 1} o WHERE NOT EXISTS (FROM {x}links x WHERE x.pair_id = o.pair_id AND (x.s = o.s OR x.t = o.t)) UNION SELECT * FROM {x}links")
        for p in "om"
        for n, x in ((2, "t"), (3, "q"))
    },
    "ruled": (["plinks", "tlinks", "qlinks"], "SELECT * FROM plinks UNION SELECT * FROM tlinks UNION SELECT * FROM qlinks"),
    # Links of literal pairs with what they come from.
    "told": (
        ["m3", "ruled", "lit_scored"],
        """SELECT o.pair_id, o.s, o.t, CASE WHEN r.s IS NULL THEN 'model' ELSE 'rule' END AS origin, CASE WHEN r.s IS NULL THEN similarity ELSE 1 END AS similarity, CASE WHEN r.s IS NULL THEN confidence ELSE 1 END AS confidence
        FROM m3 o LEFT JOIN ruled r ON r.pair_id = o.pair_id AND r.s = o.s AND r.t = o.t LEFT JOIN lit_scored c ON c.pair_id = o.pair_id AND c.s = o.s AND c.t = o.t""",
    ),
    "told_walk": (["told"], "SELECT pair_id, s, s AS r FROM told UNION SELECT w.pair_id, b.s, w.r FROM told_walk w JOIN told a ON a.pair_id = w.pair_id AND a.s = w.s JOIN told b ON b.pair_id = a.pair_id AND b.t = a.t"),
    "told_comp": (["told_walk"], "SELECT i.*, w.comp FROM told i JOIN (SELECT pair_id, s, min(r) AS comp FROM told_walk GROUP BY ALL) w USING (pair_id, s)"),
    # Connected components of a pair's links: every source that is reached from a source along shared ends.
    "walk": (
        ["iter"],
        "SELECT pair_id, s, s AS r FROM iter UNION SELECT w.pair_id, b.s, w.r FROM walk w JOIN iter a ON a.pair_id = w.pair_id AND a.s = w.s JOIN iter b ON b.pair_id = a.pair_id AND b.t = a.t",
    ),
    "comp": (["walk"], "SELECT i.pair_id, i.s, i.t, min(w.r) AS comp FROM iter i JOIN walk w ON i.pair_id = w.pair_id AND i.s = w.s GROUP BY ALL"),
    # Two neighbouring sentences are a request; what is wrong with it; the links of those that are served.
    "ask": (
        ["talk"],
        """SELECT *, concat_ws(':', conv, turn, place) AS request_id, CASE WHEN conv % 5 = 0 THEN 'mwmf' WHEN place % 3 = 0 THEN 'inter' ELSE 'itermax' END AS method FROM (SELECT pair_id, source, target, split_part(pair_id, ':', 1)::INT AS conv,
        split_part(pair_id, ':', 2)::INT AS turn, split_part(pair_id, ':', 3)::INT // 2 AS place FROM talk)""",
    ),
    "refused": (
        ["ask"],
        r"""SELECT DISTINCT request_id, e FROM (SELECT request_id, unnest([CASE WHEN conv % 5 = 0 THEN 'method is not enabled' END, CASE WHEN conv % 7 = 1 THEN 'repair needs mwmf' END, CASE WHEN conv % 11 = 3 THEN 'source_language' END,
        CASE WHEN NOT regexp_matches(source, '[^\s]') OR len(source) > 10000 THEN 'source' END, CASE WHEN NOT regexp_matches(target, '[^\s]') OR len(target) > 10000 THEN 'target' END]) AS e FROM ask) WHERE e IS NOT NULL""",
    ),
    "served": (["refused", "ask"], "SELECT pair_id, method FROM ask ANTI JOIN refused USING (request_id)"),
    "served_comp": (
        ["served", "inter", "comp", "scored"],
        """SELECT pair_id, s, t, comp, 'model' AS origin, similarity, confidence FROM (SELECT pair_id, s, t, comp, 'itermax' AS method FROM comp UNION ALL SELECT pair_id, s, t, s, 'inter' FROM inter) JOIN served USING (pair_id, method) JOIN scored USING (pair_id, s, t)""",
    ),
    # Links between punctuation marks, and of them the greedy chain whose both ends rise.
    "mark": (
        ["iter", "talk_tokens"],
        r"""SELECT i.pair_id, i.s::INT AS s, i.t::INT AS t FROM iter i JOIN talk_tokens a ON a.pair_id = i.pair_id AND a.side = 'source' AND a.idx = i.s JOIN talk_tokens b ON b.pair_id = i.pair_id AND b.side = 'target' AND b.idx = i.t
        WHERE CASE WHEN a.is_protected OR b.is_protected THEN a.is_protected AND b.is_protected AND a.text = b.text ELSE regexp_matches(a.text, '^\p{P}+$') AND regexp_matches(b.text, '^\p{P}+$') END""",
    ),
    "anchor": (
        ["mark"],
        """SELECT pair_id, x.s AS s, x.t AS t FROM (SELECT pair_id, unnest(list_reduce(list([{'s': s, 't': t}] ORDER BY s, t), lambda a, x: CASE WHEN x[1].s > a[-1].s AND x[1].t > a[-1].t THEN list_concat(a, x) ELSE a END)) AS x
        FROM mark GROUP BY pair_id)""",
    ),
    # Repair: row-wise argmax links in place of a matching, mutual ones as the base.
    "ml3": (["ml", "ranked"], "SELECT * FROM ml UNION ALL SELECT pair_id, 'mwmf', s, t FROM ranked WHERE rank_st = 1"),
    "orders3": (
        ["ml3"],
        """SELECT pair_id, s, t, avg(share) AS order_score, count(*) AS n_in FROM (SELECT a.pair_id, a.method, a.s, a.t, coalesce(avg(CASE WHEN b.s IS NULL THEN NULL WHEN (b.s - a.s) * (b.t - a.t) > 0 THEN 1.0 ELSE 0.0 END), 0.5) AS share
        FROM ml3 a LEFT JOIN ml3 b ON a.pair_id = b.pair_id AND a.method = b.method AND a.s != b.s AND a.t != b.t GROUP BY ALL) GROUP BY ALL""",
    ),
    "content": (["talk_tokens"], r"SELECT pair_id, side, idx FROM talk_tokens WHERE NOT is_protected AND regexp_matches(text, '[\p{L}\p{N}]')"),
    "open_": (
        ["ranked", "inter", "content", "sizes"],
        """SELECT r.pair_id, r.s, r.t, n_s, n_t, abs((r.s + 0.5) / n_s - (r.t + 0.5) / n_t) AS distance FROM ranked r JOIN sizes USING (pair_id) WHERE rank_st = 1
        AND (r.pair_id, r.s) NOT IN (SELECT (pair_id, s) FROM inter) AND (r.pair_id, r.t) NOT IN (SELECT (pair_id, t) FROM inter)
        AND (r.pair_id, r.s) IN (SELECT (pair_id, idx) FROM content WHERE side = 'source') AND (r.pair_id, r.t) IN (SELECT (pair_id, idx) FROM content WHERE side = 'target')""",
    ),
    "firm": (
        ["open_", "margins", "orders3"],
        """SELECT o.*, round(m.sim, 6) AS similarity, round(least(1, greatest(0, 0.35 * sqrt(p_st * p_ts) + 0.30 * margin + 0.20 * coalesce(n_in, 0) / 3
        + 0.15 * round(least(1, greatest(0, 0.7 * coalesce(order_score, 0) + 0.3 * (1 - distance))), 6))), 6) AS first FROM open_ o JOIN margins m USING (pair_id, s, t) LEFT JOIN orders3 USING (pair_id, s, t) WHERE distance <= 0.6 AND round(m.sim, 6) >= 0.3""",
    ),
    # The nearest linked source before and behind, and the targets it has.
    "beside": (
        ["firm", "inter"],
        """SELECT f.pair_id, f.s, f.t, arg_max(hi, e.s) FILTER (e.s < f.s) AS lo_t, arg_min(lo, e.s) FILTER (e.s > f.s) AS hi_t FROM firm f
        LEFT JOIN (SELECT pair_id, s, min(t) AS lo, max(t) AS hi FROM inter GROUP BY ALL) e ON e.pair_id = f.pair_id GROUP BY ALL""",
    ),
    "added": (
        ["firm", "beside"],
        """SELECT *, round(least(1, greatest(0, first * (0.75 + 0.15 * greatest(0, 1 - distance / 0.6) + 0.10 * CASE WHEN lo_t IS NULL AND hi_t IS NULL THEN 0.5
        ELSE (coalesce((t >= lo_t)::INT, 0) + coalesce((t <= hi_t)::INT, 0)) / ((lo_t IS NOT NULL)::INT + (hi_t IS NOT NULL)::INT) END))), 6) AS confidence FROM firm JOIN beside USING (pair_id, s, t)""",
    ),
    "gaps": (
        ["anchor", "sizes"],
        """SELECT * FROM (SELECT pair_id, s + 1 AS s0, lead(s) OVER w AS s1, t + 1 AS t0, lead(t) OVER w AS t1, (real + lead(real) OVER w) / 2 AS support FROM (SELECT pair_id, s, t, 1 AS real FROM anchor
        UNION ALL SELECT pair_id, -1, -1, 0 FROM sizes UNION ALL SELECT pair_id, n_s, n_t, 0 FROM sizes) WINDOW w AS (PARTITION BY pair_id ORDER BY s)) WHERE s1 > s0 AND t1 > t0 AND support > 0""",
    ),
    "region": (
        ["gaps", "talk_tok"],
        r"""SELECT g.* FROM gaps g WHERE NOT EXISTS (FROM talk_tok x WHERE x.pair_id = g.pair_id AND NOT regexp_matches(x.text, '[\p{L}\p{N}]') AND (x.side = 'source' AND x.idx >= s0 AND x.idx < s1 OR x.side = 'target' AND x.idx >= t0 AND x.idx < t1))""",
    ),
}

def _sets(spans: str) -> str:
    """The tokens of spans (pair_id, s0, s1, t0, t1)."""
    return f"SELECT pair_id, s0, s1, t0, t1, 'source' AS side, unnest(range(s0, s1)) AS idx FROM {spans} UNION ALL SELECT pair_id, s0, s1, t0, t1, 'target', unnest(range(t0, t1)) FROM {spans}"


def _likeness(sets: str, *keys: str) -> str:
    """(cos + 1) / 2 of the sums of vectors on both sides of sets of tokens, from the products of all their tokens."""
    k = ", ".join(keys)
    both = " AND ".join(f"a.{x} = b.{x}" for x in keys)
    part = lambda x, y: f"sum(d) FILTER (a.side = '{x}' AND b.side = '{y}')"
    return f"""SELECT {', '.join(f'a.{x}' for x in keys)}, round(greatest(0, least(1, ({part('source', 'target')} / (sqrt({part('source', 'source')}) * sqrt({part('target', 'target')})) + 1) / 2)), 6) AS similarity
        FROM {sets} a JOIN {sets} b ON {both} JOIN dots ON dots.pair_id = a.pair_id AND dots.x = a.side AND dots.i = a.idx AND dots.y = b.side AND dots.j = b.idx GROUP BY {', '.join(f'a.{x}' for x in keys)}"""


def _block(spans: str) -> str:
    """Root of the mean row maximum times the mean column maximum of the relative matrix of spans."""
    k = "pair_id, s0, s1, t0, t1"
    cell = f"(SELECT {k}, s, t, rel FROM (SELECT *, unnest(range(t0, t1)) AS t FROM (SELECT *, unnest(range(s0, s1)) AS s FROM {spans})) JOIN rel USING (pair_id, s, t))"
    return f"SELECT * FROM (SELECT {k}, avg(m) AS f FROM (SELECT {k}, s, max(rel) AS m FROM {cell} GROUP BY ALL) GROUP BY ALL) JOIN (SELECT {k}, avg(m) AS r FROM (SELECT {k}, t, max(rel) AS m FROM {cell} GROUP BY ALL) GROUP BY ALL) USING ({k})"


#: Phrases of regions: limits of 3 sources and 6 targets, min_similarity 0.4, min_confidence 0.2, min_score_gain 0, min_span_coverage 0.3.
CTES |= {
    "dots": (["vec"], "SELECT a.pair_id, a.side AS x, a.idx AS i, b.side AS y, b.idx AS j, list_dot_product(a.v, b.v) AS d FROM vec a JOIN vec b USING (pair_id)"),
    "own": (["region", "scored"], "SELECT *, count(*) OVER (PARTITION BY pair_id, s0, s) = 1 AND count(*) OVER (PARTITION BY pair_id, s0, t) = 1 AS single FROM (SELECT r.pair_id, s0, s1, t0, t1, x.s, x.t, confidence FROM region r JOIN scored x ON x.pair_id = r.pair_id AND s >= s0 AND s < s1 AND t >= t0 AND t < t1)"),
    "island": (
        ["own"],
        """SELECT *, sum(CASE WHEN p - t > 0 AND (s - q > 1 OR p - t = 1) THEN 0 ELSE 1 END) OVER (PARTITION BY pair_id, s0 ORDER BY s) AS island FROM (SELECT pair_id, s0, s, t, row_number() OVER w AS n, lag(s) OVER w AS q, lag(t) OVER w AS p
        FROM own WHERE single WINDOW w AS (PARTITION BY pair_id, s0 ORDER BY s))""",
    ),
    # How far a run from each link goes, whether it is one, and where the search goes on.
    "reach": (
        ["island"],
        """SELECT *, CASE WHEN good THEN last + 1 ELSE n + 1 END AS next FROM (SELECT a.pair_id, a.s0, a.n, any_value(a.s) AS s, any_value(a.t) AS t, max(b.n) AS last, max(b.s) AS s_last, min(b.t) AS t_last,
        max(b.n) - a.n >= 2 OR max(b.n) - a.n = 1 AND max(b.s) = any_value(a.s) + 1 AND min(b.t) = any_value(a.t) - 1 AS good
        FROM island a JOIN island b ON a.pair_id = b.pair_id AND a.s0 = b.s0 AND a.island = b.island AND b.n >= a.n AND b.s - a.s < 6 AND a.t - b.t < 12 GROUP BY a.pair_id, a.s0, a.n)""",
    ),
    "hop": (["reach"], "SELECT pair_id, s0, n, next FROM reach WHERE n = 1 UNION ALL SELECT h.pair_id, h.s0, r.n, r.next FROM hop h JOIN reach r ON r.pair_id = h.pair_id AND r.s0 = h.s0 AND r.n = h.next"),
    "stop": (
        ["own"],
        """SELECT pair_id, s0, s1, t0, t1, list_append(list_reduce(list_prepend({'s': s0 - 1, 't': t0 - 1}, coalesce(x, [])).list_transform(lambda y: [y]), lambda a, y: CASE WHEN y[1].s > a[-1].s AND y[1].t > a[-1].t THEN list_concat(a, y) ELSE a END), {'s': s1, 't': t1}) AS x
        FROM region LEFT JOIN (SELECT pair_id, s0, list({'s': s::BIGINT, 't': t::BIGINT} ORDER BY s) AS x FROM own WHERE single GROUP BY ALL) USING (pair_id, s0)""",
    ),
    "hole": (
        ["stop"],
        """SELECT * FROM (SELECT pair_id, region, a.s + 1 AS s0, b.s AS s1, a.t + 1 AS t0, b.t AS t1 FROM (SELECT pair_id, s0 AS region, unnest(x[:-2]) AS a, unnest(x[2:]) AS b FROM stop)) g WHERE s1 - s0 BETWEEN 1 AND 3 AND t1 - t0 BETWEEN 1 AND 6
        AND NOT EXISTS (FROM own o WHERE o.pair_id = g.pair_id AND o.s0 = g.region AND (o.s >= g.s0 AND o.s < g.s1 OR o.t >= g.t0 AND o.t < g.t1))""",
    ),
    "hole_set": (["hole"], _sets("hole")),
    "hole_like": (["hole_set", "dots"], _likeness("hole_set", "pair_id", "s0", "s1", "t0", "t1")),
    "gap": (["hole", "hole_like"], "SELECT * FROM hole JOIN hole_like USING (pair_id, s0, s1, t0, t1) WHERE similarity >= 0.4"),
    # Neighbouring gaps, with what lies in their box.
    "beside_gap": (
        ["gap"],
        """SELECT * FROM (SELECT pair_id, region, n, s0, lead(s1) OVER w AS s1, t0, lead(t1) OVER w AS t1, similarity AS v1, lead(similarity) OVER w AS v2, s1 - s0 + t1 - t0 AS w1, lead(s1 - s0 + t1 - t0) OVER w AS w2
        FROM (SELECT *, row_number() OVER (PARTITION BY pair_id, region ORDER BY s0) AS n FROM gap) WINDOW w AS (PARTITION BY pair_id, region ORDER BY s0)) WHERE s1 - s0 <= 6 AND t1 - t0 <= 12""",
    ),
    "linked_box": (
        ["beside_gap", "own"],
        """SELECT b.pair_id, region, n, bool_and(o.s >= b.s0 AND o.s < b.s1 AND o.t >= b.t0 AND o.t < b.t1 AND confidence < 0.55) AS good FROM beside_gap b JOIN own o ON o.pair_id = b.pair_id AND o.s0 = region
        AND (o.s >= b.s0 AND o.s < b.s1 OR o.t >= b.t0 AND o.t < b.t1) GROUP BY ALL HAVING good""",
    ),
    "own_walk": (["own"], "SELECT pair_id, s0, s, s AS r FROM own UNION SELECT w.pair_id, w.s0, b.s, w.r FROM own_walk w JOIN own a ON a.pair_id = w.pair_id AND a.s0 = w.s0 AND a.s = w.s JOIN own b ON b.pair_id = a.pair_id AND b.s0 = a.s0 AND b.t = a.t"),
    "own_comp": (["own_walk"], "SELECT o.pair_id, o.s0, o.s1, o.t0, o.t1, o.s, o.t, confidence, min(w.r) AS comp FROM own o JOIN own_walk w ON w.pair_id = o.pair_id AND w.s0 = o.s0 AND w.s = o.s GROUP BY ALL"),
    "part_set": (
        ["linked_box", "own_comp"],
        """SELECT DISTINCT b.pair_id, b.region, b.n, comp, unnest(['source', 'target']) AS side, unnest([c.s, c.t]) AS idx FROM linked_box JOIN beside_gap b USING (pair_id, region, n) JOIN own_comp c ON c.pair_id = b.pair_id AND c.s0 = b.region AND c.s >= b.s0 AND c.s < b.s1""",
    ),
    "part_like": (["part_set", "dots"], _likeness("part_set", "pair_id", "region", "n", "comp")),
    "box_set": (["linked_box"], _sets("(FROM beside_gap SEMI JOIN linked_box USING (pair_id, region, n))")),
    "box_like": (["box_set", "dots"], _likeness("box_set", "pair_id", "s0", "s1", "t0", "t1")),
    "merge": (
        ["part_like", "box_like", "part_set"],
        """SELECT pair_id, region, n FROM (SELECT b.pair_id, b.region, b.n, l.similarity AS whole, (w1 * v1 + w2 * v2 + p.v) / (w1 + w2 + p.k) AS base FROM beside_gap b JOIN box_like l USING (pair_id, s0, s1, t0, t1)
        JOIN (SELECT pair_id, region, n, sum(k * similarity) AS v, sum(k) AS k FROM part_like JOIN (SELECT pair_id, region, n, comp, count(*) AS k FROM part_set GROUP BY ALL) USING (pair_id, region, n, comp) GROUP BY ALL) p USING (pair_id, region, n))
        WHERE CASE WHEN whole > base THEN (whole - base) / greatest(1e-12, 1 - base) ELSE 0 END >= 0""",
    ),
    "gap_next": (["gap", "merge"], "SELECT g.*, m.n IS NOT NULL AS takes FROM (SELECT *, row_number() OVER (PARTITION BY pair_id, region ORDER BY s0) AS n FROM gap) g LEFT JOIN merge m USING (pair_id, region, n)"),
    "gap_hop": (["gap_next"], "SELECT pair_id, region, n, takes FROM gap_next WHERE n = 1 UNION ALL SELECT h.pair_id, h.region, g.n, g.takes FROM gap_hop h JOIN gap_next g ON g.pair_id = h.pair_id AND g.region = h.region AND g.n = h.n + CASE WHEN h.takes THEN 2 ELSE 1 END"),
    "merged_gap": (
        ["gap_hop"],
        "SELECT g.pair_id, g.region, g.s0, CASE WHEN g.takes THEN x.s1 ELSE g.s1 END AS s1, g.t0, CASE WHEN g.takes THEN x.t1 ELSE g.t1 END AS t1 FROM gap_hop h JOIN gap_next g USING (pair_id, region, n) LEFT JOIN gap_next x ON x.pair_id = g.pair_id AND x.region = g.region AND x.n = g.n + 1",
    ),
    # Segments of regions with their worth.
    "segment": (
        ["region"],
        """SELECT pair_id, region, s0 + i - a AS s0, s0 + i AS s1, t0 + j - b AS t0, t0 + j AS t1, i, j, a, b, n, m FROM (SELECT *, unnest(range(b, m + 1)) AS j FROM (SELECT *, unnest(range(1, least(6, m) + 1)) AS b FROM (SELECT *, unnest(range(a, n + 1)) AS i FROM
        (SELECT pair_id, s0 AS region, s0, t0, s1 - s0 AS n, t1 - t0 AS m, unnest(range(1, least(3, s1 - s0) + 1)) AS a FROM region WHERE s1 - s0 + t1 - t0 <= 64 AND NOT (s1 - s0 <= 3 AND t1 - t0 <= 6)))))""",
    ),
    "crossed": (["segment", "own"], "SELECT DISTINCT g.pair_id, g.region, g.i, g.j, g.a, g.b FROM segment g JOIN own x ON x.pair_id = g.pair_id AND x.s0 = g.region AND x.s >= g.s0 AND x.s < g.s1 AND x.t >= g.t0 AND x.t < g.t1 JOIN own y ON y.pair_id = g.pair_id AND y.s0 = g.region AND y.s > x.s AND y.s < g.s1 AND y.t < x.t AND y.t >= g.t0"),
    "allowed": (["segment", "crossed"], "SELECT * FROM segment WHERE least(a, b) = 1 UNION ALL SELECT * FROM segment SEMI JOIN crossed USING (pair_id, region, i, j, a, b)"),
    "allowed_set": (["allowed"], _sets("allowed")),
    "allowed_like": (["allowed_set", "dots"], _likeness("allowed_set", "pair_id", "s0", "s1", "t0", "t1")),
    "allowed_block": (["allowed", "rel"], _block("allowed")),
    "worth": (
        ["allowed", "allowed_like", "allowed_block"],
        """SELECT g.*, (0.45 * similarity + 0.10 * sqrt(f * r) + 0.45 * greatest(0, 1 - CASE WHEN n >= m THEN abs(i - floor(j * n / m + 0.5)) ELSE abs(j - floor(i * m / n + 0.5)) END / greatest(n, m))) * (a + b) - 0.02 AS w
        FROM allowed g JOIN allowed_like USING (pair_id, s0, s1, t0, t1) JOIN allowed_block USING (pair_id, s0, s1, t0, t1)""",
    ),
    # Points by waves; the clock of a region is its point (-1, -1). Paths are shapes as numbers that order like them.
    "wave": (
        ["worth"],
        """(SELECT pair_id, region, 0 AS i, 0 AS j, 0::DOUBLE AS score, []::INT[] AS path, 1 AS clock FROM (SELECT DISTINCT pair_id, region FROM worth) UNION ALL SELECT DISTINCT pair_id, region, -1, -1, 0, []::INT[], 1 FROM worth)
        UNION (SELECT pair_id, region, i, j, (x).score, (x).path, clock FROM (SELECT g.pair_id, g.region, g.i, g.j, max({'s': round(p.score + g.w, 9), 'n': -len(p.path), 'path': list_append(p.path, (100 * g.a + g.b)::INT), 'score': p.score + g.w}) AS x, any_value(c.clock) + 1 AS clock
        FROM wave c JOIN worth g ON g.pair_id = c.pair_id AND g.region = c.region AND c.i = -1 AND g.i + g.j = c.clock + 1 JOIN recurring.wave p ON p.pair_id = g.pair_id AND p.region = g.region AND p.i = g.i - g.a AND p.j = g.j - g.b GROUP BY ALL)
        UNION ALL SELECT c.pair_id, c.region, -1, -1, 0, []::INT[], c.clock + 1 FROM wave c WHERE c.i = -1 AND c.clock < 64)""",
    ),
    "cut": (
        ["wave"],
        """SELECT pair_id, region, s0 + coalesce(list_sum(list_transform(path[:k - 1], lambda x: x // 100)), 0)::INT AS s0, s0 + list_sum(list_transform(path[:k], lambda x: x // 100))::INT AS s1, t0 + coalesce(list_sum(list_transform(path[:k - 1], lambda x: x % 100)), 0)::INT AS t0,
        t0 + list_sum(list_transform(path[:k], lambda x: x % 100))::INT AS t1 FROM (SELECT w.pair_id, w.region, r.s0, r.t0, path, unnest(range(1, len(path) + 1)) AS k FROM wave w JOIN region r ON r.pair_id = w.pair_id AND r.s0 = w.region AND w.i = r.s1 - r.s0 AND w.j = r.t1 - r.t0)
        UNION ALL SELECT pair_id, s0, s0, s1, t0, t1 FROM region WHERE s1 - s0 <= 3 AND t1 - t0 <= 6""",
    ),
    # What becomes of a region, with a coverage of 0.75 asked for.
    "run": (["hop"], "SELECT pair_id, s0 AS region, s AS s0, s_last + 1 AS s1, t_last AS t0, t + 1 AS t1 FROM hop JOIN reach USING (pair_id, s0, n) WHERE good"),
    "choice": (
        ["run", "merged_gap", "own"],
        """SELECT *, CASE WHEN runs THEN 'runs' WHEN NOT (n >= 2 AND m >= 2 AND k >= 2 AND NOT leaves AND least(on_s / n, on_t / m) < 0.75 AND greatest(on_s / n, on_t / m) >= 0.5) THEN NULL WHEN gaps AND least(all_s / n, all_t / m) >= 0.75 THEN 'gaps' ELSE 'partition' END AS choice FROM (SELECT r.pair_id, r.s0 AS region, support,
        s1 - s0 AS n, t1 - t0 AS m, EXISTS (FROM run x WHERE x.pair_id = r.pair_id AND x.region = r.s0) AS runs, EXISTS (FROM merged_gap x WHERE x.pair_id = r.pair_id AND x.region = r.s0) AS gaps,
        EXISTS (FROM scored x WHERE x.pair_id = r.pair_id AND (x.s >= r.s0 AND x.s < r.s1) != (x.t >= r.t0 AND x.t < r.t1)) AS leaves, (SELECT count(*) FROM own o WHERE o.pair_id = r.pair_id AND o.s0 = r.s0) AS k,
        (SELECT count(DISTINCT s) FROM own o WHERE o.pair_id = r.pair_id AND o.s0 = r.s0) AS on_s, (SELECT count(DISTINCT t) FROM own o WHERE o.pair_id = r.pair_id AND o.s0 = r.s0) AS on_t,
        (SELECT count(DISTINCT i) FROM (SELECT pair_id, s0 AS region, s AS i FROM own UNION ALL SELECT pair_id, region, unnest(range(s0, s1)) FROM merged_gap) o WHERE o.pair_id = r.pair_id AND o.region = r.s0) AS all_s,
        (SELECT count(DISTINCT i) FROM (SELECT pair_id, s0 AS region, t AS i FROM own UNION ALL SELECT pair_id, region, unnest(range(t0, t1)) FROM merged_gap) o WHERE o.pair_id = r.pair_id AND o.region = r.s0) AS all_t FROM region r)""",
    ),
    "settled": (
        ["cut", "own"],
        """SELECT c.pair_id, c.region, c.s0, c.s1, c.t0, c.t1 FROM cut c JOIN own o ON o.pair_id = c.pair_id AND o.s0 = c.region AND (o.s >= c.s0 AND o.s < c.s1 OR o.t >= c.t0 AND o.t < c.t1) GROUP BY ALL
        HAVING bool_and(o.s >= c.s0 AND o.s < c.s1 AND o.t >= c.t0 AND o.t < c.t1) AND count(DISTINCT o.s) = c.s1 - c.s0 AND count(DISTINCT o.t) = c.t1 - c.t0""",
    ),
    "chosen": (
        ["choice", "settled"],
        "SELECT pair_id, region, choice, s0, s1, t0, t1, support FROM (SELECT *, 'runs' AS choice FROM run UNION ALL BY NAME SELECT *, 'gaps' AS choice FROM merged_gap UNION ALL BY NAME SELECT *, 'partition' AS choice FROM (FROM cut ANTI JOIN settled USING (pair_id, region, s0, s1, t0, t1))) JOIN choice USING (pair_id, region, choice)",
    ),
    "chosen_set": (["chosen"], _sets("chosen")),
    "chosen_like": (["chosen_set", "dots"], _likeness("chosen_set", "pair_id", "s0", "s1", "t0", "t1")),
    "chosen_block": (["chosen", "rel"], _block("chosen")),
    # Matchings of pairs with up to 8 tokens on the shorter side: token by token of the longer side, for each set of used ones the greatest weight.
    "small": (["sizes"], "SELECT *, least(n_s, n_t) AS k, greatest(n_s, n_t) AS n FROM sizes WHERE least(n_s, n_t) BETWEEN 1 AND 8"),
    "weighed": (["small", "sim"], "SELECT pair_id, CASE WHEN n_s <= n_t THEN s ELSE t END AS i, CASE WHEN n_s <= n_t THEN t ELSE s END AS l, sim FROM sim JOIN small USING (pair_id)"),
    "fill": (
        ["weighed"],
        """SELECT pair_id, 0 AS l, 0 AS mask, 0::DOUBLE AS v FROM small UNION ALL SELECT pair_id, (l + 1)::INT, mask::INT, max(v) FROM (SELECT f.pair_id, f.l, f.mask, f.v FROM fill f JOIN small USING (pair_id) WHERE f.l < n
        UNION ALL SELECT f.pair_id, f.l, f.mask | (1 << w.i::INT), f.v + w.sim FROM fill f JOIN weighed w ON w.pair_id = f.pair_id AND w.l = f.l WHERE (f.mask >> w.i::INT) & 1 = 0) GROUP BY pair_id, l, mask""",
    ),
    # Single, sure links of content tokens, in order; then, link by link, the best chain that ends there.
    "sure": (
        ["scored", "content"],
        """SELECT pair_id, s, t, (round(confidence * 1e6))::BIGINT AS w, row_number() OVER (PARTITION BY pair_id ORDER BY s) AS n FROM (SELECT *, count(*) OVER (PARTITION BY pair_id, s) AS a, count(*) OVER (PARTITION BY pair_id, t) AS b FROM scored)
        WHERE a = 1 AND b = 1 AND confidence >= 0.45 AND (pair_id, s) IN (SELECT (pair_id, idx) FROM content WHERE side = 'source') AND (pair_id, t) IN (SELECT (pair_id, idx) FROM content WHERE side = 'target')""",
    ),
    "rise": (
        ["sure"],
        """SELECT pair_id, n, [{'w': w, 'k': 1, 'n': -n, 't': t, 'path': [{'s': s, 't': t}]}] AS ends FROM sure WHERE n = 1
        UNION ALL SELECT r.pair_id, x.n, list_append(r.ends, {'w': coalesce(r.best.w, 0) + x.w, 'k': coalesce(r.best.k, 0) + 1, 'n': -x.n, 't': x.t, 'path': list_append(coalesce(r.best.path, []), {'s': x.s, 't': x.t})})
        FROM (SELECT r.pair_id, r.n, r.ends, list_max(list_filter(r.ends, lambda e: e.t < x.t)) AS best FROM rise r JOIN sure x ON x.pair_id = r.pair_id AND x.n = r.n + 1) r JOIN sure x ON x.pair_id = r.pair_id AND x.n = r.n + 1""",
    ),
    # Boxes of connected links, and what they may grow to on one side.
    "boxed": (
        ["own_comp"],
        """SELECT c.*, (SELECT count(DISTINCT s) FROM own o WHERE o.pair_id = c.pair_id AND o.s0 = c.region) AS on_s, (SELECT count(DISTINCT t) FROM own o WHERE o.pair_id = c.pair_id AND o.s0 = c.region) AS on_t FROM (SELECT pair_id, s0 AS region, s1 AS r_s1, t0 AS r_t0, t1 AS r_t1, comp,
        min(s) AS a0, max(s) + 1 AS a1, min(t) AS b0, max(t) + 1 AS b1, avg(confidence) AS mean FROM own_comp GROUP BY ALL HAVING a1 - a0 = count(DISTINCT s) AND b1 - b0 = count(DISTINCT t)) c""",
    ),
    "grown": (
        ["boxed"],
        """SELECT * FROM (SELECT *, a0 AS s0, a1 AS s1, (on_t + (t1 - t0) - (b1 - b0)) / (r_t1 - r_t0) AS cover FROM (SELECT *, unnest(range(b1, r_t1 + 1)) AS t1 FROM (SELECT *, unnest(range(r_t0, b0 + 1)) AS t0 FROM boxed WHERE a1 - a0 <= 3)) WHERE t1 - t0 <= 6 AND t1 - t0 > b1 - b0
        UNION ALL BY NAME SELECT *, b0 AS t0, b1 AS t1, (on_s + (s1 - s0) - (a1 - a0)) / (r_s1 - region) AS cover FROM (SELECT *, unnest(range(a1, r_s1 + 1)) AS s1 FROM (SELECT *, unnest(range(region, a0 + 1)) AS s0 FROM boxed WHERE b1 - b0 <= 6)) WHERE s1 - s0 <= 3 AND s1 - s0 > a1 - a0) g
        WHERE cover >= 0.3 AND NOT EXISTS (FROM scored x WHERE x.pair_id = g.pair_id AND (x.s >= s0 AND x.s < s1 AND (x.s < a0 OR x.s >= a1) OR x.t >= t0 AND x.t < t1 AND (x.t < b0 OR x.t >= b1)))""",
    ),
    "grown_span": (["grown"], "SELECT pair_id, s0, s1, t0, t1 FROM grown UNION SELECT pair_id, a0, a1, b0, b1 FROM grown"),
    "grown_set": (["grown_span"], _sets("grown_span")),
    "grown_like": (["grown_set", "dots"], _likeness("grown_set", "pair_id", "s0", "s1", "t0", "t1")),
    "grown_block": (["grown_span", "rel"], _block("grown_span")),
    "expansion": (
        ["grown", "grown_like", "grown_block"],
        """SELECT *, round(greatest(0, least(1, 0.45 * score + 0.30 * mean + 0.15 * cover + 0.10 * least(1, gain / 1e-12))), 6) AS confidence FROM (SELECT g.*, x.similarity, x.similarity - y.similarity AS gain, sqrt(f * r) AS score FROM grown g JOIN grown_like x USING (pair_id, s0, s1, t0, t1)
        JOIN grown_like y ON y.pair_id = g.pair_id AND y.s0 = a0 AND y.s1 = a1 AND y.t0 = b0 AND y.t1 = b1 JOIN grown_block k ON k.pair_id = g.pair_id AND k.s0 = g.s0 AND k.s1 = g.s1 AND k.t0 = g.t0 AND k.t1 = g.t1) WHERE gain >= 0""",
    ),
}
#: Tables that are made row by row of themselves, and their keys.
RECURSIVE = {"walk": "", "told_walk": "", "fill": "", "hop": "", "gap_hop": "", "own_walk": "", "rise": "", "wave": "(pair_id, region, i, j, score, path, clock) USING KEY (pair_id, region, i, j) "}


#: What is made of sentences, made of other pairs in the same way: whole turns, and literal pairs.
_SAME = {"turns": ("vec", "sim", "ranked", "rel", "cells", "inter", "iter", "margins"), "lit": ("sizes", "vec", "sim", "ranked", "rel", "cells", "inter", "iter", "ml", "margins", "orders_", "scored", "mark", "anchor", "gaps", "region")}
for _pairs, _names in _SAME.items():
    for _name in _names:
        _needs, _body = CTES[_name]
        CTES[f"{_pairs}_{_name}"] = ([n.replace("talk_", f"{_pairs}_") if n.startswith("talk_") else f"{_pairs}_{n}" for n in _needs], re.sub(r"\b(FROM|JOIN) (talk_)?(tok|tokens|" + "|".join(_names) + r")\b", rf"\1 {_pairs}_\3", _body))
#: In literal pairs all links are looked at, and tokens that a rule has linked count as content.
CTES["lit_mark"] = (["m3", "lit_tokens"], CTES["lit_mark"][1].replace("lit_iter", "m3"))
CTES["lit_other"] = (
    ["told", "lit_tokens"],
    r"""SELECT pair_id, side, idx FROM lit_tokens x WHERE (is_protected OR NOT regexp_matches(text, '[\p{L}\p{N}]'))
    AND NOT EXISTS (FROM told r WHERE r.origin = 'rule' AND r.pair_id = x.pair_id AND (x.side = 'source' AND r.s = x.idx OR x.side = 'target' AND r.t = x.idx))""",
)
CTES["lit_region"] = (
    ["lit_gaps", "lit_other"],
    "SELECT g.* FROM lit_gaps g WHERE NOT EXISTS (FROM lit_other x WHERE x.pair_id = g.pair_id AND (x.side = 'source' AND x.idx >= s0 AND x.idx < s1 OR x.side = 'target' AND x.idx >= t0 AND x.idx < t1))",
)


def sql(final: str, *needs: str) -> str:
    """WITH all that is needed, in order, then the final SELECT."""
    seen: list[str] = []

    def add(name: str) -> None:
        for d in CTES[name][0]:
            add(d)
        if name not in seen:
            seen.append(name)

    for n in needs:
        add(n)
    return ("WITH RECURSIVE " + ",\n".join(f"{n} {RECURSIVE[n]}AS ({CTES[n][1]})" if n in RECURSIVE else f"{n} AS MATERIALIZED ({CTES[n][1]})" for n in seen) + "\n" if seen else "") + final


#: Offsets: a token begins at the visible character that follows those of the tokens before it.
_STARTS = r"""SELECT *, (pos[n + 1] - 1)::INT AS start FROM (SELECT t.*, coalesce(sum(len(regexp_replace(text, '\s', '', 'g'))) OVER (PARTITION BY pair_id, side ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS n FROM {p}_tokens t)
JOIN (SELECT pair_id, side, list_filter(range(1, len(x) + 1), lambda i: NOT regexp_matches(x[i], '\s')) AS pos FROM (SELECT pair_id, 'source' AS side, source AS x FROM {p} UNION ALL SELECT pair_id, 'target', target FROM {p})) USING (pair_id, side)"""

#: The groups of links, in order, flat.
_GROUPED = """SELECT pair_id, (row_number() OVER (PARTITION BY pair_id ORDER BY first) - 1)::INT AS k, CASE WHEN n_s = 1 AND n_t = 1 THEN 'one-to-one' WHEN n_s = 1 THEN 'one-to-many' WHEN n_t = 1 THEN 'many-to-one' ELSE 'many-to-many' END AS type, origin,
    similarity, confidence, sources, targets, n_links FROM (SELECT pair_id, min(s) AS first, count(DISTINCT s) AS n_s, count(DISTINCT t) AS n_t, CASE WHEN count(DISTINCT origin) = 1 THEN min(origin) ELSE 'mixed' END AS origin, floor(sum(round(similarity * 1e6)) / count(*) + 0.5) / 1e6 AS similarity,
    floor(sum(round(confidence * 1e6)) / count(*) + 0.5) / 1e6 AS confidence, array_to_string(list_sort(list(DISTINCT s)), ',') AS sources, array_to_string(list_sort(list(DISTINCT t)), ',') AS targets, count(*)::INT AS n_links FROM {links} GROUP BY pair_id, comp)"""

ORACLES = {
    "pairs": sql("SELECT * FROM talk", "talk"),
    "tokenize": sql("SELECT pair_id, side, idx, text FROM talk_tok", "talk_tok"),
    "tokenize_literals": sql("SELECT pair_id, side, idx, text, is_protected FROM lit_tokens", "lit_tokens"),
    "token_classes": sql(r"SELECT pair_id, side, idx, is_protected, NOT is_protected AND regexp_matches(text, '[\p{L}\p{N}]') AS is_content, regexp_matches(text, '^\p{P}+$') AS is_punctuation FROM lit_tokens", "lit_tokens"),
    "token_offsets": sql("SELECT pair_id, side, idx, start, start + len(text)::INT AS \"end\" FROM (" + _STARTS.format(p="talk") + ")", "talk_tokens"),
    "tokenize_pages": sql("SELECT pair_id, side, idx, text, start, is_protected FROM (" + _STARTS.format(p="page") + ")", "page_tokens"),
    "validate_pairs": sql(r"SELECT pair_id, concat_ws(',', CASE WHEN NOT regexp_matches(source, '[^\s]') OR len(source) > 10000 THEN 'source' END, CASE WHEN NOT regexp_matches(target, '[^\s]') OR len(target) > 10000 THEN 'target' END) AS errors FROM talk", "talk"),
    "repair_links": sql(
        """SELECT pair_id, x.s AS s, x.t AS t, x.v AS similarity, x.c AS confidence FROM (SELECT pair_id, unnest(list_reduce(list([{'s': s, 't': t, 'c': confidence, 'v': similarity}] ORDER BY confidence DESC, similarity DESC, distance, s, t),
        lambda a, x: CASE WHEN len(list_filter(a, lambda y: y.s = x[1].s OR y.t = x[1].t)) = 0 THEN list_concat(a, x) ELSE a END)) AS x FROM added WHERE confidence >= 0.1 GROUP BY pair_id)""",
        "added",
    ),
    "align": sql(_GROUPED.format(links="(SELECT *, 'model' AS origin FROM comp JOIN scored USING (pair_id, s, t))"), "comp", "scored"),
    "align_literals": sql(_GROUPED.format(links="told_comp"), "told_comp"),
    "align_requests": sql(_GROUPED.format(links="served_comp"), "served_comp"),
    "refused_requests": sql("SELECT request_id, string_agg(e, ',' ORDER BY e) AS errors FROM refused GROUP BY request_id", "refused"),
    "literal_anchors": sql("SELECT * FROM lit_anchor", "lit_anchor"),
    "literal_regions": sql("SELECT * FROM lit_region", "lit_region"),
    "token_vectors": sql("SELECT pair_id, side, idx, len(v)::INT AS dims, array_to_string(list_transform(v, lambda x: floor(x * 1e6)::BIGINT), ',') AS millionths FROM vec", "vec"),
    "cells_similarity": sql("SELECT pair_id, s, t, round(sim, 6) AS sim FROM sim", "sim"),
    "relative_similarity": sql("SELECT pair_id, s, t, round(rel, 6) AS rel FROM rel", "rel"),
    "softmax_bidirectional": sql("SELECT pair_id, s, t, round(p_st, 6) AS p_st, round(p_ts, 6) AS p_ts FROM cells", "cells"),
    "tiled_links": sql(
        "SELECT pair_id, 'fwd' AS method, s, t FROM turns_ranked WHERE rank_st = 1 UNION ALL SELECT pair_id, 'rev', s, t FROM turns_ranked WHERE rank_ts = 1 UNION ALL SELECT pair_id, 'inter', s, t FROM turns_inter UNION ALL SELECT pair_id, 'itermax', s, t FROM turns_iter",
        "turns_ranked", "turns_inter", "turns_iter",
    ),
    "tiled_softmax": sql(
        "SELECT pair_id, s, t, round(rel, 6) AS rel, round(p_st, 6) AS p_st, round(p_ts, 6) AS p_ts, round(margin, 6) AS margin FROM turns_margins m WHERE rank_st = 1 OR rank_ts = 1 OR EXISTS (FROM turns_iter i WHERE i.pair_id = m.pair_id AND i.s = m.s AND i.t = m.t)",
        "turns_margins", "turns_iter",
    ),
    "argmax_forward": sql("SELECT pair_id, s, t FROM ranked WHERE rank_st = 1", "ranked"),
    "argmax_reverse": sql("SELECT pair_id, s, t FROM ranked WHERE rank_ts = 1", "ranked"),
    "inter_links": sql("SELECT pair_id, s, t, round(sim, 6) AS sim FROM inter", "inter"),
    "itermax_links": sql("SELECT pair_id, s, t FROM iter", "iter"),
    "candidate_margin": sql("SELECT pair_id, s, t, round(margin, 6) AS margin FROM margins", "margins"),
    "order_consistency": sql("SELECT pair_id, s, t, round(order_score, 6) AS order_score, n_in FROM orders_", "orders_"),
    "link_scores": sql("SELECT * FROM scored", "scored"),
    "protected_links": sql("SELECT * FROM plinks", "plinks"),
    "temporal_links": sql("SELECT * FROM tlinks", "tlinks"),
    "percent_links": sql("SELECT * FROM qlinks", "qlinks"),
    "rule_override": sql(
        "SELECT o.pair_id, o.s, o.t, r.s IS NOT NULL AS rule FROM o3 o LEFT JOIN ruled r ON r.pair_id = o.pair_id AND r.s = o.s AND r.t = o.t",
        "o3", "ruled",
    ),
    "hard_anchors": sql("SELECT * FROM anchor", "anchor"),
    "drop_crossing": sql("SELECT pair_id, s, t FROM scored x WHERE confidence >= 0.55 OR NOT EXISTS (FROM anchor a WHERE a.pair_id = x.pair_id AND (x.s - a.s) * (x.t - a.t) < 0)", "scored", "anchor"),
    "clause_regions": sql("SELECT * FROM region", "region"),
    "region_coverage": sql(
        "SELECT r.pair_id, s0, s1, t0, t1, count(i.s) AS n_links, round(count(DISTINCT i.s) / any_value(s1 - s0), 6) AS s_cover, round(count(DISTINCT i.t) / any_value(t1 - t0), 6) AS t_cover FROM region r LEFT JOIN inter i ON i.pair_id = r.pair_id AND i.s >= s0 AND i.s < s1 AND i.t >= t0 AND i.t < t1 GROUP BY ALL",
        "region", "inter",
    ),
    "matrix_span_score": sql("SELECT pair_id, round(sqrt(f * r), 6) AS score FROM (SELECT pair_id, avg(m) AS f FROM (SELECT pair_id, s, max(sim) AS m FROM sim GROUP BY ALL) GROUP BY ALL) JOIN (SELECT pair_id, avg(m) AS r FROM (SELECT pair_id, t, max(sim) AS m FROM sim GROUP BY ALL) GROUP BY ALL) USING (pair_id)", "sim"),
    "span_similarity": sql(
        "SELECT pair_id, round((sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b))) + 1) / 2, 6) AS similarity FROM (SELECT pair_id, d, avg(x) FILTER (side = 'source') AS a, avg(x) FILTER (side = 'target') AS b FROM (SELECT pair_id, side, unnest(range(len(v))) AS d, unnest(v) AS x FROM vec) GROUP BY ALL) GROUP BY pair_id HAVING sum(a * b) IS NOT NULL",
        "vec",
    ),
    "mwmf_certificate": sql(
        "SELECT s.pair_id, least(s.n_s, s.n_t) AS n_links, round(v, 6) AS weight, true AS proven, 0 AS violated FROM sizes s LEFT JOIN small m USING (pair_id) LEFT JOIN fill f ON f.pair_id = m.pair_id AND f.l = m.n AND f.mask = (1 << m.k::INT) - 1 WHERE s.n_s > 0 AND s.n_t > 0",
        "fill",
    ),
    "reverse_runs": sql("SELECT pair_id, s0, s AS run_s0, s_last + 1 AS run_s1, t_last AS run_t0, t + 1 AS run_t1 FROM hop JOIN reach USING (pair_id, s0, n) WHERE good", "hop"),
    "bounded_gaps": sql("SELECT pair_id, region, s0, s1, t0, t1, similarity FROM gap", "gap"),
    "merged_gaps": sql("SELECT * FROM merged_gap", "merged_gap"),
    "partition_regions": sql("SELECT * FROM cut", "cut"),
    "region_choices": sql(
        """SELECT pair_id, region, choice, s0, s1, t0, t1, similarity, round(greatest(0, least(1, 0.40 * sqrt(f * r) + 0.25 * coalesce(mean, 0) + 0.20 * similarity + 0.15 * support)), 6) AS confidence FROM chosen JOIN chosen_like USING (pair_id, s0, s1, t0, t1)
        JOIN chosen_block USING (pair_id, s0, s1, t0, t1) LEFT JOIN (SELECT c.pair_id, c.s0, c.s1, c.t0, c.t1, avg(confidence) AS mean FROM chosen c JOIN own o ON o.pair_id = c.pair_id AND o.s0 = c.region AND (o.s >= c.s0 AND o.s < c.s1 OR o.t >= c.t0 AND o.t < c.t1) GROUP BY ALL) USING (pair_id, s0, s1, t0, t1)""",
        "chosen_like", "chosen_block",
    ),
    "soft_anchors": sql("SELECT pair_id, x.s AS s, x.t AS t FROM (SELECT pair_id, unnest(list_max(ends).path) AS x FROM (SELECT pair_id, arg_max(ends, n) AS ends FROM rise GROUP BY pair_id))", "rise"),
    "span_expansions": sql(
        """SELECT pair_id, x.s0 AS s0, x.s1 AS s1, x.t0 AS t0, x.t1 AS t1, x.v AS similarity, round(x.g, 6) AS gain, x.c AS confidence FROM (SELECT pair_id, unnest(list_reduce(list([{'s0': s0, 's1': s1, 't0': t0, 't1': t1, 'v': similarity, 'g': gain, 'c': confidence}]
        ORDER BY gain DESC, confidence DESC, s1 - s0 + t1 - t0, s0, t0, s1 DESC), lambda a, x: CASE WHEN len(list_filter(a, lambda y: y.s0 < x[1].s1 AND x[1].s0 < y.s1 OR y.t0 < x[1].t1 AND x[1].t0 < y.t1)) = 0 THEN list_concat(a, x) ELSE a END)) AS x FROM expansion GROUP BY pair_id)""",
        "expansion",
    ),
    "link_components": sql("SELECT pair_id, min(s) AS s, min(t) AS t, count(*) AS n FROM comp GROUP BY pair_id, comp", "comp"),
    "alignment_groups": sql(
        """SELECT pair_id, CASE WHEN n_s = 1 AND n_t = 1 THEN 'one-to-one' WHEN n_s = 1 THEN 'one-to-many' WHEN n_t = 1 THEN 'many-to-one' ELSE 'many-to-many' END AS type, 'model' AS origin, n_s, n_t, s, similarity, n_links
        FROM (SELECT pair_id, count(DISTINCT s) AS n_s, count(DISTINCT t) AS n_t, min(s) AS s, floor(sum(round(similarity * 1e6)) / count(*) + 0.5) / 1e6 AS similarity, count(*) AS n_links FROM comp JOIN scored USING (pair_id, s, t) GROUP BY pair_id, comp)""",
        "comp", "scored",
    ),
    "unaligned_tokens": sql("SELECT pair_id, side, idx, text FROM talk_tok t WHERE NOT EXISTS (FROM inter i WHERE i.pair_id = t.pair_id AND (t.side = 'source' AND i.s = t.idx OR t.side = 'target' AND i.t = t.idx))", "talk_tok", "inter"),
}
