"""Tables of tokens are never broadcast, however small they look."""

from duolex.functions.staging import staged
from duolex.operators import regions
from duolex.operators.tokens import token_rows, tokenize
from duolex.plans.align import sizes_of


def test_tokens_are_not_broadcast(spark):
    t = staged(tokenize(spark.createDataFrame([("a", "x [[k]] y .", "[[k]] z w .")], "pair_id string, source string, target string")), "tokens")
    links = spark.createDataFrame([("a", 1, 0, True), ("a", 2, 1, True), ("a", 3, 3, False)], "pair_id string, s int, t int, rule boolean")
    anchors = regions.hard_anchors(links, token_rows(t))
    found = regions.clause_regions(anchors, token_rows(t), sizes_of(t), links.where("rule"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert sorted((r.s, r.t) for r in anchors.collect()) == [(1, 0), (3, 3)]
    assert [(r.s0, r.s1, r.t0, r.t1) for r in found.collect()] == [(2, 3, 1, 3)]
