"""Queries that score every candidate, not a part of them."""

import difflib

from stratalex.functions import matching as M
from stratalex.plans import catalog
from stratalex.plans.base import citations, hits

SF = "/root/testdata/sf0.001"


def test_block_coverage_of_every_hit(spark):
    got = {(r["item_id"], r["paragraph_id"]) for r in catalog.queries()["h13_block_coverage"](spark, SF).collect()}
    want = {(r["item_id"], r["paragraph_id"]) for r in hits(spark, SF).join(citations(spark, SF).select("item_id").distinct(), "item_id").collect()}
    assert got == want and hits(spark, SF).filter("rank > 3").count() > 0


def test_fuzzy_windows_of_every_hit(spark):
    rows = catalog.queries()["h12_fuzzy_windows"](spark, SF).collect()
    want = {(r["item_id"], r["paragraph_id"]) for r in hits(spark, SF).join(citations(spark, SF).select("item_id").distinct(), "item_id").collect()}
    assert {(r["item_id"], r["paragraph_id"]) for r in rows} == want and len(rows) == len(want)
    assert all(r["matched"] == (r["score"] >= M.FUZZY_LEAST) for r in rows) and any(r["score"] > 0 for r in rows)


def test_quote_ratio_of_a_damaged_quote():
    def plain(q, t):
        n = len(q)
        ratios = [difflib.SequenceMatcher(None, q, t[i : i + max(n + 20, int(n * 1.5))]).ratio() for i in range(0, max(1, len(t) - n + 1), max(1, n // 3))]
        return next((x for x in ratios if x >= 0.65), max(ratios))

    quote = "一个幽灵共产主义的幽灵在欧洲游荡为了对这个幽灵进行神圣的围剿" * 5
    for text in (quote, "前" * 90 + quote[:60] + "口口口" + quote[64:] + "后" * 70, "别的" * 300, quote[:20]):
        assert M.quote_ratio(quote, text) == plain(quote, text)
    assert M.quote_ratio("四字不足"[:4], "四字不足") == 0.0


def test_server_hybrid_lists_are_not_joined(spark):
    plan = catalog.queries()["t10_server_hybrid"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "FullOuter" not in plan and plan.count("Union") == 1
