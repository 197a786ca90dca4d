"""Metrics by hand-computed cases."""

import math

import pytest
from pyspark.sql import functions as F

from quillon.operators import evaluation as ev


def gold(spark, rows):
    return spark.createDataFrame(rows, "query_id string, lang string, relevant array<string>")


def pages(spark, **ranked):
    return spark.createDataFrame([(q, p, i + 1) for q, ps in ranked.items() for i, p in enumerate(ps)], "query_id string, page_id string, pos int")


def test_page_ranking_counts_anew(spark):
    hits = spark.createDataFrame([("q", 1, "a"), ("q", 2, "a"), ("q", 3, "b"), ("q", 4, "a"), ("q", 5, "c")], "query_id string, rank int, page_id string")
    got = ev.page_ranking(hits).orderBy("pos").collect()
    assert [(r.page_id, r.pos) for r in got] == [("a", 1), ("b", 2), ("c", 3)]


def test_items_and_report(spark):
    g = gold(spark, [("hit2", "en", ["b", "z"]), ("miss", "ja", ["x"]), ("none", "ja", [])])
    items = {r.query_id: r for r in ev.item_metrics(g, pages(spark, hit2=["a", "b", "c"], miss=["a"], none=["a"])).collect()}
    h = items["hit2"]
    assert (h.recall_at_1, h.recall_at_3, h.rr) == (0.0, 1.0, 0.5)
    assert h.ndcg == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3)))
    assert items["miss"].rr == 0 and items["none"].rr is None and not items["none"].answerable
    report = {r.lang: r for r in ev.report(ev.item_metrics(g, pages(spark, hit2=["a", "b"], miss=["a"]))).collect()}
    assert report[None].n_items == 3 and report[None].n_answerable == 2 and report[None].mrr == 0.25 and report["ja"].mrr == 0


def test_nothing_answerable_is_null(spark):
    r = ev.report(ev.item_metrics(gold(spark, [("q", "en", [])]), pages(spark, q=["a"]))).where("lang is null").first()
    assert r.n_items == 1 and r.mrr is None and r.recall_at_1 is None


def test_confusion(spark):
    pairs = spark.createDataFrame([("supported", "supported"), ("supported", "unsupported"), ("contradicted", "unsupported")], "true_label string, predicted_label string")
    m = ev.confusion(pairs)
    assert m.count() == 9 and m.agg(F.sum("n")).first()[0] == 3
    got = {r.label: r for r in ev.label_metrics(m).collect()}
    assert got["supported"].precision == 1 and got["supported"].recall == 0.5 and got["supported"].accuracy == pytest.approx(1 / 3)
    assert got["contradicted"].precision is None and got["contradicted"].recall == 0 and got["unsupported"].recall is None


def test_refusals_gate_parity(spark):
    a = spark.createDataFrame([(True, True), (True, False), (False, False)], "answerable boolean, refused boolean")
    assert ev.refusal_rates(a).first()[:2] == (0.5, 1.0)
    assert ev.refusal_rates(a.where("answerable")).first().miss_rate is None
    g = ev.gate(spark.createDataFrame([("bm25_recall_at_5", 0.8), ("lexical_faithfulness_accuracy", None)], "metric string, value double"))
    assert {r.metric: r.ok for r in g.collect()} == {"bm25_recall_at_5": True, "lexical_faithfulness_accuracy": False}
    assert ev.parity(pages(spark, q=["a"], r=["b"], s=["c"]), pages(spark, q=["a"], r=["x"])).first()[:] == (3, 2)


def test_gold_problems(spark):
    schema = "id string, relevant_parallel_ids array<string>, answerable boolean"
    g = spark.createDataFrame([("a", ["p"], True), ("a", ["p"], True), ("b", [], True), ("c", ["q"], False), ("d", ["gone"], True)], schema)
    got = {(r.id, r.problem) for r in ev.gold_problems(g, spark.createDataFrame([("p",), ("q",)], "parallel_id string")).collect()}
    assert got == {("a", "duplicate id"), ("b", "answerable without relevant pages"), ("c", "unanswerable with relevant pages"), ("d", "no page gone")}
    with pytest.raises(ValueError):
        ev.require_valid(g)
    ev.require_valid(g.where("id = 'd'"))
