"""Evaluation algebra: ranking metrics, confusion, refusals, gates and gold checks as aggregations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# fixed values: cut-offs, labels and regression floors
K_VALUES, NDCG_K = (1, 3, 5, 10), 10
LABELS = ("supported", "unsupported", "contradicted")
FLOORS = {"bm25_recall_at_5": 0.80, "lexical_faithfulness_accuracy": 0.55}


def page_ranking(hits: DataFrame) -> DataFrame:
    """(query_id, page_id, pos): pages by their best hit, counted anew from 1."""
    best = hits.groupBy("query_id", "page_id").agg(F.min("rank").alias("rank"))
    return best.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "page_id"))).select("query_id", "page_id", "pos")


def item_metrics(gold: DataFrame, pages: DataFrame) -> DataFrame:
    """A row for each gold item: recall at the cut-offs (hit or not), reciprocal rank, nDCG; null if unanswerable.

    ``gold``: (query_id, lang, relevant array<string>); answerable means that relevant pages are named.
    """
    relevant = gold.select("query_id", F.explode("relevant").alias("page_id")).distinct()
    at = pages.join(relevant, ["query_id", "page_id"]).groupBy("query_id").agg(
        F.min("pos").alias("first"), F.sum(F.when(F.col("pos") <= NDCG_K, 1.0 / F.log2(F.col("pos") + 1.0)).otherwise(0.0)).alias("dcg")
    )
    n = F.size(F.array_distinct("relevant"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(n, F.lit(NDCG_K)))), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    can = n > 0
    got = gold.join(at, "query_id", "left")
    hit = lambda k: F.when(can, F.coalesce((F.col("first") <= k).cast("double"), F.lit(0.0))).alias(f"recall_at_{k}")
    return got.select(
        "query_id", "lang", can.alias("answerable"), *[hit(k) for k in K_VALUES],
        F.when(can, F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("rr"), F.when(can, F.coalesce(F.col("dcg"), F.lit(0.0)) / ideal).alias("ndcg"),
    )


def report(items: DataFrame) -> DataFrame:
    """Means over answerable items, overall (lang null) and by language, in one pass; nulls where there are none."""
    means = [F.avg(c).alias(c) for c in (*(f"recall_at_{k}" for k in K_VALUES),)]
    return items.rollup("lang").agg(
        F.count("*").alias("n_items"), F.count_if("answerable").alias("n_answerable"), *means, F.avg("rr").alias("mrr"), F.avg("ndcg").alias("ndcg")
    )


def ablation(arms: dict[str, DataFrame]) -> DataFrame:
    """The reports of several arms under each other."""
    return reduce(DataFrame.unionByName, [r.select(F.lit(name).alias("arm"), "*") for name, r in arms.items()])


def deltas(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: by how much recall and reciprocal rank over all queries differ between two reports."""
    of = lambda r, x: r.where("lang is null").select(F.col("recall_at_5").alias(f"r{x}"), F.col("mrr").alias(f"m{x}"))
    both = of(a, 1).crossJoin(F.broadcast(of(b, 2)))
    return both.select(F.round(F.col("r2") - F.col("r1"), 9).alias("recall_at_5_delta"), F.round(F.col("m2") - F.col("m1"), 9).alias("mrr_delta"))


def parity(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: queries of either hit list, and those whose first page differs (a missing one counts)."""
    one = lambda h, c: h.where("pos = 1").select("query_id", F.col("page_id").alias(c))
    both = one(a, "x").join(one(b, "y"), "query_id", "full_outer")
    return both.agg(F.count("*").alias("queries"), F.count_if(~F.col("x").eqNullSafe(F.col("y"))).alias("top1_differs"))


def confusion(pairs: DataFrame, labels=LABELS) -> DataFrame:
    """(true_label, predicted_label, n) over all pairs of labels, zeros included."""
    spark = pairs.sparkSession
    grid = spark.createDataFrame([(t, p) for t in labels for p in labels], "true_label string, predicted_label string")
    n = pairs.groupBy("true_label", "predicted_label").agg(F.count("*").alias("n"))
    return grid.join(n, ["true_label", "predicted_label"], "left").na.fill(0, ["n"])


def label_metrics(matrix: DataFrame) -> DataFrame:
    """Precision and recall of each label, null without a denominator; support and the whole's accuracy."""
    hit = F.when(F.col("true_label") == F.col("predicted_label"), F.col("n")).otherwise(0)
    by_true = matrix.groupBy(F.col("true_label").alias("label")).agg(F.sum("n").alias("support"), F.sum(hit).alias("tp"))
    by_pred = matrix.groupBy(F.col("predicted_label").alias("label")).agg(F.sum("n").alias("predicted"))
    total = matrix.agg(F.coalesce(F.try_divide(F.sum(hit), F.sum("n")), F.lit(0.0)).alias("accuracy"))
    return by_true.join(by_pred, "label").crossJoin(F.broadcast(total)).select(
        "label", F.try_divide("tp", "predicted").alias("precision"), F.try_divide("tp", "support").alias("recall"), "support", "accuracy"
    )


def refusal_rates(answers: DataFrame) -> DataFrame:
    """One row: refused share of the answerable (false refusals), answered share of the unanswerable (misses)."""
    refused = F.col("refused").cast("double")
    return answers.agg(
        F.avg(F.when(F.col("answerable"), refused)).alias("false_refusal_rate"), F.avg(F.when(~F.col("answerable"), 1 - refused)).alias("miss_rate"),
        F.count_if("answerable").alias("n_answerable"), F.count_if(~F.col("answerable")).alias("n_unanswerable"),
    )


def gate(metrics: DataFrame, floors: dict[str, float] | None = None) -> DataFrame:
    """(metric, value, floor, ok): a metric that is missing or null fails."""
    want = metrics.sparkSession.createDataFrame(sorted((floors or FLOORS).items()), "metric string, floor double")
    return want.join(metrics.select("metric", "value"), "metric", "left").select("metric", "value", "floor", F.coalesce(F.col("value") >= F.col("floor"), F.lit(False)).alias("ok"))


def gold_problems(gold: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """(id, problem): repeated ids, answerable items without pages and the reverse, pages that the corpus lacks."""
    twice = gold.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("duplicate id").alias("problem"))
    none = F.size("relevant_parallel_ids") == 0
    odd = gold.where(F.col("answerable") == none).select(
        "id", F.when(none, "answerable without relevant pages").otherwise("unanswerable with relevant pages").alias("problem")
    )
    out = twice.union(odd)
    if pages is not None:
        named = gold.select("id", F.explode("relevant_parallel_ids").alias("parallel_id"))
        stale = named.join(pages.select("parallel_id").distinct(), "parallel_id", "left_anti")
        out = out.union(stale.select("id", F.concat(F.lit("no page "), "parallel_id").alias("problem")))
    return out


def require_valid(gold: DataFrame) -> DataFrame:
    bad = gold_problems(gold).first()
    if bad:
        raise ValueError(f"{bad.id}: {bad.problem}")
    return gold
