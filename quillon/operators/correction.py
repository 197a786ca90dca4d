"""The correction policy: keep, strike or recover claims, then answer or refuse."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import script_of
from . import verification

# fixed values: thresholds and the texts of a refusal
REFUSAL_THRESHOLD, RETRY_TOP_K = 0.5, 3
REFUSAL_EN = "I don't have enough verified information in the retrieved sources to answer this confidently."
REFUSAL_JA = "取得した情報からは、この質問に確信を持って回答するための十分な検証済み情報が得られませんでした。"

_KEY = ["answer_id", "claim_index"]
#: (query_id, query) -> (query_id, rank, text)
Search = Callable[[DataFrame], DataFrame]
Verify = Callable[[DataFrame, DataFrame], DataFrame]


def retry(verdicts: DataFrame, search: Search, verify: Verify = verification.lexical) -> DataFrame:
    """Verdicts of the unsupported claims after one search for the claim itself, in any language; all in one batch."""
    open_claims = verdicts.where("label = 'unsupported'").select(*_KEY, "claim")
    # a claim that many answers make is looked up once, under the least of its names
    name = F.concat_ws("#", F.col("answer_id").cast("string"), F.col("claim_index").cast("string"))
    asked = open_claims.groupBy("claim").agg(F.min(name).alias("q"))
    # a claim is its own answer here, so that it meets its own hits only
    alone = asked.select(F.col("q").alias("answer_id"), F.lit(0).alias("claim_index"), "claim")
    evidence = search(asked.select(F.col("q").alias("query_id"), F.col("claim").alias("query"))).select(F.col("query_id").alias("answer_id"), (F.col("rank") - 1).alias("evidence_index"), F.col("text").alias("evidence"))
    again = verify(alone, evidence).drop("answer_id", "claim_index")
    return open_claims.join(again, "claim").drop("claim")


def decide(verdicts: DataFrame, retried: DataFrame) -> DataFrame:
    """Each verdict with its action; a recovered claim shows the retry's result, all others the first one."""
    good = retried.where("label = 'supported'").select(*_KEY, F.struct("label", "score", "best_evidence_index", "method").alias("new"))
    got = verdicts.join(good, _KEY, "left")
    action = F.when(F.col("label") == "supported", "kept").when((F.col("label") == "unsupported") & F.col("new").isNotNull(), "recovered").otherwise("struck")
    shown = lambda c: F.when(F.col("action") == "recovered", F.col(f"new.{c}")).otherwise(F.col(c)).alias(f"final_{c}")
    return got.withColumn("action", action).select("*", *[shown(c) for c in ("label", "score", "best_evidence_index", "method")]).drop("new")


def corrected(answers: DataFrame, decisions: DataFrame, threshold: float = REFUSAL_THRESHOLD) -> DataFrame:
    """(answer_id, final_text, refused, refusal_reason, n_claims, n_kept) of answers (answer_id, question, text).

    An answer without claims stays as it is.  It is refused if nothing is kept or the kept
    share is below ``threshold``; else the kept claims make the text, in their order.
    """
    kept = F.col("action") != "struck"
    by = decisions.groupBy("answer_id").agg(
        F.count("*").alias("n"), F.count_if(kept).alias("k"), F.array_sort(F.collect_list(F.when(kept, F.struct("claim_index", "claim")))).alias("kept")
    )
    got = answers.join(by, "answer_id", "left").na.fill(0, ["n", "k"])
    refused = (F.col("n") > 0) & ((F.col("k") == 0) | (F.try_divide("k", "n") < threshold))
    refusal = F.when(script_of(F.col("question")) == "cjk", REFUSAL_JA).otherwise(REFUSAL_EN)
    reason = F.format_string("only %d/%d claims verified against the retrieved sources (or a claim-targeted retry)", "k", "n")
    text = F.when(F.col("n") == 0, F.col("text")).when(F.col("refused"), refusal).otherwise(F.array_join(F.transform("kept", lambda x: x["claim"]), " "))
    return got.withColumn("refused", F.when(F.col("n") == 0, False).otherwise(refused)).select(
        "answer_id", text.alias("final_text"), "refused", F.when(F.col("refused"), reason).alias("refusal_reason"), F.col("n").alias("n_claims"), F.col("k").alias("n_kept")
    )
