"""Claims and their verification against retrieved evidence."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import claim_lines, judge_label, query_lang, segments, sentences
from .dense import cosine

# fixed values: thresholds of the arms
LEXICAL_LEAST, EMBEDDING_LEAST, ENTAILED_LEAST, CONTRADICTED_LEAST = 0.6, 0.85, 0.5, 0.5

_KEY = ("answer_id", "claim_index")


def sentence_claims(answers: DataFrame) -> DataFrame:
    """(answer_id, claim_index, claim): one claim for each sentence of ``text``."""
    return answers.select("answer_id", F.posexplode(sentences(F.col("text"))).alias("claim_index", "claim"))


def line_claims(answers: DataFrame, reply_col: str = "reply") -> DataFrame:
    """One claim for each line of a model's list."""
    return answers.select("answer_id", F.posexplode(claim_lines(F.col(reply_col))).alias("claim_index", "claim"))


def _terms(text: str) -> Column:
    return F.array_distinct(segments(F.col(text), query_lang(F.col(text))))


def _best(scored: DataFrame, claims: DataFrame, least: float, method: str, positive: bool) -> DataFrame:
    """The best evidence of each claim, the first among equals; ``positive``: only a score above 0 counts."""
    use = scored.where("score > 0") if positive else scored
    best = use.groupBy(*_KEY).agg(F.max(F.struct("score", (-F.col("evidence_index")).alias("neg"))).alias("b"))
    score = F.coalesce(F.col("b.score"), F.lit(0.0))
    return claims.join(best, list(_KEY), "left").select(
        *_KEY, "claim", F.when(F.col("b").isNotNull() & (score >= least), "supported").otherwise("unsupported").alias("label"), score.alias("score"),
        (-F.col("b.neg")).cast("int").alias("best_evidence_index"), F.lit(method).alias("method"),
    )


def lexical(claims: DataFrame, evidence: DataFrame, least: float = LEXICAL_LEAST) -> DataFrame:
    """Share of a claim's distinct terms in an evidence text (answer_id, evidence_index, evidence), the largest counts.

    Claim and evidence meet by answer; each text is cut by its own script.  Never contradicted.
    """
    c = claims.withColumn("terms", _terms("claim"))
    e = evidence.select("answer_id", "evidence_index", _terms("evidence").alias("ev"))
    scored = c.join(e, "answer_id").select(*_KEY, "evidence_index", F.try_divide(F.size(F.array_intersect("terms", "ev")), F.size("terms")).alias("score"))
    return _best(scored, claims, least, "lexical-overlap", True)


def embedding(claims: DataFrame, evidence: DataFrame, least: float = EMBEDDING_LEAST, name: str = "given") -> DataFrame:
    """Largest cosine of ``claim_vec`` and ``evidence_vec``."""
    scored = claims.join(evidence.select("answer_id", "evidence_index", "evidence_vec"), "answer_id")
    return _best(scored.select(*_KEY, "evidence_index", cosine(F.col("claim_vec"), F.col("evidence_vec")).alias("score")), claims, least, f"embedding-sim:{name}", False)


def nli(claims: DataFrame, probabilities: DataFrame, entailed: float = ENTAILED_LEAST, contradicted: float = CONTRADICTED_LEAST, name: str = "given") -> DataFrame:
    """The decision over (answer_id, claim_index, evidence_index, entailment, contradiction).

    The evidence with the largest entailment decides; contradiction counts on that one alone.
    """
    best = probabilities.groupBy(*_KEY).agg(
        F.max(F.struct(F.coalesce("entailment", F.lit(0.0)).alias("e"), (-F.col("evidence_index")).alias("neg"), F.coalesce("contradiction", F.lit(0.0)).alias("c"))).alias("b")
    )
    label = F.when(F.col("b.e") >= entailed, "supported").when(F.col("b.c") >= contradicted, "contradicted").otherwise("unsupported")
    return claims.join(best, list(_KEY), "left").select(
        *_KEY, "claim", label.alias("label"), F.coalesce("b.e", F.lit(0.0)).alias("score"), (-F.col("b.neg")).cast("int").alias("best_evidence_index"), F.lit(f"nli:{name}").alias("method")
    )


@F.pandas_udf(T.DoubleType())
def hash_unit(text: pd.Series) -> pd.Series:
    """A number in [0, 1) that depends on the text alone: the first eight bytes of BLAKE2b over 2^64."""
    return text.map(lambda t: None if t is None else int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "big") / 2**64)


def fake(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Verdicts without meaning, for plumbing: by the claim's hash; unsupported without evidence."""
    has = evidence.select("answer_id").distinct().withColumn("has", F.lit(True))
    r = hash_unit(F.col("claim"))
    got = claims.join(has, "answer_id", "left").withColumn("r", r)
    label = F.when(F.col("has").isNull(), "unsupported").when(F.col("r") < 0.34, "supported").when(F.col("r") < 0.5, "contradicted").otherwise("unsupported")
    return got.select(
        *_KEY, "claim", label.alias("label"), F.when(F.col("has"), F.col("r")).otherwise(0.0).alias("score"),
        F.when(F.col("has"), 0).cast("int").alias("best_evidence_index"), F.lit("fake").alias("method"),
    )


def faithfulness(verdicts: DataFrame, answers: DataFrame) -> DataFrame:
    """(answer_id, n_claims, faithfulness_rate): supported share of each answer's claims, null without claims."""
    by = verdicts.groupBy("answer_id").agg(F.count("*").alias("n_claims"), F.avg((F.col("label") == "supported").cast("double")).alias("faithfulness_rate"))
    return answers.select("answer_id").join(by, "answer_id", "left").na.fill(0, ["n_claims"])


def best_first(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy(*_KEY).orderBy(F.round("score", 9).desc(), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def judged(claims: DataFrame, evidence: DataFrame, llm) -> DataFrame:
    """Verdicts that a language model's replies name; it sees all evidence, so none is the best."""
    from . import prompts

    by = evidence.groupBy("answer_id").agg(F.array_sort(F.collect_list(F.struct("evidence_index", "evidence"))).alias("all"))
    got = claims.join(by, "answer_id", "left")
    reply = llm.generate(prompts.judge_prompt(F.col("claim"), F.transform("all", lambda e: e["evidence"])), 8)
    label = F.when(F.col("all").isNull(), "unsupported").otherwise(judge_label(reply))
    return got.withColumn("label", label).select(
        *_KEY, "claim", "label", F.when(F.col("label") == "unsupported", 0.0).otherwise(1.0).alias("score"),
        F.lit(None).cast("int").alias("best_evidence_index"), F.lit(f"llm-judge:{llm.name}").alias("method"),
    )
