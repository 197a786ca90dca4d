"""Prompts over retrieved sources as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import TRAIL

# fixed values: the instructions given to the generator, the judge and the decomposer
SYSTEM_PREAMBLE = (
    "You are an enterprise support assistant. Answer only using the numbered sources below. If the sources do not contain "
    "the answer, say so plainly instead of guessing. Answer in the same language as the question. Cite sources inline as "
    "[1], [2], etc., matching the numbers given.\n\nWrite the answer as plain prose: complete sentences, separated by "
    "sentence-ending punctuation. Do not use markdown tables, bullet lists, numbered lists, or headings. State each fact as "
    "its own short sentence rather than combining several facts into one long sentence. Keep the whole answer under roughly "
    "six sentences."
)
NO_SOURCES = "No sources were retrieved for this question. Say that you don't have information to answer it."
JUDGE_QUESTION = "Does the evidence support the claim? Reply with exactly one word: SUPPORTED, CONTRADICTED, or UNSUPPORTED."
DECOMPOSE = (
    "Rewrite the following answer as a list of atomic factual claims — one self-contained statement per line, no numbering, "
    "no commentary. Each claim must be understandable without reading the others. If the answer already declines to answer "
    "or contains no factual claims, output nothing.\n\nAnswer:\n"
)


def source_block(n: Column, title: Column, path: Column, text: Column) -> Column:
    head = F.array_join(F.concat(F.array(title), path), TRAIL)
    return F.concat(F.lit("["), n.cast("string"), F.lit("] ("), head, F.lit(")\n"), text)


def build_prompts(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, question, prompt): sources in rank order, numbered from 1; a form of its own without hits."""
    block = source_block(F.col("rank"), F.coalesce("title", F.lit("")), F.coalesce("section_path", F.array().cast("array<string>")), F.coalesce("text", F.lit("")))
    by = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("block")))).alias("sources"))
    body = F.array_join(F.transform("sources", lambda s: s["block"]), "\n\n")
    middle = F.when(F.col("sources").isNull(), NO_SOURCES).otherwise(F.concat(F.lit("Sources:\n"), body))
    got = questions.join(by, "query_id", "left")
    return got.select("query_id", "question", F.concat_ws("\n\n", F.lit(SYSTEM_PREAMBLE), middle, F.concat(F.lit("Question: "), "question")).alias("prompt"))


def judge_prompt(claim: Column, evidence: Column) -> Column:
    numbered = F.transform(evidence, lambda e, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), e))
    return F.concat(F.lit("Evidence:\n"), F.array_join(numbered, "\n\n"), F.lit("\n\nClaim: "), claim, F.lit("\n\n" + JUDGE_QUESTION))


def decompose_prompt(answer: Column) -> Column:
    return F.concat(F.lit(DECOMPOSE), answer)


def echo(prompt: Column) -> Column:
    """The reply of the provider that calls no model."""
    return F.concat(F.lit("[ECHO — no model called. Prompt was "), F.length(prompt).cast("string"), F.lit(" chars.]"))
