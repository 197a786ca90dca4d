"""The corpus pipeline: documents in, readings at the target mixture out.

Each stage takes (spark, docs, sf_dir) and returns a frame, which is written and read again
as the next one's ``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import decontaminate, mixing, ngram_join, pii, toxicity
from quillon.llm.common import Scratch, free_name


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays under 0.7; null and empty texts stay."""
    return toxicity.without_toxic(docs, _table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of texts with a Jaccard of 0.8 on five-word shingles.

    Repeated rows leave one; texts without a word and rows without an id stay.
    """
    return ngram_join.one_of_each_group(docs, k=5, num=80, den=100)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window that matches a benchmark item; null and empty texts stay."""
    return decontaminate.decontaminated(docs, _table(spark, sf_dir, "benchmark").select("item_id", "text"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the changed texts; nulls stay null."""
    before = free_name(docs, "_text")
    out = pii.redacted(docs.withColumn(before, F.col("text")), pii.train(docs))
    changed = ~F.col("text").eqNullSafe(F.col(before))
    return out.withColumn("n_chars", F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The readings of the documents at the target weights: every document at least once."""
    return mixing.mix_sources(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", one_of_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", redact),
    ("mixing", mix),
]

#: the stages' models cannot be put in SQL; tests hold the rows against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over ``documents``; every stage's result is written and read again."""
    sc = Scratch(spark, "pipeline")
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = sc.keep(docs)
    return docs
