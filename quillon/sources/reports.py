"""Evaluation reports over time: an append-only table of runs, and what changed between neighbours."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

METRICS = ("recall_at_1", "recall_at_3", "recall_at_5", "recall_at_10", "mrr", "ndcg")


def stamp(at: float | None = None) -> str:
    """A UTC time as text, to the second, that sorts as time does."""
    return time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime(at))


def append(report: DataFrame, path: str, name: str, at: str | None = None) -> str:
    """Adds a report (lang, n_items, n_answerable, metrics) as one run of ``name``; returns the run's id.

    Runs are folders of their own, so none is written over, not even within one second.
    """
    at = at or stamp()
    run = f"{at}-{uuid.uuid4().hex[:8]}"
    row = report.withColumns({"name": F.lit(name), "generated_at": F.lit(at)})
    row.coalesce(1).write.mode("errorifexists").parquet(f"{path}/run={run.replace(':', '')}")
    return run


def history(spark: SparkSession, path: str) -> DataFrame:
    """All runs: (name, generated_at, run, lang, n_items, n_answerable, metrics)."""
    rows = spark.read.option("basePath", path).option("mergeSchema", True).parquet(f"{path}/run=*")
    return rows.select("name", "generated_at", F.col("run").cast("string").alias("run"), "lang", "n_items", "n_answerable", *METRICS)


def deltas(runs: DataFrame) -> DataFrame:
    """Each run but the first of its name and language against the run before it.

    A metric that one of the two lacks has no delta.  The row for all languages has a null ``lang``.
    """
    order = Window.partitionBy("name", "lang").orderBy("generated_at", "run")
    before = {f"{m}_delta": F.col(m) - F.lag(m).over(order) for m in METRICS}
    got = runs.withColumns({"previous_run": F.lag("run").over(order), "previous_at": F.lag("generated_at").over(order)} | before)
    return got.where("previous_run is not null").select("name", "lang", "previous_at", "generated_at", *before)
