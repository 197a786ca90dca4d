"""Shared plumbing: folds, written tables in the cluster's shared folder, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def held_out(doc_id: str, modulus: int, rest: int):
    """Column: crc32 of the id as text, modulo ``modulus``, is ``rest``."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus == rest, F.lit(False))


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names; a local run without one gets a temporary folder."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        at = getattr(spark, "_quillon_scratch", None)
        if not at:
            at = "file://" + tempfile.mkdtemp(prefix="quillon-")
            spark._quillon_scratch = at
    return at.rstrip("/")


def free_name(df: DataFrame, base: str) -> str:
    """``base``, or it with underscores in front, whichever is no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = "_" + base
    return base


class Scratch:
    """Tables written to the shared folder, which cut lineage and survive lost executors.

    ``keep`` writes a frame and returns it as read back; ``drop`` deletes what is no
    longer read.  Whatever the final frame reads stays until the application's owner
    clears the folder, as with reliable checkpoints.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.at = spark, f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        self.n = 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.at}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        path = getattr(df, "_scratch_path", None)
        if path:
            self._delete(path)

    def clear(self) -> None:
        """Deletes all tables kept so far; nothing may read them any more."""
        self._delete(self.at)

    def _delete(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``edges`` (a, b): comp is the smallest node reachable.

    Alternating large-star and small-star rounds (each a groupBy with map-side combine
    and a join), written after every round; O(log^2 n) rounds, and no node's
    neighbourhood is gathered anywhere.
    """
    e = scratch.keep(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    if e.isEmpty():
        return e.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("x"))
            .select("x.u", "x.v")
            .where("u <> v")
            .distinct()
        )
        new = scratch.keep(small)
        # a fixed point is a forest of stars: every node has one parent and no parent has one
        same = new.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").isEmpty() and new.alias("x").join(
            new.alias("y"), F.col("x.v") == F.col("y.u"), "left_semi"
        ).isEmpty()
        scratch.drop(e)
        e = new
        if same:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    )
