"""The trace log: one JSON object a line, appended, read with a fixed schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import TRACE

#: traces with the folders of the log that they lie in
_LOG = T.StructType([*TRACE.fields, T.StructField("batch", T.LongType()), T.StructField("day", T.StringType())])


def as_lines(traces: DataFrame) -> DataFrame:
    return traces.select(F.to_json(F.struct(*[f.name for f in TRACE.fields])).alias("value"))


def parsed(lines: DataFrame) -> DataFrame:
    return lines.select(F.from_json("value", TRACE).alias("t")).select("t.*")


def append(traces: DataFrame, path: str) -> None:
    traces.select(*[F.col(f.name).cast(f.dataType) for f in TRACE.fields]).write.mode("append").json(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The traces under ``path``, none if it does not exist."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], TRACE)
    return spark.read.schema(TRACE).json(path)


def from_turns(turns: DataFrame) -> DataFrame:
    """Traces that assistant turns stand in for."""
    none = {f.name: F.lit(None).cast(f.dataType) for f in TRACE.fields}
    made = {
        "trace_id": F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")),
        "timestamp": (F.col("conv_id") * 60 + F.col("turn")).cast("double") + 0.25,
        "question": F.col("text"),
        "claims": F.array(F.struct(F.col("text").alias("text"), F.lit("supported").alias("label"), F.lit("kept").alias("action"), F.lit("lexical-overlap").alias("method"))),
        "refused": F.length("text") % 3 == 0,
        "latency_ms": F.create_map(F.lit("total"), F.length("text") * 1.5),
    }
    return turns.where("role = 'assistant'").select(*[c.cast(TRACE[n].dataType).alias(n) for n, c in (none | made).items()])


# an appended log that a replayed stream does not double


def _days(traces: DataFrame) -> DataFrame:
    return traces.withColumn("day", F.to_date(F.timestamp_seconds(F.coalesce("timestamp", F.lit(0.0)))).cast("string"))


def sink(stream: DataFrame, path: str, **options: str):
    """Starts a query that adds the traces of ``stream`` to the log at ``path``, each trace_id once.

    A micro-batch is one folder of the log, written over if the batch is run again; ids that other
    batches have written are left out, looked for in the days of the batch alone.  So neither
    a failed and repeated batch nor traces that are sent again double a row, and none is
    dropped for being late.  A trace that is sent again keeps its timestamp, which is what makes
    it the same trace.  Traces without an id are all kept.  The checkpoint lies in the log's folder.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = _days(batch.select(*[F.col(f.name).cast(f.dataType) for f in TRACE.fields]))
        new = new.where("trace_id is not null").dropDuplicates(["trace_id"]).unionByName(new.where("trace_id is null"))
        have = _written(spark, path)
        if have is not None:
            days = [r.day for r in new.select("day").distinct().collect()]
            others = have.where(F.col("day").isin(days) & (F.col("batch") != batch_id)).select("trace_id")
            new = new.join(others, "trace_id", "left_anti").select(*new.columns)
        new.write.mode("overwrite").partitionBy("day").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", f"{path}/_checkpoint").trigger(availableNow=True).options(**options).start()


def _written(spark: SparkSession, path: str) -> DataFrame | None:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch=*/day=*")
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p):
        return None
    return spark.read.schema(_LOG).option("basePath", path).parquet(f"{path}/batch=*")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The traces that ``sink`` has written."""
    have = _written(spark, path)
    return spark.createDataFrame([], TRACE) if have is None else have.select(*TRACE.names)
