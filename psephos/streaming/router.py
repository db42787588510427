"""Structured Streaming: keyword routing of a firehose, windowed counts, incremental runs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from psephos.functions import text
from psephos.operators import joins


def routed(posts: DataFrame, keywords: DataFrame) -> DataFrame:
    """Posts with a filled text that is no spam, one row for each topic, with ``matched``, all topics of the post. Works on streams and tables alike."""
    kept = posts.where(text.is_kept_body(F.col("text")) & ~text.is_spam(F.col("text")))
    return kept.withColumn("matched", joins.matched(F.col("text"), keywords)).withColumn("topic", F.explode("matched"))


def daily(events: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Counts and means of a day and type; repeated ids within the lateness count once."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["event_id"])
    out = timed.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    return out.select(F.col("window.start").alias("day"), "event_type", "n", "mean")


def folder(spark: SparkSession) -> str:
    """A new folder that all nodes share, under ``spark.checkpoint.dir``; a temporary one is used in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    base = base or "file://" + tempfile.mkdtemp(prefix="psephos-stream-")
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def run_available(stream: DataFrame, path: str, mode: str = "append") -> None:
    """Writes what there is to Parquet, exactly once, and ends; the same checkpoint goes on from there."""
    q = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").option("path", f"{path}/out").trigger(availableNow=True).start()
    q.awaitTermination()


def parent(path: str) -> tuple[str, str]:
    """A stream reads folders: a single file is read through its parent with a name filter."""
    head, _, tail = path.rpartition("/")
    return head, tail


def opened(spark: SparkSession, path: str) -> DataFrame:
    schema = spark.read.parquet(path).schema
    single = len(spark.read.parquet(path).inputFiles()) == 1
    head, tail = parent(path)
    if single and spark.read.parquet(path).inputFiles()[0].endswith(tail):
        return spark.readStream.schema(schema).option("pathGlobFilter", tail).parquet(head)
    return spark.readStream.schema(schema).parquet(path)


def route_available(spark: SparkSession, path: str) -> DataFrame:
    keywords = spark.createDataFrame([("alpha", "the"), ("beta", "eaux"), ("gamma", "de")], "topic string, keyword string")
    at = folder(spark)
    stream = routed(opened(spark, path), keywords).select("conv_id", "turn", "topic")
    run_available(stream, at)
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def windowed_available(spark: SparkSession, path: str) -> DataFrame:
    at = folder(spark)
    stream = daily(opened(spark, path))
    run_available(stream, at)
    return spark.read.schema(stream.schema).parquet(f"{at}/out")
