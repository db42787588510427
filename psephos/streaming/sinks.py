"""Sinks whose batches have a key, so that a batch that runs again adds nothing; ids seen in earlier runs; kept scores."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from psephos.operators import simulate
from psephos.sources import readers, sinks


def keyed(write: Callable[[DataFrame], DataFrame], path: str, by: Sequence[str] = ()) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch`` that writes ``write(batch)``, text in ``value``, to folders of ``by`` and the batch's number.

    Only the batch's own folders are overwritten: a batch that was cut off or
    runs again leaves the files it would have left alone.
    """

    def run(batch: DataFrame, number: int) -> None:
        out = write(batch).withColumn("batch", F.lit(number))
        out.select(*by, "batch", "value").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by, "batch").text(path)

    return run


def run_batches(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> int:
    """Hands what there is to the sink and ends; the number of rows of this run. The same checkpoint goes on from there."""
    q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return sum(p["numInputRows"] for p in q.recentProgress)


def append_posts(stream: DataFrame, path: str, checkpoint: str, stage: str, seed: int, collected_at: str) -> int:
    """Appends posts in envelopes as JSON lines; the number of posts of this run."""
    return run_batches(stream, keyed(lambda batch: sinks.enveloped(batch, stage, seed, collected_at), path), checkpoint)


def merge_posts(lines: DataFrame, path: str, checkpoint: str, shock: str = "shock_id", platform: str = "platform") -> int:
    """Merges all platforms' records of an event (``shock_id, platform, value``) into one folder: payloads only, those without a text left out."""

    def write(batch: DataFrame) -> DataFrame:
        return readers.merged(batch, shock, platform).select(F.col(shock).alias("shock"), F.col(platform).alias("platform"), F.col("payload").alias("value"))

    return run_batches(lines, keyed(write, path, ["shock", "platform"]), checkpoint)


def counts(spark: SparkSession, path: str, by: Sequence[str]) -> DataFrame:
    """``by, n``: rows that lie in a sink's folders."""
    return spark.read.text(path).groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def unseen(stream: DataFrame, key: Sequence[str], time: str, keep: str) -> DataFrame:
    """The stream's rows whose key no earlier row has had, in this run or an earlier one with the same checkpoint.

    A key is forgotten when the time has moved on by ``keep`` twice, and may
    come again; rows that are late by more than ``keep`` are left out. The
    state is as large as the keys of that time, spread by key.
    """
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, keep).dropDuplicatesWithinWatermark(list(key))


def kept_scores(rows: DataFrame, key: str, path: str, run: str, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``key, score, hit`` of ``rows``: scores that lie under ``path``, and those that ``score`` makes for other keys, which are kept there.

    What a run has made lies in a folder of its name, so the same run again
    replaces its own scores and no other's: its keys miss again, others hit.
    Equal keys are scored once. Null keys are scored each time and never kept.
    """
    spark = rows.sparkSession
    kind = dict(rows.dtypes)[key]
    try:
        cache = spark.read.schema(f"`{key}` {kind}, score double, run string").parquet(path).where(F.col("run") != run)
    except AnalysisException:  # no run yet
        cache = spark.createDataFrame([], f"`{key}` {kind}, score double, run string")
    known = cache.groupBy(key).agg(F.max("score").alias("score"))
    new = rows.where(F.col(key).isNotNull()).dropDuplicates([key]).join(known.select(key), key, "left_anti")
    score(new).select(key, F.col("score").cast("double").alias("score"), F.lit(run).alias("run")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(path)
    made = spark.read.schema(f"`{key}` {kind}, score double, run string").parquet(path).where(F.col("run") == run).select(key, "score")
    return simulate.with_cache(rows, key, known, lambda misses: misses.where(F.col(key).isNotNull()).select(key).join(made, key).unionByName(score(misses.where(F.col(key).isNull())).select(key, F.col("score").cast("double").alias("score"))))


def hit_rate(scores: DataFrame) -> float:
    """Share of ``kept_scores`` rows that were known; 0 without rows."""
    return scores.agg(F.coalesce(F.avg(F.col("hit").cast("double")), F.lit(0.0))).first()[0]
