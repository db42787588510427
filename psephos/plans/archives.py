"""Queries of month tables, appending and merging sinks, and ids seen over runs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from psephos.plans.registry import query, table
from psephos.session import shared_folder
from psephos.sources import archives
from psephos.streaming import router, sinks


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("""
WITH s AS (SELECT n_nationkey, max(o_orderdate)::DATE - 40 * (n_nationkey % 20)::INT AS d FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey % 3 = 0 GROUP BY 1),
w AS (SELECT n_nationkey, d - 6 AS a, d + 17 AS b FROM s)
SELECT n_nationkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM w JOIN orders ON o_orderdate::DATE BETWEEN a AND b GROUP BY 1""")
def month_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in the windows of some events, from a table by month of which only the windows' months are opened."""
    orders = table(spark, sf_dir, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
    archives.write_months(orders, path := folder(spark, "months"), "o_orderdate")
    named = orders.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).where("c_nationkey % 3 = 0")
    shocks = named.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.to_date(F.max("o_orderdate")).alias("latest"))
    shocks = shocks.select("n_nationkey", F.date_sub("latest", (F.col("n_nationkey") % 20 * 40).cast("int")).alias("day"))
    found = archives.in_spans(spark, path, archives.spans_of(shocks, "day", 3, 14, margin=3), "o_orderdate")
    return found.groupBy("n_nationkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT role, count(*) AS n, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY 1")
def appended_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts of a stream, appended in envelopes and read back; running the sink again adds none."""
    path, checkpoint = folder(spark, "appended"), folder(spark, "checkpoint")
    for _ in range(2):
        sinks.append_posts(router.opened(spark, f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"), path, checkpoint, "social", 7, "2026-01-01T00:00:00Z")
    posts = spark.read.text(path).select(F.from_json("value", "struct<payload: struct<role: string, text: string>>")["payload"].alias("p"))
    return posts.groupBy(F.col("p.role").alias("role")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("p.text")).alias("chars"))


@query("SELECT 's' || (conv_id % 5) AS shock, role AS platform, count(*) AS n FROM conversations WHERE text <> '' GROUP BY ALL")
def merged_shocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a stream by event and platform (a role stands for one), merged into an event's folder, with what lies there."""
    rows = router.opened(spark, f"{sf_dir}/conversations.parquet")
    lines = rows.select(F.concat(F.lit("s"), F.col("conv_id") % 5).alias("shock_id"), F.col("role").alias("platform"), F.to_json(F.struct("conv_id", "turn", "text")).alias("value"))
    sinks.merge_posts(lines, path := folder(spark, "merged"), folder(spark, "checkpoint"))
    return sinks.counts(spark, path, ["shock", "platform"])


@query("""
WITH m AS (SELECT epoch_us(min(ts)) + (epoch_us(max(ts)) - epoch_us(min(ts))) // 2 AS mid FROM events)
SELECT user_id, min(CASE WHEN epoch_us(ts) <= mid THEN 1 ELSE 2 END)::INT AS run FROM events, m GROUP BY 1""")
def seen_over_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In which of two runs over a growing folder each user was seen first; the state of the first run is kept for the second."""
    events = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    low, high = events.agg(F.unix_micros(F.min("ts")), F.unix_micros(F.max("ts"))).first()
    inbox, at = folder(spark, "inbox"), folder(spark, "seen")
    if low is None:
        return spark.createDataFrame([], "user_id long, run int")
    early = F.unix_micros("ts") <= low + (high - low) // 2
    for run, part in ((1, events.where(early)), (2, events.where(~early))):
        part.write.mode("append").parquet(inbox)
        stream = sinks.unseen(spark.readStream.schema(events.schema).parquet(inbox), ["user_id"], "ts", "4000 days")
        sinks.run_batches(stream, lambda batch, number, run=run: batch.select("user_id").write.mode("overwrite").parquet(f"{at}/run={run}/batch={number}"), f"{at}/_checkpoint")
    return spark.read.schema("user_id long, run int, batch long").parquet(at).select("user_id", "run")
