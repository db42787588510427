"""Archives of posts by month: written once, read by spans that prune months and stop at a cut-off."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from psephos.operators import joins


def write_months(posts: DataFrame, path: str, time: str) -> None:
    """A table with a folder for each month of ``time``; rows without a time go to a folder of their own. A large month is dealt to several tasks and files."""
    rows = posts.withColumn("month", F.date_format(time, "yyyy-MM"))
    rows.hint("rebalance", "month").sortWithinPartitions("month", time).write.mode("overwrite").partitionBy("month").parquet(path)


def spans_of(shocks: DataFrame, day: str, before: int, after: int, margin: int = 0, start: str | None = None, end: str | None = None) -> DataFrame:
    """``shocks`` with ``first`` and ``last``, the days of their window (given ones count first) and ``margin`` days on both sides."""
    first = F.date_sub(day, before)
    last = F.date_add(day, after)
    first = F.coalesce(start, first) if start else first
    last = F.coalesce(end, last) if end else last
    return shocks.withColumns({"first": F.date_sub(first, margin), "last": F.date_add(last, margin)})


def in_spans(spark: SparkSession, path: str, spans: DataFrame, time: str) -> DataFrame:
    """A row for each post of a month table and span (``first``, ``last``: days) that it lies in; 10,000 spans at most.

    The spans' months are joined to the table's folders, and Spark leaves out
    the files of all other months at run time. Days before the first and after
    the last span (the cut-off) are pushed down to the row groups of files.
    Spans with an unknown end, or that end before they start, hold nothing; a post in several spans comes with each.
    """
    ok = spans.where("first <= last")
    edge = ok.agg(F.min("first"), F.max("last")).first()
    posts = spark.read.parquet(path)
    if edge[0] is not None:
        posts = posts.where((F.col(time) >= F.lit(edge[0]).cast("timestamp")) & (F.col(time) < F.date_add(F.lit(edge[1]), 1).cast("timestamp")))
    months = F.sequence(F.trunc("first", "MM"), F.trunc("last", "MM"), F.expr("INTERVAL 1 MONTH"))
    wanted = ok.withColumn("_month", F.explode(F.transform(months, lambda m: F.date_format(m, "yyyy-MM"))))
    joined = posts.join(joins.bounded(wanted), F.col("month") == F.col("_month"))
    day = F.to_date(time)
    return joined.where((day >= F.col("first")) & (day <= F.col("last"))).drop("_month", "month")
