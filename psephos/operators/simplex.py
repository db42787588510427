"""Projection of the values of each group onto the probability simplex."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from psephos.operators import ordered


def project(rows: DataFrame, key: str, value: str) -> DataFrame:
    """``rows`` with ``w``: max(value - theta, 0), where theta makes each group's sum 1.

    Equal values fall together, and the counts and sums of larger values come
    from ``ordered.running``, so a group of any size is spread over tasks. Rows
    with a null value or key get a null.
    """
    levels = rows.where(F.col(value).isNotNull() & F.col(key).isNotNull()).groupBy(key, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    levels = levels.withColumns({"_down": -F.col("_v"), "_s": F.col("_v") * F.col("_n")})
    upto = ordered.running(levels, [key], ["_down"], sums=["_n", "_s"])
    n, s = F.col("_n_before") + F.col("_n"), F.col("_s_before") + F.col("_s")
    # a level takes part as long as its values stay above theta, which is so for the largest levels up to some place
    part = upto.select(F.col(key).alias("_of"), n.alias("_n"), ((s - 1.0) / n).alias("_theta"), "_v").where("_v > _theta")
    thetas = part.groupBy("_of").agg(F.max_by("_theta", "_n").alias("_theta"))
    joined = rows.join(thetas, F.col(key) == F.col("_of"), "left")
    return joined.withColumn("w", F.when(F.col(value).isNotNull(), F.greatest(F.col(value) - F.col("_theta"), F.when(F.col("_theta").isNotNull(), F.lit(0.0))))).drop("_theta", "_of")
