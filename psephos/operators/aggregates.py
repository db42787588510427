"""Aggregations: weighted shares, merges of sources, covariances, prices, metrics. All are algebraic, so they combine before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from psephos.operators import ordered


def finite(c: Column) -> Column:
    """Neither null, NaN nor infinite."""
    x = c.cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def kish_share(rows: DataFrame, keys: Sequence[str], hit: Column, weight: Column | None = None) -> DataFrame:
    """Weighted share of ``hit`` (0 or 1; null: left out) and its standard error by Kish's effective size; a null weight counts 1."""
    w = F.coalesce(weight, F.lit(1.0)) if weight is not None else F.lit(1.0)
    sums = (
        rows.select(*keys, hit.cast("double").alias("_hit"), w.cast("double").alias("_w"))
        .where("_hit IN (0, 1)")
        .groupBy(*keys)
        .agg(F.sum(F.col("_hit") * F.col("_w")).alias("_dw"), F.sum("_w").alias("_sw"), F.sum(F.col("_w") * F.col("_w")).alias("_sww"))
    )
    share = F.col("_dw") / F.col("_sw")
    size = F.greatest(F.col("_sw") * F.col("_sw") / F.col("_sww"), F.lit(1.0))
    return sums.withColumn("vote_share", share).withColumn("se", F.sqrt(F.col("vote_share") * (1 - F.col("vote_share")) / size)).drop("_dw", "_sw", "_sww")


def inverse_se_merge(panel: DataFrame, keys: Sequence[str] = ("cycle", "bloc")) -> DataFrame:
    """One row for each key: shares of several sources averaged with weights 1/se, sources joined by ``+``.

    A key with one share keeps its row's values. A zero or null ``se`` weighs 1.
    Keys whose shares are all null vanish.
    """
    w = F.when(F.col("se") > 0, 1 / F.col("se")).otherwise(F.lit(1.0))
    valid = panel.where("vote_share IS NOT NULL").withColumn("_w", w)
    merged = valid.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.first("vote_share").alias("_one"), F.first("se").alias("_one_se"),
        (F.sum(F.col("vote_share") * F.col("_w")) / F.sum("_w")).alias("_mean"), F.sum(F.col("_w") * F.col("_w")).alias("_ww"),
        F.array_join(F.array_sort(F.collect_set("source")), "+").alias("source"),
    )
    return merged.select(
        *keys,
        F.when(F.col("_n") == 1, F.col("_one")).otherwise(F.col("_mean")).alias("vote_share"),
        F.when(F.col("_n") == 1, F.col("_one_se")).otherwise(1 / F.sqrt("_ww")).alias("se"),
        "source",
    )


def average_duplicates(rows: DataFrame, keys: Sequence[str], share: str, size: str) -> DataFrame:
    """Mean share and size of rows with one key, and the binomial standard error for that size, 1 at least."""
    out = rows.groupBy(*keys).agg(F.avg(share).alias("vote_share"), F.avg(size).alias("_n"))
    return out.withColumn("se", F.sqrt(F.col("vote_share") * (1 - F.col("vote_share")) / F.greatest("_n", F.lit(1.0)))).drop("_n")


def weighted_mean(value: Column, weight: Column, empty: Column | None = None) -> Column:
    """Mean over rows where both are known; ``empty`` (null by default) without any weight."""
    w = F.when(value.isNotNull(), weight)
    return F.when(F.sum(w) > 0, F.sum(value * w) / F.sum(w)).otherwise(F.lit(None) if empty is None else empty)


def pivot_mean(rows: DataFrame, row: str, column: str, values: Sequence[str], value: str) -> DataFrame:
    return rows.groupBy(row).pivot(column, list(values)).agg(F.avg(value))


def pairwise_covariance(rows: DataFrame, at: str, name: str, value: str) -> DataFrame:
    """Sample covariance of each pair of names over the points that both have; 0 where it isn't defined.

    ``rows`` has one row for a point and name. Names are a dimension, so each point has few rows.
    """
    a = rows.select(at, F.col(name).alias("a"), F.col(value).alias("x"))
    b = rows.select(at, F.col(name).alias("b"), F.col(value).alias("y"))
    return a.join(b, at).groupBy("a", "b").agg(F.count(F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), 1)).alias("n"), F.coalesce(F.covar_samp("x", "y"), F.lit(0.0)).alias("cov"))


def first_differences(rows: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Change from one point to the next for each key; the first has none. Keys are a dimension with few points each."""
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("delta", F.col(value) - F.lag(value).over(w)).where("delta IS NOT NULL")


def volume_weighted(rows: DataFrame, keys: Sequence[str], price: str, volume: str) -> DataFrame:
    """Volume-weighted price; a volume that is not over 0 counts as the mean of its key's known ones, and all unknown as equal. Prices that aren't finite are left out."""
    ok = rows.where(finite(F.col(price)))
    # sum p*v over known + mean * sum p over unknown, in one pass
    known = F.coalesce(finite(F.col(volume)) & (F.col(volume) > 0), F.lit(False))
    sums = ok.groupBy(*keys).agg(
        F.sum(F.when(known, F.col(price) * F.col(volume))).alias("_pv"), F.sum(F.when(known, F.col(volume))).alias("_v"), F.avg(F.when(known, F.col(volume))).alias("_mean"),
        F.sum(F.when(~known, F.col(price))).alias("_pu"), F.count(F.when(~known, 1)).alias("_nu"), F.avg(price).alias("_plain"),
    )
    top = F.coalesce("_pv", F.lit(0.0)) + F.col("_mean") * F.coalesce("_pu", F.lit(0.0))
    bottom = F.coalesce("_v", F.lit(0.0)) + F.col("_mean") * F.col("_nu")
    return sums.select(*keys, F.when(bottom > 0, top / bottom).otherwise(F.col("_plain")).alias("vwap"))


def slopes(rows: DataFrame, keys: Sequence[str], y: str, x: str, least: int = 3) -> DataFrame:
    """Least-squares slope for each key with ``least`` points or more, else null; null too where x doesn't vary. Pairs that aren't finite are left out."""
    ok = rows.where(finite(F.col(y)) & finite(F.col(x)))
    return ok.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.when(F.count(F.lit(1)) >= least, F.regr_slope(y, x)).alias("slope"))


def summary(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Count, mean, deviation, extremes and exact quartiles (linear interpolation); quartiles come from ranks over ranges, so no group is gathered."""
    v = F.col(value)
    plain = rows.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    quartiles = ordered.quantiles(rows, keys, value, {"q25": 0.25, "q75": 0.75})
    both = ordered.same(plain, quartiles, keys, "left")
    return both.select(*keys, "n", "mean", "std", "min", "q25", "q75", "max")


def two_level_mean(rows: DataFrame, record: Sequence[str], value: Column) -> DataFrame:
    """Mean of the records' means, so that long records weigh no more."""
    return rows.groupBy(*record).agg(F.avg(value).alias("_mean")).agg(F.avg("_mean").alias("mean"), F.count("_mean").alias("records"))


def share_within(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``rows`` with ``share``, the value over its key's sum: the sums are joined, so a large key is not gathered."""
    sums = rows.groupBy(*keys).agg(F.sum(value).alias("_sum"))
    return rows.join(sums, list(keys)).withColumn("share", F.when(F.col("_sum") != 0, F.col(value) / F.col("_sum"))).drop("_sum")


def group_means(rows: DataFrame, keys: Sequence[str], names: DataFrame, name: str, value: str) -> DataFrame:
    """Plain mean over the groups (platforms) that have a value, for each key and each of ``names``, a dimension; 0 where none has."""
    means = rows.groupBy(*keys, name).agg(F.avg(value).alias("_mean"))
    grid = rows.select(*keys).distinct().crossJoin(F.broadcast(names.select(name).distinct()))
    return grid.join(means, [*keys, name], "left").select(*keys, name, F.coalesce("_mean", F.lit(0.0)).alias(value))


def class_counts(rows: DataFrame, classes: dict[str, Column]) -> DataFrame:
    """``name, n``: rows of each class, a row may be in several; one pass. A condition that is null doesn't count."""
    counted = rows.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in classes.items()])
    return counted.select(F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.col(k).alias("n")) for k in classes])).alias("x")).select("x.*")


def frequent_classes(rows: DataFrame, name: str, least: int) -> DataFrame:
    """``name, n`` of the classes with ``least`` rows or more; a null name is no class."""
    return rows.where(F.col(name).isNotNull()).groupBy(name).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
