"""Sampling by seeded hashes, so that a row's fate depends on the row and the seed only."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from psephos import dims
from psephos.operators import ordered

#: Rows of a bucket of the hash in which ranks are given, about.
BUCKET_ROWS = 1000


def uniform(seed: int, *key: str) -> Column:
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *key), 12).cast("double") + 0.5) / float(1 << 52)


def ranked(rows: DataFrame, keys: Sequence[str], order: Column, name: str = "rank") -> DataFrame:
    """``rows`` with their rank by a hash (a double in (0, 1)) in each group.

    A bucket of the hash is one window partition and the counts of earlier
    buckets are added, so a large group is spread over many tasks. A group gets
    as many buckets as its rows ask for. Ranks with equal hashes follow no
    order.
    """
    rows = rows.withColumn("_u", order)
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / BUCKET_ROWS).alias("_many"))
    sized = ordered.same(rows, sizes, keys) if keys else rows.crossJoin(F.broadcast(sizes))  # one row
    rows = sized.withColumn("_b", F.floor(F.col("_u") * F.col("_many")).cast("long")).drop("_many")
    counts = rows.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # a row for each bucket
    starts = counts.select(*keys, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    here = Window.partitionBy(*keys, "_b").orderBy("_u")
    return ordered.same(rows.withColumn("_r", F.row_number().over(here)), starts, [*keys, "_b"]).withColumn(name, F.col("_start") + F.col("_r")).drop("_u", "_b", "_r", "_start")


def stratified_split(rows: DataFrame, stratum: str, key: str, fraction: float, seed: int) -> DataFrame:
    """``rows`` with ``train``: of each stratum ``fraction`` of the rows, half-even rounded, one at least."""
    sizes = rows.groupBy(stratum).agg(F.greatest(F.lit(1), F.bround(F.count(F.lit(1)) * fraction, 0).cast("long")).alias("_want"))
    got = ranked(rows, [stratum], uniform(seed, key)).join(sizes, stratum)
    return got.withColumn("train", F.col("rank") <= F.col("_want")).drop("rank", "_want")


def day_targets(rows: DataFrame, day: str, bloc: str, budget: int, shares: Mapping[str, float]) -> DataFrame:
    """``day, bloc, n, target``: an equal budget for each day, dealt by the fixed shares of the blocs that the day has, one at least.

    A bloc without a share counts as one equal part of its day. Days and blocs are dimensions.
    """
    n = rows.groupBy(day, bloc).agg(F.count(F.lit(1)).alias("n"))
    known = F.lit(None).cast("double")
    for name, share in shares.items():
        known = F.when(F.col(bloc) == name, F.lit(share)).otherwise(known)
    own = Window.partitionBy(day)  # a day's blocs
    dealt = n.withColumn("_share", F.coalesce(known, 1 / F.count(F.lit(1)).over(own)))
    dealt = dealt.withColumn("_part", F.col("_share") / F.sum("_share").over(own))
    per_day = n.agg(F.greatest(F.lit(1), F.floor(F.lit(budget) / F.count_distinct(day))).alias("_budget"))
    target = F.greatest(F.lit(1), F.bround(F.col("_budget") * F.col("_part"), 0).cast("long"))
    return dealt.crossJoin(F.broadcast(per_day)).select(day, bloc, "n", target.alias("target"))


def day_sample(
    rows: DataFrame, day: str, bloc: str, key: str, extreme: Column, budget: int, seed: int, shares: Mapping[str, float] = dims.SAMPLE_SHARE, each: int = 1000
) -> DataFrame:
    """Draws each (day, bloc)'s target with replacement, extreme rows at double weight; all rows where there are no more than that.

    Adds ``draws``, the number of times a row is drawn; a cell's draws are
    exactly its target, until the sample is cut to ``budget`` by hash. A draw is
    a seeded point on the cell's cumulative weight. Rows lie in hash buckets of
    about ``each`` rows: sums of buckets find the bucket of a point, and only
    the rows of that bucket are put in order to find the row, so no cell is
    gathered. Keys must be unique.
    """
    cell = [day, bloc]
    targets = day_targets(rows, day, bloc, budget, shares)
    weighed = rows.withColumn("_w", F.when(extreme, 2.0).otherwise(1.0)).withColumn("_u", uniform(seed, key)).join(targets, cell)
    weighed = weighed.withColumn("_b", F.floor(F.col("_u") * F.ceil(F.col("n") / each)).cast("long"))
    whole, large = weighed.where("n <= target").withColumn("draws", F.lit(1).cast("long")), weighed.where("n > target")
    sums = large.groupBy(*cell, "_b", "target").agg(F.sum("_w").alias("_sum"))
    upto = Window.partitionBy(*cell).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = sums.select(*cell, "_b", "target", "_sum", F.coalesce(F.sum("_sum").over(upto), F.lit(0.0)).alias("_at"))
    totals = buckets.groupBy(*cell, "target").agg(F.sum("_sum").alias("_all"))
    points = totals.select(*cell, F.explode(F.sequence(F.lit(1).cast("long"), F.col("target"))).alias("_i"), "_all")
    points = points.select(*cell, "_i", (uniform(seed + 1, *cell, "_i") * F.col("_all")).alias("_at"))

    def placed(starts: DataFrame, points: DataFrame, keys: list[str], what: str) -> DataFrame:
        """The points with the last start at or before each."""
        both = starts.select(*keys, "_at", F.col(what), F.lit(None).cast("long").alias("_i")).unionByName(points.select(*keys, "_at", F.lit(None).cast(starts.schema[what].dataType).alias(what), "_i"))
        order = Window.partitionBy(*keys).orderBy("_at", F.col("_i").isNotNull(), F.col(what)).rowsBetween(Window.unboundedPreceding, 0)
        return both.withColumn(what, F.last(what, ignorenulls=True).over(order)).where("_i IS NOT NULL")

    found = placed(buckets, points, cell, "_b").join(buckets.select(*cell, "_b", F.col("_at").alias("_from")), [*cell, "_b"])
    found = found.withColumn("_at", F.col("_at") - F.col("_from")).drop("_from")
    some = large.join(found.select(*cell, "_b").distinct(), [*cell, "_b"], "left_semi")
    before = Window.partitionBy(*cell, "_b").orderBy("_u", key).rowsBetween(Window.unboundedPreceding, -1)
    starts = some.withColumn("_at", F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    drawn = placed(starts, found, [*cell, "_b"], key).groupBy(key).agg(F.count(F.lit(1)).alias("draws"))
    sample = whole.unionByName(large.join(drawn, key)).drop("_w", "_u", "_b", "n", "target")
    copies = sample.select(key, F.explode(F.sequence(F.lit(1).cast("long"), F.col("draws"))).alias("_copy"))
    kept = ranked(copies, [], uniform(seed + 2, key, "_copy")).where(F.col("rank") <= budget).groupBy(key).agg(F.count(F.lit(1)).alias("draws"))
    return sample.drop("draws").join(kept, key)


def bernoulli(rows: DataFrame, key: str, fraction: float, seed: int) -> DataFrame:
    return rows.where(uniform(seed, key) < fraction)


def capped(rows: DataFrame, group: str, key: str, cap: int, seed: int) -> DataFrame:
    """``cap`` rows of each group, by a seeded hash."""
    return ranked(rows, [group], uniform(seed, key)).where(F.col("rank") <= cap).drop("rank")
