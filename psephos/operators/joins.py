"""Joins beyond plain equality."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest number of keywords, lookup targets or windows that is sent to all tasks.
SMALL_ROWS = 10_000


def bounded(small: DataFrame) -> DataFrame:
    """Broadcasts a table that is checked to be small; a larger one is refused."""
    n = small.limit(SMALL_ROWS + 1).count()
    if n > SMALL_ROWS:
        raise ValueError(f"more than {SMALL_ROWS} rows to broadcast")
    return F.broadcast(small)


def routed(posts: DataFrame, text: Column, keywords: DataFrame) -> DataFrame:
    """A row for each post and topic with a keyword in the lower-cased text. ``keywords``: ``topic, keyword``, small.

    The matched topics are an array that is made in one narrow pass and
    exploded: no text is shuffled, and repeated posts stay repeated.
    """
    return posts.withColumn("topic", F.explode(matched(text, keywords)))


def matched(text: Column, keywords: DataFrame) -> Column:
    """The sorted topics with a keyword in the lower-cased text, from ``SMALL_ROWS`` keywords at most; none for null."""
    rows = keywords.select("topic", F.lower("keyword").alias("k")).where("k IS NOT NULL AND topic IS NOT NULL").distinct().limit(SMALL_ROWS + 1).collect()
    if len(rows) > SMALL_ROWS:
        raise ValueError(f"more than {SMALL_ROWS} keywords")
    by: dict[str, list[str]] = {}
    for r in rows:
        by.setdefault(r.topic, []).append(r.k)
    low = F.lower(text)
    hits = [F.when(low.rlike("|".join(re.escape(k) for k in sorted(ks))), F.lit(t)) for t, ks in sorted(by.items())]
    return F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")


def lexicon_hits(text: Column, lexicon: DataFrame) -> Column:
    """An array of the rows of ``lexicon`` whose ``keyword`` is in the lower-cased text, as structs of its other columns; ``SMALL_ROWS`` rows at most.

    One narrow pass, where a join on ``contains`` would be a nested loop.
    """
    rows = lexicon.withColumn("keyword", F.lower("keyword")).where("keyword IS NOT NULL").limit(SMALL_ROWS + 1).collect()
    if len(rows) > SMALL_ROWS:
        raise ValueError(f"more than {SMALL_ROWS} keywords")
    rest = [f for f in lexicon.schema if f.name != "keyword"]
    by: dict[str, list[Column]] = {}
    for r in rows:
        by.setdefault(r.keyword, []).append(F.struct(*[F.lit(r[f.name]).cast(f.dataType).alias(f.name) for f in rest]))
    low = F.lower(text)
    hits = [F.when(low.contains(k), F.array(*own)) for k, own in by.items()]
    none = F.array().cast("array<struct<" + ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in rest) + ">>")
    return F.flatten(F.array_compact(F.array(*hits))) if hits else none


def routed_first(posts: DataFrame, key: str, text: Column, keywords: DataFrame) -> DataFrame:
    """``key, topic``: the topic that sorts first."""
    return routed(posts.select(key, text.alias("_text")), F.col("_text"), keywords).groupBy(key).agg(F.min("topic").alias("topic"))


def nearest_in_time(points: DataFrame, targets: DataFrame, time: str = "t", value: str = "value", at: str = "at", keys: Sequence[str] = ()) -> DataFrame:
    """The value nearest to each target time; the earliest on ties. Times are numbers; ``targets`` is small.

    A minimum over (distance, time) combines before the shuffle, so all points of a key never meet.
    """
    near = points.join(bounded(targets), list(keys)) if keys else points.crossJoin(bounded(targets))
    order = F.struct(F.abs(F.col(time) - F.col(at)), F.col(time))
    return near.groupBy(*targets.columns).agg(F.min_by(value, order).alias(value))


def last_in_window(points: DataFrame, targets: DataFrame, radius: float, time: str = "t", value: str = "value", at: str = "at", keys: Sequence[str] = ()) -> DataFrame:
    """The last value within ``radius`` of each target time, null without one."""
    cond = F.abs(F.col(time) - F.col(at)) <= radius
    t = bounded(targets)
    hit = (points.join(t, list(keys)) if keys else points.crossJoin(t)).where(cond)
    found = hit.groupBy(*targets.columns).agg(F.max_by(value, F.struct(time, value)).alias(value))
    return targets.join(found, list(targets.columns), "left")


def missing_cells(rows: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Cells of the grid of two dimension tables that ``rows`` lacks."""
    return bounded(left).crossJoin(bounded(right)).join(rows, [*left.columns, *right.columns], "left_anti")


def by_overlap(left: DataFrame, key: str, words: Column, names: DataFrame, name: str, name_words: Column) -> DataFrame:
    """The name that shares most words with each key, the first by name on ties; keys that share none are left out. Keys are unique; words meet by an equi-join."""
    own = left.select(key, F.explode(F.array_distinct(words)).alias("_word"))
    of = names.select(name, F.explode(F.array_distinct(name_words)).alias("_word"))
    scored = own.join(of, "_word").groupBy(key, name).agg(F.count(F.lit(1)).alias("overlap"))
    best = scored.groupBy(key).agg(F.min(F.struct((-F.col("overlap")).alias("o"), F.col(name).alias("n"))).alias("b"))
    return best.select(key, F.col("b.n").alias(name), (-F.col("b.o")).cast("long").alias("overlap"))


def subtract(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """``a - b`` over all keys of both; a missing value counts 0."""
    other = b.select(key, F.col(value).alias("_other"))
    return a.join(other, key, "full_outer").select(key, (F.coalesce(value, F.lit(0.0)) - F.coalesce("_other", F.lit(0.0))).alias(value))


def without_listed(rows: DataFrame, key: str, listed: DataFrame) -> DataFrame:
    """Rows whose key isn't listed; null keys stay."""
    return rows.join(listed.select(F.col(listed.columns[0]).alias("_listed")), F.col(key) == F.col("_listed"), "left_anti")
