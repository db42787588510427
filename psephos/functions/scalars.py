"""Numbers, timestamps, bins and scores."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from psephos import dims

# Fixed value: larger numbers are milliseconds (2100-01-01 in seconds).
SECONDS_MOST = 4_102_444_800

# Timestamp patterns, most usual first.
PATTERNS = [
    "yyyy-MM-dd'T'HH:mm:ss.SSSX", "yyyy-MM-dd'T'HH:mm:ssX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ssX", "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "MM/dd/yyyy HH:mm", "MM/dd/yyyy", "MMM dd HH:mm:ss Z yyyy",
]


def number(c: Column) -> Column:
    """A double, or null for what is none (NaN too)."""
    x = F.try_cast(c, "double") if hasattr(F, "try_cast") else c.try_cast("double")
    return F.when(~F.isnan(x), x)


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def timestamp(c: Column) -> Column:
    """Epoch seconds or milliseconds, or one of the patterns; without a zone UTC; null if none fits."""
    s = F.trim(c.cast("string"))
    n = s.try_cast("double")
    epoch = F.when(s.rlike(r"^-?\d+(\.\d+)?$"), F.timestamp_micros((F.when(n > SECONDS_MOST, n / 1000).otherwise(n) * 1_000_000).cast("long")))
    text = F.regexp_replace(s, r"^[A-Za-z]{3} (?=[A-Za-z]{3} )", "")
    return F.coalesce(epoch, *[F.try_to_timestamp(text, F.lit(p)) for p in PATTERNS])


def snowflake_time(c: Column) -> Column:
    return F.timestamp_millis(F.shiftright(c.cast("long"), 16))


def two_party(share: Column, cycle: Column, third_party: Column) -> Column:
    """Shares of 1992 without the third party's votes, clipped to [0, 1]."""
    fixed = clip(share / (1 - F.coalesce(third_party, F.lit(dims.THIRD_PARTY_DEFAULT))), 0.0, 1.0)
    return F.when(cycle == 1992, fixed).otherwise(share)


def sentiment_bin(score: Column) -> Column:
    """Name of the bin of a score in [-1, 1]; half-open intervals, scores beyond the ends clamped; null stays null."""
    out = F.lit(dims.BINS[-1])
    for cut, name in reversed(list(zip(dims.SENTIMENT_CUTS, dims.BINS, strict=False))):
        out = F.when(score < cut, F.lit(name)).otherwise(out)
    return F.when(score.isNotNull(), out)


def midpoint(name: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in zip(dims.BINS, dims.MIDPOINTS, strict=True) for x in pair]), name)


def direction(delta: Column, dead: float = 0.005) -> Column:
    """-1, 0 or 1."""
    return F.when(delta > dead, 1).when(delta < -dead, -1).when(delta.isNotNull(), 0)


def scaled_delta(middle: Column, intensity: Column) -> Column:
    return clip(middle * intensity, -0.15, 0.15)


# What a reaction says about a post.
REACTIONS = {"LIKE": 1.0, "LOVE": 1.5, "WOW": 0.5, "HAHA": 0.5, "ANGRY": -1.5, "SAD": -1.0}


def reaction_valence(counts: Mapping[str, Column], weights: Mapping[str, float] = REACTIONS) -> Column:
    """Balance in [-1, 1] of counts by reaction, each at its weight; a missing or null count is 0."""
    side = lambda up: reduce(add, [F.coalesce(counts[k], F.lit(0)) * abs(w) for k, w in weights.items() if (w > 0) == up and k in counts], F.lit(0.0))
    return valence(side(True), side(False))


def valence(positive: Column, negative: Column) -> Column:
    """Balance of reactions in [-1, 1]; 0 without any."""
    return F.when(positive + negative == 0, F.lit(0.0)).otherwise((positive - negative) / (positive + negative))
