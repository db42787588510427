"""Blocs of authors: outlet proxies, then keywords, then language priors, then an optional model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from psephos.operators.joins import bounded, lexicon_hits

#: Stands for methods that say nothing about a single author.
WEAK = "language_prior"


def keyword_weights(posts: DataFrame, key: str, text: Column, lexicon: DataFrame) -> DataFrame:
    """``key, weights``: for each stratum the blocs of the lexicon's keywords in the text, normalised to 1. ``lexicon``: stratum, keyword, bloc, weight; small."""
    hits = posts.select(key, F.inline(lexicon_hits(text, lexicon.select("stratum", "keyword", "bloc", "weight"))))
    sums = hits.groupBy(key, "stratum", "bloc").agg(F.sum("weight").alias("w"))
    # an author's blocs are a dimension: fifteen at most
    packed = sums.groupBy(key, "stratum").agg(F.sum("w").alias("all"), F.collect_list(F.struct("bloc", "w")).alias("own"))
    shares = F.transform("own", lambda x: F.struct(x["bloc"], x["w"] / F.col("all")))
    return packed.groupBy(key).agg(F.map_from_entries(F.flatten(F.collect_list(shares))).alias("weights"))


def classified(posts: DataFrame, key: str, text: Column, outlet: Column, lang: Column, lexicon: DataFrame, proxies: DataFrame, priors: DataFrame, model: Column | None = None) -> DataFrame:
    """``key, method, weights``: the first of outlet proxy, keywords, language prior and model that has weights, else nulls.

    ``proxies`` has ``outlet, weights`` and ``priors`` ``lang, weights``; both are small.
    """
    rows = posts.select(key, text.alias("_text"), outlet.alias("_outlet"), lang.alias("_lang"), (F.lit(None).cast("map<string,double>") if model is None else model).alias("_model"))
    words = keyword_weights(rows, key, F.col("_text"), lexicon).withColumnRenamed("weights", "_words").withColumnRenamed(key, "_key")
    out = rows.join(bounded(proxies.select(F.col("outlet").alias("_outlet"), F.col("weights").alias("_proxy"))), "_outlet", "left")
    out = out.join(bounded(priors.select(F.col("lang").alias("_lang"), F.col("weights").alias("_prior"))), "_lang", "left")
    out = out.join(words, out[key] == words["_key"], "left")
    steps = [("outlet_proxy", "_proxy"), ("keyword", "_words"), (WEAK, "_prior"), ("model", "_model")]
    method = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(name)) for name, c in steps])
    return out.select(key, method.alias("method"), F.coalesce(*[F.col(c) for _, c in steps]).alias("weights"))


def with_platform(rows: DataFrame, platform: Column, defaults: DataFrame) -> DataFrame:
    """``rows`` of ``classified``, where nothing was found with the weights of the author's platform (``platform, weights``; small) and the method ``platform``."""
    known = bounded(defaults.select(F.lower("platform").alias("_platform"), F.col("weights").alias("_default")))
    out = rows.join(known, F.lower(platform) == F.col("_platform"), "left")
    method = F.when(F.col("method").isNotNull(), F.col("method")).when(F.col("_default").isNotNull(), "platform")
    return out.withColumns({"method": method, "weights": F.coalesce("weights", "_default")}).drop("_platform", "_default")


def estimable(rows: DataFrame) -> DataFrame:
    """Rows whose method says something about the author."""
    return rows.where((F.col("method") != WEAK) & F.col("method").isNotNull())


def labelled(rows: DataFrame, least: float = 0.55) -> DataFrame:
    """``rows`` with ``bloc``: the heaviest bloc of the weights, the first by name on ties, if it reaches ``least``."""
    best = F.array_min(F.transform(F.map_entries("weights"), lambda x: F.struct((-x["value"]).alias("v"), x["key"].alias("k"))))
    return rows.withColumn("bloc", F.when(-best["v"] >= least, best["k"]))
