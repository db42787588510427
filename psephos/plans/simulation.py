"""Resampling, simulation and distribution diagnostics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from psephos.operators import simulate
from psephos.plans.registry import query, table

_CENTROIDS = """
p AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings),
c AS (SELECT label, i, avg(x) AS x FROM p GROUP BY ALL)"""


@query(f"""
WITH {_CENTROIDS}
SELECT p.vec_id, p.label, round(sum((p.x - c.x) * (p.x - c.x)), 4) AS d2, round(corr(p.x, c.x), 5) AS r FROM p JOIN c USING (label, i) GROUP BY ALL""")
def centroid_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    means = rows.groupBy("label", "i").agg(F.avg("x").alias("c"))
    out = rows.join(means, ["label", "i"]).groupBy("vec_id", "label").agg(F.sum((F.col("x") - F.col("c")) ** 2).alias("d2"), F.corr("x", "c").alias("r"))
    return out.select("vec_id", "label", F.round("d2", 4).alias("d2"), F.round("r", 5).alias("r"))


@query(f"""
WITH {_CENTROIDS}
SELECT a.label AS a, b.label AS b, round(exp(-0.5 * sum((a.x - b.x) * (a.x - b.x))), 6) AS kernel, round(1 - corr(a.x, b.x), 5) AS distance FROM c a JOIN c b ON a.i = b.i AND a.label < b.label GROUP BY ALL""")
def label_kernels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RBF kernel and correlation distance of the labels' mean vectors."""
    rows = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = rows.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    a, b = (means.select("i", F.col("label").alias(n), F.col("x").alias(f"x{n}")) for n in "ab")
    out = a.join(b, "i").where("a < b").groupBy("a", "b").agg(F.sum((F.col("xa") - F.col("xb")) ** 2).alias("d2"), F.corr("xa", "xb").alias("r"))
    return out.select("a", "b", F.round(F.exp(-0.5 * F.col("d2")), 6).alias("kernel"), F.round(1 - F.col("r"), 5).alias("distance"))


@query()
def mmd_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squared maximum mean discrepancy of each label from all vectors, by random Fourier features of the RBF kernel."""
    return simulate.discrepancy(table(spark, sf_dir, "embeddings"), "label", "embedding", seed=7)


@query()
def bootstrap_cov(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bootstrap mean and deviation of the covariance of two columns, by Poisson weights that the row and the replicate decide."""
    rows = table(spark, sf_dir, "events").select("event_id", "value", (F.col("user_id") % 100).cast("double").alias("y"))
    return simulate.bootstrap_covariance(rows, "event_id", "value", "y", replicates=32, seed=7)


@query()
def bootstrap_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean covariance matrix of bootstrap replicates that draw line items in proportion to their quantity."""
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    matrices = simulate.bootstrap_matrices(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], names, replicates=50, seed=7, weight="l_quantity")
    return simulate.bootstrap_mean(matrices).select("a", "b", *[F.round(c, 6).alias(c) for c in ("cov", "deviation")], "replicates")


@query()
def bootstrap_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean covariance matrix of bootstrap replicates that draw labelled documents in proportion to their length."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("chars"))
    rows = docs.join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "chars", F.log1p("chars").alias("length"), "quality", "toxic")
    matrices = simulate.bootstrap_matrices(rows, ["doc_id"], ["length", "quality", "toxic"], replicates=100, seed=7, weight="chars")
    return simulate.bootstrap_mean(matrices).select("a", "b", *[F.round(c, 6).alias(c) for c in ("cov", "deviation")], "replicates")


@query()
def vector_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each label's vectors with odd ids stand to all with even ids: discrepancy, weight, principal components, correlations."""
    rows = table(spark, sf_dir, "embeddings").withColumn("real", F.col("vec_id") % 2 == 0)
    found = simulate.diagnostics(rows, "real", "label", "vec_id", "embedding", seed=7)
    return found.select("label", "n", *[F.round(c, 6).alias(c) for c in ("mmd", "mmd_weight", "lambda", "top2", "pcd")], "flagged")


@query("""
WITH p AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings),
r AS (SELECT a.i, b.i AS j, corr(a.x, b.x) AS r FROM p a JOIN p b ON a.vec_id = b.vec_id AND a.i <> b.i WHERE a.vec_id % 2 = 0 GROUP BY ALL),
s AS (SELECT a.label, a.i, b.i AS j, corr(a.x, b.x) AS s FROM p a JOIN p b ON a.vec_id = b.vec_id AND a.i <> b.i WHERE a.vec_id % 2 = 1 GROUP BY ALL)
SELECT label, round(sqrt(sum((r - s) * (r - s))) / count(*), 6) AS pcd FROM r JOIN s ON r.i = s.i AND r.j = s.j GROUP BY 1""")
def correlation_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of each label's correlation matrix (odd ids) from that of all vectors with even ids."""
    rows = table(spark, sf_dir, "embeddings").withColumn("real", F.col("vec_id") % 2 == 0)
    return simulate.diagnostics(rows, "real", "label", "vec_id", "embedding", seed=7, features=16).select("label", F.round("pcd", 6).alias("pcd"))


@query()
def monte_carlo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logistic-normal draws around the customers' segment shares: percentiles of each share and the share of wins."""
    shares = table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.avg("c_acctbal").alias("mu")).orderBy("c_mktsegment").collect()  # five segments
    w = np.array([r.n for r in shares], float)
    mu = np.array([r.mu for r in shares], float)
    return simulate.monte_carlo(spark, [r.c_mktsegment for r in shares], w / w.sum(), mu / mu.max(), 0.535, draws=10_000, seed=7)


@query("SELECT doc_id, least(1.0::DOUBLE, length(text) / 1000.0::DOUBLE) AS score FROM documents")
def score_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pluggable scorer over batches of texts, here with a stand-in model."""

    def load():
        return lambda texts: [min(1.0, len(t) / 1000) for t in texts]

    return simulate.scored(table(spark, sf_dir, "documents"), "doc_id", "text", load)


@query("""
SELECT doc_id, CASE WHEN l.doc_id IS NOT NULL THEN quality ELSE round(n_chars / 1000.0::DOUBLE, 6) END::DOUBLE AS score, l.doc_id IS NOT NULL AS hit
FROM documents d LEFT JOIN labels l USING (doc_id)""".replace("SELECT doc_id", "SELECT d.doc_id"))
def score_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known scores are read, the others made."""
    cache = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("score"))
    made = lambda rows: rows.select("doc_id", F.round(F.col("n_chars") / 1000.0, 6).alias("score"))
    return simulate.with_cache(table(spark, sf_dir, "documents"), "doc_id", cache, made)
