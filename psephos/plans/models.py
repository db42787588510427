"""Queries of models fitted by group."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from psephos.operators import models
from psephos.plans.registry import query, table

STATUSES = ["F", "O", "P"]
SOURCES = ["news", "social"]


def segment_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``bloc, cycle, x, won``: for each customer segment and quarter the shares of order states, their count and its place in time; it wins if its mean price exceeds the segment's."""
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = orders.select(F.col("c_mktsegment").alias("bloc"), (F.year("o_orderdate") * 4 + F.quarter("o_orderdate")).cast("long").alias("cycle"), "o_orderstatus", F.col("o_totalprice").alias("price"))
    shares = [F.avg((F.col("o_orderstatus") == s).cast("double")).alias(s) for s in STATUSES]
    cells = rows.groupBy("bloc", "cycle").agg(*shares, F.avg("price").alias("mean"), F.stddev_samp("price").alias("spread"), F.col("cycle").cast("double").alias("time"))
    level = rows.groupBy("bloc").agg(F.avg("price").alias("level"))
    labelled = cells.join(level, "bloc").withColumn("won", (F.col("mean") > F.col("level")).cast("double"))
    return models.vectors(labelled, ["bloc"], "cycle", "won", [*STATUSES, "spread", "time"])


@query()
def loco_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each quarter of each segment as its model sees it that was fitted to the other quarters, with the fold's error and the segment's accuracy and Brier score."""
    folds = models.left_out(segment_months(spark, sf_dir), ["bloc"], "cycle", "won")
    scores = models.fold_scores(folds, ["bloc"], "won")
    brier = (F.col("prob") - F.col("won")) ** 2
    hit = (F.col("prob") >= 0.5) == (F.col("won") > 0.5)
    return folds.join(scores, "bloc").select("bloc", "cycle", "won", F.round("prob", 6).alias("prob"), F.round("deviation", 6).alias("deviation"), hit.alias("hit"), F.round(brier, 6).alias("fold_brier"), F.round("accuracy", 6).alias("accuracy"), F.round("brier", 6).alias("brier"))


def user_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``bloc, unit, news, social, delta``: an event type stands for a bloc and a user for an event; two thirds of the events are scores of two sources, the rest what was observed."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("bloc"), F.col("user_id").alias("unit"), "value", (F.col("event_id") % 3).alias("kind"))
    scores = rows.where("kind < 2").select("bloc", "unit", F.when(F.col("kind") == 0, "news").otherwise("social").alias("source"), F.col("value").alias("score"))
    return models.wide_scores(scores, rows.where("kind = 2").withColumnRenamed("value", "delta"), ["bloc"], "unit", SOURCES)


_PENALTIES = ", ".join(f"({p}::DOUBLE)" for p in models.PENALTIES)


def ridge_sql(rows: str) -> str:
    """SQL of the fits to ``w (bloc, y, a, b)``, which ``rows`` defines: 2x2 systems are written out."""
    return f"""
WITH {rows},
m AS (SELECT bloc, count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(y) AS my FROM w GROUP BY 1),
d AS (SELECT w.bloc, n, a - ma AS a, b - mb AS b, y - my AS y FROM w JOIN m ON w.bloc = m.bloc),
s AS (SELECT bloc, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * y) AS ay, sum(b * y) AS cy, sum(y * y) AS yy FROM d GROUP BY 1),
i AS (SELECT bloc, p, yy, (bb + p) / ((aa + p) * (bb + p) - ab * ab) AS i11, -ab / ((aa + p) * (bb + p) - ab * ab) AS i12, (aa + p) / ((aa + p) * (bb + p) - ab * ab) AS i22, ay, cy
      FROM s, (VALUES {_PENALTIES}) v(p)),
f AS (SELECT bloc, p, yy, i11, i12, i22, i11 * ay + i12 * cy AS wa, i12 * ay + i22 * cy AS wb FROM i),
e AS (SELECT f.bloc, p, any_value(yy) AS yy, any_value(wa) AS wa, any_value(wb) AS wb, sum(power((y - wa * a - wb * b) / greatest(1 - (i11 * a * a + 2 * i12 * a * b + i22 * b * b + 1.0 / n), 1e-9), 2)) AS press
      FROM f JOIN d ON f.bloc = d.bloc GROUP BY ALL),
c AS (SELECT *, row_number() OVER (PARTITION BY bloc ORDER BY press, p) AS r FROM e)
SELECT m.bloc, n, p AS penalty, round(my - wa * ma - wb * mb, 6) AS intercept, round(wa, 6) AS news, round(wb, 6) AS social, round(1 - press / yy, 6) AS cv_r2
FROM m JOIN c ON m.bloc = c.bloc WHERE r = 1"""


def shown(fits: DataFrame) -> DataFrame:
    return fits.select("bloc", "n", "penalty", F.round("intercept", 6).alias("intercept"), *[F.round(F.col("coefficients")[s], 6).alias(s) for s in SOURCES], F.round("cv_r2", 6).alias("cv_r2"))


@query(ridge_sql("""y AS (SELECT event_type AS bloc, user_id, avg(value) AS y FROM events WHERE event_id % 3 = 2 AND isfinite(value) GROUP BY ALL),
x AS (SELECT event_type AS bloc, user_id, avg(value) FILTER (WHERE event_id % 3 = 0) AS a, avg(value) FILTER (WHERE event_id % 3 = 1) AS b FROM events WHERE isfinite(value) GROUP BY ALL),
w AS (SELECT y.bloc, y, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM y LEFT JOIN x ON x.bloc = y.bloc AND x.user_id = y.user_id)"""))
def elasticity_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the scores of two sources move each bloc: ridge regressions with the penalty of least leave-one-out error."""
    return shown(models.ridge_by_group(user_scores(spark, sf_dir), ["bloc"], SOURCES, "delta"))


@query(ridge_sql("""w AS (SELECT lang AS bloc, quality::DOUBLE AS y, least(n_chars / 5000.0::DOUBLE, 2) AS a, toxic::DOUBLE AS b FROM documents JOIN labels ON documents.doc_id = labels.doc_id
  WHERE lang IS NOT NULL AND quality IS NOT NULL AND n_chars IS NOT NULL AND toxic IS NOT NULL)"""))
def quality_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How length and a verdict move the quality of each language's documents: a group holds as many rows as the table has."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("bloc"), F.least(F.col("n_chars") / 5000.0, F.lit(2.0)).alias("news"))
    rows = docs.join(table(spark, sf_dir, "labels"), "doc_id").select("bloc", "news", F.col("toxic").cast("double").alias("social"), F.col("quality").cast("double").alias("delta")).dropna()
    return shown(models.ridge_by_group(rows, ["bloc"], SOURCES, "delta"))
