"""Panel queries: weighted shares, merges, moments, imputation, validation.

``lineitem`` rows stand for respondents, ``orders`` rows for panel cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from psephos import dims
from psephos.functions import scalars
from psephos.operators import aggregates, joins, relational
from psephos.plans.registry import query, table

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def year(c) -> F.Column:
    return F.year(c).cast("long")


def respondents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        year("l_shipdate").alias("cycle"), F.col("l_returnflag").alias("bloc"), F.col("l_linestatus").alias("source"),
        (F.col("l_discount") > 0.05).cast("int").alias("hit"), F.col("l_quantity").alias("w"),
    )


_KISH = """
kish AS (
  SELECT cycle, bloc, source, vote_share,
         sqrt(vote_share * (1 - vote_share) / greatest(sw * sw / sww, 1.0)) AS se
  FROM (SELECT year(l_shipdate)::BIGINT AS cycle, l_returnflag AS bloc, l_linestatus AS source,
               sum(CASE WHEN l_discount > 0.05 THEN l_quantity ELSE 0 END) / sum(l_quantity) AS vote_share,
               sum(l_quantity) AS sw, sum(l_quantity * l_quantity) AS sww
        FROM lineitem GROUP BY ALL))"""


@query(f"WITH {_KISH} SELECT cycle, bloc, source, round(vote_share, 9) AS vote_share, round(se, 9) AS se FROM kish")
def kish_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = aggregates.kish_share(respondents(spark, sf_dir), ["cycle", "bloc", "source"], F.col("hit"), F.col("w"))
    return rows.select("cycle", "bloc", "source", F.round("vote_share", 9).alias("vote_share"), F.round("se", 9).alias("se"))


@query(f"""
WITH {_KISH},
w AS (SELECT *, CASE WHEN se > 0 THEN 1 / se ELSE 1 END AS w FROM kish)
SELECT cycle, bloc, round(CASE WHEN count(*) = 1 THEN any_value(vote_share) ELSE sum(vote_share * w) / sum(w) END, 9) AS vote_share,
       round(CASE WHEN count(*) = 1 THEN any_value(se) ELSE 1 / sqrt(sum(w * w)) END, 9) AS se,
       string_agg(DISTINCT source, '+' ORDER BY source) AS source
FROM w GROUP BY cycle, bloc""")
def inverse_se_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = aggregates.kish_share(respondents(spark, sf_dir), ["cycle", "bloc", "source"], F.col("hit"), F.col("w"))
    merged = aggregates.inverse_se_merge(rows)
    return merged.select("cycle", "bloc", F.round("vote_share", 9).alias("vote_share"), F.round("se", 9).alias("se"), "source")


@query("""
SELECT cycle, bloc, round(vs, 9) AS vote_share, round(sqrt(vs * (1 - vs) / greatest(n, 1.0)), 9) AS se
FROM (SELECT year(o_orderdate)::BIGINT AS cycle, o_orderstatus AS bloc, avg(least(o_totalprice / 1000000, 1.0)) AS vs, avg(o_custkey % 500) AS n
      FROM orders GROUP BY ALL)""")
def dup_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(
        year("o_orderdate").alias("cycle"), F.col("o_orderstatus").alias("bloc"),
        F.least(F.col("o_totalprice") / 1_000_000, F.lit(1.0)).alias("share"), (F.col("o_custkey") % 500).cast("double").alias("n"),
    )
    out = aggregates.average_duplicates(rows, ["cycle", "bloc"], "share", "n")
    return out.select("cycle", "bloc", F.round("vote_share", 9).alias("vote_share"), F.round("se", 9).alias("se"))


@query("SELECT year(o_orderdate)::BIGINT AS cycle, " + ", ".join(f"round(avg(o_totalprice) FILTER (WHERE o_orderpriority = '{p}'), 4) AS p{i}" for i, p in enumerate(PRIORITIES)) + " FROM orders GROUP BY 1")
def pivot_cycle_bloc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").withColumn("cycle", year("o_orderdate"))
    out = aggregates.pivot_mean(rows, "cycle", "o_orderpriority", PRIORITIES, "o_totalprice")
    return out.select("cycle", *[F.round(out[p], 4).alias(f"p{i}") for i, p in enumerate(PRIORITIES)])


def monthly_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of finished orders for each month and priority; a null where fewer than three."""
    rows = table(spark, sf_dir, "orders").select(
        (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("long").alias("month"), F.col("o_orderpriority").alias("bloc"),
        (F.col("o_orderstatus") == "F").cast("double").alias("f"),
    )
    return rows.groupBy("month", "bloc").agg(F.when(F.count(F.lit(1)) >= 3, F.avg("f")).alias("x"))


_MONTHLY = """
m AS (SELECT (year(o_orderdate) * 12 + month(o_orderdate))::BIGINT AS month, o_orderpriority AS bloc,
             CASE WHEN count(*) >= 3 THEN avg((o_orderstatus = 'F')::INT) END AS x
      FROM orders GROUP BY ALL)"""


@query(f"""
WITH {_MONTHLY}
SELECT p.bloc AS a, q.bloc AS b, count(CASE WHEN p.x IS NOT NULL AND q.x IS NOT NULL THEN 1 END) AS n,
       round(coalesce(covar_samp(p.x, q.x), 0.0), 9) AS cov
FROM m p JOIN m q USING (month) GROUP BY ALL""")
def pairwise_cov(spark: SparkSession, sf_dir: str) -> DataFrame:
    cov = aggregates.pairwise_covariance(monthly_shares(spark, sf_dir), "month", "bloc", "x")
    return cov.select("a", "b", "n", F.round("cov", 9).alias("cov"))


@query(f"""
WITH {_MONTHLY}
SELECT bloc, month, round(delta, 9) AS delta
FROM (SELECT bloc, month, x - lag(x) OVER (PARTITION BY bloc ORDER BY month) AS delta FROM m WHERE x IS NOT NULL)
WHERE delta IS NOT NULL""")
def first_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = aggregates.first_differences(monthly_shares(spark, sf_dir).where("x IS NOT NULL"), ["bloc"], "month", "x")
    return rows.select("bloc", "month", F.round("delta", 9).alias("delta"))


@query("""
SELECT year(o_orderdate)::BIGINT AS cycle, n_name AS stratum,
       round(sum(o_totalprice * c_acctbal) FILTER (WHERE c_acctbal > 0) / sum(c_acctbal) FILTER (WHERE c_acctbal > 0), 2) AS mean
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL""")
def stratum_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    # nation has 25 rows whatever the scale
    customers = table(spark, sf_dir, "customer").join(dims.small(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = table(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    weight = F.when(F.col("c_acctbal") > 0, F.col("c_acctbal"))
    out = rows.groupBy(year("o_orderdate").alias("cycle"), F.col("n_name").alias("stratum")).agg(aggregates.weighted_mean(F.col("o_totalprice"), weight).alias("mean"))
    return out.select("cycle", "stratum", F.round("mean", 2).alias("mean"))


_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "UNKNOWN"]


@query("""
WITH y AS (SELECT year(o_orderdate) AS cycle, avg((o_orderstatus = 'F')::INT) AS f FROM orders GROUP BY 1 HAVING avg((o_orderstatus = 'F')::INT) > 0.3),
m AS (SELECT c_mktsegment AS bloc, avg(o_totalprice) AS mu FROM orders JOIN customer ON o_custkey = c_custkey
      WHERE year(o_orderdate) IN (SELECT cycle FROM y) GROUP BY 1)
SELECT d.bloc, round(coalesce(mu, 0.5), 4) AS mu
FROM (VALUES ('AUTOMOBILE'), ('BUILDING'), ('FURNITURE'), ('HOUSEHOLD'), ('MACHINERY'), ('UNKNOWN')) d(bloc) LEFT JOIN m USING (bloc)""")
def winning_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("cycle", F.year("o_orderdate"))
    won = orders.groupBy("cycle").agg(F.avg((F.col("o_orderstatus") == "F").cast("int")).alias("f")).where("f > 0.3").select("cycle")
    rows = orders.join(won, "cycle", "left_semi").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    means = rows.groupBy(F.col("c_mktsegment").alias("bloc")).agg(F.avg("o_totalprice").alias("mu"))
    names = spark.createDataFrame([(b,) for b in _SEGMENTS], "bloc string")
    return names.join(means, "bloc", "left").select("bloc", F.round(F.coalesce("mu", F.lit(0.5)), 4).alias("mu"))


@query("""
WITH y AS (SELECT year(o_orderdate)::BIGINT + 12 AS cycle, o_orderpriority AS bloc, avg((o_orderstatus = 'F')::INT) AS vote_share FROM orders
           WHERE NOT (year(o_orderdate) = 1996 AND o_orderpriority = '1-URGENT') GROUP BY ALL),
p AS (SELECT cycle, CASE bloc WHEN '1-URGENT' THEN 'muslim' WHEN '2-HIGH' THEN 'other_gender' WHEN '3-MEDIUM' THEN 'other_race' ELSE 'white' END AS bloc, vote_share, 'panel' AS source FROM y
      WHERE bloc IN ('1-URGENT', '2-HIGH', '3-MEDIUM')),
r(cycle, bloc, constant, donor, source) AS (VALUES (2004, 'other_gender', 0.76, NULL, 'imputed_pew_lgbtq'), (2008, 'other_gender', 0.76, NULL, 'imputed_pew_lgbtq'),
  (2012, 'other_gender', 0.76, NULL, 'imputed_pew_lgbtq'), (2020, 'other_gender', 0.76, NULL, 'imputed_pew_lgbtq'), (2024, 'other_gender', 0.76, NULL, 'imputed_pew_lgbtq'),
  (2004, 'muslim', NULL, 2008, 'imputed_carry_2008'), (1948, 'other_race', NULL, 1952, 'imputed_carry_1952'))
SELECT cycle, bloc, round(vote_share, 9) AS vote_share, source FROM p
UNION ALL
SELECT r.cycle::BIGINT, r.bloc, round(coalesce(r.constant, d.vote_share)::DOUBLE, 9), r.source
FROM r LEFT JOIN p d ON d.cycle = r.donor AND d.bloc = r.bloc
WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.cycle = r.cycle AND p.bloc = r.bloc) AND coalesce(r.constant, d.vote_share) IS NOT NULL""")
def impute_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"1-URGENT": "muslim", "2-HIGH": "other_gender", "3-MEDIUM": "other_race"}
    bloc = F.element_at(F.create_map(*[F.lit(x) for p in names.items() for x in p]), F.col("o_orderpriority"))
    rows = table(spark, sf_dir, "orders").where(F.col("o_orderpriority").isin(list(names))).where("NOT (year(o_orderdate) = 1996 AND o_orderpriority = '1-URGENT')")
    panel = rows.groupBy((year("o_orderdate") + 12).alias("cycle"), bloc.alias("bloc")).agg(F.avg((F.col("o_orderstatus") == "F").cast("int")).alias("vote_share"))
    out = relational.impute(panel.withColumn("source", F.lit("panel")))
    return out.select("cycle", "bloc", F.round("vote_share", 9).alias("vote_share"), "source")


@query("""
SELECT count(*) FILTER (WHERE cycle IS NULL) AS null_cycle, count(*) FILTER (WHERE bloc IS NULL) AS null_bloc, count(*) FILTER (WHERE vote_share IS NULL) AS null_share,
       count(*) FILTER (WHERE cycle NOT BETWEEN 1900 AND 2100) AS cycle_range,
       count(*) FILTER (WHERE NOT regexp_matches(bloc, '^[a-z][a-z0-9_]*$')) AS bloc_name, count(*) FILTER (WHERE vote_share NOT BETWEEN 0 AND 1) AS share_range
FROM (SELECT year(o_orderdate) AS cycle, CASE WHEN o_orderkey % 7 = 0 THEN o_orderpriority WHEN o_orderkey % 11 = 0 THEN NULL ELSE 'white' END AS bloc,
             CASE WHEN o_orderkey % 13 > 0 THEN o_totalprice / 400000 END AS vote_share FROM orders)""")
def validation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    bloc = F.expr("CASE WHEN o_orderkey % 7 = 0 THEN o_orderpriority WHEN o_orderkey % 11 = 0 THEN NULL ELSE 'white' END")
    share = F.expr("CASE WHEN o_orderkey % 13 > 0 THEN o_totalprice / 400000 END")
    rows = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("cycle"), bloc.alias("bloc"), share.alias("vote_share"))
    return relational.violations(rows)


@query("SELECT o_custkey, year(o_orderdate)::BIGINT AS cycle, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey", year("o_orderdate").alias("cycle"))
    return rows.agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("""
SELECT o_orderkey, round(CASE WHEN year(o_orderdate) = 1992 THEN least(greatest(s / (1 - CASE o_orderpriority WHEN '1-URGENT' THEN 0.21 ELSE 0.189 END), 0), 1) ELSE s END, 9) AS share
FROM (SELECT *, o_totalprice / 500000 AS s FROM orders)""")
def three_party_1992(spark: SparkSession, sf_dir: str) -> DataFrame:
    third = F.when(F.col("o_orderpriority") == "1-URGENT", F.lit(0.21))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(scalars.two_party(F.col("o_totalprice") / 500_000, F.year("o_orderdate"), third), 9).alias("share"))


@query("""
SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN c_acctbal / 10000 WHEN c_mktsegment = 'BUILDING' THEN 0.5 WHEN c_nationkey < 5 THEN 0.25 ELSE 0.1 END
       / sum(CASE WHEN c_acctbal > 5000 THEN c_acctbal / 10000 WHEN c_mktsegment = 'BUILDING' THEN 0.5 WHEN c_nationkey < 5 THEN 0.25 ELSE 0.1 END) OVER (PARTITION BY c_nationkey) > 0.05 AS heavy
FROM customer""")
def value_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.expr("CASE WHEN c_acctbal > 5000 THEN c_acctbal / 10000 WHEN c_mktsegment = 'BUILDING' THEN 0.5 WHEN c_nationkey < 5 THEN 0.25 ELSE 0.1D END")
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", value.alias("value"))
    return aggregates.share_within(rows, ["c_nationkey"], "value").select("c_custkey", (F.col("share") > 0.05).alias("heavy"))


@query("""
SELECT cycle, round(0.114 * coalesce(sum(f * w) FILTER (WHERE s = 0) / sum(w) FILTER (WHERE s = 0), 0.5) + 0.224 * coalesce(avg(f) FILTER (WHERE s = 1), 0.5)
       + 0.662 * coalesce(avg(f) FILTER (WHERE s = 2), 0.5), 9) AS mu_eff
FROM (SELECT year(o_orderdate)::BIGINT AS cycle, o_orderkey % 3 AS s, (o_orderstatus = 'F')::INT AS f, o_totalprice AS w FROM orders) GROUP BY 1""")
def mu_eff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(
        year("o_orderdate").alias("cycle"), (F.col("o_orderkey") % 3).alias("s"), (F.col("o_orderstatus") == "F").cast("int").alias("f"), F.col("o_totalprice").alias("w")
    )
    of = lambda s, c: F.when(F.col("s") == s, F.col(c))
    race = aggregates.weighted_mean(of(0, "f"), of(0, "w"), F.lit(0.5))
    rest = [F.coalesce(F.avg(of(s, "f")), F.lit(0.5)) for s in (1, 2)]
    return rows.groupBy("cycle").agg(F.round(0.114 * race + 0.224 * rest[0] + 0.662 * rest[1], 9).alias("mu_eff"))


@query("""
SELECT c_custkey, CASE WHEN n IS NULL THEN 'missing' ELSE 'done' END AS status, top
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, arg_max(o_orderpriority, {'a': o_totalprice, 'k': o_orderkey}) AS top FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def summary_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderpriority", F.struct("o_totalprice", "o_orderkey")).alias("top"))
    rows = table(spark, sf_dir, "customer").join(best, F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.select("c_custkey", F.when(F.col("o_custkey").isNull(), "missing").otherwise("done").alias("status"), "top")


@query("""
WITH m AS (SELECT year(o_orderdate)::BIGINT AS cycle, avg((o_orderstatus = 'F')::INT) AS model, avg((o_orderpriority < '3')::INT) AS market FROM orders GROUP BY 1)
SELECT cycle, round(abs(model - market) * 100, 6) AS gap_pp, abs(model - market) * 100 > 10 AS flagged FROM m""")
def divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").groupBy(year("o_orderdate").alias("cycle")).agg(
        F.avg((F.col("o_orderstatus") == "F").cast("int")).alias("model"), F.avg((F.col("o_orderpriority") < "3").cast("int")).alias("market")
    )
    gap = F.abs(F.col("model") - F.col("market")) * 100
    return rows.select("cycle", F.round(gap, 6).alias("gap_pp"), (gap > 10).alias("flagged"))


@query("""
SELECT p_brand, p_partkey, round(greatest(v - theta, 0), 9) AS w
FROM (SELECT p_brand, p_partkey, v, max(CASE WHEN v * r > c - 1 THEN r END) OVER (PARTITION BY p_brand) AS rho,
             max(CASE WHEN v * r > c - 1 THEN {'r': r, 't': (c - 1) / r} END) OVER (PARTITION BY p_brand)['t'] AS theta
      FROM (SELECT p_brand, p_partkey, p_size / 50.0 AS v,
                   sum(p_size) OVER w / 50.0 AS c, row_number() OVER w AS r
            FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey ROWS UNBOUNDED PRECEDING)))""")
def simplex_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    from psephos.operators.simplex import project

    rows = table(spark, sf_dir, "part").select("p_brand", "p_partkey", (F.col("p_size") / 50.0).alias("v"))
    return project(rows, "p_brand", "v").select("p_brand", "p_partkey", F.round("w", 9).alias("w"))


@query("""
SELECT 'both' AS kind, o_custkey AS k FROM (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' INTERSECT SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW')
UNION ALL SELECT 'urgent_only', o_custkey FROM (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW')""")
def key_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = lambda p: table(spark, sf_dir, "orders").where(F.col("o_orderpriority") == p).select(F.col("o_custkey").alias("k"))
    a, b = keys("1-URGENT"), keys("5-LOW")
    return a.intersect(b).select(F.lit("both").alias("kind"), "k").unionByName(a.subtract(b).select(F.lit("urgent_only").alias("kind"), "k"))


@query("""
SELECT k, year(d)::BIGINT AS cycle, tag FROM (SELECT o_orderkey AS k, o_orderdate AS d, o_orderpriority AS tag FROM orders
UNION ALL SELECT l_orderkey * 10 + l_linenumber, l_shipdate, NULL FROM lineitem)""")
def rename_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = relational.renamed(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority"), {"o_orderkey": "k", "o_orderdate": "d", "o_orderpriority": "tag", "absent": "x"})
    lines = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), F.col("l_shipdate").alias("d"))
    return relational.union_all(orders, lines).select("k", year("d").alias("cycle"), "tag")


@query("""
SELECT coalesce(a.k, b.k) AS k, round(coalesce(a.x, 0) - coalesce(b.x, 0), 4) AS x
FROM (SELECT c_nationkey AS k, avg(c_acctbal) AS x FROM customer GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, avg(s_acctbal) AS x FROM supplier GROUP BY 1) b ON a.k = b.k""")
def outer_subtract(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.avg("c_acctbal").alias("x"))
    b = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.avg("s_acctbal").alias("x"))
    return joins.subtract(a, b, "k", "x").select("k", F.round("x", 4).alias("x"))


@query("""
SELECT o_orderpriority AS bloc, CASE WHEN grouping(o_orderpriority) = 1 THEN 'total' ELSE 'bloc' END AS level, year(o_orderdate)::BIGINT AS cycle, count(*) AS n
FROM orders GROUP BY GROUPING SETS ((o_orderpriority, year(o_orderdate)), (year(o_orderdate)))""")
def coverage_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("bloc"), year("o_orderdate").alias("cycle"))
    both = rows.rollup("cycle", "bloc").agg(F.count(F.lit(1)).alias("n"), F.grouping("bloc").alias("g"), F.grouping("cycle").alias("h")).where("h = 0")
    return both.select("bloc", F.when(F.col("g") == 1, "total").otherwise("bloc").alias("level"), "cycle", "n")


@query("""
SELECT o_orderkey, round(s, 9) AS share, CASE WHEN s < 0.05 THEN 'low' ELSE 'high' END AS reason
FROM (SELECT o_orderkey, o_totalprice / 500000 AS s FROM orders) WHERE s < 0.05 OR s > 0.95""")
def share_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") / 500_000).alias("s")).where("s < 0.05 OR s > 0.95")
    return rows.select("o_orderkey", F.round("s", 9).alias("share"), F.when(F.col("s") < 0.05, "low").otherwise("high").alias("reason"))


@query("""
SELECT p_partkey, arg_min(name, {'o': -overlap, 'n': name}) AS name, max(overlap)::BIGINT AS overlap
FROM (SELECT p_partkey, name, len(list_intersect(string_split(lower(p_type), ' '), string_split(name, '_'))) AS overlap
      FROM part CROSS JOIN (VALUES ('standard_plated_tin'), ('economy_brushed_steel'), ('promo_burnished_copper'), ('small_anodized_brass')) n(name)) WHERE overlap > 0 GROUP BY 1""")
def overlap_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([(n,) for n in ("standard_plated_tin", "economy_brushed_steel", "promo_burnished_copper", "small_anodized_brass")], "name string")
    return joins.by_overlap(table(spark, sf_dir, "part"), "p_partkey", F.split(F.lower("p_type"), " "), names, "name", F.split("name", "_"))


@query("""
SELECT c_nationkey, o_orderpriority AS bloc, round(d, 7) AS delta, rank() OVER (PARTITION BY c_nationkey ORDER BY abs(round(d, 7)) DESC, o_orderpriority) AS place
FROM (SELECT c_nationkey, o_orderpriority, avg(o_totalprice) - avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS d FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL) WHERE d IS NOT NULL""")
def coalition_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shifted less baseline means of each bloc, the largest movers first."""
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    moved = F.avg("o_totalprice") - F.avg(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")))
    out = rows.groupBy("c_nationkey", F.col("o_orderpriority").alias("bloc")).agg(F.round(moved, 7).alias("delta")).where("delta IS NOT NULL")
    return out.withColumn("place", F.rank().over(Window.partitionBy("c_nationkey").orderBy(F.desc(F.abs("delta")), "bloc")).cast("long"))  # five blocs each
