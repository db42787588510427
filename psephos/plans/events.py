"""Time queries on ``events``: windows, nearest prices, volume weights, slopes, bins, budgets, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from psephos import dims
from psephos.functions import scalars
from psephos.operators import aggregates, joins, ordered, sampling
from psephos.plans.posts import KEPT
from psephos.plans.registry import query, table
from psephos.streaming import router

DAY = 86_400


def timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with ``t`` in epoch seconds."""
    rows = table(spark, sf_dir, "events")
    return rows.withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).withColumn("day", F.floor(F.col("t") / DAY).cast("long"))


#: Four offsets around the middle of each event type, in hours.
OFFSETS = [("pre", -24.0), ("h1", 1.0), ("h24", 24.0), ("h72", 72.0)]
_T = "epoch_us(ts) / 1000000.0"
_MID = f"mid AS (SELECT event_type, floor((min({_T}) + max({_T})) / 2) AS mid FROM events GROUP BY 1)"
_OFF = ", ".join(f"('{n}', {h})" for n, h in OFFSETS)
_TARGETS = f"targets AS (SELECT event_type, name, mid + h * 3600 AS goal FROM mid CROSS JOIN (VALUES {_OFF}) o(name, h))"


def targets(events: DataFrame) -> DataFrame:
    mid = events.groupBy("event_type").agg(F.floor((F.min("t") + F.max("t")) / 2).alias("mid"))
    offsets = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(h).alias("h")) for n, h in OFFSETS]))
    return mid.select("event_type", "mid", offsets.alias("o")).select("event_type", "o.name", (F.col("mid") + F.col("o.h") * 3600).alias("at"))


@query(f"""
SELECT event_id FROM events WHERE event_id % 10 = 0 OR {_T} BETWEEN
  (SELECT floor((min({_T}) + max({_T})) / 2) - 72 * 3600 FROM events) AND (SELECT floor((min({_T}) + max({_T})) / 2) + 72 * 3600 FROM events)""")
def window_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth timestamp counts as missing; rows without one are kept."""
    rows = timed(spark, sf_dir)
    mid = rows.agg(F.floor((F.min("t") + F.max("t")) / 2).alias("mid"))
    t = F.when(F.col("event_id") % 10 != 0, F.col("t"))
    return rows.crossJoin(F.broadcast(mid)).where(t.isNull() | t.between(F.col("mid") - 72 * 3600, F.col("mid") + 72 * 3600)).select("event_id")  # mid is one row


@query(f"""
WITH {_MID}, {_TARGETS}
SELECT t.event_type, name, round(arg_min(value, {{'d': abs({_T} - goal), 't': {_T}}}), 6) AS value FROM targets t JOIN events e ON e.event_type = t.event_type GROUP BY ALL""")
def nearest_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = timed(spark, sf_dir)
    near = joins.nearest_in_time(rows.select("event_type", "t", "value"), targets(rows), keys=["event_type"])
    return near.select("event_type", "name", F.round("value", 6).alias("value"))


@query(f"""
WITH {_MID}, {_TARGETS}
SELECT t.event_type, name, round(v, 6) AS value FROM targets t LEFT JOIN
  (SELECT t.event_type AS et, name AS nm, arg_max(value, {{'t': {_T}, 'v': value}}) AS v FROM targets t JOIN events e ON e.event_type = t.event_type AND abs({_T} - goal) <= 3600 GROUP BY ALL)
  ON et = t.event_type AND nm = name""")
def last_in_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = timed(spark, sf_dir)
    last = joins.last_in_window(rows.select("event_type", "t", "value"), targets(rows), 3600.0, keys=["event_type"])
    return last.select("event_type", "name", F.round("value", 6).alias("value"))


#: Each purchase is a moment; prices are the clicks and views, in whole microseconds, of the same bucket of users.
_PRICES = "p AS (SELECT user_id % 50 AS k, epoch_us(ts) AS t, max(value) AS value FROM events WHERE event_type IN ('click', 'view') AND value IS NOT NULL GROUP BY ALL)"
_MOMENTS = "q AS (SELECT event_id, user_id % 50 AS k, epoch_us(ts) AS moment FROM events WHERE event_type = 'purchase')"


def prices_and_moments(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("k", F.col("user_id") % 50)
    moments = rows.where("event_type = 'purchase'").select("event_id", "k", F.col("us").alias("at"))
    return rows.where("event_type IN ('click', 'view')").select("k", F.col("us").alias("t"), "value"), moments


@query(f"WITH {_PRICES}, {_MOMENTS} SELECT event_id, value, (moment - t)::BIGINT AS age_us FROM q ASOF LEFT JOIN p ON q.k = p.k AND q.moment >= p.t")
def as_of_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last price at or before each moment, and its age."""
    points, moments = prices_and_moments(spark, sf_dir)
    return ordered.as_of(points, moments, ["k"]).select("event_id", F.col("found").alias("value"), (F.col("at") - F.col("found_at")).alias("age_us"))


@query(f"""
WITH {_PRICES}, {_MOMENTS}
SELECT event_id, arg_min(value, {{'d': abs(t - (moment - 86400000000)), 't': t}}) AS value FROM q LEFT JOIN p ON q.k = p.k AND t <= moment GROUP BY 1""")
def price_a_day_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The price nearest to a day before each moment, of those at or before the moment."""
    points, moments = prices_and_moments(spark, sf_dir)
    return ordered.nearest_until(points, moments, ["k"], 86_400_000_000).select("event_id", F.col("found").alias("value"))


@query(f"""
WITH e AS (SELECT event_type, floor({_T} / 86400)::BIGINT AS day, value AS price, CASE WHEN event_id % 3 > 0 AND event_id % 17 > 0 THEN (event_id % 17)::DOUBLE END AS volume FROM events WHERE isfinite(value)),
m AS (SELECT *, avg(volume) OVER (PARTITION BY event_type, day) AS mean FROM e)
SELECT event_type, day, round(CASE WHEN sum(coalesce(volume, mean)) > 0 THEN sum(price * coalesce(volume, mean)) / sum(coalesce(volume, mean)) ELSE avg(price) END, 6) AS vwap FROM m GROUP BY ALL""")
def vwap_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = timed(spark, sf_dir).withColumn("volume", F.when(F.col("event_id") % 3 > 0, (F.col("event_id") % 17).cast("double")))
    out = aggregates.volume_weighted(rows, ["event_type", "day"], "value", "volume")
    return out.select("event_type", "day", F.round("vwap", 6).alias("vwap"))


@query(f"""
SELECT event_type, day, count(*) AS n, round(CASE WHEN count(*) >= 3 THEN regr_slope(value, ({_T} - day * 86400) / 3600) END, 4) AS slope
FROM (SELECT *, floor({_T} / 86400)::BIGINT AS day FROM events) GROUP BY ALL""")
def elasticity_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = timed(spark, sf_dir).withColumn("hour", (F.col("t") - F.col("day") * DAY) / 3600)
    return aggregates.slopes(rows, ["event_type", "day"], "value", "hour").select("event_type", "day", "n", F.round("slope", 4).alias("slope"))


@query("""
SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS min, round(quantile_cont(value, 0.25), 6) AS q25,
       round(quantile_cont(value, 0.75), 6) AS q75, max(value) AS max FROM events GROUP BY 1""")
def summary_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = aggregates.summary(table(spark, sf_dir, "events"), ["event_type"], "value")
    return out.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("mean", "std")], "min", *[F.round(c, 6).alias(c) for c in ("q25", "q75")], "max")


@query("""
SELECT event_id, CASE WHEN s < -0.5 THEN 'strong_neg' WHEN s < -0.3 THEN 'mod_neg' WHEN s < -0.15 THEN 'mild_neg' WHEN s < -0.05 THEN 'slight_neg' WHEN s < 0.05 THEN 'neutral'
       WHEN s < 0.15 THEN 'slight_pos' WHEN s < 0.3 THEN 'mild_pos' WHEN s < 0.5 THEN 'mod_pos' ELSE 'strong_pos' END AS bin
FROM (SELECT event_id, (event_id % 240) / 100.0::DOUBLE - 1.2 AS s FROM events)""")
def score_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", scalars.sentiment_bin((F.col("event_id") % 240) / 100.0 - 1.2).alias("bin"))


@query("""
SELECT bin, count(*) AS n, round(avg(mid * 1.1), 9) AS delta
FROM (SELECT CASE WHEN s < -0.5 THEN 'strong_neg' WHEN s < -0.05 THEN 'neg' WHEN s < 0.05 THEN 'neutral' WHEN s < 0.5 THEN 'pos' ELSE 'strong_pos' END AS bin,
             CASE WHEN s < -0.5 THEN -0.12 WHEN s < -0.3 THEN -0.07 WHEN s < -0.15 THEN -0.035 WHEN s < -0.05 THEN -0.012 WHEN s < 0.05 THEN 0.0 WHEN s < 0.15 THEN 0.012 WHEN s < 0.3 THEN 0.035 WHEN s < 0.5 THEN 0.07 ELSE 0.12 END::DOUBLE AS mid
      FROM (SELECT (event_id % 240) / 100.0::DOUBLE - 1.2 AS s FROM events)) GROUP BY 1""")
def bin_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(((F.col("event_id") % 240) / 100.0 - 1.2).alias("s"))
    bins = dims.small(dims.bins(spark))
    joined = rows.join(bins, (F.col("s") >= F.col("lo")) & (F.col("s") < F.col("hi")))
    side = F.when(F.col("bin").isin("strong_neg", "neutral", "strong_pos"), F.col("bin")).when(F.col("midpoint") < 0, "neg").otherwise("pos")
    return joined.groupBy(side.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(scalars.scaled_delta(F.col("midpoint"), F.lit(1.1))), 9).alias("delta"))


#: Shares of two event types, as a sampler is given them; other types get an equal share of their day.
EVENT_SHARES = {"click": 0.71, "view": 0.11}


@query(f"""
WITH n AS (SELECT floor({_T} / 86400)::BIGINT AS day, event_type AS bloc, count(*) AS n FROM events GROUP BY ALL),
b AS (SELECT greatest(1, floor(600 / count(DISTINCT day))) AS budget FROM n),
s AS (SELECT *, CASE bloc WHEN 'click' THEN 0.71 WHEN 'view' THEN 0.11 ELSE 1.0 / count(*) OVER (PARTITION BY day) END::DOUBLE AS share FROM n)
SELECT day, bloc, n, greatest(1, round_even((SELECT budget FROM b) * (share / sum(share) OVER (PARTITION BY day)), 0))::BIGINT AS target FROM s""")
def day_offset_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.day_targets(timed(spark, sf_dir).withColumnRenamed("event_type", "bloc"), "day", "bloc", 600, EVENT_SHARES).select("day", "bloc", "n", "target")


@query()
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = timed(spark, sf_dir).select("event_id", "day", F.col("event_type").alias("bloc"), "value")
    return sampling.day_sample(rows, "day", "bloc", "event_id", F.abs("value") >= 0.5, 600, seed=7, shares=EVENT_SHARES)


@query(f"""
WITH g AS (SELECT d.day, t.event_type FROM (SELECT DISTINCT floor({_T} / 86400)::BIGINT AS day FROM events) d CROSS JOIN (SELECT DISTINCT event_type FROM events) t)
SELECT day, event_type FROM g ANTI JOIN (SELECT DISTINCT floor({_T} / 86400)::BIGINT AS day, event_type FROM events WHERE event_id % 97 = 0) e USING (day, event_type)""")
def coverage_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = timed(spark, sf_dir)
    return joins.missing_cells(rows.where("event_id % 97 = 0").select("day", "event_type"), rows.select("day").distinct(), rows.select("event_type").distinct())


@query("SELECT k, count(*) AS n, count(*) FILTER (WHERE k IS NULL) AS malformed FROM (SELECT TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1")
def json_unwrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.from_json("props", "struct<k: bigint>")["k"].alias("k"))
    return rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("k").isNull(), 1)).alias("malformed"))


@query("""
SELECT event_id, epoch_ms(make_timestamp((epoch_us(ts) // 1000000) * 1000000))::BIGINT AS parsed_ms, (event_id * 65536 + 77) // 65536 AS flake_ms FROM events""")
def timestamp_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One time in five notations: seconds, milliseconds, ISO with zone, with a space, with the day's name."""
    ts = F.col("ts").cast("timestamp")
    forms = [F.unix_seconds(ts).cast("string"), (F.unix_seconds(ts) * 1000).cast("string"), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.concat(F.date_format(ts, "E MMM dd HH:mm:ss"), F.lit(" +0000 "), F.date_format(ts, "yyyy"))]
    form = F.element_at(F.array(*forms), (F.col("event_id") % 5 + 1).cast("int"))
    flake = scalars.snowflake_time(F.col("event_id") * 65536 + 77)
    return table(spark, sf_dir, "events").select("event_id", F.unix_millis(scalars.timestamp(form)).alias("parsed_ms"), F.unix_millis(flake).alias("flake_ms"))


@query("SELECT event_type, round(CASE WHEN p + m = 0 THEN 0 ELSE (p - m) / (p + m) END, 9) AS valence FROM (SELECT event_type, sum(value) FILTER (WHERE event_id % 2 = 0) AS p, sum(value) FILTER (WHERE event_id % 2 = 1) AS m FROM events GROUP BY 1)")
def reaction_valence(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(F.when(F.col("event_id") % 2 == 0, F.col("value"))).alias("p"), F.sum(F.when(F.col("event_id") % 2 == 1, F.col("value"))).alias("m"))
    return sums.select("event_type", F.round(scalars.valence(F.col("p"), F.col("m")), 9).alias("valence"))


@query(f"SELECT DISTINCT conv_id, turn, topic FROM conversations JOIN (VALUES ('alpha', 'the'), ('beta', 'eaux'), ('gamma', 'de')) k(topic, keyword) ON contains(lower(text), keyword) WHERE {KEPT}")
def stream_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The firehose router as an incremental job over the files of ``conversations``."""
    return router.route_available(spark, f"{sf_dir}/conversations.parquet")


@query("""
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(DISTINCT event_id) AS n, round(avg(value), 6) AS mean FROM events
GROUP BY ALL HAVING max(date_trunc('day', ts)) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def stream_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts with late events dropped after an hour and repeats removed within it; a day comes out when the watermark has passed it."""
    out = router.windowed_available(spark, f"{sf_dir}/events.parquet")
    return out.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("mean", 6).alias("mean"))
