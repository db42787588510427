"""Text queries: routing, cleaning, filters, lexicon weights, bloc sentiment, keys, sampling. ``documents``, ``pages`` and ``conversations`` stand for posts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from psephos.functions import html, records, scalars, text
from psephos.operators import aggregates, authors, joins, ordered, relational, sampling
from psephos.plans.registry import ORACLES, query, table

# A registry of topics and keywords for the given texts.
KEYWORDS = [("alpha", "thion"), ("alpha", "stupid"), ("beta", "eaux"), ("beta", "ment"), ("gamma", "ción"), ("delta", "lich"), ("delta", "worthless")]
LEXICON = [("race", "the ", "white", 0.6), ("race", "of ", "latino", 0.4), ("religion", "and ", "catholic", 0.7), ("religion", "la ", "secular", 0.5), ("gender", "her", "women", 0.8), ("gender", "on ", "men", 0.5)]
_KW = ", ".join(f"('{t}', '{k}')" for t, k in KEYWORDS)
_LEX = ", ".join(f"('{s}', '{k}', '{b}', {w})" for s, k, b, w in LEXICON)
_STRIP = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def keywords(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(KEYWORDS, "topic string, keyword string")


def lexicon_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, stratum, bloc, weight`` for each keyword of the lexicon in a document."""
    lexicon = spark.createDataFrame(LEXICON, "stratum string, keyword string, bloc string, weight double")
    return table(spark, sf_dir, "documents").select("doc_id", F.inline(joins.lexicon_hits(F.col("text"), lexicon)))


@query(f"SELECT DISTINCT doc_id, topic FROM documents JOIN (VALUES {_KW}) k(topic, keyword) ON contains(lower(text), keyword)")
def keyword_route_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.routed(table(spark, sf_dir, "documents").select("doc_id", "text"), F.col("text"), keywords(spark)).select("doc_id", "topic").distinct()


@query(f"SELECT doc_id, min(topic) AS topic FROM documents JOIN (VALUES {_KW}) k(topic, keyword) ON contains(lower(text), keyword) GROUP BY 1")
def keyword_route_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.routed_first(table(spark, sf_dir, "documents"), "doc_id", F.col("text"), keywords(spark))


@query("SELECT doc_id FROM documents WHERE " + " OR ".join(f"contains(lower(text), '{k}')" for _, k in KEYWORDS))
def keyword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(text.holds_any(F.col("text"), [k for _, k in KEYWORDS])).select("doc_id")


@query(f"""
WITH hits AS (SELECT doc_id, stratum, bloc, sum(weight) AS w FROM documents JOIN (VALUES {_LEX}) l(stratum, keyword, bloc, weight) ON contains(lower(text), keyword) GROUP BY ALL)
SELECT doc_id, stratum, bloc, round((w / sum(w) OVER (PARTITION BY doc_id, stratum))::DOUBLE, 9) AS weight FROM hits""")
def lexicon_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = lexicon_rows(spark, sf_dir).groupBy("doc_id", "stratum", "bloc").agg(F.sum("weight").alias("w"))
    return aggregates.share_within(hits, ["doc_id", "stratum"], "w").select("doc_id", "stratum", "bloc", F.round("share", 9).alias("weight"))


_ORDER = "CASE stratum WHEN 'religion' THEN 0 WHEN 'race' THEN 1 ELSE 2 END"


@query(f"""
WITH hits AS (SELECT doc_id, {_ORDER} AS o, bloc, max(weight) AS w FROM documents JOIN (VALUES {_LEX}) l(stratum, keyword, bloc, weight) ON contains(lower(text), keyword) GROUP BY ALL)
SELECT doc_id, arg_min(bloc, {{'o': o, 'w': -w, 'b': bloc}}) AS bloc FROM hits GROUP BY 1""")
def top_bloc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon_rows(spark, sf_dir).groupBy("doc_id").agg(F.min_by("bloc", F.struct(F.expr(_ORDER), -F.col("weight"), "bloc")).alias("bloc"))


@query("""
WITH s AS (SELECT lang AS bloc, source AS platform, CASE WHEN quality = 1 THEN 0.5 ELSE -0.5 END - toxic AS score, n_chars AS w FROM documents JOIN labels USING (doc_id))
SELECT p.platform, b.bloc, round(coalesce(sum(score * w) / nullif(sum(w), 0), 0), 9) AS score
FROM (SELECT DISTINCT source AS platform FROM documents) p CROSS JOIN (VALUES ('en'), ('de'), ('fr'), ('es'), ('other')) b(bloc) LEFT JOIN s ON s.platform = p.platform AND s.bloc = b.bloc GROUP BY ALL""")
def bloc_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("bloc"), F.col("source").alias("platform"), F.col("n_chars").alias("w"))
    scored = docs.join(table(spark, sf_dir, "labels"), "doc_id").withColumn("score", F.expr("CASE WHEN quality = 1 THEN 0.5D ELSE -0.5D END - toxic"))
    means = scored.groupBy("platform", "bloc").agg(aggregates.weighted_mean(F.col("score"), F.col("w"), F.lit(0.0)).alias("score"))
    names = spark.createDataFrame([(b,) for b in ("en", "de", "fr", "es", "other")], "bloc string")
    grid = docs.select("platform").distinct().crossJoin(joins.bounded(names))
    return grid.join(means, ["platform", "bloc"], "left").select("platform", "bloc", F.round(F.coalesce("score", F.lit(0.0)), 9).alias("score"))


@query(rf"""
SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\bMAGA\b', 'Make America Great Again', 'g'), '\bSCOTUS\b', 'Supreme Court', 'g'), 'https?://\S+', '', 'g'),
       '@[0-9A-Za-z_]+', '', 'g'), '#([0-9A-Za-z_]+)', '\1', 'g'), '\s{{2,}}', ' ', 'g'), {_STRIP}) AS cleaned FROM conversations""")
def normalise_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.clean_post(F.col("text")).alias("cleaned"))


def spam_sql(said: str) -> str:
    """SQL for texts that are no spam."""
    return rf"""NOT (regexp_matches({said}, '^(?i:RT)\s+@[0-9A-Za-z_]+') OR regexp_matches(trim({said}, {_STRIP}), '^(https?://\S+)$') OR regexp_replace({said}, '{text.EMOJI}', '', 'g') = ''
  OR length(trim(regexp_replace(regexp_replace({said}, 'https?://\S+', '', 'g'), '@[0-9A-Za-z_]+', '', 'g'), {_STRIP})) < 10)"""


_PLANTED = "CASE (conv_id + turn) % 9 WHEN 0 THEN 'rt  @someone ' || text WHEN 1 THEN 'https://example.org/' || conv_id WHEN 2 THEN 'www.example.org/a/long/path' WHEN 3 THEN 'art @someone ' || text WHEN 4 THEN '@a @b https://x.org short' ELSE text END"


@query(f"SELECT conv_id, turn FROM (SELECT conv_id, turn, {_PLANTED} AS said FROM conversations) WHERE {spam_sql('said')}")
def spam_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that are no spam; some begin like retweets, or are a link or nearly so."""
    k = (F.col("conv_id") + F.col("turn")) % 9
    said = F.when(k == 0, F.concat(F.lit("rt  @someone "), "text")).when(k == 1, F.concat(F.lit("https://example.org/"), "conv_id")).when(k == 2, "www.example.org/a/long/path")
    said = said.when(k == 3, F.concat(F.lit("art @someone "), "text")).when(k == 4, "@a @b https://x.org short").otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").where(~text.is_spam(said)).select("conv_id", "turn")


@query(f"""
SELECT conv_id, turn FROM conversations WHERE lower(trim(text, {_STRIP})) NOT IN ('[deleted]', '[removed]', '[removed by reddit]') AND length(trim(text, {_STRIP})) >= 10""")
def body_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where(text.is_kept_body(F.col("text"))).select("conv_id", "turn")


#: SQL for posts that a stream keeps.
KEPT = ORACLES["body_filter"].partition(" WHERE ")[2] + " AND " + spam_sql("text")


@query(r"""
SELECT doc_id, len(w)::BIGINT AS n_words, array_to_string(w[1:128], ' ') AS head FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents) WHERE len(w) >= 100""")
def word_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").where(text.word_count(F.col("text")) >= 100)
    return rows.select("doc_id", text.word_count(F.col("text")).cast("long").alias("n_words"), text.first_words(F.col("text")).alias("head"))


@query(f"""
SELECT doc_id, key FROM (SELECT doc_id, sha256(lower(trim(text, {_STRIP}))) AS key, row_number() OVER (PARTITION BY lower(trim(text, {_STRIP})) ORDER BY doc_id) AS r FROM documents) WHERE r = 1""")
def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.lower(text.strip(F.col("text"))), 256).alias("key"))
    return relational.keep_first(rows, F.col("key"), "doc_id")


@query("""
SELECT doc_id, bloc, trim(both '_' FROM regexp_replace(regexp_replace(regexp_replace(lower(trim(label)), '[\\s/.-]+', '_', 'g'), '[^a-z0-9_]', '', 'g'), '_+', '_', 'g')) AS key
FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN ' Black / African-American ' WHEN 1 THEN 'Born-Again.Christian' WHEN 2 THEN 'NON--binary' ELSE 'Hispanic/Latino' END AS label,
             CASE doc_id % 4 WHEN 0 THEN 'african_american' WHEN 1 THEN 'evangelical' WHEN 2 THEN 'other_gender' ELSE 'latino' END AS bloc FROM documents)""".replace("\\\\", "\\"))
def bloc_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.expr("CASE doc_id % 4 WHEN 0 THEN ' Black / African-American ' WHEN 1 THEN 'Born-Again.Christian' WHEN 2 THEN 'NON--binary' ELSE 'Hispanic/Latino' END")
    rows = table(spark, sf_dir, "documents").select("doc_id", label.alias("label"))
    return relational.canonical_blocs(rows, "label").select("doc_id", "bloc", text.bloc_label(F.col("label")).alias("key"))


@query("SELECT page_id, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') AS title, length(regexp_replace(html, '<[^>]+>', ' ', 'g'))::BIGINT AS n FROM pages")
def html_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.html_title(F.col("html")).alias("title"), F.length(text.without_tags(F.col("html"))).cast("long").alias("n"))


@query("""
SELECT page_id, split_part(regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1), '^www\\.', ''), '.', 1) AS outlet, substring(sha256(url), 1, 16) AS key, sha1(url)[1:12] AS short FROM pages""".replace("\\\\", "\\"))
def page_outlets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.outlet_of(F.col("url")).alias("outlet"), text.short_key(F.col("url")).alias("key"), F.substring(F.sha1("url"), 1, 12).alias("short"))


@query("SELECT mean, records FROM (SELECT round(avg(m), 9) AS mean, count(*) AS records FROM (SELECT avg(abs(quality - (n_chars % 100) / 100.0)) AS m FROM documents JOIN labels USING (doc_id) GROUP BY source))")
def mae_two_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    out = aggregates.two_level_mean(rows, ["source"], F.abs(F.col("quality") - (F.col("n_chars") % 100) / 100.0))
    return out.select(F.round("mean", 9).alias("mean"), "records")


@query("""
SELECT source, round(avg((sign_p = sign_t)::INT), 9) AS accuracy
FROM (SELECT source, CASE WHEN p > 0.005 THEN 1 WHEN p < -0.005 THEN -1 ELSE 0 END AS sign_p, CASE WHEN quality = 1 THEN 1 ELSE -1 END AS sign_t
      FROM (SELECT source, quality, (n_chars % 100) / 100.0 - 0.3 AS p FROM documents JOIN labels USING (doc_id))) GROUP BY 1""")
def direction_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    p = (F.col("n_chars") % 100).cast("int").cast("decimal(10,2)") / 100 - F.lit(0.3).cast("decimal(3,1)")
    right = scalars.direction(p.cast("double")) == F.when(F.col("quality") == 1, 1).otherwise(-1)
    return rows.groupBy("source").agg(F.round(F.avg(right.cast("int")), 9).alias("accuracy"))


@query("SELECT lang, count(*) AS n, count(*) FILTER (WHERE source = 'src0') AS src0, rank() OVER (ORDER BY count(*) DESC, lang) AS place FROM documents GROUP BY 1")
def top_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("source") == "src0", 1)).alias("src0"))
    return n.withColumn("place", F.rank().over(Window.orderBy(F.desc("n"), "lang")).cast("long"))  # one row a language


@query("SELECT conv_id, turn, coalesce(nullif(trim(role), ''), 'unknown') AS author, first(text) OVER (PARTITION BY conv_id ORDER BY turn) = text AS opening FROM conversations")
def thread_openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    first = rows.groupBy("conv_id").agg(F.min_by("text", "turn").alias("first"))
    author = F.coalesce(text.first_filled(F.col("role")), F.lit("unknown"))
    return rows.join(first, "conv_id").select("conv_id", "turn", author.alias("author"), (F.col("first") == F.col("text")).alias("opening"))


@query("SELECT d.doc_id FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def blocklist_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.without_listed(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id"))


@query("SELECT DISTINCT doc_id FROM documents SEMI JOIN labels USING (doc_id)")
def seen_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left_semi").distinct()


@query("""
WITH n AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1)
SELECT lang, greatest(1, round_even(n * 0.8, 0))::BIGINT AS train, n - greatest(1, round_even(n * 0.8, 0))::BIGINT AS test FROM n""")
def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = sampling.stratified_split(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", 0.8, seed=7)
    return split.groupBy("lang").agg(F.count(F.when(F.col("train"), 1)).alias("train"), F.count(F.when(~F.col("train"), 1)).alias("test"))


@query()
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.stratified_split(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", 0.8, seed=7)


_TIERS = "CASE WHEN source IN ('src0', 'src1') THEN 'outlet_proxy' WHEN " + " OR ".join(f"contains(lower(text), '{k}')" for _, k, _, _ in LEXICON) + " THEN 'keyword' WHEN lang IN ('es', 'fr') THEN 'language_prior' END"


@query(f"SELECT doc_id, {_TIERS} AS method FROM documents")
def author_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexicon = spark.createDataFrame(LEXICON, "stratum string, keyword string, bloc string, weight double")
    proxies = spark.createDataFrame([("src0", {"white": 1.0}), ("src1", {"asian": 1.0})], "outlet string, weights map<string,double>")
    priors = spark.createDataFrame([("es", {"latino": 0.8}), ("fr", {"white": 0.5})], "lang string, weights map<string,double>")
    out = authors.classified(table(spark, sf_dir, "documents"), "doc_id", F.col("text"), F.col("source"), F.col("lang"), lexicon, proxies, priors)
    return out.select("doc_id", "method")


@query(f"""
WITH hits AS (SELECT doc_id, stratum, bloc, sum(weight) AS w FROM documents JOIN (VALUES {_LEX}) l(stratum, keyword, bloc, weight) ON contains(lower(text), keyword) GROUP BY ALL),
s AS (SELECT doc_id, bloc, (w / sum(w) OVER (PARTITION BY doc_id, stratum))::DOUBLE AS w FROM hits)
SELECT doc_id, arg_min(bloc, {{'w': round(-w, 12), 'b': bloc}}) AS bloc FROM s GROUP BY 1 HAVING max(round(w, 12)) >= 0.55""")
def bio_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexicon = spark.createDataFrame(LEXICON, "stratum string, keyword string, bloc string, weight double")
    weights = authors.keyword_weights(table(spark, sf_dir, "documents"), "doc_id", F.col("text"), lexicon)
    rounded = weights.withColumn("weights", F.transform_values("weights", lambda k, v: F.round(v, 12)))
    return authors.labelled(rounded).where("bloc IS NOT NULL").select("doc_id", "bloc")


@query("""
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'mod_neg' WHEN 1 THEN 'mild_pos' ELSE 'neutral' END AS white, CASE doc_id % 3 WHEN 0 THEN 'neutral' WHEN 1 THEN 'strong_pos' ELSE 'neutral' END AS latino FROM documents""")
def parsed_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.expr("""CASE doc_id % 3 WHEN 0 THEN 'Answer: {"white": "mod_neg", "latino": "no bin"} ' || lang WHEN 1 THEN 'white: mild_pos; latino = strong_pos' ELSE substring(text, 1, 20) END""")
    bins = records.parsed_bins(said)
    rows = table(spark, sf_dir, "documents")
    return rows.select("doc_id", *[F.element_at(bins, F.lit(b)).alias(b) for b in ("white", "latino")])


@query("""
SELECT doc_id, concat_ws('; ', CASE WHEN d IS NULL THEN 'delta missing' END, CASE WHEN abs(d) > 0.15 THEN 'delta out of range' END,
  CASE WHEN i NOT BETWEEN 0.8 AND 1.2 THEN 'intensity out of range' END, CASE WHEN lang <> 'en' THEN 'unknown bin' END) AS errors,
  CASE WHEN doc_id % 4 = 0 THEN 'eval' ELSE 'train' END AS split, CASE source WHEN 'src0' THEN 1.5 WHEN 'src1' THEN 1.0 ELSE 0.5 END::DOUBLE AS weight
FROM (SELECT doc_id, lang, source, CASE WHEN doc_id % 5 > 0 THEN (n_chars % 40) / 100.0::DOUBLE - 0.2 END AS d, (n_chars % 7) / 10.0::DOUBLE + 0.7 AS i FROM documents)""")
def record_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    delta = F.expr("CASE WHEN doc_id % 5 > 0 THEN (n_chars % 40) / 100.0D - 0.2D END")
    wrong = records.errors(delta, F.expr("(n_chars % 7) / 10.0D + 0.7D"), F.when(F.col("lang") == "en", "neutral").otherwise("none"))
    year = F.when(F.col("doc_id") % 4 == 0, 2020).otherwise(2016)
    origin = F.when(F.col("source") == "src0", "observed").when(F.col("source") == "src1", "reviewed")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.array_join(wrong, "; ").alias("errors"), records.split(year).alias("split"), records.record_weight(origin).alias("weight")
    )


@query("""
WITH p AS (SELECT source, documents.doc_id, quality FROM documents JOIN labels ON documents.doc_id = labels.doc_id WHERE quality IS NOT NULL)
SELECT d.doc_id, p.quality AS quality, d.doc_id - p.doc_id AS gap FROM documents d ASOF LEFT JOIN p ON d.source = p.source AND d.doc_id >= p.doc_id""")
def last_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last verdict on a document of the same source at or before each document, ids standing for time: an as-of join with a hot source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    verdicts = docs.join(table(spark, sf_dir, "labels"), "doc_id").select("source", F.col("doc_id").alias("t"), "quality")
    found = ordered.as_of(verdicts, docs, ["source"], "t", "quality", "doc_id")
    return found.select("doc_id", F.col("found").alias("quality"), (F.col("doc_id") - F.col("found_at")).alias("gap"))


@query("""
SELECT source, lang, count(n_chars) AS n, round(avg(n_chars), 6) AS mean, round(stddev_samp(n_chars), 6) AS std, min(n_chars) AS min, round(quantile_cont(n_chars, 0.25), 6) AS q25,
       round(quantile_cont(n_chars, 0.75), 6) AS q75, max(n_chars) AS max FROM documents GROUP BY ALL""")
def length_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary of the documents' lengths by source and language, with exact quartiles."""
    out = aggregates.summary(table(spark, sf_dir, "documents"), ["source", "lang"], "n_chars")
    return out.select("source", "lang", "n", *[F.round(c, 6).alias(c) for c in ("mean", "std")], "min", *[F.round(c, 6).alias(c) for c in ("q25", "q75")], "max")


@query()
def html_article(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", html.article_text(F.col("html")).alias("article"))
    return rows.select("page_id", text.word_count(F.col("article")).alias("n_words"), text.short_key(F.col("article")).alias("key"))


@query("SELECT source, year, n, rank() OVER (PARTITION BY year ORDER BY n DESC, source) AS place FROM (SELECT source, doc_id % 3 AS year, count(*) AS n FROM documents WHERE regexp_matches(lower(text), 'eaux|lich') OR source IN ('src3', 'src4') GROUP BY ALL) QUALIFY place <= 5")
def relevant_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources by number of relevant posts (a keyword, or a listed source), the first five of each part."""
    kept = table(spark, sf_dir, "documents").where(text.holds_any(F.col("text"), ["eaux", "lich"]) | F.col("source").isin("src3", "src4"))
    n = kept.groupBy("source", (F.col("doc_id") % 3).alias("year")).agg(F.count(F.lit(1)).alias("n"))
    place = F.rank().over(Window.partitionBy("year").orderBy(F.desc("n"), "source"))  # sources are few
    return n.withColumn("place", place.cast("long")).where("place <= 5")
