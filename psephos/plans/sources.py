"""Queries of readers, survey decoding and author defaults, over records that are derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from psephos.functions import html, records, scalars
from psephos.operators import aggregates, authors
from psephos.plans.registry import query, table
from psephos.sources import platforms, polls, readers, surveys


@query("""
WITH s AS (SELECT lang, source, quality FROM documents JOIN labels USING (doc_id) WHERE lang IS NOT NULL),
m AS (SELECT lang, source, avg(quality) AS q FROM s GROUP BY ALL)
SELECT k.lang, p.source, round(coalesce(q, 0), 9)::DOUBLE AS quality FROM (SELECT DISTINCT lang FROM s) k
CROSS JOIN (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL) p LEFT JOIN m ON m.lang = k.lang AND m.source = p.source""")
def platform_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean quality of each language's documents on each platform; 0 where a platform has none."""
    docs = table(spark, sf_dir, "documents").where("lang IS NOT NULL").select("doc_id", "lang", "source")
    rows = docs.join(table(spark, sf_dir, "labels"), "doc_id").select("lang", "source", F.col("quality").cast("double").alias("quality"))
    platforms = table(spark, sf_dir, "documents").where("source IS NOT NULL").select("source").distinct()
    return aggregates.group_means(rows, ["lang"], platforms, "source", "quality").select("lang", "source", F.round("quality", 9).alias("quality"))


@query("""
SELECT unnest(['good', 'poor', 'toxic', 'clean', 'poor_toxic']) AS name, unnest([count(*) FILTER (WHERE quality = 1), count(*) FILTER (WHERE quality = 0),
  count(*) FILTER (WHERE toxic = 1), count(*) FILTER (WHERE toxic = 0), count(*) FILTER (WHERE quality = 0 AND toxic = 1)])::BIGINT AS n FROM labels""")
def class_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each verdict, a row may be in several."""
    q, t = F.col("quality"), F.col("toxic")
    return aggregates.class_counts(table(spark, sf_dir, "labels"), {"good": q == 1, "poor": q == 0, "toxic": t == 1, "clean": t == 0, "poor_toxic": (q == 0) & (t == 1)})


@query("SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1 HAVING count(*) >= 10")
def class_minimum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes with enough rows to train on."""
    return aggregates.frequent_classes(table(spark, sf_dir, "documents"), "source", 10)


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 AND c_custkey % 7 <> 0 THEN c_acctbal END AS white, CASE WHEN c_custkey % 5 <> 0 AND c_custkey % 7 <> 0 THEN c_nationkey END::DOUBLE AS women FROM customer""")
def outlet_proxies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readers' weights from descriptions in JSON; every fifth has none, every seventh is cut short."""
    whole = F.to_json(F.struct(F.col("c_name").alias("outlet"), F.when(F.col("c_custkey") % 5 != 0, F.struct(
        F.struct(F.col("c_acctbal").alias("white")).alias("race"), F.struct(F.col("c_nationkey").alias("women")).alias("gender"))).alias("proxy")))
    said = F.when(F.col("c_custkey") % 7 == 0, F.substring(whole, F.lit(1), F.length(whole) - 1)).otherwise(whole)
    weights = readers.outlet_proxy(said)
    return table(spark, sf_dir, "customer").select("c_custkey", weights["white"].alias("white"), weights["women"].alias("women"))


@query("SELECT conv_id, turn, concat_ws('|', role, text, text, role) AS leaves FROM conversations")
def json_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All strings of a nested record, whole texts with their escapes; keys and numbers are none."""
    deep = F.struct(F.array_compact(F.array("text")).alias("parts"), F.struct("turn", "role").alias("of"))
    record = F.to_json(F.struct("role", "text", deep.alias("more")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(readers.json_strings(record), "|").alias("leaves"))


@query("""
SELECT strftime(unnest(generate_series(date_trunc('month', o_orderdate::DATE - 33), date_trunc('month', o_orderdate::DATE + 14), INTERVAL 1 MONTH)), '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1""")
def month_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many windows touch each month: what a month-pruned scan opens."""
    days = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("day"))
    return days.select(F.explode(readers.months("day", "day", before=33, after=14)).alias("m")).groupBy(F.date_format("m", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT o_orderkey, strftime(first, '%Y-%m-%d') AS first_day, strftime(d + 14, '%Y-%m-%d') AS last_day, strftime(d + 44, '%Y-%m-%d') AS cutoff
FROM (SELECT o_orderkey, o_orderdate::DATE AS d, o_orderdate::DATE - CASE WHEN o_orderstatus = 'F' THEN 10 ELSE 3 END AS first FROM orders)""")
def shock_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The window and cut-off of each day; some bring their own first day."""
    day = F.col("o_orderdate").cast("date")
    span = readers.span_of(day, 3, 14, start=F.when(F.col("o_orderstatus") == "F", F.date_sub(day, 10)))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", span.alias("s"))
    return rows.select("o_orderkey", *[F.date_format(f"s.{a}", "yyyy-MM-dd").alias(b) for a, b in (("start", "first_day"), ("end", "last_day"), ("cutoff", "cutoff"))])


@query("""
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'keyword' WHEN source = 'src0' OR source = 'src1' THEN 'platform' END AS method,
  CASE WHEN doc_id % 3 = 0 THEN n_chars WHEN source = 'src0' THEN 0.25 WHEN source = 'src1' THEN 0.75 END::DOUBLE AS weight FROM documents""")
def platform_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authors of whom nothing is known get the weights of their platform; case doesn't count."""
    known = F.col("doc_id") % 3 == 0
    rows = table(spark, sf_dir, "documents").select("doc_id", F.upper("source").alias("platform"), F.when(known, "keyword").alias("method"), F.when(known, F.create_map(F.lit("white"), F.col("n_chars").cast("double"))).alias("weights"))
    defaults = spark.createDataFrame([("src0", {"white": 0.25}), ("Src1", {"white": 0.75})], "platform string, weights map<string,double>")
    return authors.with_platform(rows, F.col("platform"), defaults).select("doc_id", "method", F.col("weights")["white"].alias("weight"))


@query("""
WITH r AS (SELECT 2016 + 2 * (c_custkey % 3) AS cycle, abs(c_acctbal) + 1 AS w,
  CASE c_nationkey % 4 WHEN 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'evangelical' ELSE 'protestant' END WHEN 1 THEN CASE WHEN c_custkey % 2 = 0 THEN 'evangelical' END WHEN 2 THEN 'catholic' END AS religion,
  CASE WHEN c_mktsegment < 'F' THEN 'women' ELSE 'men' END AS gender, CASE c_custkey % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 WHEN 2 THEN 0.0 WHEN 4 THEN 1.0 END::DOUBLE AS dem FROM customer),
b AS (SELECT cycle, w, dem, religion AS bloc FROM r UNION ALL SELECT cycle, w, dem, gender FROM r),
s AS (SELECT cycle, bloc, sum(w * dem) / sum(w) AS p, greatest(sum(w) * sum(w) / sum(w * w), 1) AS n FROM b WHERE bloc IS NOT NULL AND dem IS NOT NULL AND cycle % 4 = 0 GROUP BY ALL)
SELECT cycle::INT AS cycle, bloc, round(p, 9) AS vote_share, round(sqrt(p * (1 - p) / n), 9) AS se FROM s""")
def survey_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted cells of a survey: votes decoded, born-again Protestants split off, presidential cycles only."""
    k = F.col("c_custkey")
    religion = F.element_at(F.array(*map(F.lit, ["Protestant", " Protestant ", "Roman Catholic", "No answer"])), (F.col("c_nationkey") % 4 + 1).cast("int"))
    votes = F.element_at(F.array(F.lit("Democratic"), F.lit("Republican"), F.lit("Did not say"), F.lit("  "), F.lit(" DEMOCRATIC ")), (k % 5 + 1).cast("int"))
    rows = table(spark, sf_dir, "customer").select(
        (2016 + 2 * (k % 3)).alias("cycle"), (F.abs("c_acctbal") + 1).alias("weight"), religion.alias("bloc__religion"), F.when(k % 2 == 0, " YES").otherwise("No").alias("relig_bornagain"),
        F.when(F.col("c_mktsegment") < "F", "Female").otherwise("Male").alias("bloc__gender"), votes.alias("vote_indicator"),
    )
    return surveys.cells(rows, "CES").select("cycle", "bloc", F.round("vote_share", 9).alias("vote_share"), F.round("se", 9).alias("se"))


@query("""
SELECT 'documents' AS platform, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents WHERE text <> '' UNION ALL
SELECT 'conversations', count(*), sum(length(text))::BIGINT FROM conversations WHERE text <> '' AND turn % 3 <> 1""")
def merged_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of two platforms in one table, one in envelopes and the other bare with broken lines between."""
    enveloped = table(spark, sf_dir, "documents").select(F.lit("documents").alias("platform"), F.to_json(F.struct(F.lit(1).alias("version"), F.struct("doc_id", "text").alias("payload"))).alias("value"))
    bare = F.to_json(F.struct("conv_id", "turn", "text"))
    lines = enveloped.unionByName(table(spark, sf_dir, "conversations").select(F.lit("conversations").alias("platform"), F.when(F.col("turn") % 3 == 1, F.substring(bare, F.lit(1), F.length(bare) - 1)).otherwise(bare).alias("value")))
    return readers.merged(lines, "platform").groupBy("platform").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query("""
WITH c AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS a, count(*) FILTER (WHERE event_type = 'click') AS b, count(*) FILTER (WHERE event_type = 'error') AS e, count(*) FILTER (WHERE event_type = 'purchase') AS p FROM events GROUP BY 1),
s AS (SELECT user_id, a * 1.0::DOUBLE + b * 1.5::DOUBLE + p * 0.5::DOUBLE AS up, e * 1.5::DOUBLE AS down FROM c)
SELECT user_id, round(CASE WHEN up + down = 0 THEN 0 ELSE (up - down) / (up + down) END, 9)::DOUBLE AS valence FROM s""")
def reaction_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted balance of a user's reactions; event types stand for reactions, and two of the six have no counts."""
    stands = {"LIKE": "view", "LOVE": "click", "WOW": "purchase", "ANGRY": "error"}
    counts = table(spark, sf_dir, "events").groupBy("user_id").agg(*[F.count_if(F.col("event_type") == t).alias(k) for k, t in stands.items()])
    return counts.select("user_id", F.round(scalars.reaction_valence({k: F.col(k) for k in stands}), 9).alias("valence"))


@query("""
SELECT page_id FROM pages WHERE lower(regexp_extract(url, 'https?://([^/]+)', 1)) LIKE '%example.org%' AND upper(split_part(url, '/', 4)) IN ('ES', 'DE')
  AND coalesce(CASE WHEN page_id % 4 <> 0 THEN DATE '2024-01-01' + (page_id % 60)::INT END BETWEEN DATE '2024-01-10' AND DATE '2024-02-10', true)""")
def article_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of a host, some states and a span of days; every fourth has no date, which passes."""
    day = F.when(F.col("page_id") % 4 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 60).cast("int")).cast("string"))
    rows = table(spark, sf_dir, "pages").select("page_id", "url", F.lower(F.split_part("url", F.lit("/"), F.lit(4))).alias("state"), day.alias("date"))
    return readers.articles(rows, "2024-01-10", "2024-02-10", ["es", "DE"], "Example.org").select("page_id")


@query("""
WITH l AS (SELECT l_orderkey, l_linenumber, max(CASE WHEN l_linenumber % 3 = 1 THEN l_returnflag || l_linestatus END) AS h, max(l_quantity) AS q, max(CASE WHEN l_tax > 0.02 THEN l_tax * 100 END) AS t FROM lineitem GROUP BY ALL),
f AS (SELECT l_orderkey, l_linenumber, last_value(h IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS heading, q, t FROM l),
u AS (SELECT l_orderkey, l_linenumber, heading, 'quantity' AS response, q AS pct FROM f UNION ALL SELECT l_orderkey, l_linenumber, heading, 'tax', round(t, 0) FROM f WHERE t IS NOT NULL)
SELECT heading, response, count(*) AS n, round(sum(pct), 3) AS total, count(DISTINCT l_orderkey) AS tables FROM u GROUP BY ALL""")
def poll_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide tables (an order's lines), whose headings stand in some lines only, as long rows."""
    item = table(spark, sf_dir, "lineitem")
    heading = F.when(F.col("l_linenumber") % 3 == 1, F.concat("l_returnflag", "l_linestatus"))
    cells = item.groupBy("l_orderkey", "l_linenumber").agg(F.max(heading).alias("heading"), F.max("l_quantity").alias("q"), F.max(F.when(F.col("l_tax") > 0.02, F.col("l_tax") * 100)).alias("t"))
    wide = cells.select("l_orderkey", "l_linenumber", "heading", F.concat(F.col("q").cast("int"), F.lit("%")).alias("quantity"), F.coalesce(F.round("t", 0).cast("int").cast("string"), F.lit("--")).alias("tax"))
    rows = polls.long_rows(wide, "l_orderkey", "l_linenumber", ["heading"], ["quantity", "tax"])
    return rows.groupBy("heading", "response").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("pct"), 3).alias("total"), F.count_distinct("l_orderkey").alias("tables"))


@query("""
SELECT conv_id, turn, 0 AS place, role AS said FROM conversations UNION ALL SELECT conv_id, turn, 1, text FROM conversations
UNION ALL SELECT conv_id, turn, 2, text || role FROM conversations WHERE (conv_id + turn) % 3 = 0""")
def model_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of arrays in a model's answers, made of whole turns, with a fence and words around them; two of three answers are cut off within the last object."""
    item = lambda n, text: F.struct(F.col("turn").alias("turn"), F.lit(n).alias("n"), text.alias("said"))
    whole = F.to_json(F.array(item(0, F.col("role")), item(1, F.col("text")), item(2, F.concat("text", "role"))))
    part = (F.col("conv_id") + F.col("turn")) % 3
    cut = F.when(part == 0, F.concat(whole, F.lit("\n```\nThat is all."))).otherwise(F.substring(whole, F.lit(1), (F.length(whole) - 1 - part).cast("int")))
    answers = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("of"), F.concat(F.lit('Here is the "list":\n```json\n'), cut).alias("answer"))
    return records.object_rows(answers, "of", "answer", "n int, said string").select("of.*", "place", "said")


def _plain(html: str) -> str:
    """SQL for the words of a piece of a page."""
    marks = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")]
    said = f"regexp_replace({html}, '<[^>]*>', ' ', 'g')"
    for a, b in marks:
        said = f"replace({said}, '{a}', '{b}')"
    return rf"trim(regexp_replace({said}, '\s+', ' ', 'g'))"


@query(f"""
WITH p AS (SELECT page_id, regexp_extract(html, '(?s)<article>(.*)</article>', 1) AS a, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title FROM pages),
t AS (SELECT page_id, {_plain("a")} AS a, {_plain("regexp_replace(a, '(?s)^<h1>.*?</h1>', '')")} AS p, {_plain("title")} AS title FROM p)
SELECT page_id, CASE WHEN len(string_split(a, ' ')) >= 30 THEN a ELSE p END AS article, title FROM t""")
def html_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Article and title of each whole page."""
    return table(spark, sf_dir, "pages").select("page_id", html.article(F.col("html")).alias("a")).select("page_id", F.col("a.text").alias("article"), F.col("a.title").alias("title"))


_POSTS_OF = """
WITH d AS (SELECT doc_id, lang AS l, source AS s, n_chars AS n, doc_id % 6 AS k, trim(CASE doc_id % 6 WHEN 4 THEN coalesce(text, '') || ' end' ELSE text END, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM documents)
SELECT doc_id, ['reddit', 'webhose', '3dlnews', 'discord', 'telegram', 'tiktok'][k + 1] || ':' || CASE k WHEN 0 THEN 'p' || doc_id ELSE doc_id::VARCHAR END AS id, sha256(t) AS text_sha256,
  CASE WHEN k IN (1, 5) THEN coalesce(nullif(l, ''), 'en') ELSE 'en' END AS lang, ['reddit', 'news', 'news', 'discord', 'telegram', 'tiktok'][k + 1] AS platform,
  CASE k WHEN 0 THEN 'reddit:' || nullif(s, '') WHEN 3 THEN 'discord:' || n WHEN 4 THEN 'telegram:' || nullif(s, '') WHEN 5 THEN 'tiktok:' || n END AS author_did,
  CASE k WHEN 0 THEN nullif(s, '') WHEN 1 THEN coalesce(split_part(s || '.com', '.', 1), 'unknown') WHEN 2 THEN coalesce(nullif(s, ''), 'unknown') WHEN 3 THEN nullif(s, '') END AS author_handle,
  CASE k WHEN 0 THEN 1600000000 + doc_id WHEN 3 THEN 1600000000 + doc_id END AS created
FROM d WHERE t <> '' AND NOT (k = 0 AND t IN ('[deleted]', '[removed]'))"""


@query(_POSTS_OF)
def platform_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as six platforms write their posts, read back by each platform's rules in one pass."""
    j = lambda **c: F.to_json(F.struct(*[x.alias(n) for n, x in c.items()]))
    c, own = F.col, F.col("doc_id").cast("string")
    moment = (1600000000 + c("doc_id")).cast("string")
    said = [
        j(selftext=F.lit(""), body=c("text"), name=F.concat(F.lit("p"), own), created_utc=moment, author=c("source")),
        j(text=c("text"), uuid=own, thread=F.struct(F.concat(F.lit("www."), "source", F.lit(".com")).alias("site")), language=c("lang")),
        j(content=c("text"), url=own, outlet=c("source")),
        j(content=c("text"), message_id=own, author=F.struct(c("n_chars").alias("id"), c("source").alias("username")), timestamp=moment),
        j(text=F.array(F.struct(c("text").alias("text")), F.struct(F.lit("end").alias("text"))), id=c("doc_id"), **{"from": c("source")}),
        j(desc=c("text"), id=own, author=F.struct(c("n_chars").alias("uid")), textLanguage=c("lang")),
    ]
    k = F.pmod("doc_id", F.lit(6))
    value, kind = F.when(k == 0, said[0]), F.when(k == 0, "reddit")
    for i, name in enumerate(["webhose", "3dlnews", "discord", "telegram", "tiktok"], 1):
        value, kind = value.when(k == i, said[i]), kind.when(k == i, name)
    lines = table(spark, sf_dir, "documents").select("doc_id", kind.alias("kind"), value.alias("value"))
    posts = platforms.platform_posts(readers.unwrapped(lines, "doc_id", "kind"), F.col("kind"), None, None, "doc_id")
    return posts.select("doc_id", "id", F.sha2("text", 256).alias("text_sha256"), "lang", "platform", "author_did", "author_handle", F.unix_seconds("created_at").alias("created"))
