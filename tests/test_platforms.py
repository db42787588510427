import json
from datetime import datetime

from psephos.sources import platforms
from pyspark.sql import functions as F

CASES = [
    ("reddit", {"selftext": "", "body": " Said here ", "name": "t3_a", "created_utc": 1600000000, "author": "ann"}, ("reddit:t3_a", "Said here", 1600000000, "en", "reddit", "reddit:ann", "ann", None)),
    ("reddit", {"selftext": "[removed]", "title": "Title"}, None),
    ("reddit", {"body": 5, "title": "Title"}, None),
    ("webhose", {"text": "News", "uuid": "u1", "published": "2020-09-13T12:26:40", "thread": {"site": "www.paper.com"}, "language": "de"}, ("webhose:u1", "News", 1600000000, "de", "news", None, "paper", '{"outlet":"paper"}')),
    ("webhose", {"title": "News", "id": 7}, ("webhose:7", "News", None, "en", "news", None, "unknown", '{"outlet":"unknown"}')),
    ("3dlnews", {"article_text": "Local", "url": "http://a.b/c", "domain": "a.b", "date": "2020-09-13"}, ("3dlnews:http://a.b/c", "Local", 1599955200, "en", "news", None, "a.b", '{"outlet":"a.b"}')),
    ("discord", {"content": "Hi", "message_id": "9", "author": {"id": "3", "username": "bo"}}, ("discord:9", "Hi", None, "en", "discord", "discord:3", "bo", None)),
    ("discord", {"content": "Hi", "id": "9", "author": "bo"}, ("discord:9", "Hi", None, "en", "discord", None, None, None)),
    ("telegram", {"text": ["a", {"text": "b", "type": "bold"}, {"type": "x"}, "c"], "id": 4, "date_unixtime": "1600000000", "from": "user7"}, ("telegram:4", "a b  c", 1600000000, "en", "telegram", "telegram:user7", None, None)),
    ("telegram", {"message": "m", "id": 5, "from": {"id": 8, "first_name": "Cy"}, "from_id": "z"}, ("telegram:5", "m", None, "en", "telegram", "telegram:8", "Cy", None)),
    ("tiktok", {"desc": "d", "id": "6", "createTime": 1600000000000, "author": {"uid": "2", "nickname": "Di"}, "textLanguage": "es"}, ("tiktok:6", "d", 1600000000, "es", "tiktok", "tiktok:2", "Di", None)),
    ("tiktok", {"desc": None, "title": "   "}, None),
    ("other", {"text": "x"}, None),
]


def posts_of(spark, cases, **given):
    rows = spark.createDataFrame([(i, k, json.dumps(v)) for i, (k, v, _) in enumerate(cases)], "n int, kind string, value string")
    return platforms.platform_posts(rows.select("n", "kind", F.try_parse_json("value").alias("body")), F.col("kind"), None, given.get("keywords"), "n")


def test_each_platforms_names(spark):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    got = {r.n: r for r in posts_of(spark, CASES).withColumn("at", F.unix_seconds("created_at")).collect()}
    seen = {n: (r.id, r.text, r["at"], r.lang, r.platform, r.author_did, r.author_handle, r.author_description) for n, r in got.items()}
    assert seen == {n: want for n, (_, _, want) in enumerate(CASES) if want}
    assert {r.inference_method for r in got.values() if r.platform == "reddit"} == {"subreddit_proxy"}
    assert {r.archive_id for r in got.values() if r.platform == "news"} == {"webhose", "3dlnews"}


def test_missing_ids_and_topics(spark):
    same = [("tiktok", {"desc": "gas prices and votes"}, None), ("tiktok", {"desc": "gas prices and votes", "id": ""}, None), ("tiktok", {"desc": "else"}, None)]
    words = spark.createDataFrame([("b", "votes"), ("a", "PRICES")], "topic string, keyword string")
    got = sorted(posts_of(spark, same, keywords=words).collect(), key=lambda r: r.n)
    assert got[0].id == got[1].id != got[2].id and [r.shock_id for r in got] == ["a", "a", None]


def test_folders_of_archives(spark, tmp_path):
    def put(name, said):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(said)

    put("reddit/politics/a.jsonl", '{"body": "One", "id": "1", "created_utc": 1600000000, "author": "x"}\nno json\n\n{"payload": {"body": "Two", "id": "2", "author": "y"}}\n')
    put("reddit/politics/sub/b.jsonl", '{"body": "Three", "id": "3", "created_utc": 1000000000, "author": "z"}\n')
    put("telegram/chan/rows.csv", 'message_id,content,date,language,from_id,post_author,toxicity\n1,"said, twice",2020-09-13,,5,Ann,0.25\n2,,2020-09-13,,5,Ann,\n3,more,,fr,,,x\n')
    put("telegram/politics/late.jsonl", '{"message": "never"}\n')
    put("flat/f.json", '{"desc": "flat"}\n')
    put("telegram/chan/note.txt", "left out")
    root = str(tmp_path)
    assert platforms.archive_folder(spark, root, "politics").endswith("/reddit/politics")
    assert platforms.archive_folder(spark, root, "flat").endswith("/flat") and platforms.archive_folder(spark, root, "absent") is None
    got = {r.text: r for r in platforms.load_archive(spark, root, "politics", "reddit").collect()}
    assert {t: r.archive_id for t, r in got.items()} == {"One": "reddit_a", "Two": "reddit_a", "Three": "reddit_sub"}
    near = platforms.load_archive(spark, root, "politics", "reddit", moment="2020-09-14 12:26:40", hours=24, blocked=spark.createDataFrame([("reddit:y",)], "a string"))
    assert [r.text for r in near.collect()] == ["One"]
    rows = {r.text: r for r in platforms.load_archive(spark, root, "chan", "telegram").collect()}
    assert rows.keys() == {"said, twice", "more"} and rows["more"].lang == "fr" and rows["more"].metadata is None
    one = rows["said, twice"]
    assert (one.id, one.lang, one.author_did, one.author_handle, one.metadata, one.archive_id) == ("telegram:1", "en", "telegram:5", "Ann", {"toxicity": 0.25}, "chan")
    assert one.created_at == datetime(2020, 9, 13) and platforms.load_archive(spark, root, "absent", "tiktok").count() == 0


def test_exported_messages(spark, tmp_path):
    (tmp_path / "export.json").write_text(json.dumps({"name": "c", "messages": [{"id": 1, "text": ["x", {"text": "y"}], "date": "2020-09-13T12:26:40"}, {"id": 2, "text": ""}]}, indent=1))
    got = platforms.platform_posts(platforms.exported_messages(spark, str(tmp_path)), F.lit("telegram"), F.lit("c")).collect()
    assert [(r.id, r.text, r.archive_id) for r in got] == [("telegram:1", "x y", "c")]
