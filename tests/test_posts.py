"""Records of several platforms and weighted reactions."""

from pyspark.sql import functions as F

from psephos.functions import scalars
from psephos.operators import aggregates
from psephos.sources import readers


def test_merged_unwraps_and_drops(spark):
    lines = [("a", '{"payload": {"id": "1", "text": "one"}}'), ("a", "  "), ("a", '{"payload": {"id": "2", "text": ""}}'), ("b", '{"text": "two", "n": 3}'), ("b", '{"text": "cut'), ("b", '{"n": 4}'), ("b", None), (None, '{"text": "two", "n": 3}')]
    got = readers.merged(spark.createDataFrame(lines, "platform string, value string"), "platform").collect()
    assert sorted((r.platform or "", r.text) for r in got) == [("", "two"), ("a", "one"), ("b", "two")]
    assert {r.text: r.payload for r in got} == {"one": '{"id":"1","text":"one"}', "two": '{"n":3,"text":"two"}'}


def test_merged_of_nothing(spark):
    assert readers.merged(spark.createDataFrame([], "value string")).count() == 0


def test_reaction_valence(spark):
    rows = spark.createDataFrame([(2, 1, 2), (0, 0, 0), (None, None, 1), (4, 0, None)], "up int, love int, angry int")
    counts = {"LIKE": F.col("up"), "LOVE": F.col("love"), "ANGRY": F.col("angry")}
    got = [r.v for r in rows.select(scalars.reaction_valence(counts).alias("v")).collect()]
    assert [round(v, 9) for v in got] == [round((3.5 - 3) / 6.5, 9), 0.0, -1.0, 1.0]


def test_frequent_classes(spark):
    rows = spark.createDataFrame([("x",), ("x",), ("y",), (None,), (None,)], "c string")
    assert [tuple(r) for r in aggregates.frequent_classes(rows, "c", 2).collect()] == [("x", 2)]
    assert aggregates.frequent_classes(rows.limit(0), "c", 1).count() == 0
