"""Month tables that are opened in part, sinks that may run again, ids over runs, kept scores."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from psephos.sources import archives, readers
from psephos.streaming import sinks

DAY = dt.datetime(2024, 1, 1)


def files_opened(df):
    """Files that the scans of a collected query have opened, by Spark's own metric."""
    found = 0

    def walk(node):
        nonlocal found
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(node.plan())
        metrics = node.metrics()
        if metrics.contains("numFiles"):
            found += metrics.apply("numFiles").value()
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return found


@pytest.fixture(scope="module")
def months(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('months')}/posts"
    rows = [(i, DAY + dt.timedelta(days=i, hours=i % 24), "x") for i in range(720)] + [(9000, None, "x"), (3, DAY + dt.timedelta(days=3), "repeat")]
    archives.write_months(spark.createDataFrame(rows, "id int, at timestamp, first string"), path, "at")
    return path, rows


def test_only_the_months_of_spans_are_opened(spark, months, tmp_path):
    path, rows = months
    spans = [("a", dt.date(2024, 2, 10), None, None), ("b", dt.date(2025, 6, 30), None, None), ("c", dt.date(2024, 2, 20), None, dt.date(2024, 2, 1)), ("d", None, None, None), ("e", dt.date(2024, 8, 1), dt.date(2024, 8, 1), dt.date(2024, 8, 1))]
    spark.createDataFrame(spans, "shock string, day date, begins date, ends date").write.parquet(f"file://{tmp_path}/spans")
    table = archives.spans_of(spark.read.parquet(f"file://{tmp_path}/spans"), "day", 3, 14, start="begins", end="ends")
    assert spark.read.parquet(path).count() == len(rows)
    df = archives.in_spans(spark, renamed(spark, path), table, "at")
    got = sorted((r.shock, r.id, r.text) for r in df.select("shock", "id", "text").collect())
    want = []
    for s, day, begins, ends in spans:
        first, last = begins or (day and day - dt.timedelta(3)), ends or (day and day + dt.timedelta(14))
        want += [(s, i, t) for i, at, t in rows if at and first and first <= at.date() <= last]
    assert got == sorted(want) and got
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan and re.search(r"PushedFilters: \[[^\]]*at", plan)
    assert files_opened(df) <= 4 < files_opened_of(spark, path)  # February 2024, June and July 2025, August 2024
    one_side = archives.in_spans(spark, renamed(spark, path), table.limit(0), "at")
    assert one_side.count() == 0


def renamed(spark, path):
    """The same table without a column that clashes with a span's."""
    out = path + "-renamed"
    spark.read.parquet(path).withColumnRenamed("first", "text").write.mode("overwrite").partitionBy("month").parquet(out)
    return out


def files_opened_of(spark, path):
    df = spark.read.parquet(path)
    df.collect()
    return files_opened(df)


def test_appending_again_adds_nothing(spark, tmp_path):
    at = f"file://{tmp_path}"
    inbox = spark.createDataFrame([(i, f"text {i}" if i % 4 else None) for i in range(20)], "id int, text string")
    inbox.where("id < 12").write.mode("append").parquet(f"{at}/in")
    stream = lambda: spark.readStream.schema(inbox.schema).parquet(f"{at}/in")
    run = lambda: sinks.append_posts(stream(), f"{at}/out", f"{at}/check", "social", 7, "now")
    assert (run(), run()) == (12, 0)
    first = sorted(r.value for r in spark.read.text(f"{at}/out").collect())
    assert len(first) == 12 and '"payload":{"id":1,"text":"text 1"}' in first[1]
    # the batch runs again, as after a crash before its commit
    write = sinks.keyed(lambda b: sinks.sinks.enveloped(b, "social", 7, "now"), f"{at}/out")
    write(inbox.where("id < 12"), 0)
    write(inbox.where("id < 12"), 0)
    assert sorted(r.value for r in spark.read.text(f"{at}/out").collect()) == first
    inbox.where("id >= 12").write.mode("append").parquet(f"{at}/in")
    assert (run(), run()) == (8, 0)
    assert {r.batch: r.n for r in sinks.counts(spark, f"{at}/out", ["batch"]).collect()} == {0: 12, 1: 8}
    assert readers.json_lines(spark, f"{at}/out").count() == 20


def test_merging_again_adds_nothing(spark, tmp_path):
    at = f"file://{tmp_path}"
    lines = [("s1", "reddit", '{"payload": {"text": "a"}}'), ("s1", "x", '{"text": "b"}'), ("s2", "x", '{"text": ""}'), ("s2", "x", "broken"), ("s2", "x", '{"text": "c"}'), ("s2", "x", None)]
    table = spark.createDataFrame(lines, "shock_id string, platform string, value string")
    table.write.parquet(f"{at}/in")
    for want in (6, 0):
        assert sinks.merge_posts(spark.readStream.schema(table.schema).parquet(f"{at}/in"), f"{at}/out", f"{at}/check") == want
        assert {(r.shock, r.platform): r.n for r in sinks.counts(spark, f"{at}/out", ["shock", "platform"]).collect()} == {("s1", "reddit"): 1, ("s1", "x"): 1, ("s2", "x"): 1}
    assert spark.read.text(f"{at}/out/shock=s1/platform=reddit").where("value LIKE '%payload%'").count() == 0


def test_ids_are_seen_over_runs_and_forgotten(spark, tmp_path):
    at = f"file://{tmp_path}"
    schema = "id int, at timestamp"

    def run(rows):
        spark.createDataFrame([(i, DAY + dt.timedelta(days=d)) for i, d in rows], schema).write.mode("append").parquet(f"{at}/in")
        stream = sinks.unseen(spark.readStream.schema(schema).parquet(f"{at}/in"), ["id"], "at", "3 days")
        out = []
        sinks.run_batches(stream, lambda b, n: out.extend(r.id for r in b.collect()), f"{at}/check")
        return sorted(out)

    assert run([(1, 0), (2, 0), (2, 1)]) == [1, 2]
    assert run([(1, 2), (3, 2), (2, 2)]) == [3]  # seen in the run before
    assert run([(4, 30)]) == [4]  # the time moves on, and the state is let go
    assert run([(1, 31), (4, 31), (5, 3)]) == [1]  # forgotten: comes again; 4 is known; 5 is too late


def test_scores_are_kept_over_runs(spark, tmp_path):
    at, made = f"file://{tmp_path}/cache", []

    def score(rows):
        made.append(rows.count())
        return rows.select("id", F.col("id") * 0.5).toDF("id", "score")

    rows = lambda *ids: spark.createDataFrame([(i, "t") for i in ids], "id int, text string")
    first = sinks.kept_scores(rows(1, 2, 2, None), "id", at, "r1", score)
    assert sorted((r.id or 0, r.score, r.hit) for r in first.select("id", F.coalesce("score", F.lit(0.0)).alias("score"), "hit").collect()) == [(0, 0.0, False), (1, 0.5, False), (2, 1.0, False), (2, 1.0, False)]
    second = sinks.kept_scores(rows(2, 3), "id", at, "r2", score)
    assert sorted(tuple(r) for r in second.collect()) == [(2, 1.0, True), (3, 1.5, False)] and sinks.hit_rate(second) == 0.5
    again = sinks.kept_scores(rows(2, 3), "id", at, "r2", score)
    assert sorted(tuple(r) for r in again.collect()) == [(2, 1.0, True), (3, 1.5, False)]
    assert spark.read.parquet(at).count() == 3 and sinks.hit_rate(first.limit(0)) == 0
