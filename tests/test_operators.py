import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from psephos import dims, pipeline
from psephos.functions import scalars, text
from psephos.operators import aggregates, joins, relational, sampling, simplex
from psephos.sources import readers, sinks
from psephos.streaming import router

PANEL = "cycle int, bloc string, vote_share double, se double, source string"

POLL = """category,sub_category,sub_pct,dem_candidate,rep_candidate,dem_pct,rep_pct,n_total
Race,White,67,a,b,41,58,15590
Race,Black,13,a,b,87,12,15590
Race,Hispanic/Latino,13,a,b,65,32,15590
Race,Asian,4,a,b,61,34,15590
Race,All Others,4,a,b,55,41,15590
Religion,Catholic,25,a,b,52,47,15590
Religion,Other religion,8,a,b,68,29,15590
White evangelical or born-again?,Yes,28,a,b,24,76,15590
Gender,Women,52,a,b,57,42,15590
Gender,Men,48,a,b,45,53,15590
Age,18-29,17,a,b,60,36,15590
"""


def test_inverse_se_merge_edges(spark):
    rows = [(2020, "a", 0.6, 0.1, "x"), (2020, "a", 0.5, 0.2, "y"), (2020, "b", None, 0.1, "x"), (2020, "c", 0.4, None, "x"), (2020, "c", None, 0.1, "y"), (2020, "d", 0.2, 0.0, "x"), (2020, "d", 0.4, None, "y")]
    got = {r.bloc: r for r in aggregates.inverse_se_merge(spark.createDataFrame(rows, PANEL)).collect()}
    assert set(got) == {"a", "c", "d"}
    assert got["a"].vote_share == pytest.approx((0.6 * 10 + 0.5 * 5) / 15) and got["a"].source == "x+y"
    assert got["c"].vote_share == 0.4 and got["c"].se is None and got["d"].vote_share == pytest.approx(0.3)


def test_kish_null_weight(spark):
    rows = spark.createDataFrame([(1, 1.0, None), (1, 0.0, 1.0), (1, None, 5.0), (1, 1.0, 2.0)], "k int, hit double, w double")
    r = aggregates.kish_share(rows, ["k"], F.col("hit"), F.col("w")).first()
    assert r.vote_share == pytest.approx(0.75) and r.se == pytest.approx((0.75 * 0.25 / (16 / 6)) ** 0.5)


def test_exit_polls_to_panel(spark, tmp_path):
    (tmp_path / "nep_2020_exit_poll.csv").write_text(POLL)
    polls = readers.exit_polls(spark, f"file://{tmp_path}")
    cells = readers.exit_poll_panel(polls)
    panel = pipeline.build_panel(cells)
    strata = panel.join(dims.blocs(spark), "bloc").groupBy("stratum").count().collect()
    assert {r.stratum: r["count"] for r in strata} == {"race": 5, "religion": 3, "gender": 7}
    assert {r.cycle for r in panel.where("source LIKE 'imputed%'").collect()} == {2004, 2008, 2012, 2020, 2024}
    sinks.write_panel(panel, f"file://{tmp_path}/panel")
    assert spark.read.parquet(f"file://{tmp_path}/panel").where("stratum = 'race'").count() == 5
    (tmp_path / "other").mkdir()
    (tmp_path / "other/poll.csv").write_text(POLL)
    with pytest.raises(Exception, match="no cycle"):
        readers.exit_polls(spark, f"file://{tmp_path}/other").select("cycle").collect()


def test_panel_csv(spark, tmp_path):
    (tmp_path / "p.csv").write_text("cycle,stratum,bloc,vote_share,turnout,source\n2020.0,race,white,0.4,high,NEP\nNA,race,asian,NaN,,NEP\n")
    a, b = readers.panel_csv(spark, f"file://{tmp_path}/p.csv").collect()
    assert (a.cycle, a.vote_share, a.turnout) == (2020, 0.4, None) and (b.cycle, b.vote_share) == (None, None)


def test_labels_strict_and_lenient(spark):
    rows = spark.createDataFrame([("Black / African-American",), ("other",), (None,)], "label string")
    assert [r.bloc for r in relational.canonical_blocs(rows, "label", strict=False).collect()] == ["african_american"]
    with pytest.raises(Exception, match="unknown bloc label"):
        relational.canonical_blocs(rows, "label").collect()


def test_validation_order(spark):
    bad = spark.createDataFrame([(2020, "White", 2.0, 0.1, "x")], PANEL)
    with pytest.raises(ValueError, match="missing"):
        relational.validate(bad, ["absent"], "p")
    with pytest.raises(ValueError, match="bloc_name"):
        relational.validate(bad, ["cycle"], "p")
    with pytest.raises(ValueError, match="repeated"):
        relational.assert_unique(bad.union(bad), ["cycle", "bloc"])


def test_keep_first_and_upsert(spark):
    rows = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b"), (0, None)], "n int, k string")
    assert sorted(r.n for r in relational.keep_first(rows, F.col("k"), "n").collect()) == [0, 1, 2]
    once = relational.upsert_prefix(rows, spark.createDataFrame([(9, "ax")], "n int, k string"), "k", "a")
    assert sorted(r.n for r in once.collect()) == [0, 2, 9]
    twice = relational.upsert_prefix(once, spark.createDataFrame([(9, "ax")], "n int, k string"), "k", "a")
    assert sorted(r.n for r in twice.collect()) == [0, 2, 9]


def test_simplex_in_groups(spark):
    from psephos.kernels import linalg

    rng = np.random.default_rng(0)
    v = rng.normal(size=(20, 6)).round(1)
    rows = spark.createDataFrame([(g, i, float(v[g, i])) for g in range(20) for i in range(6)], "g int, i int, v double")
    got = {(r.g, r.i): r.w for r in simplex.project(rows, "g", "v").collect()}
    want = linalg.onto_simplex(v)
    assert all(got[g, i] == pytest.approx(want[g, i], abs=1e-9) for g in range(20) for i in range(6))


def test_ranks_and_split(spark):
    rows = spark.range(5000).withColumn("s", F.when(F.col("id") < 4000, "hot").otherwise("cold"))
    ranks = sampling.ranked(rows, ["s"], sampling.uniform(1, "id")).groupBy("s").agg(F.collect_set("rank").alias("r")).collect()
    assert {r.s: sorted(r.r) for r in ranks} == {"hot": list(range(1, 4001)), "cold": list(range(1, 1001))}
    split = sampling.stratified_split(rows, "s", "id", 0.8, 7)
    assert {r.s: r.n for r in split.where("train").groupBy("s").agg(F.count("*").alias("n")).collect()} == {"hot": 3200, "cold": 800}
    assert sampling.capped(rows, "s", "id", 10, 1).count() == 20


def test_text_functions(spark):
    rows = spark.createDataFrame([("RT @x hi there all",), ("\U0001f600\U0001f680",), ("https://a.b/c",), ("@you short",), ("A normal post about #Topics and @people https://x.y here",), (None,)], "t string")
    assert [r.s for r in rows.select(text.is_spam(F.col("t")).alias("s")).collect()] == [True, True, True, True, False, None]
    assert rows.select(text.clean_post(F.col("t")).alias("c")).collect()[4].c == "A normal post about Topics and here"


def test_timestamps(spark):
    forms = ["1577836800", "1577836800000", "2020-01-01T00:00:00Z", "2020-01-01 00:00:00", "Wed Jan 01 00:00:00 +0000 2020", "2020-01-01", "never", None]
    got = [r.x for r in spark.createDataFrame([(f,) for f in forms], "t string").select(F.unix_seconds(scalars.timestamp(F.col("t"))).alias("x")).collect()]
    assert got == [1577836800] * 6 + [None, None]


def test_posts_and_envelopes(spark, tmp_path):
    lines = [json.dumps({"payload": {"id": "1", "body": "hello", "created_utc": 5}}), json.dumps({"text": "bare"}), "", "{broken", json.dumps({"id": "3", "text": ""})]
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    got = readers.posts(spark, f"file://{tmp_path}/a.jsonl", "reddit")
    assert got.columns == readers.POST
    assert {(r.text, r.created_at) for r in got.collect()} == {("hello", "5"), ("bare", None)}
    sinks.write_posts(got.withColumn("shock_id", F.lit("s")), f"file://{tmp_path}/out", ["shock_id"], "merge", 7, "2020")
    back = readers.json_lines(spark, f"file://{tmp_path}/out/shock_id=s")
    assert back.count() == 2


def test_zipped_pages(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for s, y in (("ca", "2020"), ("ca", "2021"), ("ny", "2020")):
            z.writestr(f"root/{s}/{y}/news/p.html", f"<p>{s}{y}</p>")
    spark.dataSource.register(readers.ZippedPages)
    rows = spark.read.format("zipped_pages").load(str(tmp_path / "a.zip"))
    assert rows.count() == 3 and [r.html for r in rows.where("state = 'ca' AND year = '2021'").collect()] == ["<p>ca2021</p>"]


def test_joins(spark):
    points = spark.createDataFrame([(0.0, 1.0), (10.0, 2.0), (20.0, 3.0)], "t double, value double")
    goals = spark.createDataFrame([(5.0,), (19.0,), (90.0,)], "at double")
    assert {r.at: r.value for r in joins.nearest_in_time(points, goals).collect()} == {5.0: 1.0, 19.0: 3.0, 90.0: 3.0}
    assert {r.at: r.value for r in joins.last_in_window(points, goals, 6).collect()} == {5.0: 2.0, 19.0: 3.0, 90.0: None}
    left = spark.createDataFrame([(1, ["tax", "cut"]), (2, ["x"])], "k int, w array<string>")
    names = spark.createDataFrame([("tax_cut",), ("tax_rise",)], "name string")
    got = joins.by_overlap(left, "k", F.col("w"), names, "name", F.split("name", "_")).collect()
    assert [(r.k, r.name, r.overlap) for r in got] == [(1, "tax_cut", 2)]
    with pytest.raises(ValueError):
        joins.bounded(spark.range(joins.SMALL_ROWS + 1))


def test_shock_stages(spark):
    m = pipeline.Moments(np.array([0.80, 0.58, 0.54, 0.34, 0.48]), 4e-4 * np.eye(5), {b: 0.5 for s in ("religion", "gender") for b in dims.BLOCS[s]}, 0.535)
    stages = list(pipeline.run_shock(spark, m, {"white": "slight_pos"}, draws=2000))
    assert [s for s, _ in stages] == ["deltas", "equilibrium", "simulation", "done"]
    again = dict(pipeline.run_shock(spark, m, {"white": "slight_pos"}, draws=2000))
    assert again["simulation"] == stages[2][1]
    assert all(p == sorted(p) for p in stages[2][1]["percentiles"].values())
    assert [s for s, _ in pipeline.run_shock(spark, m, {"white": "no such bin"})] == ["stream_error", "done"]


def test_stream_equals_batch(spark, sf_dir):
    keywords = spark.createDataFrame([("alpha", "the"), ("beta", "eaux"), ("gamma", "de")], "topic string, keyword string")
    batch = router.routed(spark.read.parquet(f"{sf_dir}/conversations.parquet"), keywords).select("conv_id", "turn", "topic").distinct()
    stream = router.route_available(spark, f"{sf_dir}/conversations.parquet")
    assert sorted(map(tuple, stream.collect())) == sorted(map(tuple, batch.collect()))


def test_audit_and_latex(spark, tmp_path):
    from datetime import datetime

    path = f"file://{tmp_path}/audit"
    rows = [(str(i), datetime(2020, 1, 1 + i), "e", 1.0, "{}", True, False, float("nan"), 1.0, 2.0, 3.0, "b") for i in range(3)]
    sinks.audit_append(spark, path, rows)
    got = sinks.audit_latest(spark, path, 2).collect()
    assert [r.id for r in got] == ["2", "1"] and got[0].win_prob is None
    assert r"a\_b & --" in sinks.latex(spark.createDataFrame([("a_b", None)], "x string, y double"), ["x", "y"])
