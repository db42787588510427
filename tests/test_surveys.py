"""Surveys from files to moments, and the readers beside them."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from psephos import artifacts, dims, pipeline
from psephos.kernels import linalg
from psephos.operators import aggregates, authors, sampling
from psephos.sources import readers, surveys


def kish(rows):
    w = np.array([1.0 if x[1] is None else x[1] for x in rows])
    share = float((np.array([x[0] for x in rows]) * w).sum() / w.sum())
    return share, (share * (1 - share) / max(w.sum() ** 2 / (w**2).sum(), 1)) ** 0.5


def test_anes(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        "VCF0004,VCF0105a,VCF0104,VCF0704,VCF0010x\n"
        "2012,White non-Hispanic (1948-2012),Female,1.0,2.0\n2012,White non-Hispanic (1948-2012),Male,2,1.0\n2012,White non-Hispanic (1948-2012),Male,3.0,\n2012,Black non-Hispanic (1948-2012),Female,0.0,1\n2012,Martian,Female,1,1\n"
    )
    got = {r.bloc: (r.cycle, r.vote_share, r.se) for r in surveys.cells(surveys.read(spark, f"file://{tmp_path}/a.csv", "ANES"), "ANES").collect()}
    assert set(got) == {"white", "women", "men"}
    assert got["white"] == (2012, *map(pytest.approx, kish([(1, 2.0), (0, 1.0), (0, None)])))
    assert got["women"][1] == 1.0 and got["men"][1] == 0.0


def test_gss_elections(spark):
    rows = spark.createDataFrame([(2018, "white", "Clinton", None, 1.0), (2021, "white", "trump", "Biden", 3.0), (2021, "hispanic", None, "other", 1.0)], "cycle int, bloc__race string, pres16 string, pres20 string, weight double")
    got = {(r.cycle, r.bloc): r.vote_share for r in surveys.cells(rows, "GSS").collect()}
    assert got == {(2016, "white"): pytest.approx(0.25), (2020, "white"): 1.0}
    assert surveys.cells(rows.drop("pres16", "pres20"), "GSS").count() == 0


def test_ces_votes_and_born_again(spark):
    rows = [(2020, "Protestant", "Yes", " democratic ", 1.0), (2020, "Protestant", "No", "Republican", 1.0), (2020, "Protestant", None, "Other", 1.0), (2018, "Jewish", "No", "Democratic", 1.0), (2020, "Jewish", "No", None, 1.0)]
    df = spark.createDataFrame(rows, "cycle int, bloc__religion string, bloc__religion_evangelical_flag string, vote_indicator string, weight_cumulative double")
    assert {r.bloc: r.vote_share for r in surveys.cells(df, "CES").collect()} == {"evangelical": 1.0, "protestant": 0.0}


def test_renames_and_cycles(spark, tmp_path):
    (tmp_path / "g.csv").write_text("year,pres16,pres20,sex\n2021,trump,biden,Female\n")
    assert surveys.read(spark, f"file://{tmp_path}/g.csv", "GSS").columns == ["cycle", "pres16", "pres20", "bloc__gender", "source"]
    (tmp_path / "v.csv").write_bytes("race_2016\nEspaña\n".encode("latin-1"))
    assert surveys.read(spark, f"file://{tmp_path}/v.csv", "VOTER_PANEL").first().race_2016 == "España"
    (tmp_path / "n.csv").write_text("RACETHN,WEIGHT\nWhite,1\n")
    assert surveys.read(spark, f"file://{tmp_path}/n.csv", "NPORS").first().cycle == 2024


def test_surveys_to_moments(spark):
    rng = np.random.default_rng(1)
    answers = {b: a[0] for b, a in surveys.ANSWERS["CES"].items() if b in dims.BLOCS["race"]}
    rows = [(c, a, "Democratic" if rng.random() < dims.TWO_PARTY_SHARE[c] else "Republican", 1.0) for c in (2004, 2008, 2012, 2016, 2020) for a in answers.values() for _ in range(60)]
    panel = pipeline.build_panel(surveys.all_cells({"CES": spark.createDataFrame(rows, "cycle int, bloc__race string, vote_indicator string, weight double")}))
    m = pipeline.estimate_moments(panel)
    artifacts.check_moments(dict(zip(dims.BLOCS["race"], m.mu.tolist(), strict=True)), m.sigma)
    changes = pipeline.delta_covariance(panel)
    artifacts.check_covariance(changes)
    stages = dict(pipeline.run_shock(spark, m, {}, draws=500, changes=changes))
    assert stages["simulation"]["low"] <= stages["simulation"]["win_probability"] <= stages["simulation"]["high"]
    report = pipeline.moment_report(spark, m, spark.createDataFrame([("white", float(m.mu[3]) + 0.07), ("asian", 0.0)], "bloc string, benchmark double")).collect()
    flags = {r.bloc: r.flag for r in report}
    assert [r.bloc for r in report] == [b for v in dims.BLOCS.values() for b in v] and flags["white"] == "WARN" and flags["asian"] == "ALERT"
    assert pipeline.calibrate_layers(panel)[1] == 0  # no cycle with all strata
    assert 0 <= pipeline.effective_loyalty(np.full(5, 0.2), m) <= 1
    assert len(pipeline.sensitivity(spark, m, {}, draws=200)) == 7


def test_layer_weights_are_the_constrained_least_squares():
    s = np.random.default_rng(3).uniform(0.3, 0.7, (20, 3))
    y = s @ [0.0, 0.3, 0.7] + 0.01
    lam, rounds = linalg.layer_weights(s, y, np.array([0.5, 0.3, 0.2]))
    loss = lambda w: ((s @ w - y) ** 2).sum() + 0.01 * ((w - 1 / 3) ** 2).sum()
    grid = [np.array([a, b, 1 - a - b]) for a in np.linspace(0, 1, 101) for b in np.linspace(0, 1 - a, 101)]
    assert rounds <= 5 and loss(lam) <= min(map(loss, grid)) + 0.01


def test_bounds_and_full_sharpe():
    b = linalg.Bounds(("a", "b", "c"), {"a": 0.1}, {"b": 0.5}).check()
    mu = np.array([0.4, 0.9, 0.6])
    assert np.allclose(b.best(mu), [0.1, 0.5, 0.4])
    w = linalg.max_sharpe_within(np.eye(3) * 1e-3, mu, 0.55, 0.5, 0.25, b)
    assert abs(w.sum() - 1) < 1e-8 and w[0] >= 0.1 - 1e-8 and w[1] <= 0.5 + 1e-8
    rng = np.random.default_rng(0)
    tried = [x for x in rng.dirichlet([1, 1, 1], 5000) if x[0] >= 0.1 and x[1] <= 0.5]
    ratio = lambda x: (mu @ x - 0.6) / np.sqrt(x @ x)
    assert ratio(w) >= max(map(ratio, tried)) - 1e-3
    for bad in (linalg.Bounds(("a",), {"x": 0.1}), linalg.Bounds(("a", "b"), {"a": 0.7, "b": 0.7}), linalg.Bounds(("a", "b"), {}, {"a": 0.2, "b": 0.2}), linalg.Bounds(("a", "b"), {"a": 0.5}, {"a": 0.4})):
        with pytest.raises(ValueError):
            bad.check()
    with pytest.raises(ValueError, match="out of reach"):
        linalg.max_sharpe_within(np.eye(3), mu, 0.99, 0.5, 0.25, b)


def test_win_interval():
    low, high = linalg.win_interval(0.6, 1000, 7)
    assert 0.55 < low < 0.6 < high < 0.65 and linalg.win_interval(1.0, 10, 7) == (1.0, 1.0)


def test_sample_cells_have_their_target(spark):
    rows = spark.range(6000).select("id", (F.col("id") % 3).alias("day"), F.when(F.col("id") % 100 == 0, "rare").when(F.col("id") % 2 == 0, "white").otherwise("latino").alias("bloc"), (F.col("id") % 7 == 0).alias("extreme"))
    targets = {(r.day, r.bloc): (r.n, r.target) for r in sampling.day_targets(rows, "day", "bloc", 300, dims.SAMPLE_SHARE).collect()}
    got = sampling.day_sample(rows, "day", "bloc", "id", F.col("extreme"), 10_000, 7, each=50)
    big = {(r.day, r.bloc): r.n for r in got.groupBy("day", "bloc").agg(F.sum("draws").alias("n")).collect()}
    wanted = {k: t for k, (n, t) in {(r.day, r.bloc): (r.n, r.target) for r in sampling.day_targets(rows, "day", "bloc", 10_000, dims.SAMPLE_SHARE).collect()}.items() if n > t}
    assert all(big[k] == t for k, t in wanted.items())
    few = sampling.day_sample(rows, "day", "bloc", "id", F.col("extreme"), 300, 7, each=50)
    assert few.agg(F.sum("draws")).first()[0] == min(300, sum(min(x) for x in targets.values()))
    share = few.where("extreme").agg(F.sum("draws")).first()[0] / 300
    assert 0.17 < share < 0.36  # double weight: about 0.25
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, sampling.day_sample(rows.repartition(5), "day", "bloc", "id", F.col("extreme"), 300, 7, each=50).collect()))


def test_vwap_and_slopes_leave_out_what_is_not_finite(spark):
    rows = spark.createDataFrame([("a", 0.4, 0.0), ("a", 0.6, 2.0), ("a", float("inf"), 1.0), ("a", float("nan"), 1.0), ("b", 0.2, None), ("b", 0.4, 0.0)], "k string, p double, v double")
    got = {r.k: r.vwap for r in aggregates.volume_weighted(rows, ["k"], "p", "v").collect()}
    assert got == {"a": pytest.approx(0.5), "b": pytest.approx(0.3)}
    points = spark.createDataFrame([(1, 1.0, 1.0), (1, 2.0, 2.0), (1, 3.0, 3.0), (1, float("nan"), 4.0), (1, 5.0, float("inf"))], "k int, y double, x double")
    assert aggregates.slopes(points, ["k"], "y", "x").first().slope == pytest.approx(1.0)


def test_group_means_and_counts(spark):
    rows = spark.createDataFrame([("s", "reddit", "men", 0.5), ("s", "x", "men", 0.1), ("s", "x", "women", None)], "shock string, platform string, bloc string, score double")
    names = spark.createDataFrame([("men",), ("women",), ("asian",)], "bloc string")
    assert {r.bloc: r.score for r in aggregates.group_means(rows, ["shock"], names, "bloc", "score").collect()} == {"men": pytest.approx(0.3), "women": 0.0, "asian": 0.0}
    assert {r.name: r.n for r in aggregates.class_counts(rows, {"known": F.col("score").isNotNull(), "high": F.col("score") > 0.3}).collect()} == {"known": 2, "high": 1}


def test_articles_proxies_and_strings(spark):
    rows = spark.createDataFrame([(1, "ca", "https://www.Times.com/a", "2020-05-01", None), (2, "NY", "https://x.org/b", None, "The Times"), (3, None, None, "2021-01-01", "")], "k int, state string, url string, date string, outlet string")
    ids = lambda df: sorted(r.k for r in df.collect())
    assert ids(readers.articles(rows, until="2020-12-31")) == [1, 2] and ids(readers.articles(rows, since="2020-06-01")) == [2, 3]
    assert ids(readers.articles(rows, states=["CA", "ny"])) == [1, 2] and ids(readers.articles(rows, outlet="times")) == [1, 2]
    said = spark.createDataFrame([(json.dumps({"outlet": "x", "proxy": {"race": {"white": 0.7}, "gender": {"men": 0.4}}}),), ("plain bio",), ('{"proxy": {}}',), (None,)], "d string")
    assert [r.p for r in said.select(readers.outlet_proxy(F.col("d")).alias("p")).collect()] == [{"white": 0.7, "men": 0.4}, None, None, None]
    deep = spark.createDataFrame([(json.dumps({"a": "one", "b": [{"c": 'tw"o'}, "three", 4, None]}),), ("not json",), ('"lone"',)], "j string")
    assert [r.s for r in deep.select(readers.json_strings(F.col("j")).alias("s")).collect()] == [["one", 'tw"o', "three"], [], ["lone"]]


def test_dated_files(spark, tmp_path):
    for day in ("2020-01-01", "2020-01-05", "2020-02-01"):
        (tmp_path / f"posts_{day}.jsonl").write_text(f'{{"d": "{day}"}}\n')
    got = readers.dated_files(spark, f"file://{tmp_path}", "2020-01-02", "2020-01-31")
    assert [(r.value, r.day) for r in got.collect()] == [('{"d": "2020-01-05"}', "2020-01-05")]
    assert readers.dated_files(spark, f"file://{tmp_path}", "2030-01-01", "2030-01-31").count() == 0
    span = spark.range(1).select(readers.span_of(F.lit("2020-01-10").cast("date"), 3, 14).alias("s")).first().s
    assert [str(x) for x in span] == ["2020-01-07", "2020-01-24", "2020-02-23"]


def test_platform_defaults(spark):
    rows = spark.createDataFrame([(1, None, None, "Truth"), (2, "keyword", {"men": 1.0}, "truth"), (3, None, None, "x")], "k int, method string, weights map<string,double>, platform string")
    defaults = spark.createDataFrame([("truth", {"white": 0.8})], "platform string, weights map<string,double>")
    got = {r.k: (r.method, r.weights) for r in authors.with_platform(rows, F.col("platform"), defaults).collect()}
    assert got == {1: ("platform", {"white": 0.8}), 2: ("keyword", {"men": 1.0}), 3: (None, None)}


def test_more_artifact_checks():
    race = dims.BLOCS["race"]
    good = [
        lambda: artifacts.check_panel([{"cycle": 2020, "bloc": "white", "vote_share": 0.4}]), lambda: artifacts.check_layers({"lambda_1": 0.2, "lambda_2": 0.3, "lambda_3": 0.5}),
        lambda: artifacts.check_deltas(dict.fromkeys(race, 0.1)), lambda: artifacts.check_sentiment({"x": {"men": -0.5}}), lambda: artifacts.check_market(0.5, {"post_shock_1h": 0.4, "post_shock_24h": None, "post_shock_72h": 0.6}),
        lambda: artifacts.check_shock({"id": "a", "date": "2020-01-01", "description": "d", "keywords": ["k"]}), lambda: artifacts.check_equilibrium(dict.fromkeys(race, 0.2), 0.5, 0.6, True),
        lambda: artifacts.check_percentiles(dict.fromkeys(race, [0.1, 0.2, 0.3, 0.4, 0.5])), lambda: artifacts.check_record({"shock_id": "a", "party": "democrat", "delta_bins": dict.fromkeys([b for v in dims.BLOCS.values() for b in v], "neutral")}),
    ]
    for check in good:
        check()
    bad = [
        lambda: artifacts.check_panel([]), lambda: artifacts.check_panel([{"cycle": 2020, "bloc": "white", "vote_share": 1.4}]), lambda: artifacts.check_layers({"lambda_1": 0.2, "lambda_2": 0.3, "lambda_3": 0.6}),
        lambda: artifacts.check_deltas(dict.fromkeys(race, 0.2)), lambda: artifacts.check_sentiment({"x": {"martians": 0.1}}), lambda: artifacts.check_market(1.5, {"post_shock_1h": 0.4, "post_shock_24h": None, "post_shock_72h": 0.6}),
        lambda: artifacts.check_shock({"id": "a", "date": "May", "description": "d"}), lambda: artifacts.check_equilibrium(dict.fromkeys(race, 0.2), 0.5, 0.4, True),
        lambda: artifacts.check_percentiles(dict.fromkeys(race, [0.2, 0.1, 0.3, 0.4, 0.5])), lambda: artifacts.check_moments(dict.fromkeys(race, 0.5), -np.eye(5)), lambda: artifacts.check_record({"shock_id": "a", "party": "x", "delta_bins": {}}),
    ]
    for check in bad:
        with pytest.raises(artifacts.ArtifactError):
            check()
