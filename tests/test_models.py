"""Folds and ridge regressions against plain numpy loops."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from psephos import dims
from psephos.kernels import linalg
from psephos.operators import models
from psephos.plans import models as plans


def plain_folds(rows):
    by = defaultdict(list)
    for k, u, x, y in rows:
        by[k].append((u, x, y))
    out = {}
    for k, own in by.items():
        own.sort()
        x, y = np.array([r[1] for r in own], float), np.array([r[2] for r in own], float)
        s = x.std(0)
        x = (x - x.mean(0)) / np.where(s > 0, s, 1)
        for i, (u, *_) in enumerate(own):
            keep = np.arange(len(own)) != i
            if keep.sum() > 1 and y[keep].std() > 0:
                mean, dev = linalg.gaussian_process(x[keep], y[keep], x[i : i + 1], 0.10)
                out[k, u] = (float(np.clip(mean[0], 0, 1)), float(dev[0]))
            else:
                out[k, u] = (None, None)
    return out


def test_folds_against_a_plain_loop(spark, sf_dir):
    table = plans.segment_months(spark, sf_dir)
    rows = [tuple(r) for r in table.collect()]
    got = models.left_out(table.repartition(5), ["bloc"], "cycle", "won").collect()
    want = plain_folds(rows)
    assert len(got) == len(rows) == len(want)
    for r in got:
        assert (r.prob, r.deviation) == pytest.approx(want[r.bloc, r.cycle], abs=1e-6)
    shown = plans.loco_folds(spark, sf_dir).collect()
    for r in shown:
        own = [(w[0], x[3]) for x in rows if x[0] == r.bloc and (w := want[x[0], x[1]])[0] is not None]
        assert r.brier == pytest.approx(np.mean([(p - y) ** 2 for p, y in own]), abs=1e-5)
        assert r.accuracy == pytest.approx(np.mean([(p >= 0.5) == (y > 0.5) for p, y in own]), abs=1e-5)
        assert r.fold_brier == pytest.approx((want[r.bloc, r.cycle][0] - r.won) ** 2, abs=1e-5)


def test_folds_of_a_panel(spark):
    rng = random.Random(6)
    lean = {b: rng.uniform(-0.2, 0.3) for s in dims.BLOCS.values() for b in s}
    rows = [(c, b, min(0.95, max(0.05, t + lean[b] + rng.gauss(0, 0.01)))) for c, t in dims.TWO_PARTY_SHARE.items() for b in lean if not (b == "muslim" and c < 2000)]
    panel = spark.createDataFrame([*rows, (None, "white", 0.5), (1948, "latino", None), (2020, "no_bloc", 0.5)], "cycle int, bloc string, vote_share double")
    for party in ("democrat", "republican"):
        features = models.cycle_features(panel, party)
        got = features.collect()
        assert len(got) == 20 and all(len(r.x) == 9 and None not in r.x for r in got)
        assert sum(r.won for r in got) == sum((t > 0.5) == (party == "democrat") for t in dims.TWO_PARTY_SHARE.values())
        folds = models.left_out(features, ["party"], "cycle", "won")
        score = models.fold_scores(folds, ["party"], "won").first()
        assert score.folds == 20 and score.accuracy >= 0.7 and score.brier < 0.2
    assert len(models.cycle_features(panel, with_year=False, with_strata=False).first().x) == 5


def test_folds_that_cannot_be_fitted(spark):
    rows = [("same", i, [float(i), 1.0], 1.0) for i in range(4)] + [("two", 1, [0.0], 0.0), ("two", 2, [1.0], 1.0), (None, 1, [1.0], 0.0), (None, 2, [2.0], 1.0), (None, 3, [3.0], 1.0), (None, 4, [0.0], 0.0)]
    got = models.left_out(spark.createDataFrame(rows, "k string, u int, x array<double>, y double"), ["k"], "u", "y").collect()
    assert len(got) == len(rows)
    assert all((r.prob is None) == (r.k in ("same", "two")) for r in got)
    assert models.left_out(spark.createDataFrame([], "k string, u int, x array<double>, y double"), ["k"], "u", "y").count() == 0


def test_ridge_against_numpy(spark):
    rng = np.random.default_rng(7)
    rows = []
    for k, n in (("a", 60), ("b", 9), ("c", 3), ("few", 2), ("flat", 5)):
        for _ in range(n):
            x = rng.normal(0, 0.4, 3)
            rows.append((k, *map(float, x), 0.25 if k == "flat" else float(0.3 * x[0] - 0.2 * x[1] + rng.normal(0, 0.05))))
    got = {r.k: r for r in models.ridge_by_group(spark.createDataFrame(rows, "k string, news double, x double, y double, d double").repartition(4), ["k"], ["news", "x", "y"], "d").collect()}
    for k in "abc":
        own = np.array([r[1:] for r in rows if r[0] == k])
        w, penalty = linalg.ridge_loo(own[:, :3], own[:, 3], np.array(models.PENALTIES))
        r = got[k]
        assert (r.n, r.penalty) == (len(own), penalty)
        assert [*[r.coefficients[c] for c in ("news", "x", "y")], r.intercept] == pytest.approx(w, abs=1e-9)
        errors = []
        for i in range(len(own)):  # really left out
            keep = np.arange(len(own)) != i
            x, y = own[keep, :3], own[keep, 3]
            c = x - x.mean(0)
            b = np.linalg.solve(c.T @ c + penalty * np.eye(3), c.T @ (y - y.mean()))
            errors.append(own[i, 3] - y.mean() - (own[i, :3] - x.mean(0)) @ b)
        assert r.cv_r2 == pytest.approx(1 - np.square(errors).sum() / np.square(own[:, 3] - own[:, 3].mean()).sum(), abs=1e-9)
    assert got["few"].n == 2 and got["few"].penalty is None and got["few"].coefficients is None
    assert got["flat"].cv_r2 is None and got["flat"].intercept == pytest.approx(0.25)


def test_predictions_and_missing_scores(spark):
    scores = spark.createDataFrame([("a", i, s, v) for i in range(6) for s, v in (("news", i / 5), ("social", -i / 9 if i % 2 else None))], "k string, u int, source string, score double")
    targets = spark.createDataFrame([("a", i, i / 10) for i in range(6)] + [("a", 9, None), ("b", 1, float("nan")), ("b", 2, 0.5)], "k string, u int, delta double")
    wide = models.wide_scores(scores, targets, ["k"], "u", ["news", "social"])
    assert {(r.k, r.u): (r.news, r.social) for r in wide.collect()} == {**{("a", i): (i / 5, -i / 9 if i % 2 else 0.0) for i in range(6)}, ("b", 2): (0.0, 0.0)}
    fits = models.ridge_by_group(wide, ["k"], ["news", "social"], "delta")
    out = {(r.k, r.u): r.predicted for r in models.predicted(wide, fits, ["k"], ["news", "social"]).collect()}
    assert out["b", 2] is None and all(abs(out["a", i] - i / 10) < 0.05 for i in range(6))
    assert models.ridge_by_group(wide.limit(0), ["k"], ["news"], "delta").agg(F.count("*")).first()[0] == 0
