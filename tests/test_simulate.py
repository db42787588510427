"""Bootstrap matrices and vector diagnostics against numpy, and the covariance in the shock run."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from psephos import dims, pipeline
from psephos.operators import simulate
from psephos.sources import readers


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(3)
    x = rng.multivariate_normal([1000, 2, -5], [[4, 1, 0], [1, 2, -0.5], [0, -0.5, 1]], 600)
    return x, np.abs(x[:, 0] - 1000) ** 3


def matrix(found, names):
    got = {(r.a, r.b): r.cov for r in found.collect()}
    return np.array([[got[a, b] for b in names] for a in names])


@pytest.mark.parametrize("weighted", [False, True])
def test_bootstrap_against_numpy(spark, sample, weighted):
    x, w = sample
    rows = spark.createDataFrame([(i, *map(float, v), float(u)) for i, (v, u) in enumerate(zip(x, w, strict=True))] + [(900, None, 1.0, 1.0, 1.0), (901, float("nan"), 1.0, 1.0, 1.0)], "id int, a double, b double, c double, w double")
    names = ["a", "b", "c"]
    some = simulate.bootstrap_matrices(rows, ["id"], names, 300, 7, "w" if weighted else None)
    one = matrix(simulate.bootstrap_mean(some), names)
    rng = np.random.default_rng(1)
    p = w / w.sum() if weighted else None
    plain = [np.cov(x[rng.choice(len(x), len(x), p=p)].T) for _ in range(300)]
    assert np.abs(one - np.mean(plain, axis=0)).max() < 0.05 * np.abs(one).max()
    each = np.array([r.deviation for r in simulate.bootstrap_mean(some).where("a = b").orderBy("a").collect()])
    assert each == pytest.approx(np.std(plain, axis=0).diagonal(), rel=0.35)
    other = matrix(simulate.bootstrap_mean(simulate.bootstrap_matrices(rows.repartition(11), ["id"], names, 300, 7, "w" if weighted else None)), names)
    assert np.allclose(one, other, rtol=1e-9)  # the same under any layout


def test_bootstrap_edges(spark):
    rows = spark.createDataFrame([(i, float(i), 1.0 if i else 3000.0) for i in range(50)], "id int, a double, w double")
    heavy = simulate.bootstrap_matrices(rows, ["id"], ["a"], 100, 7, "w")  # one row with nearly all draws
    assert heavy.agg(F.avg("cov")).first()[0] == pytest.approx(np.mean([np.var(np.random.default_rng(s).choice(50, 50, p=np.array([3000.0, *[1.0] * 49]) / 3049), ddof=1) for s in range(4000)]), rel=0.5)
    none = simulate.bootstrap_matrices(rows.withColumn("w", F.lit(None).cast("double")), ["id"], ["a"], 20, 7, "w")
    assert none.count() == 20
    assert simulate.bootstrap_matrices(rows.limit(0), ["id"], ["a"], 5, 7).count() == 0


def test_poisson_parts_have_the_law():
    u = simulate._uniform(np.arange(20_000, dtype=np.uint64) * np.uint64(7919), np.arange(3, dtype=np.uint64), 5)
    assert abs(u.mean() - 0.5) < 0.005 and len(np.unique(u)) == u.size
    for rate in (0.1, 1.0, 4.0):
        draws = simulate._poisson(np.full(len(u), rate), u)
        assert draws.mean() == pytest.approx(rate, rel=0.05) and draws.var() == pytest.approx(rate, rel=0.05)


def test_noise_covariance(spark):
    got = simulate.noise_covariance(spark, [0.1, -0.2, 0.0], 30_000, 7)
    assert np.allclose(got, np.eye(3) * 1e-4, atol=4e-6)
    assert np.array_equal(got, simulate.noise_covariance(spark, [0.5, 0.5, 0.5], 30_000, 7))


def exact(real, made):
    def square(a, b):
        return ((a[:, None] - b[None]) ** 2).sum(-1)

    d = square(real, real)
    lam = 1 / (2 * np.median(d[d > 0]))
    k = lambda a, b: np.exp(-lam * square(a, b)).mean()
    mmd2 = k(real, real) - 2 * k(real, made) + k(made, made)
    centred = real - real.mean(0)
    top = np.linalg.svd(centred, full_matrices=False)[2][:2].T
    top2 = np.var(made @ top, axis=0).sum() / np.var(made, axis=0).sum()
    diff = np.corrcoef(real.T) - np.corrcoef(made.T)
    np.fill_diagonal(diff, 0)
    return np.sqrt(max(mmd2, 0)), lam, top2, np.linalg.norm(diff) / (real.shape[1] * (real.shape[1] - 1))


def test_diagnostics_against_numpy(spark):
    rng = np.random.default_rng(9)
    mix = rng.normal(size=(5, 5)) * [3, 2, 0.3, 0.2, 0.1]
    real = rng.normal(size=(150, 5)) @ mix.T + 4
    near, far = rng.normal(size=(120, 5)) @ mix.T + 4, rng.normal(size=(90, 5)) * 2 - 3
    rows = [(i, "r", True, v.tolist()) for i, v in enumerate(real)] + [(i + 1000, "near", False, v.tolist()) for i, v in enumerate(near)] + [(i + 2000, "far", False, v.tolist()) for i, v in enumerate(far)]
    rows += [(5000, "near", False, None), (5001, None, False, [0.0] * 5), (5002, "r", None, [0.0] * 5)]
    table = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), "id int, label string, real boolean, v array<double>").repartition(5)
    got = {r.label: r for r in simulate.diagnostics(table, "real", "label", "id", "v", 7).collect()}
    assert set(got) == {"near", "far"}
    for name, made in (("near", near), ("far", far)):
        mmd, lam, top2, pcd = exact(real, made)
        r = got[name]
        assert r.n == len(made) and r["lambda"] == pytest.approx(lam, rel=1e-6)
        assert r.mmd == pytest.approx(mmd, abs=0.05) and r.mmd_weight == pytest.approx(0.5 * np.exp(-lam * mmd**2), abs=0.01)
        assert (r.top2, r.pcd) == pytest.approx((top2, pcd), abs=1e-9) and r.flagged == (top2 < 0.7)
    assert got["far"].flagged and not got["near"].flagged
    few = simulate.diagnostics(table.where("id < 2 OR id >= 1000"), "real", "label", "id", "v", 7).collect()
    assert len(few) == 2 and all(r.mmd is None and r.flagged is None for r in few)
    assert simulate.diagnostics(table.limit(0), "real", "label", "id", "v", 7).count() == 0


def test_scale_of_repeated_vectors():
    assert simulate.median_scale(np.zeros((4, 3))) == 1.0 and simulate.median_scale(np.zeros((0, 3))) == 1.0


def test_past_changes_spread_the_draws(spark):
    rng = random.Random(2)
    rows = [(c, b, min(0.95, max(0.05, t + rng.gauss(0, 0.08)))) for c, t in dims.TWO_PARTY_SHARE.items() for s in dims.BLOCS.values() for b in s]
    panel = spark.createDataFrame(rows, "cycle int, bloc string, vote_share double")
    m, changes = pipeline.estimate_moments(panel), pipeline.delta_covariance(panel)
    wide = dict(pipeline.shock_on_panel(panel, {"white": "mild_neg"}, draws=2000))["simulation"]
    narrow = dict(pipeline.run_shock(spark, m, {"white": "mild_neg"}, draws=2000))["simulation"]
    spread = lambda s: sum(p[4] - p[0] for p in s["percentiles"].values())
    assert changes is not None and np.sqrt(changes.diagonal()).mean() > 0.02 and spread(wide) > 1.5 * spread(narrow)
    assert len(pipeline.sensitivity(spark, m, {}, draws=200, changes=changes)) == 7
    report = pipeline.spectrum_report(spark, m).collect()
    assert [r.eigenvalue for r in report] == sorted((r.eigenvalue for r in report), reverse=True)
    assert sum(r.share for r in report) == pytest.approx(1) and report[0].condition == pytest.approx(np.linalg.cond(m.sigma), rel=1e-3)


def test_one_name_in_two_strata(spark):
    said = '{"proxy": {"race": {"white": 0.5, "women": 0.1}, "gender": {"women": 0.6}}}'
    got = spark.createDataFrame([(said,), ("{}",), (None,), ("{cut",)], "d string").select(readers.outlet_proxy(F.col("d")).alias("w")).collect()
    assert [r.w for r in got] == [{"white": 0.5, "women": 0.1}, None, None, None]
