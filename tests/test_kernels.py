import numpy as np
import pytest

from psephos import dims, pipeline
from psephos.kernels import linalg


def test_seeds():
    assert [linalg.derive_seed(7, s) for s in ("voter_panel", "monte_carlo", "sentiment_data")] == [1401318295, 1875195376, 1544954873]
    with pytest.raises(ValueError):
        linalg.derive_seed(7, "a:b")


def test_simplex():
    w = linalg.onto_simplex(np.random.default_rng(0).normal(size=(500, 7)))
    assert np.allclose(w.sum(1), 1) and (w >= 0).all()
    assert np.allclose(linalg.onto_simplex(np.array([0.2, 0.3, 0.5])), [0.2, 0.3, 0.5])


def test_elector_majority_share():
    assert pipeline.elector_majority_share() == pytest.approx(0.5066, abs=1e-4)
    assert pipeline.elector_majority_share("republican") == pytest.approx(0.4934, abs=1e-4)


def test_max_sharpe_known_weights():
    w = linalg.max_sharpe(4e-4 * np.eye(5), np.array([0.80, 0.58, 0.54, 0.34, 0.48]), 0.535)
    assert np.allclose(w, [0.6000, 0.2032, 0.0968, 0.05, 0.05], atol=2e-4)
    assert np.allclose(linalg.max_sharpe(np.eye(3), np.array([0.1, 0.2, 0.3]), 0.5), 1 / 3)


def test_min_variance():
    w, floor = linalg.min_variance(np.diag([1.0, 4.0]), np.array([0.5, 0.5]), 0.4)
    assert np.allclose(w, [0.8, 0.2]) and floor == 0.4
    w, floor = linalg.min_variance(np.eye(2), np.array([0.50, 0.52]), 0.53)
    assert floor == pytest.approx(0.52) and w[1] == pytest.approx(1)


def test_log_ratios():
    v = linalg.helmert(5)
    assert np.allclose(v.T @ v, np.eye(4)) and np.allclose(v.sum(0), 0)
    w = np.array([0.6, 0.2, 0.1, 0.05, 0.05])
    assert np.allclose(linalg.from_log_ratio(linalg.log_ratio(w)), w)
    with pytest.raises(ValueError):
        linalg.log_ratio(np.array([0.5, 0.5, 0.0]))


def test_shrinkage_and_psd():
    x = np.random.default_rng(1).normal(size=(10, 6))
    s, rho = linalg.shrunk_covariance(x)
    assert 0 <= rho <= 1 and np.linalg.eigvalsh(s)[0] > 0
    assert np.linalg.eigvalsh(linalg.nearest_psd(np.array([[1.0, 2.0], [2.0, 1.0]])))[0] == pytest.approx(1e-6)


def test_ridge_leave_one_out():
    rng = np.random.default_rng(2)
    x, alphas = rng.normal(size=(20, 3)), np.logspace(-3, 3, 9)
    y = x @ [1.0, -2.0, 0.5] + 0.1 * rng.normal(size=20)
    w, alpha = linalg.ridge_loo(x, y, alphas)
    assert np.allclose(w[:3], [1, -2, 0.5], atol=0.15) and alpha in alphas


def test_gaussian_process_and_platt():
    x = np.linspace(0, 1, 15)[:, None]
    mean, sd = linalg.gaussian_process(x, np.sin(4 * x[:, 0]), np.array([[0.5], [9.0]]))
    assert mean[0] == pytest.approx(np.sin(2), abs=0.15) and sd[1] > sd[0]
    p = linalg.jackknife_platt(np.array([0.1, 0.2, 0.3, 0.7, 0.8, 0.9]), np.array([0, 0, 0, 1, 1, 1.0]))
    assert (p[:3] < 0.5).all() and (p[3:] > 0.5).all()


def test_layer_weights():
    s = np.random.default_rng(3).uniform(0.3, 0.7, (20, 3))
    lam, _ = linalg.layer_weights(s, s @ [0.2, 0.3, 0.5], np.array([1 / 3] * 3), strength=1e-6, rounds=5000, tol=1e-10)
    assert np.allclose(lam, [0.2, 0.3, 0.5], atol=0.02) and lam.sum() == pytest.approx(1)
    assert linalg.layer_weights(s[:2], s[:2, 0], np.array([0.5, 0.3, 0.2]))[1] == 0


def test_dimensions():
    assert sum(map(len, dims.BLOCS.values())) == 15 and len(dims.BINS) == len(dims.MIDPOINTS) == 9
    assert all(abs(sum(dims.ELECTORATE_SHARE[b] for b in v) - 1) < 1e-9 for v in dims.BLOCS.values())
