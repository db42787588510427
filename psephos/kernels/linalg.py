"""Mathematics on vectors and matrices of a handful of entries; the data behind them is aggregated in Spark."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping
from dataclasses import dataclass, field
from itertools import product

import numpy as np


def derive_seed(base: int, stage: str) -> int:
    """Seed of a stage: first 8 bytes (little-endian) of SHA-256 of ``base:stage``, modulo 2**31."""
    if ":" in stage:
        raise ValueError("a stage name has no colon")
    return int.from_bytes(hashlib.sha256(f"{base}:{stage}".encode()).digest()[:8], "little") % 2**31


def onto_simplex(v: np.ndarray) -> np.ndarray:
    """Rows projected onto the probability simplex."""
    x = np.atleast_2d(np.asarray(v, float))
    u = -np.sort(-x, axis=1)
    excess = u.cumsum(1) - 1
    place = np.arange(1, x.shape[1] + 1)
    count = (u * place > excess).sum(1)
    theta = excess[np.arange(len(x)), count - 1] / count
    out = np.maximum(x - theta[:, None], 0)
    return out if np.ndim(v) == 2 else out[0]


def nearest_psd(m: np.ndarray, eps: float = 1e-6) -> np.ndarray:
    """Shifted by the identity so that the least eigenvalue is ``eps``, if it is under 0."""
    least = np.linalg.eigvalsh(m)[0]
    return m if least >= 0 else m + (eps - least) * np.eye(len(m))


def floored(m: np.ndarray, eps: float = 1e-6) -> np.ndarray:
    """Eigenvalues raised to ``eps``."""
    values, vectors = np.linalg.eigh(m)
    return (vectors * np.maximum(values, eps)) @ vectors.T


def shrunk_covariance(x: np.ndarray) -> tuple[np.ndarray, float]:
    """Ledoit-Wolf covariance of rows towards a multiple of the identity, and the shrinkage."""
    x = np.asarray(x, float) - np.mean(x, axis=0)
    n, p = x.shape
    s = x.T @ x / n
    mu = np.trace(s) / p
    d2 = ((s - mu * np.eye(p)) ** 2).sum() / p
    b2 = min(((x**2).T @ (x**2) / n - s**2).sum() / n / p, d2)
    rho = 0.0 if d2 == 0 else b2 / d2
    return rho * mu * np.eye(p) + (1 - rho) * s, rho


def logistic(x: np.ndarray, y: np.ndarray, c: float = 1e4, rounds: int = 100) -> tuple[float, float]:
    """Slope and intercept of a logistic regression with an L2 penalty 1/c on the slope, by Newton steps."""
    x, y, w = np.asarray(x, float), np.asarray(y, float), np.zeros(2)
    design = np.column_stack([x, np.ones_like(x)])
    penalty = np.array([1 / c, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -50, 50)))
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + np.diag(penalty + 1e-12), design.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-10:
            break
    return float(w[0]), float(w[1])


def threshold(x: np.ndarray, y: np.ndarray) -> float:
    """Where the fitted probability is one half."""
    a, b = logistic(x, y)
    return -b / a


def quadratic_program(sigma: np.ndarray, mu: np.ndarray, floor: float | None, lo: np.ndarray, hi: np.ndarray) -> np.ndarray | None:
    """Weights of least variance with sum 1, ``mu . w >= floor`` and bounds, by trying all active sets; null if infeasible. For a few weights."""
    k, best, best_value = len(mu), None, np.inf
    for state in product((0, -1, 1), repeat=k):
        fixed = np.array(state)
        free = np.flatnonzero(fixed == 0)
        base = np.where(fixed == -1, lo, np.where(fixed == 1, hi, 0.0))
        for bind in (False, True) if floor is not None else (False,):
            rows = [np.ones(len(free))] + ([mu[free]] if bind else [])
            right = [1 - base.sum()] + ([floor - mu @ base] if bind else [])
            a, m = np.array(rows), len(rows)
            kkt = np.block([[2 * sigma[np.ix_(free, free)], -a.T], [a, np.zeros((m, m))]])
            target = np.concatenate([-2 * sigma[np.ix_(free, range(k))] @ base, right])
            solved = np.linalg.lstsq(kkt, target, rcond=None)[0]
            w = base.copy()
            w[free] = solved[: len(free)]
            ok = abs(w.sum() - 1) < 1e-8 and (w >= lo - 1e-9).all() and (w <= hi + 1e-9).all() and (floor is None or mu @ w >= floor - 1e-9)
            if ok and (value := w @ sigma @ w) < best_value - 1e-15:
                best, best_value = w, value
    return best


def min_variance(sigma: np.ndarray, mu: np.ndarray, floor: float, relax: float = 0.01, times: int = 5) -> tuple[np.ndarray, float]:
    """Least variance with a floor on the mean that is relaxed step by step; equal weights if that fails too."""
    k = len(mu)
    for i in range(times + 1):
        if (w := quadratic_program(sigma, mu, floor - i * relax, np.zeros(k), np.ones(k))) is not None:
            return w, floor - i * relax
    return np.full(k, 1 / k), floor


def max_sharpe(sigma: np.ndarray, mu: np.ndarray, target: float, lo: float = 0.05, hi: float = 0.60) -> np.ndarray:
    """Weights in [lo, hi] with the largest (mu . w - target) / deviation; equal weights if no mean exceeds the target.

    For a given excess the deviation is least on the frontier, and the ratio
    has one peak along it, so a golden-section search over the excess finds it.
    """
    k = len(mu)
    low, high = np.full(k, lo), np.full(k, hi)
    order, top, left = np.argsort(-mu), low.copy(), 1 - low.sum()
    for i in order:  # the largest mean within the bounds
        give = min(hi - lo, left)
        top[i] += give
        left -= give
    if mu @ top <= target:
        return np.full(k, 1 / k)

    def at(m: float) -> tuple[float, np.ndarray]:
        w = quadratic_program(sigma, mu, m, low, high)
        w = top if w is None else w
        return (mu @ w - target) / np.sqrt(w @ sigma @ w), w

    a, b, g = target, float(mu @ top), (5**0.5 - 1) / 2
    for _ in range(60):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if at(c)[0] >= at(d)[0] else (c, b)
    return at((a + b) / 2)[1]


def helmert(k: int) -> np.ndarray:
    """Orthonormal contrasts, k x (k - 1); every column sums to 0."""
    if k < 2:
        raise ValueError("needs two parts at least")
    j = np.arange(1, k)
    upper = np.triu(np.ones((k, k - 1))) / np.sqrt(j * (j + 1))
    upper[j, j - 1] = -j / np.sqrt(j * (j + 1))
    return upper


def log_ratio(w: np.ndarray) -> np.ndarray:
    if (np.asarray(w) <= 0).any():
        raise ValueError("weights must be positive")
    return np.log(w) @ helmert(len(w))


def from_log_ratio(z: np.ndarray) -> np.ndarray:
    """Rows of log-ratios back on the simplex; clipped to +-30 first."""
    x = np.clip(np.atleast_2d(z), -30, 30) @ helmert(np.shape(z)[-1] + 1).T
    x = np.exp(x - x.max(1, keepdims=True))
    out = x / x.sum(1, keepdims=True)
    return out if np.ndim(z) == 2 else out[0]


def log_ratio_covariance(w: np.ndarray, sigma: np.ndarray) -> np.ndarray:
    """Covariance of deltas carried to log-ratios by the Jacobian, positive definite."""
    j = helmert(len(w)).T / w
    m = j @ sigma @ j.T
    return floored((m + m.T) / 2)


def ridge_loo(x: np.ndarray, y: np.ndarray, alphas: np.ndarray) -> tuple[np.ndarray, float]:
    """Ridge weights (intercept last) with the penalty of least leave-one-out error, in closed form; missing features count 0."""
    x = np.nan_to_num(np.asarray(x, float))
    xm, ym = x.mean(0), y.mean()
    u, s, vt = np.linalg.svd(x - xm, full_matrices=False)
    best = (np.inf, None, None)
    for a in alphas:
        shrink = s**2 / (s**2 + a)
        fit = ym + u @ (shrink * (u.T @ (y - ym)))
        left = 1 - (u**2 @ shrink) - 1 / len(y)
        error = float(np.mean(((y - fit) / np.maximum(left, 1e-9)) ** 2))
        if error < best[0]:
            w = vt.T @ (s / (s**2 + a) * (u.T @ (y - ym)))
            best = (error, np.append(w, ym - xm @ w), float(a))
    return best[1], best[2]


def gaussian_process(x: np.ndarray, y: np.ndarray, new: np.ndarray, noise: float = 0.10, scales: tuple = (0.3, 0.6, 1.0, 2.0, 4.0)) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of a process with an RBF plus Matern-3/2 kernel; the scale has the largest marginal likelihood on a grid."""
    x, new = np.atleast_2d(x), np.atleast_2d(new)
    mid, spread = y.mean(), y.std() or 1.0
    t = (y - mid) / spread
    dist = lambda a, b: np.sqrt(np.maximum(((a[:, None] - b[None]) ** 2).sum(-1), 0))

    def kernel(d: np.ndarray, scale: float) -> np.ndarray:
        r = d / scale
        return 0.5 * np.exp(-(r**2) / 2) + 0.5 * (1 + 3**0.5 * r) * np.exp(-(3**0.5) * r)

    def fitted(scale: float):
        c = np.linalg.cholesky(kernel(dist(x, x), scale) + noise * np.eye(len(x)))
        alpha = np.linalg.solve(c.T, np.linalg.solve(c, t))
        return -(t @ alpha) / 2 - np.log(np.diag(c)).sum(), scale, c, alpha

    _, scale, c, alpha = max((fitted(s) for s in scales), key=lambda f: f[0])
    k = kernel(dist(new, x), scale)
    var = 1 - (np.linalg.solve(c, k.T) ** 2).sum(0)
    return mid + spread * (k @ alpha), spread * np.sqrt(np.maximum(var, 0))


def jackknife_platt(score: np.ndarray, won: np.ndarray, c: float = 100.0) -> np.ndarray:
    """Calibrated probability of each case from a logistic fit to the others."""
    out = np.empty(len(score))
    for i in range(len(score)):
        keep = np.arange(len(score)) != i
        a, b = logistic(score[keep], won[keep], c)
        out[i] = 1 / (1 + np.exp(-(a * score[i] + b)))
    return out


def layer_weights(strata: np.ndarray, truth: np.ndarray, start: np.ndarray, strength: float = 0.01, rounds: int = 100, tol: float = 1e-6) -> tuple[np.ndarray, int]:
    """Non-negative weights of strata with sum 1 that explain the results, drawn to equal weights, and the rounds it took.

    Each round solves the regularised normal equations of the strata that have
    weight and projects onto the simplex, until nothing moves. Under three
    points: the start, normalised, and 0 rounds.
    """
    lam = np.asarray(start, float)
    if len(truth) < 3:
        return lam / (lam.sum() or 1.0), 0
    even = np.full(len(lam), 1 / len(lam))
    for i in range(1, rounds + 1):
        live, new = np.flatnonzero(lam > 1e-9), np.zeros(len(lam))
        own = strata[:, live]
        new[live] = np.linalg.solve(own.T @ own + strength * np.eye(len(live)), own.T @ truth + strength * even[live])
        new = onto_simplex(new)
        moved, lam = np.abs(new - lam).max(), new
        if moved < tol:
            return lam, i
    return lam, rounds


@dataclass(frozen=True)
class Bounds:
    """Bounds of named weights whose sum is 1; 0 and 1 where none are given."""

    names: tuple[str, ...]
    lower: Mapping[str, float] = field(default_factory=dict)
    upper: Mapping[str, float] = field(default_factory=dict)

    def check(self) -> Bounds:
        """Itself, or an error that names the first bound that is unknown, out of [0, 1] or above its partner, or the sum that leaves no weights."""
        for kind in ("lower", "upper"):
            for name, x in getattr(self, kind).items():
                if name not in self.names or not (np.isfinite(x) and 0 <= x <= 1):
                    raise ValueError(f"{kind}[{name}]: {x} is no bound of {list(self.names)} in [0, 1]")
        lo, hi = self.arrays()
        crossed = [n for n, a, b in zip(self.names, lo, hi, strict=True) if a > b]
        if crossed or lo.sum() > 1 + 1e-9 or hi.sum() < 1 - 1e-9:
            raise ValueError(f"no weights with sum 1: crossed {crossed}, lower bounds sum to {lo.sum()}, upper to {hi.sum()}")
        return self

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        return np.array([self.lower.get(n, 0.0) for n in self.names]), np.array([self.upper.get(n, 1.0) for n in self.names])

    def best(self, mu: np.ndarray) -> np.ndarray:
        """The weights with the largest mean: what is left over the lower bounds goes to the largest first."""
        lo, hi = self.arrays()
        w, left = lo.copy(), 1 - lo.sum()
        for i in np.argsort(-np.asarray(mu), kind="stable"):
            give = min(hi[i] - lo[i], left)
            w[i] += give
            left -= give
        return w


def max_sharpe_within(sigma: np.ndarray, mu: np.ndarray, target: float, layer: float, fixed: float, bounds: Bounds) -> np.ndarray:
    """Weights within ``bounds`` with the largest (layer * mu . w + fixed - target) / (layer * deviation); an error if no weights reach the target."""
    lo, hi = bounds.check().arrays()
    goal = (target - fixed) / layer
    top = bounds.best(mu)
    if mu @ top <= goal:
        raise ValueError(f"the target {target} is out of reach: {layer * (mu @ top) + fixed} at most")

    def at(m: float) -> tuple[float, np.ndarray]:
        w = quadratic_program(sigma, mu, m, lo, hi)
        w = top if w is None else w
        return (mu @ w - goal) / np.sqrt(max(w @ sigma @ w, 1e-18)), w

    a, b, g = goal, float(mu @ top), (5**0.5 - 1) / 2
    for _ in range(60):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if at(c)[0] >= at(d)[0] else (c, b)
    return at((a + b) / 2)[1]


def win_interval(win: float, n: int, seed: int, replicates: int = 500) -> tuple[float, float]:
    """5th and 95th percentiles of Binomial(n, win) / n: the interval of the estimated probability."""
    shares = np.random.default_rng(seed).binomial(n, win, replicates) / n
    return float(np.percentile(shares, 5)), float(np.percentile(shares, 95))
