"""Checks of the small results that stages hand on."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

import numpy as np

from psephos import dims

TOLERANCE = 1e-6


class ArtifactError(ValueError):
    """Names the artifact, the field and what is wrong."""


def require(ok: bool, field: str, said: str) -> None:
    if not ok:
        raise ArtifactError(f"{field}: {said}")


def check_keys(values: Mapping[str, object], wanted: Sequence[str], field: str) -> None:
    gone, more = sorted(set(wanted) - set(values)), sorted(set(values) - set(wanted))
    require(not gone and not more, field, f"missing {gone}, unknown {more}")


def check_range(values: Mapping[str, float], lo: float, hi: float, field: str) -> None:
    bad = {k: v for k, v in values.items() if not np.isfinite(v) or not lo <= v <= hi}
    require(not bad, field, f"outside [{lo}, {hi}]: {bad}")


def check_weights(weights: Mapping[str, float], blocs: Sequence[str] = tuple(dims.BLOCS["race"])) -> None:
    check_keys(weights, blocs, "weights")
    check_range(weights, 0.0, 1.0, "weights")
    require(abs(sum(weights.values()) - 1) <= TOLERANCE, "weights", f"sum to {sum(weights.values())}")


def check_covariance(sigma: Sequence[Sequence[float]], size: int = 5) -> None:
    m = np.asarray(sigma, float)
    require(m.shape == (size, size), "covariance", f"shape {m.shape}")
    require(bool(np.isfinite(m).all()), "covariance", "not finite")
    require(bool(np.allclose(m, m.T, atol=1e-9)), "covariance", "not symmetric")


def check_simulation(win: float, low: float, high: float, percentiles: Mapping[str, Sequence[float]]) -> None:
    check_range({"win_probability": win, "low": low, "high": high}, 0.0, 1.0, "simulation")
    require(low <= win <= high, "simulation", "the win probability is outside its interval")
    for k, p in percentiles.items():
        require(len(p) == 5 and list(p) == sorted(p), f"percentiles.{k}", "five rising values are wanted")


def check_bins(bins: Mapping[str, str], blocs: Sequence[str]) -> None:
    check_keys(bins, blocs, "delta_bins")
    bad = {k: v for k, v in bins.items() if v not in dims.BINS}
    require(not bad, "delta_bins", f"unknown {bad}")


def check_target(target: float, lo: float = 0.4, hi: float = 0.7) -> None:
    """Either party's threshold lies in this range."""
    check_range({"target": target}, lo, hi, "target")


def check_panel(rows: Sequence[Mapping[str, object]]) -> None:
    """Cells with a cycle, a known bloc and a share in [0, 1], each once."""
    known = {b for names in dims.BLOCS.values() for b in names}
    require(bool(rows), "panel", "empty")
    seen = [(r.get("cycle"), r.get("bloc")) for r in rows]
    require(len(set(seen)) == len(seen), "panel", "repeated cells")
    for r in rows:
        require(r.get("bloc") in known, "panel.bloc", f"unknown {r.get('bloc')}")
        require(isinstance(r.get("cycle"), int) and 1900 <= r["cycle"] <= 2100, "panel.cycle", f"{r.get('cycle')}")
        check_range({str(r["bloc"]): float(r["vote_share"])}, 0.0, 1.0, "panel.vote_share")


def check_moments(mu: Mapping[str, float], sigma: Sequence[Sequence[float]], blocs: Sequence[str] = tuple(dims.BLOCS["race"])) -> None:
    check_keys(mu, blocs, "mu")
    check_range(mu, 0.0, 1.0, "mu")
    check_covariance(sigma, len(blocs))
    require(float(np.linalg.eigvalsh(np.asarray(sigma, float))[0]) >= -1e-8, "covariance", "not positive semi-definite")


def check_layers(layers: Mapping[str, float]) -> None:
    check_keys(layers, ["lambda_1", "lambda_2", "lambda_3"], "layers")
    check_range(layers, 0.0, 1.0, "layers")
    require(abs(sum(layers.values()) - 1) <= TOLERANCE, "layers", f"sum to {sum(layers.values())}")


def check_deltas(deltas: Mapping[str, float], blocs: Sequence[str] = tuple(dims.BLOCS["race"]), most: float = 0.15) -> None:
    check_keys(deltas, blocs, "deltas")
    check_range(deltas, -most, most, "deltas")


def check_sentiment(scores: Mapping[str, Mapping[str, float]]) -> None:
    """Scores in [-1, 1] of known blocs, by platform."""
    known = {b for names in dims.BLOCS.values() for b in names}
    for platform, own in scores.items():
        require(bool(platform), "sentiment", "a platform without a name")
        require(set(own) <= known, f"sentiment.{platform}", f"unknown {sorted(set(own) - known)}")
        check_range(own, -1.0, 1.0, f"sentiment.{platform}")


def check_market(pre: float | None, after: Mapping[str, float | None]) -> None:
    """Probabilities before and 1, 24 and 72 hours after; unknown ones are null."""
    check_keys(after, ["post_shock_1h", "post_shock_24h", "post_shock_72h"], "market")
    check_range({k: v for k, v in {"pre": pre, **after}.items() if v is not None}, 0.0, 1.0, "market")


def check_shock(shock: Mapping[str, object]) -> None:
    """A name, a day, a window that ends after it begins, keywords that are filled."""
    for k in ("id", "date", "description"):
        require(bool(shock.get(k)), f"shock.{k}", "missing")
    require(bool(re.fullmatch(r"\d{4}-\d{2}-\d{2}", str(shock["date"]))), "shock.date", f"{shock['date']}")
    words = shock.get("keywords") or []
    require(all(isinstance(w, str) and w.strip() for w in words), "shock.keywords", "blank")
    window = shock.get("date_window")
    require(not window or str(window["start"]) <= str(window["end"]), "shock.date_window", "ends before it begins")


def check_record(record: Mapping[str, object]) -> None:
    """A training record: its shock, party, bins and intensity."""
    require(bool(record.get("shock_id")), "record.shock_id", "missing")
    require(record.get("party") in ("democrat", "republican"), "record.party", f"{record.get('party')}")
    check_range({"intensity": float(record.get("intensity", 1.0))}, 0.8, 1.2, "record")
    check_bins(record["delta_bins"], [b for names in dims.BLOCS.values() for b in names])


def check_equilibrium(weights: Mapping[str, float], target: float, loyalty: float, met: bool) -> None:
    check_weights(weights)
    check_target(target)
    check_range({"loyalty": loyalty}, 0.0, 1.0, "equilibrium")
    require(met == (loyalty >= target - TOLERANCE), "equilibrium.met", f"{met} at {loyalty} of {target}")


def check_percentiles(percentiles: Mapping[str, Sequence[float]], blocs: Sequence[str] = tuple(dims.BLOCS["race"])) -> None:
    check_keys(percentiles, blocs, "percentiles")
    for k, p in percentiles.items():
        check_range(dict(enumerate(p)), 0.0, 1.0, f"percentiles.{k}")
        require(len(p) == 5 and list(p) == sorted(p), f"percentiles.{k}", "five rising values are wanted")
