"""From surveys to a simulated coalition: panel, moments, shock, weights, draws. Tables stay in Spark; the driver gets five-vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from psephos import dims
from psephos.functions import scalars
from psephos.kernels import linalg
from psephos.operators import aggregates, relational, simulate

# Weights of the race, religion and gender layers.
LAYERS = (0.114, 0.224, 0.662)


@dataclass(frozen=True)
class Moments:
    """Mean loyalty and covariance of the race blocs, means of the other blocs, and the target share."""

    mu: np.ndarray
    sigma: np.ndarray
    fixed: dict[str, float]
    target: float


def build_panel(*sources: DataFrame) -> DataFrame:
    """``cycle, bloc, vote_share, se, source`` of all sources merged by inverse standard errors, imputed and validated; a row for a cycle and bloc, so it is kept in memory for its many readers."""
    merged = aggregates.inverse_se_merge(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources))
    full = relational.impute(merged).persist()
    return relational.validate(relational.assert_unique(full, ["cycle", "bloc", "source"]), ["cycle", "bloc", "vote_share"], "panel")


def winning_cycles(spark: SparkSession, party: str) -> DataFrame:
    won = F.col("truth") > 0.5
    return dims.cycles(spark).where(won if party == "democrat" else ~won).select("cycle")


def elector_majority_share(party: str = "democrat") -> float:
    """The two-party share at which the electors are won as often as not."""
    share = np.array(list(dims.TWO_PARTY_SHARE.values()))
    won = np.array([c in dims.ELECTORS_WON for c in dims.TWO_PARTY_SHARE], float)
    t = linalg.threshold(share, won)
    return t if party == "democrat" else 1 - t


def estimate_moments(panel: DataFrame, party: str = "democrat") -> Moments:
    """Means over won cycles and the pairwise covariance over all; absent blocs count 0.5."""
    spark, race = panel.sparkSession, dims.BLOCS["race"]
    third = dims.small(dims.blocs(spark).select("bloc", "third_party_1992"))
    share = scalars.two_party(F.col("vote_share"), F.col("cycle"), F.col("third_party_1992"))
    share = share if party == "democrat" else 1 - share
    rows = panel.join(third, "bloc").select("cycle", "bloc", share.alias("x")).groupBy("cycle", "bloc").agg(F.avg("x").alias("x"))
    won = rows.join(dims.small(winning_cycles(spark, party)), "cycle", "left_semi").groupBy("bloc").agg(F.avg("x").alias("mu"))
    mu = {r.bloc: r.mu for r in won.collect()}  # fifteen blocs
    cov = {(r.a, r.b): r["cov"] for r in aggregates.pairwise_covariance(rows.where(F.col("bloc").isin(race)), "cycle", "bloc", "x").collect()}
    sigma = linalg.nearest_psd(np.array([[cov.get((a, b), 0.0) for b in race] for a in race]))
    rest = [b for s in ("religion", "gender") for b in dims.BLOCS[s]]
    return Moments(np.array([mu.get(b, 0.5) for b in race]), sigma, {b: mu.get(b, 0.5) for b in rest}, elector_majority_share(party))


def delta_covariance(panel: DataFrame, least: int = 3) -> np.ndarray | None:
    """Shrunk covariance of changes between consecutive cycles in which all race blocs are known; null under three changes."""
    race = dims.BLOCS["race"]
    wide = aggregates.pivot_mean(panel.where(F.col("bloc").isin(race)), "cycle", "bloc", race, "vote_share").dropna().orderBy("cycle")
    x = np.array([[r[b] for b in race] for r in wide.collect()])  # a row for each cycle
    return linalg.shrunk_covariance(np.diff(x, axis=0))[0] if len(x) > least else None


def calibrate_layers(panel: DataFrame, start: tuple = (0.5, 0.3, 0.2)) -> tuple[np.ndarray, int]:
    """Layer weights that explain past results by the strata's means."""
    spark = panel.sparkSession
    blocs = dims.small(dims.blocs(spark).select("bloc", "stratum", "share"))
    means = panel.join(blocs, "bloc").groupBy("cycle").pivot("stratum", list(dims.BLOCS)).agg(aggregates.weighted_mean(F.col("vote_share"), F.col("share")))
    # cycles without all strata or a known result have no say
    rows = means.join(dims.small(dims.cycles(spark)), "cycle").dropna().orderBy("cycle").collect()
    s = np.array([[r[k] for k in dims.BLOCS] for r in rows]).reshape(-1, 3)
    return linalg.layer_weights(s, np.array([r.truth for r in rows]), np.array(start))


def effective_loyalty(weights: np.ndarray, m: Moments, layers: tuple = LAYERS) -> float:
    mean = lambda s: float(np.mean([m.fixed[b] for b in dims.BLOCS[s]]))
    return float(np.clip(layers[0] * weights @ m.mu + layers[1] * mean("religion") + layers[2] * mean("gender"), 0, 1))


def shifted(mu: np.ndarray, deltas: dict[str, str], intensity: float = 1.0) -> np.ndarray:
    """Means moved by the midpoints of delta bins, clipped to [0.01, 0.99]."""
    middle = dict(zip(dims.BINS, dims.MIDPOINTS, strict=True))
    move = np.array([np.clip(middle[deltas.get(b, "neutral")] * intensity, -0.15, 0.15) for b in dims.BLOCS["race"]])
    return np.clip(mu + move, 0.01, 0.99)


def run_shock(spark: SparkSession, m: Moments, deltas: dict[str, str], intensity: float = 1.0, draws: int = 10_000, seed: int = 7, changes: np.ndarray | None = None) -> Iterator[tuple[str, dict]]:
    """The stages of one event in order: deltas, equilibrium, simulation, done; an error ends it with ``stream_error`` and ``done``.

    ``changes`` is the covariance of past changes (``delta_covariance``) that the draws spread by.
    """
    race = dims.BLOCS["race"]
    try:
        mu = shifted(m.mu, deltas, intensity)
        yield "deltas", {"mu_shifted": dict(zip(race, mu.tolist(), strict=True))}
        w = linalg.max_sharpe(m.sigma + 1e-9 * np.eye(len(race)), mu, m.target)
        met = LAYERS[0] * float(w @ mu) + (1 - LAYERS[0]) * 0.5 >= m.target
        yield "equilibrium", {"weights": dict(zip(race, w.tolist(), strict=True)), "target": m.target, "target_met": bool(met)}
        rows = simulate.monte_carlo(spark, race, w, mu, m.target, draws, linalg.derive_seed(seed, "monte_carlo"), sigma=changes).collect()  # five rows
        yield "simulation", {"win_probability": rows[0].win, "low": rows[0].win_low, "high": rows[0].win_high, "percentiles": {r.name: [r.p05, r.p25, r.p50, r.p75, r.p95] for r in rows}}
    except Exception as e:  # the stream tells its reader
        yield "stream_error", {"message": str(e)}
    yield "done", {}


def shock_on_panel(panel: DataFrame, deltas: dict[str, str], party: str = "democrat", intensity: float = 1.0, draws: int = 10_000, seed: int = 7) -> Iterator[tuple[str, dict]]:
    """``run_shock`` with the moments of a panel, its draws spread by the panel's own past changes where there are enough of them."""
    yield from run_shock(panel.sparkSession, estimate_moments(panel, party), deltas, intensity, draws, seed, delta_covariance(panel))


def sensitivity(spark: SparkSession, m: Moments, deltas: dict[str, str], seed: int = 7, draws: int = 10_000, changes: np.ndarray | None = None) -> list[tuple[float, float]]:
    """Win probability for intensities from 0.5 to 2 in steps of 0.25; ``changes`` as in ``run_shock``."""
    out = []
    for i in np.arange(0.5, 2.01, 0.25):
        found = dict(run_shock(spark, m, deltas, float(i), draws, seed, changes))
        out.append((float(i), found["simulation"]["win_probability"]))
    return out


def moment_report(spark: SparkSession, m: Moments, benchmarks: DataFrame, threshold: float = 0.05) -> DataFrame:
    """``bloc, stratum, estimated, benchmark, delta, flag`` in the order of the blocs: ``ok``, ``WARN`` over the threshold, ``ALERT`` over twice it, ``MISSING`` without an estimate.

    ``benchmarks`` has ``bloc, benchmark``.
    """
    known = dict(zip(dims.BLOCS["race"], m.mu.tolist(), strict=True)) | m.fixed
    rows = spark.createDataFrame([(b, float(x)) for b, x in known.items() if np.isfinite(x)], "bloc string, estimated double")
    found = dims.blocs(spark).select("bloc", "stratum", "ord").join(rows, "bloc", "left").join(benchmarks.select("bloc", "benchmark"), "bloc", "left")
    delta = F.col("estimated") - F.col("benchmark")
    flag = F.when(F.col("estimated").isNull(), "MISSING").when(F.abs(delta) > 2 * threshold, "ALERT").when(F.abs(delta) > threshold, "WARN").otherwise("ok")
    return found.select("bloc", "stratum", "estimated", "benchmark", delta.alias("delta"), flag.alias("flag"), "ord").orderBy("ord").drop("ord")


def spectrum_report(spark: SparkSession, m: Moments) -> DataFrame:
    """``bloc, variance, eigenvalue, share, condition``: the race blocs' variances beside the eigenvalues of their covariance in falling order, each one's share of the trace, and the condition number (null if the least is not over 0)."""
    values = np.linalg.eigvalsh(m.sigma)[::-1]
    condition = float(values[0] / values[-1]) if values[-1] > 0 else None
    trace = float(values.sum())
    rows = [(b, float(m.sigma[i, i]), float(values[i]), float(values[i]) / trace if trace > 0 else None, condition) for i, b in enumerate(dims.BLOCS["race"])]
    return spark.createDataFrame(rows, "bloc string, variance double, eigenvalue double, share double, condition double")
