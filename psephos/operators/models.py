"""Models fitted by group: leave-one-out folds of a Gaussian process, and ridge regressions from sums."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from psephos import dims
from psephos.functions import scalars
from psephos.kernels import linalg
from psephos.operators import aggregates, ordered
from psephos.session import written

# Penalties tried for ridge regressions, and the least number of points.
PENALTIES = (0.01, 0.05, 0.1, 0.5, 1.0, 5.0, 10.0, 50.0, 100.0)
LEAST = 3


def cycle_features(panel: DataFrame, party: str = "democrat", with_year: bool = True, with_strata: bool = True) -> DataFrame:
    """``party, cycle, x, won`` of a panel ``cycle, bloc, vote_share``: what a model of wins knows of each cycle.

    Features are the mean two-party shares of the race blocs, the place of the
    cycle in the panel's span (0 to 1), and for each stratum the mean weighted
    by the electorate's shares over the blocs that the cycle has. A missing
    feature is the mean of the other cycles, 0 where no cycle has it.
    """
    spark = panel.sparkSession
    blocs = dims.small(dims.blocs(spark).select("bloc", "stratum", "share", "third_party_1992"))
    two_party = scalars.two_party(F.col("vote_share"), F.col("cycle"), F.col("third_party_1992"))
    rows = panel.where("cycle IS NOT NULL AND vote_share IS NOT NULL").join(blocs, "bloc").select("cycle", "bloc", "stratum", "share", (two_party if party == "democrat" else 1 - two_party).alias("y"))
    race = dims.BLOCS["race"]
    parts = [aggregates.pivot_mean(rows, "cycle", "bloc", race, "y")]
    names = list(race)
    if with_strata:
        strata = rows.groupBy("cycle").pivot("stratum", list(dims.BLOCS)).agg(aggregates.weighted_mean(F.col("y"), F.col("share")))
        parts.append(strata)
        names += list(dims.BLOCS)
    wide = parts[0]
    for p in parts[1:]:
        wide = wide.join(p, "cycle", "full_outer")
    if with_year:
        span = rows.agg(F.min("cycle").alias("_first"), F.greatest(F.max("cycle") - F.min("cycle"), F.lit(1)).alias("_span"))
        wide = wide.crossJoin(F.broadcast(span)).withColumn("_year", (F.col("cycle") - F.col("_first")) / F.col("_span")).drop("_first", "_span")  # one row
        names.append("_year")
    known = dims.small(dims.cycles(spark).select("cycle", (F.col("truth") > 0.5).alias("_dem")))
    won = F.col("_dem") if party == "democrat" else ~F.col("_dem")
    rows = wide.join(known, "cycle").select(F.lit(party).alias("party"), "cycle", won.cast("double").alias("won"), *names)
    return vectors(rows, ["party"], "cycle", "won", names)


def vectors(rows: DataFrame, keys: Sequence[str], unit: str, label: str, names: Sequence[str]) -> DataFrame:
    """``keys, unit, x, label``: the features as an array of doubles; a missing one is its group's mean, 0 where the group has none."""
    means = rows.groupBy(*keys).agg(*[F.avg(n).alias(f"_mean_{n}") for n in names])
    both = ordered.same(rows, means, keys)
    x = F.array(*[F.coalesce(F.col(n).cast("double"), F.col(f"_mean_{n}"), F.lit(0.0)) for n in names])
    return both.select(*keys, unit, x.alias("x"), label)


def left_out(rows: DataFrame, keys: Sequence[str], unit: str, label: str, noise: float = 0.10) -> DataFrame:
    """``keys, unit, label, prob, deviation`` of ``rows (keys, unit, x, label)``: what a Gaussian process says of each unit that has seen the group's other units only.

    Folds are joined to the rows of their group and fitted side by side in a
    grouped map: a group of n units makes n fits of n - 1 rows. Units are a
    dimension (cycles, months), so a fold is small; rows of a unit should be
    one. Features are standardised over the group. Where all others have one
    label, or there are fewer than two, ``prob`` is null.
    """
    folds = rows.select(*keys, F.col(unit).alias("fold")).distinct()
    joined = ordered.same(rows.where(F.col(label).isNotNull()), folds, keys)
    kinds = dict(rows.dtypes)

    def fit(table: pd.DataFrame) -> pd.DataFrame:
        x, y = np.array(table["x"].tolist(), float), table[label].to_numpy(float)
        spread = x.std(0)
        x = (x - x.mean(0)) / np.where(spread > 0, spread, 1.0)
        held = (table[unit] == table["fold"]).to_numpy()
        prob = deviation = None
        if (~held).sum() > 1 and y[~held].std() > 0:
            order = np.argsort(table[unit].to_numpy()[~held], kind="stable")  # the same sums whatever the rows' order
            mean, dev = linalg.gaussian_process(x[~held][order], y[~held][order], x[held], noise)
            prob, deviation = np.clip(mean, 0, 1), dev
        out = table.loc[held, [*keys, unit, label]].copy()
        out["prob"], out["deviation"] = prob, deviation
        return out

    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in [*keys, unit, label]], "prob double", "deviation double"])
    return joined.groupBy(*keys, "fold").applyInPandas(fit, schema)


def fold_scores(folds: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """``keys, folds, accuracy, brier`` over the folds with a probability."""
    hit = ((F.col("prob") >= 0.5) == (F.col(label) > 0.5)).cast("double")
    ok = F.col("prob").isNotNull()
    return folds.groupBy(*keys).agg(F.count_if(ok).alias("folds"), F.avg(F.when(ok, hit)).alias("accuracy"), F.avg((F.col("prob") - F.col(label)) ** 2).alias("brier"))


def wide_scores(scores: DataFrame, targets: DataFrame, keys: Sequence[str], unit: str, sources: Sequence[str], source: str = "source", score: str = "score", target: str = "delta") -> DataFrame:
    """``keys, unit, one column a source, target``: mean scores beside what was observed; units without a known target are left out, and a missing score is 0."""
    ok = targets.where(aggregates.finite(F.col(target))).groupBy(*keys, unit).agg(F.avg(target).alias(target))
    pivoted = scores.groupBy(*keys, unit).pivot(source, list(sources)).agg(F.avg(F.when(aggregates.finite(F.col(score)), F.col(score))))
    joined = ok.join(pivoted, [*keys, unit], "left")
    return joined.select(*keys, unit, *[F.coalesce(F.col(f"`{s}`"), F.lit(0.0)).alias(s) for s in sources], target)


def ridge_by_group(rows: DataFrame, keys: Sequence[str], names: Sequence[str], target: str, penalties: Sequence[float] = PENALTIES, least: int = LEAST) -> DataFrame:
    """``keys, n, penalty, intercept, coefficients, cv_r2``: a ridge regression for each group, its penalty chosen by leave-one-out error.

    A group of any size: its sums of outer products combine before the shuffle,
    a grouped map solves the small systems of all penalties, and the errors
    that leaving out each row would make follow from the row and its group's
    solution in closed form, and are summed. ``cv_r2`` is 1 less their squares'
    share of the target's. Groups with fewer than ``least`` rows get nulls; the
    smaller penalty wins ties. Features and the target must be known and finite (``wide_scores``).
    """
    k = len(names)
    v = [*names, target]
    pairs = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
    # sums around each group's means, which lose no digits
    means = written(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.avg(c).alias(f"_m{i}") for i, c in enumerate(v)]), "means")
    centred = ordered.same(rows, means, keys).select(*keys, "_n", *[F.col(f"_m{i}") for i in range(k + 1)], *[(F.col(c) - F.col(f"_m{i}")).alias(f"_d{i}") for i, c in enumerate(v)])
    sums = centred.groupBy(*keys, "_n", *[f"_m{i}" for i in range(k + 1)]).agg(*[F.sum(F.col(f"_d{i}") * F.col(f"_d{j}")).alias(f"_s{i}_{j}") for i, j in pairs])
    kinds = dict(rows.dtypes)

    def solve(batches):
        for t in batches:
            out = []
            for r in t.to_dict("records"):
                s = np.zeros((k + 1, k + 1))
                for i, j in pairs:
                    s[i, j] = s[j, i] = r[f"_s{i}_{j}"]
                for a in penalties:
                    inverse = np.linalg.inv(s[:k, :k] + a * np.eye(k))
                    w = inverse @ s[:k, k]
                    out.append({c: r[c] for c in keys} | {"penalty": a, "w": w.tolist(), "inverse": inverse.ravel().tolist(), "spread": s[k, k]})
            yield pd.DataFrame(out, columns=[*keys, "penalty", "w", "inverse", "spread"])

    key_kinds = "".join(f"`{c}` {kinds[c]}, " for c in keys)
    fits = written(sums.where(F.col("_n") >= least).mapInPandas(solve, key_kinds + "penalty double, w array<double>, inverse array<double>, spread double"), "fits")
    joined = ordered.same(centred, fits, keys)  # a row for each penalty
    d = [F.col(f"_d{i}") for i in range(k)]
    fitted = sum((F.col("w")[i] * d[i] for i in range(k)), F.lit(0.0))
    leverage = sum((F.col("inverse")[i * k + j] * d[i] * d[j] for i in range(k) for j in range(k)), F.lit(0.0)) + 1 / F.col("_n")
    error = (F.col(f"_d{k}") - fitted) / F.greatest(1 - leverage, F.lit(1e-9))
    errors = joined.groupBy(*keys, "penalty").agg(F.sum(error * error).alias("press"))
    best = errors.groupBy(*keys).agg(F.min(F.struct("press", "penalty")).alias("b"))
    chosen = ordered.same(fits, best, keys).where("penalty = b.penalty")
    found = ordered.same(means, chosen.select(*keys, "penalty", "w", F.col("b.press").alias("press"), "spread"), keys, "left")
    intercept = F.col(f"_m{k}") - sum((F.col("w")[i] * F.col(f"_m{i}") for i in range(k)), F.lit(0.0))
    r2 = F.when(F.col("spread") > 0, 1 - F.col("press") / F.col("spread"))
    named = F.when(F.col("w").isNotNull(), F.create_map(*[x for i, c in enumerate(names) for x in (F.lit(c), F.col("w")[i])]))
    return found.select(*keys, F.col("_n").alias("n"), "penalty", intercept.alias("intercept"), named.alias("coefficients"), r2.alias("cv_r2"))


def predicted(rows: DataFrame, fits: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """``rows`` with ``predicted`` by the fit of their group; null where it has none. A missing feature counts 0."""
    joined = ordered.same(rows, fits.select(*keys, F.col("intercept").alias("_i"), F.col("coefficients").alias("_c")), keys, "left")
    value = F.col("_i") + sum((F.coalesce(F.col(c), F.lit(0.0)) * F.col("_c")[c] for c in names), F.lit(0.0))
    return joined.withColumn("predicted", value).drop("_i", "_c")
