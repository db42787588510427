"""Running sums, last known rows, quantiles and as-of joins against plain loops, with hot keys, nulls, ties and repeats."""

import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from psephos.operators import aggregates, ordered, simplex


@pytest.fixture(scope="module")
def cells():
    rng = random.Random(1)
    keys = [("hot", 1)] * 400 + [(rng.choice("abc"), rng.randint(0, 2)) for _ in range(200)] + [(None, 1)] * 30 + [("a", None)] * 20
    return [(*k, i, rng.randint(0, 9) if rng.random() < 0.8 else None, rng.random() if rng.random() < 0.4 else None) for i, k in enumerate(keys)]


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_running_against_a_plain_loop(spark, cells, parts):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.createDataFrame(random.Random(2).sample(cells, len(cells)), "k string, j int, t long, n long, x double")
        got = {r.t: (r.n, r.x, r.n_before, r.x_before) for r in ordered.running(rows.withColumn("y", F.col("x")), ["k", "j"], ["t"], sums=["n"], lasts=["x"]).withColumn("x_before", F.col("y")).collect()}
        total, last = defaultdict(int), {}
        for k, j, t, n, x in cells:
            last[k, j] = x if x is not None else last.get((k, j))
            assert got[t] == (n, last[k, j], total[k, j], x)
            total[k, j] += n or 0
        assert len(got) == len(cells)
        assert ordered.running(rows.limit(0), ["k"], ["t"], sums=["n"]).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_quantiles_against_numpy(spark, cells):
    rows = spark.createDataFrame(cells, "k string, j int, t long, n long, x double")
    got = {r.k: r for r in aggregates.summary(rows, ["k"], "n").collect()}
    for k in {c[0] for c in cells}:
        own = [c[3] for c in cells if c[0] == k and c[3] is not None]
        r = got[k]
        assert (r.n, r.min, r.max) == (len(own), min(own), max(own))
        assert [r.mean, r.std, r.q25, r.q75] == pytest.approx([np.mean(own), np.std(own, ddof=1), *np.percentile(own, [25, 75])])
    nothing = aggregates.summary(spark.createDataFrame([("a", None)], "k string, n double"), ["k"], "n").collect()
    assert [tuple(r) for r in nothing] == [("a", 0, None, None, None, None, None, None)]
    assert ordered.quantiles(rows, [], "x", {"m": 0.5}).first().m == pytest.approx(np.median([c[4] for c in cells if c[4] is not None]))


def test_projection_of_a_large_group(spark):
    rng = random.Random(3)
    rows = [("g", round(rng.uniform(-1, 1), 2)) for _ in range(500)] + [("h", 0.25)] * 4 + [("one", -3.0), ("one", None), (None, 0.5)]
    got = simplex.project(spark.createDataFrame(rows, "k string, v double"), "k", "v").collect()
    own = sorted((r.v for r in got if r.k == "g"), reverse=True)
    count = max(i for i, v in enumerate(own, 1) if v > (sum(own[:i]) - 1) / i)
    theta = (sum(own[:count]) - 1) / count
    for r in got:
        want = {"g": lambda v: max(v - theta, 0), "h": lambda v: 0.25, "one": lambda v: None if v is None else 1.0, None: lambda v: None}[r.k](r.v)
        assert r.w == (None if want is None else pytest.approx(want))
    assert len(got) == len(rows)


@pytest.fixture(scope="module")
def prices():
    rng = random.Random(4)
    points = [("hot", rng.randint(0, 3000), round(rng.random(), 3)) for _ in range(900)] + [(rng.choice("ab"), rng.randint(0, 3000), round(rng.random(), 3)) for _ in range(60)]
    points += [("a", None, 0.5), ("a", 5, None), (None, 5, 0.5), ("late", 2999, 0.7)]
    targets = [(k, t, n) for n, (k, t) in enumerate([("hot", rng.randint(-50, 3100)) for _ in range(300)] + [(rng.choice("abc"), rng.randint(-50, 3100)) for _ in range(60)] + [("late", 5), ("late", 2999), (None, 9), ("a", None), ("a", 70), ("a", 70)])]
    return points, targets


def test_as_of_against_sql(spark, prices):
    points, targets = prices
    p, t = spark.createDataFrame(points, "k string, t long, value double"), spark.createDataFrame(targets, "k string, at long, n int")
    got = {r.n: r.found for r in ordered.as_of(p, t, ["k"]).collect()}
    con = duckdb.connect()
    p.write.mode("overwrite").parquet(at := f"{spark.conf.get('spark.checkpoint.dir')}/points")
    t.write.mode("overwrite").parquet(to := f"{spark.conf.get('spark.checkpoint.dir')}/targets")
    files = [f"read_parquet('{x.removeprefix('file://')}/*.parquet')" for x in (at, to)]
    want = dict(con.sql(f"SELECT n, value FROM {files[1]} t ASOF LEFT JOIN (SELECT k, t, max(value) AS value FROM {files[0]} WHERE value IS NOT NULL GROUP BY ALL) p ON t.k = p.k AND t.at >= p.t").fetchall())
    assert got == want and any(v is None for v in got.values())
    ahead = {r.n: (r.found, r.found_at) for r in ordered.as_of(p, t, ["k"], forward=True).collect()}
    for k, at, n in targets:
        later = [(x, v) for j, x, v in points if j == k and None not in (k, at, x, v) and x >= at]
        first = min((x for x, _ in later), default=None)
        assert ahead[n] == (max((v for x, v in later if x == first), default=None), first)


def test_nearest_until_against_a_plain_loop(spark, prices):
    points, targets = prices
    p, t = spark.createDataFrame(points, "k string, t long, value double"), spark.createDataFrame(targets, "k string, at long, n int")
    got = {r.n: r.found for r in ordered.nearest_until(p, t, ["k"], 24).collect()}
    by = defaultdict(dict)
    for k, x, v in points:
        if None not in (k, x, v):
            by[k][x] = max(v, by[k].get(x, v))
    for k, at, n in targets:
        fit = [x for x in by[k] if at is not None and x <= at] if k else []
        best = min(fit, key=lambda x: (abs(x - (at - 24)), x), default=None)
        assert got[n] == (None if best is None else by[k][best])


def test_empty_sides(spark, prices):
    p, t = spark.createDataFrame(prices[0], "k string, t long, value double"), spark.createDataFrame(prices[1], "k string, at long, n int")
    assert ordered.as_of(p, t.limit(0), ["k"]).count() == 0
    assert {r.found for r in ordered.as_of(p.limit(0), t, ["k"]).collect()} == {None}
