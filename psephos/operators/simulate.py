"""Simulation and resampling over partitions."""

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type as pa_type

from psephos.kernels import linalg
from psephos.operators.aggregates import finite
from psephos.operators.sampling import uniform

PERCENTILES = [0.05, 0.25, 0.50, 0.75, 0.95]


def monte_carlo(
    spark: SparkSession, names: Sequence[str], weights: np.ndarray, mu: np.ndarray, target: float, draws: int, seed: int, sigma: np.ndarray | None = None, first_layer: float = 0.114, fixed: float | None = None, parts: int = 16
) -> DataFrame:
    """``name, p05 .. p95, win, win_low, win_high`` from draws of log-ratios around ``weights``.

    ``sigma`` is the covariance of the changes (0.02 squared times the identity
    by default). A win is a weighted mean of at least the target with ``fixed``
    from the other layers (neutral by default). The interval is that of the
    estimated probability, 5 to 95 %.

    Every block of draws has its own seed, so neither the partitioning nor a rerun changes them.
    """
    centre = linalg.log_ratio(weights)
    root = np.linalg.cholesky(linalg.log_ratio_covariance(weights, np.eye(len(weights)) * 0.02**2 if sigma is None else sigma))
    rest = (1 - first_layer) * 0.5 if fixed is None else fixed
    block = -(-draws // parts)

    def run(batches):
        for b in batches:
            for k in b.column(0).to_pylist():
                rng = np.random.default_rng([seed, k])
                z = centre + rng.standard_normal((min(block, draws - k * block), len(centre))) @ root.T
                w = linalg.from_log_ratio(z)
                win = first_layer * (w @ mu) + rest >= target
                for i, name in enumerate(names):
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(w)), pa.array(w[:, i]), pa.array(win.astype(float))], ["name", "w", "win"])

    rows = spark.range(parts, numPartitions=parts).where(F.col("id") * block < draws).mapInArrow(run, "name string, w double, win double")
    p = F.percentile("w", F.array(*[F.lit(x) for x in PERCENTILES]))
    out = rows.groupBy("name").agg(p.alias("p"), F.avg("win").alias("win"))

    @F.pandas_udf("struct<low: double, high: double>")
    def interval(win: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([linalg.win_interval(x, draws, seed) for x in win], columns=["low", "high"])

    shown = [F.get("p", F.lit(i)).alias(f"p{int(x * 100):02d}") for i, x in enumerate(PERCENTILES)]
    return out.withColumn("i", interval("win")).select("name", *shown, "win", F.col("i.low").alias("win_low"), F.col("i.high").alias("win_high"))  # a row for each name


def poisson(rate: float, u, terms: int = 9):
    """A Poisson variate by inversion of a uniform column."""
    out, p = F.lit(0), float(np.exp(-rate))
    acc = p
    for i in range(1, terms):
        out = out + (u > acc).cast("int")
        p *= rate / i
        acc += p
    return out


def bootstrap_covariance(rows: DataFrame, key: str, x: str, y: str, replicates: int, seed: int) -> DataFrame:
    """Mean and deviation over replicates of the sample covariance; the weights of a row come from hashes of its key. Sums combine before the shuffle."""
    reps = rows.select(key, x, y, F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("rep"))
    w = reps.withColumn("w", poisson(1.0, uniform(seed, key, "rep")))
    wx, wy = F.col("w") * F.col(x), F.col("w") * F.col(y)
    sums = w.groupBy("rep").agg(F.sum("w").alias("n"), F.sum(wx).alias("sx"), F.sum(wy).alias("sy"), F.sum(wx * F.col(y)).alias("sxy"))
    cov = (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / (F.col("n") - 1)
    return sums.select(cov.alias("c")).agg(F.round(F.avg("c"), 9).alias("mean"), F.round(F.stddev_samp("c"), 9).alias("std"), F.count("c").alias("replicates"))


def _uniform(key: np.ndarray, replicate: np.ndarray, seed: int) -> np.ndarray:
    """Uniform numbers in (0, 1) of each key and replicate, by rounds of shifts and products of 64 bits."""
    with np.errstate(over="ignore"):
        z = key[:, None] + (replicate[None] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed) * np.uint64(0xD1342543DE82EF95)
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(by)
        z ^= z >> np.uint64(31)
    return ((z >> np.uint64(12)).astype(float) + 0.5) / float(1 << 52)


def _poisson(rate: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Poisson variates by inversion: a row of ``u`` for each rate, which is small."""
    out, p = np.zeros(u.shape), np.exp(-rate)[:, None]
    upto, k = p.copy(), 0
    while (more := u > upto).any() and k < 200:
        k += 1
        out += more
        p = p * rate[:, None] / k
        upto = upto + p
    return out


def bootstrap_matrices(rows: DataFrame, key: Sequence[str], columns: Sequence[str], replicates: int, seed: int, weight: str | None = None, part_rate: float = 4.0) -> DataFrame:
    """``replicate, a, b, cov``: the sample covariance matrix of ``columns`` in each bootstrap replicate.

    A replicate draws about as many rows as there are, each with the same
    chance or in proportion to ``weight`` (its absolute value; null: 0). A row's
    number of draws is a Poisson variate from hashes of its key, the replicate
    and the seed, so no partitioning changes it; a row whose expected number
    exceeds ``part_rate`` is split into parts with variates of their own, whose
    sum has the same law. All replicates of a batch come from one product of
    the numbers of draws with the rows' outer products, and only these sums are
    shuffled. If all weights are 0, all rows have the same chance. Rows with a
    null or infinite value are left out, and so are replicates of under two draws.
    """
    ok = F.lit(True)
    for c in columns:
        ok = ok & finite(F.col(c))
    w = F.coalesce(F.abs(F.col(weight).cast("double")), F.lit(0.0)) if weight else F.lit(1.0)
    known = rows.where(ok).select(F.xxhash64(*key).alias("key"), F.array(*[F.col(c).cast("double") for c in columns]).alias("x"), w.alias("w"))
    total = known.agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"), *[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(len(columns))]).first()
    n, mean = total.n, np.array([total[f"m{i}"] or 0.0 for i in range(len(columns))])
    rate = F.col("w") * (n / total.w) if n and total.w else F.lit(1.0)
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / part_rate)).cast("long")
    chunk = 1 << 16  # a row of most of the weight has many parts
    split = known.withColumn("rate", rate).where("rate > 0").withColumn("parts", parts)
    split = split.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("parts") - 1) / chunk).cast("long"))))
    split = split.withColumn("part", F.explode(F.sequence(F.col("chunk") * chunk, F.least((F.col("chunk") + 1) * chunk, "parts") - 1)))
    split = split.select(F.when(F.col("part") == 0, F.col("key")).otherwise(F.xxhash64("key", "part")).alias("key"), (F.col("rate") / F.col("parts")).alias("rate"), "x")
    k, reps = len(columns), np.arange(replicates, dtype=np.uint64)
    upper = np.triu_indices(k)

    def run(batches):
        sums = np.zeros((replicates, 1 + k + len(upper[0])))
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                t = b.slice(at, 4096)
                x = np.array(t.column(2).to_pylist(), float).reshape(-1, k) - mean  # about the mean no digits are lost
                draws = _poisson(t.column(1).to_numpy(), _uniform(t.column(0).to_numpy().view(np.uint64), reps, seed))
                sums += draws.T @ np.column_stack([np.ones(len(x)), x, x[:, upper[0]] * x[:, upper[1]]])
        yield pa.RecordBatch.from_pydict({"replicate": pa.array(range(replicates), pa.int32()), "sums": sums.tolist()})

    long = split.mapInArrow(run, "replicate int, sums array<double>")
    added = long.groupBy("replicate").agg(*[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(1 + k + len(upper[0]))])
    cells = []
    for place, (i, j) in enumerate(zip(*upper, strict=True)):
        cov = (F.col(f"s{1 + k + place}") - F.col(f"s{1 + i}") * F.col(f"s{1 + j}") / F.col("s0")) / (F.col("s0") - 1)
        cells += [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), cov.alias("cov")) for a, b in {(columns[i], columns[j]), (columns[j], columns[i])}]
    return added.where("s0 >= 2").select("replicate", F.explode(F.array(*cells)).alias("c")).select("replicate", "c.*")


def bootstrap_mean(matrices: DataFrame) -> DataFrame:
    """``a, b, cov, deviation, replicates``: the mean matrix over the replicates and the deviation of its entries."""
    return matrices.groupBy("a", "b").agg(F.avg("cov").alias("cov"), F.stddev_samp("cov").alias("deviation"), F.count("cov").alias("replicates"))


def noise_covariance(spark: SparkSession, deltas: Sequence[float], draws: int, seed: int, noise: float = 0.01, block: int = 10_000) -> np.ndarray:
    """Covariance of one vector under independent Gaussian noise, near ``noise`` squared times the identity: a diagnostic. Blocks of draws have seeds of their own."""
    k = len(deltas)

    def run(batches):
        for b in batches:
            for i in b.column(0).to_pylist():
                z = np.random.default_rng([seed, i]).normal(0, noise, (min(block, draws - i * block), k))
                yield pa.RecordBatch.from_pydict({"sums": [np.concatenate([z.sum(0), (z.T @ z).ravel()]).tolist()]})  # the vector itself moves no covariance

    rows = spark.range(-(-draws // block)).mapInArrow(run, "sums array<double>")
    total = rows.agg(*[F.sum(F.col("sums")[i]) for i in range(k + k * k)]).first()
    s = np.array(total, float)
    return (s[k:].reshape(k, k) - np.outer(s[:k], s[:k]) / draws) / (draws - 1)


def discrepancy(rows: DataFrame, label: str, vector: str, seed: int, features: int = 256, scale: float = 1.0) -> DataFrame:
    """``label, mmd2``: squared distance of the mean random Fourier features of a label from those of all vectors.

    The features approach the RBF kernel, so no pair of vectors is formed.
    """
    first = rows.select(F.size(vector)).first()
    width = first[0] if first else 1
    rng = np.random.default_rng(seed)
    w, shift = rng.normal(0, 1 / scale, (width, features)), rng.uniform(0, 2 * np.pi, features)

    def run(batches):
        sums: dict = {}
        for b in batches:
            if not b.num_rows:
                continue
            x = np.stack([np.asarray(v, float) for v in b.column(1).to_pylist()])
            f = np.sqrt(2 / features) * np.cos(x @ w + shift)
            for k in set(labels := b.column(0).to_pylist()):
                own = f[[v == k for v in labels]]
                n, s = sums.get(k, (0, 0.0))
                sums[k] = n + len(own), s + own.sum(0)
        for k, (n, s) in sums.items():
            yield pa.RecordBatch.from_pydict({"label": [str(k)], "n": [n], "sums": [s.tolist()]})

    parts = rows.where(F.col(vector).isNotNull() & F.col(label).isNotNull()).select(label, vector).mapInArrow(run, "label string, n long, sums array<double>")
    long = parts.select("label", "n", F.posexplode("sums").alias("i", "s"))
    each = long.groupBy("label", "i").agg((F.sum("s") / F.sum("n")).alias("m"))
    total = long.groupBy("i").agg((F.sum("s") / F.sum("n")).alias("all"))
    return each.join(total, "i").groupBy("label").agg(F.round(F.sum((F.col("m") - F.col("all")) ** 2), 9).alias("mmd2"))


def drawn_vectors(rows: DataFrame, key: str, vector: str, most: int, seed: int) -> np.ndarray:
    """The vectors of ``most`` rows with the smallest hashes of their keys."""
    got = rows.where(F.col(vector).isNotNull()).select(F.xxhash64(F.lit(seed), key).alias("h"), F.col(vector).cast("array<double>").alias("v")).orderBy("h", "v").limit(most).collect()
    return np.array([r.v for r in got], float)


def median_scale(x: np.ndarray) -> float:
    """The root of the median squared distance between different vectors; 1 without any."""
    square = (x * x).sum(1) if len(x) else np.zeros(0)
    d = np.maximum(square[:, None] + square[None] - 2 * x @ x.T, 0) if len(x) else np.zeros((0, 0))
    np.fill_diagonal(d, 0)
    d = d[d > 1e-12]
    return float(np.sqrt(np.median(d))) if len(d) else 1.0


def moments_by(rows: DataFrame, keys: Sequence[str], vector: str, shift: np.ndarray) -> DataFrame:
    """``keys, n, sums, gram``: sums of vectors and of their outer products around ``shift`` for each group; a task's part is summed before the shuffle."""
    width = len(shift)

    def run(batches):
        held: dict = {}
        for b in batches:
            if not b.num_rows:
                continue
            x = np.array(b.column(len(keys)).to_pylist(), float).reshape(-1, width) - shift
            of: dict = {}
            for i, k in enumerate(zip(*[b.column(j).to_pylist() for j in range(len(keys))], strict=True) if keys else [()] * len(x)):
                of.setdefault(k, []).append(i)
            for k, at in of.items():
                own = x[at]
                n, s, g = held.get(k, (0, 0.0, 0.0))
                held[k] = n + len(own), s + own.sum(0), g + own.T @ own
        for k, (n, s, g) in held.items():
            yield pa.RecordBatch.from_arrays([*[pa.array([v], t) for v, t in zip(k, types, strict=True)], pa.array([n]), pa.array([s.tolist()]), pa.array([g.ravel().tolist()])], [*keys, "n", "sums", "gram"])

    source = rows.where(F.col(vector).isNotNull()).select(*keys, F.col(vector).cast("array<double>").alias("_v"))
    types = [pa_type(f.dataType) for f in source.schema.fields[: len(keys)]]
    kinds = "".join(f"`{k}` {t}, " for k, t in source.dtypes[: len(keys)])
    parts = source.mapInArrow(run, f"{kinds}n long, sums array<double>, gram array<double>")
    long = parts.select(*keys, "n", F.posexplode(F.concat("sums", "gram")).alias("i", "s")).groupBy(*keys, "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    gathered = long.groupBy(*keys).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "s"))).alias("all"))  # as many entries as a matrix has
    values = F.transform("all", lambda e: e["s"])
    return gathered.select(*keys, "n", F.slice(values, 1, width).alias("sums"), F.slice(values, width + 1, width * width).alias("gram"))


def diagnostics(rows: DataFrame, real: str, label: str, key: str, vector: str, seed: int, least: int = 3, features: int = 2048, sample: int = 512, floor: float = 0.70) -> DataFrame:
    """``label, n, mmd, mmd_weight, lambda, top2, flagged, pcd``: how each label's made vectors stand to the real ones (``real`` true).

    ``mmd`` is the maximum mean discrepancy under an RBF kernel with lambda
    1 / (2 median squared distance of real vectors), which ``sample`` real rows
    drawn by hash tell; the means of random Fourier features approach the
    kernel. ``mmd_weight`` is 0.5 exp(-lambda mmd^2). ``top2`` is the share of a
    label's variance that the first two principal components of the real
    vectors hold, ``flagged`` under ``floor``. ``pcd`` is the Frobenius norm of
    the difference of both correlation matrices over the number of pairs. All
    come from sums over tasks; the driver gets matrices of the vectors' width.
    With fewer than ``least`` real vectors all are null. Null vectors and labels are left out.
    """
    ok = rows.where(F.col(vector).isNotNull() & F.col(label).isNotNull() & F.col(real).isNotNull())
    spark, kind = rows.sparkSession, dict(rows.dtypes)[label]
    schema = f"`{label}` {kind}, n long, mmd double, mmd_weight double, lambda double, top2 double, flagged boolean, pcd double"
    drawn = drawn_vectors(ok.where(real), key, vector, sample, seed)
    first = ok.select(F.size(vector)).first()
    if first is None:
        return spark.createDataFrame([], schema)
    if len(drawn) < least:
        names = "mmd double, mmd_weight double, lambda double, top2 double, flagged boolean, pcd double".split(", ")
        return ok.where(~F.col(real)).groupBy(label).agg(F.count(F.lit(1)).alias("n"), *[F.lit(None).cast(t.split()[1]).alias(t.split()[0]) for t in names])
    width, scale, shift = first[0], median_scale(drawn), drawn.mean(0)
    lam = 1 / (2 * scale**2)
    rng = np.random.default_rng(seed)
    w, phase = rng.normal(0, 1 / scale, (width, features)), rng.uniform(0, 2 * np.pi, features)

    def run(batches):
        held: dict = {}
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                t = b.slice(at, 1024)
                x = np.array(t.column(1).to_pylist(), float).reshape(-1, width)
                f = np.sqrt(2 / features) * np.cos(x @ w + phase)
                of: dict = {}
                for i, g in enumerate(t.column(0).to_pylist()):
                    of.setdefault(g, []).append(i)
                for g, own in of.items():
                    n, s = held.get(g, (0, 0.0))
                    held[g] = n + len(own), s + f[own].sum(0)
        for g, (n, s) in held.items():
            yield pa.RecordBatch.from_pydict({"g": pa.array([g], pa.int32()), "n": [n], "sums": [s.tolist()]})

    # labels are a dimension: numbered, with the real vectors as number -1
    labels = [r[0] for r in ok.where(~F.col(real)).select(label).distinct().orderBy(label).collect()]
    if not labels:
        return spark.createDataFrame([], schema)
    number = spark.createDataFrame(list(enumerate(labels)), f"g int, _label {kind}")
    coded = ok.join(F.broadcast(number), F.col(label) == F.col("_label"), "left").select(F.when(F.col(real), F.lit(-1)).otherwise(F.col("g")).alias("g"), F.col(vector).cast("array<double>").alias("v"))
    sums = coded.select("g", "v").mapInArrow(run, "g int, n long, sums array<double>")
    sums = sums.select("g", "n", F.posexplode("sums").alias("i", "s")).groupBy("g", "i").agg((F.sum("s") / F.sum("n")).alias("m"))
    own, base = sums.where("g >= 0"), sums.where("g = -1").select("i", F.col("m").alias("r"))
    apart = {r.g: r.d for r in own.join(base, "i").groupBy("g").agg(F.sum((F.col("m") - F.col("r")) ** 2).alias("d")).collect()}
    moments = {r.g: r for r in moments_by(coded, ["g"], "v", shift).collect()}

    def covariance(r) -> np.ndarray:
        s = np.array(r.sums)
        return np.array(r.gram).reshape(width, width) / r.n - np.outer(s, s) / r.n**2

    def correlation(c: np.ndarray) -> np.ndarray:
        d = np.sqrt(np.maximum(np.diag(c), 0))
        return np.divide(c, np.outer(d, d), out=np.zeros_like(c), where=np.outer(d, d) > 0)

    truth = covariance(moments[-1])
    top = np.linalg.eigh(truth)[1][:, ::-1][:, :2]
    out = []
    for g, name in enumerate(labels):
        c, mmd = covariance(moments[g]), float(np.sqrt(apart[g]))
        total = float(np.trace(c))
        share = float(np.trace(top.T @ c @ top)) / total if total > 0 else 0.0
        diff = correlation(truth) - correlation(c)
        np.fill_diagonal(diff, 0)
        pcd = float(np.linalg.norm(diff)) / (width * (width - 1)) if width > 1 else 0.0
        out.append((name, moments[g].n, mmd, 0.5 * float(np.exp(-lam * mmd**2)), lam, share, share < floor, pcd))
    return spark.createDataFrame(out, schema)


def scored(rows: DataFrame, key: str, text: str, load: Callable[[], Callable[[Sequence[str]], Sequence[float]]]) -> DataFrame:
    """``key, score``: the model is loaded once in each task and gets whole batches. A null text has a null score."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for s in batches:
            out = pd.Series(np.nan, index=s.index, dtype=float)
            known = s.notna()
            out[known] = list(model(s[known].tolist()))
            yield out

    return rows.select(key, score(F.col(text)).alias("score"))


def with_cache(rows: DataFrame, key: str, cache: DataFrame, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``key, score, hit``: scores of the cache where it has the key, else those ``score`` makes for the rest (``key, score``). Null keys always miss."""
    known = cache.select(F.col(key).alias("_key"), F.col("score").alias("_score"))
    hits = rows.join(known, F.col(key) == F.col("_key")).select(key, F.col("_score").alias("score"), F.lit(True).alias("hit"))
    misses = rows.join(known, F.col(key) == F.col("_key"), "left_anti")
    return hits.unionByName(score(misses).select(key, "score", F.lit(False).alias("hit")))
