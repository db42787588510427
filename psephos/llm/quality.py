"""Quality by importance resampling.

Target text (labelled as good) and raw text (all documents) each get a
generative model of hashed word n-grams. The logarithm of the ratio of a
document's likelihoods is its importance; Gumbel noise seeded by the row makes
a top-k of importance plus noise a sample without replacement in proportion to
the importance.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from psephos.llm._shared import durable, lean, slices

#: Runs of word characters (any byte of a non-ASCII character is one) or runs of other visible characters.
TOKEN = re.compile(rb"[\w\x80-\xff]+|[^\w\s\x80-\xff]+")


@dataclass(frozen=True)
class Params:
    """``label_rows`` bounds the labelled sample, drawn by a seeded hash of the id.

    ``prior`` n-grams of raw text for each bucket smooth the target model.
    ``errors`` standard errors are added to the estimated share of good
    documents where the budget is not given. ``temper``, off by default,
    divides the importance of a text of over so many n-grams by their number
    over it, so that long texts don't drown out short ones.
    """

    buckets: int = 1 << 16
    label_rows: int = 50_000
    prior: float = 20.0
    errors: float = 2.0
    temper: int | None = None
    seed: int = 3
    slice_bytes: int = 4 << 20


def ngrams(texts: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each word unigram and bigram of the texts, and the number of them in each text."""
    tokens = [TOKEN.findall(t.lower()) for t in texts]
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    crc = zlib.crc32
    one = np.fromiter((crc(w) for ws in tokens for w in ws), np.uint64, int(sizes.sum()))
    last = np.cumsum(sizes)[sizes > 0] - 1
    two = np.zeros(len(one), np.uint64)
    if len(one):
        two[:-1] = one[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ one[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
        two = (two ^ two >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(20)
    pairs = np.ones(len(one), bool)
    pairs[last] = False
    row = np.repeat(np.arange(len(texts)), sizes)
    at = np.concatenate([row, row[pairs]])
    found = np.concatenate([one, two[pairs]]) % np.uint64(buckets)
    order = np.argsort(at, kind="stable")
    return found[order].astype(np.int64), np.bincount(at, minlength=len(texts))


def bucket_counts(rows: DataFrame, p: Params) -> DataFrame:
    """``good, bucket, n`` over rows of ``(good, text)``."""

    def run(batches):
        sums: dict[bool, np.ndarray] = {}
        for b in slices(batches, p.slice_bytes):
            found, sizes = ngrams(b.column(1).to_pylist(), p.buckets)
            good = np.repeat(np.array(b.column(0).to_pylist(), bool), sizes)
            for kind in (False, True):
                sums[kind] = sums.get(kind, 0) + np.bincount(found[good == kind], minlength=p.buckets)
        for kind, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind)), pa.array(at), pa.array(n[at])], ["good", "bucket", "n"])

    return rows.select("good", "text").mapInArrow(lean(run), "good boolean, bucket long, n long").groupBy("good", "bucket").agg(F.sum("n").alias("n"))


def gumbel(seed: int, *key: Column) -> Column:
    """A Gumbel variate that the row's key decides."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *key), 12).cast("double") + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def kth_largest(keys: DataFrame, k: int, bins: int = 4096, few: int = 10_000) -> float:
    """The k-th largest of the column ``key``, exactly, by histograms that close in on it; no sort of all rows."""
    lo, hi, n = keys.agg(F.min("key"), F.max("key"), F.count("key")).first()
    if k <= 0 or not n:
        return float("inf")
    if k >= n:
        return lo
    inside, above = keys, 0
    while True:
        width = (hi - lo) / bins
        if n <= few or width <= 0 or lo + width == lo:
            return sorted((r.key for r in inside.select("key").collect()), reverse=True)[k - above - 1] if width > 0 and n <= few else hi
        at = F.least(F.floor((F.col("key") - lo) / width), F.lit(bins - 1))
        found = {r.bin: r for r in inside.groupBy(at.alias("bin")).agg(F.count("key").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()}
        for b in sorted(found, reverse=True):
            if above + found[b].n >= k:
                lo, hi, n = found[b].lo, found[b].hi, found[b].n
                break
            above += found[b].n
        if lo == hi:
            return hi
        inside = inside.where(F.col("key").between(lo, hi))


def labelled(labels: DataFrame, label_id: str, label_col: str, p: Params) -> DataFrame:
    """``label_id, good`` of the bounded sample; of several labels of a document the lowest counts, null ids and labels are left out."""
    known = labels.select(labels[label_id].alias("label_id"), labels[label_col].alias("q")).where("label_id IS NOT NULL AND q IS NOT NULL")
    known = known.groupBy("label_id").agg((F.min("q") > 0).alias("good"))
    top, n = 1 << 62, known.count()
    drawn = F.pmod(F.xxhash64(F.lit(p.seed), "label_id"), F.lit(top)) < min(top, int(top * (p.label_rows / max(n, 1))))
    return durable(known.where(drawn), "labelled")


def learnt() -> Column:
    """Whether the target model learns from a labelled row; the others judge it."""
    return F.pmod(F.xxhash64(F.lit(1), "label_id"), F.lit(2)) == 1


def log_ratios(docs: DataFrame, sample: DataFrame, id_col: str, text_col: str, p: Params) -> np.ndarray:
    """The logarithm of the target model's probability over the raw one's, for each bucket."""
    text = F.coalesce(docs[text_col].cast("binary"), F.lit(b""))
    rows = docs.select(docs[id_col].alias("id"), text.alias("text"))
    target_ids = F.broadcast(sample.where(F.col("good") & learnt()).select("label_id"))  # label_rows at most
    rows = rows.join(target_ids, rows["id"] == F.col("label_id"), "left").select(F.col("label_id").isNotNull().alias("good"), "text")
    raw, target = np.zeros(p.buckets), np.zeros(p.buckets)
    for r in bucket_counts(rows, p).collect():  # buckets x 2 rows at most
        raw[r.bucket] += r.n
        if r.good:
            target[r.bucket] += r.n
    common = (raw + 0.5) / (raw.sum() + 0.5 * p.buckets)
    wanted = (target + p.prior * p.buckets * common) / (target.sum() + p.prior * p.buckets)
    return np.log(wanted / common)


def importance(docs: DataFrame, ratios: np.ndarray, id_col: str, text_col: str, carry: Sequence[str], p: Params) -> DataFrame:
    """The columns ``carry`` of ``docs`` in a struct ``row``, with ``log_ratio`` and ``gumbel_key``; a text goes through Python once."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)
    kept = [c for c in carry if c != text_col]

    def run(batches):
        for b in slices(batches, p.slice_bytes):
            texts = [t.encode() if isinstance(t, str) else t or b"" for t in b.column(0).to_pylist()]
            found, sizes = ngrams(texts, p.buckets)
            sums = np.concatenate([[0.0], np.cumsum(shared.value[found])])
            ends = np.cumsum(sizes)
            ratio = sums[ends] - sums[ends - sizes]
            if p.temper:
                ratio = ratio * p.temper / np.maximum(sizes, p.temper)
            own = [b.column(0)] * (text_col in carry)
            yield pa.RecordBatch.from_arrays([*own, b.column(1), pa.array(ratio), pa.array(ratio + b.column(2).to_numpy())], [*["text"] * len(own), "row", "log_ratio", "gumbel_key"])

    row = F.struct(*[docs[c] for c in kept]) if kept else F.lit(None).cast("boolean")
    rows = docs.select(docs[text_col].alias("text"), row.alias("row"), gumbel(p.seed, docs[id_col], docs[text_col]).alias("noise"))
    own = f"text {rows.schema['text'].dataType.simpleString()}, " if text_col in carry else ""
    scored = rows.mapInArrow(lean(run), schema_of(own, rows))
    back = [F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in carry]
    return durable(scored.select(F.struct(*back).alias("row"), "log_ratio", "gumbel_key"), "scored")


def schema_of(own: str, rows: DataFrame) -> T.StructType:
    found = T.StructType.fromDDL(own.rstrip(", ")) if own else T.StructType()
    return found.add("row", rows.schema["row"].dataType).add("log_ratio", "double").add("gumbel_key", "double")


def resample(
    docs: DataFrame, labels: DataFrame, k: int | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", label_id: str = "doc_id",
    carry: Sequence[str] | None = None, p: Params = Params(),  # noqa: B008
) -> DataFrame:
    """The columns ``carry`` of ``docs`` (all by default) with ``log_ratio``, ``gumbel_key`` and ``selected``: the ``k`` rows with the largest keys.

    ``log_ratio`` is the log-likelihood of the text under the target model less
    that under the raw one. Without ``k`` the budget is as many documents as
    are good by the labelled sample: their share, and ``errors`` standard errors
    more, so as rather to keep a document. Without labels of both kinds every
    row is selected.

    Null and empty texts have ratio 0. Labels with a null id or value are left
    out; of several labels of a document the lowest counts. Ties at the k-th
    key are all selected. Columns of ``docs`` named like the results are
    replaced; any other name may occur. Repeated rows get equal keys. An empty
    table gives an empty result.
    """
    added = ("log_ratio", "gumbel_key", "selected")
    carry = [c for c in (docs.columns if carry is None else carry) if c not in added]
    sample = labelled(labels, label_id, label_col, p)
    scored = importance(docs, log_ratios(docs, sample, id_col, text_col, p), id_col, text_col, carry, p)
    if k is None:
        good, known = (x or 0 for x in sample.agg(F.count_if("good"), F.count(F.lit(1))).first())
        share = good / known if known else 1.0
        share = 1.0 if good in (0, known) else min(1.0, share + p.errors * (share * (1 - share) / known) ** 0.5)
        k = round(share * scored.count())
    cut = kth_largest(scored.select(F.col("gumbel_key").alias("key")), k)
    return scored.select("row.*", "log_ratio", "gumbel_key", (F.col("gumbel_key") >= cut).alias("selected"))


def label_report(resampled: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", label_id: str = "doc_id", p: Params = Params()) -> DataFrame:  # noqa: B008
    """``good, rows, kept``: of the labelled rows that the target model has not seen, how many there are and how many were selected."""
    sample = labelled(labels, label_id, label_col, p).where(~learnt())
    rows = resampled.select(resampled[id_col].alias("_of"), "selected").join(F.broadcast(sample), F.col("_of") == F.col("label_id"))
    return rows.groupBy("good").agg(F.count(F.lit(1)).alias("rows"), F.count_if("selected").alias("kept"))
