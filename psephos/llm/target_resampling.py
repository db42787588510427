"""Importance resampling towards a target: array-scored weights, a cut found by bisection, ranks from ranges of rows."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from psephos.llm._shared import added_up, durable, id_and_text, slices

#: Bytes as words see them: A-Z lower-cased, digits, a-z and all bytes over 127 kept, the rest blank.
FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
#: Bytes of a text that are taken apart at once.
WINDOW = 1 << 20
#: Points at which one count job tries the cut: four halvings of the range.
POINTS = 15


def word_windows(text: bytes, window: int = WINDOW) -> Iterator[list[bytes]]:
    """The words of a text, a list for each window of it; windows end between words."""
    at = 0
    while at < len(text):
        end = at + window
        folded = text[at:end].translate(FOLDED)
        while end < len(text) and folded[-1] != 32:  # on to the next blank
            folded += text[end : end + window].translate(FOLDED)
            end += window
            if (cut := folded.find(b" ", window)) >= 0:
                folded, end = folded[: cut + 1], at + cut + 1
        yield folded.split()
        at = end


def bucketed(text: bytes, buckets: int, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """The number of words and the buckets of the features of each window; runs of words go on over windows."""
    carried: list[bytes] = []
    for words in word_windows(text):
        features = list(words)
        held = carried + words
        for k in range(2, longest + 1):
            first = max(0, len(carried) - k + 1)
            features += [b" ".join(held[i : i + k]) for i in range(first, len(held) - k + 1)]
        carried = held[max(0, len(held) - longest + 1) :]
        yield len(words), np.fromiter(map(zlib.crc32, features), np.int64, len(features)) % buckets


def bucket_counts(docs: DataFrame, text_col: str, buckets: int, longest: int) -> np.ndarray:
    """How many features of all texts fall in each bucket."""
    texts = docs.select(F.coalesce(docs[text_col].cast("binary"), F.lit(b"")).alias("text"))

    def run(batches):
        sums = np.zeros(buckets)
        for b in slices(batches, WINDOW):
            for text in b.column(0).to_pylist():
                for _, x in bucketed(text, buckets, longest):
                    sums += np.bincount(x, minlength=buckets)
        yield pa.RecordBatch.from_pydict({"n": [int(sums.sum())], "sums": [sums.tolist()]})

    total = added_up(texts.mapInArrow(run, "n long, sums array<double>"))[1]
    return np.zeros(buckets) if total is None else total


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log-ratio of the two smoothed bucket models, rounded down."""
    n, total_raw, total_target = len(raw), float(raw.sum()), float(target.sum())
    ratio = [(t + 1.0) * (total_raw + n) / ((s + 1.0) * (total_target + n)) for s, t in zip(raw.tolist(), target.tolist(), strict=True)]
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def scored(docs: DataFrame, gains: np.ndarray, id_col: str, text_col: str, longest: int, seed: int) -> DataFrame:
    """``id, n_words, n_features, weight, score``: the features' gains by array lookup, and the weight moved by the id's Gumbel variate."""

    def run(batches):
        for b in slices(batches, WINDOW):
            out: list[list] = [[], [], [], []]
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = features = weight = 0
                for k, x in bucketed(text, len(gains), longest):
                    words, features, weight = words + k, features + len(x), weight + int(gains[x].sum())
                h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
                score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
                for column, value in zip(out, (words, features, weight, score), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int64()) for c in out]], ["id", "n_words", "n_features", "weight", "score"])

    return id_and_text(docs, id_col, text_col).select(F.col("id").cast("long").alias("id"), "text").mapInArrow(run, "id long, n_words long, n_features long, weight long, score long")


def cutoff(rows: DataFrame, keys: list[str], copies: str, want: int) -> tuple[list[int], int] | None:
    """The keys of the last of the first ``want`` rows in the order of ``keys`` (whole numbers), and how many rows with just these keys belong to them.

    A row counts ``copies`` times. The first key's cut is found by bisection:
    each job counts the rows up to some points of the range exactly, which
    narrows it to one value; rows that tie there are cut by the next key in the
    same way. Nothing is sorted or collected. Null for no rows wanted.
    """
    if want < 1:
        return None
    here, found = rows, []
    for key in keys:
        low, high = here.agg(F.min(key), F.max(key)).first()
        while low < high:
            step = max(1, (high - low) // (POINTS + 1))
            points = [p for k in range(1, POINTS + 1) if (p := low + k * step - 1) < high]
            upto = here.agg(*[F.coalesce(F.sum(F.when(F.col(key) <= p, F.col(copies))), F.lit(0)) for p in points]).first()
            enough = [p for p, n in zip(points, upto, strict=True) if n >= want]
            short = [p for p, n in zip(points, upto, strict=True) if n < want]
            low, high = (max(short) + 1 if short else low), (min(enough) if enough else high)
        want -= here.where(F.col(key) < low).agg(F.coalesce(F.sum(copies), F.lit(0))).first()[0]
        here = here.where(F.col(key) == low)
        found.append(low)
    return found, want


def up_to(keys: list[str], cut: list[int]) -> Column:
    """Rows up to the cut, with those that have its very keys."""
    before, same = F.lit(False), F.lit(True)
    for k, v in zip(keys, cut, strict=True):
        before = before | (same & (F.col(k) < v))
        same = same & (F.col(k) == v)
    return before | same


def ranged(rows: DataFrame, keys: list[str], copies: str, tasks: int) -> DataFrame:
    """``rows`` with ``first``, the rank of a row's first copy: ranges of the order are sorted one a task, and the copies of earlier ranges added."""

    def run(batches):
        n = 0
        for b in batches:
            own = b.column(b.schema.get_field_index(copies)).to_numpy()
            upto = n + np.cumsum(own)
            n = int(upto[-1]) if len(upto) else n
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(upto - own + 1, pa.int64())], [*b.schema.names, "first"])

    sorted_rows = rows.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id())
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sorted_rows.schema)
    placed = durable(sorted_rows.mapInArrow(run, f"{kinds}, first long"), "ranges")
    sizes = placed.groupBy("part").agg(F.sum(copies).alias("n"))  # a row for each of ``tasks`` ranges
    starts = sizes.select(F.col("part").alias("of"), F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    return placed.join(starts, F.col("part") == F.col("of")).withColumn("first", F.col("first") + F.col("start")).drop("part", "of", "start")


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text",
    percent: int = 10, least_words: int = 20, longest: int = 1, buckets: int = 10_000, seed: int = 2024, rows_each: int = 1_000_000,
) -> DataFrame:
    """``id, n_words, n_features, weight, score, rank``: of the documents with ``least_words`` words, the ``percent`` with the highest scores get a rank.

    Features are runs of 1 to ``longest`` words. A bucket's gain compares its
    share of the target's features with that of all documents; a document's
    weight sums the gains of its features, and a Gumbel variate from its id
    makes the score, so that the highest are a draw without replacement. Two
    narrow passes read the texts; what is written and counted is five numbers a
    document. The cut is found by counting jobs (``cutoff``), and only drawn
    rows are put in order, in ranges of ``rows_each``, 10,000 ranges at most.

    Ids are whole numbers, and smaller ones win ties. A null id counts as the
    empty text and comes last in ties. Rows that repeat id and score are equal:
    they are counted once with their number and get ranks one after the other.
    A null text has no features. An empty table gives an empty result, and an
    empty target leaves weights to the documents alone.
    """
    gains = bucket_gains(bucket_counts(docs, text_col, buckets, longest), bucket_counts(target, target_text, buckets, longest))
    each = scored(docs, gains, id_col, text_col, longest, seed)
    counted = each.groupBy("id", "n_words", "n_features", "weight", "score").agg(F.count(F.lit(1)).alias("copies"))
    order = {"by_score": -F.col("score"), "no_id": F.col("id").isNull().cast("long"), "by_id": F.coalesce("id", F.lit(0)).cast("long"), "by_size": F.col("n_features")}
    rows, keys = durable(counted.withColumns(order), "importance-scores"), list(order)
    fit = rows.where(F.col("n_words") >= least_words)
    n = fit.agg(F.sum("copies")).first()[0] or 0
    cut = cutoff(fit, keys, "copies", percent * n // 100)
    if cut is None:
        all_rows = rows.withColumns({"first": F.lit(None).cast("long"), "drawn": F.lit(0).cast("long")})
    else:
        inside = (F.col("n_words") >= least_words) & up_to(keys, cut[0])
        last = F.lit(True)
        for k, v in zip(keys, cut[0], strict=True):
            last = last & (F.col(k) == v)
        taken = rows.where(inside).withColumn("drawn", F.when(last, F.lit(cut[1])).otherwise(F.col("copies")))
        tasks = min(10_000, -(-(percent * n // 100) // rows_each))
        rest = rows.where(~inside).withColumns({"drawn": F.lit(0).cast("long"), "first": F.lit(None).cast("long")})
        all_rows = ranged(taken, keys, "drawn", tasks).unionByName(rest)
    chunk = 1 << 16  # copies of one row come in chunks, which other tasks can take
    chunks = all_rows.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / chunk).cast("long"))))
    if (rows.agg(F.max("copies")).first()[0] or 0) > chunk:
        chunks = chunks.repartition("id", "score", "chunk")
    each = chunks.withColumn("copy", F.explode(F.sequence(F.col("chunk") * chunk, F.least((F.col("chunk") + 1) * chunk, "copies") - 1)))
    return each.select("id", "n_words", "n_features", "weight", "score", F.when(F.col("copy") < F.col("drawn"), F.col("first") + F.col("copy")).alias("rank"))


#: The same rows in SQL, for documents with distinct ids.
ORACLE_SQL = r"""
WITH t(crcs) AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END))),
d AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents),
b AS (
  SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
words AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM d UNION SELECT w FROM b)),
hashed AS (
  SELECT w, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
         lambda c, y: xor(c >> 8, crcs[(xor(c, y) & 255) + 1]))) % 10000 AS bucket FROM words, t),
df AS (SELECT doc_id, bucket FROM d JOIN hashed USING (w)),
s AS (SELECT bucket, count(*) AS s FROM df GROUP BY 1),
tg AS (SELECT bucket, count(*) AS t FROM b JOIN hashed USING (w) GROUP BY 1),
g AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(s) FROM s) + 10000)::DOUBLE / ((s + 1)::DOUBLE * (coalesce((SELECT sum(t) FROM tg), 0) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM s LEFT JOIN tg USING (bucket)),
w AS (SELECT doc_id, count(*) AS n, sum(gain)::BIGINT AS weight FROM df JOIN g USING (bucket) GROUP BY 1),
scored AS (
  SELECT documents.doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || documents.doc_id), 1, 8))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM documents LEFT JOIN w USING (doc_id)),
ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT scored.doc_id, n_features AS n_words, n_features, weight, score, CASE WHEN r <= 10 * n // 100 THEN r END AS rank
FROM scored LEFT JOIN ranked USING (doc_id)
"""
