"""Language identification by a string kernel.

The kernel of two texts is the number of character n-grams (n = 1, 2, 3) that
both hold, over the geometric mean of their numbers of n-grams: the blended
spectrum with presence in place of counts. n-grams are hashed to a fixed number
of places. Nyström landmarks turn kernel rows into features for one-versus-rest
kernel ridge regression; a text is scored by two matrix products.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from psephos.llm._shared import added_up, slices


@dataclass(frozen=True)
class Params:
    """``landmarks`` and ``train_rows`` bound what is learnt from: labelled rows, drawn by a seeded hash."""

    places: int = 1 << 14
    orders: Sequence[int] = (1, 2, 3)
    landmarks: int = 160
    train_rows: int = 20_000
    ridge: float = 1e-4
    seed: int = 5
    slice_bytes: int = 1 << 20
    slice_rows: int = 1024  # 64 MB of presence at most


def presence(texts: Sequence[bytes], p: Params) -> np.ndarray:
    """Texts x places, 1 where the text holds an n-gram of that place. Whatever is no letter counts as a space."""
    words = "\0".join([t.decode("utf-8", "replace").lower().replace("\0", " ") for t in texts]) + "\0"
    code = np.frombuffer(words.encode("utf-32-le", "surrogatepass"), np.uint32)
    end = code == 0
    letter = ((code >= 97) & (code <= 122)) | (code >= 0xAA)
    code = np.where(letter, code, np.uint32(32))
    row = np.cumsum(end) - end
    out = np.zeros((len(texts), p.places), np.float32)
    flat, shift = out.ravel(), np.uint32(32 - (p.places - 1).bit_length())
    h = np.zeros(len(code), np.uint32)
    broken = np.zeros(len(code), bool)
    for n in range(1, max(p.orders) + 1):
        # of the n characters that end here
        h = np.concatenate([np.zeros(1, np.uint32), h[:-1]]) * np.uint32(0x01000193) + code * np.uint32(0x9E3779B1)
        broken = end | np.concatenate([np.ones(1, bool), broken[:-1]]) if n > 1 else end
        if n in p.orders:
            mixed = (h ^ h >> np.uint32(15)) * np.uint32(0x85EBCA6B + 2 * n)
            ok = ~broken
            flat[row[ok] * p.places + (mixed[ok] >> shift)] = 1
    return out


def kernel(x: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Rows of ``x`` by landmarks, both 0/1."""
    sizes = np.sqrt(np.maximum(x.sum(1), 1))[:, None] * np.sqrt(np.maximum(landmarks.sum(1), 1))
    return (x @ landmarks.T) / sizes


def drawn(rows: DataFrame, counts: dict, wanted: int, seed: int) -> DataFrame:
    """About ``wanted`` rows of each language, by a seeded hash of id and text; all if there are fewer."""
    top = 1 << 62
    h = F.pmod(F.xxhash64(F.lit(seed), "id", "text"), F.lit(top))
    limit = F.lit(-1).cast("long")
    for lang, n in counts.items():
        limit = F.when(F.col("lang") == lang, F.lit(min(top, int(top * (wanted / n))))).otherwise(limit)
    return rows.withColumn("h", h).where(F.col("h") < limit)


def identify(
    docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", p: Params = Params()  # noqa: B008
) -> DataFrame:
    """Predicts the language of every row: ``id, held_out, lang_pred, score``.

    Learns from text and language of rows that aren't held out and have a
    language; ids only draw the sample. ``score`` is the share of the winning
    class in the clipped class scores, between 0 and 1. A null text or one
    without a letter gets ``und`` with score 0, and so does every text if there
    is nothing to learn from. Ties go to the language that sorts first.
    Repeated rows give repeated rows.
    """
    spark = docs.sparkSession
    rows = docs.select(
        docs[id_col].alias("id"), F.coalesce(docs[text_col].cast("binary"), F.lit(b"")).alias("text"), held_out.alias("held_out"),
        docs[lang_col].cast("string").alias("lang"), F.coalesce(docs[text_col].rlike(r"\p{L}"), F.lit(False)).alias("letters"),
    )
    learnt = rows.where(~F.col("held_out") & F.col("lang").isNotNull() & F.col("letters"))
    counts = {r.lang: r["count"] for r in learnt.groupBy("lang").count().collect()}
    langs = sorted(counts)
    each = max(4, p.landmarks // max(1, len(langs)))

    def shape(batches):
        for b in slices(batches, p.slice_bytes, max_rows=p.slice_rows):
            bits = [x.tobytes() for x in np.packbits(presence(b.column(0).to_pylist(), p) > 0, axis=1)]
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(bits, pa.binary())], ["lang", "h", "bits"])

    some = drawn(learnt, counts, 2 * each, p.seed).select("text", "lang", "h").mapInArrow(shape, "lang string, h long, bits binary").collect()
    chosen: dict[str, list] = {lang: [] for lang in langs}
    for r in sorted(some, key=lambda r: (r.h, r.bits)):
        if len(chosen[r.lang]) < each:
            chosen[r.lang].append(r.bits)
    packed = sorted({bytes(x) for v in chosen.values() for x in v})
    landmarks = np.unpackbits(np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), p.places // 8), axis=1)[:, : p.places].astype(np.float32)
    if packed:
        values, vectors = np.linalg.eigh(kernel(landmarks, landmarks).astype(np.float64))
        kept = values > 1e-6 * values[-1]
        nystrom = vectors[:, kept] / np.sqrt(values[kept])
        m = nystrom.shape[1] + 1
        shared = spark.sparkContext.broadcast((landmarks, nystrom))

        def sums(batches):
            landmarks, nystrom = shared.value
            gram, n = np.zeros((m, m + len(langs))), 0
            for b in slices(batches, p.slice_bytes, max_rows=p.slice_rows):
                x = kernel(presence(b.column(0).to_pylist(), p), landmarks) @ nystrom
                x = np.hstack([x, np.ones((len(x), 1))])
                y = np.where(np.array(b.column(1).to_pylist())[:, None] == np.array(langs), 1.0, -1.0)
                gram += x.T @ np.hstack([x, y])
                n += len(x)
            if n:
                yield pa.RecordBatch.from_pydict({"n": [n], "sums": [gram.ravel().tolist()]})

        sample = drawn(learnt, counts, max(1, p.train_rows // len(langs)), p.seed + 1).select("text", "lang")
        n, total = added_up(sample.mapInArrow(sums, "n long, sums array<double>"))
        if n:
            gram = total.reshape(m, -1)
            beta = np.linalg.solve(gram[:, :m] + p.ridge * n * np.eye(m), gram[:, m:])
            weights, bias = (nystrom @ beta[:-1]).astype(np.float32), beta[-1].astype(np.float32)
            model = spark.sparkContext.broadcast((landmarks, weights, bias))
        else:
            model = None
    else:
        model = None

    def predict(batches):
        for b in slices(batches, p.slice_bytes, max_rows=p.slice_rows):
            letters = np.array(b.column(2).to_pylist(), bool)
            pred, score = ["und"] * b.num_rows, np.zeros(b.num_rows)
            at = np.flatnonzero(letters)
            if model and len(at):
                landmarks, weights, bias = model.value
                texts = b.column(0).to_pylist()
                f = kernel(presence([texts[i] for i in at], p), landmarks) @ weights + bias
                share = np.clip((f + 1) / 2, 1e-6, 1)
                share /= share.sum(1, keepdims=True)
                best = share.argmax(1)
                score[at] = share[np.arange(len(at)), best]
                for i, k in zip(at.tolist(), best.tolist(), strict=True):
                    pred[i] = langs[k]
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(3), pa.array(pred, pa.string()), pa.array(score)], ["id", "held_out", "lang_pred", "score"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("text", "id", "letters", "held_out").mapInArrow(predict, f"id {kind}, held_out boolean, lang_pred string, score double")
