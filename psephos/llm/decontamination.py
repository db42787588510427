"""Benchmark decontamination: rare n-gram seeds join documents to test items, then Smith-Waterman alignment.

One pass over the documents writes the places of all n-grams that the
benchmark has, found through a Bloom filter of bounded size. Their document
counts pick the seeds of each passage, its rarest n-grams; an equi-join of
places and seeds names passages and documents, and only the documents with
enough seeds of a passage near one diagonal are read again and aligned.

Items of equal words are one class, and a result names the class once. Nothing
of the benchmark or the documents comes to the driver but the filters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from psephos.llm._shared import durable, lean, slices

#: Scripts that are written without spaces: each of their characters is a word.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
WORD = re.compile(f"[{UNSPACED}]|[^\\W{UNSPACED}]+")
PROBES = 3


@dataclass(frozen=True)
class Params:
    """What is found, and what bounds the work.

    ``n`` words make a seed (2 in a passage of under ``short`` words, all of a
    passage of under three). An n-gram in at most ``rare`` documents is a seed;
    of the others the ``fewest`` rarest of a passage are, if it has not as many
    rare ones. A passage of ``long`` words or more needs two seeds, a shorter
    one one. Less than
    ``evidence`` aligned words are no match. n-grams of more than ``common``
    classes of items weigh less in the alignment, and are no seeds unless a
    passage has no others. ``filter_bits`` bounds what is broadcast at a time
    (16 MB); a benchmark whose n-grams do not get ``gram_bits`` each is looked
    up in several passes.
    """

    n: int = 3
    short: int = 12
    long: int = 20
    chunk: int = 64
    stride: int = 32
    least: float = 0.4
    evidence: int = 5
    rare: int = 1000
    fewest: int = 6
    common: int = 5
    filter_bits: int = 1 << 27
    gram_bits: int = 12
    slice_bytes: int = 4 << 20
    pairs: int = 2048


def words_of(text: bytes) -> list[str]:
    return WORD.findall(text.decode("utf-8", "replace").lower())


def numbered(words: list[str], known: dict[str, int]) -> np.ndarray:
    """64-bit hashes of words; ``known`` keeps those seen."""
    for w in words:
        if w not in known:
            known[w] = xxhash.xxh64_intdigest(w) | 1
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def grams_of(numbers: np.ndarray, n: int) -> np.ndarray:
    """A signed code for each n-gram of word numbers."""
    m = max(0, len(numbers) - n + 1)
    h = np.full(m, 0x9E3779B97F4A7C15 * n & (1 << 64) - 1, np.uint64)
    for i in range(n):
        h = (h ^ numbers[i : i + m]) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(31)
    return h.view(np.int64)


def signed_digest(numbers: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(numbers.tobytes()) - (1 << 63)


def seed_words(length: int, p: Params) -> int:
    return length if length < 3 else 2 if length < p.short else p.n


def passages_of(items: DataFrame, id_col: str, text_col: str, p: Params) -> DataFrame:
    """``item, whole, passage, words``: the passages of each item, ``chunk`` words at most, as word hashes.

    Equal passages have one number ``passage``, items of equal words one
    ``whole``. Items of under ``evidence`` words have no passages.
    """

    def run(batches):
        for b in batches:
            rows = []
            for i, t in enumerate(b.column(1).to_pylist()):
                own = numbered(words_of(t), {}).view(np.int64)
                if len(own) < p.evidence:
                    continue
                for at in range(0, len(own) - p.chunk + p.stride, p.stride) if len(own) > p.chunk else [0]:
                    part = own[at : at + p.chunk]
                    rows.append((i, signed_digest(own), signed_digest(part), part))
            at, whole, passage, words = list(zip(*rows, strict=True)) or ([], [], [], [])
            same = [pa.array(x, pa.int64()) for x in (whole, passage)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at, pa.int64())), *same, pa.array(words, pa.list_(pa.int64()))], ["item", "whole", "passage", "words"]
            )

    rows = items.select(items[id_col].alias("item"), F.coalesce(items[text_col].cast("string").cast("binary"), F.lit(b"")).alias("text"))
    return rows.mapInArrow(run, f"item {rows.schema['item'].dataType.simpleString()}, whole long, passage long, words array<long>")


def telling(owned: DataFrame, p: Params) -> DataFrame:
    """``passage, whole``: the passages that speak for a class of items: those of ``common`` classes at most. A class without any keeps its rarest."""
    owners = owned.select("passage", "whole").distinct()
    shared = owners.join(owners.groupBy("passage").agg(F.count(F.lit(1)).alias("classes")), "passage")
    rarest = shared.groupBy("whole").agg(F.min(F.struct("classes", "passage"))["passage"].alias("rarest"))
    return shared.join(rarest, "whole").where((F.col("classes") <= p.common) | (F.col("passage") == F.col("rarest"))).select("passage", "whole")


def item_classes(items: DataFrame, item_col: str = "item_id", item_text: str = "text", p: Params = Params()) -> DataFrame:  # noqa: B008
    """``item_id, class_id``: the class of each item that can match, the smallest id of those of equal words. Null ids are left out."""
    owned = passages_of(items, item_col, item_text, p).select("item", "whole").where("item IS NOT NULL").distinct()
    return owned.join(owned.groupBy("whole").agg(F.min("item").alias("class_id")), "whole").select(F.col("item").alias("item_id"), "class_id")


def gram_rows(passages: DataFrame, p: Params) -> DataFrame:
    """``passage, size, position, n, gram`` of distinct passages."""

    def run(batches):
        for b in batches:
            for passage, words in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n = seed_words(len(words), p)
                g = grams_of(np.array(words, np.int64).view(np.uint64), n)
                same = [np.full(len(g), x) for x in (passage, len(words))]
                yield pa.RecordBatch.from_arrays([*map(pa.array, same), pa.array(np.arange(len(g))), pa.array(np.full(len(g), n)), pa.array(g)], ["passage", "size", "position", "n", "gram"])

    return passages.select("passage", "words").mapInArrow(run, "passage long, size long, position long, n long, gram long")


def probes(grams: np.ndarray, bits: int) -> list[np.ndarray]:
    """Bits of the filter for each n-gram; ``bits`` is a power of two."""
    h = grams.view(np.uint64)
    return [((h * np.uint64(m)) >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]


def bloom_filter(grams: DataFrame, p: Params) -> np.ndarray:
    """A Bloom filter of the column ``gram``, of 32 bits for each, within ``filter_bits``; what it lets through in error, the join drops."""
    many = grams.select("gram").distinct().count()
    bits = min(p.filter_bits, 1 << max(10, (32 * many - 1).bit_length()))

    def run(batches):
        for b in batches:
            at = np.unique(np.concatenate(probes(b.column(0).to_numpy(), bits)))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(np.left_shift(np.uint64(1), (at & 63).astype(np.uint64)).view(np.int64))], ["place", "bit"])

    packed = grams.select("gram").mapInArrow(run, "place long, bit long").groupBy("place").agg(F.bit_or("bit").alias("word")).toArrow()  # bits / 64 rows at most
    out = np.zeros(bits >> 6, np.uint64)
    out[packed.column("place").to_numpy()] = packed.column("word").to_numpy().view(np.uint64)
    return np.unpackbits(out.view(np.uint8), bitorder="little").view(bool) if bits <= 1 << 24 else out


def passes(table: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Places of the n-grams that the filter lets through."""
    bits = len(table) if table.dtype == bool else len(table) << 6
    own = np.arange(len(grams))
    for i in range(PROBES):
        at = probes(grams[own], bits)[i]
        ok = table[at] if table.dtype == bool else (table[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
        own = own[ok]
    return own


def all_places(rows: DataFrame, grams: DataFrame, p: Params) -> DataFrame:
    """``places`` of the column ``gram`` of ``grams``, in as many passes over the rows as filters of ``filter_bits`` are needed."""
    many = grams.select("gram").distinct().count()
    parts = max(1, -(-many * p.gram_bits // p.filter_bits))
    sizes = sorted(r.n for r in grams.select("n").distinct().collect())  # three at most
    found = []
    for part in range(parts):
        table = rows.sparkSession.sparkContext.broadcast(bloom_filter(grams.where(F.pmod("gram", F.lit(parts)) == part), p))
        found.append(places(rows, sizes, table, (part, parts), p))
    return reduce(DataFrame.unionByName, found)


def places(rows: DataFrame, sizes: list[int], table, own_part: tuple[int, int], p: Params) -> DataFrame:
    """``gram, doc, pos, once`` for each place of an n-gram of the benchmark in ``rows (doc, text)``; ``once`` marks the first in its text.

    ``own_part`` (k, m) keeps the n-grams that leave k modulo m.
    """
    part, parts = own_part

    def run(batches):
        known: dict[str, int] = {}
        for b in slices(batches, p.slice_bytes):
            docs = b.column(0).to_numpy()
            if len(known) > 2_000_000:
                known.clear()
            words = [words_of(t) for t in b.column(1).to_pylist()]
            lengths = np.fromiter(map(len, words), np.int64, len(words))
            flat = numbered([w for own in words for w in own], known)
            first = np.cumsum(lengths) - lengths
            text = np.repeat(np.arange(len(words)), lengths)
            for n in sizes:
                grams = grams_of(flat, n)
                inside = text[: len(grams)] == text[n - 1 :][: len(grams)]
                own = passes(table.value, grams)
                own = own[inside[own]]
                own = own[grams[own] % parts == part]
                g, t = grams[own], text[own]
                order = np.lexsort((g, t))
                new = np.ones(len(order), bool)
                new[1:] = (np.diff(g[order]) != 0) | (np.diff(t[order]) != 0)
                once = np.zeros(len(order), bool)
                once[order] = new
                yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(docs[t]), pa.array(own - first[t]), pa.array(once)], ["gram", "doc", "pos", "once"])

    return rows.mapInArrow(lean(run), "gram long, doc long, pos long, once boolean")


def smith_waterman(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best local alignment of each row of ``a`` with the row of ``b``: score, and where it ends in a and in b (1-based).

    A word of ``a`` gives its weight where it matches; a mismatch, its loss or
    a word put in after it cost as much. One step for each column of ``a``, for
    all pairs at once; gaps along ``b`` are a running maximum. 0 in ``a`` and 1
    in ``b`` fill rows up and equal nothing.
    """
    rows, width = b.shape
    h = np.zeros((rows, width + 1), np.float32)
    ramp = np.arange(width + 1, dtype=np.float32)
    best, end_a, end_b = np.zeros(rows, np.float32), np.zeros(rows, np.int32), np.zeros(rows, np.int32)
    for i in range(a.shape[1]):
        w = weight[:, i : i + 1]
        new = np.zeros_like(h)
        np.maximum(h[:, :-1] + np.where(a[:, i : i + 1] == b, w, -w), h[:, 1:] - w, out=new[:, 1:])
        np.maximum(new, 0, out=new)
        slope = w * ramp
        h = np.maximum.accumulate(new + slope, axis=1) - slope
        at = h.argmax(1)
        top = h[np.arange(rows), at]
        better = (top > best + 1e-6) & (a[:, i] != 0)
        best[better], end_a[better], end_b[better] = top[better], i + 1, at[better]
    return best, end_a, end_b


def align(pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]], p: Params) -> list[tuple[float, int, int]]:
    """Share of the passage's full score, and the aligned words of the window, for each passage, its weights and a window."""

    def padded(xs: list[np.ndarray], fill: int, kind: type) -> np.ndarray:
        out = np.full((len(xs), max(map(len, xs))), fill, kind)
        for i, x in enumerate(xs):
            out[i, : len(x)] = x
        return out

    passages, weights, windows = ([x[i] for x in pairs] for i in range(3))
    score, end_a, end_b = smith_waterman(padded(passages, 0, np.int64), padded(windows, 2, np.int64), padded(weights, 0, np.float32))
    share = score / np.array([w.sum() for w in weights])
    out = [(float(s), 0, 0) for s in share]
    good = np.flatnonzero(share >= p.least - 1e-6)
    if len(good):
        back_a = [passages[i][: end_a[i]][::-1] for i in good]
        back_w = [weights[i][: end_a[i]][::-1] for i in good]
        back_b = [windows[i][: end_b[i]][::-1] for i in good]
        _, _, length = smith_waterman(padded(back_a, 0, np.int64), padded(back_b, 2, np.int64), padded(back_w, 0, np.float32))
        for i, n in zip(good, length, strict=True):
            out[i] = (float(share[i]), int(end_b[i] - n), int(end_b[i]))
    return out


def weighed(grams: DataFrame, spread: DataFrame, passages: DataFrame, p: Params) -> DataFrame:
    """``passage, words, weights``: the weight of a word is 1, or ``common`` over the classes that hold the rarest n-gram over it."""
    w = F.least(F.lit(1.0), p.common / F.col("spread"))
    over = grams.join(spread, "gram").select("passage", F.explode(F.sequence(F.col("position"), F.col("position") + F.col("n") - 1)).alias("at"), w.alias("w"))
    each = over.groupBy("passage", "at").agg(F.max("w").alias("w"))
    lists = each.groupBy("passage").agg(F.array_sort(F.collect_list(F.struct("at", "w"))).alias("own"))  # chunk words at most
    return passages.join(lists, "passage").select("passage", "words", F.transform("own", lambda x: x["w"]).alias("weights"))


def seeds_of(grams: DataFrame, counts: DataFrame, spread: DataFrame, p: Params) -> DataFrame:
    """``gram, passage, position, size``: the seeds. n-grams that no document holds are none; equal ones of a passage are all seeds."""
    own = Window.partitionBy("passage")  # chunk rows at most
    shared = F.col("spread") > p.common
    known = grams.join(spread, "gram").withColumn("alone", F.max((~shared).cast("int")).over(own) == 1).where(~F.col("alone") | ~shared)
    held = known.join(counts, "gram").withColumn("rank", F.row_number().over(own.orderBy("docs", "position")))
    return held.where((F.col("docs") <= p.rare) | (F.col("rank") <= p.fewest)).select("gram", "passage", "position", "size")


def windows_of(hits: DataFrame, p: Params) -> DataFrame:
    """``doc, passage, start, stop``: where a document has enough seeds of a passage.

    An alignment keeps to ``size - least score + 1`` neighbouring diagonals. A
    band is twice as wide and begins each so many, so one band holds all of it.
    """
    step = F.col("size") - F.ceil(F.col("size") * p.least - 1e-9) + 1
    band = F.floor((F.col("pos") - F.col("position")) / F.col("step"))
    each = hits.withColumn("step", step).select("doc", "passage", "size", "step", "position", F.explode(F.array(band, band - 1)).alias("band")).distinct()
    need = F.when(F.col("size") >= p.long, 2).otherwise(1)
    enough = each.groupBy("doc", "passage", "size", "step", "band").count().where(F.col("count") >= need)
    start = F.col("band") * F.col("step")
    return enough.select("doc", "passage", F.greatest(start, F.lit(0)).alias("start"), (start + 2 * F.col("step") + F.col("size")).alias("stop"))


def window_words(rows: DataFrame, p: Params) -> DataFrame:
    """``doc_id, passage, start, window`` of ``rows (doc_id, text, windows)``: the words of each window, in a row of its own."""

    def run(batches):
        for b in slices(batches, p.slice_bytes):
            texts = (numbered(words_of(t.as_py()), {}).view(np.int64) for t in b.column(1))
            wanted = ((i, w, own[w["start"] : w["stop"]]) for i, own in enumerate(texts) for w in b.column(2)[i].as_py())
            for some in batched(wanted, p.pairs):
                ids = b.column(0).take(pa.array([i for i, _, _ in some], pa.int64()))
                rest = [pa.array([w[c] for _, w, _ in some], pa.int64()) for c in ("passage", "start")]
                yield pa.RecordBatch.from_arrays([ids, *rest, pa.array([x for _, _, x in some], pa.list_(pa.int64()))], ["doc_id", "passage", "start", "window"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "text", "windows").mapInArrow(lean(run), f"doc_id {kind}, passage long, start long, window array<long>")


def alignments(rows: DataFrame, p: Params) -> DataFrame:
    """``doc_id, passage, score, start, stop`` of ``rows (doc_id, passage, start, window, words, weights)`` that align."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, p.pairs):
                b = whole.slice(at, p.pairs)
                pairs = [
                    (np.array(a, np.int64), np.array(w, np.float32), np.array(x, np.int64))
                    for a, w, x in zip(*(b.column(i).to_pylist() for i in (4, 5, 3)), strict=True)
                ]
                hits = [(i, h) for i, h in enumerate(align(pairs, p)) if h[0] >= p.least - 1e-6 and h[0] * len(pairs[i][0]) > p.evidence - 0.5]
                own = b.take(pa.array([i for i, _ in hits], pa.int64()))
                start = own.column(2).to_numpy()
                ends = [pa.array(start + np.array([h[i] for _, h in hits], np.int64)) for i in (1, 2)]
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array([h[0] for _, h in hits], pa.float64()), *ends], ["doc_id", "passage", "score", "start", "stop"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    rows = rows.select("doc_id", "passage", "start", "window", "words", "weights")
    return rows.mapInArrow(lean(run), f"doc_id {kind}, passage long, score double, start long, stop long")


def batched(rows: Iterator, n: int) -> Iterator[list]:
    held = []
    for r in rows:
        held.append(r)
        if len(held) == n:
            yield held
            held = []
    if held:
        yield held


def contaminated(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", p: Params = Params()  # noqa: B008
) -> DataFrame:
    """``doc_id, item_id, items, score, start, stop`` for each document and class of items that align with a share of ``least`` or more.

    A class is the items of equal words; ``item_id`` is its smallest id and
    ``items`` their number (``item_classes`` has the members), so equal items
    are not paired with every document. ``score`` is the best local alignment's
    score over that of a full match of the passage (an item, or ``chunk`` words
    of a longer one); ``start`` and ``stop`` are its words in the document.
    Words are compared in lower case without punctuation; a character of a
    script without spaces is a word. An alignment of under ``evidence`` words
    does not count, so an item of fewer words never matches. Text that more
    than ``common`` classes share weighs less, so it makes no match alone; a
    whole passage that so many share (a preamble) speaks for none of them,
    unless the item has no other. Null and empty items never match, nor do null
    and empty texts. Rows with one id give one row for a class, the best; a
    null id is kept. Every document is read whole, once for each filter (one,
    up to eleven million n-grams), and those with a candidate once more.
    """
    owned = durable(passages_of(items, item_col, item_text, p), "passages")
    owners = durable(telling(owned, p), "owners")
    passages = owned.select("passage", "words").dropDuplicates(["passage"])
    every = durable(gram_rows(passages, p), "grams")
    spread = every.join(owned.select("passage", "whole").distinct(), "passage").select("gram", "whole").distinct().groupBy("gram").agg(F.count(F.lit(1)).alias("spread"))
    spread = durable(spread, "spread")
    grams = durable(every.join(owners.select("passage"), "passage", "left_semi"), "own-grams")
    passages = durable(weighed(grams, spread, passages, p), "weighed")
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(docs[id_col].alias("doc_id"), text.cast("binary").alias("text"), F.xxhash64(docs[id_col], text).alias("doc"))
    found = durable(all_places(rows.select("doc", "text"), grams, p), "places")
    counts = found.where("once").groupBy("gram").agg(F.count(F.lit(1)).alias("docs"))
    seeds = durable(seeds_of(grams, counts, spread, p), "seeds")
    windows = windows_of(found.select("gram", "doc", "pos").join(seeds, "gram"), p)
    some = durable(windows.groupBy("doc").agg(F.collect_list(F.struct("passage", "start", "stop")).alias("windows")), "candidates")  # 24 bytes a window
    cut = window_words(rows.join(some, "doc"), p)
    aligned = alignments(cut.join(passages, "passage"), p).join(owners, "passage")
    best = aligned.groupBy("doc_id", "whole").agg(F.max(F.struct("score", -F.col("start"), "stop")).alias("b"))
    classes = owned.groupBy("whole").agg(F.min("item").alias("item_id"), F.count_distinct("item").alias("items"))
    return best.join(classes, "whole").select("doc_id", "item_id", "items", "b.score", (-F.col("b.col2")).alias("start"), "b.stop")


def without_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **params) -> DataFrame:
    """The rows of ``docs`` that align with no item; rows with a null id are judged by no one and stay."""
    gone = contaminated(docs, items, id_col, **params).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
