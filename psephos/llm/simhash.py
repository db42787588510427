"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked by pigeonhole blocks."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from psephos.llm._shared import components, durable, id_and_text, slices

SEED, BITS = 42, 64


def shingle_hashes(text: bytes, words_each: int = 3, seed: int = SEED) -> np.ndarray:
    """XXH64 of every shingle of lower-cased words, repeats included; fewer words make one shingle, none make none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - words_each + 1)
    starts = np.concatenate([[0], ends[: n - 1] + 1])
    stops = ends[min(words_each, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)), np.uint64, n)


def fingerprint(hashes: np.ndarray, block: int = 1 << 16) -> int:
    """Bit i is 1 if it is set in over half of the hashes, which are added up in blocks; signed, 0 without hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), block):
        part = hashes[at : at + block].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_each: int = 3) -> DataFrame:
    """``id, fp`` (signed 64 bits) of each row of ``docs``; a null or blank text gets 0. One narrow pass."""

    def run(batches):
        for b in slices(batches, 8 << 20):
            fps = [fingerprint(shingle_hashes(t, words_each)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["id", "fp"])

    rows = id_and_text(docs, id_col, text_col)
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def first_masks(distance: int, blocks: int) -> list[int]:
    """Unions of ``blocks - distance`` blocks: of two fingerprints within ``distance`` one union is equal at least."""
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    block = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(block, blocks - distance)]


def free_bits(mask: int) -> list[int]:
    return [i for i in range(BITS) if not mask >> i & 1]


def finer_masks(mask: int, distance: int) -> list[int]:
    """Cuts the free bits of a mask, more than ``distance`` of them, into distance + 1 blocks: of two that agree on the mask one more block is equal."""
    free = free_bits(mask)
    return [mask | sum(1 << i for i in free[g :: distance + 1]) for g in range(distance + 1)]


def links(fps: DataFrame, distance: int = 3, blocks: int = 6, bucket_rows: int = 200) -> DataFrame:
    """Pairs ``a, b`` of distinct fingerprints (column ``fp``) within ``distance`` bits.

    Joins on blocks, then verifies. A bucket with over ``bucket_rows``
    fingerprints is not paired: its rows go on to finer blocks, which lose no
    pair. Each level leaves a quarter less bits free (for 3 bits of distance),
    so buckets end after some ten levels at the latest: where no more than
    ``distance`` bits are free a bucket has 2 ** distance fingerprints at most
    and all its pairs are links. So the pairs grow with the rows, not with the
    square of a group.
    """
    spark = fps.sparkSession
    masks = first_masks(distance, blocks)
    rows = fps.select("fp", F.explode(F.array(*[F.lit(signed(m)) for m in masks])).alias("mask"))
    out = None
    while True:
        rows = rows.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = rows.groupBy("mask", "key").count()
        pairable = durable(rows.join(sizes.where("count > 1"), ["mask", "key"]), "blocks")
        last = F.bit_count("mask") >= BITS - distance
        small = pairable.where((F.col("count") <= bucket_rows) | last)
        left, right = (small.select("mask", "key", F.col("fp").alias(n)) for n in "ab")
        found = left.join(right, ["mask", "key"]).where("a < b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance).select("a", "b").distinct()
        out = found if out is None else out.unionByName(found)
        large = pairable.where((F.col("count") > bucket_rows) & ~last)
        used = [r.mask for r in large.select("mask").distinct().collect()]  # masks in use, not rows
        if not used:
            return out.distinct()
        finer = [(m, signed(f)) for m in used for f in finer_masks(m & (1 << 64) - 1, distance)]
        table = spark.createDataFrame(finer, "mask long, finer long")
        rows = durable(large.join(table, "mask").select("fp", F.col("finer").alias("mask")).distinct(), "finer")


def grouped(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``fp, component`` of ``nodes (fp, least)``: the smallest ``least`` of the nodes that ``edges (a, b)`` between fps reach; null if all are null."""
    reached = components(edges)
    of = nodes.join(reached, nodes["fp"] == reached["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("_group"))
    named = of.groupBy("_group").agg(F.min("least").alias("component"))
    return of.join(named, "_group").select("fp", "component")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 3, words_each: int = 3, blocks: int = 6, bucket_rows: int = 200
) -> DataFrame:
    """``id, fp, component``: every row of ``docs`` with its fingerprint and the smallest id that links reach.

    Equal fingerprints are one node, so copies are never paired. Rows with a
    null id take part, and link what lies on both sides of them, but never name
    a component unless all rows of it have null ids (then null). Repeated rows
    give repeated rows; an empty table gives an empty result. Raises an error
    if the components have not settled after 40 rounds.
    """
    rows = durable(fingerprints(docs, id_col, text_col, words_each), "fingerprints")
    nodes = durable(rows.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    named = grouped(nodes, links(nodes.select("fp"), distance, blocks, bucket_rows))
    return rows.join(named, "fp").select("id", "fp", "component")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component; rows with a null id stay."""
    found = near_duplicates(docs.where(docs[id_col].isNotNull()), id_col, text_col, **params)
    gone = found.where("id <> component").select(F.col("id").alias("_gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
