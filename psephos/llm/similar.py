"""SimHash near-duplicates at a stated similarity of word shingles, verified exactly.

SimHash fingerprints and pigeonhole blocks name candidates, as in ``simhash``.
Pairs at a similarity of 0.8 lie at some ten of 64 bits, though, farther than
blocks can reach at any size of the corpus, so MinHash bands name candidates too; every
candidate is verified by the exact Jaccard similarity. At a similarity s two
texts share one band at least with the probability ``1 - (1 - s ** EACH) **
BANDS``: 0.9996 at 0.8.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from psephos.llm import simhash
from psephos.llm._shared import components, durable, id_and_text, lean, slices
from psephos.llm.simhash import SEED, fingerprint, shingle_hashes, signed

BANDS, EACH = 20, 5  # bands, minima in each
_rng = np.random.default_rng(SEED)
FLIP, TIMES = _rng.integers(0, (1 << 64) - 1, (2, BANDS * EACH), np.uint64)
TIMES |= np.uint64(1)


def digest_of(shingles: np.ndarray) -> int:
    """Signed 64 bits of a set of shingles, 0 for none."""
    return signed(xxhash.xxh64_intdigest(shingles.tobytes(), SEED)) if len(shingles) else 0


def band_keys(shingles: np.ndarray, block: int = 1024) -> list[int]:
    """A key for each band: equal where all minima of the band are."""
    least = np.full(len(FLIP), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), block):
        np.minimum(least, ((shingles[at : at + block, None] ^ FLIP) * TIMES).min(0), out=least)
    return [signed(xxhash.xxh64_intdigest(least[i * EACH : (i + 1) * EACH].tobytes(), i)) for i in range(BANDS)]


def lists(values: list, kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values) if values else [], kind))


def sketches(rows: DataFrame, words_each: int) -> DataFrame:
    """``id, fp, n, sim, keys`` of ``rows (id, text)``: the digest and size of the shingle set, its SimHash, its band keys (none for a blank text)."""

    def run(batches):
        for b in slices(batches, 8 << 20):
            sets = [np.unique(shingle_hashes(t, words_each)) for t in b.column(1).to_pylist()]
            keys = lists([np.array(band_keys(s) if len(s) else [], np.int64) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(digest_of, sets), pa.int64()), pa.array(map(len, sets), pa.int64()), pa.array(map(fingerprint, sets), pa.int64()), keys], ["id", "fp", "n", "sim", "keys"])

    return rows.mapInArrow(lean(run), f"id {rows.schema['id'].dataType.simpleString()}, fp long, n long, sim long, keys array<long>")


def shingle_sets(rows: DataFrame, words_each: int) -> DataFrame:
    """``fp, shingles`` of ``rows (id, text)``."""

    def run(batches):
        for b in slices(batches, 2 << 20):
            sets = [np.unique(shingle_hashes(t, words_each)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(map(digest_of, sets), pa.int64()), lists([s.view(np.int64) for s in sets], pa.int64())], ["fp", "shingles"])

    return rows.mapInArrow(lean(run), "fp long, shingles array<long>")


def candidates(nodes: DataFrame, least: float, bucket_rows: int) -> tuple[DataFrame, DataFrame]:
    """Pairs ``a, b`` of ``nodes (fp, n, keys)`` with a band key in common and sizes that allow the similarity, and the stars ``a, b`` of crowded keys.

    A key of over ``bucket_rows`` sets is not paired, so pairs grow with the
    sets and not with the square of a group: each of its sets is paired with
    the smallest, which makes a star. ``across`` compares what the links of
    these pairs leave apart.
    """
    keys = nodes.select("fp", "n", F.posexplode("keys").alias("band", "key"))
    sizes = keys.groupBy("band", "key").agg(F.count(F.lit(1)).alias("many"), F.min("fp").alias("first"))
    shared = durable(keys.join(sizes.where("many > 1"), ["band", "key"]), "bands")
    small = shared.where(F.col("many") <= bucket_rows)
    stars = shared.where((F.col("many") > bucket_rows) & (F.col("fp") != F.col("first"))).select(F.col("first").alias("a"), F.col("fp").alias("b")).distinct()
    left, right = (small.select("band", "key", F.col("fp").alias(x), F.col("n").alias(f"n_{x}")) for x in "ab")
    sized = F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * least - 1e-6
    found = left.join(right, ["band", "key"]).where("a < b").where(sized).select("a", "b")
    stars = durable(stars, "stars")
    return durable(found.unionByName(stars).distinct(), "candidates"), stars


def tile_links(t: pa.Table, least: float) -> pa.Table:
    """Links between the left and the right sets of a tile that lie in different components: of each left set one for each component."""
    lists_, side = t.column("shingles").combine_chunks(), t.column("left").to_numpy()
    fps, comp, ends = t.column("fp").to_numpy(), t.column("comp").to_numpy(), lists_.offsets.to_numpy()
    values, sizes = lists_.values.to_numpy(), np.diff(lists_.offsets.to_numpy())
    of = np.repeat(np.arange(len(sizes)), sizes)
    values = values[ends[0] : ends[-1]]
    left, right = np.flatnonzero(side), np.flatnonzero(~side)
    columns = np.intersect1d(values[side[of]], values[~side[of]])
    both = np.zeros((len(left), len(right)), np.float32)
    place = np.zeros(len(sizes), np.int64)
    place[left], place[right] = np.arange(len(left)), np.arange(len(right))
    at = np.minimum(np.searchsorted(columns, values), max(0, len(columns) - 1))
    shared = columns[at] == values if len(columns) else np.zeros(len(values), bool)
    for start in range(0, len(columns), 8192):
        part = shared & (at >= start) & (at < start + 8192)
        a, b = (np.zeros((n, min(8192, len(columns) - start)), np.float32) for n in (len(left), len(right)))
        for m, own in ((a, part & side[of]), (b, part & ~side[of])):
            m[place[of[own]], at[own] - start] = 1
        both += a @ b.T
    linked = both >= (sizes[left][:, None] + sizes[right][None] - both) * least - 1e-6
    linked &= comp[left][:, None] != comp[right][None]
    i, j = np.nonzero(linked)
    _, first = np.unique(np.stack([i, comp[right[j]]]), axis=1, return_index=True)
    return pa.table({"a": fps[left[i[first]]], "b": fps[right[j[first]]]})


def across(stars: DataFrame, found: DataFrame, sets: DataFrame, least: float, tile_rows: int = 256, tile_shingles: int = 1 << 20) -> DataFrame:
    """Links ``a, b`` between components of one crowd that star links leave apart.

    A crowd is what the ``stars`` of crowded keys reach. All its sets outside
    its largest component are compared with all its sets, in dense tiles of
    ``tile_rows`` sets (fewer of long ones), so that no pair is left out and
    none is written that is no link. A crowd that is one component, as copies
    make it, is not compared. ``found``: ``node, component``.
    """
    crowds = components(stars).select(F.col("node").alias("fp"), F.col("component").alias("crowd"))
    comps = found.select(F.col("node").alias("of"), F.col("component").alias("comp"))
    members = durable(crowds.join(comps, F.col("fp") == F.col("of"), "left").select("fp", "crowd", F.coalesce("comp", "fp").alias("comp")), "crowds")
    each = members.groupBy("crowd", "comp").agg(F.count(F.lit(1)).alias("n"))
    apart = each.groupBy("crowd").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("comps"), F.max(F.struct("n", "comp")).alias("main")).where("comps > 1")
    rows = members.join(apart, "crowd").join(sets.select(F.col("fp").alias("of"), "shingles"), F.col("fp") == F.col("of")).drop("of")
    rows = durable(rows, "crowded-sets")
    longest = rows.groupBy("crowd").agg(F.max(F.size("shingles")).alias("longest"))
    rows = rows.join(longest.withColumnRenamed("crowd", "of"), F.col("crowd") == F.col("of"))
    fit = F.greatest(F.lit(1), F.least(F.lit(tile_rows), F.floor(F.lit(tile_shingles) / F.greatest("longest", F.lit(1)))))
    rows = rows.withColumn("down", F.ceil((F.col("all") - F.col("main.n")) / fit).cast("int")).withColumn("along", F.ceil(F.col("all") / fit).cast("int"))
    dealt = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "fp"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    kept = ["crowd", "fp", "comp", "shingles"]
    left = rows.where("comp <> main.comp").select(*kept, F.lit(True).alias("left"), dealt(1, "down").alias("i"), every("along").alias("j"))
    right = rows.select(*kept, F.lit(False).alias("left"), every("down").alias("i"), dealt(2, "along").alias("j"))
    return left.unionByName(right).groupBy("crowd", "i", "j").applyInArrow(lambda t: tile_links(t, least), "a long, b long")


def simhash_candidates(nodes: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of ``nodes (fp, sim)``: each set with the smallest of its SimHash, and the smallest ones of SimHashes within three bits."""
    least = durable(nodes.groupBy("sim").agg(F.min("fp").alias("rep")), "simhashes")
    same = nodes.join(least, "sim").where("fp <> rep").select(F.col("rep").alias("a"), F.col("fp").alias("b"))
    near = simhash.links(least.select(F.col("sim").alias("fp")))
    for x in "ab":
        near = near.join(least.select(F.col("sim").alias(x), F.col("rep").alias(f"rep_{x}")), x)
    return same.unionByName(near.select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b")))


def links(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The ``pairs`` whose sets have a Jaccard similarity of ``least`` or more."""
    for x in "ab":
        pairs = pairs.join(sets.select(F.col("fp").alias(x), F.col("shingles").alias(f"set_{x}")), x)
    both = F.size(F.array_intersect("set_a", "set_b"))
    return pairs.where(both >= (F.size("set_a") + F.size("set_b") - both) * least - 1e-6).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_each: int = 5, least: float = 0.8, bucket_rows: int = 16, tile_rows: int = 256) -> DataFrame:
    """``id, component``: every row with an id, and the smallest id that links reach. Equal sets are one node; blank texts are copies."""
    rows = id_and_text(docs.where(docs[id_col].isNotNull()), id_col, text_col)
    known = durable(sketches(rows, words_each), "sketches")
    nodes = known.groupBy("fp").agg(F.min("id").alias("node"), F.first("n").alias("n"), F.first("sim").alias("sim"), F.first("keys").alias("keys"))
    nodes = durable(nodes, "nodes")
    pairs, stars = candidates(nodes.select("fp", "n", "keys"), least, bucket_rows)
    pairs = durable(pairs.unionByName(simhash_candidates(nodes.where("n > 0").select("fp", "sim"))).distinct(), "pairs")
    used = pairs.select(F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("fp"))).distinct()
    ids = nodes.join(used, "fp").select(F.col("node").alias("id")).distinct()
    sets = durable(shingle_sets(rows.join(ids, "id", "left_semi"), words_each).dropDuplicates(["fp"]), "shingles")
    linked = durable(links(pairs, sets, least), "links")
    found = components(linked)
    if not stars.isEmpty():
        more = durable(across(stars, found, sets, least, tile_rows), "links")
        found = found if more.isEmpty() else components(linked.unionByName(more))
    reached = nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", nodes["node"], F.coalesce("component", "fp").alias("group"))
    least_id = reached.groupBy("group").agg(F.min("node").alias("component"))
    named = reached.join(least_id, "group").select("fp", "component")
    return known.join(named, "fp").select("id", "component")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component; rows with a null id stay."""
    found = near_duplicates(docs, id_col, text_col, **params)
    gone = found.where("id <> component").select(F.col("id").alias("_gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
