"""Helpers that several operators share: the shared folder, durable tables, bytes batches, tasks that give memory back, components."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the only characters that part words and are stripped from lines.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; unset, a temporary one in local mode (tests) and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="psephos-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def durable(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back.

    Cuts the lineage, survives the loss of any executor and fixes the rows that
    a partition-dependent computation made. The folder's own retention removes
    the files.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lower_az(c: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(c, UPPER, LOWER)


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id`` and ``text`` (UTF-8 bytes, null as empty), whatever other columns there are."""
    return docs.select(
        docs[id_col].alias("id"), F.coalesce(docs[text_col].cast("binary"), F.lit(b"")).alias("text")
    )


def crc_mod(id_col: Column, m: int) -> Column:
    """crc32 of the id written as text, modulo m; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % m


def slices(batches: Iterator[pa.RecordBatch], max_bytes: int, text: str = "text", max_rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that each holds about ``max_bytes`` of text and ``max_rows`` rows at most; one long text stands alone."""
    for b in batches:
        start, size = 0, 0
        lengths = pc.fill_null(pc.binary_length(b.column(b.schema.get_field_index(text))), 0).to_pylist()
        for i, n in enumerate(lengths):
            if i > start and (size + n > max_bytes or i - start >= max_rows):
                yield b.slice(start, i - start)
                start, size = i, 0
            size += n
        if start < b.num_rows:
            yield b.slice(start)


def give_back() -> None:
    """Free memory of Arrow and of the C library goes back to the system, which they keep by themselves."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, after which its worker is small: Spark keeps workers, more of them than cores, and those that wait take an executor's memory too."""

    def wrapped(batches):
        yield from run(batches)  # its variables are gone afterwards
        give_back()

    return wrapped


def added_up(rows: DataFrame) -> tuple[int, np.ndarray | None]:
    """Sums of ``n long, sums array<double>`` rows, one for each task, in two levels; null sums without rows."""
    fan = max(1, int(rows.rdd.getNumPartitions() ** 0.5))

    def add(table: pa.Table) -> pa.Table:
        total = np.sum([np.asarray(x) for x in table.column("sums").to_pylist()], axis=0)
        return pa.Table.from_pydict({"n": [sum(table.column("n").to_pylist())], "sums": [total.tolist()]})

    dealt = rows.withColumn("part", F.spark_partition_id() % fan)
    n, total = 0, None
    for r in dealt.groupBy("part").applyInArrow(add, "n long, sums array<double>").toLocalIterator():
        n, total = n + r.n, np.asarray(r.sums) + (0 if total is None else total)
    return n, total


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Connected components of the undirected ``edges(a, b)``: ``node, component`` with the smallest node reached.

    Alternates large-star and small-star steps. Minima are map-side combined
    aggregates and the joins are plain equi-joins, so a node with very many
    links is split by the skew join. Every step is written to the shared folder.
    Edges with a null end are left out; without edges the result is empty.
    """
    e = durable(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")

    def mark(x: DataFrame):
        return x.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long")), F.sum(F.hash("b", "a").cast("long"))).first()

    def star(both: DataFrame, large: bool) -> DataFrame:
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        rows = both.join(least, "u")
        if large:
            return rows.where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        kept = rows.where("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b"))
        return kept.unionByName(least.where("u <> m").select(F.col("m").alias("a"), F.col("u").alias("b")))

    seen = mark(e)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        both = both.unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        e = durable(star(both, True).distinct(), "large-star")
        e = durable(star(e.select(F.col("b").alias("u"), F.col("a").alias("v")), False).where("a <> b").distinct(), "small-star")
        now = mark(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    found = e.groupBy("b").agg(F.min("a").alias("component")).select(F.col("b").alias("node"), "component")
    return found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())
