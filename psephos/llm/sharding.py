"""Sharding by a two-pass external shuffle, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from psephos.llm._shared import durable, shared_dir


def home(id_col: Column, shards: int, seed: int) -> Column:
    """The shard with the largest seeded hash of (id, shard).

    Only the id and the number of shards decide. One more shard takes exactly
    the rows for which its own hash is the largest, and no other row moves.
    """
    key = F.coalesce(id_col.cast("string"), F.lit(""))
    best = F.greatest(*[F.struct(F.xxhash64(F.lit(seed), F.lit(s), key).alias("h"), F.lit(s).alias("s")) for s in range(shards)])
    return best["s"] if shards > 1 else F.lit(0)


def copied(rows: DataFrame, at_once: int = 1 << 16) -> DataFrame:
    """The rows with ``copy``, the number among equal rows from 0; copies of a row are counted, and written out by as many tasks as there are parts of ``at_once``."""
    counts = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_n"))
    parts = counts.withColumn("_part", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / at_once).cast("long")))).repartition("turn", "_part")
    start = F.col("_part") * at_once
    return parts.withColumn("copy", F.explode(F.sequence(start, F.least(start + at_once, "_n") - 1))).drop("_n", "_part")


def shuffle_into_shards(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 24, seed: int = 7, bucket_bytes: int = 4 << 20, task_bytes: int = 32 << 20
) -> DataFrame:
    """Deals every row to a shard and a random slot in it: ``id, text, size, shard, slot, grown_shard``.

    Pass one scatters rows by a seeded hash of (id, text) into the buckets of
    their shard, as many as hold ``bucket_bytes`` each; the only shuffle of
    texts brings each bucket to one of total / ``task_bytes`` tasks. Pass two
    shuffles each bucket by Fisher-Yates (``shuffle`` on the array of its rows)
    and numbers the slots: buckets lie one after the other, so slots are
    gapless from 0. Where a bucket starts is counted from hashes beforehand and
    rides along with its rows.

    The order is fixed by the seed and the rows: neither a rerun task nor the
    session's number of shuffle partitions changes it, as the number of tasks
    comes from the bytes and each task draws for its buckets in order.

    Rows of a bucket of over four times its size, as rows that repeat id and
    text make it, are dealt anew over all buckets of their shard, by the number
    of the copy: equal rows are counted and written out again, so nothing
    depends on the order in which they came. ``size`` is the text's UTF-8 bytes plus 8 (null
    text: 8). A null id counts as the empty one. An empty table gives an empty
    result.
    """
    size = F.coalesce(F.octet_length(docs[text_col]), F.lit(0)).cast("long") + 8
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), size.alias("size"))
    rows = rows.withColumn("shard", home(F.col("id"), shards, seed))
    total = {r.shard: r.bytes for r in rows.groupBy("shard").agg(F.sum("size").alias("bytes")).collect()}  # a row for each shard
    many = F.element_at(F.array(*[F.lit(max(1, -(-total.get(s, 0) // bucket_bytes))).cast("long") for s in range(shards)]), F.col("shard") + 1)
    turn = F.xxhash64(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit("")), "text")
    dealt = rows.withColumn("turn", turn).withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed + 1), "turn"), many))

    def counted(rows: DataFrame) -> DataFrame:
        return durable(rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")), "bucket-sizes")

    sizes = counted(dealt)
    large = sizes.where((F.col("bytes") > 4 * bucket_bytes) & (F.col("n") > 1)).select("shard", "bucket", F.lit(True).alias("large"))
    if not large.isEmpty():
        marked = dealt.join(large, ["shard", "bucket"], "left")
        anew = F.pmod(F.xxhash64(F.lit(seed + 2), "turn", "copy"), many)
        copies = copied(marked.where("large").select("id", "text", "size", "shard", "turn")).withColumn("bucket", anew).drop("copy")
        dealt = marked.where("large IS NULL").drop("large").unionByName(copies)
        sizes = counted(dealt)
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    row = F.struct("turn", "id", "text", "size")
    both = dealt.select("shard", "bucket", row.alias("row"), F.lit(None).cast("long").alias("start"))
    both = both.unionByName(starts.withColumn("row", F.lit(None).cast(both.schema["row"].dataType)))
    tasks = max(1, -(-sum(total.values()) // task_bytes))
    groups = both.repartition(tasks, "shard", "bucket").groupBy("shard", "bucket").agg(F.array_sort(F.collect_list("row")).alias("rows"), F.max("start").alias("start"))
    shuffled = groups.sortWithinPartitions("shard", "bucket").select("shard", "start", F.posexplode(F.shuffle("rows", seed)).alias("pos", "row"))
    return shuffled.select(
        "row.id", "row.text", "row.size", "shard", (F.col("start") + F.col("pos")).cast("long").alias("slot"),
        home(F.col("row.id"), shards + 1, seed).alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str | None = None, **params) -> str:
    """Writes the shuffled rows as one folder ``shard=N`` for each shard, with no further shuffle: a file holds whole buckets, each in slot order."""
    path = path or f"{shared_dir(docs.sparkSession)}/shards"
    shuffle_into_shards(docs, **params).write.mode("overwrite").partitionBy("shard").parquet(path)
    return path
