"""Order within groups without gathering a group: one sort by ranges, and what earlier ranges hand on."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from psephos.session import written


def _changes(columns: list[pa.Array], last: tuple | None) -> np.ndarray:
    """Where a row's key differs from that of the row before it; ``last`` is the key before the first row, if any."""
    n = len(columns[0])
    out = np.zeros(n, bool)
    for c in columns:
        a, b = c.slice(1), c.slice(0, n - 1)
        differ = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
        out[1:] |= differ.to_numpy(zero_copy_only=False)
    out[0] = last is not None and last != tuple(c[0].as_py() for c in columns)
    return out


def running(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column], sums: Sequence[str] = (), lasts: Sequence[str] = ()) -> DataFrame:
    """``rows`` with ``<name>_before`` for each of ``sums``, the sum over the earlier rows of the key, and with each of ``lasts`` filled from the last known row of its key.

    Rows are dealt to tasks by ranges of (keys, order) and sorted there, so a
    key of any size is spread over many tasks. A task goes through its rows in
    order and keeps one key's state. What its last key has summed up is written
    beside the rows; later ranges that begin with that key get it added in a
    join with as many rows as there were tasks. Rows of equal keys and order
    share a task: make them one row first where many are equal. Sums take null
    as 0; null keys form one group. An empty table gives an empty result.
    """
    names, kinds = rows.columns, dict(rows.dtypes)
    by = [F.col(o) if isinstance(o, str) else o for o in order]
    sorted_rows = rows.repartitionByRange(*[F.col(k) for k in keys], *by).sortWithinPartitions(*keys, *by)
    number = {s: "double" if kinds[s] in ("double", "float") else "bigint" for s in sums}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, key, first, head = TaskContext.get().partitionId(), None, None, True
        carry = dict.fromkeys(sums, 0)
        known: dict = dict.fromkeys(lasts)
        schema = None

        def edge(kind: int, of: tuple, totals: dict, ends: dict) -> pa.RecordBatch:
            cells = dict(zip(keys, of, strict=True)) | ends
            columns = [pa.array([cells.get(n)], f.type) for n, f in zip(names, schema, strict=True)]
            more = [pa.array([totals[s]], pa.float64() if number[s] == "double" else pa.int64()) for s in sums]
            return pa.RecordBatch.from_arrays([*columns, *more, pa.array([part], pa.int32()), pa.array([False]), pa.array([kind], pa.int32())], out_names)

        out_names = [*names, *[f"{s}_before" for s in sums], "_part", "_head", "_edge"]
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            schema = b.schema
            column = {c: b.column(i) for i, c in enumerate(names)}
            change = _changes([column[k] for k in keys], key) if keys else np.zeros(n, bool)
            at = np.arange(n)
            start = np.maximum.accumulate(np.where(change, at, -1))  # -1: goes on from the batch before
            ongoing = start < 0
            in_head = ongoing & head
            before = []
            for s in sums:
                x = pc.fill_null(column[s], 0).to_numpy(zero_copy_only=False).astype(float if number[s] == "double" else np.int64)
                exclusive = np.cumsum(x) - x
                got = exclusive - np.where(ongoing, 0, exclusive[np.maximum(start, 0)]) + np.where(ongoing, carry[s], 0)
                carry[s] = (got[-1] + x[-1]).item()
                before.append(pa.array(got))
            filled = {}
            for c in lasts:
                valid = pc.is_valid(column[c]).to_numpy(zero_copy_only=False)
                place = np.maximum.accumulate(np.where(valid, at, -1))
                inside = (place >= 0) & (place >= start)
                got = column[c].take(pa.array(np.where(inside, place, 0), mask=~inside))
                filled[c] = pc.if_else(pa.array(ongoing & ~inside), pa.scalar(known[c], column[c].type), got)
                known[c] = filled[c][-1].as_py()
            if first is None:
                first = tuple(column[k][0].as_py() for k in keys)
            key = tuple(column[k][n - 1].as_py() for k in keys)
            head = head and bool(ongoing[-1])
            yield pa.RecordBatch.from_arrays([*[filled.get(c, column[c]) for c in names], *before, pa.array(np.full(n, part, np.int32)), pa.array(in_head), pa.array(np.full(n, -1, np.int32))], out_names)
        if first is not None:
            yield edge(0, first, dict.fromkeys(sums, 0), {})
            yield edge(1, key, carry, known)

    fields = [f"`{n}` {k}" for n, k in rows.dtypes] + [f"`{s}_before` {number[s]}" for s in sums] + ["_part int", "_head boolean", "_edge int"]
    placed = written(sorted_rows.mapInArrow(run, ", ".join(fields)), "ordered")
    before = Window.partitionBy(*keys).orderBy("_part", "_edge").rowsBetween(Window.unboundedPreceding, -1)  # two rows a task
    handed = [F.coalesce(F.sum(f"{s}_before").over(before), F.lit(0)).alias(f"_sum_{s}") for s in sums] + [F.last(c, ignorenulls=True).over(before).alias(f"_last_{c}") for c in lasts]
    ends = placed.where("_edge >= 0").select(F.col("_part").alias("_of"), "_edge", *handed).where("_edge = 0").drop("_edge")
    body = placed.where("_edge < 0").join(F.broadcast(ends), F.col("_part") == F.col("_of"), "left")
    added = {f"{s}_before": F.col(f"{s}_before") + F.when(F.col("_head"), F.col(f"_sum_{s}")).otherwise(0) for s in sums}
    added |= {c: F.coalesce(c, F.when(F.col("_head"), F.col(f"_last_{c}"))) for c in lasts}
    return body.withColumns(added).select(*names, *[F.col(f"{s}_before").cast(number[s]).alias(f"{s}_before") for s in sums])


def same(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """A join on ``keys`` in which null equals null."""
    other = b.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return a.join(other, on, how).drop(*[f"_of_{k}" for k in keys])


def quantiles(rows: DataFrame, keys: Sequence[str], value: str, at: dict[str, float]) -> DataFrame:
    """``keys`` and a column for each of ``at``: exact quantiles with linear interpolation; nulls are left out.

    Equal values are counted first, and the ranks of the others come from
    ``running``, so no group is gathered. Of a key only the rows at the wanted ranks are kept.
    """
    levels = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running(levels, keys, ["_v"], sums=["_n"])
    sized = same(ranked, levels.groupBy(*keys).agg(F.sum("_n").alias("_all")), keys) if keys else ranked.crossJoin(F.broadcast(levels.agg(F.sum("_n").alias("_all"))))  # one row
    place = {n: (F.col("_all") - 1) * p for n, p in at.items()}
    holds = lambda k: (F.col("_n_before") <= k) & (k < F.col("_n_before") + F.col("_n"))
    ends = [F.max(F.when(holds(f(h)), F.col("_v"))).alias(f"{side}_{n}") for n, h in place.items() for side, f in (("_lo", F.floor), ("_hi", F.ceil))]
    part = [F.max(h - F.floor(h)).alias(f"_part_{n}") for n, h in place.items()]
    found = sized.groupBy(*keys).agg(*ends, *part)
    return found.select(*keys, *[(F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_part_{n}")).alias(n) for n in at])


def as_of(points: DataFrame, targets: DataFrame, keys: Sequence[str], time: str = "t", value: str = "value", at: str = "at", forward: bool = False, found: str = "found", found_at: str = "found_at") -> DataFrame:
    """``targets`` with ``found``, the value of the last point of the key at or before ``at`` (``forward``: the first at or after it), and ``found_at``, its time; null without one.

    Any number of targets and a key of any size: points and targets are sorted
    together and the last point is handed on (``running``). Of points at one
    time the largest value counts. Points without key, time or value are none;
    a target without key or time finds none. Repeated targets stay repeated.
    """
    sign = -1 if forward else 1
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    p = points.where(known & F.col(time).isNotNull() & F.col(value).isNotNull()).groupBy(*keys, F.col(time).alias("_t")).agg(F.max(value).alias("_v"))
    p = p.select(*keys, (F.col("_t") * sign).alias("_t"), F.lit(0).alias("_kind"), "_v", F.col("_t").alias("_point"))
    q = targets.where(known & F.col(at).isNotNull()).select(*keys, (F.col(at) * sign).alias("_t")).distinct()
    q = q.select("*", F.lit(1).alias("_kind"), F.lit(None).cast(p.schema["_v"].dataType).alias("_v"), F.lit(None).cast(p.schema["_point"].dataType).alias("_point"))
    both = running(p.unionByName(q), keys, ["_t", "_kind"], lasts=["_v", "_point"]).where("_kind = 1")
    own = both.select(*keys, (F.col("_t") * sign).alias("_at"), F.col("_v").alias(found), F.col("_point").alias(found_at)).withColumnsRenamed({k: f"_of_{k}" for k in keys})
    on = F.col(at) == F.col("_at")
    for k in keys:
        on = on & (F.col(k) == F.col(f"_of_{k}"))
    return targets.join(own, on, "left").select(*targets.columns, found, found_at)


def nearest_until(points: DataFrame, targets: DataFrame, keys: Sequence[str], back: float, time: str = "t", value: str = "value", at: str = "at", found: str = "found") -> DataFrame:
    """``targets`` with the value of the point nearest to ``at - back`` among those at or before ``at``; the earlier on ties. Two as-of joins."""
    moved = targets.withColumn("_goal", F.col(at) - back)
    left = as_of(points, moved, keys, time, value, "_goal", found="_a", found_at="_a_at")
    both = as_of(points, left, keys, time, value, "_goal", True, "_b", "_b_at")
    later = F.when(F.col("_b_at") <= F.col(at), F.col("_b_at") - F.col("_goal"))
    earlier = F.col("_goal") - F.col("_a_at")
    pick = F.when(earlier.isNotNull() & (later.isNull() | (earlier <= later)), F.col("_a")).when(later.isNotNull(), F.col("_b"))
    return both.select(*targets.columns, pick.alias(found))
