"""Deduplication, imputation, validation, upserts, reshaping."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from psephos import dims


def keep_first(rows: DataFrame, key: Column, order: str) -> DataFrame:
    """For each key the row with the smallest ``order``; a minimum of structs, so rows of a large key combine early."""
    packed = rows.groupBy(key.alias("_key")).agg(F.min(F.struct(F.col(order).alias("_order"), F.struct(*rows.columns).alias("row"))).alias("m"))
    return packed.select("m.row.*")


def assert_unique(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows``, or an error that names three repeated keys."""
    found = rows.groupBy(*keys).count().where("count > 1").orderBy(*keys).limit(3).collect()
    if found:
        raise ValueError(f"repeated ({', '.join(keys)}): {[tuple(r)[:-1] for r in found]}")
    return rows


def impute(panel: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Adds cells that rules name and the panel lacks: a constant, or the donor cycle's share; without a donor nothing."""
    rules = dims.small(dims.imputation(panel.sparkSession) if rules is None else rules)
    absent = rules.join(panel.select("cycle", "bloc").distinct(), ["cycle", "bloc"], "left_anti")
    donors = panel.groupBy(F.col("cycle").alias("donor"), "bloc").agg(F.min("vote_share").alias("_given"))
    made = absent.join(donors, ["donor", "bloc"], "left").withColumn("vote_share", F.coalesce("constant", "_given")).where("vote_share IS NOT NULL")
    return panel.unionByName(made.select(F.col("cycle").cast(panel.schema["cycle"].dataType), "bloc", "vote_share", "source"), allowMissingColumns=True)


CHECKS: Mapping[str, str] = {
    "null_cycle": "cycle IS NULL", "null_bloc": "bloc IS NULL", "null_share": "vote_share IS NULL",
    "cycle_range": "cycle NOT BETWEEN 1900 AND 2100", "bloc_name": "NOT bloc RLIKE '^[a-z][a-z0-9_]*$'", "share_range": "vote_share NOT BETWEEN 0 AND 1",
}


def violations(panel: DataFrame, checks: Mapping[str, str] = CHECKS) -> DataFrame:
    """One row with the number of rows against each check, in one pass."""
    return panel.agg(*[F.count(F.when(F.expr(c), 1)).alias(k) for k, c in checks.items()])


def validate(panel: DataFrame, required: Sequence[str], context: str) -> DataFrame:
    """``panel``, or an error for the first check that fails: columns, nulls, then ranges."""
    gone = [c for c in required if c not in panel.columns]
    if gone:
        raise ValueError(f"{context}.columns: missing {gone}")
    checks = {f"null_{c}": f"`{c}` IS NULL" for c in required} | {k: v for k, v in CHECKS.items() if not k.startswith("null_")}
    found = violations(panel, checks).first()
    for k in checks:
        if found[k]:
            raise ValueError(f"{context}.{k}: {found[k]} row(s)")
    return panel


def upsert_prefix(old: DataFrame, new: DataFrame, key: str, prefix: str) -> DataFrame:
    """``old`` without the keys of a prefix, and ``new``: the same again changes nothing."""
    return old.where(~F.coalesce(F.col(key).startswith(prefix), F.lit(False))).unionByName(new, allowMissingColumns=True)


def renamed(rows: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Renames where the source exists, the target doesn't, and no other source that exists has that target."""
    targets = [b for a, b in names.items() if a in rows.columns]
    ok = {a: b for a, b in names.items() if a in rows.columns and b not in rows.columns and targets.count(b) == 1}
    return rows.withColumnsRenamed(ok)


def canonical_blocs(rows: DataFrame, label: str, strict: bool = True) -> DataFrame:
    """``rows`` with ``bloc``; an unknown label is an error if ``strict``, else its row is left out."""
    from psephos.functions.text import bloc_label

    known = dims.small(dims.aliases(rows.sparkSession).withColumnRenamed("label", "_label").withColumnRenamed("bloc", "_bloc"))
    joined = rows.withColumn("_key", bloc_label(F.col(label))).join(known, F.col("_key") == F.col("_label"), "left" if strict else "inner")
    found = F.when(F.col("_key").isNull() | F.col("_bloc").isNotNull(), F.col("_bloc"))
    if strict:
        found = found.otherwise(F.raise_error(F.concat(F.lit("unknown bloc label: "), F.col(label))))
    return joined.withColumn("bloc", found).drop("_key", "_label", "_bloc")


def union_all(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
