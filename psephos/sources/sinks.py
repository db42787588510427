"""Sinks: partitioned tables, envelopes of posts, small artifacts, reports, the audit table."""

from __future__ import annotations

import json
from collections.abc import Sequence
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from psephos import dims

# Characters of LaTeX and how they are written.
LATEX = {"\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}


def write_panel(panel: DataFrame, path: str) -> None:
    """One table, a folder for each stratum."""
    strata = dims.small(dims.blocs(panel.sparkSession).select("bloc", "stratum"))
    panel.drop("stratum").join(strata, "bloc").write.mode("overwrite").partitionBy("stratum").parquet(path)


def enveloped(posts: DataFrame, stage: str, seed: int, collected_at: str) -> DataFrame:
    """``value``: a JSON envelope around each post."""
    head = [F.lit(1).alias("schema_version"), F.lit(stage).alias("stage"), F.lit(collected_at).alias("collected_at"), F.lit(seed).alias("seed")]
    return posts.select(F.to_json(F.struct(*head, F.struct(*posts.columns).alias("payload"))).alias("value"))


def write_posts(posts: DataFrame, path: str, by: Sequence[str], stage: str, seed: int, collected_at: str) -> None:
    """Overwrites the folders of the groups that ``posts`` has, and no others."""
    rows = posts.select(*[F.col(c).alias(f"part_{c}") for c in by], *posts.columns)
    head = [F.lit(1).alias("schema_version"), F.lit(stage).alias("stage"), F.lit(collected_at).alias("collected_at"), F.lit(seed).alias("seed")]
    out = rows.select(*[F.col(f"part_{c}").alias(c) for c in by], F.to_json(F.struct(*head, F.struct(*posts.columns).alias("payload"))).alias("value"))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).text(path)


def write_json(value: Any, path: str | Path) -> None:
    """A small artifact: sorted keys, two spaces, a line feed at the end."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(value, sort_keys=True, indent=2, ensure_ascii=False) + "\n", encoding="utf-8")


def read_json(path: str | Path) -> Any:
    return json.loads(Path(path).read_text(encoding="utf-8"))


def write_csv(rows: DataFrame, path: str, fields: Sequence[str]) -> None:
    """The named fields; missing ones stay empty."""
    have = [F.col(f) if f in rows.columns else F.lit(None).cast("string").alias(f) for f in fields]
    rows.select(*have).write.mode("overwrite").option("header", True).csv(path)


def latex(rows: DataFrame, columns: Sequence[str], most: int = 200) -> str:
    """A booktabs table of a report; more than ``most`` rows are refused."""
    got = rows.select(*columns).limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"a report has {most} rows at most")

    def cell(x: Any) -> str:
        if x is None or x != x:
            return "--"
        return f"{x:.4f}" if isinstance(x, float) else "".join(LATEX.get(c, c) for c in str(x))

    body = [" & ".join(map(cell, r)) + r" \\" for r in [columns, *got]]
    return "\n".join([rf"\begin{{tabular}}{{{'l' * len(columns)}}}", r"\toprule", body[0], r"\midrule", *body[1:], r"\bottomrule", r"\end{tabular}", ""])


AUDIT = "id string, timestamp timestamp, event_text string, intensity double, deltas_json string, feasible boolean, target_met boolean, win_prob double, estimate_ms double, solve_ms double, simulate_ms double, backend string"


def audit_append(spark: SparkSession, path: str, records: Sequence[tuple]) -> None:
    """Appends estimates; numbers that aren't finite become null."""
    rows = spark.createDataFrame(records, AUDIT)
    doubles = [f.name for f in rows.schema if f.dataType.simpleString() == "double"]
    finite = {c: F.when(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.col(c)) for c in doubles}
    rows.withColumns(finite).write.mode("append").parquet(path)


def audit_latest(spark: SparkSession, path: str, n: int = 50) -> DataFrame:
    return spark.read.schema(AUDIT).parquet(path).orderBy(F.desc("timestamp"), "id").limit(n)
