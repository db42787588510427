"""Poll tables to long rows: nested questions, wide tables with headings over gaps, repeated sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from psephos.operators import ordered, relational

#: A poll as it is stored.
POLL = "metadata struct<source: string, dates: string, sample_size: long, moe: double>, questions array<struct<question_num: string, question_text: string, notes: string, responses: array<struct<label: string, pct: double>>>>"


def nested_rows(polls: DataFrame) -> DataFrame:
    """``source, poll_dates, sample_size, moe, question_num, question_text, response, pct, notes``: a row for each response of each question. Questions without responses have none; a question without notes has the empty text."""
    q = polls.select("metadata.*", F.explode("questions").alias("q")).select("*", F.explode("q.responses").alias("r"))
    return q.select("source", F.col("dates").alias("poll_dates"), "sample_size", "moe", "q.question_num", "q.question_text", F.col("r.label").alias("response"), "r.pct", F.coalesce("q.notes", F.lit("")).alias("notes"))


def first_by_url(polls: DataFrame, url: str, order: str) -> DataFrame:
    """Of the polls with one address the first by ``order``; polls without an address stay each."""
    known = polls.where(F.col(url).isNotNull())
    return relational.keep_first(known, F.col(url), order).unionByName(polls.where(F.col(url).isNull()))


def percent(c: Column) -> Column:
    """A share in percent from ``48``, ``48%`` or ``<1%``; null for dashes and words."""
    return F.try_to_number(F.nullif(F.regexp_extract(F.trim(c.cast("string")), r"^<?\s*(\d{1,3}(?:\.\d+)?)\s*%?$", 1), F.lit("")), F.lit("999.999")).cast("double")


def long_rows(rows: DataFrame, table: str, line: str, headings: Sequence[str], columns: Sequence[str], name: str = "response", value: str = "pct") -> DataFrame:
    """``table, line``, the headings, ``response, pct``: a row for each cell of wide tables with a known share.

    A heading stands in its first line only and holds for the lines below until
    the next one of its table (``ordered.running``, so a table of any length
    will do). Columns that a table lacks are null and give no row. Lines before
    any heading keep a null one. The lines of a table are numbered.
    """
    text = [F.nullif(F.trim(F.col(h)), F.lit("")).alias(h) for h in headings]
    filled = ordered.running(rows.select(table, line, *text, *columns), [table], [line], lasts=headings)
    cells = filled.select(table, line, *headings, *[percent(F.col(c)).alias(c) for c in columns])
    return cells.unpivot([table, line, *headings], list(columns), name, value).where(F.col(value).isNotNull())
