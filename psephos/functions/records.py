"""Records of a model's training and output: bins parsed from text, prompts, checks, splits."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from psephos import dims

BLOC_NAMES = [b for names in dims.BLOCS.values() for b in names]


def parsed_bins(text: Column) -> Column:
    """A map from each bloc to its bin: from a JSON object in the text, else from ``bloc: token``; neutral where there is none that is known."""
    found = F.from_json(F.regexp_extract(text, r"(?s)\{[^{}]*\}", 0), "map<string,string>")
    tokens = "|".join(dims.BINS)
    pairs = []
    for b in BLOC_NAMES:
        plain = F.regexp_extract(text, rf"\b{b}\W+({tokens})\b", 1)
        token = F.coalesce(F.element_at(found, F.lit(b)), F.nullif(plain, F.lit("")))
        pairs += [F.lit(b), F.when(token.isin(dims.BINS), token).otherwise("neutral")]
    return F.create_map(*pairs)


def errors(delta: Column, intensity: Column, token: Column) -> Column:
    """What is wrong with a synthetic record, in order."""
    return F.array_compact(
        F.array(
            F.when(delta.isNull(), "delta missing"), F.when(F.abs(delta) > 0.15, "delta out of range"),
            F.when(intensity.isNull() | ~intensity.between(0.8, 1.2), "intensity out of range"), F.when(~F.coalesce(token.isin(dims.BINS), F.lit(False)), "unknown bin"),
        )
    )


def prompt(description: Column, party: Column, year: Column) -> Column:
    return F.format_string("Event: %s\nParty: %s\nYear: %d\nAnswer with one bin for each bloc.", description, party, year)


def split(year: Column, held_out: int = 2020) -> Column:
    return F.when(year == held_out, "eval").otherwise("train")


def record_weight(source: Column) -> Column:
    """Observed records weigh 1.5, reviewed ones 1, synthetic ones 0.5."""
    return F.when(source == "observed", 1.5).when(source == "reviewed", 1.0).otherwise(0.5)


#: What a scan for objects stops at: whole strings, a string that is cut off, and brackets.
MARKS = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*(?:"|\\?\Z)|[{}]', re.S)
FENCE = re.compile(r"^```.*$", re.M)


def whole_objects(text: str) -> list[str]:
    """The JSON objects that stand whole in a model's answer, in order: those of its array, even if the array is cut off.

    A scan keeps the depth of brackets outside strings; what closes at depth 0
    is a candidate, and stays if it parses. Fences and words around it don't
    count. A quote in the words between objects opens no string.
    """
    text = FENCE.sub("", text)
    out, depth, start, at = [], 0, 0, 0
    while m := MARKS.search(text, at):
        mark, at = m[0], m.end()
        if mark[0] == '"':
            if not depth:
                at = m.start() + 1
        elif mark == "{":
            start, depth = (m.start() if not depth else start), depth + 1
        elif depth:
            depth -= 1
            if not depth:
                try:
                    json.loads(text[start:at])
                except ValueError:
                    continue
                out.append(text[start:at])
    return out


def objects(text: Column) -> Column:
    """``whole_objects`` of each answer as an array of JSON texts, in batches; none for null."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([whole_objects(t) if t is not None else [] for t in s], dtype=object)

    return F.pandas_udf(run, "array<string>")(text)


def object_rows(answers: DataFrame, key: str, text: str, schema: str) -> DataFrame:
    """``key, place``, and a column for each field of ``schema``: a row for each whole object of each answer; a field that is absent or of another kind is null."""
    rows = answers.select(key, F.posexplode(objects(F.col(text))).alias("place", "_o"))
    return rows.select(key, "place", F.from_json("_o", schema).alias("_f")).select(key, "place", "_f.*")


def kept_flags(text: Column, n: Column) -> Column:
    """``n`` flags from lines such as ``3. yes``: the last line for a number counts, and a number without a line is kept, as all are where there is no answer."""
    line = r"^\s*(\d{1,9})[.:\s)]+(\w+)"
    pairs = F.transform(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\r?\n"), lambda x: F.struct(F.try_to_number(F.nullif(F.regexp_extract(x, line, 1), F.lit("")), F.lit("999999999")).cast("int").alias("i"), F.regexp_extract(x, line, 2).startswith("y").alias("yes")))
    said = F.filter(pairs, lambda p: p["i"].isNotNull())
    each = lambda i: F.coalesce(F.try_element_at(F.filter(said, lambda p: p["i"] == i), F.lit(-1))["yes"], F.lit(True))
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), each)).otherwise(F.array().cast("array<boolean>"))
