"""Text columns: labels, posts, predicates, keys."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"

# Acronyms and what they stand for (case counts).
ACRONYMS = {"SCOTUS": "Supreme Court", "POTUS": "President", "FLOTUS": "First Lady", "VPOTUS": "Vice President", "MAGA": "Make America Great Again"}

DELETED = ["[deleted]", "[removed]", "[removed by reddit]"]
URL = r"https?://\S+"
EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{FE0F}\s]"


def strip(c: Column) -> Column:
    """Without white space at both ends (``trim`` takes spaces only)."""
    return F.btrim(c, F.lit(SPACES))


def bloc_label(c: Column) -> Column:
    """A survey label in snake case; null if nothing is left."""
    out = F.lower(strip(c))
    for pattern, to in ((r"[\s/\-.]+", "_"), (r"[^a-z0-9_]", ""), (r"_+", "_"), (r"^_+|_+$", "")):
        out = F.regexp_replace(out, pattern, to)
    return F.nullif(out, F.lit(""))


def first_filled(*columns: Column) -> Column:
    """The first column that is neither null nor blank."""
    return F.coalesce(*[F.when(strip(c) != "", c) for c in columns])


def clean_post(c: Column) -> Column:
    """Acronyms spelled out; links and mentions gone; hashtags without their mark; white space collapsed."""
    out = c
    for short, full in ACRONYMS.items():
        out = F.regexp_replace(out, rf"\b{short}\b", full)
    for pattern, to in ((URL, ""), (r"(?U)@\w+", ""), (r"(?U)#(\w+)", "$1"), (r"\s{2,}", " ")):
        out = F.regexp_replace(out, pattern, to)
    return strip(out)


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def first_words(c: Column, n: int = 128) -> Column:
    return F.array_join(F.slice(words(c), 1, n), " ")


def holds_any(c: Column, keywords: Iterable[str]) -> Column:
    """Whether the lower-cased text has one of the keywords in it; one pass."""
    return F.lower(c).rlike("|".join(re.escape(k.lower()) for k in keywords))


def is_spam(c: Column) -> Column:
    """Retweets, texts of emoji or one link only, and texts of under 10 characters without links and mentions."""
    bare = strip(F.regexp_replace(F.regexp_replace(c, URL, ""), r"@\w+", ""))
    return c.rlike(r"(?i)^RT\s+@\w+") | (F.regexp_replace(c, EMOJI, "") == "") | strip(c).rlike(rf"^({URL})$") | (F.length(bare) < 10)


def is_kept_body(c: Column, least: int = 10) -> Column:
    """Not deleted, and long enough; false for null."""
    return F.coalesce(~F.lower(strip(c)).isin(DELETED) & (F.length(strip(c)) >= least), F.lit(False))


def without_tags(c: Column) -> Column:
    return F.regexp_replace(c, r"<[^>]+>", " ")


def html_title(c: Column) -> Column:
    return F.nullif(strip(F.regexp_extract(c, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def short_key(c: Column, size: int = 16) -> Column:
    """The first hex digits of a SHA-256."""
    return F.substring(F.sha2(c, 256), 1, size)


def outlet_slug(c: Column) -> Column:
    return F.translate(F.lower(c), "- ", "__")


def outlet_of(url: Column) -> Column:
    """The first label of the host, without www."""
    return F.split_part(F.regexp_replace(F.try_parse_url(url, F.lit("HOST")), r"^www\.", ""), F.lit("."), F.lit(1))


def language_tag(tags: Column) -> Column:
    """The first filled entry of an array of tags, in lower case."""
    return F.lower(strip(F.get(F.filter(tags, lambda t: strip(t) != ""), F.lit(0))))


def is_english(lang: Column) -> Column:
    """English, or not told."""
    return F.coalesce((lang == "") | (F.substring(lang, 1, 2) == "en"), F.lit(True))
