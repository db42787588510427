"""Posts of single platforms' archives: each platform's names for the fields of a post, the folders of archives, and windows around a shock.

A line's JSON stays a variant, so one narrow pass reads a mixture of platforms.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from psephos.functions import scalars, text
from psephos.operators import joins
from psephos.sources import readers


@dataclass(frozen=True)
class Platform:
    """Names of a post's fields, first choice first; a dot leads into an object.

    ``author`` and ``handle`` name the author, ``outlet`` the paper instead.
    ``any_kind`` takes numbers and lists of parts as texts, too; otherwise a
    text that is no string is none. ``archive`` stands where a caller names no
    archive.
    """

    name: str
    text: Sequence[str]
    id: Sequence[str]
    created: Sequence[str]
    lang: Sequence[str] = ()
    author: Sequence[str] = ()
    handle: Sequence[str] = ()
    outlet: Sequence[str] = ()
    site: Sequence[str] = ()
    gone: Sequence[str] = ()
    archive: str | None = None
    method: str | None = None
    any_kind: bool = False
    scores: Sequence[str] = ()


# What archives of each platform call the fields of a post.
PLATFORMS = {
    "reddit": Platform(
        name="reddit",
        text=("selftext", "body", "text", "title"),
        id=("id", "post_id", "name"),
        created=("created_utc", "created_at", "timestamp"),
        author=("author",),
        handle=("author",),
        gone=("[deleted]", "[removed]"),
        method="subreddit_proxy",
    ),
    "webhose": Platform(
        name="news",
        text=("text", "body", "title", "summary"),
        id=("uuid", "id"),
        created=("published", "crawled", "created_at"),
        lang=("language",),
        site=("thread.site", "site_full", "site"),
        archive="webhose",
    ),
    "3dlnews": Platform(
        name="news",
        text=("content", "article_text", "text", "title"),
        id=("id", "url"),
        created=("date", "published_at", "created_at"),
        lang=("language",),
        outlet=("outlet", "source", "domain"),
        archive="3dlnews",
    ),
    "discord": Platform(
        name="discord",
        text=("content", "text"),
        id=("id", "message_id"),
        created=("timestamp", "created_at"),
        author=("author.id",),
        handle=("author.username",),
        archive="discord",
    ),
    "telegram": Platform(
        name="telegram",
        text=("text", "message", "content"),
        id=("id", "message_id"),
        created=("date", "date_unixtime"),
        lang=("lang", "language"),
        author=("from.id", "from", "from_id"),
        handle=("from.username", "from.first_name", "post_author"),
        method="platform_proxy",
        any_kind=True,
        scores=("toxicity", "severe_toxicity", "identity_attack"),
    ),
    "tiktok": Platform(
        name="tiktok",
        text=("desc", "text", "title"),
        id=("id",),
        created=("createTime", "create_time", "created_at"),
        lang=("textLanguage", "lang"),
        author=("author.id", "author.uid", "author"),
        handle=("author.uniqueId", "author.nickname"),
        method="platform_proxy",
        any_kind=True,
    ),
}


def field(path: str, lists: bool = False) -> tuple[Column, Column]:
    """The kind and the string of a field of ``body``; both null where it is absent, empty, an object or a JSON null. ``lists`` joins the parts of a list."""
    kind = F.expr(f"schema_of_variant(try_variant_get(body, '$.{path}', 'variant'))")
    value = F.when(~kind.startswith("OBJECT") & ~kind.startswith("ARRAY"), F.expr(f"try_variant_get(body, '$.{path}', 'string')"))
    if lists:
        parts = F.expr(f"try_variant_get(body, '$.{path}', 'array<variant>')")
        plain = lambda x: F.when(~F.schema_of_variant(x).startswith("OBJECT"), F.try_variant_get(x, "$", "string"))
        joined = F.array_join(F.transform(parts, lambda x: F.coalesce(F.try_variant_get(x, "$.text", "string"), plain(x), F.lit(""))), " ")
        value = F.coalesce(value, joined)
    return F.when(value != "", kind), F.nullif(value, F.lit(""))


def first(paths: Sequence[str]) -> Column:
    return F.coalesce(*[field(p)[1] for p in paths]) if paths else F.lit(None).cast("string")


def said_by(p: Platform) -> Column:
    """``said, fits``: the first filled text, and whether its kind is one that the platform's texts have."""
    each = [field(path, p.any_kind) for path in p.text]
    fits = lambda kind: F.lit(True) if p.any_kind else kind == "STRING"
    return F.coalesce(*[F.when(v.isNotNull(), F.struct(text.strip(v).alias("said"), fits(k).alias("fits"))) for k, v in each])


def columns_of(key: str, p: Platform) -> dict[str, Column]:
    """The columns of a post by the rules of one platform, but for its text."""
    nothing, paper = F.lit(None).cast("string"), bool(p.outlet or p.site)
    outlet = F.substring_index(F.replace(first(p.site), F.lit("www.")), ".", 1) if p.site else first(p.outlet)
    outlet = F.coalesce(outlet, F.lit("unknown"))
    prefixed = lambda c: F.concat(F.lit(f"{key}:"), c)
    scored = F.array(*[F.struct(F.lit(s).alias("key"), scalars.number(field(s)[1]).alias("value")) for s in p.scores])
    return {
        "id": prefixed(F.coalesce(first(p.id), F.lower(F.hex(F.xxhash64("text"))))),
        "_created": first(p.created),
        "lang": F.coalesce(first(p.lang), F.lit("en")),
        "archive_id": F.coalesce("_archive", F.lit(p.archive).cast("string")),
        "platform": F.lit(p.name),
        "author_did": nothing if paper else prefixed(first(p.author)),
        "author_handle": outlet if paper else first(p.handle),
        "inference_method": F.lit(p.method).cast("string"),
        "_paper": F.lit(paper),
        "metadata": F.map_from_entries(F.filter(scored, lambda x: x["value"].isNotNull())) if p.scores else F.lit(None).cast("map<string,double>"),
    }


def once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """``rows`` with a column that is worked out once a row.

    Filters and projections are not merged with what lies under a generator, so
    the many columns that read this one do not each hold its whole expression.
    """
    return rows.select(*[c for c in rows.columns if c != name], F.explode(F.array(value)).alias(name))


def by_kind(rules: dict[str, Column]) -> Column:
    return F.coalesce(*[F.when(F.col("_kind") == k, c) for k, c in rules.items()])


def platform_posts(bodies: DataFrame, kind: Column, archive: Column | None = None, keywords: DataFrame | None = None, *keep: str) -> DataFrame:
    """Posts (``keep``, columns of ``readers.POST``, ``metadata``) of ``bodies (body variant)``, each by the rules of its ``kind``, a key of ``PLATFORMS``.

    A post without a text, with a deleted one or of another kind is left out; a
    missing id is a hash of the text. ``shock_id`` is the first of the topics
    of ``keywords (topic, keyword)`` with a keyword in the text. One narrow pass.
    """
    given = F.lit(None).cast("string") if archive is None else archive
    rows = once(bodies.select(*keep, kind.alias("_kind"), given.alias("_archive"), "body"), "body", F.col("body"))
    rows = once(rows, "_said", by_kind({k: said_by(p) for k, p in PLATFORMS.items()}))
    gone = by_kind({k: F.col("_said.said").isin("", *p.gone) for k, p in PLATFORMS.items()})
    rows = rows.where(~gone & F.col("_said.fits")).withColumn("text", F.col("_said.said"))
    rules = {k: columns_of(k, p) for k, p in PLATFORMS.items()}
    names = next(iter(rules.values())).keys()
    rows = once(rows, "_post", F.struct(*[by_kind({k: r[c] for k, r in rules.items()}).alias(c) for c in names]))
    found = rows.select(*keep, "text", "_post.*")
    shock = F.lit(None).cast("string") if keywords is None else F.try_element_at(joins.matched(F.col("text"), keywords), F.lit(1)).cast("string")
    last = {
        "source": F.lit("archive"),
        "shock_id": shock,
        "created_at": scalars.timestamp(F.col("_created")),
        "author_description": F.when(F.col("_paper"), F.to_json(F.struct(F.col("author_handle").alias("outlet")))),
        "metadata": F.when(F.size("metadata") > 0, F.col("metadata")),
    }
    return found.withColumns(last).select(*keep, *readers.POST, "metadata")


def exported_messages(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """``body`` of the messages of channel exports, one JSON object with ``messages`` a file."""
    rows = spark.read.option("multiLine", True).schema("messages array<variant>").json(path)
    return rows.select(F.explode("messages").alias("body"))


def listed(spark: SparkSession, pattern: str) -> DataFrame:
    """``path`` of the files under the folders of a pattern; none if there is no such folder. Contents are not read."""
    try:
        return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(pattern).select("path")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "path string")


def archive_folder(spark: SparkSession, root: str, archive_id: str) -> str | None:
    """The folder of an archive: that of the first platform's folder, by name, that has one with a file in it, else the one in ``root`` itself, else none."""
    name = re.sub(r"([\[\]{}*?\\])", r"\\\1", archive_id)
    inside = listed(spark, f"{root}/*/{name}")
    shape = rf"^(.*/[^/]+/{re.escape(archive_id)})(?:/|$)"
    best = inside.agg(F.min(F.regexp_extract("path", shape, 1))).first()[0]
    if best:
        return best
    return f"{root}/{archive_id}" if listed(spark, f"{root}/{name}").limit(1).count() else None


def archive_bodies(spark: SparkSession, folder: str) -> DataFrame:
    """``path, body`` of a folder's files at any depth: lines of .jsonl and .json, rows of .csv and .tsv (NUL characters dropped) as objects; other files are left out."""
    found = listed(spark, folder).select(F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1)).alias("kind")).distinct()
    kinds = {r.kind for r in found.where(F.col("kind").isin("jsonl", "json", "csv", "tsv")).collect()}  # four at most
    out = []
    for kind in sorted(kinds):
        deep = {"recursiveFileLookup": True, "pathGlobFilter": f"*.{kind}"}
        if kind in ("jsonl", "json"):
            rows = spark.read.options(**deep).text(folder).select(F.col("_metadata.file_path").alias("path"), "value")
        else:
            raw = spark.read.options(**deep, header=True, multiLine=True, escape='"', sep="\t" if kind == "tsv" else ",").csv(folder)
            cells = F.struct(*[F.nullif(text.strip(F.replace(F.col(f"`{c}`"), F.lit("\0"))), F.lit("")).alias(c) for c in raw.columns])
            rows = raw.select(F.col("_metadata.file_path").alias("path"), F.to_json(cells).alias("value"))
        out.append(readers.unwrapped(rows, "path").select("path", "body"))
    if not out:
        return spark.createDataFrame([], "path string, value string").select("path", F.try_parse_json("value").alias("body"))
    both = out[0]
    for rows in out[1:]:
        both = both.unionByName(rows)
    return both


def subreddit(root: str) -> Column:
    """``reddit_`` and the name of a file's folder, or of the file where it lies in ``root`` itself."""
    parts = F.split("path", "/")
    folder, file = F.element_at(parts, -2), F.element_at(parts, -1)
    return F.concat(F.lit("reddit_"), F.when(folder == root.rstrip("/").rsplit("/", 1)[-1], F.regexp_replace(file, r"\.[^.]*$", "")).otherwise(folder))


def around(posts: DataFrame, moment: Column, hours: int = 72) -> DataFrame:
    """Posts within ``hours`` of a moment, both ends included; those without a time stay."""
    apart = F.abs(F.unix_micros("created_at") - F.unix_micros(moment))
    return posts.where(F.coalesce(apart <= hours * 3_600_000_000, F.lit(True)))


def load_archive(
    spark: SparkSession, root: str, archive_id: str, kind: str, keywords: DataFrame | None = None, moment: str | None = None, hours: int = 72, blocked: DataFrame | None = None
) -> DataFrame:
    """An archive's posts by the rules of ``kind``: around a moment, without blocked authors (first column of ``blocked``). An archive that is not there has none."""
    folder = archive_folder(spark, root, archive_id)
    bodies = archive_bodies(spark, folder or f"{root}/{archive_id}")
    posts = platform_posts(bodies, F.lit(kind), subreddit(folder) if folder and kind == "reddit" else F.lit(PLATFORMS[kind].archive or archive_id), keywords)
    if moment:
        posts = around(posts, F.lit(moment).cast("timestamp"), hours)
    return posts if blocked is None else joins.without_listed(posts, "author_did", blocked)
