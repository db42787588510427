"""Readers: survey extracts, exit polls, post archives, prices, and archives of pages."""

from __future__ import annotations

import gzip
import io
import re
import zipfile
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition

from psephos.functions import scalars, text
from psephos.operators import relational

#: What survey files write for nothing.
MISSING = ["", "NA", "N/A", "NaN", "null"]

#: Columns of a post, in order; all are strings.
POST = ["id", "text", "created_at", "lang", "source", "archive_id", "platform", "shock_id", "author_did", "author_handle", "author_description", "inference_method"]

#: Names that archives give to the columns of a post, first choice first.
POST_NAMES = {
    "id": ["id", "post_id", "tweet_id", "message_id", "uuid"],
    "text": ["text", "body", "full_text", "content", "selftext", "message", "title"],
    "created_at": ["created_at", "created_utc", "timestamp", "date", "published", "collected_at"],
    "lang": ["lang", "language"],
    "source": ["source", "outlet", "site", "domain"],
    "author_did": ["author_did", "author_id", "user_id"],
    "author_handle": ["author_handle", "author", "username", "screen_name"],
    "author_description": ["author_description", "description", "bio"],
}


def blank_to_null(c: Column) -> Column:
    return F.when(~c.isin(MISSING), c)


def panel_csv(spark: SparkSession, path: str | Sequence[str], numbers: Iterable[str] = ("vote_share", "turnout", "stratum_share", "se")) -> DataFrame:
    """A panel file: text columns, ``cycle`` as a whole number, the named columns as doubles; what isn't a number is null."""
    raw = spark.read.option("header", True).option("escape", '"').csv(path)
    cols = {c: blank_to_null(F.col(f"`{c}`")) for c in raw.columns}
    out = {c: scalars.number(v) if c in set(numbers) else v for c, v in cols.items()}
    if "cycle" in out:
        out["cycle"] = scalars.number(cols["cycle"]).cast("long")
    return raw.select(*[v.alias(c) for c, v in out.items()])


def any_table(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """Parquet by its suffix, else CSV (or TSV) with a header."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    sep = "\t" if path.endswith((".tsv", ".tab")) else ","
    return spark.read.option("header", True).option("encoding", encoding).option("sep", sep).option("multiLine", True).option("escape", '"').csv(path)


def survey(spark: SparkSession, path: str, names: Mapping[str, str], source: str, cycle: int | None = None, encoding: str = "UTF-8") -> DataFrame:
    """A survey extract with its columns renamed, a source tag and, for one-wave files, the cycle."""
    out = relational.renamed(any_table(spark, path, encoding), names).withColumn("source", F.lit(source))
    return out.withColumn("cycle", F.lit(cycle)) if cycle else out


def exit_polls(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Exit-poll files named ``nep_YYYY_...``: the cycle comes from the name; a file without one is an error."""
    raw = spark.read.option("header", True).option("escape", '"').csv(path)
    year = F.regexp_extract(F.col("_metadata.file_name"), r"nep_(\d{4})_", 1)
    cycle = F.when(year != "", year.cast("int")).otherwise(F.raise_error(F.concat(F.lit("no cycle in the name of "), F.col("_metadata.file_name"))).cast("int"))
    return raw.select("*", cycle.alias("cycle"), F.lit("NEP").alias("source"))


def exit_poll_panel(polls: DataFrame) -> DataFrame:
    """``cycle, bloc, vote_share, se, source``: race, religion and gender rows; evangelicals from their own question; other labels left out."""
    category, label = F.lower("category"), F.lower(text.strip(F.col("sub_category")))
    evangelical = category.rlike("evang|born") & label.rlike(r"\byes\b|y\s+e\s+s")
    gender = category.rlike("gender|sex") & ~category.rlike("marital|education|white|race|income")
    rows = polls.where(category.rlike(r"\brace\b") | category.contains("relig") | gender | evangelical)
    rows = rows.withColumn("label", F.when(evangelical, "evangelical").otherwise(F.col("sub_category")))
    known = relational.canonical_blocs(rows, "label", strict=False)
    share, size = scalars.number(F.col("dem_pct")) / 100, scalars.number(F.col("n_total")) * scalars.number(F.col("sub_pct")) / 100
    cells = known.select("cycle", "bloc", "source", share.alias("share"), size.alias("n")).where("share IS NOT NULL")
    means = cells.groupBy("cycle", "bloc", "source").agg(F.avg("share").alias("vote_share"), F.avg("n").alias("n"))
    se = F.when(F.col("n").isNotNull(), F.sqrt(F.col("vote_share") * (1 - F.col("vote_share")) / F.greatest("n", F.lit(1.0))))
    return means.select("cycle", "bloc", "vote_share", se.alias("se"), "source")


def unwrapped(lines: DataFrame, *keep: str) -> DataFrame:
    """``keep``, ``raw, body`` of ``lines (value)``: each line's JSON as a variant, the payload of an envelope unwrapped; blank and malformed lines left out."""
    parsed = lines.where(F.trim("value") != "").select(*keep, F.col("value").alias("raw"), F.try_parse_json("value").alias("v")).where("v IS NOT NULL")
    return parsed.select(*keep, "raw", F.coalesce(F.expr("try_variant_get(v, '$.payload', 'variant')"), F.col("v")).alias("body"))


def json_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """The lines of files, ``unwrapped``. Reads .gz and .bz2 too."""
    return unwrapped(spark.read.text(path))


def merged(lines: DataFrame, *keep: str) -> DataFrame:
    """``keep``, ``text, payload``: the records of all platforms' ``lines (value)`` without their envelopes; those without a text are left out."""
    body = unwrapped(lines, *keep).withColumn("text", F.expr("try_variant_get(body, '$.text', 'string')"))
    return body.where("text <> ''").select(*keep, "text", F.to_json("body").alias("payload"))


def posts(spark: SparkSession, path: str | Sequence[str], platform: str, archive_id: str | None = None) -> DataFrame:
    """Posts of an archive of JSON lines in the columns of ``POST``: for each the first filled of the names archives use; a missing id is a hash of the text."""
    body = json_lines(spark, path)
    got = lambda name: F.expr(f"try_variant_get(body, '$.{name}', 'string')")
    found = {c: text.first_filled(*[got(n) for n in names]) for c, names in POST_NAMES.items()}
    given = {"platform": F.lit(platform), "archive_id": F.lit(archive_id).cast("string"), "shock_id": got("shock_id"), "inference_method": got("inference_method")}
    columns = found | given
    columns["id"] = F.coalesce(columns["id"], F.xxhash64(columns["text"]).cast("string"))
    return body.select(*[columns[c].alias(c) for c in POST]).where("text IS NOT NULL")


def telegram(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Messages of channel exports: one JSON a file; text parts of a message are joined."""
    schema = "name string, messages array<struct<id: string, date: string, text: string>>"
    rows = spark.read.option("multiLine", True).schema(schema).json(path).select("name", F.explode("messages").alias("m"))
    parts = F.from_json("m.text", "array<string>")
    plain = F.array_join(F.transform(parts, lambda p: F.coalesce(F.get_json_object(p, "$.text"), p)), "")
    return rows.select(F.col("m.id").alias("id"), F.coalesce(plain, F.col("m.text")).alias("text"), F.col("m.date").alias("created_at"), F.col("name").alias("source"))


def prices(spark: SparkSession, path: str) -> DataFrame:
    """Daily prices ``day, price, volume``; rows without a date or price are left out."""
    raw = spark.read.option("header", True).csv(path)
    day = F.coalesce(*[F.try_to_date(F.trim("Date"), f) for f in ("MM/dd/yy", "MM/dd/yyyy", "yyyy-MM-dd")])
    rows = raw.select(day.alias("day"), scalars.number(F.col("LastPrice")).alias("price"), scalars.number(F.col("Volume")).alias("volume"))
    return rows.where("day IS NOT NULL AND price IS NOT NULL")


def months(start: str, end: str, before: int = 30, after: int = 0) -> Column:
    """The first days of all months that a window touches, for pruning of month partitions."""
    return F.sequence(F.trunc(F.date_sub(F.col(start), before), "MM"), F.trunc(F.date_add(F.col(end), after), "MM"), F.expr("INTERVAL 1 MONTH"))


def sampling_tasks(shocks: DataFrame, before: int = 3, after: int = 14) -> DataFrame:
    """One row for each active shock and archive, with its window in days around the date unless one is given."""
    rows = shocks.where(F.coalesce("active", F.lit(True))).select("id", "date", "date_window", F.explode("archive_ids").alias("archive_id"))
    start, end = F.coalesce("date_window.start", F.date_sub("date", before)), F.coalesce("date_window.end", F.date_add("date", after))
    return rows.select("id", "archive_id", start.alias("start"), end.alias("end"))


class _Member(InputPartition):
    def __init__(self, path: str, names: list[str]) -> None:
        self.path, self.names = path, names


class _ZipReader(DataSourceReader):
    """Members are listed from the directory of each archive; filters on the state, year and kind in a member's path prune before anything is inflated."""

    PATH = re.compile(r"(?:^|/)(?P<state>[A-Za-z]{2})/(?P<year>\d{4})/(?P<kind>[^/]+)/")

    def __init__(self, options: Mapping[str, str]) -> None:
        self.paths, self.size, self.wanted = options["path"].split(","), int(options.get("members", "200")), {}

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and f.attribute[0] in ("state", "year", "kind"):
                self.wanted[f.attribute[0]] = str(f.value)
            else:
                yield f

    def partitions(self):
        out = []
        for path in self.paths:
            with zipfile.ZipFile(path) as z:
                names = [n for n in z.namelist() if (m := self.PATH.search(n)) and all(m[k] == v for k, v in self.wanted.items())]
            out += [_Member(path, names[i : i + self.size]) for i in range(0, len(names), self.size)]
        return out or [_Member("", [])]

    def read(self, partition):
        if not partition.names:
            return
        with zipfile.ZipFile(partition.path) as z:
            for n in partition.names:
                raw = z.read(n)
                if n.endswith(".gz"):
                    raw = gzip.GzipFile(fileobj=io.BytesIO(raw)).read()
                m = self.PATH.search(n)
                yield (n, m["state"], m["year"], m["kind"], raw.decode("utf-8", "replace"))


class ZippedPages(DataSource):
    """``spark.read.format("zipped_pages").load(path)``: pages in zip archives, one row for each member.

    The archives must be on a path all executors see. Needs ``spark.sql.python.filterPushdown.enabled``.
    """

    @classmethod
    def name(cls) -> str:
        return "zipped_pages"

    def schema(self) -> str:
        return "member string, state string, year string, kind string, html string"

    def reader(self, schema) -> DataSourceReader:
        return _ZipReader(self.options)


def articles(rows: DataFrame, since: str | None = None, until: str | None = None, states: Sequence[str] = (), outlet: str | None = None) -> DataFrame:
    """Articles (``state, url, date`` and names of the outlet, where there are) of a span of days, some states and one outlet.

    An article without a date passes the span. The outlet's name may stand in
    the first filled of ``outlet, source, domain`` or in the host. Case doesn't
    count.
    """
    got = lambda *names: text.first_filled(*[F.col(n) for n in names if n in rows.columns], F.lit(None).cast("string"))
    day = F.try_to_date(F.substring(got("date", "published", "created_at"), 1, 10), "yyyy-MM-dd")
    keep = F.lit(True)
    if since:
        keep &= F.coalesce(day >= F.lit(since).cast("date"), F.lit(True))
    if until:
        keep &= F.coalesce(day <= F.lit(until).cast("date"), F.lit(True))
    if states:
        keep &= F.coalesce(F.upper(got("state")).isin([s.upper() for s in states]), F.lit(False))
    if outlet:
        host = F.lower(F.regexp_extract(got("url", "link"), "https?://([^/]+)", 1))
        named = F.lower(got("outlet", "source", "domain")).contains(outlet.lower())
        keep &= F.coalesce(named, F.lit(False)) | F.coalesce(host.contains(outlet.lower()), F.lit(False))
    return rows.where(keep)


def outlet_proxy(description: Column) -> Column:
    """The weights of an outlet's readers, by bloc, from a description that is JSON with ``proxy``: ``{race, religion, gender}``; null without any. A name in several strata has the first one's weight."""
    kind = "struct<proxy: struct<race: map<string,double>, religion: map<string,double>, gender: map<string,double>>>"
    proxy = F.from_json(description, kind)["proxy"]
    parts = [F.coalesce(proxy[s], F.create_map().cast("map<string,double>")) for s in ("race", "religion", "gender")]
    both = reduce(lambda a, b: F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, y)), parts)
    return F.when(F.size(both) > 0, both)


def json_strings(c: Column) -> Column:
    """All string values of a JSON text at any depth, in order; none for what is no JSON. Keys are no values."""
    mark = r'"((?:[^"\\]|\\.)*)"\s*(?!\s*:)(?=[,\]}\s]|$)'
    found = F.regexp_extract_all(c, F.lit(mark), F.lit(1))
    plain = F.transform(found, lambda s: F.from_json(F.concat(F.lit('["'), s, F.lit('"]')), "array<string>")[0])
    return F.when(F.try_parse_json(c).isNotNull(), plain).otherwise(F.array().cast("array<string>"))


def span_of(shock_day: Column, before: int, after: int, start: Column | None = None, end: Column | None = None) -> Column:
    """The days ``start`` and ``end`` of a window and its ``cutoff``, 30 days past the end, beyond which no file need be read."""
    first, last = F.coalesce(start, F.date_sub(shock_day, before)) if start is not None else F.date_sub(shock_day, before), F.date_add(shock_day, after)
    last = F.coalesce(end, last) if end is not None else last
    return F.struct(first.alias("start"), last.alias("end"), F.date_add(last, 30).alias("cutoff"))


def dated_files(spark: SparkSession, path: str, start: str, end: str, pattern: str = r"(\d{4}-\d{2}-\d{2})") -> DataFrame:
    """Lines (``value, day``) of files whose name has a day in [start, end]; names alone decide which are opened."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")  # names only: contents are pruned
    day = F.regexp_extract(F.element_at(F.split("path", "/"), -1), pattern, 1)
    names = [r.path for r in listed.where(day.between(start, end)).sort("path").collect()]  # files of the span
    if not names:
        return spark.createDataFrame([], "value string, day string")
    return spark.read.text(names).select("value", F.regexp_extract(F.col("_metadata.file_name"), pattern, 1).alias("day"))
