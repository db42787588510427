"""Spelling variants: words one edit apart, found by dense tiles of code points, and the forms they lead to."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from psephos.llm._shared import LOWER, UPPER, durable, id_and_text, slices

RUN = re.compile(r"[a-zÀ-ÿ]+")
OUTSIDE = re.compile(r"[^a-zÀ-ÿ]")
TO_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: Distinct words a task counts before it passes the counts on.
COUNTED = 300_000
#: Code points of a text that are taken apart at once.
WINDOW = 1 << 20
#: Code-point comparisons of a tile, and of what numpy holds at once.
TILE, AT_ONCE = 1 << 20, 1 << 22


def runs(text: str) -> Iterator[list[str]]:
    """The runs of letters of a lower-cased text, a list for each window of it; windows end between runs."""
    at = 0
    while at < len(text):
        cut = OUTSIDE.search(text, at + WINDOW)
        end = cut.start() if cut else len(text)
        yield RUN.findall(text, at, end)
        at = end


def misspelt(run: str, prefix: int, every: int) -> str:
    """The run, or in one of ``every`` cases by the checksum, without one of its code points. ``prefix``: the checksum of what stands before the run."""
    h = zlib.crc32(run.encode(), prefix)
    return run if not every or h % every else run[: (i := h % len(run))] + run[i + 1 :]


def word_counts(docs: DataFrame, id_col: str, text_col: str, min_chars: int, every: int) -> DataFrame:
    """``word, n``: occurrences of words over all texts; sums of a task's part go to the shuffle."""

    def run(batches):
        total: Counter[str] = Counter()
        for b in slices(batches, WINDOW):
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                prefix = zlib.crc32(f"{'' if i is None else i}:".encode())
                for found in runs(text.translate(TO_LOWER).decode("utf-8", "replace")):
                    for r, n in Counter(found).items():
                        if len(r) >= min_chars and len(w := misspelt(r, prefix, every)) >= min_chars:
                            total[w] += n
                    if len(total) > COUNTED:
                        yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])
                        total.clear()
        yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def halved(rows: DataFrame) -> DataFrame:
    """Each row twice, for an edit in the one or the other half of the open part ``[lo, hi)`` of a word of ``size`` code points; ``key`` hashes what lies outside."""
    middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    halves = F.array(F.struct(middle.alias("lo"), F.col("hi").alias("hi")), F.struct(F.col("lo").alias("lo"), middle.alias("hi")))
    each = rows.select("word", "n", "size", F.explode(halves).alias("part")).select("word", "n", "size", "part.lo", "part.hi")
    behind = F.col("size") - F.col("hi")
    start, end = F.substring("word", F.lit(1), F.col("lo")), F.substring("word", F.length("word") - behind + 1, behind)
    return each.withColumn("key", F.xxhash64("size", "lo", "hi", start, end))


def blocks(words: DataFrame, min_chars: int, tile: int) -> DataFrame:
    """``word, n, size, lo, hi, key``: words that may be one edit apart share a key, and a key's words make one tile.

    The shorter of two near words has ``size`` code points and the longer as
    many or one more. An edit in one half of a word leaves the other half
    whole, so words meet by a half. Keys that gather more comparisons than
    ``tile`` are halved again in their open part, until one code point is open,
    where the letters bound a key's words. No pair is lost, and each belongs to
    one key only: that whose open part holds the end of its common prefix.
    """
    open_rows = words.select("word", "n", F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("size")).where(F.col("size") >= min_chars)
    open_rows = open_rows.select("word", "n", "size", F.lit(0).alias("lo"), F.col("size").alias("hi"))
    done = None
    group = ["key", "size", "lo", "hi"]
    while True:
        keyed = durable(halved(open_rows), "word-keys")
        sizes = keyed.groupBy(*group).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.length("word") == F.col("size")).alias("short"))
        shared = sizes.where((F.col("rows") > 1) & (F.col("short") > 0))
        large = (F.col("rows") * F.col("short") * F.col("size") > tile) & (F.col("hi") - F.col("lo") > 1)
        met = durable(keyed.join(shared.select(*group, large.alias("large")), group), "word-blocks")
        ready = met.where(~F.col("large")).drop("large")
        done = ready if done is None else done.unionByName(ready)
        open_rows = met.where("large").drop("large", "key")
        if open_rows.isEmpty():
            return done


def padded(words: list[bytes], width: int) -> np.ndarray:
    """Code points of words, a row each, filled up with zeros."""
    return np.array(words, f"S{width}").view(np.uint8).reshape(len(words), width)


def near_in_block(front: np.ndarray, back: np.ndarray, sizes: np.ndarray, size: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the near words of one block: the rows of its shorter words against all.

    The tile compares the padded matrices at once: the first difference from
    the front is the common prefix, that from the back the common suffix. Both
    together reach the longer length minus one in near words only.
    """
    short, out = np.flatnonzero(sizes == size), []
    step = max(1, AT_ONCE // (len(sizes) * front.shape[1]))
    for at in range(0, len(short), step):
        own = short[at : at + step]
        prefix = (front[own, None] != front[None]).argmax(2)
        suffix = (back[own, None] != back[None]).argmax(2)
        near = (prefix + suffix >= sizes[None] - 1) & (prefix >= lo) & ((prefix < hi) | (hi == size))
        near &= (sizes[None] > size) | (own[:, None] < np.arange(len(sizes))[None])  # a pair of equal length once, and no word with itself
        i, j = np.nonzero(near)
        out.append((own[i], j))
    return np.concatenate([i for i, _ in out]), np.concatenate([j for _, j in out])


def near_words(words: DataFrame, min_chars: int, tile: int = TILE) -> DataFrame:
    """``word, other, other_n``: the words of ``words (word, n)`` that are one edit apart, each pair both ways, once."""
    rows = blocks(words, min_chars, tile).repartition("key", "size", "lo", "hi").sortWithinPartitions("key", "size", "lo", "hi")

    def compared(t: pa.Table) -> Iterator[pa.RecordBatch]:
        """Of whole blocks."""
        text = [w.encode("latin-1") for w in t.column("word").to_pylist()]
        sizes = np.array([len(w) for w in text])
        keys = [t.column(c).to_numpy() for c in ("key", "size", "lo", "hi")]
        starts = np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)]))
        firsts, seconds = [], []
        for a, b in zip(starts, [*starts[1:], len(text)], strict=True):
            width = int(sizes[a:b].max())
            own = text[a:b]
            i, j = near_in_block(padded(own, width), padded([w[::-1] for w in own], width), sizes[a:b], *(int(k[a]) for k in keys[1:]))
            firsts.append(a + i)
            seconds.append(a + j)
        i, j = np.concatenate(firsts), np.concatenate(seconds)
        i, j = np.concatenate([i, j]), np.concatenate([j, i])
        if len(i):
            yield from pa.table({"word": t.column("word").take(i), "other": t.column("word").take(j), "other_n": t.column("n").take(j)}).combine_chunks().to_batches(65_536)

    def run(batches):
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([held, t]) if held is not None else t
            last = np.ones(len(t), bool)
            for c in ("key", "size", "lo", "hi"):
                x = t.column(c).to_numpy()
                last &= x == x[-1]
            cut = int(np.flatnonzero(last)[0])  # the last block may go on
            if cut:
                yield from compared(t.slice(0, cut).combine_chunks())
            held = t.slice(cut)
        if held is not None:
            yield from compared(held.combine_chunks())

    return rows.mapInArrow(run, "word string, other string, other_n long")


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of ``forms (word, form)``: the last of the forms that follow one another. Steps double from round to round; forms at least double their number, so chains are short."""
    links = durable(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        on = links.select(F.col("word").alias("via"), F.col("root").alias("further"))
        joined = durable(links.join(on, F.col("root") == F.col("via"), "left"), "roots")
        links = joined.select("word", F.coalesce("further", "root").alias("root"))
        if joined.where("further IS NOT NULL").isEmpty():
            return links


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 5, min_count: int = 3, ratio: int = 2, every: int = 97, tile: int = TILE) -> DataFrame:
    """``word, form, root, n, n_near, form_n``: the words of all texts with the more frequent spelling that each is a variant of.

    Words are runs of Latin letters, A-Z lower-cased, with ``min_chars`` code
    points and ``min_count`` occurrences; one run in ``every``, by a checksum
    of its document's id and itself, first loses a code point (0 keeps all), as
    a typing error would. Near words differ by one inserted, deleted or
    replaced code point. A word's form is its most frequent near word (the
    first in code-point order on ties) if that occurs ``ratio`` times as often;
    its root is where forms lead in the end, itself without one.

    Texts are read once, and only counts are shuffled. Null texts have no
    words, a null id counts as the empty text, repeated rows count each, and an
    empty table gives an empty result.
    """
    counts = word_counts(docs, id_col, text_col, min_chars, every)
    words = durable(counts.where(F.col("n") >= min_count), "words")
    best = F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("word")))
    near = near_words(words, min_chars, tile).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    joined = words.join(near.withColumnRenamed("word", "of"), F.col("word") == F.col("of"), "left")
    leads = -F.col("best.n") >= ratio * F.col("n")
    found = durable(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(leads, F.col("best.word")).alias("form"), F.when(leads, -F.col("best.n")).alias("form_n")), "variants")
    ends = roots(found.where("form IS NOT NULL")).withColumnRenamed("word", "of")
    rooted = found.join(ends, F.col("word") == F.col("of"), "left")
    return rooted.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: The same rows in SQL.
ORACLE_SQL = r"""
WITH RECURSIVE t(crcs) AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END))),
r AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) AS w FROM documents),
c AS (SELECT doc_id, w, count(*) AS n, hex(encode(doc_id || ':' || w)) AS x FROM r WHERE length(w) >= 5 GROUP BY 1, 2),
h AS (
  SELECT w, n, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
         lambda a, y: xor(a >> 8, crcs[(xor(a, y) & 255) + 1]))) AS h FROM c, t),
m AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM h),
words AS (SELECT word, sum(n)::BIGINT AS n FROM m WHERE length(word) >= 5 GROUP BY 1 HAVING sum(n) >= 3),
cut AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM words, unnest(range(length(word))) u(i)),
near AS (
  SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM words a JOIN cut b ON a.word = b.rest
  UNION SELECT b.word, a.word, a.n FROM words a JOIN cut b ON a.word = b.rest),
best AS (SELECT word, count(*) AS n_near, min((-n, other)) AS b FROM near GROUP BY 1),
f AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b[1] >= 2 * w.n THEN b[2] END AS form, CASE WHEN -b[1] >= 2 * w.n THEN -b[1] END AS form_n
  FROM words w LEFT JOIN best USING (word)),
path(word, here, step) AS (
  SELECT word, coalesce(form, word), 0 FROM f
  UNION ALL SELECT path.word, f.form, step + 1 FROM path JOIN f ON f.word = path.here WHERE f.form IS NOT NULL)
SELECT f.word, f.form, p.root, f.n, f.n_near, f.form_n::BIGINT AS form_n
FROM f JOIN (SELECT word, arg_max(here, step) AS root FROM path GROUP BY 1) p USING (word)
"""
