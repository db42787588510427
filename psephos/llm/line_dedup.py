"""Line dedup: lines that several documents share stay in one document only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from psephos.llm._shared import SPACES, durable, lower_az


def deduplicate_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, carry: Sequence[str] = ()
) -> DataFrame:
    """Drops lines that ``min_docs`` documents or more hold, except in the document with the largest id.

    Returns ``id, text, n_lines, n_dropped`` for every row, and the columns
    ``carry`` of ``docs`` as fields of a struct ``rest``, so that no name clashes. Lines part at \\n
    (null or empty text: one empty line). The key of a line is the line
    stripped of ASCII white space with A-Z lower-cased; keys of under
    ``min_chars`` code points are never dropped. Documents are counted by id:
    repeated rows with one id count once and lose the same lines, and rows
    with a null id are neither counted nor changed.

    The plan shuffles hashes (128 bits a line), never lines. The count for
    each hash is combined before the shuffle; only hashes over the threshold
    are joined back, and texts are shuffled once for reassembly by position.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rest = [F.struct(*[docs[c] for c in carry]).alias("rest")] if carry else []
    rows = docs.select(docs[id_col].alias("id"), text.alias("text"), *rest)
    key = lower_az(F.btrim("line", F.lit(SPACES)))
    lines = (
        rows.where("id IS NOT NULL")
        .select("id", F.xxhash64("text").alias("version"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
        .select("id", "version", "pos", key.alias("key"))
        .where(F.length("key") >= min_chars)
        .select("id", "version", "pos", F.xxhash64("key").alias("h1"), F.xxhash64("key", F.lit(1)).alias("h2"))
    )
    lines = durable(lines, "line-hashes")
    shared = (
        lines.select("h1", "h2", "id").distinct()
        .groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keeper"))
        .where(F.col("n") >= min_docs)
        .select("h1", "h2", "keeper")
    )
    shared = durable(shared, "shared-lines")  # a plain join of two exchanges follows, which Spark splits where a line is hot
    dropped = (
        lines.join(shared, ["h1", "h2"]).where("id <> keeper")
        .groupBy("id", "version").agg(F.collect_set("pos").alias("drop"))
        .withColumnRenamed("id", "of")
    )
    parts = F.split("text", "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("drop"))
    joined = F.array_join(F.transform(kept, lambda p: F.get(F.col("parts"), p)), "\n")
    return (
        rows.join(dropped, (rows["id"] == dropped["of"]) & (F.xxhash64("text") == dropped["version"]), "left")
        .withColumn("parts", parts)
        .select(
            "id",
            F.when(F.col("drop").isNull(), F.col("text")).otherwise(joined).alias("text"),
            F.size("parts").cast("long").alias("n_lines"),
            F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"),
            *(["rest"] if carry else []),
        )
    )


#: The same rows in SQL, for documents with distinct ids.
ORACLE_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
shared AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT d.doc_id, d.pos, d.line, s.k IS NOT NULL AND d.doc_id <> s.keeper AS gone
  FROM keyed d LEFT JOIN shared s ON d.k = s.k)
SELECT doc_id, count(*) AS n_lines, coalesce(sum(gone::INT), 0)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
