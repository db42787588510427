"""The registered queries of this subpackage: each applies one operator to the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from psephos.llm import decontamination, langid, line_dedup, lm, media, packing, pieces, quality, secrets, sharding, simhash, spelling, target_resampling
from psephos.llm._shared import crc_mod


#: The public byte-pair model of the installed tokenizer files.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return lm.score(docs, crc_mod(docs["doc_id"], 7) == 2).withColumnRenamed("id", "doc_id")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return langid.identify(docs, crc_mod(docs["doc_id"], 3) == 1).withColumnRenamed("id", "doc_id")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.deduplicate_lines(documents(spark, sf_dir))
    return kept.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.segmentation_digests(documents(spark, sf_dir), PIECE_MODEL).withColumnRenamed("id", "doc_id")


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    rows = docs.select("doc_id", "text", F.octet_length("text").alias("n"))
    keyed = rows.select(F.struct("doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_bytes")).alias("id"), "text")
    return media.digests(media.sniff(media.stored_texts(keyed, "id"))).select("id.*", "*").drop("id")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.resample(documents(spark, sf_dir), labels, carry=["doc_id"])


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id")
    )


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), "word_at", "run_at", F.sha2("candidate", 256).alias("candidate_sha256"), "probability", "is_secret")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.shuffle_into_shards(documents(spark, sf_dir))
    crc = F.crc32(F.coalesce(F.col("text").cast("binary"), F.lit(b"")))
    return dealt.select(F.col("id").alias("doc_id"), "size", crc.alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op11_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return target_resampling.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).withColumnRenamed("id", "doc_id")


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    length = (F.octet_length("ids") / 4).cast("long")
    return packed.select(F.col("id").alias("doc_id"), "start", length.alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", F.col("sequence").alias("sequence_id"), "offset")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir))


QUERIES = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_language_id": op2_language_id,
    "op3_line_dedup": op3_line_dedup,
    "op4_decontamination": op4_decontamination,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_media_columns": op6_media_columns,
    "op7_quality": op7_quality,
    "op8_simhash": op8_simhash,
    "op9_secret_scan": op9_secret_scan,
    "op10_sharding": op10_sharding,
    "op11_target_resampling": op11_target_resampling,
    "op12_packing": op12_packing,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLES = {"op3_line_dedup": line_dedup.ORACLE_SQL, "op11_target_resampling": target_resampling.ORACLE_SQL, "op13_spelling_variants": spelling.ORACLE_SQL}
