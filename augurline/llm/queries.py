"""The registered queries of the ten operators, over whole tables and with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from augurline.llm import chat, decontam, katz, licenses, ngramjoin, packing, quality, sql, tokenfiles, warc, wrappers
from augurline.llm.cluster import stored


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), packing.word_lengths())


def op2_tokens(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return tokenfiles.round_trip(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2)


def op3_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(table(spark, folder, "pages"))


def op4_katz(spark: SparkSession, folder: str) -> DataFrame:
    return katz.score(table(spark, folder, "documents"))[0]


def op5_chat(spark: SparkSession, folder: str) -> DataFrame:
    said = f"{chat.END}{chat.START}assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(chat.examples(turns))


def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    measured = stored(quality.features(table(spark, folder, "documents")), "quality")
    cutoffs = quality.calibrate(measured, table(spark, folder, "labels"))
    return measured.select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", quality.base_failed().alias("base_failed"), quality.verdict(cutoffs).alias("kept")
    )


def op7_articles(spark: SparkSession, folder: str) -> DataFrame:
    return wrappers.articles(table(spark, folder, "pages"))


def op8_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontam.scan(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op9_licenses(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses.scan(table(spark, folder, "documents"))
    return found.select("doc_id", "n_sentences", F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"))


def op10_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    _, rows = ngramjoin.join(table(spark, folder, "documents").select("doc_id", "text"))
    return rows.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def queries() -> dict:
    return {f.__name__: f for f in (op1_packing, op2_tokens, op3_warc, op4_katz, op5_chat, op6_quality, op7_articles, op8_decontamination, op9_licenses, op10_jaccard)}


def oracle_sql() -> dict[str, str]:
    return sql.oracle_sql()
