"""The registered query of each operator, with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Key of the pseudonyms in the registered queries; a real one comes from a secret store.
PSEUDONYM_KEY = "demonstration"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from telemill.llm.minhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from telemill.llm.bpe import token_digests

    return token_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from telemill.llm.repeats import drop_repeats

    return drop_repeats(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from telemill.llm.toxicity import toxicity

    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from telemill.llm.embeddings import near_vectors

    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from telemill.llm.warc import archive_pages

    return archive_pages(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified")


def op3_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from telemill.llm.merkle import fingerprints

    return fingerprints(_table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from telemill.llm.pii import pseudonymise

    return pseudonymise(_table(spark, sf_dir, "documents"), PSEUDONYM_KEY).select("doc_id", "text", "n_private")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from telemill.llm.packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"))


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from telemill.llm.lines import drop_boilerplate

    return drop_boilerplate(_table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


def op11_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from telemill.llm.tokens import token_files

    found = token_files(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end=2)
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from telemill.llm.centroids import cluster

    return cluster(_table(spark, sf_dir, "embeddings"), k=16, rounds=3, seed=1)


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    from telemill.llm.infill import fill_in_middle, restored

    found = fill_in_middle(_table(spark, sf_dir, "documents").select("doc_id", "text"), seed=7)
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored()).alias("restored_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    from telemill.llm import centroids, infill, lines

    return {"op6_lines": lines.ORACLE, "op12_centroids": centroids.oracle(k=16, rounds=3, seed=1), "op13_infill": infill.ORACLE}
