"""The queries of the corpus operators: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardstone.llm.byte_bpe import byte_bpe, read_ranks
from wardstone.llm.factorization import quality_scores
from wardstone.llm.html_text import extract_text
from wardstone.llm.katz import katz_scores
from wardstone.llm.line_dedup import line_dedup
from wardstone.llm.quality_rules import quality_rules
from wardstone.llm.simhash import near_duplicates
from wardstone.llm.suffix_dedup import suffix_dedup
from wardstone.llm.toxicity import toxicity
from wardstone.llm.wu_manber import decontaminate


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def _bucket(n: int):
    """crc32 of the id as text, mod n."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from rows whose crc32 mod 5 is not 0."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = toxicity(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"), _bucket(5) != 0)
    return found.select("doc_id", F.coalesce(_bucket(5) == 0, F.lit(False)).alias("held_out"), "expected_severity", "severity", "score", "toxic")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = quality_scores(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"), _bucket(5) != 0)
    return found.select("doc_id", F.coalesce(_bucket(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(_bucket(7) == 2, F.lit(False))
    found = katz_scores(table(spark, sf_dir, "documents").select("doc_id", "text"), ~held)
    return found.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary file is read on the driver only."""
    import public_tokenizers

    ranks = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    found = byte_bpe(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, public_tokenizers.PATTERN)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2("packed", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines_failed")


QUERIES = {f.__name__: f for f in (op1_suffix_array_dedup, op2_toxicity, op3_html_extraction, op4_quality_classifier, op5_katz_backoff, op6_benchmark_decontamination, op7_simhash_near_dedup, op8_line_dedup, op9_byte_bpe, op10_quality_rules)}
