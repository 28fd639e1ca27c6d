"""The registered queries of the training-data operators, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, html_text, licenses, lm, media, packing, quality, tool_calls
from .near_dedup import near_duplicates
from .substring_dedup import deduplicate


def tokenizer_path(name: str) -> str:
    """Where the box keeps its public vocabulary files; operators only get a path."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = tool_calls.of_conversations(_table(spark, sf_dir, "conversations"))
    return tool_calls.link(calls, results, tool_calls.SCHEMAS)


def op2_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    scored = quality.classify(docs, quality.train(docs, labels), threshold=0.3)
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


def op5_lossless_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(media.store(_table(spark, sf_dir, "documents")))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(_table(spark, sf_dir, "documents"), window=13).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), k=4, percent=80)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), threshold=0.8)


def op9_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


QUERIES = {
    "op1_chat_tool_calls": op1_chat_tool_calls,
    "op2_html_main_text": op2_html_main_text,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_lossless_webp": op5_lossless_webp,
    "op6_license_scan": op6_license_scan,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_retrieval_packing": op9_retrieval_packing,
    "op10_decontamination": op10_decontamination,
}

ORACLE: dict[str, str] = {
    "op1_chat_tool_calls": tool_calls.ORACLE,
    "op10_decontamination": decontaminate.ORACLE,
}
