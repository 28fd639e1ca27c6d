"""The corpus pipeline: five stages, each on all that its predecessor kept.

quality classifier -> MinHash near-dedup -> substring dedup -> benchmark decontamination -> packing
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwalk.llm import decontaminate, packing, quality
from groundwalk.llm.near_dedup import near_duplicates
from groundwalk.llm.queries import tokenizer_path
from groundwalk.llm.scratch import materialize
from groundwalk.llm.substring_dedup import deduplicate, opened_rows, squeezed_rows


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns c0, c1, ..., so that no name of a caller's column clashes with an inner one; and their names."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), dict(zip(docs.columns, names, strict=True))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. Other columns, whatever their names, are kept as they are, here as in the
    stages that follow."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.accepted(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8."""
    gone = near_duplicates(docs, k=5, percent=80).where("not kept").select(F.col("doc_id").alias("gone_id")).distinct()
    inner, at = numbered(docs)
    return inner.join(gone, F.col(at["doc_id"]) == F.col("gone_id"), "left_anti").toDF(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 13 and more words that an earlier document has; a text of which nothing stays goes."""
    cut = deduplicate(docs, window=13).where("n_removed > 0").select(F.col("doc_id").alias("cut_id"), F.col("text_hash").alias("cut_hash"), "kept").dropDuplicates(["cut_id", "cut_hash"])
    inner, at = numbered(docs)
    # Texts cross the join as zstandard frames, for half the shuffle.
    rows = squeezed_rows(inner.withColumn("text_hash", F.xxhash64(F.coalesce(at["text"], F.lit("")))), at["text"])
    joined = rows.join(cut, (F.col(at["doc_id"]) == F.col("cut_id")) & (F.col("text_hash") == F.col("cut_hash")), "left").where("kept is null or kept <> ''")
    if "n_chars" in at:
        n_chars = F.when(F.col("kept").isNull(), F.col(at["n_chars"])).otherwise(F.char_length("kept").cast("long"))
        joined = joined.withColumn(at["n_chars"], n_chars)
    return opened_rows(joined.drop("text_hash", "cut_id", "cut_hash"), at["text"]).select(*inner.columns).toDF(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    keyed = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    hits = decontaminate.contamination(keyed, bench, by=("doc_id", "text_hash")).select(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash")).distinct()
    inner, at = numbered(docs)
    same = F.col(at["doc_id"]).eqNullSafe(F.col("hit_id")) & (F.xxhash64(F.coalesce(at["text"], F.lit(""))) == F.col("hit_hash"))
    return inner.join(hits, same, "left_anti").toDF(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 4096 ids."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("packing", packed),
]

#: Three of the stages have no equal in SQL; the tests hold the pipeline against a plain version of each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents that the stages keep."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
