"""One query for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import decontaminate, mixing, ngram_join, nn_descent, quality, substring_index, suffix_array, token_counts, token_output, toxicity
from quillspark.llm.scratch import Scratch, small_batches

END_ID = 2


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(n: int):
    """crc32 of doc_id as text, modulo n."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.NgramJoin(table(spark, sf_dir, "documents"), Scratch(spark, "op1"), 4, 85).run()


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_index.dedup(table(spark, sf_dir, "documents"), Scratch(spark, "op2")).drop("kept_text")


def op3_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array.dedup(table(spark, sf_dir, "documents"), Scratch(spark, "op3")).drop("kept")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.QualityModel.fit(docs, table(spark, sf_dir, "labels"), "quality", remainder(4) != 2)
    held = (remainder(4) == 2).alias("held_out")
    return quality.score_quality(docs, model).select("doc_id", held, "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), Scratch(spark, "op6")).select("doc_id", "size", "source_size", "target", "taken")


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.file_digests(
        spark,
        token_output.write_files(table(spark, sf_dir, "documents"), Scratch(spark, "op7"), tokenizer_path(), END_ID),
    )


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    hits = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"))
    hits = hits.groupBy(F.col("doc_id").alias("_hit")).agg(F.count("*").alias("n_items"), F.min("item_id").alias("first_item"))
    return (
        docs.select("doc_id")
        .join(hits, F.col("doc_id").eqNullSafe(F.col("_hit")), "left")
        .select("doc_id", F.col("_hit").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"), "first_item")
    )


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.ToxicityModel.fit(docs, table(spark, sf_dir, "labels"), "toxic", remainder(5) != 0)
    return toxicity.score_toxicity(docs, model).select(
        "doc_id",
        (remainder(5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.NnDescent(table(spark, sf_dir, "embeddings"), Scratch(spark, "op10"), 0.93).run()


QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_join,
        op2_substring_dedup,
        op3_suffix_array,
        op4_token_counts,
        op5_quality,
        op6_mixing,
        op7_token_output,
        op8_decontamination,
        op9_toxicity,
        op10_embedding_near_dedup,
    )
}
