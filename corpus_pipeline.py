"""Documents to token ids in five stages, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import decontaminate, mixing, ngram_join, token_output, toxicity
from quillspark.llm.queries import END_ID, remainder, table, tokenizer_path
from quillspark.llm.scratch import Scratch, clear_since


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject; it learns from all documents' labels."""
    model = toxicity.ToxicityModel.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "toxic", remainder(5) != 0)
    return toxicity.drop_toxic(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 on five-word shingles."""
    return ngram_join.keep_one(docs, Scratch(spark, "pipeline-join"), 5, 80)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item's template."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources repeated and cut to their targets; a document is a row for each time it is taken."""
    return mixing.mixed(docs, Scratch(spark, "pipeline-mix"))


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, read back as one row a document."""
    return token_output.file_digests(spark, token_output.write_files(docs, Scratch(spark, "pipeline-tokens"), tokenizer_path(), END_ID))


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_benchmark),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", write_tokens),
]

#: Neither the classifier nor the tokenizer can be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a stage has written goes as soon as its result stands."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        made = len(Scratch.made)
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage-{k}")
        clear_since(made)
        if k:
            scratch.drop(f"stage-{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
