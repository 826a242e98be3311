"""Suggestions, completions and fuzzy expansion over the vocabulary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions.analysis import normalize_text
from quillspark.functions.stem import stem

SUGGESTIONS, COMPLETIONS, MIN_PREFIX = 10, 50, 2


def _top(words: DataFrame, prefix: str, limit: int) -> DataFrame:
    return words.where(F.col("word").startswith(prefix)).orderBy(F.desc("df"), "word").limit(limit)


def suggest(words: DataFrame, prefix: str) -> DataFrame:
    """(word, count): the ten most common words with the prefix."""
    p = normalize_text(prefix.strip())
    return _top(words if len(p) >= MIN_PREFIX else words.where(F.lit(False)), p, SUGGESTIONS).select("word", F.col("df").alias("count"))


def suggest_sharded(words: DataFrame, prefix: str) -> DataFrame:
    """The same from (shard, word, df) when each shard offers only its own ten."""
    p = normalize_text(prefix.strip())
    own = F.row_number().over(W.partitionBy("shard").orderBy(F.desc("df"), "word"))
    top = words.where(F.col("word").startswith(p) & F.lit(len(p) >= MIN_PREFIX)).withColumn("nth", own).where(F.col("nth") <= SUGGESTIONS)
    return top.groupBy("word").agg(F.sum("df").alias("count")).orderBy(F.desc("count"), "word").limit(SUGGESTIONS)


def complete(words: DataFrame, prefix: str, stemmed: bool = True) -> list[str]:
    """Terms of the fifty most common words with the prefix, sorted."""
    p = normalize_text(prefix.strip())
    if len(p) < MIN_PREFIX:
        return []
    return sorted({stem(r["word"]) if stemmed else r["word"] for r in _top(words, p, COMPLETIONS).collect()})


def max_distance(length: Column) -> Column:
    return F.when(length <= 4, 0).when(length <= 8, 1).otherwise(2)


def expand(terms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(term, variant): terms of the vocabulary, a row each, within the edit distance that the query term's length allows.

    ``terms`` is a query's, so it is broadcast; the length band is tested before the distance, which
    is counted only as far as it is allowed.
    """
    q = F.broadcast(terms.select(F.col("term").alias("q"), F.char_length("term").alias("n")).withColumn("most", max_distance(F.col("n"))))
    v = vocabulary.select(F.col("term").alias("variant"))
    near = (
        F.abs(F.char_length("variant") - F.col("n")) <= F.col("most")
    ) & F.when(F.col("most") == 0, F.col("variant") == F.col("q")).when(F.col("most") == 1, F.levenshtein("q", "variant", 1) >= 0).otherwise(F.levenshtein("q", "variant", 2) >= 0)
    return v.join(q, near).select(F.col("q").alias("term"), "variant")
