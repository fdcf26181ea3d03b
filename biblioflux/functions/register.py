"""Lexicons and segmenters under names that SQL can use."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .text import max_match_pattern


def register_lexicon(spark: SparkSession, name: str, words: list[str]) -> None:
    """A temporary view `name` with the distinct words in one column, word."""
    spark.createDataFrame([(w,) for w in sorted(set(words))], "word string").createOrReplaceTempView(name)


def register_segmenter(spark: SparkSession, name: str, dictionary: list[str]) -> None:
    """A temporary SQL function name(text) that cuts text by forward maximum match; it stays an expression."""
    pattern = max_match_pattern(dictionary).replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x STRING) RETURNS ARRAY<STRING> RETURN regexp_extract_all(x, '{pattern}', 0)")
