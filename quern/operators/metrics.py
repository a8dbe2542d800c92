"""Compression and vocabulary figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import safe_ratio


def compression(encoded: DataFrame, by: str | None = None) -> DataFrame:
    """Input bytes, tokens and bytes per token over (text, n_tokens); null for no tokens."""
    grouped = encoded.groupBy(by) if by else encoded.groupBy()
    sums = grouped.agg(F.sum(F.octet_length("text")).alias("input_bytes"), F.sum("n_tokens").alias("num_tokens"))
    return sums.withColumn("bytes_per_token", safe_ratio(F.col("input_bytes"), F.col("num_tokens")))


def verdict(first: Column, second: Column) -> Column:
    """Which of two ratios is higher, in words."""
    return F.when(second > first, "better").when(second < first, "worse").otherwise("equal")


def improvement(first: Column, second: Column) -> Column:
    """Percent by which the second ratio is above the first."""
    return F.try_divide((second - first) * 100.0, first)


def longest_tokens(vocab: DataFrame, k: int = 10) -> DataFrame:
    """The k longest tokens; of equals, the lowest ids."""
    return vocab.select("token_id", F.hex("token").alias("token"), F.octet_length("token").alias("n_bytes")).orderBy(F.col("n_bytes").desc(), "token_id").limit(k)
