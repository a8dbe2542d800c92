"""Pre-token counts and byte-pair counts: partial aggregates before every exchange."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.text import adjacent, byte_symbols, pretokens, split_specials


def pretoken_stream(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, pos, pretoken): every pre-token of every text at its place."""
    return docs.select(key, F.posexplode(pretokens(F.col("text"))).alias("pos", "pretoken"))


def pretoken_counts(docs: DataFrame, specials: Sequence[str] = ()) -> DataFrame:
    """(pretoken, n) over a corpus. Special tokens separate texts and are not counted."""
    texts = docs.select("text")
    if specials:
        texts = texts.select(F.explode(split_specials(F.col("text"), specials)).alias("text"))
    return texts.select(F.explode(pretokens(F.col("text"))).alias("pretoken")).groupBy("pretoken").agg(F.count("*").alias("n"))


def word_table(counts: DataFrame) -> DataFrame:
    """(s, n): distinct pre-tokens as strings of symbols, weighted by how often they occur."""
    return counts.select(byte_symbols(F.col("pretoken")).alias("s"), "n")


def pair_counts(words: DataFrame) -> DataFrame:
    """(pair, c): adjacent symbols over (s, n), two characters each. Overlapping pairs count."""
    return words.select(F.explode(adjacent(F.col("s"))).alias("pair"), "n").groupBy("pair").agg(F.sum("n").alias("c"))


def pair_index(words: DataFrame) -> DataFrame:
    """(pair, s): the inverted index, each different pair of a word with the word. The rows of a pair
    stay apart, so a pair that most words hold is no one task's."""
    return words.select(F.explode(F.array_distinct(adjacent(F.col("s")))).alias("pair"), "s")


def hex_pairs(pairs: DataFrame) -> DataFrame:
    """(left, right, c) of pairs of bytes, in hex."""
    coded = F.hex(F.encode("pair", "ISO-8859-1"))
    return pairs.select(F.substring(coded, 1, 2).alias("left"), F.substring(coded, 3, 2).alias("right"), "c")


def best_pair(pairs: DataFrame) -> DataFrame:
    """The pair to merge next: the highest count; among equals, the greatest bytes, left first."""
    top = F.max(F.struct("c", "left", "right")).alias("m")
    return pairs.agg(top).select("m.left", "m.right", "m.c").where(F.col("c").isNotNull())
