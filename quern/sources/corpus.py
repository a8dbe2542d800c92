"""Delimited corpora as documents, and delimiter-aligned byte ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import END_OF_TEXT
from quern.operators.prefix import running_total


#: The sequences of bytes that are a character of UTF-8, one character for a byte.
CHARACTER = "|".join((
    r"[\x00-\x7F]", r"[\xC2-\xDF][\x80-\xBF]", r"\xE0[\xA0-\xBF][\x80-\xBF]", r"[\xE1-\xEC\xEE\xEF][\x80-\xBF]{2}", r"\xED[\x80-\x9F][\x80-\xBF]",
    r"\xF0[\x90-\xBF][\x80-\xBF]{2}", r"[\xF1-\xF3][\x80-\xBF]{3}", r"\xF4[\x80-\x8F][\x80-\xBF]{2}",
))


def read_corpus(spark: SparkSession, path: str, delimiter: str = END_OF_TEXT) -> DataFrame:
    """(file, ordinal_in_split, text) of text files whose documents a delimiter separates. Spark
    splits large files at delimiters. A trailing delimiter makes no empty document."""
    rows = spark.read.text(path, lineSep=delimiter)
    return rows.select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("doc_id"), F.col("value").alias("text"))


def read_whole(spark: SparkSession, path: str, errors: str = "strict") -> DataFrame:
    """(file, text): each file as one text, line ends as line feeds."""
    rows = spark.read.format("binaryFile").load(path)
    return rows.select(F.col("path").alias("file"), F.regexp_replace(decoded(F.col("content"), errors), r"\r\n?", "\n").alias("text"))


def decoded(raw: Column, errors: str = "strict") -> Column:
    """Text of UTF-8 bytes. Bytes that aren't UTF-8 make the job fail ("strict"), become U+FFFD
    ("replace") or go ("ignore"). A text that is sound is never touched, a U+FFFD in it included."""
    text = raw.cast("string")
    if errors == "replace":
        return F.make_valid_utf8(text)
    if errors == "ignore":  # of all sequences of bytes, those that are a character
        return F.when(F.is_valid_utf8(text), text).otherwise(_sound(raw))
    if errors != "strict":
        raise ValueError(errors)
    return F.validate_utf8(text)


def _sound(raw: Column) -> Column:
    shown = F.decode(raw, "ISO-8859-1")  # a character for each byte
    return F.decode(F.encode(F.array_join(F.regexp_extract_all(shown, F.lit(f"({CHARACTER})+"), F.lit(0)), ""), "ISO-8859-1"), "UTF-8")


def read_range(spark: SparkSession, path: str, start: int, length: int, errors: str = "ignore") -> DataFrame:
    """(file, text): ``length`` bytes of each file from byte ``start`` on, as text."""
    rows = spark.read.format("binaryFile").load(path)
    return rows.select(F.col("path").alias("file"), decoded(F.substring("content", start + 1, length), errors).alias("text"))


def spread(df: DataFrame) -> DataFrame:
    """The same rows over all cores, where a table has fewer splits than there are cores. Larger
    tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def split_corpus(blobs: DataFrame, key: str, delimiter: str = END_OF_TEXT, drop_empty: bool = False) -> DataFrame:
    """(key, pos, text): pieces of a text column between delimiters. The piece after a trailing
    delimiter goes if empty; with ``drop_empty`` all empty pieces go and line ends are stripped."""
    parts = F.split("text", r"\Q" + delimiter + r"\E", -1)
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    rows = blobs.select(key, F.posexplode(parts).alias("pos", "text"))
    return rows.withColumn("text", F.btrim("text", F.lit("\r\n"))).where("text != ''") if drop_empty else rows


def chunk_boundaries(docs: DataFrame, chunks: int, key: str = "doc_id", delimiter: str = END_OF_TEXT) -> DataFrame:
    """(boundary): byte offsets that cut the corpus (texts in key order, a delimiter between two)
    into about ``chunks`` ranges, each inner cut moved up to the next delimiter's start."""
    mark = len(delimiter.encode())
    sized = docs.select(key, (F.octet_length(F.coalesce("text", F.lit(""))) + mark).alias("n"))
    placed = running_total(sized, [key], "n", "start")
    ends = placed.select((F.col("start") + F.col("n") - mark).alias("at"))
    size = ends.agg(F.max("at").alias("size"))
    guesses = size.select("size", F.explode(F.sequence(F.lit(0), F.lit(chunks))).alias("i")).select("size", "i", (F.floor(F.col("size") / chunks) * F.col("i")).alias("guess"))
    # Each delimiter serves the guesses between the one before it and itself: found by arithmetic, not by a join.
    width = F.floor(F.col("size") / chunks)
    length = F.col("n")
    cuts = placed.join(F.broadcast(size)).where("size > 0")
    low, high = F.col("start") - mark + 1, F.col("start") + length - mark
    first = F.greatest(F.lit(1), F.ceil(low / width))
    last = F.least(F.lit(chunks - 1), F.floor(high / width))
    inner = cuts.where((width > 0) & (first <= last) & (high < F.col("size"))).select(high.alias("boundary"))
    outer = guesses.where(F.col("i").isin(0, chunks)).select(F.when(F.col("i") == 0, 0).otherwise(F.col("size")).cast("long").alias("boundary"))
    return inner.select(F.col("boundary").cast("long")).union(outer).distinct()
