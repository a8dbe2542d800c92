"""Vocabulary and merge files, and the small JSON files beside them. All paths go through Spark."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import printable
from quern.operators.codec import with_specials
from quern.operators.train import Tokenizer


def byte_characters() -> dict[int, str]:
    """Byte to printable character, by the same rule as ``printable``."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(seen)]
    return {b: chr(b) for b in seen} | {b: chr(256 + k) for k, b in enumerate(hidden)}


def byte_table(spark: SparkSession) -> DataFrame:
    """(byte, ch): the 256 rows of the printable map, made by the JVM."""
    return spark.range(256).select(F.col("id").cast("int").alias("byte"), printable(F.col("id").cast("int")).alias("ch"))


def shown(token: bytes) -> str:
    table = byte_characters()
    return "".join(table[b] for b in token)


def hidden(token: str) -> bytes:
    """Bytes of a printable token; one with a character outside the map is its own UTF-8."""
    table = {c: b for b, c in byte_characters().items()}
    return bytes(table[c] for c in token) if all(c in table for c in token) else token.encode()


def _text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def load_tokenizer(spark: SparkSession, vocab_path: str, merges_path: str, specials: Sequence[str] = ()) -> Tokenizer:
    """A tokenizer from ``vocab.json`` and ``merges.txt``. A line of two fields is a merge, whatever
    it says, and takes a rank; other lines are skipped."""
    vocab = {int(i): hidden(t) for t, i in json.loads(_text(spark, vocab_path)).items()}
    lines = (line.rstrip().split(" ") for line in _text(spark, merges_path).split("\n"))
    merges = [(hidden(x[0]), hidden(x[1])) for x in lines if len(x) == 2]
    return with_specials(Tokenizer(vocab, merges), specials)


def first_present(spark: SparkSession, paths: Sequence[str]) -> str:
    """The first path that exists."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        if target.getFileSystem(conf).exists(target):
            return path
    raise FileNotFoundError(", ".join(paths))


def save_tokenizer(spark: SparkSession, tokenizer: Tokenizer, folder: str) -> None:
    """Writes ``vocab.json`` and ``merges.txt`` folders of one part each. Ids that share their bytes
    can't both be named in the file: the highest stays, and the caller is told."""
    names: dict[str, int] = {shown(b): i for i, b in sorted(tokenizer.vocab.items())}
    if len(names) < len(tokenizer.vocab):
        import warnings

        warnings.warn("ids with equal bytes: only the highest of each is saved", stacklevel=2)
    body = json.dumps(names, ensure_ascii=False)
    spark.createDataFrame([(body,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/vocab.json")
    lines = [(k, f"{shown(a)} {shown(b)}") for k, (a, b) in enumerate(tokenizer.merges)]
    merges = spark.createDataFrame(lines, "rank int, value string")
    merges.orderBy("rank").coalesce(1).select("value").write.mode("overwrite").text(f"{folder}/merges.txt")


def save_record(record: DataFrame, path: str) -> None:
    """A one-row table, such as metrics or a summary, as JSON."""
    record.coalesce(1).write.mode("overwrite").json(path)


def save_tokens(tokens: DataFrame, path: str, expected: int | None = None) -> None:
    """(pos, token_id) as Parquet, in ranges of pos. Fails if the count isn't the expected one."""
    tokens.repartitionByRange("pos").sortWithinPartitions("pos").write.mode("overwrite").parquet(path)
    if expected is not None and (n := tokens.sparkSession.read.parquet(path).count()) != expected:
        raise ValueError(f"{n} tokens were written, {expected} counted")
