"""Encoding of a stream of texts: the same stateless expression as in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from quern.operators.codec import encode
from quern.operators.train import Tokenizer


def read_texts(spark: SparkSession, folder: str, schema: StructType | str, files_per_trigger: int = 64) -> DataFrame:
    """A stream over Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def encode_stream(texts: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """Each element is encoded by itself, so no state is kept and no watermark is needed."""
    return encode(texts, tokenizer)


def run_available(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes all that is there to Parquet, once for each input file, and stops."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
