"""Token ids of a corpus in files of Simple-8b blocks, in ascending order of document.

The store is a folder of Parquet files that serve as containers: a row is a block of whole
documents with its words, the marks for decoding from the middle, and each document's size. Files
are ranges of doc_id, rows ascend in a file. Spark's writers commit them, so a lost executor's
tasks just run again, and any file system that Spark writes to will do.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm import simple8b
from quern.llm.batches import bounded
from quern.llm.pieces import MEMORIES, memory_of

#: Ids of a block, unless its last document is longer.
BLOCK_IDS = 1 << 17
#: Bytes of input, as Spark estimates them, of a range of doc_ids at most.
SHARD_BYTES = 128 << 20
#: Characters of a text that order rows of one doc_id among ranges.
RANGE_PREFIX = 32
_BLOCKS = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("words", pa.binary()), ("marks", pa.binary())])
SCHEMA = "shard int, block int, start long, n_ids long, doc_ids array<long>, sizes array<int>, words binary, marks binary"


def _estimate(df: DataFrame) -> int:
    """Bytes of a plan by Spark's statistics: file sizes, for a scan; 0 where it knows none."""
    found = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return found if found < 1 << 60 else 0


def write(docs: DataFrame, path: str, tokenizer: str, end: int, shards: int | None = None) -> None:
    """Encodes every whole text, ends each document with the id ``end``, and writes the store.

    A null text counts as empty: its document is the end id alone. Null doc_ids come first; rows with
    equal doc_ids stay apart, ordered by text. Other columns are ignored. Special tokens in a text are
    what the library makes of them. ``tokenizer`` is a file that every executor has. Only texts are
    shuffled, once, into ranges of doc_id; a doc_id with very many texts is cut into ranges of these.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shards = shards or max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), _estimate(plain) // SHARD_BYTES)
    ordered = plain.repartitionByRange(shards, F.col("doc_id"), F.substring("text", 1, RANGE_PREFIX)).sortWithinPartitions("doc_id", "text")
    closing = np.array([end], "<u4").tobytes()

    def blocks(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, start = TaskContext.get().partitionId(), 0, 0
        keys: list[int | None] = []
        held: list[bytes] = []

        def full() -> pa.RecordBatch:
            nonlocal block, start
            ids = np.frombuffer(b"".join(held), "<u4")
            words, marks = simple8b.encode(ids)
            row = {"shard": shard, "block": block, "start": start, "n_ids": len(ids), "doc_ids": list(keys), "sizes": [len(x) // 4 for x in held], "words": words.astype("<u8").tobytes(), "marks": marks.astype("<i8").tobytes()}
            block, start = block + 1, start + len(ids)
            keys.clear()
            held.clear()
            return pa.RecordBatch.from_pylist([row], schema=_BLOCKS)

        memory, size = memory_of(tokenizer), 0
        for batch in bounded(source, uses=(MEMORIES,)):
            for key, ids in zip(batch.column("doc_id").to_pylist(), memory.texts(batch.column("text")), strict=True):
                keys.append(key)
                held.append(ids + closing)
                size += len(held[-1]) // 4
                if size >= BLOCK_IDS:
                    yield full()
                    size = 0
        if held:
            yield full()

    ordered.mapInArrow(blocks, SCHEMA).write.option("compression", "none").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): all documents of a store; ids as little-endian unsigned
    32-bit integers, start the number of ids before them in the whole store."""

    def documents(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for row in batch.to_pylist():
                ids = simple8b.decode(np.frombuffer(row["words"], "<u8")).astype("<u4")
                ends = np.cumsum(np.array(row["sizes"], np.int64))
                starts = ends - row["sizes"]
                out = [ids[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                columns = [pa.array(row["doc_ids"], pa.int64()), pa.array([row["shard"]] * len(out), pa.int32()), pa.array(starts + row["start"], pa.int64()), pa.array(row["sizes"], pa.int64()), pa.array(out, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "shard", "local", "n_tokens", "ids"])

    stored = spark.read.schema(SCHEMA).parquet(path)
    totals = stored.groupBy("shard").agg(F.sum("n_ids").alias("n"))  # a row for each file's range
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    rows = stored.mapInArrow(documents, "doc_id long, shard int, local long, n_tokens long, ids binary")
    return rows.join(F.broadcast(bases), "shard").select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids")


def crc(ids: bytes) -> int:
    return zlib.crc32(ids)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files of a store."""
    return read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
