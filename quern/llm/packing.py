"""Best-fit packing of documents into sequences, in bulk-synchronous steps.

Sizes are whole numbers up to the capacity, so documents of one size are alike, and so are open
sequences of one gap. Both are kept range-sorted by size as counts. A step takes the largest size
that is left, sweeps to its successor among the gaps (the smallest gap that holds it), fills as many
sequences of that gap as there are documents for, and updates the gaps; what is left goes on to the
next successor and, after the last, opens new sequences. That is exactly best-fit decreasing, and
its work depends on the capacity, not on the number of documents.

The sweep over at most ``capacity`` counts runs on the driver and yields intervals of ranks. The
documents themselves are placed in a distributed way: each gets its rank among those of its size
(so no two claim one place), from counts per size and task and a rank within them, and takes the
place that its rank's interval names.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.batches import bounded
from quern.llm.pieces import MEMORIES, memory_of
from quern.sources.shared import written

#: Intervals of a plan that are broadcast, 40 bytes each; more are joined by a shuffle. They follow the
#: capacity and the shape of the lengths, not the number of documents.
BROADCAST_STEPS = 200_000


def cut(docs: DataFrame, tokenizer: str, end: int, capacity: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every document's ids and the id ``end``, in pieces
    of at most ``capacity``; only the first piece of a longer document may be shorter.

    A null text counts as empty. Rows are independent: repeated rows and null doc_ids pass.
    """
    closing = np.array([end], "<u4").tobytes()

    def pieces(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = memory_of(tokenizer)
        for batch in bounded(source, uses=(MEMORIES,)):
            rows = []
            for key, ids in zip(batch.column("doc_id").to_pylist(), memory.texts(batch.column("text")), strict=True):
                view = memoryview(ids + closing)
                n = len(view) // 4
                count = -(-n // capacity)
                first = n - capacity * (count - 1)
                bounds = [0, *(first + capacity * k for k in range(count))]
                rows += [(key, k, a, b - a, zlib.crc32(view[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(bounds, bounds[1:]))]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    ready = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return ready.mapInArrow(pieces, "doc_id long, piece int, start long, length long, ids_crc32 long")


def sweep(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, low, high, first, each, offset): documents of a length with ranks from low to below
    high go to the sequences from ``first`` on, ``each`` to a sequence, from ``offset`` in it."""
    plan: list[tuple[int, int, int, int, int, int]] = []
    gaps: list[int] = []  # sorted gaps that some open sequence has
    runs: dict[int, list[tuple[int, int]]] = {}  # gap to (first sequence, number of them)
    opened = 0

    def leave(gap: int, first: int, number: int) -> None:
        if gap and number:
            if gap not in runs:
                bisect.insort(gaps, gap)
                runs[gap] = []
            runs[gap].append((first, number))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(gaps, length)
            if at < len(gaps):
                gap = gaps[at]
                first, number = runs[gap].pop()
                if not runs[gap]:
                    del runs[gap], gaps[at]
            else:
                gap, first, number = capacity, opened, -(-left // (capacity // length))
                opened += number
            each = gap // length
            full = min(number, left // each)
            if full:
                plan.append((length, rank, rank + full * each, first, each, capacity - gap))
                leave(gap - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < number and left:  # the last documents of this length share one sequence
                plan.append((length, rank, rank + left, first + full, left, capacity - gap))
                leave(gap - left * length, first + full, 1)
                leave(gap, first + full + 1, number - full - 1)
                rank, left = rank + left, 0
            else:
                leave(gap, first + full, number - full)
    return plan


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """``pieces`` (with ``length`` from 1 to ``capacity``) with sequence_id and offset.

    Offsets in a sequence follow each other without gaps from 0. Which of several pieces of one
    length gets a place is decided by rank; repeated rows get places of their own. A piece's rank is
    its number in the task that wrote it and the count of its length in the tasks before: no task gets
    more rows of a length than another has written. The driver gets a count for each length. Columns
    sequence_id and offset of ``pieces`` are replaced.
    """
    spark, names = pieces.sparkSession, [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    rows = written(pieces.select(F.struct(*(f"`{c}`" for c in names)).alias("r"), F.col("length").cast("long").alias("length"), F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("at")), "pieces")  # encoded once, counted and placed from there
    counts = written(rows.groupBy("length", "task").agg(F.count("*").alias("n")), "counts")
    plan: dict[int, list[tuple[int, ...]]] = {}
    for length, *rest in sweep({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity):
        plan.setdefault(length, []).append(tuple(rest))
    steps = spark.createDataFrame(list(plan.items()), "length long, steps array<struct<low: long, high: long, first: long, each: long, at: long>>")
    steps = F.broadcast(steps) if sum(map(len, plan.values())) <= BROADCAST_STEPS else steps
    base = counts.select("length", "task", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    local = F.row_number().over(Window.partitionBy("length", "task").orderBy("at")) - 1
    ranked = rows.select("r", "length", "task", local.alias("local")).join(base, ["length", "task"]).select("r", "length", (F.col("base") + F.col("local")).alias("rank"))
    mine = ranked.join(steps, "length").select("r", "length", "rank", F.get(F.filter("steps", lambda s: (s["low"] <= F.col("rank")) & (F.col("rank") < s["high"])), F.lit(0)).alias("step"))
    nth = F.col("rank") - F.col("step.low")
    sequence = F.col("step.first") + F.floor(nth / F.col("step.each"))
    offset = F.col("step.at") + nth % F.col("step.each") * F.col("length")
    return mine.select(*(F.col(f"r.`{c}`") for c in names), sequence.cast("long").alias("sequence_id"), offset.cast("long").alias("offset"))
