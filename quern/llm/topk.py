"""Exact top-k by inner product: tiles of queries and shards, selection per tile, a tree of merges.

Vectors become rows of whole numbers in blocks. Blocks of queries go to the shards of candidates,
which move once; each meeting is a tile: a matrix product and a partial selection of each query's k
best. The tiles' short lists meet by query in a tree: lists of about ``FAN_IN`` shards are merged at each
level, so that no task gets the lists of all shards of a large table at once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.sources.shared import written

QUERY_BLOCK, SHARD_ROWS, FAN_IN = 2048, 8192, 32
_TILE = "query_id long, vec_id long, score long, shard long"


def quantised(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, dim, v array<long>): floor(scale * x) of each component as a double. Vectors that are
    null or hold a null or a number that isn't finite are left out, as are null vec_ids."""
    x = F.col("embedding").cast("array<double>")
    sound = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    whole = F.transform(x, lambda e: F.floor(e * F.lit(float(scale))).cast("long"))
    good = vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & F.coalesce(sound, F.lit(False)))
    return good.select(F.col("vec_id").cast("long").alias("vec_id"), F.size(x).alias("dim"), whole.alias("v"))


def _narrow(values: np.ndarray) -> np.ndarray:
    """The same numbers in the fewest bytes that hold them all."""
    low, high = int(values.min(initial=0)), int(values.max(initial=0))
    return values.astype(next(k for k in ("<i1", "<i2", "<i4", "<i8") if np.iinfo(k).min <= low and high <= np.iinfo(k).max))


def _blocks(rows: DataFrame, size: int, kind: str) -> DataFrame:
    """(dim, part, n, ids, width, values): rows of one dimension in blocks of at most ``size``, as bytes;
    n counts the blocks of a dimension in each task, ``part``."""

    def packed(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list[int], list[np.ndarray]]] = {}
        part, made = TaskContext.get().partitionId(), Counter()

        def out(dim: int) -> pa.RecordBatch:
            ids, parts = held.pop(dim)
            values = _narrow(np.concatenate(parts))
            made[dim] += 1
            columns = [pa.array([dim], pa.int32()), pa.array([part], pa.int32()), pa.array([made[dim] - 1], pa.int64()), pa.array([np.array(ids, "<i8").tobytes()], pa.binary()), pa.array([values.itemsize], pa.int32()), pa.array([values.tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["dim", "part", "n", "ids", "width", "values"])

        for batch in source:
            values = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype("<i8")
            ends = np.cumsum(batch.column("dim").to_numpy())
            for vec, dim, end in zip(batch.column("vec_id").to_pylist(), batch.column("dim").to_pylist(), ends.tolist(), strict=True):
                ids, parts = held.setdefault(dim, ([], []))
                ids.append(vec)
                parts.append(values[end - dim : end])
                if len(ids) >= size:
                    yield out(dim)
        for dim in list(held):
            yield out(dim)

    return written(rows.mapInArrow(packed, "dim int, part int, n long, ids binary, width int, values binary"), kind)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles while every partial sum is below 2**53, else in integers."""
    most = float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) * a.shape[1]
    return (a.astype(float) @ b.astype(float).T).astype(np.int64) if most < 2**53 else a @ b.T


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > k:
        bar = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= bar)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def _different(ids: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """Places of one row for each different (id, score)."""
    at = np.lexsort((scores, ids))
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(ids[at]) != 0) | (np.diff(scores[at]) != 0)
    return at[new]


def _matrix(row: dict, name: str = "") -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row[name + "ids"], "<i8")
    return ids, np.frombuffer(row[name + "values"], f"<i{row[name + 'width']}").reshape(len(ids), row["dim"]).astype(np.int64)


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, query_block: int = QUERY_BLOCK, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products over all other
    rows, ties to the smaller vec_id; all of them if there are fewer.

    ``is_query`` picks the queries, a stated set; candidates are all rows but those with the query's
    own id. Vectors meet only those of their own dimension. If several query rows share a vec_id, their
    lists are one: a candidate may stand in it once for each score. Equal (vec_id, score) count once.
    Other columns are ignored; an empty table gives an empty result.
    """
    rows = quantised(vectors)
    shards = _blocks(rows, shard_rows, "shards")
    queries = _blocks(rows.where(is_query).distinct(), query_block, "queries")
    counts = shards.groupBy("dim", "part").agg((F.max("n") + 1).alias("m"))
    there = counts.groupBy("dim").agg(F.collect_list(F.struct("part", "m")).alias("parts"))  # for each dimension, two numbers a task
    sent = queries.select("dim", F.col("ids").alias("q_ids"), F.col("width").alias("q_width"), F.col("values").alias("q_values")).join(F.broadcast(there), "dim")
    each = sent.select("*", F.inline("parts")).select("dim", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("n"), "q_ids", "q_width", "q_values")
    tiles = each.join(shards, ["dim", "part", "n"]).withColumn("shard", F.abs(F.xxhash64("part", "n") % (1 << 40)))

    def selected(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for row in batch.to_pylist():
                (ids, values), (q_ids, q_values) = _matrix(row), _matrix(row, "q_")
                repeated = len(np.unique(ids)) < len(ids)
                out: list[tuple[np.ndarray, ...]] = []
                for low in range(0, len(q_ids), 256):
                    for q, scores in zip(q_ids[low : low + 256], _product(q_values[low : low + 256], values), strict=True):
                        other = ids != q
                        mine, found = ids[other], scores[other]
                        if repeated:  # copies would take places from other candidates
                            once = _different(mine, found)
                            mine, found = mine[once], found[once]
                        at = _best(mine, found, k)
                        out.append((np.full(len(at), q), mine[at], found[at]))
                if out:
                    columns = [pa.array(np.concatenate(c), pa.int64()) for c in zip(*out, strict=True)]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(columns[0]), row["shard"]), pa.int64())], names=["query_id", "vec_id", "score", "shard"])

    lists = tiles.mapInArrow(selected, _TILE)
    best, left = [F.desc("score"), F.asc("vec_id")], counts.agg(F.sum("m").alias("m")).first()["m"] or 0  # one number
    while left > 1:  # a level of the tree
        left = -(-left // FAN_IN)
        near = lists.withColumn("shard", F.col("shard") % left).distinct()
        lists = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "shard").orderBy(*best))).where(F.col("rank") <= k).drop("rank")
    merged = lists.select("query_id", "vec_id", "score").distinct()
    final = merged.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*best))).where(F.col("rank") <= k)
    return final.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
