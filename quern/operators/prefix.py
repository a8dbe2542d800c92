"""Running totals over a whole table without gathering it in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows of a range, about.
RANGE_ROWS = 1 << 20


def range_bounds(df: DataFrame, key: str, shards: int) -> list:
    """At most ``shards - 1`` ascending bounds that cut a numeric column into even ranges."""
    if shards < 2:
        return []
    steps = [i / shards for i in range(1, shards)]
    found = df.agg(F.percentile_approx(key, steps, 10_000).alias("b")).first()["b"] or []
    return sorted({b for b in found if b is not None})


def range_shard(key: Column, bounds: Sequence) -> Column:
    """The number of bounds below a key: its range, from 0. Null keys come first."""
    if not bounds:
        return F.lit(0)
    below = F.filter(F.lit(list(bounds)), lambda b: b < key)
    return F.coalesce(F.size(below), F.lit(0))


def running_total(df: DataFrame, order: Sequence[str], value: str, name: str, shards: int | None = None) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over all earlier rows by ``order``. The first order column
    must be numeric; its ranges are summed apart, and the few range totals then shift them. There are
    ``shards`` ranges, by default one for each ``RANGE_ROWS`` rows. Whole rows are shuffled: pass narrow ones."""
    shards = shards or -(-df.count() // RANGE_ROWS)
    row, own = F.struct("*"), df.columns
    bounds = range_bounds(df, order[0], shards)
    cut = df.select(row.alias("r"), range_shard(F.col(order[0]), bounds).alias("shard"), F.col(value).alias("v"))
    within = Window.partitionBy("shard").orderBy(*(F.col(f"r.`{c}`") for c in order))
    local = F.sum("v").over(within.rowsBetween(Window.unboundedPreceding, -1))
    totals = cut.groupBy("shard").agg(F.sum("v").alias("total"))  # a row for each range
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("shard", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    placed = cut.select("r", "shard", F.coalesce(local, F.lit(0)).alias("local")).join(F.broadcast(bases), "shard")  # as many rows as there are ranges
    return placed.select(*(F.col(f"r.`{c}`") for c in own if c != name), (F.col("base") + F.col("local")).cast("long").alias(name))
