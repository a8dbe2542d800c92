"""Document samples: an exact replay of reservoir sampling, and a hash order that needs no ordinals."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.text import strip_newlines
from quern.operators.prefix import running_total
from quern.sources.shared import keyed, spare


def usable(docs: DataFrame) -> DataFrame:
    """Documents without line ends around them; empty ones go."""
    return docs.withColumn("text", strip_newlines(F.col("text"))).where("text != ''")


def reservoir_slots(k: int, seed: int, total: int) -> dict[int, int]:
    """Ordinal (from 0) of the document in each slot after ``total`` documents. The draws depend on
    ordinals alone, so no text is needed to make them."""
    rng = random.Random(seed)
    slots = {i: i for i in range(min(k, total))}
    for seen in range(k + 1, total + 1):
        j = rng.randrange(seen)
        if j < k:
            slots[j] = seen - 1
    return slots


def reservoir_sample(docs: DataFrame, k: int, seed: int, key: str = "doc_id") -> DataFrame:
    """(slot, key, text): the documents that reservoir sampling by key order would hold.

    The replay draws once for each document, on the driver: that is what makes the sample the same.
    For very many documents ``hash_sample`` gives a uniform sample without it. Rows may share a key.
    """
    row = spare("row", [key, "text"])
    ready = keyed(usable(docs).select(key, "text"), row)
    total = ready.count()
    chosen = [(o, s) for s, o in reservoir_slots(k, seed, total).items()]
    slots = docs.sparkSession.createDataFrame(chosen, "ordinal long, slot int")  # k rows
    numbered = running_total(ready.select(key, row, F.lit(1).alias("one")), [key, row], "one", "ordinal")
    picked = numbered.join(F.broadcast(slots), "ordinal").select(row, "slot")
    return ready.join(F.broadcast(picked), row).select("slot", key, "text")  # k rows


def hash_sample(docs: DataFrame, k: int, seed: int, key: str = "doc_id") -> DataFrame:
    """k documents with the smallest hash of seed and key: uniform, stable under any partitioning."""
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    return usable(docs).select(key, "text").orderBy(order, key).limit(k)
