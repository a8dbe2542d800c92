"""Exact duplicates by an extendible-hash index on shared files, with DataFrame functions only.

A text's key is a 64-bit hash of its normal form. The directory maps a key's first bits to a bucket:
it starts with one bucket, and while a bucket holds more than ``capacity`` different keys the
directory doubles and that bucket splits in two. It is made first, from the number of keys by prefix.
Equal texts are then brought together by bucket, key and every byte of the text, counted before and
after the shuffle, so a text with very many copies costs no more than any other. Owner tasks take
ranges of buckets and keys and write the index: a row for each key with its chain, the different texts
that have this hash. Probes look up each document by bucket and key and, in a chain of several, by digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.sources.shared import written

#: Bits of a key by which the directory can split.
MOST_BITS = 16
#: Keys that a bucket holds at least before it splits, and the share of all keys that it may hold as
#: bits: together they keep the directory well within ``MOST_BITS`` at any number of keys.
LEAST_CAPACITY, SHARE_BITS = 4096, 12


def normal(text: Column) -> Column:
    """A text with each run of ASCII white space as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def full_hash(text: Column) -> Column:
    return F.xxhash64(text)


def directory(sizes: dict[int, int], bits: int, capacity: int) -> list[tuple[int, int]]:
    """(prefix, depth) of the buckets: from one bucket, by doubling and splitting overfull ones.
    ``sizes`` has the number of texts for each prefix of ``bits`` bits."""
    counts = [dict(sizes)]
    for depth in range(bits, 0, -1):  # the sizes that each split would find
        halved: dict[int, int] = {}
        for prefix, n in counts[-1].items():
            halved[prefix >> 1] = halved.get(prefix >> 1, 0) + n
        counts.append(halved)
    counts.reverse()
    buckets, depth = [(0, 0)], 0
    while depth < bits:
        overfull = [p for p, d in buckets if d == depth and counts[depth].get(p, 0) > capacity]
        if not overfull:
            break
        depth += 1  # the directory doubles
        kept = [b for b in buckets if b[1] < depth - 1 or b[0] not in set(overfull)]
        buckets = kept + [(2 * p + side, depth) for p in overfull for side in (0, 1)]
    return sorted(buckets, key=lambda b: b[0] << (bits - b[1]))


def bucket_of(key: Column, buckets: list[tuple[int, int]], bits: int) -> Column:
    """Number of a key's bucket: a lookup in the directory of 2**depth entries."""
    depth = max(d for _, d in buckets)
    if not depth:
        return F.lit(0)
    entries = [0] * (1 << depth)
    for number, (prefix, d) in enumerate(buckets):
        low = prefix << (depth - d)
        entries[low : low + (1 << (depth - d))] = [number] * (1 << (depth - d))
    return F.get(F.lit(entries), F.shiftrightunsigned(key, 64 - depth).cast("int"))


def capacity_for(keys: int) -> int:
    return max(LEAST_CAPACITY, keys >> SHARE_BITS)


def build(docs: DataFrame, capacity: int | None = None, hash_of=full_hash) -> tuple[DataFrame, DataFrame]:
    """The index (bucket, key, chain array<(digest, keep_id, group_size)>) on shared files, and the
    probes (doc_id, bucket, key, text_sha256) of all rows. ``hash_of`` gives a column's 64-bit key;
    tests force collisions with a shorter one."""
    text = docs.select("doc_id", normal(F.col("text")).alias("t")).select("doc_id", hash_of(F.col("t")).alias("key"), "t")
    probes = written(text.select("doc_id", "key", F.sha2("t", 256).alias("text_sha256")), "probes")
    prefix = F.shiftrightunsigned("key", 64 - MOST_BITS).cast("int")
    sizes = {r["p"]: r["n"] for r in probes.select("key").distinct().groupBy(prefix.alias("p")).agg(F.count("*").alias("n")).collect()}  # 2**MOST_BITS rows at most
    bucket = bucket_of(F.col("key"), directory(sizes, MOST_BITS, capacity or capacity_for(sum(sizes.values()))), MOST_BITS)
    same = text.withColumn("bucket", bucket).groupBy("bucket", "key", "t").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    entries = written(same.select("bucket", "key", F.struct(F.sha2("t", 256).alias("digest"), "keep_id", "group_size").alias("entry")), "entries")
    owned = entries.repartitionByRange("bucket", "key").groupBy("bucket", "key").agg(F.collect_list("entry").alias("chain"))
    # Entries of one chain are different texts, for equal texts are one entry. If two had one digest,
    # it couldn't tell them apart, and the build fails rather than merge them.
    sound = F.assert_true(F.size(F.array_distinct("chain.digest")) == F.size("chain"), F.lit("two texts share hash and digest"))
    index = written(owned.where(sound.isNull()).sortWithinPartitions("bucket", "key"), "index")
    return index, probes.withColumn("bucket", bucket)


def exact_dedup(docs: DataFrame, capacity: int | None = None, hash_of=full_hash) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of (doc_id, text).

    Null text counts as empty; white space runs count as one space. Of equal texts the smallest
    doc_id stays; null doc_ids are never smallest and don't stay, unless the whole group has no other
    (then keep_id is null and all its rows count as kept). Rows with one doc_id and one text are all
    returned, all with the same answer. Other columns are ignored. An empty table gives an empty result.
    """
    index, probes = build(docs, capacity, hash_of)
    mine = F.when(F.size("chain") == 1, F.get("chain", F.lit(0))).otherwise(F.get(F.filter("chain", lambda e: e["digest"] == F.col("text_sha256")), F.lit(0)))
    found = probes.join(index, ["bucket", "key"]).withColumn("entry", mine)
    kept = F.coalesce(F.col("doc_id") == F.col("entry.keep_id"), F.col("entry.keep_id").isNull())
    return found.select("doc_id", "entry.keep_id", "entry.group_size", kept.alias("kept"), "text_sha256")
