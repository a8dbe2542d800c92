"""Text quality by an interpolated modified Kneser-Ney model of trusted text.

The model is over runs of up to ``ORDER`` bytes, whatever bytes there are. Counts of the longest runs
are added up by a shuffle; the ways in which shorter runs are continued, the discounts and each run's
probability follow by aggregates and joins of tables of different runs, of which no group has more
than 256 rows. A run's probability is kept as what it adds, in bits, to the run one byte shorter: so
the code length of a text is a plain sum over its runs of all lengths, and any split of the table will
do. The table is cut into shards of at most ``SHARD_RUNS`` runs. Each shard in turn is joined with the
different runs of each group of documents, which gives each document's sum.

Perplexity is per document. Trusted documents that were left out of training give, for each
language, the quantiles between which a document's score must lie: text that reads like nothing
trusted is above, text that repeats itself is below. A run of bytes can't see a repeated word that is
longer, so word trigrams that a document has already had are counted too, and have a threshold of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.batches import bounded
from quern.sources.shared import if_few, keyed, written

ORDER = 5
#: Runs of a shard at most: 16 bytes each, on the driver and in each worker.
SHARD_RUNS = 2_000_000
#: Bytes of text whose runs are taken together.
GROUP_BYTES = 2 << 20
#: Of trusted documents, the share that trains; the rest sets thresholds.
FOLDS = 5
#: A document's score is shrunk towards its language's mean as if it had so many more bytes.
PRIOR = 150.0
QUANTILES = (0.001, 0.999)
#: The thresholds lie beyond the quantiles by this share of half their distance: a few documents
#: tell a far quantile only roughly.
MARGIN = 0.25
#: A document's share of repeated word trigrams is taken as if it had so many new ones more; it may be so
#: many times the upper quantile of trusted documents, and is never rejected up to the floor.
NEW_TRIGRAMS, REPEATS, REPEATS_FLOOR = 20, 2.0, 0.1
#: A language has thresholds of its own from so many documents left out of training.
FEWEST = 50

_GAP = b"\n" * (ORDER - 1)  # each text starts after the same bytes


def runs(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(runs, owners, sizes) of groups of texts: the run of ``ORDER`` bytes that ends with each byte, text
    by text, as a number; the texts in the group, and how many of the runs are each one's. Long
    texts come in several groups."""
    held: list[bytes] = []
    owners: list[int] = []
    size = 0
    for k, text in enumerate(texts):
        for at in range(0, len(text), GROUP_BYTES):
            part = (_GAP if not at else text[at - ORDER + 1 : at]) + text[at : at + GROUP_BYTES]
            held.append(part)
            owners.append(k)
            size += len(part)
            if size >= GROUP_BYTES:
                yield _group(held, owners)
                held, owners, size = [], [], 0
    if held:
        yield _group(held, owners)


def _group(held: list[bytes], owners: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(held), np.uint8)
    sizes = np.array([len(t) for t in held], np.int64)
    starts = np.cumsum(sizes) - sizes
    inside = np.ones(len(raw) - ORDER + 1, bool)  # a run that begins in one text's end belongs to none
    for k in range(1, ORDER):
        inside[(starts[1:] - k)] = False
    code = np.zeros(np.count_nonzero(inside), np.int64)
    for k in range(ORDER):
        code <<= 8
        code |= raw[k : k + len(inside)][inside]
    return code, np.array(owners), sizes - ORDER + 1


def run_counts(docs: DataFrame) -> DataFrame:
    """(run, n) over all texts; each group of texts adds up its own before the shuffle."""

    def counted(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(source):
            for found, _, _ in runs([t.encode() for t in batch.column("text").to_pylist() if t]):
                coded = pa.array(found).dictionary_encode()
                n = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))
                yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(n.astype(np.int64))], names=["run", "n"])

    return docs.select("text").mapInArrow(counted, "run long, n long").groupBy("run").agg(F.sum("n").alias("n"))


def discounts(n: list[float]) -> tuple[float, float, float]:
    """The three discounts from the numbers of runs that count 1, 2, 3 and 4."""
    if not n[0] or not n[1]:
        return 0.5, 0.5, 0.5
    y = n[0] / (n[0] + 2 * n[1])
    found = [k + 1 - (k + 2) * y * n[k + 1] / n[k] if n[k] else 0.5 for k in range(3)]
    return tuple(min(k + 0.9, max(0.1, d)) for k, d in enumerate(found))


def _key(run: Column, order: int) -> Column:
    """A run's number with a mark of its length before it."""
    return run + F.lit(1 << 8 * order)


def model(counts: DataFrame) -> DataFrame:
    """(key, adds, backs): bits that a run adds to the run without its first byte, and bits that it
    adds, as a context, to whatever follows. Both are of log2 of probabilities."""
    levels = [counts]
    for order in range(ORDER - 1, 0, -1):  # below the longest: in how many ways a run goes on to the left
        shorter = F.col("run").bitwiseAND(F.lit((1 << 8 * order) - 1))
        levels.append(written(levels[-1].select(shorter.alias("run")).groupBy("run").agg(F.count("*").alias("n")), f"ways{order}"))
    levels.reverse()
    lower, out = None, []
    for order, level in enumerate(levels, 1):
        told = level.agg(*(F.count(F.when(F.col("n") == k, 1)).alias(f"n{k}") for k in (1, 2, 3, 4))).first()
        d1, d2, d3 = discounts([float(x) for x in told])
        cut = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        context = level.select(F.shiftright("run", 8).alias("context"), "n", cut.alias("cut"))
        spare = context.groupBy("context").agg(F.sum("n").alias("total"), (F.sum("cut") / F.sum("n")).alias("spare"))
        rows = level.select("run", F.shiftright("run", 8).alias("context"), (F.col("n") - cut).alias("own")).join(spare, "context")
        if lower is None:
            rows = rows.withColumn("below", F.lit(1.0 / 256))
        else:
            shorter = F.col("run").bitwiseAND(F.lit((1 << 8 * (order - 1)) - 1))
            rows = rows.withColumn("shorter", shorter).join(lower.select(F.col("run").alias("shorter"), F.col("p").alias("below")), "shorter")
        share = F.col("spare") * F.col("below")
        lower = written(rows.select("run", (F.col("own") / F.col("total") + share).alias("p"), share.alias("share")), f"order{order}")
        zero = F.lit(0.0)
        out += [lower.select(_key(F.col("run"), order).alias("key"), F.log2(F.col("p") / F.col("share")).alias("adds"), zero.alias("backs"))]
        out += [spare.select(_key(F.col("context"), order - 1).alias("key"), zero.alias("adds"), F.log2("spare").alias("backs"))]
    every = out[0]
    for part in out[1:]:
        every = every.unionAll(part)
    return every.groupBy("key").agg(F.sum("adds").cast("float").alias("adds"), F.sum("backs").cast("float").alias("backs"))


class Shard:
    """Some runs of a model, sorted. ``bits`` is what they give to the code length of each run asked for."""

    def __init__(self, key: np.ndarray, adds: np.ndarray, backs: np.ndarray, first: bool):
        order = np.argsort(key)
        self.key, self.adds, self.backs, self.first = key[order], adds[order].astype(np.float32), backs[order].astype(np.float32), first

    def _found(self, runs: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
        """Which of the runs of a length are in the table, in the order of their numbers, and their rows."""
        mark = 1 << 8 * order
        low, high = np.searchsorted(self.key, [mark, mark << 8])
        own, asked = self.key[low:high], np.argsort(runs)
        keys = runs[asked] + mark
        at = np.searchsorted(own, keys)
        hit = at < len(own)
        hit[hit] = own[at[hit]] == keys[hit]
        return asked[hit], low + at[hit]

    def bits(self, asked: np.ndarray) -> np.ndarray:
        """Runs of a length are looked up once each: those of ``ORDER`` bytes, then their different ends, and so
        on down to nothing. Those lengths but the first are contexts too, of what follows."""
        coded = pa.array(asked).dictionary_encode()
        different = coded.dictionary.to_numpy()
        told = (8.0 if self.first else 0.0) - self._sums(different, ORDER, self.adds) - self._sums(different >> 8, ORDER - 1, self.backs)
        return told[coded.indices.to_numpy()]

    def _sums(self, runs: np.ndarray, order: int, values: np.ndarray) -> np.ndarray:
        """For each run, the values of it and of all its ends."""
        coded = pa.array(runs).dictionary_encode()
        different, of = coded.dictionary.to_numpy(), coded.indices.to_numpy()
        out = self._sums(different & ((1 << 8 * (order - 1)) - 1), order - 1, values) if order else np.zeros(len(different))
        hit, at = self._found(different, order)
        out[hit] += values[at]
        return out[of]


def shards(table: DataFrame, most: int = SHARD_RUNS) -> Iterator[Shard]:
    """The model's table in shards of about ``most`` runs, one at a time on the driver."""
    count = max(1, -(-table.count() // most))
    for k in range(count):
        mine = table.where(F.pmod(F.xxhash64("key"), F.lit(count)) == k).toArrow()
        yield Shard(mine["key"].to_numpy(), mine["adds"].to_numpy(), mine["backs"].to_numpy(), k == 0)


def trusted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose label says quality 1. Their ids are broadcast while they are few."""
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    return docs.select("doc_id", "text").join(if_few(good), "doc_id", "left_semi")


def in_training(key: Column) -> Column:
    return F.crc32(key.cast("string")) % FOLDS != 0


def fit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The model of all trusted documents but every fifth, on shared files."""
    counts = run_counts(trusted(docs, labels).where(in_training(F.col("doc_id"))))
    return written(model(written(counts, "counts")), "model")


def repeats(text: bytes) -> float:
    """The share of a text's word trigrams that it has had before, shrunk for short texts."""
    words = text.split()
    n = max(0, len(words) - 2)
    return (n - len(set(zip(words, words[1:], words[2:])))) / (n + NEW_TRIGRAMS)


def _sums(texts: list[bytes], shard: Shard) -> np.ndarray:
    out = np.zeros(len(texts))
    for found, owners, sizes in runs(texts):
        np.add.at(out, owners, np.add.reduceat(shard.bits(found), np.cumsum(sizes) - sizes))
        del found  # before the next group's are made
    return out


def scored(docs: DataFrame, table: DataFrame, carried: tuple[str, ...] = (), most: int = SHARD_RUNS) -> DataFrame:
    """(doc_id, lang, n_symbols, bits, repeats): bytes and code length of every whole text under the
    model, and its share of repeated word trigrams. Columns ``carried`` follow unchanged.

    Every shard is a pass over the texts, and gives each row a part of its sum.
    """
    ready = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text", *(F.col(c).alias(f"c{k}") for k, c in enumerate(carried)))
    kept = [f"c{k}" for k in range(len(carried))]
    parts = shards(table, most)
    first, second = next(parts), next(parts, None)
    ready = keyed(ready, "row") if second else ready.withColumn("row", F.lit(0).cast("long"))
    kinds = {f.name: f.dataType.simpleString() for f in ready.schema.fields}

    def passed(shard: Shard) -> DataFrame:
        held = docs.sparkSession.sparkContext.broadcast(shard)  # SHARD_RUNS runs at most, about
        whole = shard.first
        names = ["row", "doc_id", "lang", *kept] if whole else ["row"]
        extra = [("bits", "double"), *([("n_symbols", "long"), ("repeats", "double")] if whole else [])]

        def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in bounded(source):
                texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
                columns = [*map(batch.column, names), pa.array(_sums(texts, held.value))]
                if whole:
                    columns += [pa.array([len(t) for t in texts], pa.int64()), pa.array(map(repeats, texts), pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, *(n for n, _ in extra)])

        return written(ready.mapInArrow(batches, ", ".join(f"{n} {t}" for n, t in [*((n, kinds[n]) for n in names), *extra])), "scored")

    out = passed(first)
    if second:
        more = passed(second)
        for shard in parts:
            more = more.unionAll(passed(shard))
        total = more.groupBy("row").agg(F.sum("bits").alias("more"))
        out = out.join(total, "row").withColumn("bits", F.col("bits") + F.col("more"))
    return out.select("doc_id", "lang", "n_symbols", "bits", "repeats", *(F.col(f"c{k}").alias(c) for k, c in enumerate(carried)))


def judged(docs: DataFrame, labels: DataFrame, quantiles: tuple[float, float] = QUANTILES, carried: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, lang, n_symbols, perplexity, low, high, kept) for every row of (doc_id, text, lang).

    Trains on the documents that ``labels`` (doc_id, quality) trusts. Perplexity is per byte, shrunk
    for short texts; low and high are the thresholds for the row's language, or over all languages
    where it is null or has fewer than ``FEWEST`` trusted documents left out of training. Texts that repeat their
    word trigrams far more than trusted ones are rejected as well. Null and empty texts
    are rejected with a null perplexity. Without trusted documents, or where no threshold is known,
    everything else is kept. Repeated rows are judged alike. Columns ``carried`` follow unchanged; others are ignored.
    """
    rows = scored(docs, fit(docs, labels), carried)
    names = {c: f"c{k}" for k, c in enumerate(carried)}
    rows = rows.select("doc_id", "lang", "n_symbols", "bits", "repeats", *(F.col(c).alias(n) for c, n in names.items()))
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()

    def apart(table: DataFrame) -> DataFrame:
        return table.where(~in_training(F.col("doc_id")) & (F.col("n_symbols") > 0)).join(good, "doc_id", "left_semi")

    sums = [F.sum("bits").alias("b"), F.sum("n_symbols").alias("s")]
    whole = apart(rows).agg(*sums).first()
    overall = whole["b"] / whole["s"] if whole["s"] else 3.0
    means = apart(rows).where("lang is not null").groupBy("lang").agg(*sums, F.count("*").alias("docs")).where(F.col("docs") >= FEWEST).select("lang", (F.col("b") / F.col("s")).alias("mean"))
    score = (F.col("bits") + PRIOR * F.coalesce("mean", F.lit(overall))) / (F.col("n_symbols") + PRIOR)
    shrunk = written(rows.join(means, "lang", "left").withColumn("h", score), "shrunk")
    cuts = F.percentile_approx("h", list(quantiles), 100_000).alias("q")
    pooled = apart(shrunk).agg(cuts, F.percentile_approx("repeats", quantiles[1], 100_000).alias("r")).first()
    every = pooled["q"] or [0.0, 500.0]
    most = 1.0 if pooled["r"] is None else max(REPEATS_FLOOR, REPEATS * pooled["r"])
    limits = apart(shrunk).where("mean is not null").groupBy("lang").agg(cuts)  # a row for each language
    told = shrunk.join(limits, "lang", "left").withColumn("q", F.coalesce("q", F.lit(every)))
    beyond = MARGIN * (F.get("q", F.lit(1)) - F.get("q", F.lit(0))) / 2
    told = told.withColumn("low", F.get("q", F.lit(0)) - beyond).withColumn("high", F.get("q", F.lit(1)) + beyond)
    filled, two = F.col("n_symbols") > 0, F.lit(2.0)
    kept = filled & F.col("h").between(F.col("low"), F.col("high")) & (F.col("repeats") <= most)
    return told.select(
        "doc_id", "lang", "n_symbols", F.when(filled, F.pow(two, "h")).alias("perplexity"),
        F.pow(two, "low").alias("low"), F.pow(two, "high").alias("high"), kept.alias("kept"), *(F.col(n).alias(c) for c, n in names.items()),
    )
