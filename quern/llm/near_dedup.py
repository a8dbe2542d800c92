"""Near duplicates by min-max hashing of word shingles, confirmed on full sets.

Each permutation of a document's shingles gives two values, the least and the greatest, so a
signature of 2n values costs n hash evaluations. Bands of the signature are keys; documents with a
key in common are candidates. With 32 bands of 5 values, a pair of similarity 0.8 shares
no key with a chance of 3 in a million, a closer pair far less often.

Documents with the same set are one class from the start, so copies meet nowhere. The centre of a
bucket is the class that meets most others over all its buckets; every class is compared with its
buckets' centres only. What two classes of one bucket still have to be compared is told by how they
differ from its centre. If both are linked to it, they are in one component. If not, they can only
be alike if their differences from it have shingles in common: these are joined by prefix, length and
position, rare shingles first (see ``_further``). So no link between candidates is lost and no group
is paired in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.batches import bounded
from quern.sources.shared import if_few, keyed, spare, written

BANDS, ROWS = 32, 5
#: Bytes of text that are shingled together, unless one text has more.
GROUP_BYTES = 4 << 20
#: Pairs that one copy of a centre's set serves, about.
SHARE = 1024
#: Cells in which shingles are counted, as bits: the driver and every task hold so many numbers.
CELL_BITS = 16
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """Each text's distinct shingles of ``words`` words as sorted 64-bit hashes. Words are hashed once
    for a group of texts; nothing is kept beyond it."""
    sizes = np.cumsum(pc.binary_length(pc.fill_null(texts, "")).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + GROUP_BYTES, side="right")))
        split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.slice(at, end - at), "")))  # A-Z and ASCII white space only
        offsets, flat = split.offsets.to_numpy(), split.flatten()
        filled = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
        coded = flat.dictionary_encode()
        hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
        each = hashed[coded.indices.to_numpy()][filled]
        bounds = np.concatenate([[0], np.cumsum(filled)])[offsets - offsets[0]].tolist()
        for low, high in zip(bounds, bounds[1:]):
            yield _shingles(each[low:high], words)
        at = end


def _shingles(each: np.ndarray, words: int) -> np.ndarray:
    if not len(each):
        return np.zeros(0, np.uint64)
    size = min(words, len(each))
    mixed = np.full(len(each) - size + 1, np.uint64(len(each) if size < words else 0))
    for k in range(size):
        mixed = _mixed(mixed * _ODD + each[k : k + len(mixed)])
    return np.unique(mixed)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    draws = _mixed(np.arange(1, 2 * count + 1, dtype=np.uint64) * _ODD)
    return draws[:count] | np.uint64(1), draws[count:]


def band_keys(shingles: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A key for each band of the signature: both extremes of each permutation."""
    a, b = _permutations((bands * rows + 1) // 2)
    low = np.full(len(a), np.uint64(2**64 - 1))
    high = np.zeros(len(a), np.uint64)
    for k in range(0, len(shingles), 256):
        permuted = shingles[k : k + 256][None, :] * a[:, None] + b[:, None]
        permuted ^= permuted >> np.uint64(32)
        np.minimum(low, permuted.min(axis=1), out=low)
        np.maximum(high, permuted.max(axis=1), out=high)
    signature = np.concatenate([low, high])[: bands * rows]
    # The two extremes of one permutation go to different bands: they are not quite independent.
    table = signature.reshape(rows, bands)
    keys = np.arange(1, bands + 1, dtype=np.uint64)
    for r in range(rows):
        keys = _mixed(keys * _ODD + table[r])
    return keys.astype(np.int64)


def sketches(docs: DataFrame, words: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, digest, bands): the size and digest of each document's set, and its keys."""

    def made(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(source):
            sizes, digests, keys = [], [], []
            for found in shingle_sets(batch.column("text"), words):
                sizes.append(len(found))
                digests.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                keys.append(band_keys(found, bands, rows).tolist() if len(found) else None)
            columns = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "digest", "bands"])

    ready = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return ready.mapInArrow(made, "doc_id long, n_shingles long, digest binary, bands array<long>")


def full_sets(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, hashes): each document's whole set as bytes of sorted 64-bit hashes."""

    def made(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(source):
            sets = [found.tobytes() for found in shingle_sets(batch.column("text"), words)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.binary())], names=["doc_id", "hashes"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(made, "doc_id long, hashes binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are alike: 100 * intersection >= percent * union."""

    def checked(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(source, "x"):
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.sort(np.concatenate([u, v]))
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * common >= percent * (len(both) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("doc_id").alias("a"), F.col("hashes").alias("x"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("hashes").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(checked, "a long, b long")


def compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, n, linked, least, differs) for pairs of a centre a and a class b, whose set has n shingles.

    ``differs`` has the d shingles that are in one of the two sets only. Let r = (100 - percent) / (100 +
    percent). Sets are alike when they differ in at most r times the sum of their sizes, so a class that
    is not linked to a differs from it in more. Hence b is only alike to such a class if their two
    differences have more than (d + r * (size of a - n)) / 2 shingles in common: ``least`` at least.
    Each centre's set goes to its pairs in shares of ``SHARE``, so that one with very many is no task's alone.
    """

    def told(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("linked", pa.bool_()), ("least", pa.int64()), ("differs", pa.list_(pa.int64()))])
        for batch in bounded(source, "x"):
            rows = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                u, v = np.frombuffer(x.as_buffer(), np.int64), np.frombuffer(y.as_buffer(), np.int64)
                differs = np.setxor1d(u, v, assume_unique=True)
                d = len(differs)
                common = (len(u) + len(v) - d) // 2
                linked = 100 * common >= percent * (common + d)
                least = (d * (100 + percent) + (100 - percent) * (len(u) - len(v))) // (2 * (100 + percent)) + 1
                rows.append((len(v), linked, least, differs))
            columns = zip(*rows, strict=True) if rows else ((),) * 4
            arrays = [pa.array(c, f.type) for c, f in zip(columns, list(schema)[2:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *arrays], schema=schema)

    shares = written(pairs.groupBy("a").agg(F.floor(F.count("*") / SHARE).alias("most")), "shares")
    left = sets.select(F.col("doc_id").alias("a"), F.col("hashes").alias("x")).join(shares, "a").select("a", "x", F.explode(F.sequence(F.lit(0), "most")).alias("share"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("hashes").alias("y"))
    dealt = pairs.join(shares, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("most") + 1).alias("share"))
    both = dealt.join(right, "b").join(left, ["a", "share"])
    return both.select("a", "b", "x", "y").mapInArrow(told, "a long, b long, n long, linked boolean, least long, differs array<long>")


def _cell(x: np.ndarray) -> np.ndarray:
    return (x.view(np.uint64) >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def ordered(seen: DataFrame) -> DataFrame:
    """``seen`` with each ``differs`` in one order for all, rare shingles first. Rarity is counted over all
    rows, in 2**CELL_BITS cells of hashes, which is all that the driver gets."""

    def counted(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << CELL_BITS, np.int64)
        for batch in source:
            cells, n = np.unique(_cell(batch.column("differs").flatten().to_numpy(zero_copy_only=False)), return_counts=True)
            total[cells] += n
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], names=["cell", "n"])

    found = seen.select("differs").mapInArrow(counted, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    often = np.zeros(1 << CELL_BITS, np.int64)
    often[found["cell"].to_numpy()] = found["n"].to_numpy()
    held = seen.sparkSession.sparkContext.broadcast(often)
    names, at = seen.columns, seen.columns.index("differs")

    def sorted_(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            lists, out = batch.column(at), []
            for x in lists:
                own = x.values.to_numpy(zero_copy_only=False)
                out.append(own[np.lexsort((own, held.value[_cell(own)]))])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.int64())) if n == "differs" else c for n, c in zip(names, batch.columns, strict=True)], names=names)

    return seen.mapInArrow(sorted_, seen.schema)


def contracted(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(v, c): ``labels`` after the links (a, b) between vertices; c is the least vertex reached.

    Each round, every label moves to the least label beside it; links between labels that are then
    the same go. Labels left over at least halve, so rounds are few. All tables are on shared files.
    """
    first = links.join(labels.select(F.col("v").alias("a"), F.col("c").alias("ca")), "a").join(labels.select(F.col("v").alias("b"), F.col("c").alias("cb")), "b")
    edges = written(_between(first.select("ca", "cb")), "edges")
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        least = written(both.groupBy("a").agg(F.min("b").alias("to")).where("to < a"), "least")  # written: joins split where many move to one
        jump = least.join(least.select(F.col("a").alias("to"), F.col("to").alias("far")), "to", "left")
        moves = written(jump.select(F.col("a").alias("at"), F.coalesce("far", "to").alias("to")), "moves")
        labels = written(labels.join(moves.withColumnRenamed("at", "c"), "c", "left").select("v", F.coalesce("to", "c").alias("c")), "labels")
        ends = edges.join(moves.select(F.col("at").alias("a"), F.col("to").alias("ca")), "a", "left").join(moves.select(F.col("at").alias("b"), F.col("to").alias("cb")), "b", "left")
        edges = written(_between(ends.select(F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb"))), "edges")
    return labels


def _between(pairs: DataFrame) -> DataFrame:
    ends = pairs.where("ca != cb").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"))
    return ends.distinct()


def components(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of (doc_id, text).

    A set holds a text's distinct shingles of ``words`` words; with fewer words the whole sequence is
    the one shingle. Null, empty and white texts have empty sets and are linked with nothing.
    component_id is the smallest doc_id reachable over links; kept says that it is the row's own.
    Rows that share a doc_id are one document, linked by any of their texts. A row whose doc_id is
    null is linked with nothing, has no component and is kept. Other columns are ignored.
    """
    sketch = written(sketches(docs, words, bands, rows), "sketch")
    vertices = sketch.where("doc_id is not null and digest is not null")
    classes = written(vertices.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min_by("bands", "doc_id").alias("bands")), "classes")
    members = written(classes.select("rep", F.explode("bands").alias("key")), "members")
    sizes = members.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("last"), F.count("*").alias("m"))
    held = written(members.join(sizes.where("low != last"), "key").select("key", "rep", "m"), "held")
    met = held.groupBy("rep").agg(F.sum("m").alias("met"))
    centres = held.join(met, "rep").groupBy("key").agg(F.max_by("rep", F.struct("met", -F.col("rep"))).alias("a"))
    pairs = written(held.join(centres, "key").where("rep != a").select("a", F.col("rep").alias("b")).distinct(), "pairs")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    inside = written(held.select(F.col("rep").alias("doc_id")).distinct(), "inside")
    sets = written(full_sets(texts.join(if_few(inside), "doc_id", "left_semi"), words), "sets")
    labels = written(classes.select(F.col("rep").alias("v")).distinct().withColumn("c", F.col("v")), "labels")
    seen = written(compared(pairs, sets, percent), "seen")
    links = seen.where("linked").select("a", "b")
    labels = contracted(labels, links.union(_one_document(vertices, classes)))
    labels = _further(seen, labels, sets, percent)
    reached = written(classes.select("digest", "rep").join(labels.withColumnRenamed("v", "rep"), "rep"), "reached")
    out = sketch.join(reached.select("digest", "c"), "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def _one_document(vertices: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between the classes of rows that share a doc_id."""
    many = vertices.groupBy("doc_id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low != high").select("doc_id")
    held = vertices.select("doc_id", "digest").join(many, "doc_id", "left_semi").distinct().join(classes.select("digest", "rep"), "digest").select("doc_id", "rep")
    first = held.groupBy("doc_id").agg(F.min("rep").alias("a"))
    return held.join(first, "doc_id").where("rep != a").select("a", F.col("rep").alias("b")).distinct()


def _further(seen: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The labels after links between classes that have a centre in common, one of them not linked to it.

    Of the classes b and o of one centre, o not linked to it, b's first shingles in the common order, so
    many that fewer than ``least`` are left out, hold one that o's difference has too, the first that
    they share. If o's place of it, or b's, leaves too few for what the two sizes ask, they aren't alike.
    """
    apart = seen.where("not linked").select("a").distinct()
    placed = seen.join(apart, "a", "left_semi").join(labels.select(F.col("v").alias("b"), "c"), "b")
    rows = written(ordered(placed), "differs")
    d = F.size("differs")
    prefix = rows.select("a", "b", "n", "c", "linked", d.alias("d"), F.posexplode(F.slice("differs", 1, F.greatest(d - F.col("least") + 1, F.lit(0)).cast("int"))).alias("i", "x"))
    other = rows.where("not linked").select("a", F.col("b").alias("o"), F.col("n").alias("m"), F.col("c").alias("oc"), F.col("least").alias("o_least"), d.alias("e"), F.posexplode("differs").alias("j", "x"))
    alike = F.least("n", "m") * 100 >= F.greatest("n", "m") * percent
    once = F.col("linked") | ((F.col("b") < F.col("o")) & (F.col("j") <= F.col("e") - F.col("o_least")))
    left = F.least(F.col("d") - F.col("i"), F.col("e") - F.col("j"))
    enough = 2 * (100 + percent) * left >= (100 + percent) * (F.col("d") + F.col("e")) - (100 - percent) * (F.col("n") + F.col("m"))
    near = prefix.join(other, ["a", "x"]).where((F.col("c") != F.col("oc")) & alike & once & enough)
    pairs = written(near.select(F.least("b", "o").alias("a"), F.greatest("b", "o").alias("b")).distinct(), "pairs")
    links = written(confirmed(pairs, sets, percent), "links")
    return labels if links.isEmpty() else contracted(labels, links)


def near_dedup(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` of which one row of each component stays: the smallest doc_id, null last.

    Each row is a document of its own, whether its doc_id is null or repeated or not.
    """
    row = spare("row", docs.columns)
    rows = keyed(docs, row)
    found = components(rows.select(F.col(row).alias("doc_id"), "text"), words, percent).select(F.col("doc_id").alias(row), "component_id")
    ids = rows.select(row, F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", row).alias("id"))
    placed = written(found.join(ids, row), "placed")
    first = placed.groupBy("component_id").agg(F.min("id").alias("first"))
    gone = written(placed.join(first, "component_id").where(F.col(f"first.{row}") != F.col(row)).select(row), "gone")
    return rows.join(if_few(gone), row, "left_anti").select(*(f"`{c}`" for c in docs.columns))
