"""Encoding and decoding with byte-level merges."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from heapq import heapify, heappop, heappush

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.text import SEPARATOR, byte_symbols, longest_first, pretokens, split_specials, symbol_ids
from quern.operators.train import Tokenizer, apply_merges
from quern.sources.shared import spare

#: Vocabularies up to this id are decoded by a literal in the JVM, others in Arrow batches. Results are the same.
SMALL_VOCAB = 1024
#: Pre-tokens that a task remembers, and their bytes at most: longer ones are merged each time.
REMEMBERED, LONGEST = 200_000, 64
#: Merge lists up to this length are applied as one JVM expression.
FOLD_LIMIT = 64


def vocab_frame(spark, tokenizer: Tokenizer) -> DataFrame:
    """(token_id, token) with tokens as bytes."""
    return spark.createDataFrame([(i, bytearray(b)) for i, b in sorted(tokenizer.vocab.items())], "token_id int, token binary")


def merges_frame(spark, tokenizer: Tokenizer) -> DataFrame:
    """(rank, left, right)."""
    rows = [(k, bytearray(a), bytearray(b)) for k, (a, b) in enumerate(tokenizer.merges)]
    return spark.createDataFrame(rows, "rank int, left binary, right binary")


def with_specials(tokenizer: Tokenizer, specials: Sequence[str]) -> Tokenizer:
    """A tokenizer that knows these special tokens; unknown ones get the ids after the highest."""
    vocab, known = dict(tokenizer.vocab), set(tokenizer.vocab.values())
    for s in dict.fromkeys(specials):
        if s.encode() not in known:
            vocab[max(vocab, default=-1) + 1] = s.encode()
            known.add(s.encode())
    return Tokenizer(vocab, tokenizer.merges, list(dict.fromkeys(specials)), tokenizer.pairs)


def usable_ranks(tokenizer: Tokenizer) -> dict[tuple[bytes, bytes], int]:
    """Rank of each merge whose result is a token. Ranks count all merges; of a repeated pair the
    last counts."""
    known = set(tokenizer.vocab.values())
    return {p: k for k, p in enumerate(tokenizer.merges) if p[0] + p[1] in known}


def token_symbols(text: Column, tokenizer: Tokenizer) -> Column:
    """The tokens of a text as a string of symbols, for merges learned here, without a shuffle."""
    if tokenizer.pairs is None or len(tokenizer.pairs) > FOLD_LIMIT:
        raise ValueError("only a short list of merges learned here folds into one expression")
    marked = F.array_join(F.transform(pretokens(text), byte_symbols), SEPARATOR)
    return F.replace(apply_merges(marked, tokenizer.pairs), F.lit(SEPARATOR), F.lit(""))


def held(df: DataFrame, name: str, column: Column) -> DataFrame:
    """``df`` with a column that is computed once, however often later expressions name it."""
    return df.select("*", F.explode(F.array(column)).alias(name))


def encode(docs: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """``docs`` with ``ids array<int>``. A null text has null ids, an empty one none.

    Merges learned here, up to ``FOLD_LIMIT``, become one chain of replacements in the JVM. Others
    run in Arrow batches: in each text the lowest rank merges first, and a worker keeps what it has
    found for a pre-token. Special tokens of the tokenizer stand for themselves. A column ``ids`` is replaced.
    """
    if tokenizer.pairs is not None and len(tokenizer.pairs) <= FOLD_LIMIT and not tokenizer.specials:
        own = docs.drop("ids")
        name = spare("symbols", own.columns)
        return held(own, name, token_symbols(F.col("text"), tokenizer)).withColumn("ids", symbol_ids(F.col(name))).drop(name)
    docs = docs.drop("ids")
    schema = T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])
    names = docs.columns
    specials = longest_first(tokenizer.specials)
    pieces = F.transform(split_specials(F.col("text"), specials, keep=True), lambda p: F.when(p.isin(specials) if specials else F.lit(False), F.array(p)).otherwise(pretokens(p)))
    ready = docs.select("*", F.when(F.col("text").isNotNull(), F.flatten(pieces)))  # the last column, whatever the others' names
    ranks, ids, marks = usable_ranks(tokenizer), tokenizer.ids, set(specials)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list[int]] = {}

        def told(w: str) -> list[int]:
            if w in marks:
                return [ids[w.encode()]]
            out = merge_word(w.encode(), ranks, ids)
            if len(w) <= LONGEST:
                if len(found) >= REMEMBERED:
                    found.clear()
                found[w] = out
            return out

        for batch in source:
            out = [None if words is None else [i for w in words for i in (found.get(w) or told(w))] for words in batch.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(out, pa.list_(pa.int32()))], names=[*names, "ids"])

    return ready.mapInArrow(batches, schema)


def merge_word(word: bytes, ranks: dict[tuple[bytes, bytes], int], ids: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token. All places of the lowest rank merge together, from the left and without
    overlap; pairs that this makes wait for the next turn. A heap holds the places of pairs as (rank,
    start, middle, end), so long words cost n log n."""
    n = len(word)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def pair(i: int) -> tuple[int, int, int, int] | None:
        middle = after[i] if 0 <= i < n else n
        if middle >= n:
            return None
        rank = ranks.get((word[i:middle], word[middle : after[middle]]))
        return None if rank is None else (rank, i, middle, after[middle])

    queue = [p for p in map(pair, range(n)) if p]
    heapify(queue)
    while queue:
        turn = [heappop(queue)]
        while queue and queue[0][0] == turn[0][0]:
            turn.append(heappop(queue))
        merged = []
        for _, i, middle, end in turn:
            if after[i] == middle and after[middle] == end:  # neither token has changed since
                after[i], after[middle] = end, -1
                if end < n:
                    before[end] = i
                merged.append(i)
        for p in {before[i] for i in merged} | set(merged):
            if p >= 0 and after[p] >= 0 and (found := pair(p)):
                heappush(queue, found)
    out, i = [], 0
    while i < n:
        out.append(ids[word[i : after[i]]])
        i = after[i]
    return out


def decode(encoded: DataFrame, tokenizer: Tokenizer, key: str = "doc_id") -> DataFrame:
    """(key, text) from (key, ids), row by row: rows that share a key stay apart, null ids give null. An
    unknown or null id and bytes that aren't UTF-8 become U+FFFD."""
    highest = max(tokenizer.vocab, default=-1)
    if highest <= SMALL_VOCAB:
        table = F.lit([tokenizer.vocab.get(i, b"\xef\xbf\xbd").hex().upper() for i in range(highest + 1)])
        raw = F.unhex(F.array_join(F.transform("ids", lambda i: F.coalesce(F.get(table, i), F.lit("EFBFBD"))), ""))
        return encoded.select(key, F.make_valid_utf8(raw.cast("string")).alias("text"))
    known = sorted(tokenizer.vocab)
    held = encoded.sparkSession.sparkContext.broadcast((known, [tokenizer.vocab[i] for i in known]))  # the vocabulary

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = pa.array(held.value[0], pa.int64())
        tokens = pa.array([*held.value[1], b"\xef\xbf\xbd"], pa.large_binary())
        for batch in source:
            rows = batch.column("ids")
            at = pc.fill_null(pc.index_in(rows.values.cast(pa.int64()), value_set=ids), len(ids))
            lists = pa.LargeListArray.from_arrays(rows.offsets.cast(pa.int64()), tokens.take(at))
            raw = pc.if_else(rows.is_valid(), pc.binary_join(lists, pa.scalar(b"", pa.large_binary())), None)
            yield pa.RecordBatch.from_arrays([batch.column(key), raw.cast(pa.binary())], names=[key, "raw"])

    schema = T.StructType([encoded.schema[key], T.StructField("raw", T.BinaryType())])
    return encoded.select(key, "ids").mapInArrow(batches, schema).select(key, F.make_valid_utf8(F.col("raw").cast("string")).alias("text"))


def decode_ids(ids: Sequence[int], tokenizer: Tokenizer) -> str:
    """One sequence on the driver."""
    return b"".join(tokenizer.vocab.get(i, b"\xef\xbf\xbd") for i in ids).decode("utf-8", "replace")


def end_id(tokenizer: Tokenizer, token: str) -> int:
    """The id of a delimiter token, which must be a single token."""
    ids = tokenizer.ids
    if token.encode() in ids:
        return ids[token.encode()]
    import regex

    from quern.functions.text import PRETOKEN_PATTERN

    found = [i for w in regex.findall(PRETOKEN_PATTERN, token) for i in merge_word(w.encode(), usable_ranks(tokenizer), ids)]
    if len(found) != 1:
        raise ValueError(f"{token!r} is {len(found)} tokens, not one")
    return found[0]


def fits_uint16(tokenizer: Tokenizer) -> bool:
    """Whether every id can be stored in 16 bits."""
    return max(tokenizer.vocab, default=0) <= 65_535
