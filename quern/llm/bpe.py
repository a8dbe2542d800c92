"""Byte-level BPE by ranks: a queue of merge ranks on a hierarchical bitmap.

Each adjacent pair of a pre-token waits in the bucket of its merge rank. A two-level bitmap marks
buckets that hold something; finding the first set bit gives the lowest rank in constant time.
Tokens are a linked list over byte positions; an entry whose pair has changed since is skipped when
it is met. A pre-token of n bytes takes O(n log n) at most, so very long ones are no trouble.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quern.llm.batches import bounded, kept
from quern.llm.pieces import LONGEST, PieceMemory

_BITS = 8  # ranks of a block, as bits
_LOW = (1 << _BITS) - 1


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}


def encode_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token.

    ``buckets`` hold the places (start, end) of the pairs that wait, by rank, the leftmost first.
    ``blocks`` have a bit for each rank of a block whose bucket isn't empty, ``summary`` one for each
    block with a bit. The lowest set bits lead to the next place; a place whose tokens have changed
    since it was queued is skipped.
    """
    found = ranks.get(word)
    if found is not None:
        return [found]
    n = len(word)
    after = list(range(1, n + 2))  # where the token that starts here ends; after[n] is past the end
    before = list(range(-1, n))
    summary, rank_of = 0, ranks.get
    blocks: dict[int, int] = {}
    buckets: dict[int, list[tuple[int, int]]] = {}
    fresh = [(i, i + 2) for i in range(n - 1)]
    while True:
        for place in fresh:
            rank = rank_of(word[place[0] : place[1]])
            if rank is not None:
                bucket = buckets.get(rank)
                if bucket is None:
                    buckets[rank] = [place]
                    block = rank >> _BITS
                    blocks[block] = blocks.get(block, 0) | 1 << (rank & _LOW)
                    summary |= 1 << block
                else:
                    heappush(bucket, place)
        while summary:
            block = (summary & -summary).bit_length() - 1
            bits = blocks[block]
            low = bits & -bits
            rank = (block << _BITS) + low.bit_length() - 1
            bucket = buckets[rank]
            i, end = heappop(bucket)
            if not bucket:
                del buckets[rank]
                if bits == low:
                    del blocks[block]
                    summary ^= 1 << block
                else:
                    blocks[block] = bits ^ low
            middle = after[i]
            if 0 <= middle < n and after[middle] == end:
                break
        else:
            break
        after[i], after[middle] = end, -1
        fresh = []
        if end < n:
            before[end] = i
            fresh.append((i, after[end]))
        if before[i] >= 0:
            fresh.append((before[i], end))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[word[i : after[i]]])
        i = after[i]
    return ids


class RankTokens:
    """Texts to ids by ranks and a pattern. Remembers pre-tokens of at most ``LONGEST`` characters, up
    to a number: a bound in bytes."""

    specials: list[str] = []

    def __init__(self, ranks: dict[bytes, int], pattern: str, limit: int = 200_000):
        self.ranks, self.limit = ranks, limit
        self.find = regex.compile(pattern).findall
        self.words: dict[str, list[int]] = {}
        self.opens = np.zeros(max(ranks.values()) + 1, bool)
        self.opens[[r for t, r in ranks.items() if t.startswith(b" ")]] = True
        self.newline = ranks[b"\n"]

    def ids(self, text: str) -> np.ndarray:
        words, found = self.words, []
        for w in self.find(text):
            ids = words.get(w)
            if ids is None:
                ids = encode_word(w.encode(), self.ranks)
                if len(w) <= LONGEST:
                    if len(words) >= self.limit:
                        words.clear()
                    words[w] = ids
            found += ids
        return np.array(found, "<u4")


_encoders: dict[tuple[str, str], PieceMemory] = kept()
_tables: dict[str, list[bytes]] = kept()


def _encoder(path: str, pattern: str) -> PieceMemory:
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = PieceMemory(RankTokens(read_ranks(path), pattern))
    return _encoders[path, pattern]


def _table(path: str) -> list[bytes]:
    if path not in _tables:
        ranks = read_ranks(path)
        _tables[path] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            _tables[path][rank] = token
    return _tables[path]


def _encoded(source: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    memory = _encoder(path, pattern)
    for batch in bounded(source, uses=(_encoders, _tables)):
        ids = memory.texts(batch.column("text"))
        sizes = pa.array([len(x) // 4 for x in ids], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), sizes, pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"])


def _decoded(ids: bytes | None, table: list[bytes]) -> bytes:
    return b"".join([table[i] for i in memoryview(ids or b"").cast("I")])


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids): every text's ids as little-endian unsigned 32-bit integers.

    A null text counts as empty and has no ids. Rows are independent, so repeated rows and ids, and
    a null doc_id, pass through; columns other than doc_id and text are dropped. ``path`` is a rank
    file that every executor has; ``pattern`` splits a text into pre-tokens.
    """
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(lambda source: _encoded(source, path, pattern), f"doc_id {kind}, n_tokens long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(…, decoded): the bytes of ``ids``, beside the columns that are there. An id that the file
    doesn't have fails; null ids decode to no bytes."""
    names = encoded.columns

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(path)
        for batch in source:
            out = [_decoded(x, table) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*names, "decoded"])

    kinds = ", ".join(f"`{n}` {t}" for n, t in encoded.dtypes)
    return encoded.mapInArrow(batches, f"{kinds}, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) by encoding and then decoding every text.

    Both run in one worker, which passes on only the digests: a text's ids and bytes go nowhere else.
    """

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(path)
        for batch in _encoded(source, path, pattern):
            ids = batch.column("ids")
            coded = [hashlib.sha256(x.as_py()).hexdigest() for x in ids]
            plain = [hashlib.sha256(_decoded(x.as_py(), table)).hexdigest() for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_tokens"), pa.array(coded, pa.string()), pa.array(plain, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(batches, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
