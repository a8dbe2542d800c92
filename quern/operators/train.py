"""Byte-pair merges learned from a corpus: exact, with deterministic ties."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import END_OF_TEXT, symbol, symbol_id
from quern.operators.counting import pair_counts, pretoken_counts, word_table
from quern.operators.shares import learn_here, learn_spread, slots
from quern.sources.shared import cut_lineage

#: Named settings: vocabulary sizes for a small and a large corpus.
PRESETS = {"small": {"vocab_size": 10_000, "specials": (END_OF_TEXT,)}, "large": {"vocab_size": 32_000, "specials": (END_OF_TEXT,)}}


@dataclass
class Tokenizer:
    """Vocabulary (id to bytes), merges in order of rank, special tokens."""

    vocab: dict[int, bytes]
    merges: list[tuple[bytes, bytes]]
    specials: list[str] = field(default_factory=list)
    pairs: list[tuple[int, int, int]] | None = None  # (left id, right id, new id), only where trained here

    @property
    def ids(self) -> dict[bytes, int]:
        """Bytes to id; the lowest id where several have the same bytes."""
        return {b: i for i, b in sorted(self.vocab.items(), reverse=True)}


def base_vocab(specials: Sequence[str]) -> dict[int, bytes]:
    """The 256 bytes, then each distinct special token."""
    found = [bytes([b]) for b in range(256)] + [s.encode() for s in dict.fromkeys(specials)]
    return dict(enumerate(found))


def train(docs: DataFrame, vocab_size: int, specials: Sequence[str] = (), strategy: str = "auto", local_words: int = 500_000) -> Tokenizer:
    """Learns merges until the vocabulary has ``vocab_size`` entries or no pair is left.

    Counting is one distributed aggregate. ``rounds`` then merges on the distributed word table, a
    batch of provably independent merges a job. ``spread`` merges in tasks that run together, each with
    a share of the words. ``local`` merges on the driver, but more than ``local_words`` distinct words,
    or more than 16 times as many bytes, as ``spread`` does. ``auto`` takes ``rounds`` for a few merges,
    ``local`` for more. Where tasks can't be had together, ``rounds`` stands for ``spread``. Results are
    the same.
    """
    vocab = base_vocab(specials)
    if vocab_size <= len(vocab):
        return Tokenizer(vocab, [], list(specials), [])
    words = word_table(pretoken_counts(docs, specials)).where(F.length("s") > 1)
    words = cut_lineage(words)  # counted once, whatever the rounds
    if strategy == "auto":
        strategy = "rounds" if vocab_size - len(vocab) <= 32 else "local"
    size = words.agg(F.count("*").alias("words"), F.coalesce(F.sum(F.length("s")), F.lit(0)).alias("symbols")).first()
    if strategy == "local" and (size["words"] > local_words or size["symbols"] > 16 * local_words):
        strategy = "spread"
    if strategy == "spread" and not slots(words):
        strategy = "rounds"
    if strategy == "rounds":
        pairs = _learn_rounds(words, vocab, vocab_size)
    else:
        pairs = learn_here(words, vocab, vocab_size) if strategy == "local" else learn_spread(words, vocab, vocab_size, size["symbols"])
        for a, b, new in pairs:
            vocab[new] = vocab[a] + vocab[b]
    return Tokenizer(vocab, [(vocab[a], vocab[b]) for a, b, _ in pairs], list(specials), pairs)


def train_preset(docs: DataFrame, name: str) -> Tokenizer:
    """A tokenizer with the settings of that name."""
    return train(docs, **PRESETS[name])


def apply_merges(s: Column, pairs: Iterable[tuple[int, int, int]]) -> Column:
    """Replaces pairs of symbols in order of rank. Each replacement runs from the left and does not
    overlap. Valid for merges whose operands come before them, as learned here."""
    for a, b, new in pairs:
        s = F.replace(s, F.lit(symbol(a) + symbol(b)), F.lit(symbol(new)))
    return s


def _ids(pair: str) -> tuple[int, int]:
    return symbol_id(pair[0]), symbol_id(pair[1])


def _learn_rounds(words: DataFrame, vocab: dict[int, bytes], vocab_size: int, cut_every: int = 64) -> list[tuple[int, int, int]]:
    """A job a round: words that hold a pair of the batch give up old pairs and gain new ones; the
    sums change the pair counts, which the vocabulary bounds, not the corpus."""
    count = {_ids(r["pair"]): r["c"] for r in pair_counts(words).collect()}
    learned: list[tuple[int, int, int]] = []
    applied = 0
    while len(vocab) < vocab_size and count:
        batch = []
        for a, b in _independent(count, vocab, vocab_size - len(vocab)):
            batch.append((a, b, len(vocab)))
            vocab[len(vocab)] = vocab[a] + vocab[b]
        held = F.lit(False)
        for a, b, _ in batch:
            held = held | F.contains(F.col("s"), F.lit(symbol(a) + symbol(b)))
        touched = words.where(held)
        changes = touched.select("s", (-F.col("n")).alias("n")).union(touched.select(apply_merges(F.col("s"), batch).alias("s"), "n"))
        for r in pair_counts(changes).where("c != 0").collect():
            p = _ids(r["pair"])
            count[p] = count.get(p, 0) + r["c"]
            if count[p] <= 0:
                del count[p]
        learned += batch
        words = words.select(apply_merges(F.col("s"), batch).alias("s"), "n")
        applied += len(batch)
        if applied >= cut_every:
            words, applied = cut_lineage(words), 0
    return learned


def _independent(count: dict[tuple[int, int], int], vocab: dict[int, bytes], most: int) -> list[tuple[int, int]]:
    """Pairs from the top that later merges of the batch can't change or overtake: no symbol in
    common, and each count above every other pair that ends or begins with a taken pair's outer
    symbols, since those bound the counts of new pairs. A pair of one symbol stands alone."""
    top = heapq.nlargest(min(64, most), count, key=lambda p: (count[p], vocab[p[0]], vocab[p[1]]))
    begins: dict[int, int] = {}  # the highest count of a pair that begins with a symbol
    ends: dict[int, int] = {}  # and that ends with it
    for (x, y), c in count.items():
        begins[x], ends[y] = max(c, begins.get(x, 0)), max(c, ends.get(y, 0))
    taken: list[tuple[int, int]] = []
    used: set[int] = set()
    bound = 0
    for a, b in top:
        if taken and (a in used or b in used or a == b or count[a, b] <= bound):
            break
        taken.append((a, b))
        used |= {a, b}
        bound = max(bound, begins.get(b, 0), ends.get(a, 0))  # of (a, b) itself only if a is b, which ends the batch
        if a == b:
            break
    return taken


def segment(words: DataFrame, pairs: Sequence[tuple[int, int, int]]) -> DataFrame:
    """The word table after all merges, in the order learned."""
    return words.select(apply_merges(F.col("s"), pairs).alias("s"), "n")

