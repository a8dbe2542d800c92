"""Merges learned over shares of a word table: each share is two arrays in one process, the pair counts
are with one of them, and only chosen merges and changed counts travel."""

from __future__ import annotations

import heapq
import secrets
from collections.abc import Iterable, Iterator, Sequence
from multiprocessing.connection import Client, Connection, Listener

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Symbols of a share that are worth a task of their own.
SHARE = 4_000_000
#: Merges of a batch at most.
MOST = 256
#: Pairs that are ordered by count at once; those below their least count wait unordered.
ORDERED = 5_000
#: Pairs that are new since the counts were sorted last.
LATE = 1 << 17

Merge = tuple[int, int, int]
Changes = tuple[np.ndarray, np.ndarray]


def _summed(codes: np.ndarray, n: np.ndarray) -> Changes:
    """Each different code, ascending, with its sum; exact, and without those of sum 0."""
    order = np.argsort(codes, kind="stable")
    codes, n = codes[order], n[order]
    first = np.flatnonzero(np.diff(codes, prepend=-1))
    total = np.add.reduceat(n, first) if len(first) else n[:0]
    return codes[first][total != 0], total[total != 0]


class Share:
    """Words as symbols. A token of k bytes takes k places: ``head`` has its id at the first of them and
    ``tail`` at the last, so its neighbours are found without links, and a merge moves nothing.
    A mark stands before, between and after words."""

    def __init__(self, batches: Iterable[pa.RecordBatch], vocab: dict[int, bytes], vocab_size: int):
        """``batches`` have words as bytes and how often each occurs."""
        self.kind = np.uint16 if vocab_size + 2 < 1 << 16 else np.uint32
        self.mark, self.hole = (np.iinfo(self.kind).max - k for k in (0, 1))
        self.length = np.ones(vocab_size, np.int64)
        self.length[: len(vocab)] = [len(vocab[k]) for k in range(len(vocab))]
        parts, starts, counts, size = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 1
        for batch in batches:
            if not batch.num_rows:
                continue
            word = batch.column(0).cast(pa.large_binary())
            offsets = np.frombuffer(word.buffers()[1], np.int64)[word.offset : word.offset + len(word) + 1]
            raw = np.frombuffer(word.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
            first = offsets[:-1] - offsets[0] + np.arange(len(word))
            part = np.full(len(raw) + len(word), self.mark, self.kind)
            ends = np.zeros(len(part), bool)
            ends[first[1:] - 1] = True
            ends[-1:] = True
            part[~ends] = raw
            parts.append(part)
            starts.append(first + size)
            counts.append(batch.column(1).to_numpy())
            size += len(part)
        self.head = np.concatenate([np.full(1, self.mark, self.kind), *parts])
        self.tail = self.head.copy()
        self.starts, self.counts = np.concatenate(starts), np.concatenate(counts)
        self.none = np.zeros(0, np.int32 if size < 1 << 31 else np.int64)
        found: list[list[np.ndarray]] = [[self.none] for _ in range(256)]
        for low in range(0, size, 1 << 20):
            block = self.head[low : low + (1 << 20)]
            order = np.argsort(block, kind="stable")
            bounds = np.searchsorted(block[order], np.arange(257))
            for k in np.flatnonzero(np.diff(bounds)).tolist():
                found[k].append((order[bounds[k] : bounds[k + 1]] + low).astype(self.none.dtype))
        self.where = {k: np.concatenate(f) for k, f in enumerate(found)}  # places of a symbol, and some that it has lost

    def _sizes(self, ids: np.ndarray) -> np.ndarray:
        return np.where(ids == self.mark, 1, self.length[np.minimum(ids, len(self.length) - 1)])

    def _weights(self, places: np.ndarray) -> np.ndarray:
        return self.counts[np.searchsorted(self.starts, places, side="right") - 1]

    def pairs(self) -> Changes:
        """Counts of all pairs, while each symbol is one byte."""
        found = []
        for low in range(0, len(self.head) - 1, 1 << 20):
            left, right = self.head[low : low + (1 << 20)][: len(self.head) - 1 - low], self.head[low + 1 : low + 1 + (1 << 20)]
            at = np.flatnonzero((left != self.mark) & (right != self.mark))
            found.append(_summed((left[at].astype(np.int64) << 32) + right[at], self._weights(at + low)))
        return _summed(*(np.concatenate([np.zeros(0, np.int64), *(f[k] for f in found)]) for k in (0, 1)))

    def _at(self, places: np.ndarray, weights: np.ndarray) -> Changes:
        """The pairs that start at some places, each place once; marks have none."""
        places, first = np.unique(places, return_index=True)
        left = self.head[places].astype(np.int64)
        right = self.head[np.minimum(places + self._sizes(left), len(self.head) - 1)].astype(np.int64)
        real = (left != self.mark) & (right != self.mark)
        return (left[real] << 32) + right[real], weights[first][real]

    def _places(self, a: int, b: int) -> np.ndarray:
        """Where a pair stands, ascending: looked up by the rarer of its symbols."""
        lefts, rights = self.where.get(a, self.none), self.where.get(b, self.none)
        if len(lefts) <= len(rights):
            i = self.where[a] = lefts[self.head[lefts] == a]
            i = i.astype(np.int64)
            return i[self.head[i + self.length[a]] == b]
        j = self.where[b] = rights[self.head[rights] == b]
        j = j.astype(np.int64)
        return j[self.tail[j - 1] == a] - self.length[a]

    def merge(self, batch: Sequence[Merge]) -> Changes:
        """Applies merges in order and returns how the counts of pairs change."""
        codes, changes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a, b, new in batch:
            self.length[new] = self.length[a] + self.length[b]
            i = self._places(a, b)
            if a == b and len(i):  # of places that overlap, each second one, from the left
                order = np.arange(len(i))
                begin = np.diff(i, prepend=-1 - self.length[a]) != self.length[a]
                i = i[(order - np.maximum.accumulate(np.where(begin, order, 0))) % 2 == 0]
            self.where[new] = i.astype(self.none.dtype)
            if not len(i):
                continue
            weights, j = self._weights(i), i + self.length[a]
            old = self._at(np.concatenate([i - self._sizes(self.tail[i - 1]), i, j]), np.tile(weights, 3))
            self.head[i], self.head[j], self.tail[i + self.length[new] - 1] = new, self.hole, new
            young = self._at(np.concatenate([i - self._sizes(self.tail[i - 1]), i]), np.tile(weights, 2))
            codes += [old[0], young[0]]
            changes += [-old[1], young[1]]
        return _summed(np.concatenate(codes), np.concatenate(changes))


class _Falling:
    """Orders bytes pairs from the greatest down, for a heap."""

    __slots__ = ("pair",)

    def __init__(self, pair: tuple[bytes, bytes]):
        self.pair = pair

    def __lt__(self, other: _Falling) -> bool:
        return self.pair > other.pair


class Chooser:
    """Counts of all pairs, 16 bytes each, and the merges that follow from them."""

    def __init__(self, vocab: dict[int, bytes], vocab_size: int):
        self.vocab, self.vocab_size = dict(vocab), vocab_size
        self.levels = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in range(2)]  # sorted: all but the late pairs, the late ones
        self.floor = np.iinfo(np.int64).max
        self.ordered: dict[int, int] = {}  # the count of each pair that has ``floor`` at least
        self.begin: dict[int, set[int]] = {}  # these pairs by their first symbol
        self.end: dict[int, set[int]] = {}  # and by their last one
        self.queue: list[tuple[int, _Falling, int]] = []

    def add(self, found: Sequence[Changes]) -> None:
        """Adds up the changes of all shares."""
        codes, changes = _summed(*(np.concatenate([f[k] for f in found]) for k in (0, 1)))
        total, rest = np.zeros(len(codes), np.int64), np.arange(len(codes))
        for keys, counts in self.levels:
            at = np.searchsorted(keys, codes[rest])
            held = keys[np.minimum(at, len(keys) - 1)] == codes[rest] if len(keys) else np.zeros(len(rest), bool)
            counts[at[held]] += changes[rest[held]]
            total[rest[held]] = counts[at[held]]
            rest = rest[~held]
        total[rest] = changes[rest]
        (keys, counts), (late, late_counts) = self.levels
        at = np.searchsorted(late, codes[rest])
        late, late_counts = np.insert(late, at, codes[rest]), np.insert(late_counts, at, changes[rest])
        if len(late) > LATE:
            keys, counts = _summed(np.concatenate([keys, late]), np.concatenate([counts, late_counts]))
            late, late_counts = late[:0], late_counts[:0]
        self.levels = [(keys, counts), (late, late_counts)]
        for code in codes[(total < self.floor) & (total - changes >= self.floor)].tolist():
            self._leave(code)
        high = total >= self.floor
        self._order(codes[high], total[high])

    def _order(self, codes: np.ndarray, counts: np.ndarray) -> None:
        for code, n in zip(codes.tolist(), counts.tolist(), strict=True):
            a, b = code >> 32, code & 0xFFFFFFFF
            self.ordered[code] = n
            self.begin.setdefault(a, set()).add(code)
            self.end.setdefault(b, set()).add(code)
            heapq.heappush(self.queue, (-n, _Falling((self.vocab[a], self.vocab[b])), code))

    def _leave(self, code: int) -> None:
        """Takes a pair out of the ordered ones; it may have left as a merge."""
        if self.ordered.pop(code, None) is not None:
            self.begin[code >> 32].discard(code)
            self.end[code & 0xFFFFFFFF].discard(code)

    def _lower(self) -> bool:
        """Orders the next pairs, when all ordered ones are used up."""
        codes, counts = (np.concatenate([level[k] for level in self.levels]) for k in (0, 1))
        codes, counts = codes[counts > 0], counts[counts > 0]
        if not len(codes):
            return False
        self.floor = int(counts.min() if len(counts) <= ORDERED else np.partition(counts, -ORDERED)[-ORDERED])
        self.queue = []
        self._order(codes[counts >= self.floor], counts[counts >= self.floor])
        return True

    def _top(self) -> int | None:
        """The first of the ordered pairs."""
        while self.queue and self.ordered.get(self.queue[0][2]) != -self.queue[0][0]:
            heapq.heappop(self.queue)  # an entry from before a change
        return self.queue[0][2] if self.queue else None

    def batch(self) -> list[Merge]:
        """The next merges, as far as the counts tell them; none at the end.

        Merging (a, b) leaves the pairs alone that neither begin with b nor end with a, and the count of
        a new pair is at most that of a pair that does. So the pairs above all those counts follow in
        order. A pair of one symbol stands alone."""
        out: list[Merge] = []
        lefts: set[int] = set()
        rights: set[int] = set()
        bound = 0
        while len(self.vocab) < self.vocab_size and len(out) < MOST:
            code = self._top()
            if code is None and not out and self._lower():
                code = self._top()
            if code is None:
                break  # after others, the counts of pairs that aren't ordered must be summed first
            a, b = code >> 32, code & 0xFFFFFFFF
            if out and (a in rights or b in lefts or a == b or self.ordered[code] <= bound):
                break
            self._leave(code)
            new = len(self.vocab)
            self.vocab[new] = self.vocab[a] + self.vocab[b]
            out.append((a, b, new))
            lefts.add(a)
            rights.add(b)
            bound = max([bound, *(self.ordered[c] for c in (*self.begin.get(b, ()), *self.end.get(a, ())))])
            if a == b:
                break
        return out


def _words(words: DataFrame) -> DataFrame:
    return words.select(F.encode("s", "ISO-8859-1").alias("word"), F.col("n").cast("long").alias("n"))


def learn_here(words: DataFrame, vocab: dict[int, bytes], vocab_size: int) -> list[Merge]:
    """Merges of a table (s, n) of words that is one share, in this process."""
    share, chooser = Share(_words(words).toArrow().to_batches(), vocab, vocab_size), Chooser(vocab, vocab_size)
    chooser.add([share.pairs()])
    learned: list[Merge] = []
    while batch := chooser.batch():
        learned += batch
        chooser.add([share.merge(batch)])
    return learned


def _heard(message: bytes) -> Changes:
    both = np.frombuffer(message, np.int64)
    return both[: len(both) // 2], both[len(both) // 2 :]


def _joined(task: BarrierTaskContext, key: bytes) -> list[Connection]:
    """Connections of the first task to all others; of each other, to the first. Spark's own gathering
    takes a second each time, so it only tells the port."""
    infos = task.getTaskInfos()
    host = infos[0].address.rpartition(":")[0]
    if task.partitionId():
        return [Client((host, int(task.allGather("")[0])), authkey=key)]
    with Listener((host, 0), backlog=len(infos), authkey=key) as door:
        task.allGather(str(door.address[1]))
        return [door.accept() for _ in infos[1:]]


def learn_spread(words: DataFrame, vocab: dict[int, bytes], vocab_size: int, symbols: int) -> list[Merge]:
    """Merges of a written table (s, n) of words with so many symbols, which tasks share that run together.

    The first task has the pair counts and talks with the others. The driver gets the merges only."""
    tasks = max(1, min(slots(words), -(-symbols // SHARE)))
    key = secrets.token_bytes(32)

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = BarrierTaskContext.get()
        share, merges = Share(batches, vocab, vocab_size), []
        others = _joined(task, key)
        changes = share.pairs()
        if task.partitionId():
            others[0].send_bytes(np.concatenate(changes).tobytes())
            while batch := np.frombuffer(others[0].recv_bytes(), np.int64).reshape(-1, 3).tolist():
                others[0].send_bytes(np.concatenate(share.merge(batch)).tobytes())
        else:
            chooser = Chooser(vocab, vocab_size)
            chooser.add([changes, *(_heard(c.recv_bytes()) for c in others)])
            while batch := chooser.batch():
                for c in others:
                    c.send_bytes(np.array(batch, np.int64).tobytes())
                merges += batch
                changes = share.merge(batch)
                chooser.add([changes, *(_heard(c.recv_bytes()) for c in others)])
            for c in others:
                c.send_bytes(b"")
        for c in others:
            c.close()
        columns = [pa.array([m[k] for m in merges], pa.int32()) for k in range(3)]
        yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "new"])

    found = _words(words).repartition(tasks).mapInArrow(learned, "a int, b int, new int", barrier=True).toArrow()
    return sorted(zip(*(found[n].to_pylist() for n in ("a", "b", "new")), strict=True), key=lambda m: m[2])


def slots(df: DataFrame) -> int:
    """Tasks that can run together; 0 where executors come and go, so that none need."""
    context = df.sparkSession.sparkContext
    if context.getConf().get("spark.dynamicAllocation.enabled", "false") == "true":
        return 0
    jvm = context._jsc.sc()
    return jvm.maxNumConcurrentTasks(jvm.resourceProfileManager().defaultResourceProfile())
