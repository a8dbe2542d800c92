"""Whole-text encoding by pieces, with a memory of pieces that is bounded in bytes.

In the pattern of byte-level tokenizers a token never spans a space that text follows: the space
begins a token. Nor does one span a line end between two visible characters. So a text is cut before
each such space and around each such line end, each different piece of a group of texts is encoded
once, and the ids of a text are those of its pieces in order. Cutting, looking up and putting
together are column operations; no string of a piece becomes an object of its own. Texts in which a
space or line end has a neighbour that is white or a control character, and texts that hold a
special token, are encoded whole, without cuts.
"""

from __future__ import annotations

import gc
import os
import unicodedata
from collections.abc import Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quern.llm.batches import kept

#: Bytes of pieces and their ids that a worker remembers; beyond it, it forgets all of them.
REMEMBERED_BYTES = 24 << 20
#: Longer pieces are not remembered.
LONGEST = 64
#: Bytes of text that are cut and looked up together, unless one text has more.
GROUP_BYTES = 8 << 20
#: Pieces that go to the tokenizer in one string.
JOINED = 4096
#: Marks after words, and words in letters that every table of Unicode knows.
MARKS = ".,;:!?"
WORD = r"^\x00?[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}]+$"
#: Stands before a piece that no space precedes; texts that hold this character are encoded whole.
OPENING = "\0"


class Tokens(Protocol):
    """What encodes pieces. ``opens`` says of each id whether its token begins with a space,
    ``newline`` is the id of a line end, ``specials`` are strings that must not be cut."""

    opens: np.ndarray
    newline: int
    specials: list[str]

    def ids(self, text: str) -> np.ndarray: ...


def _odd(pieces: pa.Array) -> np.ndarray:
    """Whether a cut before each piece could be wrong."""
    body = pc.utf8_ltrim(pieces, OPENING)
    first = pc.utf8_slice_codeunits(body, 0, 1).dictionary_encode()
    white = np.array([not c or (not "!" <= c <= "~" and unicodedata.category(c)[0] in "ZC") for c in first.dictionary.to_pylist()], bool)
    return white[first.indices.to_numpy()] & ~pc.equal(pieces, "\n").to_numpy(zero_copy_only=False)


def _gathered(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of a pool one after another, and where each ends."""
    ends = np.cumsum(lengths)
    places = np.repeat(starts - (ends - lengths), lengths)
    places += np.arange(len(places))
    return pool[places], ends


class PieceMemory:
    """Ids of whole texts as little-endian unsigned 32-bit integers."""

    def __init__(self, tokens: Tokens, most: int = REMEMBERED_BYTES):
        self.tokens, self.most = tokens, most
        self.marks = np.array([tokens.ids(m)[0] for m in MARKS], "<u4")
        self.forget()

    def forget(self) -> None:
        self.known = pa.array([], pa.string())
        self.starts = self.lengths = np.zeros(0, np.int32)
        self.pool = np.zeros(0, "<u4")

    def texts(self, texts: pa.Array | Sequence[str | None]) -> list[bytes]:
        """Ids of each text; null counts as empty."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        column = pc.fill_null(column, "")
        sizes = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False), dtype=np.int64)
        out, at, collects = [], 0, gc.isenabled()
        gc.disable()  # strings and bytes form no cycles, and passing over many of them takes long
        try:
            while at < len(column):
                end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + GROUP_BYTES, side="right")))
                out += self._group(column.slice(at, end - at))
                at = end
        finally:
            if collects:
                gc.enable()
        return out

    def _group(self, column: pa.Array) -> list[bytes]:
        """Each different piece is looked up once; the ids are then put together by index."""
        whole = np.zeros(len(column), bool)
        for mark in (OPENING, *self.tokens.specials):
            whole |= pc.match_substring(column, mark).to_numpy(zero_copy_only=False)
        split = pc.split_pattern(pc.binary_join_element_wise(OPENING, pc.replace_substring(column, "\n", f" \n {OPENING}"), ""), " ")
        offsets = split.offsets.to_numpy()
        offsets = offsets - offsets[0]
        coded = split.flatten().dictionary_encode()
        pieces, codes = coded.dictionary, coded.indices.to_numpy()
        odd = _odd(pieces)
        if odd.any():
            hits = np.flatnonzero(odd[codes])
            whole[np.searchsorted(offsets, hits, side="right") - 1] = True
        starts, lengths, pool = self._parted(pieces, odd)
        ids, ends = _gathered(pool, starts[codes], lengths[codes])
        data = memoryview(ids).cast("B")
        bounds = np.concatenate([[0], ends])[offsets] * 4
        out = [bytes(data[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        for k in np.flatnonzero(whole).tolist():
            text = column[k].as_py()
            out[k] = self.tokens.ids(text).astype("<u4").tobytes() if text else b""
        return out

    def _parted(self, pieces: pa.Array, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``_found``, but a word and the one mark after it are looked up apart: no token spans both."""
        words = pc.utf8_rtrim(pieces, MARKS)
        marked = (pc.subtract(pc.binary_length(pieces), pc.binary_length(words)).to_numpy(zero_copy_only=False) == 1) & pc.match_substring_regex(words, WORD).to_numpy(zero_copy_only=False)
        coded = pc.if_else(pa.array(marked), words, pieces).dictionary_encode()
        codes = coded.indices.to_numpy()
        strange = np.zeros(len(coded.dictionary), bool)
        strange[codes[odd]] = True
        starts, lengths, pool = self._found(coded.dictionary, strange)
        last = pc.utf8_slice_codeunits(pieces.take(pa.array(np.flatnonzero(marked))), -1)
        ends = np.zeros(len(pieces), np.int64)
        ends[marked] = pc.index_in(last, value_set=pa.array(list(MARKS))).to_numpy(zero_copy_only=False)
        runs = np.stack([starts[codes], len(pool) + ends], axis=1).ravel()
        sizes = np.stack([lengths[codes], marked], axis=1).ravel()
        ids, bounds = _gathered(np.concatenate([pool, self.marks]), runs, sizes)
        lengths = lengths[codes] + marked
        return bounds[1::2] - lengths, lengths, ids

    def _found(self, pieces: pa.Array, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and number of the ids of each piece in a pool; odd pieces have none."""
        at = pc.fill_null(pc.index_in(pieces, value_set=self.known), -1).to_numpy(zero_copy_only=False)
        starts, lengths = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        old = at >= 0
        starts[old], lengths[old] = self.starts[at[old]], self.lengths[at[old]]
        new = np.flatnonzero(~old & ~odd)
        opening = pc.starts_with(pieces.take(pa.array(new)), OPENING).to_numpy(zero_copy_only=False)
        line_end = pc.equal(pieces.take(pa.array(new)), "\n").to_numpy(zero_copy_only=False)
        pools, held = [self.pool], len(self.pool)
        for mine, mark in ((new[~opening & ~line_end], " "), (new[opening], "\n")):
            for low in range(0, len(mine), JOINED):
                part = mine[low : low + JOINED]
                ids, cuts = self._encoded(pieces.take(pa.array(part)), mark)
                starts[part], lengths[part] = held + cuts[:, 0], cuts[:, 1] - cuts[:, 0]
                pools.append(ids)
                held += len(ids)
        if line_end.any():
            starts[new[line_end]], lengths[new[line_end]] = held, 1
            pools.append(np.array([self.tokens.newline], "<u4"))
        pool = np.concatenate(pools)
        self._remember(pieces, new, starts, lengths, pool)
        return starts, lengths, pool

    def _encoded(self, pieces: pa.Array, mark: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces joined by a mark, and the bounds of each piece's own."""
        listed = pc.utf8_ltrim(pieces, OPENING).to_pylist()
        ids = self.tokens.ids(mark + mark.join(listed) if mark == " " else mark.join(listed))
        if mark == " ":
            begins = np.flatnonzero(self.tokens.opens[ids])
            cuts = np.stack([begins, np.append(begins[1:], len(ids))], axis=1)
        else:
            ends = np.append(np.flatnonzero(ids == self.tokens.newline), len(ids))
            cuts = np.stack([np.append(0, ends[:-1] + 1), ends], axis=1)
        if len(cuts) == len(listed):
            return ids, cuts
        each = [self.tokens.ids((mark if mark == " " else "") + p) for p in listed]  # a special token among them
        ends = np.cumsum([len(x) for x in each])
        return np.concatenate(each), np.stack([ends - [len(x) for x in each], ends], axis=1)

    def _remember(self, pieces: pa.Array, new: np.ndarray, starts: np.ndarray, lengths: np.ndarray, pool: np.ndarray) -> None:
        short = new[pc.binary_length(pieces.take(pa.array(new))).to_numpy(zero_copy_only=False) <= LONGEST]
        fresh = pieces.take(pa.array(short))
        ids, ends = _gathered(pool, starts[short], lengths[short])
        if self.known.nbytes + self.pool.nbytes + self.starts.nbytes * 2 + fresh.nbytes + ids.nbytes > self.most:
            self.forget()
        self.known = pa.concat_arrays([self.known, fresh])
        self.starts = np.concatenate([self.starts, (len(self.pool) + ends - lengths[short]).astype(np.int32)])
        self.lengths = np.concatenate([self.lengths, lengths[short].astype(np.int32)])
        self.pool = np.concatenate([self.pool, ids])


class LibraryTokens:
    """The tokenizers library, with its own treatment of special tokens."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        tokens = [self.tokenizer.id_to_token(k) or "" for k in range(self.tokenizer.get_vocab_size())]
        self.opens = np.array([t.startswith("Ġ") for t in tokens], bool)  # as such files write a space
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.newline = int(self.ids("\n")[0])

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")


MEMORIES: dict[str, PieceMemory] = kept()


def memory_of(path: str) -> PieceMemory:
    """The worker's memory for a tokenizer file, bounded by ``REMEMBERED_BYTES``. A task that asks for it uses ``MEMORIES``."""
    if path not in MEMORIES:
        MEMORIES[path] = PieceMemory(LibraryTokens(path))
    return MEMORIES[path]
