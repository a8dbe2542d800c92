"""Language identification by prediction by partial matching.

For each language, a context tree holds the bytes that followed each context of up to ``ORDER``
bytes in a training sample. A byte costs what PPM (method C, with exclusions) codes it with: from
the longest known context, an escape for each context that hasn't seen it, its share in the first
that has, and an equal share of the unseen bytes below order 0. Statistics are frozen after training,
so a byte's cost depends only on its context and can be tabled: each tree has a row for each of its
contexts and a column for each byte. Scoring a text sums exact code lengths; the shortest code names
the language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.batches import bounded
from quern.sources.shared import spare, written

ORDER = 3
#: Documents of each language that training expects to see: the bound of its sample.
SAMPLE = 1500
#: Languages at most: the driver gets a row, and a model a tree, for each.
MOST_LANGUAGES = 1000
#: A text is foreign if it costs more than so many times its language's typical bits a byte ...
FAR = 2.5
#: ... where each text counts as so many typical bytes longer: a few bytes tell a rate only roughly.
SLACK = 8
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_COUNT = "lang string, gram long, n long"


class Model:
    """Costs in bits. A state is the longest context that some tree has; ``states`` maps the last three
    symbols to it. ``rows[k][state]`` is the row of the k-th language's tree for it, the longest context
    that this tree has, and ``tables[k]`` its costs: rows of ``width`` symbols. Their size follows the
    contexts of the bounded sample, each language's own."""

    def __init__(self, languages: list[str], symbol: np.ndarray, width: int, states: np.ndarray, rows: list[np.ndarray], tables: list[np.ndarray]):
        self.languages, self.symbol, self.width, self.states, self.rows, self.tables = languages, symbol, width, states, rows, tables

    def costs(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each text in each language."""
        sizes = np.array([len(t) for t in texts], np.int64)
        out = np.zeros((len(texts), len(self.languages)))
        gap = b"\n" * ORDER  # each text starts after the same context
        low = 0
        while low < len(texts):
            high, total = low, 0
            while high < len(texts) and (high == low or total + len(texts[high]) < 1 << 20):
                total += len(texts[high])
                high += 1
            raw = np.frombuffer(b"".join(gap + t for t in texts[low:high]), np.uint8)
            for k, bits in _slabs(raw, sizes[low:high], self):
                out[low + k] += bits
            low = high
        return out


def _slabs(raw: np.ndarray, sizes: np.ndarray, model: Model, slab: int = 1 << 20):
    """Sums of costs over slabs of the joined texts, by text."""
    starts, width = np.concatenate([[0], np.cumsum(sizes + ORDER)]), model.width
    for a in range(0, len(raw), slab):
        b = min(len(raw), a + slab)
        lead = min(a, ORDER)
        s = model.symbol[raw[a - lead : b]].astype(np.int64)
        code = np.zeros(len(s), np.int64)
        code[ORDER:] = (s[:-3] * width + s[1:-2]) * width + s[2:-1] if len(s) > ORDER else 0
        state, s = model.states[code][lead:], s[lead:]
        costs = np.empty((len(s), len(model.tables)), np.float32)
        for k, (rows, table) in enumerate(zip(model.rows, model.tables, strict=True)):
            costs[:, k] = table[rows[state] * width + s]
        first = np.searchsorted(starts, a, side="right") - 1
        last = np.searchsorted(starts, b, side="left")
        for k in range(first, last):
            x, y = max(starts[k] + ORDER, a) - a, min(starts[k + 1], b) - a
            if y > x:
                yield k, costs[x:y].sum(axis=0, dtype=np.float64)


def grams(docs: DataFrame) -> DataFrame:
    """(lang, gram, n): every run of ORDER + 1 bytes after ``ORDER`` line feeds at a text's start."""

    def counted(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(source):
            joined: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                joined.setdefault(lang, []).append(text.encode())
            for lang, texts in joined.items():
                codes = []
                for t in texts:
                    raw = np.frombuffer(b"\n" * ORDER + t, np.uint8).astype(np.int64)
                    codes.append((raw[:-3] << 24) + (raw[1:-2] << 16) + (raw[2:-1] << 8) + raw[3:])
                found, n = np.unique(np.concatenate(codes), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found)), pa.array(found), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    return docs.select("lang", "text").mapInArrow(counted, _COUNT).groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _by_language(lang: Column, values: dict[str, float], other: Column) -> Column:
    """The value of a row's language; ``other`` for the rest. One flat expression of as many branches."""
    out = F
    for name, value in values.items():
        out = out.when(lang == name, value)
    return out.otherwise(other) if values else other


def sample(docs: DataFrame, per_language: int = SAMPLE) -> DataFrame:
    """Whole documents with a language, about ``per_language`` of each, by a hash of the doc_id."""
    ready = docs.where("lang is not null and text is not null and doc_id is not null")
    totals = {r["lang"]: r["n"] for r in ready.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(totals) > MOST_LANGUAGES:
        raise ValueError(f"lang has more than {MOST_LANGUAGES} different values")
    share = _by_language(F.col("lang"), {lang: int(min(1.0, per_language / n) * (1 << 20)) for lang, n in totals.items()}, F.lit(0))
    return ready.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share)


def labelled(docs: DataFrame) -> DataFrame:
    """Every document with text and lang."""
    return docs.where("lang is not null and text is not null")


def fit(docs: DataFrame, per_language: int | None = SAMPLE) -> Model | None:
    """A model from documents with text and lang; None if there are none.

    The sample is bounded per language, so the counts that reach the driver are too; with None for
    ``per_language`` all documents count, and what reaches the driver follows the different runs of
    ORDER + 1 bytes. Null texts and languages are left out.
    """
    chosen = labelled(docs) if per_language is None else sample(docs, per_language)
    found = grams(chosen).toArrow()
    if found.num_rows and len(found["lang"].unique()) > MOST_LANGUAGES:
        raise ValueError(f"lang has more than {MOST_LANGUAGES} different values")
    languages = sorted(set(found["lang"].to_pylist()))
    if not languages:
        return None
    place = {x: k for k, x in enumerate(languages)}
    lang = np.array([place[x] for x in found["lang"].to_pylist()])
    gram, n = found["gram"].to_numpy(), found["n"].to_numpy()
    raw = np.stack([gram >> 24, gram >> 16 & 255, gram >> 8 & 255, gram & 255])
    seen = np.unique(raw)
    symbol = np.zeros(256, np.int64)  # 0: any byte that training hasn't seen
    symbol[seen] = np.arange(1, len(seen) + 1)
    width = len(seen) + 1
    s = symbol[raw]
    suffix = [np.zeros_like(s[0]), s[2], s[1] * width + s[2], (s[0] * width + s[1]) * width + s[2]]  # contexts of order 0 to 3 as numbers
    every = [np.unique(c) for c in suffix]
    offsets = np.cumsum([0, *map(len, every)])
    rows, tables = [], []
    for k in range(len(languages)):
        mine = lang == k
        grown = [np.unique(c[mine]) for c in suffix]
        starts = np.cumsum([0, *map(len, grown)])
        table = np.zeros((starts[-1], width), np.float32)
        _tree(table, grown, starts, [c[mine] for c in suffix], s[3][mine], n[mine].astype(np.float64), width)
        tables.append(table.ravel())
        row = np.zeros(offsets[-1], np.int64)
        for order in range(1, ORDER + 1):
            own, shorter = np.searchsorted(grown[order], every[order]), np.searchsorted(every[order - 1], every[order] % width ** (order - 1))
            held = grown[order][np.minimum(own, len(grown[order]) - 1)] == every[order]
            row[offsets[order] : offsets[order + 1]] = np.where(held, starts[order] + own, row[offsets[order - 1] + shorter])
        rows.append(row)
    states = np.zeros(width**ORDER, np.int32)
    contexts = np.arange(width**ORDER)
    for order in range(1, ORDER + 1):
        code = contexts % width**order
        at = np.minimum(np.searchsorted(every[order], code), len(every[order]) - 1)
        hit = every[order][at] == code
        states[hit] = offsets[order] + at[hit]
    return Model(languages, symbol, width, states, rows, tables)


def _tree(out: np.ndarray, grown: list[np.ndarray], offsets: np.ndarray, suffix: list[np.ndarray], symbol: np.ndarray, n: np.ndarray, width: int) -> None:
    """Fills one language's costs for every context and symbol."""
    counts = []
    for order, codes in enumerate(grown):
        dense = np.zeros((len(codes), width))
        at = np.minimum(np.searchsorted(codes, suffix[order]), max(0, len(codes) - 1))
        hit = codes[at] == suffix[order] if len(codes) else np.zeros(len(symbol), bool)
        np.add.at(dense, (at[hit], symbol[hit]), n[hit])
        counts.append(dense)
    unseen = 256 - (width - 1)  # bytes that share symbol 0
    for order, codes in enumerate(grown):
        for low in range(0, len(codes), 4096):
            block = codes[low : low + 4096]
            bits = np.zeros((len(block), width))
            open_ = np.ones((len(block), width), bool)  # not yet coded nor excluded
            spent = np.zeros(len(block))
            for level in range(order, -1, -1):
                at = np.searchsorted(grown[level], block % width**level)
                here = counts[level][at] * open_
                total, kinds = here.sum(axis=1), (here > 0).sum(axis=1)
                used = total > 0  # a context that is new to this language, or wholly excluded, costs nothing
                base = np.where(used, total + kinds, 1.0)
                coded = here > 0
                bits[coded] = (spent[:, None] + np.log2(base)[:, None] - np.log2(np.where(coded, here, 1.0)))[coded]
                spent += np.where(used, np.log2(base) - np.log2(np.where(used, kinds, 1.0)), 0.0)
                open_ &= ~coded
            rest = open_[:, 1:].sum(axis=1) + unseen
            bits[open_] = (spent + np.log2(np.maximum(rest, 1)))[:, None].repeat(width, axis=1)[open_]
            out[offsets[order] + low : offsets[order] + low + len(block)] = bits


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """(…, lang_pred, score): the language of every whole text of ``docs``, beside its columns.
    The score compares languages with each other; ``recognised`` leaves out texts that are in none of them.

    A text that is null or has no letter is ``und`` with score 0, and so is every text without a
    model. The score is the share of the best language if all are equally likely beforehand; ties go
    to the language that sorts first. Columns of those names in ``docs`` are replaced.
    """
    plain = docs.drop("lang_pred", "score")
    return _told(plain, model, ("lang_pred", "score", spare("bits", plain.columns))).select(*(f"`{c}`" for c in plain.columns), "lang_pred", "score")


def _told(docs: DataFrame, model: Model | None, new: tuple[str, str, str]) -> DataFrame:
    """Beside the columns of ``docs``, what ``identify`` says and the text's code length in that
    language, under three names that the columns don't have."""
    names = docs.columns
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)  # bounded by the sample of each language

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned = held.value
        for batch in bounded(source):
            texts = batch.column(names.index("text")).to_pylist()
            asked = [k for k, t in enumerate(texts) if t and learned and _LETTER.search(t)]
            pred, score, least = [UNKNOWN] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
            if asked:
                bits = learned.costs([texts[k].encode() for k in asked])
                best = bits.argmin(axis=1)
                odds = np.exp2(np.maximum(bits.min(axis=1)[:, None] - bits, -1000.0)).sum(axis=1)
                for k, b, o, m in zip(asked, best.tolist(), odds.tolist(), bits.min(axis=1).tolist(), strict=True):
                    pred[k], score[k], least[k] = learned.languages[b], 1.0 / o, m
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred), pa.array(score), pa.array(least)], names=[*names, *new])

    kinds = "".join(f"`{n}` {t}, " for n, t in docs.dtypes)
    return docs.mapInArrow(batches, f"{kinds}`{new[0]}` string, `{new[1]}` double, `{new[2]}` double")


def typical(docs: DataFrame, model: Model | None) -> dict[str, float]:
    """Median bits a byte of each language's held-out texts, all of them, as the model names it. A median stands
    while fewer than half of a language's texts are junk."""
    new = ("lang_pred", "score", "bits")
    return _medians(_told(labelled(docs).select("text"), model, new), new)


def _medians(told: DataFrame, new: tuple[str, str, str]) -> dict[str, float]:
    named_as, _, bits = (F.col(n) for n in new)
    rates = told.where(named_as != UNKNOWN).groupBy(named_as.alias("k")).agg(F.percentile_approx(bits / F.octet_length("text"), 0.5, 10_000).alias("m"))
    return {r["k"]: r["m"] for r in rates.collect()}  # a row for each language


def recognised(docs: DataFrame, model: Model | None, rates: dict[str, float], score: float = 0.5) -> DataFrame:
    """The rows of ``docs`` in a language that the model knows: named with at least ``score``, and not
    ``FAR`` from that language's typical bits a byte. A language without held-out texts has the mean
    of the others; without any, texts are not called far."""
    new = _new(docs)
    return _near(_told(docs, model, new), new, rates, score)


def known(docs: DataFrame, model: Model | None, score: float = 0.5) -> DataFrame:
    """As ``recognised`` with what is ``typical`` of ``docs`` themselves; each text is coded once."""
    new = _new(docs)
    told = written(_told(docs, model, new), "told")
    return _near(told, new, _medians(labelled(told), new), score)


def _new(docs: DataFrame) -> tuple[str, str, str]:
    return tuple(spare(n, docs.columns) for n in ("lang_pred", "score", "bits"))


def _near(told: DataFrame, new: tuple[str, str, str], rates: dict[str, float], score: float) -> DataFrame:
    named_as, sure, bits = map(F.col, new)
    usual = _by_language(named_as, rates, F.lit(sum(rates.values()) / len(rates) if rates else None).cast("double"))
    size = F.octet_length("text")
    near = F.coalesce(bits + SLACK * usual <= FAR * usual * (size + SLACK), F.lit(True))
    return told.where((named_as != UNKNOWN) & (sure >= score) & near).select(*(f"`{c}`" for c in told.columns if c not in new))


def in_fold(docs: DataFrame, folds: int) -> Column:
    """Whether the checksum of the doc_id is divisible by ``folds``. A null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(docs["doc_id"].cast("string"), F.lit(""))) % folds == 0


def held_out(docs: DataFrame, folds: int = 5) -> DataFrame:
    """``docs`` with held_out, as ``in_fold`` says."""
    return docs.withColumn("held_out", in_fold(docs, folds))
