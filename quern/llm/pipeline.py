"""A training corpus from raw documents: five stages, each written and read again."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import exact_dedup, language, near_dedup, packing, quality
from quern.llm.queries import CAPACITY, END_OF_PACK, LIBRARY_FILE, spread_documents, tokenizer_path
from quern.sources.shared import if_few, keyed, made, release, shared_path, spare, written


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows with a number of their own, and the name of its column, which is none of theirs."""
    row = spare("row", docs.columns)
    return keyed(docs, row), row


def _without(rows: DataFrame, gone: DataFrame, row: str) -> DataFrame:
    """The rows whose own number is not among those that go, without it."""
    gone = written(gone.select(row), "gone")
    return rows.join(if_few(gone), row, "left_anti").select(*(f"`{c}`" for c in rows.columns if c != row))


_left: list[str] = []


def _stage(body: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that first deletes the tables that the stage called before it has left: its result has
    been written and is read again by now. If ``docs`` is that result itself, they stay."""

    @functools.wraps(body)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        files = docs.inputFiles() if _left else []
        if not any(p.rpartition("/")[2] in f for p in _left for f in files):
            release(spark, _left)
        before = set(made())
        out = body(spark, docs, sf_dir)
        _left[:] = [p for p in made() if p not in before]
        return out

    return stage


@_stage
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose perplexity lies outside their language's quantiles."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows, row = _numbered(docs)
    return _without(rows, quality.judged(rows, labels, carried=(row,)).where("not kept"), row)


@_stage
def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a recognisable language: ``und``, a score below one half, or a code too
    long for a text in the language named, measured by documents that the model hasn't seen. Two halves
    train a model each, from all its documents, which judges the other half: no text is judged by a model
    that has learned it. What is typical is measured over all of the half that is judged."""
    half = language.in_fold(docs, folds=2)
    parts = []
    for own, other in ((docs.where(half), docs.where(~half)), (docs.where(~half), docs.where(half))):
        model = language.fit(other, None) or language.fit(own, None)
        parts.append(language.known(own, model))
    return parts[0].unionAll(parts[1])


@_stage
def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays: the smallest doc_id, null last."""
    rows, row = _numbered(docs)
    ids = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", row)
    gone = exact_dedup.exact_dedup(rows.select(ids.alias("doc_id"), "text")).where("not kept")
    return _without(rows, gone.select(f"doc_id.{row}"), row)


@_stage
def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near duplicates stays: shingles of five words, 0.8."""
    return near_dedup.near_dedup(docs, words=5, percent=80)


@_stage
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most ``CAPACITY`` tokens."""
    return packing.pack(packing.cut(docs, tokenizer_path(LIBRARY_FILE), END_OF_PACK, CAPACITY), CAPACITY)


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("packing", packing_stage),
]

#: No SQL: models and a tokenizer decide. The tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each reads what the one before has written."""
    docs, read = spread_documents(spark, sf_dir), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = shared_path(spark, f"stage-{name}")
            docs.write.parquet(path)
            release(spark, [read] if read else [])
            docs, read = spark.read.parquet(path), path
    return docs
