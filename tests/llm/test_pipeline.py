"""The pipeline: each stage against a plain version on what the stage before has kept."""

import base64
import random

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from conftest import DATA
from quern.llm import language
from test_operators import checked_packs, plain_components

FOLDER = str(DATA / "sf0.001")


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = spark.createDataFrame(stage(spark, docs, FOLDER).collect(), docs.schema)
        assert docs.columns == columns
        kept = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert kept.items() <= before.items()
        if name == "exact_dedup":
            first = {}
            for i in sorted(before):
                first.setdefault(" ".join(before[i].split()), i)
            assert set(kept) == set(first.values())
        if name == "near_dedup":
            found = plain_components(sorted(before.items()), 5)
            assert set(kept) == {i for i, c in found.items() if i == c}
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    assert {r["doc_id"] for r in rows} == set(kept)
    assert checked_packs(rows, corpus_pipeline.CAPACITY) >= np.ceil(sum(r["length"] for r in rows) / corpus_pipeline.CAPACITY)


def test_an_empty_table(spark, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{FOLDER}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_rows_with_null_and_repeated_ids(spark):
    clean, labels = (spark.read.parquet(f"{DATA / 'sf0.01'}/{t}.parquet") for t in ("documents", "labels"))
    good = [r["text"] for r in clean.join(labels.where("quality = 1"), "doc_id").where("lang = 'en' and n_chars > 2000").orderBy("doc_id").limit(3).collect()]
    a, b, c = good
    junk = "\x01\x02%$#*" * 400
    near = a.replace(a.split()[40], "changed", 1)
    rows = [(None, a), (None, b), (None, b), (7, a), (7, a), (8, c), (8, c.replace(" ", "  ", 1)), (9, near), (None, near), (5, junk), (None, junk), (5, b + " x")]

    def table(kept):
        return spark.createDataFrame([(i, t, "en") for i, t in kept], "doc_id long, text string, lang string")

    def told(stage, kept):
        return sorted(((r["doc_id"], r["text"]) for r in stage(spark, table(kept), str(DATA / "sf0.01")).collect()), key=str)

    both = clean.select("doc_id", "text", "lang").union(table(rows))
    after = corpus_pipeline.quality_stage(spark, both, str(DATA / "sf0.01"))
    assert after.columns == both.columns and after.where(F.col("text") == junk).count() == 0
    assert after.where(F.col("text") == b).count() == both.where(F.col("text") == b).count()
    rows = [r for r in rows if r[1] != junk]
    assert told(corpus_pipeline.exact_stage, rows) in (sorted([(7, a), (None, b), r, (9, near), (5, b + " x")], key=str) for r in ((8, c), (8, c.replace(" ", "  ", 1))))
    assert told(corpus_pipeline.near_stage, rows) in (sorted([(7, a), (5, b + " x"), r], key=str) for r in ((8, c), (8, c.replace(" ", "  ", 1))))


def test_language_stage_rejects_what_is_in_no_language(spark):
    rng = random.Random(3)
    folder = DATA / "sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.select("doc_id", "text", "lang")
    strange = ["Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw", "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar", "Все люди рождаются свободными и равными", "すべての人間は生まれながらにして自由であり"]
    strange += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz     ") for _ in range(n)) for n in (20, 40, 300, 300, 5000)]
    strange += [base64.b64encode(rng.randbytes(n)).decode() for n in (30, 90, 3000)] + [rng.randbytes(60).hex()]
    strange += ["".join(chr(rng.randrange(0x3041, 0x3094)) for _ in range(50)), "".join(chr(rng.randrange(0x430, 0x450)) for _ in range(50))]
    rows = [(10**9 + k, t, "en") for k, t in enumerate(strange)]
    left = corpus_pipeline.language_stage(spark, docs.union(spark.createDataFrame(rows, docs.schema)), str(folder))
    ids = {r["doc_id"] for r in left.collect()}
    clean = {r["doc_id"] for r in docs.join(labels.where("quality = 1"), "doc_id").where("text rlike '[A-Za-z]'").collect()}
    assert len(clean - ids) <= 0.005 * len(clean)
    assert not [t for i, t, _ in rows if i in ids]


def test_language_stage_learns_from_all_documents(spark, monkeypatch):
    """No sample: neither of the documents that a model learns from nor of those that tell what is typical."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(60).select("doc_id", "text", "lang").cache()
    half = language.in_fold(docs, folds=2)
    want = set()
    for own, other in ((docs.where(half), docs.where(~half)), (docs.where(~half), docs.where(half))):
        model = language.fit(other, 10**9)
        want |= {r["doc_id"] for r in language.recognised(own, model, language.typical(own, model)).collect()}
    monkeypatch.setattr(language, "sample", None)
    rows = corpus_pipeline.language_stage(spark, docs, FOLDER)
    assert rows.columns == docs.columns and {r["doc_id"] for r in rows.collect()} == want
