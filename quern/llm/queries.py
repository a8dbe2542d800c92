"""The operators' queries over whole tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import bpe, exact_dedup, language, licenses, near_dedup, packing, quality, token_store, topk, urls
from quern.sources.corpus import spread
from quern.sources.shared import shared_path

#: Tokenizer files, by name in their folder.
LIBRARY_FILE, RANK_FILE = "byte_bpe_50k.json", "byte_bpe_multi_50k.tiktoken"
END_OF_STORE, END_OF_PACK, CAPACITY = 2, 0, 2048


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def spread_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, over all cores where the table has fewer splits."""
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(spread_documents(spark, sf_dir))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), urls.train(urls.labelled(spark)))


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "store")
    token_store.write(spread_documents(spark, sf_dir), path, tokenizer_path(LIBRARY_FILE), END_OF_STORE)
    return token_store.digests(spark, path)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = language.held_out(spread_documents(spark, sf_dir))
    model = language.fit(docs.where("not held_out"))
    return language.identify(docs.select("doc_id", "text", "held_out"), model).select("doc_id", "held_out", "lang_pred", "score")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(spread_documents(spark, sf_dir), tokenizer_path(RANK_FILE), public_tokenizers.PATTERN)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.cut(spread_documents(spark, sf_dir), tokenizer_path(LIBRARY_FILE), END_OF_PACK, CAPACITY), CAPACITY)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(spread_documents(spark, sf_dir))


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(spread_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.components(spread_documents(spark, sf_dir), words=2)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_license_scan, op2_url_filter, op3_token_store, op4_language_id, op5_byte_bpe, op6_best_fit_packing, op7_exact_dedup, op8_exact_topk, op9_quality, op10_near_dedup,
)}

SQL: dict[str, str] = {
    "op1_license_scan": licenses.SQL,
    "op7_exact_dedup": """with d as (select doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') t from documents)
select doc_id, min(doc_id) over w keep_id, count(*) over w group_size, doc_id = min(doc_id) over w kept, sha256(t) text_sha256 from d window w as (partition by t)""",
    "op8_exact_topk": """with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) v, len(embedding) n from embeddings
where embedding is not null and vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select distinct q.vec_id query_id, c.vec_id, coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])), 0)::bigint score from v q join v c on q.n = c.n and q.vec_id <> c.vec_id where q.vec_id % 20 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 20""",
    "op10_near_dedup": """with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x != '') a from documents),
g as (select doc_id, case when len(a) = 0 then [] when len(a) = 1 then a else list_distinct(list_transform(range(1, len(a)), lambda i: a[i] || ' ' || a[i + 1])) end s from w),
e as (select doc_id, len(s) n, unnest(s) x from g),
p as (select a.doc_id a, b.doc_id b from e a join e b on a.x = b.x and a.doc_id < b.doc_id and least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 80
group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
l as (select a, b from p union all select b, a from p),
c(v, r) as (select doc_id, doc_id from g union select l.b, c.r from c join l on l.a = c.v where c.r < l.b)
select g.doc_id, len(s)::bigint n_shingles, min(r) component_id, g.doc_id = min(r) kept from g join c on c.v = g.doc_id group by g.doc_id, len(s)""",
}
