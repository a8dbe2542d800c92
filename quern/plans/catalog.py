"""The named queries over the driver's tables. Each takes a session and a folder of Parquet tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import network, tensor
from quern.functions.text import END_OF_TEXT, split_specials, symbol_ids
from quern.operators import arrays, codec, counting, metrics, optimiser, sampling, train
from quern.sources import corpus, tokenizer_files
from quern.sources.shared import shared_path
from quern.streaming import encode as stream

#: Merges learned by the queries; the SQL of the oracle learns as many.
MERGES = 12
FEW_MERGES = 4
#: Size of the vocabulary of the queries that encode with a long list of merges.
LARGE = 1500
BATCH = 32
#: The small language model: layers, heads, the base of its rotary places, places of a window.
LAYERS, HEADS, THETA, WINDOW = 2, 2, 10_000.0, 64
SAMPLE, SEED = 50, 336
CHUNKS, CONTEXT = 16, 8
RATES = {"highest": 1.0, "lowest": 0.1, "warm_up": 7, "cycle": 21}

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, over all cores where it has few splits."""
    return corpus.spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def learned(docs: DataFrame, k: int = MERGES) -> train.Tokenizer:
    return train.train(docs, 256 + k)


def pretoken_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.pretoken_stream(table(spark, sf_dir, "documents"))


def pretoken_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.pretoken_counts(table(spark, sf_dir, "documents"))


def special_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with a delimiter spliced in after each line, cut at it, with the delimiters kept."""
    texts = table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit(END_OF_TEXT)).alias("text"))
    return texts.select("doc_id", F.posexplode(split_specials(F.col("text"), [END_OF_TEXT], keep=True)).alias("pos", "part"))


def corpus_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delimited texts cut back into documents, empty ones dropped, as sampling does."""
    texts = table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit(END_OF_TEXT)).alias("text"))
    return corpus.split_corpus(texts, "doc_id", drop_empty=True).select("doc_id", "text")


def byte_pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.hex_pairs(counting.pair_counts(counting.word_table(pretoken_counts(spark, sf_dir))))


def best_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.best_pair(byte_pair_counts(spark, sf_dir))


def inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(left, right, n_places): in how many places of distinct words a pair stands."""
    words = counting.word_table(pretoken_counts(spark, sf_dir))
    return counting.hex_pairs(counting.pair_counts(words.select("s", F.lit(1).alias("n")))).select("left", "right", F.col("c").alias("n_places"))


def bpe_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = learned(table(spark, sf_dir, "documents"))
    rows = [(k + 1, a.hex().upper(), b.hex().upper()) for k, (a, b) in enumerate(found.merges)]
    return spark.createDataFrame(rows, "it int, l string, r string")


def bpe_merges_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same merges, learned on the driver from the distinct words; from many, by tasks that run together."""
    found = train.train(table(spark, sf_dir, "documents"), 256 + MERGES, strategy="local")
    rows = [(k + 1, a.hex().upper(), b.hex().upper()) for k, (a, b) in enumerate(found.merges)]
    return spark.createDataFrame(rows, "it int, l string, r string")


def bpe_merges_500(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All merges up to a vocabulary of 500 with one special token, over the benchmark items."""
    found = train.train(table(spark, sf_dir, "benchmark"), 500, [END_OF_TEXT], strategy="local")
    rows = [(k + 1, a.hex().upper(), b.hex().upper()) for k, (a, b) in enumerate(found.merges)]
    return spark.createDataFrame(rows, "it int, l string, r string")


def files_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary after it was written as files, found behind a path that isn't there, and read with a special token."""
    folder = shared_path(spark, "tokenizer")
    tokenizer_files.save_tokenizer(spark, learned(table(spark, sf_dir, "documents")), folder)
    found = [tokenizer_files.first_present(spark, [f"{folder}/older-{n}", f"{folder}/{n}"]) for n in ("vocab.json", "merges.txt")]
    back = tokenizer_files.load_tokenizer(spark, *found, [END_OF_TEXT])
    ranks = spark.createDataFrame([(back.ids[a + b], k) for k, (a, b) in enumerate(back.merges)], "token_id int, rank int")
    return codec.vocab_frame(spark, back).select("token_id", F.hex("token").alias("token")).join(ranks, "token_id", "left")


def stream_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that arrive as files, encoded as a stream."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found, folder = learned(docs), shared_path(spark, "arrived")
    docs.write.parquet(f"{folder}/in")
    texts = stream.read_texts(spark, f"{folder}/in", docs.schema, 4)
    stream.run_available(stream.encode_stream(texts, found), f"{folder}/out", f"{folder}/progress")
    ids = codec.held(spark.read.parquet(f"{folder}/out"), "_ids", F.col("ids"))
    return ids.select("doc_id", F.size("_ids").cast("long").alias("n_tokens"), F.md5(_told(F.col("_ids"))).alias("ids_md5"))


def metrics_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The figures of ``training_metrics``, written and read as JSON."""
    record, path = training_metrics(spark, sf_dir), shared_path(spark, "metrics")
    tokenizer_files.save_record(record, path)
    return spark.read.schema(record.schema).json(path)


def summary_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``tokenization_summary``, written and read as JSON."""
    record, path = tokenization_summary(spark, sf_dir), shared_path(spark, "summary")
    tokenizer_files.save_record(record, path)
    return spark.read.schema(record.schema).json(path)


def tokens_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytes of the benchmark items as a token array on files, its length checked, as runs of 16 places."""
    items, path = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text"), shared_path(spark, "tokens")
    expected = items.agg(F.sum(F.octet_length("text") + 1).alias("n")).first()["n"]
    tokenizer_files.save_tokens(arrays.checked_uint16(arrays.token_array(items, train.Tokenizer(train.base_vocab([]), [], [], []), 256)), path, expected)
    run = F.floor(F.col("pos") / 16).alias("run")
    return spark.read.parquet(path).groupBy(run).agg(F.sum("token_id").alias("total"), F.count("*").alias("n"))


def whole_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item written as a file of its own, read whole and by a range of bytes."""
    path = shared_path(spark, "files")
    items = table(spark, sf_dir, "benchmark").select(F.replace("text", F.lit("\n"), F.lit("\r")).alias("value"), "item_id")
    items.repartition("item_id").write.partitionBy("item_id").text(path)
    at = F.regexp_extract("file", r"item_id=(\d+)/", 1).cast("long").alias("item_id")
    part = corpus.read_range(spark, f"{path}/*/*.txt", 3, 20).select(at, F.col("text").alias("part"))
    return corpus.read_whole(spark, f"{path}/*/*.txt").select(at, "text").join(part, "item_id")


def pair_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inverted index: each pair of bytes with every word that holds it."""
    words = counting.word_table(pretoken_counts(spark, sf_dir))
    pair = F.hex(F.encode("pair", "ISO-8859-1"))
    return counting.pair_index(words).select(pair.alias("pair"), F.hex(F.encode("s", "ISO-8859-1")).alias("word"))


def special_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pre-token counts of delimited texts, whose delimiters separate and aren't counted."""
    texts = table(spark, sf_dir, "documents").select(F.replace("text", F.lit("\n"), F.lit(END_OF_TEXT)).alias("text"))
    return counting.pretoken_counts(texts, [END_OF_TEXT])


def _large(spark: SparkSession, sf_dir: str) -> train.Tokenizer:
    """A vocabulary of ``LARGE`` from the benchmark items, with two special tokens, one in the other."""
    found = train.train(table(spark, sf_dir, "benchmark"), LARGE, strategy="local")
    return codec.with_specials(found, [END_OF_TEXT, END_OF_TEXT * 2])


def _delimited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit(END_OF_TEXT * 2)).alias("text"))


def bpe_encode_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with special tokens, by a long list of merges in Arrow batches."""
    ids = codec.held(codec.encode(_delimited(spark, sf_dir), _large(spark, sf_dir)), "_ids", F.col("ids"))
    return ids.select("doc_id", F.size("_ids").cast("long").alias("n_tokens"), F.md5(_told(F.col("_ids"))).alias("ids_md5"))


def bpe_roundtrip_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _large(spark, sf_dir)
    return codec.decode(codec.encode(_delimited(spark, sf_dir), found), found)


def training_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: sizes of the vocabulary and the corpus, the longest token."""
    docs = table(spark, sf_dir, "documents")
    found = learned(docs)
    longest = metrics.longest_tokens(codec.vocab_frame(spark, found), 1).select(F.col("token").alias("longest_token"), F.col("n_bytes").alias("longest_bytes"))
    sizes = docs.agg(F.count("*").alias("n_docs"), F.sum(F.octet_length("text")).alias("input_bytes"))
    return sizes.select(F.lit(len(found.vocab)).alias("vocab_size"), F.lit(len(found.merges)).alias("n_merges"), "n_docs", "input_bytes").crossJoin(F.broadcast(longest))  # one row each


def decode_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """40 bytes of each document from byte 5 on, as text: parts of characters at both ends go."""
    raw = F.substring(F.encode("text", "UTF-8"), 6, 40)
    return table(spark, sf_dir, "documents").select("doc_id", corpus.decoded(raw, "ignore").alias("part"))


def lm_drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of windows over the bytes of all documents, drawn by hash order."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = arrays.sample_windows(codec.encode(docs, train.Tokenizer(train.base_vocab([]), [], [], [])), CONTEXT, BATCH, SEED)
    joined = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), " ")
    return cut.select("doc_id", F.col("start").cast("long").alias("start"), joined("x").alias("x"), joined("y").alias("y"))


def bpe_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = train.train(table(spark, sf_dir, "documents"), 257 + MERGES, [END_OF_TEXT])
    return codec.vocab_frame(spark, found).select("token_id", F.hex("token").alias("token"))


def _told(ids: Column) -> Column:
    return F.array_join(ids.cast("array<string>"), " ")


def bpe_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct pre-tokens in their final segments, as ids."""
    docs = table(spark, sf_dir, "documents")
    found = learned(docs)
    words = train.segment(counting.word_table(counting.pretoken_counts(docs)), found.pairs)
    return codec.held(words, "t", F.col("s")).select(_told(symbol_ids(F.col("t"))).alias("ids"), "n")


def bpe_encode_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = codec.held(codec.encode(docs, learned(docs)), "_ids", F.col("ids"))
    return ids.select("doc_id", F.size("_ids").cast("long").alias("n_tokens"), F.md5(_told(F.col("_ids"))).alias("ids_md5"))


def bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = learned(docs)
    return codec.decode(codec.encode(docs, found).select("doc_id", "ids"), found)


def decode_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each key an id of its own, an unknown one, one that isn't UTF-8, and a last."""
    own = (F.col("n_nationkey") + 65).cast("int")
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("doc_id"), F.array(own, F.lit(99_999), F.lit(195), F.lit(66)).alias("ids"))
    return codec.decode(rows, train.Tokenizer(train.base_vocab([]), []))


def _lengths(docs: DataFrame, found: train.Tokenizer, *keep: str) -> DataFrame:
    return docs.select(*keep, "text", _count(found).alias("n_tokens"))


def compression_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sums = metrics.compression(_lengths(docs, learned(docs), "lang"), "lang")
    return sums.withColumn("bytes_per_token", F.round("bytes_per_token", 6))


def tokenizer_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = learned(docs)
    few = train.Tokenizer(found.vocab, found.merges[:FEW_MERGES], [], found.pairs[:FEW_MERGES])
    both = docs.select(F.sum(F.octet_length("text")).alias("b"), *(F.sum(_count(t)).alias(n) for t, n in ((few, "few"), (found, "many"))))
    first, second = F.col("b") / F.col("few"), F.col("b") / F.col("many")
    return both.select(F.round(first, 6).alias("first"), F.round(second, 6).alias("second"), F.round(metrics.improvement(first, second), 4).alias("percent"), metrics.verdict(first, second).alias("verdict"))


def _count(found: train.Tokenizer) -> Column:
    return F.length(codec.token_symbols(F.col("text"), found)).cast("long")


def tokenization_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each source: tokens with an end id after each document, bytes, ratio."""
    docs = table(spark, sf_dir, "documents")
    closed = _lengths(docs, learned(docs), "source").withColumn("n_tokens", F.col("n_tokens") + 1)
    sums = metrics.compression(closed, "source")
    return sums.select(F.col("source").alias("name"), "num_tokens", "input_bytes", F.round("bytes_per_token", 6).alias("bytes_per_token"))


def token_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = learned(docs)
    closed = codec.with_specials(found, [END_OF_TEXT])
    return arrays.token_array(docs, found, end=codec.end_id(closed, END_OF_TEXT))


def uint16_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = learned(table(spark, sf_dir, "documents"))
    return spark.createDataFrame([(max(found.vocab), codec.fits_uint16(found))], "max_id int, safe boolean")


def longest_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.longest_tokens(codec.vocab_frame(spark, learned(table(spark, sf_dir, "documents"))))


def byte_unicode_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer_files.byte_table(spark)


def reservoir_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.reservoir_sample(table(spark, sf_dir, "documents"), SAMPLE, SEED)


def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.hash_sample(table(spark, sf_dir, "documents"), SAMPLE, SEED)


def chunk_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.chunk_boundaries(table(spark, sf_dir, "documents"), CHUNKS)


def lm_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every window over the bytes of the benchmark items, as digests."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    cut = arrays.windows(codec.encode(items, train.Tokenizer(train.base_vocab([]), [], [], [])), CONTEXT)
    joined = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), " ")
    return cut.select("doc_id", F.col("start").cast("long").alias("start"), joined("x").alias("x"), joined("y").alias("y"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))


def _rounded(xs: Column) -> Column:
    """Entries as whole millionths, which hash alike in any engine."""
    return F.array_join(F.transform(xs, lambda v: F.round(v * 1e6).cast("long").cast("string")), " ")


def softmax_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).select("vec_id", _rounded(tensor.softmax(F.col("x"))).alias("y"))


def silu_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).select("vec_id", _rounded(tensor.silu(F.col("x"))).alias("y"))


def rmsnorm_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).select("vec_id", _rounded(tensor.rms_norm(F.col("x"))).alias("y"))


def cross_entropy_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    loss = tensor.cross_entropy(F.col("x"), F.pmod("vec_id", F.size("x")))
    return _vectors(spark, sf_dir).groupBy("label").agg(F.round(F.avg(loss), 6).alias("loss"))


def linear_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed 2-row matrix of plain and alternating ones."""
    signs = F.transform("x", lambda _, k: F.when(k % 2 == 0, 1.0).otherwise(-1.0))
    ones = F.transform("x", lambda _: F.lit(1.0))
    return _vectors(spark, sf_dir).select("vec_id", _rounded(tensor.linear(F.array(ones, signs), F.col("x"))).alias("y"))


def swiglu_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matrices of one and two rows: plain, halved and alternating ones."""
    ones, halves = F.transform("x", lambda _: F.lit(1.0)), F.transform("x", lambda _: F.lit(0.5))
    signs = F.transform("x", lambda _, k: F.when(k % 2 == 0, 1.0).otherwise(-1.0))
    back = F.array(F.array(F.lit(1.0), F.lit(2.0)))
    return _vectors(spark, sf_dir).select("vec_id", _rounded(tensor.swiglu(F.array(ones, signs), back, F.array(halves, ones), F.col("x"))).alias("y"))


def rope_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).select("vec_id", _rounded(tensor.rope(F.col("x"), (F.col("vec_id") % 16).cast("double"))).alias("y"))


def attention_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector over itself, itself reversed and, masked for odd ids, its negative."""
    keys = F.array("x", F.reverse("x"), F.transform("x", lambda v: -v))
    mask = F.array(F.lit(True), F.lit(True), F.col("vec_id") % 2 == 0)
    return _vectors(spark, sf_dir).select("vec_id", _rounded(tensor.attention(F.col("x"), keys, keys, mask)).alias("y"))


def _weights(rows: int, columns: int, seed: int) -> np.ndarray:
    """A fixed matrix whose entries look unrelated."""
    return np.sin(np.arange(rows * columns).reshape(rows, columns) * 1.7 + seed) / np.sqrt(columns)


def _layer(width: int, inner: int, seed: int) -> network.Weights:
    out = {f"attn.{n}_proj.weight": _weights(width, width, seed + k) for k, n in enumerate(("q", "k", "v", "output"))}
    out |= {"ffn.w1.weight": _weights(inner, width, seed + 4), "ffn.w2.weight": _weights(width, inner, seed + 5), "ffn.w3.weight": _weights(inner, width, seed + 6)}
    return out | {f"ln{k}.weight": 1 + 0.1 * _weights(1, width, seed + 6 + k)[0] for k in (1, 2)}


def language_model() -> network.Weights:
    """Fixed weights of a small model over bytes."""
    out = {"token_embeddings.weight": _weights(256, 8, 1), "ln_final.weight": np.ones(8), "lm_head.weight": _weights(256, 8, 2)}
    return out | {f"layers.{k}.{n}": w for k in range(LAYERS) for n, w in _layer(8, 16, 10 * k + 20).items()}


def attention_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as a sequence of eight places: two heads, without and with rotary places, and a whole layer."""
    rows, weights = _vectors(spark, sf_dir), _layer(8, 16, 3)
    for name, layer in (
        ("plain", lambda x, w: network.self_attention(x.reshape(8, -1), HEADS, w)), ("rotary", lambda x, w: network.self_attention(x.reshape(8, -1), HEADS, w, THETA)),
        ("block", lambda x, w: network.block(x.reshape(8, -1), HEADS, w, THETA)),
    ):
        rows = network.mapped(rows, "x", name, layer, weights)
    return rows.select("vec_id", *(_rounded(F.col(n)).alias(n) for n in ("plain", "rotary", "block")))


def lm_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean loss over the bytes of each benchmark item, in windows of ``WINDOW`` that follow each other."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    ids = codec.encode(items, train.Tokenizer(train.base_vocab([]), [], [], []))

    def losses(x: np.ndarray, weights: network.Weights) -> np.ndarray:
        out = []
        for at in range(0, len(x) - 1, WINDOW):
            seen, wanted = x[at : at + WINDOW][: len(x) - 1 - at], x[at + 1 : at + 1 + WINDOW]
            scores = network.language_model(seen, LAYERS, HEADS, weights, THETA)
            top = scores.max(axis=1)
            out.append(np.log(np.exp(scores - top[:, None]).sum(axis=1)) + top - scores[np.arange(len(wanted)), wanted])
        return np.concatenate(out) if out else np.zeros(0)

    told = network.mapped(ids, "ids", "losses", losses, language_model())
    return told.select("doc_id", F.size("losses").cast("long").alias("n"), F.round(F.try_divide(tensor.total(F.col("losses")), F.size("losses")), 6).alias("loss"))


def adamw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two steps over the entries of all vectors, each entry's square less a tenth as its gradient; between
    them the state goes to a checkpoint and comes from there."""
    rows = _vectors(spark, sf_dir).select("vec_id", F.posexplode("x").alias("place", "value")).withColumns({"grad": F.col("value") * F.col("value") - 0.1, "m": F.lit(0.0), "v": F.lit(0.0)})
    path = shared_path(spark, "checkpoint")
    optimiser.save_checkpoint(optimiser.adamw_step(rows, 1, 0.05), 1, path)
    saved, step = optimiser.load_checkpoint(spark, path)
    rows = optimiser.adamw_step(saved, step + 1, 0.05)
    return rows.select("vec_id", "place", F.round("value", 9).alias("value"), F.round("m", 9).alias("m"), F.round("v", 9).alias("v"))


def bpe_preset_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merges of the smaller preset over all documents."""
    found = train.train_preset(table(spark, sf_dir, "documents"), "small")
    rows = [(k + 1, a.hex().upper(), b.hex().upper()) for k, (a, b) in enumerate(found.merges)]
    return spark.createDataFrame(rows, "it int, l string, r string")


def embedding_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors for a list of ids: a join that Spark broadcasts only if statistics allow."""
    ids = table(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") * 7).cast("long").alias("vec_id"))
    return ids.join(_vectors(spark, sf_dir), "vec_id").select("n_nationkey", "vec_id", _rounded(F.col("x")).alias("y"))


def grad_norm_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    norm = rows.agg(F.sqrt(F.sum(tensor.dot(F.col("x"), F.col("x")))).alias("norm"))  # one row
    scaled = rows.crossJoin(F.broadcast(norm)).withColumn("s", tensor.clip_scale(F.col("norm"), 1.0))
    return scaled.select("vec_id", F.round("norm", 6).alias("norm"), F.round(tensor.total(F.col("x")) * F.col("s"), 9).alias("clipped_sum"))


def cosine_lr(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = spark.range(25)
    return steps.select(F.col("id").alias("step"), F.round(tensor.cosine_lr(F.col("id"), **RATES), 9).alias("lr"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    bpe_merges_local, bpe_merges_500, files_roundtrip, stream_encode, metrics_file, summary_file, tokens_file, whole_files, pair_words, special_drop, bpe_encode_large, bpe_roundtrip_large, training_metrics, decode_range, lm_drawn, swiglu_embeddings,
    rope_embeddings, attention_embeddings, attention_heads, lm_loss, adamw, bpe_preset_small, pretoken_stream, pretoken_counts, special_split, corpus_split, byte_pair_counts, best_pair, inverted_index, bpe_merges, bpe_vocab, bpe_words,
    bpe_encode_docs, bpe_roundtrip, decode_unknown, compression_by_lang, tokenizer_compare, tokenization_summary, token_array, uint16_safe, longest_tokens,
    byte_unicode_map, reservoir_sample, hash_sample, chunk_boundaries, lm_batches, softmax_embeddings, silu_embeddings, rmsnorm_embeddings,
    cross_entropy_embeddings, linear_embeddings, embedding_lookup, grad_norm_clip, cosine_lr,
)}
