"""Sources, samples, arrays, files, streams and numeric contracts."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import tensor
from quern.functions.text import END_OF_TEXT
from quern.operators import arrays, codec, prefix, sampling, train
from quern.sources import corpus, shared, tokenizer_files
from quern.streaming import encode as stream


def test_read_corpus(spark, tmp_path):
    (tmp_path / "a.txt").write_text(f"one{END_OF_TEXT}{END_OF_TEXT}two\n{END_OF_TEXT}")
    assert [r["text"] for r in corpus.read_corpus(spark, str(tmp_path)).orderBy("doc_id").collect()] == ["one", "", "two\n"]
    assert corpus.read_whole(spark, str(tmp_path)).first()["text"].startswith("one")


def test_split_corpus(spark):
    rows = spark.createDataFrame([(1, f"\r\na\n{END_OF_TEXT}{END_OF_TEXT}b"), (2, None), (3, "")], "doc_id long, text string")
    assert [(r[0], r[2]) for r in corpus.split_corpus(rows, "doc_id").collect()] == [(1, "\r\na\n"), (1, ""), (1, "b")]
    assert [r["text"] for r in corpus.split_corpus(rows, "doc_id", drop_empty=True).collect()] == ["a", "b"]


def test_boundaries_by_scanning(spark):
    rng = random.Random(1)
    texts = ["é" * rng.randrange(40) for _ in range(50)]
    blob = END_OF_TEXT.join(texts).encode()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for n in (1, 3, 8, 40, 5000):
        width = len(blob) // n
        wanted = {0, len(blob)} | {at if (at := blob.find(END_OF_TEXT.encode(), i * width)) >= 0 else len(blob) for i in range(1, n) if width}
        assert {r[0] for r in corpus.chunk_boundaries(docs, n).collect()} == wanted


def test_reservoir_replays_the_plain_loop(spark):
    texts = [f"\nd{i}\r\n" if i % 7 else "\n" for i in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    held, rng, seen = [], random.Random(5), 0
    for t in (t.strip("\r\n") for t in texts):
        if t:
            seen += 1
            if len(held) < 9:
                held.append(t)
            elif (j := rng.randrange(seen)) < 9:
                held[j] = t
    assert [r["text"] for r in sampling.reservoir_sample(docs, 9, 5).orderBy("slot").collect()] == held
    assert sampling.hash_sample(docs, 5, 1).collect() == sampling.hash_sample(docs.repartition(7), 5, 1).collect()


def test_a_sample_of_rows_that_share_a_key(spark):
    docs = spark.createDataFrame([(k % 3, f"d{k}") for k in range(30)], "doc_id long, text string")
    got = sampling.reservoir_sample(docs, 5, 1).collect()
    assert sorted(r["slot"] for r in got) == list(range(5)) and len({r["text"] for r in got}) == 5


def test_running_total(spark):
    rows = [(k % 50, k, k % 7) for k in range(500)]
    got = prefix.running_total(spark.createDataFrame(rows, "a long, b long, v long"), ["a", "b"], "v", "t", 9).collect()
    total, wanted = 0, {}
    for a, b, v in sorted(rows):
        wanted[a, b] = total
        total += v
    assert {(r["a"], r["b"]): r["t"] for r in got} == wanted


def test_token_array(spark):
    docs = spark.createDataFrame([(2, "b"), (1, "aé"), (3, None)], "doc_id long, text string")
    found = train.Tokenizer(train.base_vocab([END_OF_TEXT]), [], [], [])
    rows = arrays.checked_uint16(arrays.token_array(docs, found, 256)).orderBy("pos").collect()
    assert [r["token_id"] for r in rows] == [97, 195, 169, 256, 98, 256, 256] and [r["pos"] for r in rows] == list(range(7))


def test_windows(spark):
    rows = spark.createDataFrame([(1, list(range(6))), (2, [1, 2])], "doc_id long, ids array<int>")
    got = arrays.windows(rows, 3).orderBy("start").collect()
    assert [(r["x"], r["y"]) for r in got] == [([k, k + 1, k + 2], [k + 1, k + 2, k + 3]) for k in range(3)]
    many = spark.createDataFrame([(1, list(range(100)))], "doc_id long, ids array<int>")
    assert arrays.sample_windows(many, 7, 32, 1).count() == 32


def test_tokenizer_files(spark, tmp_path):
    docs = spark.createDataFrame([(1, "low lower lowest é")], "doc_id long, text string")
    found = train.train(docs, 270)
    tokenizer_files.save_tokenizer(spark, found, str(tmp_path))
    back = tokenizer_files.load_tokenizer(spark, f"{tmp_path}/vocab.json", f"{tmp_path}/merges.txt", [END_OF_TEXT])
    assert back.merges == found.merges and back.vocab == found.vocab | {max(found.vocab) + 1: END_OF_TEXT.encode()}
    assert {r["byte"]: r["ch"] for r in tokenizer_files.byte_table(spark).collect()} == tokenizer_files.byte_characters()
    assert tokenizer_files.first_present(spark, [f"{tmp_path}/none", f"{tmp_path}/vocab.json"]) == f"{tmp_path}/vocab.json"
    (tmp_path / "m.txt").write_text("#version: 0.2\n\na b c\na b\n")
    (tmp_path / "v.json").write_text(json.dumps({"a": 0, "b": 1, "ab": 2, "日": 3}))
    odd = tokenizer_files.load_tokenizer(spark, f"{tmp_path}/v.json", f"{tmp_path}/m.txt")
    assert odd.vocab[3] == "日".encode() and codec.usable_ranks(odd) == {(b"a", b"b"): 1}


def test_saved_tokens_and_records(spark, tmp_path):
    tokens = spark.range(100).selectExpr("id as pos", "cast(id as int) as token_id")
    tokenizer_files.save_tokens(tokens, f"{tmp_path}/t", 100)
    tokenizer_files.save_record(spark.range(1), f"{tmp_path}/r")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 100


def test_decoding_policies(spark):
    rng = random.Random(2)
    raw = [bytes(rng.choice(b"ab\xc3\xa9\xe2\x82\xac\xf0\x9f\x99\x83\xed\xa0\x80\xff\xc0") for _ in range(rng.randrange(9))) for _ in range(500)] + ["é\ufffd🙃".encode(), b""]
    rows = spark.createDataFrame([(k, bytearray(b)) for k, b in enumerate(raw)], "id int, b binary")
    for errors in ("ignore", "replace"):
        got = {r["id"]: r["t"] for r in rows.select("id", corpus.decoded(F.col("b"), errors).alias("t")).collect()}
        assert got == {k: b.decode("utf-8", errors) for k, b in enumerate(raw)}
    sound = rows.where(f"id = {len(raw) - 2}")
    assert sound.select(corpus.decoded(F.col("b")).alias("t")).first()["t"] == "é\ufffd🙃"
    with pytest.raises(Exception, match="UTF"):
        rows.select(corpus.decoded(F.col("b")).alias("t")).collect()


def test_ranges_of_bytes(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("aé\r\nb€c".encode())
    assert corpus.read_range(spark, str(tmp_path / "a.txt"), 2, 6).first()["text"] == "\r\nb"
    assert corpus.read_whole(spark, str(tmp_path / "a.txt")).first()["text"] == "aé\nb€c"


def test_inverted_index(spark):
    from quern.operators import counting

    words = spark.createDataFrame([("aab", 2), ("ab", 1), ("b", 9), ("", 1)], "s string, n long")
    assert sorted(map(tuple, counting.pair_index(words).collect())) == [("aa", "aab"), ("ab", "aab"), ("ab", "ab")]
    assert {r["pair"]: r["c"] for r in counting.pair_counts(words).collect()} == {"aa": 2, "ab": 3}


def test_release(spark):
    path = shared.shared_path(spark, "gone")
    spark.range(3).write.parquet(path)
    assert shared.release(spark) > 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
    assert shared.spare("Row", ["row", "ROW_"]) == "Row__"


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"text {k} é\n\nend") for k in range(40)], "doc_id long, text string")
    docs.repartition(4).write.parquet(f"{tmp_path}/in")
    found = train.train(docs, 266)
    texts = stream.read_texts(spark, f"{tmp_path}/in", docs.schema, 1)
    stream.run_available(stream.encode_stream(texts, found), f"{tmp_path}/out", f"{tmp_path}/check")
    got = spark.read.parquet(f"{tmp_path}/out").orderBy("doc_id").collect()
    assert got == codec.encode(docs, found).orderBy("doc_id").collect()


def test_shared_tables(spark):
    path = shared.shared_path(spark, "x")
    spark.range(3).write.parquet(path)
    shared.removed(spark, path)
    assert shared.written(spark.range(3), "y").count() == 3


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def arr(*xs):
    return F.array(*(F.lit(float(x)) for x in xs))


def close(a, b):
    return all(math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-12) for x, y in zip(a, b, strict=True))


def test_tensor_contracts(spark):
    assert close(one(spark, tensor.softmax(arr(1000, 1001))), [1 / (1 + math.e), math.e / (1 + math.e)])
    assert math.isclose(one(spark, tensor.cross_entropy(arr(0, 1000), F.lit(0))), 1000.0)
    assert close(one(spark, tensor.silu(arr(0, 2))), [0, 2 / (1 + math.exp(-2))])
    assert close(one(spark, tensor.rms_norm(arr(3, 4), arr(1, 2), 0.0)), [3 / math.sqrt(12.5), 8 / math.sqrt(12.5)])
    eye = F.array(arr(1, 0), arr(0, 1))
    assert close(one(spark, tensor.swiglu(eye, eye, eye, arr(1, 2))), [1 / (1 + math.exp(-1)), 4 / (1 + math.exp(-2))])
    assert close(one(spark, tensor.rope(arr(1, 0), F.lit(1.0))), [math.cos(1), math.sin(1)])
    seen = tensor.attention(arr(1, 0), eye, F.array(arr(1, 2), arr(3, 4)), F.array(F.lit(True), F.lit(False)))
    assert close(one(spark, seen), [1, 2])
    assert one(spark, tensor.clip_scale(F.lit(0.5), 1.0)) == 1.0


def test_contracts_over_long_vectors_take_linear_time(spark):
    import time

    def seconds(d):
        rows = spark.range(50).select(F.transform(F.sequence(F.lit(1), F.lit(d)), lambda k: F.sin(k + F.col("id"))).alias("x")).select("*", F.pmod(F.size("x"), F.lit(7)).alias("t")).collect()
        frame = spark.createDataFrame(rows, "x array<double>, t int")
        began = time.perf_counter()
        frame.select(tensor.softmax(F.col("x")), tensor.cross_entropy(F.col("x"), F.col("t")), tensor.rms_norm(F.col("x"))).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    seconds(16)
    assert seconds(4096) < 60  # 16 million steps if linear, 70 billion if not


def looped_attention(x, heads, w, theta):
    """Entry by entry."""
    n, d = x.shape
    size = d // heads
    q, k, v = (np.array([[sum(w[f"attn.{name}_proj.weight"][j][i] * row[i] for i in range(d)) for j in range(d)] for row in x]) for name in "qkv")

    def turn(row, place):
        out = list(row)
        for i in range(size // 2 if theta else 0):
            a = place / theta ** (2 * i / size)
            out[2 * i], out[2 * i + 1] = row[2 * i] * math.cos(a) - row[2 * i + 1] * math.sin(a), row[2 * i] * math.sin(a) + row[2 * i + 1] * math.cos(a)
        return np.array(out)

    joined = np.zeros((n, d))
    for h in range(heads):
        part = slice(h * size, (h + 1) * size)
        for i in range(n):
            scores = [turn(q[i, part], i) @ turn(k[j, part], j) / math.sqrt(size) for j in range(i + 1)]
            odds = [math.exp(s - max(scores)) for s in scores]
            joined[i, part] = sum(o * v[j, part] for j, o in enumerate(odds)) / sum(odds)
    return joined @ w["attn.output_proj.weight"].T


def test_network_layers(spark):
    from quern.functions import network
    from quern.plans import catalog

    rng = np.random.default_rng(2)
    x, w = rng.normal(size=(5, 8)), catalog._layer(8, 16, 1)
    for theta in (None, 100.0):
        assert np.allclose(network.self_attention(x, 2, w, theta), looped_attention(x, 2, w, theta))
    norm = lambda y, g: np.array([row / math.sqrt(sum(v * v for v in row) / 8 + 1e-5) * g for row in y])
    middle = x + looped_attention(norm(x, w["ln1.weight"]), 2, w, 100.0)
    y = norm(middle, w["ln2.weight"])
    gate = np.array([[sum(a * b for a, b in zip(row, u, strict=True)) for u in w["ffn.w1.weight"]] for row in y])
    after = middle + (gate / (1 + np.exp(-gate)) * (y @ w["ffn.w3.weight"].T)) @ w["ffn.w2.weight"].T
    assert np.allclose(network.block(x, 2, w, 100.0), after)
    model = catalog.language_model()
    ids = np.array([1, 2, 3, 250, 7])
    whole = network.language_model(ids, 2, 2, model, 1e4)
    assert whole.shape == (5, 256) and np.allclose(network.language_model(ids[:3], 2, 2, model, 1e4), whole[:3])  # no place sees a later one
    rows = spark.createDataFrame([(1, x.ravel().tolist(), 0), (2, None, 0)], "id int, x array<double>, y int")
    got = {r["id"]: r["y"] for r in network.mapped(rows, "x", "y", lambda v, u: network.block(v.reshape(5, 8), 2, u, 100.0), w).collect()}
    assert got[2] is None and np.allclose(got[1], after.ravel())


def test_losses_of_a_language_model(spark):
    from quern.functions import network
    from quern.plans import catalog

    got = {r["doc_id"]: r for r in catalog.lm_loss(spark, "/root/testdata/sf0.001").collect()}
    for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").limit(5).collect():
        raw, losses = r["text"].encode(), []
        for at in range(0, len(raw) - 1, catalog.WINDOW):
            seen = list(raw[at : min(at + catalog.WINDOW, len(raw) - 1)])
            for k, scores in enumerate(network.language_model(np.array(seen), 2, 2, catalog.language_model(), catalog.THETA)):
                losses.append(math.log(sum(math.exp(s) for s in scores)) - scores[raw[at + k + 1]])
        assert got[r["item_id"]]["n"] == len(raw) - 1 and math.isclose(got[r["item_id"]]["loss"], sum(losses) / len(losses), abs_tol=1e-5)


def test_optimiser_and_checkpoints(spark, tmp_path):
    from quern.operators import optimiser

    rows = spark.createDataFrame([("w", 0, 1.0, 0.5, 0.0, 0.0), ("w", 1, -2.0, None, 0.1, 0.2)], "name string, i int, value double, grad double, m double, v double")
    for step in (1, 2, 3):
        rows = optimiser.adamw_step(rows, step, 0.1)
    value, m, v = 1.0, 0.0, 0.0
    for step in (1, 2, 3):
        m, v = 0.9 * m + 0.1 * 0.5, 0.999 * v + 0.001 * 0.25
        value = value - 0.1 * 0.01 * value - 0.1 * (m / (1 - 0.9**step)) / (math.sqrt(v / (1 - 0.999**step)) + 1e-8)
    optimiser.save_checkpoint(rows, 3, f"{tmp_path}/c")
    back, iteration = optimiser.load_checkpoint(spark, f"{tmp_path}/c")
    got = {r["i"]: r for r in back.collect()}
    assert iteration == 3 and close([got[0]["value"], got[0]["m"], got[0]["v"]], [value, m, v]) and tuple(got[1]) == ("w", 1, -2.0, None, 0.1, 0.2)


def test_learning_rates(spark):
    rates = [r[0] for r in spark.range(25).select(tensor.cosine_lr(F.col("id"), 1.0, 0.1, 7, 21)).collect()]
    assert rates[0] == 0 and rates[7] == 1.0 and close(rates[21:], [0.1] * 4) and close(rates[14:15], [0.55])
