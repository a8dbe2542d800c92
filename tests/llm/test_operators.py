"""Operators on odd rows, against brute force, and on planted cases."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import DATA
from quern.llm import batches, bpe, exact_dedup, language, licenses, near_dedup, packing, pieces, quality, simple8b, token_store, topk, urls
from quern.llm.queries import QUERIES, SQL
from quern.sources.shared import shared_path

SMALL = DATA / "sf0.001"
LIBRARY, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, source string, key long, length int, t string, n long"
ODD = ["", None, " ", "a", "a", "a  b", "a \t\n b", " x", "x  ", "it's 'll\r\n\r\n x", "é" * 3000, "日本 語　 の", "<|endoftext|> a", "All rights reserved. cc-by CC BY cc by", "general public\nLICENSE", "word " * 3000, "xyz" * 2000]
ROWS = [(k, t, "en" if k % 2 else None, None, k % 3, 7, "t", 1) for k, t in enumerate(ODD)] + [(3, "a", None, "s", 1, 1, "", 0), (None, "a", "en", None, None, None, None, None), (None, None, None, None, None, None, None, None), (5, "other text", "fr", None, 1, 1, "", 0)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(name, same_rows):
    same_rows(QUERIES[name], SQL[name], SMALL)


def library_ids(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(LIBRARY)
    return t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_names_that_clash(spark, odd, none):
    """Extra columns under every name that an operator uses inside."""
    names = "row _row c0 c a b v label rank share part shard bits score lang_pred key bucket chain entry keep_id digest w present blocks kept mean h q n t length task at step start n_tokens ids".split()
    wide = odd.select("doc_id", "text", "lang", *(F.lit(7).alias(n) for n in names))
    marks = spark.createDataFrame([(4, 1, 0)], "doc_id long, quality int, row int")
    model = language.fit(odd.where("lang is not null"))
    assert language.identify(wide, model).columns == [c for c in wide.columns if c not in ("lang_pred", "score")] + ["lang_pred", "score"]
    for got in (
        licenses.scan(wide), bpe.digests(wide, RANKS, P.PATTERN), exact_dedup.exact_dedup(wide), quality.judged(wide, marks), near_dedup.components(wide), near_dedup.near_dedup(wide),
        language.recognised(wide, model, {}), language.identify(wide, model), packing.pack(packing.cut(wide, LIBRARY, 0, 64), 64),
    ):
        assert got.count() > 0
    assert near_dedup.near_dedup(wide).columns == wide.columns
    assert set(map(tuple, near_dedup.components(wide).collect())) == set(map(tuple, near_dedup.components(odd).collect()))
    pages = spark.createDataFrame([(1, "http://a.net/x", "r", "h", "p", "v", 1)], "page_id long, url string, rule string, host string, path string, verdict string, u int")
    assert urls.judge(pages, [0.0] * (urls.DIM + 1)).count() == 1


def test_special_tokens_are_the_librarys(spark):
    """As the plain call gives them: one id in op3 and op6, text in op5."""
    docs = spark.createDataFrame([(1, "<|endoftext|> a"), (2, "x <|endoftext|><|endoftext|>\ny")], "doc_id long, text string")
    path = shared_path(spark, "specials")
    token_store.write(docs, path, LIBRARY, 2)
    assert [r["n_tokens"] for r in token_store.digests(spark, path).orderBy("start").collect()] == [3, 7]
    assert {r["length"] for r in packing.cut(docs, LIBRARY, 0, 64).collect()} == {3, 7}


def test_simple8b():
    rng = np.random.default_rng(1)
    for n in (0, 1, 59, 60, 61, 5000):
        for top in (2, 300, 50_257, 2**40):
            v = rng.integers(0, top, n).astype(np.uint64)
            v[::97] = 2**63 + 5 if n > 1 else 1
            words, marks = simple8b.encode(v)
            assert (simple8b.decode(words) == v).all()
            a, b = sorted(rng.integers(0, n + 1, 2).tolist())
            assert (simple8b.decode_from(words, marks, a, b - a) == v[a:b]).all()


def test_token_store(spark, odd, none):
    path = shared_path(spark, "t")
    token_store.write(odd, path, LIBRARY, 2, shards=3)
    got = token_store.digests(spark, path).orderBy("start").collect()
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start = 0
    assert [r["doc_id"] for r in got] == [r[0] for r in order]
    for mine, row in zip(got, order, strict=True):
        ids = [*library_ids(row[1]), 2]
        assert (mine["start"], mine["n_tokens"], mine["ids_crc32"]) == (start, len(ids), crc(ids))
        start += len(ids)
    path = shared_path(spark, "t")
    token_store.write(none, path, LIBRARY, 2)
    assert token_store.digests(spark, path).count() == 0


def test_byte_bpe(spark, odd, none):
    import tiktoken

    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    got = sorted(map(tuple, bpe.digests(odd, RANKS, P.PATTERN).collect()), key=str)
    want = []
    for r in ROWS:
        text = r[1] or ""
        ids = theirs.encode_ordinary(text)
        want.append((r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.digests(none, RANKS, P.PATTERN).count() == 0


def best_fit(lengths, capacity):
    """Plain best-fit decreasing."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


def checked_packs(rows, capacity):
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


def test_packing(spark, odd, none):
    rows = packing.pack(packing.cut(odd, LIBRARY, 0, 64), 64).collect()
    checked_packs(rows, 64)
    want = []
    for key, text, *_ in ROWS:  # repeated and null ids included
        ids = [*library_ids(text), 0]
        first = len(ids) - 64 * ((len(ids) - 1) // 64)
        cuts = [0, *range(first, len(ids) + 1, 64)]
        want += [(key, k, a, b - a, crc(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=str) == sorted(want, key=str)
    assert packing.pack(packing.cut(none, LIBRARY, 0, 64), 64).count() == 0


def test_packing_is_best_fit_decreasing(spark):
    rng = random.Random(4)
    for capacity in (7, 100):
        lengths = [min(capacity, rng.choice([1, 2, 3, capacity, rng.randrange(1, capacity + 1)])) for _ in range(400)]
        pieces = spark.createDataFrame([(k % 50, k, 0, n, 0) for k, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long")
        assert checked_packs(packing.pack(pieces.repartition(3), capacity).collect(), capacity) == best_fit(lengths, capacity)


def test_exact_dedup(odd, none):
    def told(hash_of):
        return sorted(map(tuple, exact_dedup.exact_dedup(odd, 2, hash_of).collect()), key=str)

    groups = defaultdict(list)
    normal = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    for r in ROWS:
        groups[normal(r[1])].append(r[0])
    want = []
    for r in ROWS:
        ids = groups[normal(r[1])]
        keep = min((i for i in ids if i is not None), default=None)
        want.append((r[0], keep, len(ids), keep is None or r[0] == keep, hashlib.sha256(normal(r[1]).encode()).hexdigest()))
    assert told(exact_dedup.full_hash) == sorted(want, key=str)
    assert told(lambda t: F.pmod(F.xxhash64(t), F.lit(3)) * (1 << 60)) == sorted(want, key=str)  # chains everywhere
    assert exact_dedup.exact_dedup(none).count() == 0


def test_exact_dedup_keeps_no_null_id_beside_another(spark):
    docs = spark.createDataFrame([(5, "x  y"), (None, "x y"), (7, "x\ty"), (None, "z"), (None, "z")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(docs).collect()), key=str)
    assert got == sorted([(5, 5, 3, True), (None, 5, 3, False), (7, 5, 3, False), (None, None, 2, True), (None, None, 2, True)], key=str)


def test_the_index_splits_at_production_capacity(spark):
    """Many buckets, each of a range of keys, no more keys in one than the capacity."""
    docs = spark.range(60_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), (F.col("id") % 50_000).cast("string")).alias("text"))
    index, probes = exact_dedup.build(docs)
    rows = index.groupBy("bucket").agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).orderBy("bucket").collect()
    assert len(rows) > 8 and sum(r["n"] for r in rows) == 50_000 and max(r["n"] for r in rows) <= exact_dedup.LEAST_CAPACITY
    unsigned = [(r["low"] % 2**64, r["high"] % 2**64) for r in rows]
    assert probes.count() == 60_000 and len({h >> 60 for _, h in unsigned}) > 8


def test_directory_doubles_only_where_needed():
    sizes = {p: 1 for p in range(64)} | {5: 100}
    buckets = exact_dedup.directory(sizes, 6, 8)
    assert sum(1 << (6 - d) for _, d in buckets) == 64  # they cover all keys once
    deep = [(p, d) for p, d in buckets if d == 6]
    assert (5, 6) in deep and len(deep) == 2


def test_top_k(spark):
    rng = random.Random(2)
    rows = [(k, [rng.choice([0.0, 0.5, -0.25, rng.random()]) for _ in range(3)], k) for k in range(60)]
    rows += [(100, None, 0), (120, [None, 1.0, 2.0], 0), (140, [float("nan"), 1.0, 0.0], 0), (160, [float("inf"), 0.0, 0.0], 0), (180, [], 0), (200, [1.0, 2.0], 0), (None, [1.0, 1.0, 1.0], 0), (20, rows[20][1], 9)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    assert {(r["query_id"], r["vec_id"], r["score"]) for r in topk.top_k(spark.createDataFrame([(20, []), (40, []), (1, [1.0])], "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).collect()} == {(20, 40, 0), (40, 20, 0)}
    got = defaultdict(list)
    for r in topk.top_k(table, F.col("vec_id") % 20 == 0, 5, query_block=2, shard_rows=7).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    whole = {i: np.floor(64 * np.array(v, np.float32).astype(float)).astype(int) for i, v, _ in rows[:60]}
    for q in (0, 20, 40):
        best = sorted(((-int(whole[q] @ v), i) for i, v in whole.items() if i != q))[:5]
        assert got[q] == [(i, -s) for s, i in best]
    assert set(got) == {0, 20, 40}
    assert topk.top_k(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_top_k_with_several_vectors_of_one_id(spark):
    """In any order of the rows, and in as many shards, one answer: that of all pairs."""
    rng = random.Random(6)
    rows = [(rng.choice([0, 20, 40, *range(1, 15)]), [float(rng.randrange(-9, 9)) for _ in range(3)]) for _ in range(80)]
    score = lambda a, b: sum(int(64 * x) * int(64 * y) for x, y in zip(a, b, strict=True))
    want = set()
    for q in (0, 20, 40):
        found = sorted({(-score(a, b), j) for i, a in rows if i == q for j, b in rows if j != q})[:7]
        want |= {(q, k, j, -s) for k, (s, j) in enumerate(found, 1)}
    for seed in range(2):
        rng.shuffle(rows)
        table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(1 + 4 * seed)
        assert {tuple(r) for r in topk.top_k(table, F.col("vec_id") % 20 == 0, 7, query_block=2, shard_rows=3).collect()} == want


def test_top_k_counts_copies_once(spark):
    rows = [(k, [float(60 - k), 1.0]) for k in range(1, 31)]
    rows += [rows[0]] * 40 + [rows[1]] * 3 + [(3, [50.0, 1.0])] * 2 + [(100, [1.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)  # one shard
    want = sorted({(-64 * 64 * int(v[0]), i) for i, v in rows if i != 100})[:20]
    for shard_rows in (1000, 7):
        got = topk.top_k(table, F.col("vec_id") == 100, 20, shard_rows=shard_rows).orderBy("rank").collect()
        assert [(-r["score"], r["vec_id"]) for r in got] == want
        assert [r["rank"] for r in got] == [*range(1, 21)]


def shingles(text, words):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[k : k + words]) for k in range(len(w) - words + 1)} or ({b" ".join(w)} if w else set())


def plain_components(rows, words, percent=80):
    sets = [(i, shingles(t, words)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, s) in enumerate(sets):
        for j, u in sets[:k]:
            if s and u and 100 * len(s & u) >= percent * len(s | u):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i, _ in sets}


def test_near_dedup(spark, none):
    rng = random.Random(7)
    base = [rng.choice("abcdefghij") * 2 + str(rng.randrange(40)) for _ in range(120)]
    texts = list(ODD)
    for k in range(60):  # a chain of near copies, each of the one before
        base = list(base)
        base[rng.randrange(len(base))] = f"new{k}"
        texts.append(" ".join(base))
    texts += [texts[-1].upper(), texts[-1].replace(" ", "\n"), "p q r", "p q r s", "q r", "one"]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in [*rows, (None, "a")]], "doc_id long, text string, digest string, n int")
    for words in (2, 5):
        got = near_dedup.components(docs, words).collect()
        want = plain_components(rows, words)
        assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == want
        assert all(r["n_shingles"] == len(shingles(texts[r["doc_id"]], words)) and r["kept"] == (want[r["doc_id"]] == r["doc_id"]) for r in got if r["doc_id"] is not None)
        assert [(r["component_id"], r["kept"]) for r in got if r["doc_id"] is None] == [(None, True)]
    assert near_dedup.near_dedup(docs, 5).columns == docs.columns
    assert near_dedup.components(none).count() == 0


def test_min_and_max_agree_as_often_as_sets_do():
    rng = np.random.default_rng(3)
    agreed = []
    for _ in range(30):
        pool = rng.integers(0, 2**63, 300).astype(np.uint64)
        a, b = np.unique(pool[:270]), np.unique(pool[30:])  # similarity 0.8
        agreed.append(np.mean(near_dedup.band_keys(a, 64, 1) == near_dedup.band_keys(b, 64, 1)))
    assert abs(np.mean(agreed) - 0.8) < 0.05


def test_licenses(odd, none):
    got = {(r["doc_id"], r["n_words"]): r for r in licenses.scan(odd).collect()}
    row = got[13, 9]
    assert (row["n_base"], row["first_word"], row["last_word"], row["base_labels"]) == (4, 0, 7, "cc-by,reserved")
    assert got[14, 3]["base_labels"] == "gpl" and got[14, 3]["score"] == 1.0
    assert got[0, 0]["first_word"] is None and got[0, 0]["labels"] == ""
    assert len(licenses.scan(odd).collect()) == len(ROWS) and licenses.scan(none).count() == 0


def test_near_notices(spark):
    lines = ["released under mit license", "released under license", "x\nLicensed under the Apache License Version 2.0 and more words here\ny"]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan(docs).collect()}
    assert got == {0: ("mit", 0.8), 1: ("", 0.0), 2: ("apache", 1.0)}


def test_wrapped_notices(spark):
    """Notices as files wrap them; words far apart aren't one."""
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal"
    bsd = "Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions\n * are met:"
    far = " ".join(f"{w} {'x ' * 9}" for w in "released under the mit license".split())
    docs = spark.createDataFrame([(1, mit), (1, "nothing"), (2, bsd), (3, far), (None, bsd), (4, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["labels"]) for r in licenses.scan(docs).collect()), key=str)
    assert got == sorted([(1, "mit-permission"), (1, ""), (2, "bsd"), (3, ""), (None, "bsd"), (4, "")], key=str)


def test_urls(spark):
    urls_ = ["http://A.Example.ORG/en/1?x", "http://example.org/es/", "https://x.com/de/1", "x.com/fr/", None, "", "a://b.org", "http://notorg/", "https://cheap-pills.example.net/en/5", "https://thenorth.example.net/en/5", "http://net#/x"]
    pages = spark.createDataFrame([(k, u, "<p>", "r") for k, u in enumerate(urls_)] + [(0, urls_[0], None, None)], "page_id long, url string, html string, rule string")
    weights = urls.train(urls.labelled(spark))
    got = urls.judge(pages, weights).orderBy("page_id").collect()
    told = [(r["host"], r["path"], r["rule"], r["verdict"]) for r in got][1:]
    assert told[0] == ("a.example.org", "/en/1", "example.org/en/1", "block")
    assert told[1:3] == [("example.org", "/es/", "example.org/es/", "block"), ("x.com", "/de/1", "com/de/", "block")]
    assert told[3][:3] == told[4][:3] == told[5][:3] == ("", "", None)
    assert told[6][:3] == ("b.org", "", None) and told[7][2] is None and told[10][:3] == ("net", "", None)
    assert told[8][3] == "block" and told[9][3] == "allow"
    assert urls.judge(pages.limit(0), weights).count() == 0


def test_url_model_is_gradient_descent(spark):
    """The same descent in numpy, from the buckets that Spark gives."""
    table = urls.labelled(spark)
    host, path = urls.parts(F.col("url"))
    rows = table.select("y", urls.buckets(host, path).alias("g")).collect()
    x = np.array([[*np.bincount(r["g"], minlength=urls.DIM) / np.sqrt(len(r["g"])), 1.0] for r in rows])
    y, w = np.array([r["y"] for r in rows]), np.zeros(urls.DIM + 1)
    for _ in range(urls.STEPS):
        w = w * (1 - urls.RATE * urls.DECAY) - urls.RATE / len(y) * x.T @ (1 / (1 + np.exp(-x @ w)) - y)
    assert np.allclose(urls.train(table), w, atol=1e-6)
    assert ((x @ w > 0) == (y > 0.5)).mean() > 0.98


def test_url_model_on_hosts_that_it_has_not_seen(spark):
    """Whole queries against brute force over folds of the labelled words: each word's hosts are judged by
    a model of the others, whose scores numpy gives too."""
    words = [*urls.BLOCKED, *urls.ALLOWED]
    host, path = urls.parts(F.col("url"))
    table = urls.labelled(spark).select("url", "y", urls.buckets(host, path).alias("g"), host.alias("host")).collect()
    right = 0
    for fold in range(3):
        mine = {w for k, w in enumerate(words) if k % 3 == fold}
        apart = lambda r: any(r["host"].removeprefix("www.").removeprefix("m.").removeprefix("blog.").startswith(w + ".") for w in mine)
        learn, test = [r for r in table if not apart(r)], [r for r in table if apart(r)]
        weights = urls.train(spark.createDataFrame([(r["url"], r["y"]) for r in learn], "url string, y double"))
        pages = spark.createDataFrame([(k, r["url"]) for k, r in enumerate(test)], "page_id long, url string")
        for got in urls.judge(pages, weights, rules=()).collect():
            r = test[got["page_id"]]
            margin = sum(weights[b] for b in r["g"]) / np.sqrt(len(r["g"])) + weights[-1]
            assert np.isclose(got["score"], 1 / (1 + np.exp(-margin)))
            assert got["verdict"] == ("block" if margin >= 0 else "allow")
            right += got["verdict"] == ("block" if r["y"] else "allow")
    print("of hosts not seen:", right, len(table))
    assert right / len(table) > 0.75


def test_very_long_urls(spark):
    pages = spark.createDataFrame([(0, "http://a.net/" + "xyz/" * 50_000)], "page_id long, url string")
    assert urls.judge(pages, [0.0] * (urls.DIM + 1)).first()["score"] == 0.5


def plain_ppm(train, text):
    """PPM (C, exclusions, frozen) byte by byte over one language's counts."""
    counts = defaultdict(lambda: defaultdict(int))
    for t in train:
        raw = b"\n" * 3 + t.encode()
        for i in range(3, len(raw)):
            for k in range(4):
                counts[raw[i - k : i]][raw[i]] += 1
    bits, raw = 0.0, b"\n" * 3 + text.encode()
    for i in range(3, len(raw)):
        gone = set()
        for k in (3, 2, 1, 0):
            here = {s: n for s, n in counts.get(raw[i - k : i], {}).items() if s not in gone}
            if not here:
                continue
            total = sum(here.values()) + len(here)
            if raw[i] in here:
                bits += np.log2(total / here[raw[i]])
                break
            bits += np.log2(total / len(here))
            gone |= here.keys()
        else:
            bits += np.log2(256 - len(gone))
    return bits


def test_language_costs_are_exact(spark):
    texts = {"en": ["the cat sat on the mat", "then there is that"], "fr": ["le chat est là", "elle est là-bas"]}
    docs = spark.createDataFrame([(k, t, lang) for lang, ts in texts.items() for k, t in enumerate(ts)], "doc_id long, text string, lang string")
    model = language.fit(docs)
    for text in ("that cat", "est là", "zzz é ü the", "a" * 5000):
        got = model.costs(["x".encode(), text.encode()])[1]
        assert np.allclose(got, [plain_ppm(texts["en"], text), plain_ppm(texts["fr"], text)], rtol=1e-4)


def test_language_queries_by_brute_force(spark):
    """identify, typical and recognised against code lengths byte by byte."""
    rng = random.Random(8)
    words = {"en": "the cat sat on that mat and then there was this with".split(), "fr": "le chat est là et elle était sur une table très bien".split()}
    train = [(k, " ".join(rng.choice(words[lang]) for _ in range(30)), lang) for k, lang in enumerate(["en", "fr"] * 10)]
    docs = spark.createDataFrame(train, "doc_id long, text string, lang string")
    model = language.fit(docs)
    texts = [" ".join(rng.choice(words[lang]) for _ in range(n)) for lang in words for n in (1, 3, 20)] + ["zqzq xkxk 0101", "½ ² ①", "12 .", "", None, "日本語", "the là"]
    asked = spark.createDataFrame(list(enumerate(texts)), "bits long, text string")
    learn = {lang: [t for _, t, x in train if x == lang] for lang in ("en", "fr")}

    def told(text):
        if not any(c.isalpha() for c in text or ""):
            return "und", 0.0, 0.0
        bits = [plain_ppm(learn[lang], text) for lang in ("en", "fr")]
        return ("en", "fr")[bits.index(min(bits))], 1 / sum(2 ** max(min(bits) - b, -1000) for b in bits), min(bits)

    want = [told(t) for t in texts]
    got = {r["bits"]: r for r in language.identify(asked, model).collect()}
    assert [got[k]["lang_pred"] for k in range(len(texts))] == [w[0] for w in want]
    assert np.allclose([got[k]["score"] for k in range(len(texts))], [w[1] for w in want], atol=1e-3)
    rates = language.typical(docs, model)
    per = {lang: sorted(told(t)[2] / len(t.encode()) for _, t, x in train if x == lang) for lang in rates}
    assert all(np.isclose(rates[lang], per[lang][len(per[lang]) // 2 - 1], rtol=1e-3) for lang in rates)
    kept = {r["bits"] for r in language.recognised(asked, model, rates).collect()}
    plain = {k for k, (lang, sure, bits) in enumerate(want) if lang != "und" and sure >= 0.5 and bits + language.SLACK * rates[lang] <= language.FAR * rates[lang] * (len(texts[k].encode()) + language.SLACK)}
    assert kept == plain and 0 < len(plain) < len(texts)


def test_languages(spark, odd, none):
    docs = language.held_out(spark.read.parquet(str(SMALL / "documents.parquet")))
    model = language.fit(docs.where("not held_out"))
    rows = language.identify(docs.where("held_out"), model).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.9
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    told = {r["doc_id"]: r for r in language.identify(odd, model).collect()}
    assert told[0]["lang_pred"] == told[1]["lang_pred"] == told[2]["lang_pred"] == "und" and told[0]["score"] == 0
    assert all(0 <= r["score"] <= 1 for r in told.values())
    assert language.fit(none) is None
    assert {r["lang_pred"] for r in language.identify(odd, None).collect()} == {"und"} and language.identify(none, model).count() == 0


def plain_kneser_ney(texts):
    """The probability of a run's last byte after the others, from dictionaries."""
    top = defaultdict(int)
    for t in texts:
        raw = b"\n" * (quality.ORDER - 1) + t
        for i in range(len(t)):
            top[raw[i : i + quality.ORDER]] += 1
    levels = {quality.ORDER: dict(top)}
    for k in range(quality.ORDER - 1, 0, -1):
        ways = defaultdict(set)
        for g in levels[k + 1]:
            ways[g[1:]].add(g[:1])
        levels[k] = {g: len(s) for g, s in ways.items()}
    cuts = {k: quality.discounts([float(sum(n == j for n in level.values())) for j in (1, 2, 3, 4)]) for k, level in levels.items()}
    after = defaultdict(list)
    for level in levels.values():
        for g, n in level.items():
            after[len(g), g[:-1]].append(n)

    def p(run):
        k = len(run)
        if not k:
            return 1 / 256
        lower, rest, d = p(run[1:]), after[k, run[:-1]], cuts[k]
        if not rest:
            return lower
        n = levels[k].get(run, 0)
        return ((n - d[min(n, 3) - 1] if n else 0) + sum(d[min(m, 3) - 1] for m in rest) * lower) / sum(rest)

    return p


def test_kneser_ney(spark):
    """Sums over texts, in one shard and in many, against the formula; probabilities sum to one."""
    train = [b"abcab abd abe cab", "l'\u00e9t\u00e9 est l\u00e0".encode(), b"", b"the cat sat on the mat that sat"]
    p = plain_kneser_ney(train)
    assert all(np.isclose(sum(p(c + bytes([b])) for b in range(256)), 1) for c in (b"", b"a", b"the ", b"zzzz", b"\n\n\n\n"))
    docs = spark.createDataFrame([(k, t.decode(), "en") for k, t in enumerate(train)], "doc_id long, text string, lang string")
    table = quality.model(quality.run_counts(docs))
    texts = [*train, b"the bat", b"\xc3\xa9 zzz", b"a" * 3000]
    rows = spark.createDataFrame([(k, t.decode(), "en", 3) for k, t in enumerate(texts)], "doc_id long, text string, lang string, bits long").repartition(2)
    want = {}
    for k, t in enumerate(texts):
        raw = b"\n" * (quality.ORDER - 1) + t
        want[k] = -sum(np.log2(p(raw[i : i + quality.ORDER])) for i in range(len(t)))
    for most in (10**6, 60):
        got = {r["doc_id"]: r["bits"] for r in quality.scored(rows, table, most=most).collect()}
        assert all(np.isclose(got[k], want[k], rtol=1e-4, atol=1e-3) for k in want) and len(got) == len(want)


def test_runs_of_long_texts_are_whole(monkeypatch):
    texts = [b"abcdefghijk" * 30, b"", b"x", b"yz" * 100]
    whole = [r.tolist() for r, _, _ in quality.runs(texts)]
    monkeypatch.setattr(quality, "GROUP_BYTES", 7)
    assert [x for r, _, _ in quality.runs(texts) for x in r.tolist()] == sum(whole, [])
    assert all(len(r) == sum(n) for r, _, n in quality.runs(texts))


def test_scoring_holds_one_group_at_a_time(monkeypatch):
    """Memory while texts are scored, in multiples of a group's bytes."""
    monkeypatch.setattr(quality, "GROUP_BYTES", 1 << 18)
    rng = np.random.default_rng(5)
    texts = [rng.integers(97, 105, 1 << 18, np.uint8).tobytes() for _ in range(4)]
    key = np.unique(np.concatenate([(r & ((1 << 8 * k) - 1)) + (1 << 8 * k) for r, _, _ in quality.runs(texts) for k in range(quality.ORDER + 1)]))
    adds, backs = rng.random((2, len(key)), np.float32)
    shard = quality.Shard(rng.permutation(key), adds, backs, True)
    quality._sums(texts[:1], shard)
    tracemalloc.start()
    try:
        quality._sums(texts, shard)
        assert tracemalloc.get_traced_memory()[1] < 24 * quality.GROUP_BYTES
    finally:
        tracemalloc.stop()


def test_tables_go_when_other_tasks_begin():
    """What a worker keeps for tasks of one kind is not held beside what the next kind needs."""
    batch = pa.RecordBatch.from_pydict({"text": ["a b", None]})
    pieces.memory_of(LIBRARY).texts(["a b"])
    held = pieces.memory_of(LIBRARY)
    assert len(list(batches.bounded(iter([batch]), uses=(pieces.MEMORIES,)))) == 1 and pieces.memory_of(LIBRARY) is held
    assert len(list(batches.bounded(iter([batch])))) == 1 and not pieces.MEMORIES


def test_quality_query_by_brute_force(spark, monkeypatch):
    """Perplexities, thresholds and decisions of a whole table against plain Python."""
    monkeypatch.setattr(quality, "FEWEST", 8)
    rng = random.Random(9)
    words = {"en": "the cat sat on that mat".split(), "fr": "le chat est là bas".split(), "de": ["das"], None: ["x"]}
    rows = [(k, " ".join(rng.choice(words[lang]) for _ in range(rng.randrange(1, 30))), lang) for k, lang in enumerate(["en", "fr"] * 60 + ["de", None] * 3)]
    rows += [(200, "q7 %% zz \x01" * 9, "en"), (201, "", "fr"), (202, None, "en"), (203, "the cat sat " * 200, "en"), (None, "le chat", "fr"), (5, "le le", "fr")]
    good = {k for k in range(126)}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, 1) for k in good] + [(200, 0)], "doc_id long, quality int")
    fold = lambda k: zlib.crc32(str(k).encode()) % quality.FOLDS == 0
    p = plain_kneser_ney([t.encode() for k, t, _ in rows if k in good and not fold(k)])
    lead = b"\n" * (quality.ORDER - 1)
    bits = {t: -sum(np.log2(p((lead + t.encode())[i : i + quality.ORDER])) for i in range(len(t.encode()))) for t in {t or "" for _, t, _ in rows}}
    apart = [(t, lang) for k, t, lang in rows if k in good and fold(k) and t]
    rate = lambda ts: sum(bits[t] for t in ts) / sum(len(t.encode()) for t in ts)
    own = {lang: [t for t, x in apart if x == lang] for lang in words if lang and sum(x == lang for _, x in apart) >= 8}
    mean = lambda lang: rate(own.get(lang) or [t for t, _ in apart])
    score = lambda t, lang: (bits[t] + quality.PRIOR * mean(lang)) / (len(t.encode()) + quality.PRIOR)
    pick = lambda xs, q: sorted(xs)[max(0, int(np.ceil(q * len(xs))) - 1)]
    limits = {}
    for lang in words:
        xs = [score(t, x) for t, x in apart if x == lang] if lang in own else [score(t, x) for t, x in apart]
        low, high = (pick(xs, q) for q in quality.QUANTILES)
        limits[lang] = (low - quality.MARGIN * (high - low) / 2, high + quality.MARGIN * (high - low) / 2)
    most = max(quality.REPEATS_FLOOR, quality.REPEATS * pick([quality.repeats(t.encode()) for t, _ in apart], quality.QUANTILES[1]))
    assert set(own) == {"en", "fr"}
    want = []
    for k, t, lang in rows:
        s = score(t or "", lang)
        sure = min(abs(s - x) for x in limits[lang]) > 1e-4
        want.append((str(k), bool(t) and limits[lang][0] <= s <= limits[lang][1] and quality.repeats(t.encode()) <= most if sure else None, round(2**s, 2) if t else None))
    got = [(str(r["doc_id"]), r["kept"], r["perplexity"] and round(r["perplexity"], 2)) for r in quality.judged(docs, labels).collect()]
    assert len(got) == len(want) and {w[1] for w in want} >= {True, False}
    for mine, plain in zip(sorted(got, key=str), sorted(((k, g, x) for k, g, x in want), key=lambda w: str((w[0], [m for m in got if m[0] == w[0]][0][1] if w[1] is None else w[1], w[2]))), strict=True):
        assert mine[0] == plain[0] and (plain[1] is None or mine[1] == plain[1]) and (mine[2] is None) == (plain[2] is None) and (mine[2] is None or abs(mine[2] - plain[2]) < 0.05)


def test_quality(spark, odd, none):
    docs, labels = (spark.read.parquet(str(DATA / "sf0.01" / f"{t}.parquet")) for t in ("documents", "labels"))
    rows = quality.judged(docs, labels).join(labels, "doc_id").collect()
    clean = [r["kept"] for r in rows if r["quality"] == 1]
    junk = [r["kept"] for r in rows if r["quality"] == 0]
    assert np.mean(clean) > 0.97 and np.mean(junk) < 0.25
    marks = spark.createDataFrame([(0, 1, 0), (None, 1, 0), (4, 1, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    told = quality.judged(odd, marks).collect()
    assert len(told) == len(ROWS) and all(not r["kept"] and r["perplexity"] is None for r in told if r["n_symbols"] == 0)
    assert quality.judged(none, marks).count() == 0
    assert quality.judged(odd, marks.limit(0)).count() == len(ROWS)


def test_quality_sees_repeated_words(spark):
    docs, labels = (spark.read.parquet(str(DATA / "sf0.1" / f"{t}.parquet")) for t in ("documents", "labels"))
    rows = quality.judged(docs, labels).join(labels, "doc_id").collect()
    clean = [r["kept"] for r in rows if r["quality"] == 1]
    junk = [r["kept"] for r in rows if r["quality"] == 0]
    print(len(clean), sum(clean), len(junk), sum(junk))
    assert np.mean(clean) > 0.99 and np.mean(junk) < 0.03
