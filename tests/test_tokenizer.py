"""Training, encoding and decoding against plain Python versions."""

from collections import Counter

import pyarrow as pa
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.functions.text import END_OF_TEXT, PRETOKEN_PATTERN
from quern.operators import codec, shares, train
from quern.operators.counting import pretoken_counts, pretoken_stream

SPECIALS = [END_OF_TEXT, END_OF_TEXT * 2]
TEXTS = ["", "s", "🙃", "Hello, how are you?", "Héllò hôw are ü? 🙃", "a\n\n\nfoo  bar don'T can't we'll", "aaa aaaa aaaaa", "low low low lower lowest newer newest widest"]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def plain_train(texts, size):
    """Recounts every pair before each merge."""
    words = Counter(w.encode() for t in texts for w in regex.findall(PRETOKEN_PATTERN, t))
    split = {w: [bytes([b]) for b in w] for w in words}
    merges = []
    while len(merges) < size:
        pairs = Counter()
        for w, parts in split.items():
            for p in zip(parts, parts[1:]):
                pairs[p] += words[w]
        if not pairs:
            break
        best = max(pairs, key=lambda p: (pairs[p], p))
        merges.append(best)
        for w, parts in split.items():
            out = []
            for x in parts:
                if out and (out[-1], x) == best and isinstance(out[-1], bytes):
                    out[-1] = [out[-1] + x]
                else:
                    out.append(x)
            split[w] = [x[0] if isinstance(x, list) else x for x in out]
    return merges


@pytest.mark.parametrize("strategy", ["local", "rounds"])
def test_training_is_exact(spark, strategy):
    found = train.train(frame(spark, TEXTS * 3), 256 + 40, [], strategy)
    assert found.merges == plain_train(TEXTS * 3, 40)
    assert [found.vocab[256 + k] for k in range(len(found.merges))] == [a + b for a, b in found.merges]


def test_strategies_agree(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    a, b = (train.train(docs, 256 + 50, [END_OF_TEXT], s) for s in ("local", "rounds"))
    assert a.merges == b.merges and a.vocab == b.vocab and a.vocab[256] == END_OF_TEXT.encode()


def test_presets(spark, monkeypatch):
    monkeypatch.setitem(train.PRESETS, "small", {"vocab_size": 300, "specials": (END_OF_TEXT,)})
    found = train.train_preset(frame(spark, TEXTS * 3), "small")
    assert found.merges == plain_train(TEXTS * 3, 43) and found.vocab[256] == END_OF_TEXT.encode()


@pytest.mark.parametrize("strategy", ["auto", "local"])
def test_many_words_are_merged_by_tasks_together(spark, monkeypatch, strategy):
    """Neither by a job for each round nor on the driver."""
    for name in ("_learn_rounds", "learn_here"):
        monkeypatch.setattr(train, name, None)
    monkeypatch.setattr(shares, "SHARE", 40)
    found = train.train(frame(spark, TEXTS * 3), 256 + 41, [END_OF_TEXT], strategy, local_words=5)
    assert found.merges == plain_train(TEXTS * 3, 40) and [found.vocab[a] + found.vocab[b] for a, b, _ in found.pairs] == [found.vocab[new] for _, _, new in found.pairs]


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.binary(min_size=1, max_size=14).map(lambda b: bytes(97 + x % 3 for x in b)), st.integers(1, 9), max_size=20), st.sampled_from([1, 3, 5_000]), st.sampled_from([1, 4, 1 << 17]))
def test_shares_learn_what_plain_counts_tell(words, ordered, late):
    vocab = train.base_vocab([])
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(shares, "ORDERED", ordered)
        patch.setattr(shares, "LATE", late)
        parts = [[pa.RecordBatch.from_arrays([pa.array([w], pa.binary()), pa.array([n], pa.int64())], names=["word", "n"]) for w, n in list(words.items())[k::3]] for k in range(3)]
        held, chooser = [shares.Share(p, vocab, 296) for p in parts], shares.Chooser(vocab, 296)
        chooser.add([s.pairs() for s in held])
        learned = []
        while batch := chooser.batch():
            learned += batch
            chooser.add([s.merge(batch) for s in held])
    assert [(chooser.vocab[a], chooser.vocab[b]) for a, b, _ in learned] == plain_train([w.decode() for w, n in words.items() for _ in range(n)], 40)


def test_small_vocabularies_learn_nothing(spark):
    assert train.train(frame(spark, TEXTS), 200, SPECIALS).merges == []
    assert len(train.base_vocab(SPECIALS + SPECIALS)) == 258


def test_specials_are_cut_out_of_training(spark):
    docs = frame(spark, [f"ab{END_OF_TEXT}ab", END_OF_TEXT * 40])
    assert {r["pretoken"]: r["n"] for r in pretoken_counts(docs, [END_OF_TEXT]).collect()} == {"ab": 2}
    assert all(b"<|" not in t for i, t in train.train(docs, 300, [END_OF_TEXT]).vocab.items() if i > 256)


def test_pretokens_follow_the_pattern(spark):
    got = {}
    for r in pretoken_stream(frame(spark, TEXTS)).collect():
        got.setdefault(r["doc_id"], {})[r["pos"]] = r["pretoken"]
    assert [[w for _, w in sorted(got.get(i, {}).items())] for i in range(len(TEXTS))] == [regex.findall(PRETOKEN_PATTERN, t) for t in TEXTS]


def arrow_only(found, specials=()):
    return codec.with_specials(train.Tokenizer(found.vocab, found.merges, []), list(specials))


def test_both_encoders_agree_and_round_trip(spark):
    docs = frame(spark, TEXTS)
    found = train.train(docs, 256 + 30)
    fold = {r["doc_id"]: r["ids"] for r in codec.encode(docs, found).collect()}
    batch = {r["doc_id"]: r["ids"] for r in codec.encode(docs, arrow_only(found)).collect()}
    assert fold == batch
    for t in (found, train.Tokenizer(found.vocab | {5000: b"far"}, found.merges)):  # the second decodes by a join
        back = {r["doc_id"]: r["text"] for r in codec.decode(codec.encode(docs, t), t).collect()}
        assert back == dict(enumerate(TEXTS))


def plain_merge(word, ranks, ids):
    """While any pair has a rank: all places of the lowest one, from the left."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while True:
        ranked = [ranks.get(p) for p in zip(parts, parts[1:])]
        lowest = min((r for r in ranked if r is not None), default=None)
        if lowest is None:
            return [ids[p] for p in parts]
        out, k = [], 0
        while k < len(parts):
            both = k < len(ranked) and ranked[k] == lowest
            out.append(parts[k] + parts[k + 1] if both else parts[k])
            k += 2 if both else 1
        parts = out


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=24).map(lambda b: bytes(97 + x % 3 for x in b)), st.permutations([(a, b) for a in (b"a", b"b", b"c", b"ab", b"aa", b"ba", b"aab") for b in (b"a", b"b", b"c", b"ab", b"ba")]))
def test_merging_by_a_heap(word, merges):
    """Any order of merges, those included that give a token of a lower rank later on."""
    ranks = {p: k for k, p in enumerate(merges[:20])}
    tokens = {bytes([b]) for b in b"abc"} | {a + b for a, b in ranks}
    ranks = {p: k for p, k in ranks.items() if p[0] in tokens and p[1] in tokens}
    ids = {t: k for k, t in enumerate(sorted(tokens))}
    assert codec.merge_word(word, ranks, ids) == plain_merge(word, ranks, ids)


def test_a_long_word_is_merged_in_time():
    ranks, ids = {(b"a", b"a"): 0, (b"aa", b"aa"): 1}, {b"a": 0, b"aa": 1, b"aaaa": 2}
    assert codec.merge_word(b"a" * 200_001, ranks, ids) == [2] * 50_000 + [0]


def test_decoding_is_one_thing_for_any_vocabulary(spark):
    small = train.Tokenizer(train.base_vocab([]), [])
    large = train.Tokenizer(small.vocab | {5000 + k: b"far" for k in range(3)}, [])
    rows = [(1, [65, 66]), (1, [67]), (2, None), (3, []), (4, [65, 9999, 195, 66]), (5, [-1, None, 226, 130]), (None, [72])]
    docs = spark.createDataFrame(rows, "doc_id long, ids array<int>").repartition(2)
    a, b = (sorted(map(tuple, codec.decode(docs, t).collect()), key=str) for t in (small, large))
    assert a == b == sorted([(1, "AB"), (1, "C"), (2, None), (3, ""), (4, "A\ufffd\ufffdB"), (5, "\ufffd\ufffd\ufffd"), (None, "H")], key=str)


def test_large_queries_by_brute_force(spark, tmp_path):
    from quern.plans import catalog

    for t in ("documents", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").limit(12).write.parquet(f"{tmp_path}/{t}.parquet")
    found = catalog._large(spark, str(tmp_path))
    texts = [r["text"] for r in spark.read.parquet(f"{tmp_path}/benchmark.parquet").collect()]
    assert found.merges == plain_train(texts, catalog.LARGE - 256)
    ranks, ids = codec.usable_ranks(found), found.ids
    want = {}
    for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect():
        parts = regex.split(f"({regex.escape(END_OF_TEXT * 2)}|{regex.escape(END_OF_TEXT)})", r["text"].replace("\n", END_OF_TEXT * 2))
        want[r["doc_id"]] = [i for p in parts if p for w in ([p] if p in SPECIALS else regex.findall(PRETOKEN_PATTERN, p)) for i in ([ids[w.encode()]] if p in SPECIALS else plain_merge(w.encode(), ranks, ids))]
    import hashlib

    got = {r["doc_id"]: (r["n_tokens"], r["ids_md5"]) for r in catalog.bpe_encode_large(spark, str(tmp_path)).collect()}
    assert got == {k: (len(v), hashlib.md5(" ".join(map(str, v)).encode()).hexdigest()) for k, v in want.items()}


def test_null_text(spark):
    found = train.train(frame(spark, TEXTS), 260)
    docs = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert codec.encode(docs, found).first()["ids"] is None and codec.encode(docs, arrow_only(found)).first()["ids"] is None
    assert codec.decode(codec.encode(docs, found), found).count() == 1


def test_the_longest_special_wins(spark):
    found = arrow_only(train.train(frame(spark, TEXTS), 256), SPECIALS)
    ids = codec.encode(frame(spark, [f"a{END_OF_TEXT * 2}\n\nb{END_OF_TEXT}"]), found).first()["ids"]
    one, two = (found.ids[s.encode()] for s in SPECIALS)
    assert ids == [97, two, 10, 10, 98, one]
    assert codec.decode_ids(ids, found) == f"a{END_OF_TEXT * 2}\n\nb{END_OF_TEXT}"


def test_lowest_rank_first_over_the_same_vocabulary(spark):
    """Ranks of a public vocabulary, whose merges don't all fold in order."""
    import base64

    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    pairs = [(t[:i], t[i:]) for t in sorted(ranks, key=ranks.get)[256:2000] for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    small = {t: r for t, r in ranks.items() if r < 2000}
    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=small, special_tokens={})
    order = {p: small[p[0] + p[1]] for p in pairs}
    for text in TEXTS:
        ours = [i for w in regex.findall(P.PATTERN, text) for i in codec.merge_word(w.encode(), order, small)]
        assert ours == theirs.encode_ordinary(text)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(-3, 300), max_size=12))
def test_decoding_never_fails(ids):
    found = train.Tokenizer(train.base_vocab([]), [])
    assert codec.decode_ids(ids, found) == b"".join(bytes([i]) if 0 <= i < 256 else b"\xef\xbf\xbd" for i in ids).decode("utf-8", "replace")


def test_spark_decodes_as_python_does(spark):
    import random

    rng = random.Random(3)
    cases = [[rng.choice([rng.randrange(256), 195, 226, 999]) for _ in range(rng.randrange(9))] for _ in range(300)]
    found = train.Tokenizer(train.base_vocab([]), [])
    got = codec.decode(spark.createDataFrame(list(enumerate(cases)), "doc_id long, ids array<int>"), found).collect()
    assert {r["doc_id"]: r["text"] for r in got} == {i: codec.decode_ids(c, found) for i, c in enumerate(cases)}


def test_vocabulary_details():
    found = train.Tokenizer({0: b"a", 1: b"a", 2: b"b", 3: b"ab"}, [(b"x", b"y"), (b"a", b"b"), (b"a", b"b")])
    assert found.ids[b"a"] == 0
    assert codec.usable_ranks(found) == {(b"a", b"b"): 2}
    assert codec.with_specials(found, ["ab", "<s>"]).vocab[4] == b"<s>"
    assert codec.end_id(found, "b") == 2 and codec.fits_uint16(found)
    with pytest.raises(ValueError):
        codec.end_id(train.Tokenizer(train.base_vocab([]), []), "ab")
