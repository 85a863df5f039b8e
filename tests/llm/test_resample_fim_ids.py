"""Importance resampling, fill-in-middle and token-id files against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from neurofold.llm import fim, resample, token_ids
from neurofold.llm.common import flat, words

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id bigint, text string, lang string, run int, rank int, path string, n int, form string, file string, start int"
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def cases():
    """Null, empty, short, long, sentinel and foreign texts, repeated rows, null and shared ids, clashing columns."""
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice(["the", "Cat", "naïve", "x9", "don't", "œuvre", "漢字", "a-b", "42", "\n\n", "  "]) for _ in range(n))
    texts = [None, "", " ", "é", "a <P> b", "<<M>", "x" * 300, "漢字かな" * 60, say(6000), "<|endoftext|> and <|endoftext|>!", "🤦🏼‍♂️ ok", "tail '", "\t\r\n"]
    texts += [say(rng.randint(15, 60)) for _ in range(60)]
    rows = [(i * 7 % 61, t) for i, t in enumerate(texts)] + [(None, say(30)), (None, None)] + [(None, "same text " * 12)] * 40 + [(5, "same text " * 12)] * 3
    return [(*r, "en", 1, 2, "p", 3, "f", "g", 4) for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(cases(), SCHEMA).repartition(7).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ---- op11


def features(text):
    w = WORD.findall((text or "").encode().lower())
    return w, w + [a + b" " + b for a, b in zip(w, w[1:])]


def drawn(rows, targets, percent, buckets=10_000):
    """(doc_id, n_features, weight, score, drawn) of each row, and the order of those drawn."""
    bucket = lambda f: zlib.crc32(f) % buckets
    s, t = Counter(), Counter()
    for _, x in rows:
        s.update(map(bucket, features(x)[1]))
    for x in targets:
        t.update(map(bucket, features(x)[1]))
    S, T = s.total() + buckets, t.total() + buckets
    out = []
    for d, x in rows:
        w, f = features(x)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * S / ((s[b] + 1) * T))) for b in map(bucket, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append((d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(w) >= 20))
    eligible = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    return out, eligible[: percent * len(eligible) // 100]


@pytest.mark.parametrize(("percent", "range_rows", "run_rows", "ranges"), [(25, 50_000, 1 << 20, 64), (60, 5, 3, 1), (100, 20, 4, 2), (0, 50, 10, 1)])
def test_resample(spark, docs, monkeypatch, percent, range_rows, run_rows, ranges):
    """Ranks are those of one sort, whatever the runs and ranges; a third of the rows are equal."""
    monkeypatch.setattr(resample, "LEAST_RANGES", ranges)
    monkeypatch.setattr(resample, "FENCE", 2)
    targets = ["The cat of naïve 42", None, "œuvre x9 cat"]
    rows = [r[:2] for r in cases()]
    target = spark.createDataFrame([(1, t) for t in targets], "item_id int, text string")
    got = [tuple(r) for r in resample.importance_resample(docs, target, percent, range_rows=range_rows, run_rows=run_rows).collect()]
    every, order = drawn(rows, targets, percent)
    plain = lambda rs: sorted(rs, key=lambda r: tuple((x is None, x or 0) for x in r))
    assert plain(r[:4] for r in got) == plain(r[:4] for r in every)
    ranked = sorted((r for r in got if r[4] is not None), key=lambda r: r[4])
    assert [r[4] for r in ranked] == list(range(1, len(order) + 1))
    assert [(r[0], r[3]) for r in ranked] == [(r[0], r[3]) for r in order]


def test_resample_of_empty_tables(spark, docs, empty):
    target = spark.createDataFrame([(1, "cat")], "item_id int, text string")
    assert resample.importance_resample(empty, target).count() == 0
    got = resample.importance_resample(docs, target.limit(0)).collect()
    assert len(got) == len(cases()) and sum(r["rank"] is not None for r in got) == sum(len(features(r[1])[0]) >= 20 for r in cases()) // 4


def test_feature_buckets_are_those_of_zlib():
    rng = random.Random(2)
    for sizes in ((1, 2, 5, 9), (63, 64, 65, 66, 300), (1, 64, 900)):
        w = [bytes(rng.choice(b"abc0\xc3\xa9") for _ in range(rng.choice(sizes))) for _ in range(80)]
        data = np.frombuffer(b" ".join(w), np.uint8)
        starts, ends, _ = words(data, np.array([0, len(data)]), resample.OUTSIDE)
        one, two = resample.feature_buckets(data, starts, ends, np.arange(len(w) - 1), 1 << 31)
        assert one.tolist() == [zlib.crc32(x) % (1 << 31) for x in w]
        assert two.tolist() == [zlib.crc32(a + b" " + b) % (1 << 31) for a, b in zip(w, w[1:])]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 30), max_size=12), max_size=9))
def test_tournament_merges_as_sorting_does(runs):
    runs = [sorted(bytes([x]) for x in r) for r in runs]
    tree, out = resample.Tournament(runs), []
    while len(out) < sum(map(len, runs)):
        run, first, last = tree.take()
        assert last > first
        out += runs[run][first:last]
    assert out == sorted(x for r in runs for x in r)


# ---- op12


def test_fill_in_middle(docs, empty):
    got = fim.restore(fim.fill_in_middle(docs)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    rows = sorted((r[:2] for r in cases()), key=key)
    assert len(got) == len(rows)
    assert sorted(((r["doc_id"], r["restored"]) for r in got), key=key) == [(d, t or "") for d, t in rows]
    forms = Counter()
    for r in got:
        d, t = r["doc_id"], r["restored"]
        digest = hashlib.sha256(f"1:{'' if d is None else d}".encode()).hexdigest()
        h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
        a, b = sorted((h[0] % (len(t) + 1), h[1] % (len(t) + 1)))
        forms[r["form"]] += 1
        assert r["n"] == len(t)
        if not t or re.search("<[PSM]>", t) or h[2] % 100 >= 90:
            assert (r["form"], r["output"], r["prefix_chars"], r["middle_chars"]) == ("plain", t, None, None)
        else:
            p, m, s = t[:a], t[a:b], t[b:]
            expected = ("spm", f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else ("psm", f"<P>{p}<S>{s}<M>{m}")
            assert (r["form"], r["output"], r["prefix_chars"], r["middle_chars"]) == (*expected, a, b - a)
    assert min(forms[f] for f in ("plain", "psm", "spm")) > 0
    assert fim.restore(fim.fill_in_middle(empty)).count() == 0


def test_units_of_words_and_lines(docs):
    text = "one  two\nthree\n\nfour"
    points = fim.code_points(text.encode())
    assert fim.boundaries(points, "word").tolist() == [0, 3, 5, 8, 9, 14, 16, 20]
    assert fim.boundaries(points, "line").tolist() == [0, 9, 15, 16, 20]
    for unit in ("word", "line"):
        for r in fim.restore(fim.fill_in_middle(docs, unit)).where("form <> 'plain'").collect():
            ends = set(fim.boundaries(fim.code_points(r["restored"].encode()), unit).tolist())
            assert {r["prefix_chars"], r["prefix_chars"] + r["middle_chars"]} <= ends
    with pytest.raises(ValueError):
        fim.fill_in_middle(docs, "page")


def test_bytes_that_are_not_utf8_come_back(spark):
    broken = spark.range(40).select(F.col("id").alias("doc_id"), F.expr("cast(x'61ff62c3' as string)").alias("text"))
    for r in fim.restore(fim.fill_in_middle(broken)).select("n", F.hex(F.col("restored").cast("binary")).alias("h")).collect():
        assert (r["n"], r["h"]) == (4, "61FF62C3")


# ---- op13


def brute_ids(rows):
    """(doc_id, start, n_tokens, crc) of rows in id order, by the library over whole texts."""
    tokenizer, at, out = Tokenizer.from_file(VOCABULARY), 0, []
    for d, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        out.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        at += len(ids)
    return out


@pytest.mark.parametrize("file_ids", [16 << 20, 700])
def test_token_ids(spark, docs, tmp_path, monkeypatch, file_ids):
    """Without repeated ids the order is one, so starts are compared too.  Files roll inside a task."""
    monkeypatch.setattr(token_ids, "FILE_IDS", file_ids)
    rows = {r[0]: r for r in cases() if r[0] is not None}
    plain = spark.createDataFrame(list(rows.values()), SCHEMA).repartition(5)
    token_ids.write_ids(plain, f"file://{tmp_path}/ids", VOCABULARY)
    got = token_ids.documents(spark, f"file://{tmp_path}/ids", ids=True).collect()
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"], r["ids"]) for r in got) == brute_ids(sorted(r[:2] for r in rows.values()))


def test_token_ids_of_repeated_and_null_ids(spark, docs, empty, tmp_path):
    token_ids.write_ids(docs, str(tmp_path / "ids"), VOCABULARY)
    token_ids.write_ids(docs, str(tmp_path / "ids"), VOCABULARY)  # a second write takes the first one's place
    got = sorted((tuple(r) for r in token_ids.documents(spark, str(tmp_path / "ids")).collect()), key=lambda r: r[1])
    expected = brute_ids([r[:2] for r in cases()])
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(((d, n, c) for d, _, n, c in got), key=key) == sorted(((d, n, c) for d, _, n, c, _ in expected), key=key)
    assert [r[1] for r in got] == np.cumsum([0, *(r[2] for r in got[:-1])]).tolist()
    assert [(r[0] is None, r[0] or 0) for r in got] == sorted((r[0] is None, r[0] or 0) for r in got)
    token_ids.write_ids(empty, str(tmp_path / "none"), VOCABULARY)
    assert token_ids.documents(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="no tokenizer at"):
        token_ids.write_ids(docs, str(tmp_path / "gone"), "/no/such/file")


def test_random_access(tmp_path):
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 50_000, 10_000).astype(np.uint32)
    raw = token_ids.encode_file(ids, np.array([1, 0]), np.array([True, False]), np.array([4_000, 6_000]))
    (tmp_path / "a.ids").write_bytes(raw)
    for a, b in ((0, 1), (1023, 1025), (5_000, 9_999), (9_999, 20_000), (7, 7)):
        assert token_ids.read_slice(str(tmp_path / "a.ids"), a, b).tolist() == ids[a:b].tolist()
    with pytest.raises(ValueError):
        (tmp_path / "b.ids").write_bytes(raw[:-8] + b"otherone")
        token_ids.read_slice(str(tmp_path / "b.ids"), 0, 1)


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 3000), st.integers(0, 32), st.integers(0, 32), st.floats(0, 1), st.integers(0, 10))
def test_blocks_round_trip(n, low, high, share, seed):
    """All widths, exceptions in any number, short last blocks; outliers do not widen a block that has few of them."""
    rng = np.random.default_rng(seed)
    ids = np.where(rng.random(n) < share, rng.integers(0, 1 << low, n), rng.integers(0, 1 << high, n)).astype(np.uint32)
    blob, starts = token_ids.pack_blocks(ids)
    assert token_ids.unpack_blocks(blob, starts)[:n].tolist() == ids.tolist()
    assert starts[-1] == len(blob) and len(starts) == -(-n // token_ids.BLOCK) + 1


def test_exceptions_are_listed():
    ids = np.full(1024, 100, np.uint32) + np.arange(1024, dtype=np.uint32) % 8
    ids[[5, 900]] = 49_000
    blob, _ = token_ids.pack_blocks(ids)
    assert len(blob) == 8 + 1024 * 3 // 8 + 2 * 6


LETTERS = st.sampled_from(list("abZ's't  \n\t.,'\"-_019éßœ×÷Łñ漢が 　‍🤦İ<|>") + ["<|endoftext|>", " don't", "'ll", "  x", "\r\n"])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(LETTERS, max_size=25).map("".join), max_size=5))
def test_pieces_give_the_ids_of_whole_texts(texts):
    import pyarrow as pa

    pieces = token_ids.pieces_of(VOCABULARY)
    ids, n = pieces.texts(*flat(pa.array(texts, pa.string())))
    cuts = np.cumsum([0, *n])
    whole = [e.ids for e in pieces.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:])] == whole


def test_long_texts_are_taken_in_stretches(monkeypatch):
    """Cut between words and where the tokenizer cuts, special tokens and words longer than a stretch whole."""
    import pyarrow as pa

    rng = random.Random(8)
    pieces = token_ids.pieces_of(VOCABULARY)
    monkeypatch.setattr(resample, "CHUNK", 40)
    monkeypatch.setattr("neurofold.llm.common.CHUNK", 40)
    monkeypatch.setattr(resample, "chunks", lambda o: resample_chunks(o, 40))
    from neurofold.llm.common import chunks as resample_chunks

    for _ in range(60):
        text = "".join(rng.choice(["the cat", " sat", "<|endoftext|>", "é" * 30, " " * 12, "x" * 150, ", ", "don't ", "\n", "漢字"]) for _ in range(60))
        data, offsets = flat(pa.array([text]))
        assert pieces.texts(data, offsets, 40)[0].tolist() == pieces.tokenizer.encode(text, add_special_tokens=False).ids
        texts = ["a b", text, None, "c", text[:100]]
        counts, of_words, of_pairs = Counter(), Counter(), Counter()
        for one, two, word_text, pair_text in resample.featured(pa.RecordBatch.from_arrays([pa.array(texts)], ["text"]), 10_000):
            counts.update(one.tolist() + two.tolist())
            of_words.update(word_text.tolist())
            of_pairs.update(pair_text.tolist())
        whole = [features(t) for t in texts]
        assert counts == Counter(zlib.crc32(f) % 10_000 for _, fs in whole for f in fs)
        assert [of_words[k] for k in range(5)] == [len(w) for w, _ in whole] and [of_pairs[k] for k in range(5)] == [len(f) - len(w) for w, f in whole]


def test_other_tokenizers_get_whole_texts():
    import pyarrow as pa

    pieces = token_ids.Pieces(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["Hello  World it's", "", "Ünder 12\n x"]
    ids, n = pieces.texts(*flat(pa.array(texts)))
    assert not pieces.cuttable and ids.tolist() == [i for e in pieces.tokenizer.encode_batch(texts, add_special_tokens=False) for i in e.ids] and len(n) == 3
