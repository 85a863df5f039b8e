"""Each text operator against a brute-force version on small tables with hard cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from neurofold.llm import decontaminate, jaccard, licences, lm, mix, quality, shard, substrings, token_counts
from neurofold.llm.common import crc_fold

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, component string, part int, token string, id bigint, n int"


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def cases(seed=3):
    """Copies, near copies, shared passages, empty, null, one-byte and long texts, repeated rows, a null id."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, base = say(70), say(120).split()
    texts = [None, "", " \t\n ", "a", "One two", "one  TWO", "aaaa " * 120, "é" * 150 + "KK", say(8000), passage, passage]
    texts += [f"{say(20)} {passage} {say(20)}" for _ in range(12)]
    texts += [say(rng.randint(1, 60)) for _ in range(20)]
    for edits in (0, 0, 1, 2, 3, 4, 6, 8, 12, 3, 4, 5, 6):
        words = list(base)
        for _ in range(edits):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        texts.append(" ".join(words))
    texts += ["released under the MIT License, see LICENSE", "under the mit\tlicense under-the mit license", "Licensed under CC BY-NC 4.0", "licensed under the Apache License, Version 2.0"]
    rows = [(i * 3, t, rng.choice(["en", "de", None]), rng.choice(["hot", "hot", "b", None]), len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[12], rows[0]]
    return [(*r, "x", 1, "y", 2, 3) for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(cases(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def listed(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def brute_repeats(texts, length):
    texts = [(t or "").encode() for t in texts]
    starts = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if starts[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((len(t), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def test_repeated_substrings(docs, empty):
    rows = cases()
    expected = sorted((r[0], *b) for r, b in zip(rows, brute_repeats([r[1] for r in rows], 200)))
    assert listed(substrings.repeated_substrings(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == expected
    assert substrings.repeated_substrings(empty).count() == 0


def test_repeated_substrings_where_keys_clash(docs, monkeypatch):
    """Entries with keys of two bits: nearly all clash, and their bytes decide.  Without their checks the keys alone would."""
    real = substrings.entries

    def few_keys(checks):
        def entries(data, offsets, length):
            own, low, high, key, whole, check = real(data, offsets, length)
            return own, low, high, key, whole >> np.uint64(62), check * checks

        return entries

    columns = ("doc_id", "n_removed", "n_spans", "kept_sha256")
    expected = listed(substrings.repeated_substrings(docs), *columns)
    for checks in (1, 0):
        monkeypatch.setattr(substrings, "entries", few_keys(np.int32(checks)))
        assert (listed(substrings.repeated_substrings(docs), *columns) == expected) == (checks == 1)


def test_repeated_substrings_of_long_texts_and_large_classes(spark, monkeypatch):
    """Texts over a stretch, repeats across its cuts, and a passage with many contexts whose class is dealt by content."""
    monkeypatch.setattr(substrings, "CLASS", 3)
    rng = random.Random(9)
    say = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    far = say(700)
    long = say((1 << 20) - 350) + far + say(1 << 18) + far[100:500] + "zq" * 400
    line = say(190)
    texts = [long, None, say(300) + far[50:400], "zq" * 150] + [say(rng.randint(0, 150)) + line + say(rng.randint(0, 150)) for _ in range(60)]
    texts += [t[3:] for t in texts[-5:]] + [t[:-7] + "#" for t in texts[-20:]]
    rows = [(i % 50, t) for i, t in enumerate(texts)]
    expected = sorted((r[0], *b) for r, b in zip(rows, brute_repeats(texts, 200)))
    got = substrings.repeated_substrings(spark.createDataFrame(rows, "doc_id long, text string"))
    assert listed(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == expected


def test_suffix_ranks_are_the_order_of_the_strings():
    rng = np.random.default_rng(1)
    text = rng.integers(97, 99, 3000).astype(np.uint8)
    text[1500:2300] = text[100:900]
    starts = np.arange(0, 2800)
    rank = substrings.suffix_ranks(text, starts, 200)
    strings = [text[s : s + 200].tobytes() for s in starts]
    place = {v: k for k, v in enumerate(sorted(set(strings)))}
    assert rank.tolist() == [place[v] for v in strings] and len(place) < len(starts)


def brute_jaccard(rows):
    sets = {}
    for r in rows:
        w = WORD.findall(lower(r[1]))
        sets[r[0]] = {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = list(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sets, find


@pytest.mark.parametrize("seed", [3, 4])
def test_ngram_jaccard(spark, seed, empty):
    rows = cases(seed)
    sets, find = brute_jaccard(rows)
    got = jaccard.near_duplicates(spark.createDataFrame(rows, SCHEMA))
    assert listed(got, "doc_id", "n_shingles", "component_id") == sorted((r[0], len(sets[r[0]]), find(r[0])) for r in rows)
    if seed == 3:
        assert jaccard.near_duplicates(empty).count() == 0


def test_ngram_jaccard_family(spark):
    """A family of edited copies, most of them linked through a centre only."""
    rng = random.Random(8)
    base = [f"b{i}" for i in range(90)]
    rows = []
    for i in range(250):
        words = list(base)
        for k in range(rng.choice([0, 1, 2, 3, 3, 4, 5])):
            words[rng.randrange(len(words))] = f"x{rng.randrange(500)}"
        rows.append((i, " ".join(words), "en", "s", 1, "x", 1, "y", 2, 3))
    sets, find = brute_jaccard(rows)
    got = jaccard.near_duplicates(spark.createDataFrame(rows, SCHEMA))
    assert listed(got, "doc_id", "component_id") == sorted((r[0], find(r[0])) for r in rows)


def test_deleted_interpolation(docs, empty):
    fold = crc_fold(F.col("doc_id"), 7)
    got = lm.deleted_interpolation(docs, fold != 2, fold == 5).collect()
    rows = cases()
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    tokens = lambda t: [*WORD.findall(lower(t)), None]
    counts = Counter(w for r in rows if not held(r[0]) for w in tokens(r[1]))
    total, distinct = sum(counts.values()), len(counts)
    expected = {r[0]: (held(r[0]), len(tokens(r[1])), sum(counts[w] > 0 for w in tokens(r[1])), sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in tokens(r[1]))) for r in rows}
    assert len(got) == len(rows)
    for r in got:
        a, n, known, base = expected[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (a, n, known, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert r["score"] < 0 and math.isfinite(r["score"])
    assert lm.deleted_interpolation(empty, F.lit(True), F.lit(False)).count() == 0


def test_ngram_jaccard_of_null_and_shared_ids(spark):
    """Each row is a document: classes without ids and classes that share one keep their links."""
    say = lambda k, n=30: " ".join(f"{chr(97 + (i * k) % 26)}{i}{k}" for i in range(n))
    rows = [(None, say(1)), (None, say(1) + " tail"), (5, say(1) + " end"), (6, say(2)), (6, say(3)), (9, say(3) + " tail"), (8, say(2) + " tail"), (None, say(4)), (None, say(4) + " x"), (6, None), (None, " ")]
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    names = [(None, 5), (None, 5), (5, 5), (6, 6), (6, 6), (9, 6), (8, 6), (None, None), (None, None), (6, 6), (None, None)]
    assert sorted(((r["doc_id"], r["component_id"]) for r in got), key=str) == sorted(names, key=str)


def brute_interpolation(rows):
    """log10 probabilities by dictionaries of n-grams and as many rounds of expectation-maximisation."""
    fold = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7
    texts = [(fold(r[0]), [*WORD.findall(lower(r[1])), None]) for r in rows]
    words, pairs = [Counter(), Counter()], [Counter(), Counter()]
    for f, t in texts:
        for k in range(2):
            if f != 2 and (k == 0 or f != 5):
                words[k].update(t)
                pairs[k].update(zip([None, *t], t))
    total, distinct = [sum(w.values()) for w in words], len(words[0])

    def estimates(t, k, a, w):
        c = words[k][a]
        bucket = min(int(math.log2(c)) + 1, lm.BUCKETS - 1) if c else 0
        return bucket, (pairs[k][a, w] / c if c else 0.0, words[k][w] / max(total[k], 1), 1 / (distinct + 1))

    held = [estimates(t, 1, a, w) for f, t in texts if f == 5 for a, w in zip([None, *t], t)]
    pooled = em([p for _, p in held])
    weights = {b: em([p for c, p in held if c == b]) for b in {b for b, _ in held}}
    out = []
    for _, t in texts:
        got = [estimates(t, 0, a, w) for a, w in zip([None, *t], t)]
        out.append(sum(math.log10(sum(x * y for x, y in zip(weights.get(b, pooled), p))) for b, p in got))
    return out


def em(p):
    p, lam = np.array(p), np.full(3, 1 / 3)
    for _ in range(60 + lm.ROUNDS):
        joint = p * lam
        lam = (joint / joint.sum(1, keepdims=True)).mean(0)
    return (lam + lm.LEAST_WEIGHT) / (1 + 3 * lm.LEAST_WEIGHT)


def test_interpolated_scores(docs):
    fold = crc_fold(F.col("doc_id"), 7)
    got = sorted((r["doc_id"], r["n_tokens"], r["score"]) for r in lm.deleted_interpolation(docs, fold != 2, fold == 5).collect())
    expected = sorted((r[0], len(WORD.findall(lower(r[1]))) + 1, s) for r, s in zip(cases(), brute_interpolation(cases())))
    assert [g[:2] for g in got] == [e[:2] for e in expected]
    assert [g[2] for g in got] == pytest.approx([e[2] for e in expected], rel=3e-3)


def test_counts_beyond_32_bits():
    from neurofold.llm.common import pack_counts, unpack_counts

    n = np.array([0, 1, 5_000_000_000, 2**52])
    assert unpack_counts(pack_counts(n)).tolist() == n.tolist()


def test_mixture_weights_are_likelier_than_a_uniform_mix():
    import numpy as np

    grid = np.array([[3, 40, 20, 100], [3, -200, 20, 10], [3, -200, -200, 1]])
    w = lm.fit_weights(grid)
    assert w.shape == (lm.BUCKETS, 3) and np.allclose(w.sum(1), 1) and w[3, 0] > 0.5


def test_trie_token_counts(docs, empty):
    import sentencepiece  # noqa: F401

    scores = token_counts.pieces()

    def count(word):
        best = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            size = len(word[end - 1].encode())
            options = [(best[end - 1][0] + token_counts.BYTE_SCORE * size, best[end - 1][1] - size)]
            options += [(best[b][0] + scores[word[b:end]], best[b][1] - 1) for b in range(end) if word[b:end] in scores]
            best.append(max(options))
        return -best[-1][1]

    memo = {}
    expected = []
    for r in cases():
        words = WORD.findall(r[1] or "")
        for w in words:
            if w not in memo:
                memo[w] = count(token_counts.MARK + w)
        expected.append((r[0], len(words), sum(memo[w] for w in words)))
    assert listed(token_counts.count_tokens(docs), "doc_id", "n_words", "n_tokens") == sorted(expected)
    assert token_counts.count_tokens(empty).count() == 0


def test_pivotal_mix(docs, empty):
    got = mix.pivotal_mix(docs).collect()
    rows = cases()
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    open_, target, left = set(order), {}, sum(sizes.values())
    while True:
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s] + 1e-9]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3 * sizes[s]
            left -= target[s]
            open_.remove(s)
        if not open_:
            break
    source = {r[0]: r[3] for r in rows}
    taken, largest = Counter(), Counter()
    assert len(got) == len(rows)
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(target[s])
        assert r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
        largest[s] = max(largest[s], r["size"])
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in order)
    assert listed(mix.pivotal_mix(docs.repartition(2)), "doc_id", "taken") == sorted((r["doc_id"], r["taken"]) for r in got)
    assert mix.pivotal_mix(empty).count() == 0


def test_hilbert_shards(docs, empty):
    rows = cases()
    got = shard.hilbert_shards(docs, 4).collect()
    encoded = {r[0]: (r[1] or "").encode() for r in rows}
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == sorted((r[0], len(encoded[r[0]]) + 1, zlib.crc32(encoded[r[0]])) for r in rows)
    by, total = {}, Counter()
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
        total[r["shard"]] += r["size"]
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and set(by) <= set(range(4))
    groups = Counter()
    for r in rows:
        groups[encoded[r[0]]] += len(encoded[r[0]]) + 1
    assert max(total.values()) - sum(total.values()) / 4 <= max(groups.values())
    at = {}
    for r in got:
        assert at.setdefault(encoded[r["doc_id"]], r["shard"]) == r["shard"]
    assert shard.hilbert_shards(empty).count() == 0


def test_hilbert_shards_tell_sources_with_a_common_beginning_apart(spark):
    names = [f"wikipedia_{k}" for k in ("de", "en", "fr", "pl")]
    rows = [(i, f"text {i:04d}", "en", names[i % 4]) for i in range(400)]
    got = shard.hilbert_shards(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), 4).collect()
    held = {}
    for r in got:
        held.setdefault(r["shard"], set()).add(names[r["doc_id"] % 4])
    assert len(got) == 400 and sorted(map(sorted, held.values())) == [[n] for n in names]


def test_hilbert_index_is_a_walk(spark):
    """Neighbours on the curve are neighbours in space, and every cell has its own index."""
    cell = spark.range(512).select((F.col("id") % 8).alias("a"), (F.floor(F.col("id") / 8) % 8).alias("b"), F.floor(F.col("id") / 64).alias("c"))
    rows = cell.select(shard.hilbert_index([F.col("a"), F.col("b"), F.col("c")], 3).alias("h"), "a", "b", "c").collect()
    walk = [tuple(r)[1:] for r in sorted(rows)]
    assert sorted(r["h"] for r in rows) == list(range(512))
    assert all(sum(abs(x - y) for x, y in zip(p, q)) == 1 for p, q in zip(walk, walk[1:]))


def test_licences(docs, empty):
    expected = {}
    for r in cases():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(r[1]))
        hits = [(i, label) for phrase, label in licences.PHRASES.items() for p in [phrase.split()] for i in range(len(words)) if words[i : i + len(p)] == p]
        at = [i for i, _ in hits]
        expected[r[0]] = (len(words), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits})))
    got = licences.scan(docs).collect()
    assert len(got) == len(cases())
    for r in got:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == expected[r["doc_id"]]
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1
    assert licences.scan(empty).count() == 0


def test_licence_templates_add_labels(spark):
    text = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and so on"
    r = licences.scan(spark.createDataFrame([(1, text), (2, "nothing of that kind")], "doc_id long, text string")).collect()
    assert {x["doc_id"]: x["labels"] for x in r} == {1: "mit", 2: ""}


def test_licences_repeated_rows_and_null_ids(spark):
    """Two of five rare words stay two whatever the copies, and rows without an id keep the method's labels."""
    granted = "licensed under the gnu lesser general public license"
    rows = [(1, "mit license"), (2, "mit license"), (2, "mit license"), (None, "mit license"), (None, "mit license"), (3, granted), (None, granted), (None, granted), (4, "nothing of that kind")]
    got = licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["labels"]) for r in got) == sorted((str(d), "lgpl" if t == granted else "") for d, t in rows)


def brute_distance(pattern, text):
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(row[i] + 1, new[i - 1] + 1, row[i - 1] + (p != c)))
        row = new
        best = min(best, row[-1])
    return best


def test_decontaminate(spark, empty):
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "zeta", "rho"]) + str(rng.randrange(9)) for _ in range(n))
    items = [(i, say(12)) for i in range(6)] + [(6, None), (7, ""), (8, "tiny")]
    texts = [None, "", "x tiny y", "TINY", "tin", say(200)]
    for _, t in items[:6]:
        edited = list(t)
        for _ in range(rng.randrange(4, 9)):
            edited[rng.randrange(len(edited))] = "#"
        texts += [f"{say(5)}  {t.upper()}\n{say(3)}", "".join(edited), f"{say(4)} {''.join(edited)} {say(9)}"]
    rows = [(i, t, "en", "s", 1, "x", 1, "y", 2, 3) for i, t in enumerate(texts)]
    rows.append(rows[7])
    norm = lambda t: " ".join(WORD.findall(lower(t)))
    expected = set()
    for d, t, *_ in rows:
        for i, item in items:
            n = norm(item)
            if n and (best := brute_distance(n, norm(t))) <= decontaminate.budget(len(n)):
                expected.add((d, i, best))
    got = decontaminate.contaminated(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id long, text string"))
    assert listed(got, "doc_id", "item_id", "distance") == sorted(expected) and len(expected) >= 10
    assert decontaminate.contaminated(empty, spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert decontaminate.contaminated(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_decontaminate_searches_the_stated_rate(spark):
    """A fixed tenth of the bytes, whatever the module's own budget says: short items, items at the edge, one past it."""
    rng = random.Random(11)
    say = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 9))) for _ in range(n))
    items = [(i, say(40)[:n].strip() + "z") for i, n in enumerate([9, 11, 15, 19, 22, 29, 33, 47, 80, 81, 100, 150, 229])]
    rows = []
    for _, item in items:
        allowed = len(item) // 10
        for edits in (allowed, allowed, allowed, allowed + 1):
            edited = list(item)
            # Evenly dealt, so that no long piece stays whole.
            for e in range(edits):
                at = (2 * e + 1) * len(item) // (2 * edits)
                edited[at] = rng.choice(["#", "", edited[at] + "#"])
            rows.append((len(rows), f"{say(3)} {''.join(edited)} {say(4)}"))
    expected = {(d, i, b) for d, t in rows for i, item in items if (b := brute_distance(item, t)) <= len(item) // 10}
    got = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert listed(got, "doc_id", "item_id", "distance") == sorted(expected)
    assert {i for _, i, b in expected if b == len(items[i][1]) // 10} >= set(range(1, len(items)))
    assert {r["item_id"]: r["budget"] for r in got.collect()} == {i: len(items[i][1]) // 10 for _, i, _ in expected}


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scored = quality.quality_scores(docs, labels, crc_fold(F.col("doc_id"), 5) == 0)
    rows = scored.where("held_out").join(labels, "doc_id").select("score", "quality", "predicted").collect()
    good, bad = [r["score"] for r in rows if r["quality"] == 1], [r["score"] for r in rows if r["quality"] == 0]
    auc = sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))
    kept = sum(r["predicted"] for r in rows if r["quality"] == 1) / len(good)
    rejected = sum(1 - r["predicted"] for r in rows if r["quality"] == 0) / len(bad)
    print("held-out AUC", auc, "good kept", kept, "bad rejected", rejected)
    assert auc > 0.9 and kept > 0.95


def test_quality_hard_cases(docs, empty, spark):
    labels = spark.createDataFrame([(0, 1, 0), (3, None, 0), (6, 0, 1), (9, 1, 0), (9, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.quality_scores(docs, labels, F.lit(False)).collect()
    assert len(got) == len(cases()) and all(0 <= r["score"] <= 1 for r in got)
    assert quality.quality_scores(empty, labels, F.lit(False)).count() == 0
    assert {r["score"] for r in quality.quality_scores(docs, labels.limit(0), F.lit(False)).collect()} == {0.5}


def test_shards_prune_metadata(spark):
    """A predicate on source, lang and size meets few of the shards' value ranges; shards dealt at random meet it nearly everywhere."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = shard.hilbert_shards(docs, 16).join(docs.select("doc_id", "source", "lang"), "doc_id").select("shard", "source", "lang", "size").collect()

    def touched(of):
        boxes = {}
        for r in rows:
            boxes.setdefault(of(r), []).append(r)
        span = {s: [(min(v), max(v)) for v in zip(*((r["source"] or "", r["lang"] or "", r["size"]) for r in b))] for s, b in boxes.items()}
        asked = {(r["source"] or "", r["lang"] or "", r["size"]) for r in rows[::37]}
        return sum(all(lo <= v <= hi for v, (lo, hi) in zip(a, s)) for a in asked for s in span.values()) / len(asked) / len(span)

    curve, chance = touched(lambda r: r["shard"]), touched(lambda r: zlib.crc32(repr(tuple(r)[1:]).encode()) % 16)
    print("shards that a point of (source, lang, size) meets:", curve, "dealt at random:", chance)
    assert curve < 0.5 * chance


def test_decontaminate_ties_and_long_items(spark):
    """Equal items, items of several kilobytes, a null item id, repeated rows, matches at both ends."""
    rng = random.Random(12)
    say = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n))
    long, short = say(700), say(9)
    items = [(1, long), (2, long.upper()), (None, short), (3, short + " " + say(4))]
    near = list(long)
    for at in range(0, len(near), 40):
        near[at] = "#"
    rows = [(1, long), (1, long), (2, "".join(near) + say(3)), (3, say(5) + " " + short), (4, short + say(2)), (5, say(200))]
    got = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {(r["doc_id"], r["item_id"]): r["distance"] for r in got}
    assert len(got) == len(found) and found == {(1, 1): 0, (1, 2): 0, (2, 1): len(range(0, len(near), 40)), (2, 2): len(range(0, len(near), 40)), (3, None): 0, (4, None): 0}


def test_mix_of_rows_that_repeat_beyond_a_block(spark, monkeypatch):
    monkeypatch.setattr(mix, "BLOCK_ROWS", 20)
    rows = [(1, "one two three", "a")] * 150 + [(k, "four five", "b") for k in range(40)] + [(None, "six", None)] * 30
    got = mix.pivotal_mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)).collect()
    assert len(got) == len(rows) and all(0 <= r["taken"] <= 3 * r["size"] and r["taken"] % max(r["size"], 1) == 0 for r in got)
    for size in {r["source_size"] for r in got}:
        own = [r for r in got if r["source_size"] == size]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 3


def test_trie_of_long_words_and_a_bound_on_nodes(monkeypatch):
    """A word of 100,000 characters, and a trie that is begun anew on the way: the same counts as word by word."""
    scores = {"a": -1.0, "b": -1.5, "ab": -1.2, "abc": -4.0, "bab": -2.0}
    rng = random.Random(3)
    tokens = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 12))) for _ in range(300)] + ["ab" * 50_000]
    alone = [token_counts.Trie(scores).count(t) for t in tokens]
    assert alone[-1] == 50_000 and token_counts.Trie(scores).counts(tokens) == alone
    monkeypatch.setattr(token_counts, "NODES", 40)
    assert token_counts.Trie(scores).counts(tokens) == alone


def test_long_words_are_scored_beyond_the_trie(spark, monkeypatch):
    """A word longer than the trie keeps is counted as by one that keeps all of it; the trie stays small."""
    scores = token_counts.pieces()
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeést") for _ in range(n)) for n in (255, 256, 257, 300, 5000)] + ["the" * 400, "漢" * 500]
    plain = token_counts.Trie(scores)
    monkeypatch.setattr(token_counts, "DEPTH", 1 << 30)
    whole = plain.counts([token_counts.MARK + w for w in words])
    monkeypatch.undo()
    bounded = token_counts.Trie(scores)
    assert bounded.counts([token_counts.MARK + w for w in words]) == whole
    assert len(bounded.best) <= 1 + token_counts.DEPTH * len(words) < len(plain.best)


def test_distinct_words_are_told_apart_by_bytes():
    data = np.frombuffer(b"  aa b aa  \tb aa", np.uint8)
    begin, stop, _ = token_counts.words(data, np.array([0, len(data)]))
    distinct, slot = token_counts.distinct_words(data, begin, stop)
    assert [distinct[k] for k in slot] == [b"aa", b"b", b"aa", b"b", b"aa"] and sorted(distinct) == [b"aa", b"b"]
