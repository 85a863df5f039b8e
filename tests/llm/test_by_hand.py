"""The classifier's arithmetic and the shards' order against plain versions of both."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from neurofold.llm import quality, shard


def plain_scores(model, bags):
    """Every passage by its own: features, encoder, gates, attention over the bag, output."""
    p, out = {k: v.astype(float) for k, v in model.p.items()}, []
    for bag in bags:
        h = [np.tanh(((x - model.mean) * model.scale) @ p["E"]) for x in bag]
        e = [((np.tanh(v @ p["V"]) * (1 / (1 + np.exp(-(v @ p["U"]))))) @ p["w"]).item() for v in h]
        total = sum(math.exp(v - max(e)) for v in e)
        z = sum(math.exp(v - max(e)) / total * x for v, x in zip(e, h, strict=True))
        out.append(1 / (1 + math.exp(-(z @ p["c"] + p["b"][0]).item())))
    return np.array(out)


@pytest.fixture
def small():
    rng = np.random.default_rng(3)
    model = quality.Attention(seed=5)
    model.p = {k: rng.normal(0, 0.3, v.shape) for k, v in model.p.items()}
    model.mean, model.scale = rng.normal(0, 0.1, quality.FEATURES), rng.uniform(0.5, 2, quality.FEATURES)
    bags = [rng.normal(0, 0.2, (n, quality.FEATURES)) for n in (1, 4, 2, 7)]
    return model, bags, np.concatenate([[0], np.cumsum([len(b) for b in bags])])


def test_scores_of_bags_by_hand(small):
    model, bags, first = small
    x = np.concatenate(bags)
    got = model.scores(iter([x[:3], x[3:4], x[4:]]), first)
    assert got == pytest.approx(plain_scores(model, bags), rel=1e-6)


def test_gradients_are_those_of_the_loss(small):
    model, bags, first = small
    x, y = np.concatenate(bags), np.array([1.0, 0.0, 0.0, 1.0])

    def loss():
        s = plain_scores(model, bags)
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    found, rng = model.gradients(x, first, y), np.random.default_rng(1)
    for name, value in model.p.items():
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in value.shape)
            kept = value[at]
            value[at] = kept + 1e-5
            up = loss()
            value[at] = kept - 1e-5
            down = loss()
            value[at] = kept
            assert found[name][at] == pytest.approx((up - down) / 2e-5, rel=2e-3, abs=1e-7), (name, at)


def curve_index(point, bits):
    """Index of a point on the Hilbert curve: axes turned level by level, then their bits interleaved."""
    x = list(point)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(len(x)):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0], x[i] = x[0] ^ t, x[i] ^ t
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[-1] & q:
            t ^= q - 1
        q >>= 1
    h = 0
    for b in range(bits - 1, -1, -1):
        for v in x:
            h = h * 2 + (((v ^ t) >> b) & 1)
    return h


@pytest.mark.parametrize("block_rows", [5000, 4])
def test_shards_by_hand(spark, monkeypatch, block_rows):
    """Groups of equal texts in the order of the curve and their hash, cut where a group's middle passes a shard's share of bytes."""
    monkeypatch.setattr(shard, "BLOCK_ROWS", block_rows)
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["aa", "bé", "ccc"]) for _ in range(rng.randint(1, 40))) for _ in range(50)] + [None, "", "same"]
    rows = [(rng.choice([None, *range(30)]), rng.choice(texts), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", "s30", None])) for _ in range(160)] + [(None, "same", "en", "s1")] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    key = {r["text"]: r["k"] for r in docs.select("text", F.xxhash64(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("k")).distinct().collect()}
    groups = {}
    for _, text, lang, source in rows:
        raw = (text or "").encode()
        g = groups.setdefault((key[text], zlib.crc32(raw), len(raw) + 1), {"source": source or "", "lang": lang or "", "rows": 0})
        g["source"], g["lang"], g["rows"] = min(g["source"], source or ""), min(g["lang"], lang or ""), g["rows"] + 1
    cuts = spark.createDataFrame([(k[2],) for k in groups], "size long").agg(F.percentile_approx("size", [i / 16 for i in range(1, 16)], 10000)).first()[0]
    n = len(groups)
    code = lambda c, v: sum(g[c] < v for g in groups.values()) * 16 // n
    curve = {k: curve_index((code("source", g["source"]), code("lang", g["lang"]), sum(c < k[2] for c in cuts)), 4) for k, g in groups.items()}
    total, before, count, expected, starts = sum(k[2] * g["rows"] for k, g in groups.items()), 0, 0, {}, {}
    for k in sorted(groups, key=lambda k: (curve[k], k)):
        size = k[2] * groups[k]["rows"]
        s = min(math.floor((before + size / 2) * 5 / total), 4)
        starts.setdefault(s, count)
        expected[k] = (s, curve[k], list(range(count - starts[s], count - starts[s] + groups[k]["rows"])))
        before, count = before + size, count + groups[k]["rows"]
    got = {}
    by_crc = {(k[1], k[2]): k for k in groups}
    for r in shard.hilbert_shards(docs, 5).collect():
        got.setdefault(by_crc[r["text_crc32"], r["size"]], []).append((r["shard"], r["curve"], r["slot"]))
    assert {k: (v[0][0], v[0][1], sorted(x[2] for x in v)) for k, v in got.items()} == expected
    assert all(len({x[:2] for x in v}) == 1 for v in got.values())
