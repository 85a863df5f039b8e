"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages.  Every passage is encoded from its bytes and words
(shares of byte-class pairs, hashed words, a few surface figures) through a learned
layer; gated attention weights, learned from document labels alone, say how much each
passage counts; the weighted passage representation is scored by a logistic output.

The network is small and is fitted on a bounded sample of labelled documents: the first
by hash order, at most ``SAMPLE`` of them with ``SAMPLE_BYTES`` of text together, those
over ``LARGEST`` bytes excepted.  A sampled document takes part with all its passages.
Scoring reads all passages of every text in one pass, without a shuffle.

Defined results: null and empty texts are one empty passage and get a score; without
labels every score is 0.5; labels that repeat count once, by the largest; of rows that
share a labelled doc_id the shortest text is learned from; null ids have no label;
repeated rows are scored each; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, SPACE, Spans, chunks, flat, words

#: Bounds of the training sample: documents, bytes of text of all of them and of one.
SAMPLE, SAMPLE_BYTES, LARGEST = 6000, 16 << 20, 1 << 20
#: Bytes of a passage.
PASSAGE = 512
#: A document is accepted from this score on.
ACCEPT = 0.3

CLASS = np.full(256, 15, np.uint8)
for _k, _bytes in enumerate((b"aeiou", b"bcdfghjklmnpqrstvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\t\n\x0b\x0c\r", b".", b",;:", b"!?", b"|", b"#$%&*+=^~<>", b"()[]{}\"'`", b"/\\@_-")):
    CLASS[list(_bytes)] = _k
CLASS[128:] = 13
CLASSES, BUCKETS = 16, 256
FEATURES = CLASSES * CLASSES + BUCKETS + 6
#: Passages that are encoded at once.
BATCH = 2048


class Passages:
    """All passages of some texts.  ``first`` is the first passage of each text; features are made for a run of passages at a time."""

    def __init__(self, text: pa.Array):
        self.data, offsets = flat(text)
        sizes = np.diff(offsets)
        count = np.maximum(1, -(-sizes // PASSAGE))
        self.first = np.concatenate([[0], np.cumsum(count)])
        doc = np.repeat(np.arange(len(sizes)), count)
        self.start = offsets[:-1][doc] + (np.arange(len(doc)) - self.first[:-1][doc]) * PASSAGE
        self.stop, self.size = np.minimum(self.start + PASSAGE, offsets[1:][doc]), sizes[doc]
        begin, end, _ = words(self.data, offsets)
        self.word, self.bucket = begin, (Spans(LOWER[self.data])(begin, end) >> np.uint64(56)).astype(np.int64)

    def runs(self):
        """Feature rows of all passages, ``BATCH`` at once."""
        for a in range(0, len(self.start), BATCH):
            yield self.features(a, min(a + BATCH, len(self.start)))

    def features(self, a: int, b: int) -> np.ndarray:
        lo, hi, size = self.start[a:b], self.stop[a:b], self.size[a:b]
        out = np.zeros((b - a, FEATURES), np.float32)
        n, rows = hi - lo, np.arange(b - a)
        row = np.repeat(rows, n)
        byte = self.data[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        kind = CLASS[byte].astype(np.int64)
        pair = (row[:-1] * CLASSES + kind[:-1]) * CLASSES + kind[1:]
        pair = pair[row[1:] == row[:-1]]
        table = np.bincount(pair, minlength=len(rows) * CLASSES * CLASSES).reshape(len(rows), -1)
        out[:, : CLASSES * CLASSES] = np.sqrt(table / np.maximum(n - 1, 1)[:, None])
        # A word belongs to the passage that it begins in.
        own = slice(*np.searchsorted(self.word, [lo[0], hi[-1]]))
        at = np.searchsorted(lo, self.word[own], "right") - 1
        hashed = np.bincount(at * BUCKETS + self.bucket[own], minlength=len(rows) * BUCKETS).reshape(len(rows), -1)
        count = hashed.sum(1)
        out[:, CLASSES * CLASSES : -6] = np.sqrt(hashed / np.maximum(count, 1)[:, None])
        # Repeated lines and words show in how many slots of a small table the passage's 4-byte strings fill.
        gram = np.zeros(len(byte), np.uint32)
        for k in range(4):
            gram[: max(len(byte) - k, 0)] += byte[k:].astype(np.uint32) << np.uint32(8 * k)
        slots = np.zeros((len(rows), 1024), bool)
        slots[row, (gram * np.uint32(2654435761)) >> np.uint32(22)] = True
        dense = n - np.bincount(row[SPACE[byte]], minlength=len(rows))
        out[:, -6:] = np.stack([np.log1p(n) / 6, np.log1p(size) / 10, dense / np.maximum(count, 1) / 10, slots.sum(1) / np.maximum(n, 1), (size == 0).astype(float), np.ones(len(rows))], 1)
        return out


class Attention:
    """Gated attention over the passages of a document: encoder E, gates V and U, attention w, output c."""

    def __init__(self, seed: int = 7, hidden: int = 32, gate: int = 16):
        rng = np.random.default_rng(seed)
        small = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"E": small(FEATURES, hidden), "V": small(hidden, gate), "U": small(hidden, gate), "w": small(gate, 1), "c": small(hidden, 1) * 0, "b": np.zeros((1, 1), np.float32)}
        self.mean, self.scale = np.zeros(FEATURES, np.float32), np.ones(FEATURES, np.float32)

    def encode(self, x: np.ndarray):
        """Standardised features, passage vectors, both gates and attention energies."""
        p, z = self.p, (x - self.mean) * self.scale
        h = np.tanh(z @ p["E"])
        v, u = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        return z, h, v, u, ((v * u) @ p["w"])[:, 0]

    def gather(self, h: np.ndarray, e: np.ndarray, first: np.ndarray):
        """Attention weights, weighted passage vectors, each passage's document, and scores."""
        at = first[:-1]
        doc = np.repeat(np.arange(len(at)), np.diff(first))
        e = np.exp(e - np.maximum.reduceat(e, at)[doc])
        a = e / np.add.reduceat(e, at)[doc]
        bag = np.add.reduceat(h * a[:, None], at)
        logit = (bag @ self.p["c"] + self.p["b"])[:, 0]
        return a, bag, doc, 1 / (1 + np.exp(-np.clip(logit, -30, 30)))

    def scores(self, runs, first: np.ndarray) -> np.ndarray:
        """Scores of documents whose passages' features come in runs; only passage vectors are kept of them."""
        kept = [self.encode(x)[1::3] for x in runs]
        return self.gather(np.concatenate([h for h, _ in kept]), np.concatenate([e for _, e in kept]), first)[-1].astype(float)

    def gradients(self, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        z, h, v, u, e = self.encode(x)
        a, bag, doc, s = self.gather(h, e, first)
        d_logit = ((s - y) / len(y))[:, None].astype(np.float32)
        d_bag = d_logit @ p["c"].T
        d_a = (h * d_bag[doc]).sum(1)
        d_e = a * (d_a - np.add.reduceat(a * d_a, first[:-1])[doc])
        d_vu = d_e[:, None] @ p["w"].T
        d_v, d_u = d_vu * u * (1 - v * v), d_vu * v * u * (1 - u)
        d_h = d_bag[doc] * a[:, None] + d_v @ p["V"].T + d_u @ p["U"].T
        d_z = d_h * (1 - h * h)
        return {"E": z.T @ d_z, "V": h.T @ d_v, "U": h.T @ d_u, "w": (v * u).T @ d_e[:, None], "c": bag.T @ d_logit, "b": d_logit.sum(0, keepdims=True)}

    def fit(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 3e-3, decay: float = 1e-4) -> Attention:
        self.mean = x.mean(0)
        self.scale = (1 / np.maximum(x.std(0), 1e-3)).astype(np.float32)
        rng, step = np.random.default_rng(11), 0
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        for epoch in range(epochs):
            order = rng.permutation(len(y))
            for i in range(0, len(y), batch):
                pick = order[i : i + batch]
                n = first[pick + 1] - first[pick]
                rows = np.repeat(first[pick] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                g = self.gradients(x[rows], np.concatenate([[0], np.cumsum(n)]), y[pick])
                step += 1
                pace = rate * (1 - epoch / epochs)
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    s[k] = 0.999 * s[k] + 0.001 * g[k] ** 2
                    self.p[k] = (self.p[k] * (1 - pace * decay) - pace * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self


def train(docs: DataFrame, labels: DataFrame, may_learn: Column) -> Attention:
    """Fits on a bounded sample of labelled rows where ``may_learn`` (a condition on doc_id) holds."""
    known = labels.where(may_learn & F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    text = F.coalesce("text", F.lit(""))
    size = F.octet_length(text).alias("size")
    # Sizes alone choose the texts: at most SAMPLE rows of figures are added up in one place.
    sizes = docs.select("doc_id", size).join(F.broadcast(sample), "doc_id").groupBy("doc_id", "quality").agg(F.min("size").alias("size")).where(F.col("size") <= LARGEST)
    so_far = F.sum("size").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = sizes.withColumn("so_far", so_far).where(F.col("so_far") <= SAMPLE_BYTES).drop("so_far")
    rows = docs.select("doc_id", text.alias("text"), size).join(F.broadcast(chosen), ["doc_id", "size"]).groupBy("doc_id", "quality").agg(F.min("text").alias("text"))

    def encode(batches):
        for batch in batches:
            bags = Passages(batch.column("text"))
            x = np.concatenate([r.astype(np.float16) for r in bags.runs()]) if batch.num_rows else np.zeros((0, FEATURES), np.float16)
            blobs = [x[i:j].tobytes() for i, j in zip(bags.first[:-1], bags.first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(blobs, pa.binary())], ["doc_id", "quality", "x"])

    found = rows.select("doc_id", "text", F.col("quality").cast("int").alias("quality")).repartition(16, "doc_id").mapInArrow(encode, "doc_id bigint, quality int, x binary").collect()
    found.sort(key=lambda r: (r["doc_id"], r["x"]))
    model = Attention()
    if not found:
        return model
    bags = [np.frombuffer(r["x"], np.float16).reshape(-1, FEATURES).astype(np.float32) for r in found]
    first = np.concatenate([[0], np.cumsum([len(b) for b in bags])])
    return model.fit(np.concatenate(bags), first, np.array([float(r["quality"] > 0) for r in found], np.float32))


def quality_scores(docs: DataFrame, labels: DataFrame, held_out: Column) -> DataFrame:
    """Scores each row of docs (doc_id, text); labels (doc_id, quality) are learned from where ``held_out`` does not hold.

    Returns doc_id, held_out, score (0 to 1, higher: better) and predicted (1 from ACCEPT on).
    """
    scored = apply(train(docs, labels, ~held_out), docs.select("doc_id", held_out.alias("held_out"), "text"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def apply(model: Attention, docs: DataFrame) -> DataFrame:
    """The columns of docs but its text, with score and predicted."""
    others = [c for c in docs.columns if c != "text"]

    def score(batches):
        for batch in batches:
            text, out = batch.column("text"), []
            _, offsets = flat(text)
            for i, j in chunks(offsets, 4 << 20):
                bags = Passages(text.slice(i, j - i))
                out.append(model.scores(bags.runs(), bags.first))
            s = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(s), pa.array((s >= ACCEPT).astype(np.int32))], [*others, "score", "predicted"])

    schema = docs.select(*others).schema.add("score", "double").add("predicted", "integer")
    return docs.mapInArrow(score, schema)
