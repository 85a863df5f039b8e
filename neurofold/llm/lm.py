"""Language-model scores by deleted interpolation.

Bigram and unigram maximum-likelihood estimates and a uniform floor are mixed;
the mixture weights depend on how often the context occurs (buckets of its
frequency, in octaves) and are learned by expectation-maximisation on held-out
counts: one fold of the training documents is scored by counts from which the
fold itself has been deleted.  The rounds begin on a grid of rounded estimates, which
is small, and end on the estimates themselves.

Words and word pairs are counted with ``common.counted``: parts of documents send
each distinct key once, so the work and the traffic follow the corpus, hot words
cost one entry a part, and no count table is broadcast.

Defined results: a null text is empty and still has the end token; without any training
token every base probability is 1 and every score the uniform floor; a null doc_id counts
as the empty text in the fold conditions of the query; repeated rows and repeated ids are
scored, and counted, each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Spans, chunks, counted, expand, flat, materialise, mix, pack_counts, parcels, part_count, squeeze, text_size, unpack_counts, unparcel, words

#: The end token's key; words get hashed keys.
END = np.uint64(0x5DEECE66D1234567)
PAIR = np.uint64(0x9E6C63D0876A9A47)
PAIRED = np.uint64(0xD1B54A32D192ED03)
#: Contexts are bucketed by the octave of their training frequency.
BUCKETS = 24
#: Grid of the first held-out statistics: steps per decade, and decades that a ratio of estimates spans.
STEPS, DECADES = 16, 12
#: Most exact rounds of expectation-maximisation, the change of a weight that ends them, and a weight's floor.
ROUNDS, CLOSE, LEAST_WEIGHT = 12, 1e-4, 1e-6


def tokens(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all tokens (words and an end token for each text) and where each text's tokens begin."""
    data, offsets = flat(text)
    keys, first, at = [], [np.zeros(1, np.int64)], 0
    for i, j in chunks(offsets):
        own = offsets[i : j + 1] - offsets[i]
        part = LOWER[data[offsets[i] : offsets[j]]]
        begin, stop, index = words(part, own)
        out = np.empty(len(begin) + j - i, np.uint64)
        ends = index[1:] + np.arange(j - i)
        is_word = np.ones(len(out), bool)
        is_word[ends] = False
        out[ends] = END
        out[is_word] = Spans(part)(begin, stop)
        keys.append(out)
        first.append(at + ends + 1)
        at += len(out)
    return (np.concatenate(keys) if keys else np.zeros(0, np.uint64)), np.concatenate(first)


def pairs(keys: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Keys of (previous token, token); a text's first token follows an end."""
    before = np.empty_like(keys)
    before[1:] = keys[:-1]
    before[first[:-1]] = END
    return mix(before * PAIRED + keys) ^ PAIR


def _split(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    rows = unparcel(table)
    keys, first = tokens(rows.column("text"))
    sizes = np.diff(first)
    train = np.repeat(rows.column("train").to_numpy(), sizes)
    fold = np.repeat(rows.column("fold").to_numpy(), sizes)
    return rows, keys, first, pairs(keys, first), train, fold


def _ranked(x: np.ndarray, *weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    every, slot = np.unique(x, return_inverse=True)
    return every, slot, [np.bincount(slot, w, len(every)).astype(np.int64) for w in weights]


def _keys(table: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
    _, one, _, two, train, fold = _split(table)
    a, _, counts_a = _ranked(one, train, fold)
    b, _, counts_b = _ranked(two, train, fold)
    every = np.concatenate([a, b])
    order = np.argsort(every)
    return every[order], [np.concatenate(x)[order] for x in zip(counts_a, counts_b, strict=True)]


TERMS = "part int, doc_id array<bigint>, held_out array<boolean>, size binary, known binary, logs binary, word binary, pair binary, learned bigint, ends bigint, deleted bigint, fresh bigint, fold_word binary, fold_pair binary, fold_before binary"


def _terms(table: pa.Table, totals: list[np.ndarray]) -> pa.Table:
    """A part's row: its documents, the counts that their tokens and pairs have, and for the fold's tokens those counts, and their contexts', less the fold.

    fresh: training tokens that this part was elected to count, so that the sum over parts is the vocabulary.
    """
    rows, one, first, two, train, fold = _split(table)
    every = np.unique(np.concatenate([one, two]))
    at_one, at_two = np.searchsorted(every, one), np.searchsorted(every, two)
    word, pair = totals[0][at_one], totals[0][at_two]
    here, sizes, trains, folds = np.unique(at_one), np.diff(first), rows.column("train").to_numpy(), rows.column("fold").to_numpy()
    per_doc = lambda x: np.add.reduceat(x, first[:-1]) if len(x) else x
    rest = word - totals[1][at_one]
    before = np.empty_like(rest)
    before[1:] = rest[:-1]
    end = np.searchsorted(every, END)
    before[first[:-1]] = totals[0][end] - totals[1][end] if len(every) else 0
    mine = fold > 0
    return pa.table(
        {
            "part": table.column("part")[:1],
            "doc_id": pa.array([rows.column("doc_id").to_pylist()], pa.list_(pa.int64())),
            "held_out": pa.array([(trains == 0).tolist()], pa.list_(pa.bool_())),
            "size": pa.array([pack_counts(sizes)], pa.binary()),
            "known": pa.array([pack_counts(per_doc((word > 0).astype(np.int64)))], pa.binary()),
            "logs": pa.array([squeeze(per_doc(np.log10(word + 1.0)))], pa.binary()),
            "word": pa.array([pack_counts(word)], pa.binary()),
            "pair": pa.array([pack_counts(pair)], pa.binary()),
            "learned": pa.array([int(train.sum())], pa.int64()),
            "ends": pa.array([int(trains.sum())], pa.int64()),
            "deleted": pa.array([int((sizes * folds).sum())], pa.int64()),
            "fresh": pa.array([int(((totals[2][here] > 0) & (totals[0][here] > 0)).sum())], pa.int64()),
            "fold_word": pa.array([pack_counts(rest[mine])], pa.binary()),
            "fold_pair": pa.array([pack_counts((pair - totals[1][at_two])[mine])], pa.binary()),
            "fold_before": pa.array([pack_counts(before[mine])], pa.binary()),
        }
    )


def _estimates(word: np.ndarray, pair: np.ndarray, context: np.ndarray, total: int, vocabulary: int):
    """Context bucket, pair estimate, word estimate and the floor for tokens with these counts."""
    bucket = np.minimum(np.log2(np.maximum(context, 1)).astype(np.int64) + (context > 0), BUCKETS - 1)
    return bucket, np.where(context > 0, pair / np.maximum(context, 1), 0.0), word / max(total, 1), 1.0 / (vocabulary + 1)


def _fold(batches, total: int, vocabulary: int):
    """Estimates of the fold's tokens, part by part, by counts without the fold (total: training tokens without it)."""
    for batch in batches:
        for word, pair, before in zip(*(batch.column(c).to_pylist() for c in ("fold_word", "fold_pair", "fold_before")), strict=True):
            yield _estimates(unpack_counts(word), unpack_counts(pair), unpack_counts(before), total, vocabulary)


def _grid(parts):
    """Counts the fold's tokens on a grid of (context bucket, pair estimate / floor, word estimate / floor)."""
    for bucket, two, one, floor in parts:
        if len(bucket):
            step = lambda p: np.where(p > 0, np.clip(np.round(np.log10(np.maximum(p, 1e-300) / floor) * STEPS), -STEPS * DECADES, STEPS * DECADES), -(STEPS * DECADES + 1)).astype(np.int64)  # noqa: B023, E731
            keys, n = np.unique(np.stack([bucket, step(two), step(one)], 1), axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(k) for k in (*keys.T, n)], ["bucket", "two", "one", "n"])


def _shares(parts, weights: np.ndarray):
    """The expectation step: how many of each bucket's tokens fall to the pair, the word and the floor estimate."""
    for bucket, two, one, floor in parts:
        joint = np.stack([two, one, np.full(len(two), floor)], 1) * weights[bucket]
        joint /= joint.sum(1, keepdims=True)
        got = [np.bincount(bucket, joint[:, k], BUCKETS) for k in range(3)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), *map(pa.array, got)], ["bucket", "two", "one", "floor"])


def fit_weights(grid: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Mixture weights (pair, word, floor) of each context bucket by expectation-maximisation over the grid, from where the exact rounds go on.

    grid: rows of bucket, steps of the pair and word estimates over the floor, count.  A bucket without held-out tokens gets the pooled weights.
    """
    weights = np.full((BUCKETS, 3), 1 / 3)
    value = lambda s: np.where(s < -STEPS * DECADES, 0.0, 10.0 ** (s / STEPS))
    pooled = None
    for bucket in [None, *range(BUCKETS)]:
        rows = grid if bucket is None else grid[grid[:, 0] == bucket]
        lam = np.full(3, 1 / 3)
        if len(rows):
            p = np.stack([value(rows[:, 1]), value(rows[:, 2]), np.ones(len(rows))], 1)
            for _ in range(rounds):
                joint = p * lam
                lam = ((joint / joint.sum(1, keepdims=True)) * rows[:, 3:4]).sum(0) / rows[:, 3].sum()
            lam = floored(lam)
        elif pooled is not None:
            lam = pooled
        if bucket is None:
            pooled = lam
        else:
            weights[bucket] = lam
    return weights


def floored(lam: np.ndarray) -> np.ndarray:
    """No weight is zero, so that every text has a probability."""
    return (lam + LEAST_WEIGHT) / (1 + 3 * LEAST_WEIGHT)


def deleted_interpolation(docs: DataFrame, train, fold) -> DataFrame:
    """Scores every row of docs (doc_id, text) by a bigram model that learns from rows where ``train`` holds.

    ``fold`` marks the training rows whose counts are deleted to learn the mixture weights.  Returns doc_id, held_out
    (not train), n_tokens, n_known, train_tokens, base_score (add-one unigram, log10) and score (log10 probability).
    """
    held = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), held(train).alias("train"), held(train & fold).alias("fold"))
    parts = part_count(text_size(docs))
    terms = materialise(counted(parcels(own, parts), _keys, _terms, TERMS, parts, told=2, elect=True), "lm-terms")
    total, vocabulary, ends, deleted = (x or 0 for x in terms.agg(F.sum("learned"), F.sum("fresh"), F.sum("ends"), F.sum("deleted")).first())
    folds = terms.where("deleted > 0").select("fold_word", "fold_pair", "fold_before")
    estimates = lambda batches: _fold(batches, total - deleted, vocabulary)
    grid = folds.mapInArrow(lambda batches: _grid(estimates(batches)), "bucket bigint, two bigint, one bigint, n bigint").groupBy("bucket", "two", "one").agg(F.sum("n").alias("n"))
    weights = fit_weights(np.array(grid.collect(), np.int64).reshape(-1, 4))
    # The grid rounds estimates; the last rounds take them as they are.
    for _ in range(ROUNDS if deleted else 0):
        step = folds.mapInArrow(lambda batches, at=weights: _shares(estimates(batches), at), "bucket bigint, two double, one double, floor double")
        got = np.array(step.groupBy("bucket").agg(F.sum("two"), F.sum("one"), F.sum("floor")).orderBy("bucket").drop("bucket").collect())
        seen = got.sum(1) > 0
        new = weights.copy()
        new[seen] = floored(got[seen] / got[seen].sum(1, keepdims=True))
        moved, weights = np.abs(new - weights).max(), new
        if moved < CLOSE:
            break

    def score(batches):
        for batch in batches:
            for r in batch.to_pylist():
                word, pair, sizes = unpack_counts(r["word"]), unpack_counts(r["pair"]), unpack_counts(r["size"])
                first = np.cumsum(sizes) - sizes
                before = np.empty_like(word)
                before[1:] = word[:-1]
                before[first] = ends
                bucket, two, one, floor = _estimates(word, pair, before, total, vocabulary)
                lam = weights[bucket]
                logs = np.add.reduceat(np.log10(lam[:, 0] * two + lam[:, 1] * one + lam[:, 2] * floor), first)
                base = expand(r["logs"]) - sizes * np.log10(total + vocabulary + 1.0)
                yield pa.RecordBatch.from_arrays([pa.array(r["doc_id"], pa.int64()), pa.array(r["held_out"], pa.bool_()), pa.array(sizes), pa.array(unpack_counts(r["known"])), pa.array(np.full(len(sizes), total)), pa.array(base), pa.array(logs)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return terms.select("doc_id", "held_out", "size", "known", "logs", "word", "pair").mapInArrow(score, schema)
