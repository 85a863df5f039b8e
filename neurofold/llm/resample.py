"""Importance resampling towards a target: documents are drawn by hashed n-gram weights plus Gumbel noise.

1. Every task counts its features (runs of one and two words) into an array of buckets; arrays are added up.
   The target's texts are counted alike, and a bucket's gain is the log ratio of both, a whole number.
2. A document's weight is the mean gain of its features, gathered from the gains' array; its score adds noise from a
   hash of its doc_id, so that the highest scores are a draw without replacement in proportion to exp(weight / 1000).
3. Every task orders its eligible documents in runs.  Splitters from the runs' fences cut the order into ranges of
   bounded rows; a range's slices of runs are merged by a tournament tree, which stops after the exact draw count
   and hands out ranks.  Ranges beyond the draw are not merged at all.

The order is (score descending, doc_id ascending with nulls last, a hash of the text, the row's place), so rows that
repeat, a third of the table or more, are split among ranges as well as others.  Scored rows are a written table; the
driver holds the buckets' gains and the splitters (at most ``MOST_RANGES``).

crc32 is linear: all words of a chunk are digested together byte by byte, and a pair's value is its first word's,
moved by the length of the second, combined with the second's.

Defined results: a null text has no features; documents without features have weight 0; documents under ``least_words``
have no rank; repeated rows and repeated or null ids are documents of their own (a null doc_id is hashed as no digits);
an empty table gives an empty result and an empty target is one without features; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK, LOWER, chunks, flat, materialise, words

BUCKETS, SCALE = 10_000, 1000
#: Rows of a run at most, rows from fence to fence, rows of a range, and how many ranges there are at least and at most.
RUN_ROWS, FENCE, RANGE_ROWS, LEAST_RANGES, MOST_RANGES = 1 << 20, 64, 50_000, 64, 16_384

OUTSIDE = np.ones(256, bool)
OUTSIDE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

# ---- crc32 of many words at once

FULL = np.uint32(0xFFFFFFFF)
#: Bytes of a word up to which it is digested with the others.
SHORT = 64


def _table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


TABLE = _table()


def _moves() -> np.ndarray:
    """moves[n, k, b]: what byte k of a register, being b, becomes n zero bytes later."""
    out = np.zeros((SHORT + 1, 4, 256), np.uint32)
    x = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(SHORT + 1):
        out[n] = x
        x = TABLE[x & 255] ^ (x >> 8)
    return out


MOVES = _moves()


def moved(register: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Registers after ``by`` (up to SHORT) zero bytes."""
    out = np.zeros(len(register), np.uint32)
    for k in range(4):
        out ^= MOVES[by, k, (register >> np.uint32(8 * k)) & np.uint32(255)]
    return out


def feature_buckets(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, paired: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words, and of the pairs whose first word is one of the indexes ``paired`` and whose second is the next."""
    size = ends - starts
    short = np.minimum(size, SHORT + 1).astype(np.uint8)
    order = np.argsort(SHORT + 1 - short, kind="stable")
    at, register = starts[order], np.zeros(len(starts), np.uint32)
    count = np.append(np.cumsum(np.bincount(short, minlength=SHORT + 2)[::-1])[::-1], 0)
    for k in range(SHORT):
        m = count[k + 1]
        if not m:
            break
        register[:m] = TABLE[(register[:m] ^ data[at[:m] + k]) & 255] ^ (register[:m] >> 8)
    own = np.empty_like(register)
    own[order] = register
    fits = np.minimum(size, SHORT)
    full = own ^ moved(np.full(len(own), FULL), fits)  # the register after the word alone
    second = paired + 1
    space = TABLE[(full[paired] ^ 0x20) & 255] ^ (full[paired] >> 8)
    pair = own[second] ^ moved(space, fits[second]) ^ FULL
    one = full ^ FULL
    for w in np.flatnonzero(size > SHORT):
        one[w] = zlib.crc32(data[starts[w] : ends[w]].tobytes())
    for p in np.flatnonzero((size[paired] > SHORT) | (size[second] > SHORT)):
        a, b = paired[p], second[p]
        pair[p] = zlib.crc32(data[starts[b] : ends[b]].tobytes(), zlib.crc32(data[starts[a] : ends[a]].tobytes() + b" "))
    return one % np.uint32(buckets), pair % np.uint32(buckets)


def featured(batch: pa.RecordBatch, buckets: int):
    """For runs of a batch's texts: buckets of their words and of their pairs, and the text (its row) of each word and pair.

    A text longer than a run is cut between words, and a stretch begins with the last word of the one before it, so that no
    pair is lost; the word itself is counted once.
    """
    data, offsets = flat(batch.column("text"))
    for i, j in chunks(offsets):
        at, stop, again = int(offsets[i]), int(offsets[j]), False
        stretched = j == i + 1 and stop - at > 2 * CHUNK
        while True:
            end = stretch_end(data, at, stop, 1 + again) if stretched else stop
            part = LOWER[data[at:end]]
            starts, ends, index = words(part, np.array([0, len(part)]) if stretched else offsets[i : j + 1] - at, OUTSIDE)
            follows = np.ones(len(starts), bool)
            follows[index[1:][index[1:] > 0] - 1] = False  # a text's last word begins no pair
            paired = np.flatnonzero(follows)
            one, two = feature_buckets(part, starts, ends, paired, buckets)
            text = i + np.repeat(np.arange(len(index) - 1), np.diff(index))
            yield one[again:], two, text[again:], text[paired]
            if end == stop:
                break
            at, again = at + int(starts[-1]), True


def stretch_end(data: np.ndarray, at: int, stop: int, least: int) -> int:
    """The last place within about CHUNK bytes that no word covers and that ``least`` words begin before; else further on, or the end."""
    reach = CHUNK
    while at + reach < stop:
        outside = OUTSIDE[LOWER[data[at : at + reach]]]
        last = reach - 1 - int(outside[::-1].argmax())
        if outside[last] and np.count_nonzero(outside[:last] & ~outside[1 : last + 1]) + (not outside[0]) >= least and last:
            return at + last
        reach *= 2
    return stop


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in all texts: an array of fixed size, whatever the input."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for one, two, _, _ in featured(batch, buckets):
                total += np.bincount(one, minlength=buckets) + np.bincount(two, minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(total[met])], ["bucket", "n"])

    found = np.zeros(buckets, np.int64)
    for row in docs.select("text").mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        found[row["bucket"]] = row["n"]
    return found


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the ratio of a bucket's smoothed shares in target and corpus)."""
    S, T = float(corpus.sum() + len(corpus)), float(target.sum() + len(target))
    return np.array([math.floor(SCALE * math.log((t + 1.0) * S / ((s + 1.0) * T))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-SCALE * math.log(-math.log((h + 0.5) / 4294967296)))


# ---- runs and their merge

KEY = ["neg", "none", "id", "tie", "run", "place"]
SCORED = "doc_id bigint, n_features bigint, weight bigint, score bigint, eligible boolean, neg bigint, none bigint, id bigint, tie bigint, run bigint, place bigint"


def scored(docs: DataFrame, gain: np.ndarray, least_words: int, seed: int, run_rows: int = RUN_ROWS) -> DataFrame:
    """n_features, weight and score of every document, with eligible ones in sorted runs: (run, place) is the row's own."""

    def score(batches):
        run, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            ids = batch.column("doc_id")
            numbers, valid = ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False)
            n_words, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for one, two, word_text, pair_text in featured(batch, len(gain)):
                n_words += np.bincount(word_text, minlength=len(n_words))
                np.add.at(total, word_text, gain[one])
                np.add.at(total, pair_text, gain[two])
            n = np.where(n_words > 0, 2 * n_words - 1, 0)
            weight = total // np.maximum(n, 1)
            drawn = np.array([noise(d if v else None, seed) for d, v in zip(numbers.tolist(), valid.tolist(), strict=True)], np.int64)
            held.append([numbers, n, weight, weight + drawn, n_words >= least_words, ~valid, batch.column("tie").to_numpy()])
            size += batch.num_rows
            if size >= run_rows:
                yield ordered(held, run)
                run, held, size = run + 1, [], 0
        if held:
            yield ordered(held, run)

    def ordered(held: list, run: int) -> pa.RecordBatch:
        doc_id, n, weight, total, eligible, none, tie = map(np.concatenate, zip(*held, strict=True))
        order = np.lexsort((tie, doc_id, none, -total, ~eligible))
        doc_id, n, weight, total, eligible, none, tie = (x[order] for x in (doc_id, n, weight, total, eligible, none, tie))
        columns = [pa.array(doc_id, mask=none), n, weight, total, pa.array(eligible), -total, none.astype(np.int64), doc_id, tie, np.full(len(n), run, np.int64), np.arange(len(n))]
        return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, pa.int64()) for x in columns], [c.split()[0] for c in SCORED.split(", ")])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("tie")).mapInArrow(score, SCORED)


def sort_keys(columns: list[np.ndarray]) -> list[bytes]:
    """Rows of 64-bit integers as byte strings in the same order."""
    wide = np.stack([c.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63) for c in columns], 1)
    raw, size = wide.astype(">u8").tobytes(), 8 * len(columns)
    return [raw[i : i + size] for i in range(0, len(raw), size)]


class Tournament:
    """A tree of losers over the heads of sorted runs; the champion's run goes on until the best of the others' heads."""

    END = b"\xff" * 64

    def __init__(self, runs: list[list[bytes]]):
        self.runs, self.at = runs, [0] * len(runs)
        self.leaves = 1 << max(0, (len(runs) - 1).bit_length())
        self.loser = [0] * self.leaves  # node 0 stands for nothing
        best = [0] * self.leaves + list(range(self.leaves))
        for node in range(self.leaves - 1, 0, -1):
            a, b = best[2 * node], best[2 * node + 1]
            best[node], self.loser[node] = (a, b) if self.head(a) <= self.head(b) else (b, a)
        self.champion = best[1]

    def head(self, run: int) -> bytes:
        return self.runs[run][self.at[run]] if run < len(self.runs) and self.at[run] < len(self.runs[run]) else self.END

    def take(self) -> tuple[int, int, int]:
        """(run, first, last): the next rows of the order, all from one run."""
        winner = run = self.champion
        node, others = (self.leaves + run) // 2, self.END
        while node > 0:
            others = min(others, self.head(self.loser[node]))
            node //= 2
        first = self.at[run]
        self.at[run] = last = max(first + 1, bisect_right(self.runs[run], others, first))
        node = (self.leaves + run) // 2
        while node:
            if self.head(self.loser[node]) < self.head(run):
                run, self.loser[node] = self.loser[node], run
            node //= 2
        self.champion = run
        return winner, first, last


def merged(table: pa.Table, limit: int) -> np.ndarray:
    """Row numbers of the first ``limit`` rows of the order of a table that holds slices of sorted runs."""
    column = lambda c: table.column(c).to_numpy()
    order = np.lexsort((column("place"), column("run")))  # slices as they were in their runs
    run = column("run")[order]
    cuts = np.append(np.flatnonzero(np.append(True, run[1:] != run[:-1])), len(run)).tolist()
    keys = sort_keys([column(c)[order] for c in KEY])
    tree, out, n = Tournament([keys[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]), [], 0
    while n < limit:
        run, first, last = tree.take()
        last = min(last, first + limit - n)
        out.append(order[cuts[run] + first : cuts[run] + last])
        n += last - first
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def splitters(rows: DataFrame, ranges: int) -> np.ndarray:
    """Keys that cut the order of eligible rows into ranges of about equal rows; from every FENCE-th row of each run."""
    fences = rows.where(f"eligible AND place % {FENCE} = 0").select(*KEY).repartitionByRange(ranges, *KEY)
    firsts = fences.groupBy(F.spark_partition_id()).agg(F.min(F.struct(*KEY)).alias("k")).select("k.*").collect()
    return np.array(sorted(map(tuple, firsts))[1:], np.int64).reshape(-1, len(KEY))


def in_ranges(rows: DataFrame, cuts: np.ndarray) -> DataFrame:
    """rows with their range: how many splitters are not after them."""

    def assign(batches):
        for batch in batches:
            mine = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in KEY], 1)
            every = np.concatenate([cuts, mine])
            order = np.lexsort((np.arange(len(every)) >= len(cuts), *every.T[::-1]))
            range_of = np.empty(len(every), np.int32)
            range_of[order] = np.cumsum(order < len(cuts))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(range_of[len(cuts) :])], [*batch.schema.names, "range"])

    return rows.mapInArrow(assign, f"{SCORED}, range int")


def importance_resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, buckets: int = BUCKETS, seed: int = 7, range_rows: int = RANGE_ROWS, run_rows: int = RUN_ROWS) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null if not drawn) of every row of docs (doc_id, text).

    Of the documents with at least ``least_words`` words, floor(percent * their number / 100) are drawn.
    """
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    rows = materialise(scored(docs, gain, least_words, seed, run_rows), "scored")
    eligible = rows.where("eligible")
    n = eligible.count()
    draw = percent * n // 100
    ranges = min(max(LEAST_RANGES, -(-n // range_rows)), MOST_RANGES)
    ranged = in_ranges(eligible, splitters(rows, ranges))
    starts, before = {}, 0
    for row in sorted(ranged.groupBy("range").count().collect()):
        starts[row["range"]], before = before, before + row["count"]
    last = max((r for r, start in starts.items() if start < draw), default=-1)
    result = "doc_id bigint, n_features bigint, weight bigint, score bigint, rank bigint"
    shown = ["doc_id", "n_features", "weight", "score"]

    def merge(table: pa.Table) -> pa.Table:
        start = starts[table.column("range")[0].as_py()]
        taken = merged(table, min(table.num_rows, draw - start))
        rank = np.zeros(table.num_rows, np.int64)
        rank[taken] = start + 1 + np.arange(len(taken))
        return table.select(shown).append_column("rank", pa.array(rank, mask=rank == 0))

    drawn = ranged.where(F.col("range") <= last).groupBy("range").applyInArrow(merge, result)
    none = F.lit(None).cast("long").alias("rank")
    return drawn.unionByName(ranged.where(F.col("range") > last).select(*shown, none)).unionByName(rows.where("NOT eligible").select(*shown, none))
