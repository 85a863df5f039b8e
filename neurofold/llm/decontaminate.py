"""Benchmark decontamination: approximate passage search by pieces and bit-parallel distances.

A test item of n bytes may occur with k edits.  Cut into k + 1 pieces, one piece must
occur unchanged (pigeonhole), so documents are scanned for exact piece hits: the first
n // (k + 1) bytes of every piece form a key, all keys of a document are one numpy
expression, and a bitmap passes the few that can be a piece.  The stated rate alone sets
k; pieces are as long as it leaves them.  A hit goes on if the window that the edits
allow has enough of the item's 4-grams (k edits spoil at most 4k of them, so no match is
lost), and hits on close diagonals are verified once with Myers' bit-parallel distance.

Texts and items are compared in lower case (A-Z) with white space collapsed.  Items go
out in blocks of bounded bytes, one scan of the documents per block, so nothing that is
sent to the executors grows with the benchmark; equal items are searched once.

Defined results: null and empty texts and items match nothing; the result has one row for
each (doc_id, item_id) with the least distance over the rows that share them, the earliest
end among equal ones; null ids are one id; an empty table on either side gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACE, chunks, flat

#: Edits allowed per byte of an item; bytes of items that one scan searches.
EDIT_RATE = 0.1
BLOCK_BYTES = 16 << 20
#: Least bits of a bitmap of keys, and bits that it has beyond the number of keys; the same for an item's grams.
BITMAP, SPARSE, SPARSE_GRAMS = 22, 4, 2
#: Bytes of the grams that hits are filtered by; bytes of hits' windows that are looked at together.
GRAM = 4
WINDOW_BYTES = 1 << 20
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def normal(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower case, each run of white space as one space, none at the ends; and the texts' new offsets."""
    space = SPACE[data]
    first = np.zeros(len(data), bool)
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    after = np.empty(len(data), bool)
    after[:1] = True
    after[1:] = space[:-1]
    keep = ~(space & (after | first))
    last = np.flatnonzero(keep)
    out = LOWER[data]
    out[space] = 0x20
    at = np.concatenate([[0], np.cumsum(keep)])[offsets]
    out = out[last]
    # A space that ends a text goes too.
    ends = at[1:][at[1:] > at[:-1]] - 1
    drop = ends[out[ends] == 0x20]
    if len(drop):
        at = at - np.searchsorted(drop, at, "left")
        out = np.delete(out, drop)
    return out, at


def budget(n: int) -> int:
    """Edits that an item of n bytes may have: a share of its bytes."""
    return int(EDIT_RATE * n)


def grams(data: np.ndarray, q: int) -> np.ndarray:
    """A key of data[i : i + q] for each i: equal for equal strings (q up to 16, by a hash of two words)."""
    n = len(data) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    room = np.zeros(len(data) + 16, np.uint8)
    room[: len(data)] = data
    word = np.ndarray(len(data) + 8, "<u8", room, strides=(1,))
    if q <= 8:
        x = word[:n] & np.uint64((1 << (8 * q)) - 1)
        y = np.full(1, q, np.uint64)
    else:
        x, y = word[:n], word[q - 8 : q - 8 + n]
    h = x * M1
    h ^= h >> np.uint64(29)
    h += y * M2
    h ^= h >> np.uint64(32)
    return h * M1


def least_distance(pattern: bytes, text: bytes) -> tuple[int, int]:
    """Least edit distance of the pattern to any substring of text, and where the first such substring ends."""
    m = len(pattern)
    equal: dict[int, int] = {}
    for i, c in enumerate(pattern):
        equal[c] = equal.get(c, 0) | 1 << i
    mask, high = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best, end = mask, 0, m, m, 0
    for j, c in enumerate(text):
        eq = equal.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (~(xh | plus) & mask)
        down = plus & xh
        if up & high:
            score += 1
        elif down & high:
            score -= 1
            if score < best:
                best, end = score, j + 1
        up, down = (up << 1) & mask, (down << 1) & mask
        plus = down | (~(xv | up) & mask)
        minus = up & xv
    return best, end


class Pieces:
    """The pieces of a block of items, by key."""

    def __init__(self, items: list[tuple]):
        self.items = [(i, t, budget(len(t))) for i, t in items if t]
        # An item's pieces are of one length: their keys are picked from the hashes of all its places.
        found: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for k, (_, text, edits) in enumerate(self.items):
            q, at = len(text) // (edits + 1), np.arange(edits + 1) * len(text) // (edits + 1)
            found.setdefault(q, []).append((grams(np.frombuffer(text, np.uint8), q)[at], np.full(edits + 1, k, np.int32), at.astype(np.int32)))
        self.tables = {}
        for q, rows in found.items():
            key, item, offset = map(np.concatenate, zip(*rows, strict=True))
            order = np.lexsort((offset, item, key))
            key, item, offset = key[order], item[order], offset[order]
            shift = np.uint64(64 - max(BITMAP, len(key).bit_length() + SPARSE))
            bitmap = np.zeros(1 << (64 - int(shift)), bool)
            bitmap[key >> shift] = True
            self.tables[q] = (key, item, offset, bitmap, shift)
        self.length, self.edits = np.array([len(t) for _, t, _ in self.items], np.int64), np.array([e for *_, e in self.items], np.int64)
        # Which grams an item has, as one bitmap of hashes of both: a clash can only pass a window that the distance then rejects.
        own = [np.unique(self.marks(grams(np.frombuffer(t, np.uint8), GRAM), np.full(1, k, np.uint64))) for k, (_, t, _) in enumerate(self.items)]
        marks = np.concatenate([np.zeros(0, np.uint64), *own])
        self.shift = np.uint64(64 - max(20, len(marks).bit_length() + SPARSE_GRAMS))
        self.has = np.zeros(1 << (64 - int(self.shift)), bool)
        self.has[marks >> self.shift] = True

    @staticmethod
    def marks(gram: np.ndarray, item: np.ndarray) -> np.ndarray:
        return (gram ^ (gram >> np.uint64(31)) ^ ((item + np.uint64(1)) * M2)) * M1

    def hits(self, data: np.ndarray):
        """Yields (item, place, place of the piece in the item) of all piece hits, a bounded number at once."""
        for q, (key, item, offset, bitmap, shift) in self.tables.items():
            h = grams(data, q)
            at = np.flatnonzero(bitmap[h >> shift])
            low, high = np.searchsorted(key, h[at], "left"), np.searchsorted(key, h[at], "right")
            at, low, n = at[high > low], low[high > low], (high - low)[high > low]
            ends = np.cumsum(n)
            i = 0
            while i < len(at):
                j = max(i + 1, int(np.searchsorted(ends, ends[i] - n[i] + WINDOW_BYTES, "right")))
                m = n[i:j]
                slot = np.repeat(low[i:j], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                yield item[slot], np.repeat(at[i:j], m), offset[slot]
                i = j

    def likely(self, gram: np.ndarray, item: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether data[low : high] has as many of the item's grams as its edits must leave."""
        need = self.length[item] - GRAM + 1 - GRAM * self.edits[item]
        width = np.maximum(0, high - low - GRAM + 1)
        out = np.ones(len(item), bool)
        ends = np.cumsum(width)
        i = 0
        while i < len(item):
            j = max(i + 1, int(np.searchsorted(ends, ends[i] - width[i] + WINDOW_BYTES, "right")))
            w = width[i:j]
            first = np.cumsum(w) - w
            place = np.repeat(low[i:j] - first, w) + np.arange(w.sum())
            found = self.has[self.marks(gram[place], np.repeat(item[i:j], w).astype(np.uint64)) >> self.shift]
            total = np.concatenate([[0], np.cumsum(found)])
            out[i:j] = total[first + w] - total[first] >= need[i:j]
            i = j
        return out

    def search(self, data: np.ndarray, offsets: np.ndarray):
        """Yields (text index, item index, distance, end in the text) of the matches within budget."""
        gram, kept = grams(data, GRAM), [(np.zeros(0, np.int64),) * 3]
        for item, at, offset in self.hits(data):
            doc = np.searchsorted(offsets, at, "right") - 1
            diagonal = at - offset
            order = np.lexsort((diagonal, item, doc))
            item, doc, diagonal = item[order], doc[order], diagonal[order]
            new = np.ones(len(item), bool)
            new[1:] = (item[1:] != item[:-1]) | (doc[1:] != doc[:-1]) | (diagonal[1:] != diagonal[:-1])
            item, doc, diagonal = item[new], doc[new], diagonal[new]
            low = np.maximum(offsets[doc], diagonal - self.edits[item])
            high = np.minimum(offsets[doc + 1], diagonal + self.length[item] + self.edits[item])
            good = self.likely(gram, item, low, high)
            kept.append((item[good], doc[good], diagonal[good]))
        item, doc, diagonal = map(np.concatenate, zip(*kept, strict=True))
        if not len(item):
            return
        order = np.lexsort((diagonal, item, doc))
        item, doc, diagonal = item[order], doc[order], diagonal[order]
        edits = self.edits
        new = np.ones(len(item), bool)
        # Windows of hits whose diagonals follow each other closely are verified as one.
        new[1:] = (item[1:] != item[:-1]) | (doc[1:] != doc[:-1]) | (diagonal[1:] - diagonal[:-1] > edits[item[1:]] + 1)
        first = np.flatnonzero(new)
        for a, b in zip(first, [*first[1:], len(item)], strict=True):
            _, text, k = self.items[item[a]]
            low = max(offsets[doc[a]], diagonal[a] - k)
            high = min(offsets[doc[a] + 1], diagonal[b - 1] + len(text) + k)
            best, end = least_distance(text, data[low:high].tobytes())
            if best <= k:
                yield int(doc[a]), int(item[a]), best, int(low + end - offsets[doc[a]])


_BUILT: dict[str, Pieces] = {}


def kept(block: str, named: dict[bytes, list[int | None]]) -> Pieces:
    """The pieces of a block of items; a worker builds them once and keeps those of its last block."""
    if block not in _BUILT:
        _BUILT.clear()
        _BUILT[block] = Pieces([(ids, text) for text, ids in named.items()])
    return _BUILT[block]


MATCHES = "doc_id bigint, item_id bigint, distance int, budget int, match_end bigint"


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents (doc_id, text) that hold an item of benchmark (item_id, text) within the item's edit budget.

    Returns doc_id, item_id, distance (least edits), budget (edits allowed) and match_end (bytes of normalised text before
    the end of the closest match); one row for each pair.
    """
    items = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    blocks = max(1, math.ceil((items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / BLOCK_BYTES))
    found = None
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        named: dict[bytes, list[int | None]] = {}
        for r in rows:
            data = np.frombuffer(r["text"].encode(), np.uint8)
            named.setdefault(normal(data, np.array([0, len(data)]))[0].tobytes(), []).append(r["item_id"])

        def scan(batches, named=named, block=uuid.uuid4().hex):
            pieces = kept(block, named)
            for batch in batches:
                ids = batch.column("doc_id")
                data, offsets = flat(batch.column("text"))
                out: list[tuple] = []
                for i, j in chunks(offsets):
                    part, own = normal(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                    out += [(i + d, name, *x) for d, *x in pieces.search(part, own) for name in pieces.items[x[0]][0]]
                doc, name, item, distance, end = zip(*out, strict=True) if out else ((),) * 5
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(doc, pa.int64())), pa.array(name, pa.int64()), pa.array(distance, pa.int32()), pa.array([pieces.items[x][2] for x in item], pa.int32()), pa.array(end, pa.int64())],
                    ["doc_id", "item_id", "distance", "budget", "match_end"],
                )

        part = docs.select("doc_id", "text").mapInArrow(scan, MATCHES)
        found = part if found is None else found.union(part)
    best = F.min(F.struct("distance", "match_end", "budget")).alias("m")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "m.distance", "m.budget", "m.match_end")
