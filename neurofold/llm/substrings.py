"""Removes repeated substrings of a corpus by prefix-free parsing.

Rolling-hash triggers cut every text into phrases.  Whether a string is a trigger is
decided by its own bytes, so two copies of a passage are cut alike wherever they
stand; stretches without a trigger get one from the least hash of each window, so
every window of the sought length has a trigger near its begin and belongs to exactly
one (its first trigger).  A trigger with the windows it owns and the bytes that they
cover is a dictionary entry; the parse is the sequence of entries.

Windows are put in corpus order only as far as ``length`` bytes and only where they can
have an equal neighbour in it:

1. equal windows have equal triggers with equal bytes after them, so triggers whose
   following bytes are unique in the corpus leave the parse (most of it does);
2. the dictionary holds each remaining entry once: an entry that the parse has twice
   makes all its windows repeated, and one occurrence is elected to stand for it; where
   a check beside the key tells that different entries share a key, all of them are
   elected and none counts as repeated, so that step 4 decides by their bytes;
3. entries that are alone under their following bytes are settled;
4. the others are spelled out.  An entry carries the bytes that follow its phrase as far
   as a window reaches, so the order of the parse's suffixes is part of the order of the
   dictionary's.  The suffix array of a share of the dictionary is built by prefix
   doubling from exact eight-byte words; windows that are equal over their whole length
   are neighbours in it, so repeats are decided by bytes.

Steps 1 to 3 are distributed counts of 64-bit keys (``common.counted``), with the sum of
a 24-bit check of each entry in step 2.  In steps 1 and 3 a clash of keys only leaves
more to compare.  Step 4 deals
entries by their following bytes, and where more than ``CLASS`` entries share them, their
windows by content, so no passage that a third of all documents share meets in one task.

Defined results: null texts are empty; matches never cross texts; the two copies may
overlap; texts shorter than the length keep everything; repeated rows and rows of one
doc_id or of none are texts of their own, each with a row; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE2, BYTE_CODE2, Spans, counted, expand, flat, materialise, mix, parcels, part_count, squeeze, text_size, unparcel

#: Bytes of a trigger; one in PERIOD strings is one by itself; a trigger lies at most REACH bytes after a window's start.
TRIGGER, PERIOD, REACH = 16, 96, 132
#: Bytes handled at once.
STRETCH = 1 << 20
#: Entries of one class that are ordered together; shares of a range that are ordered one after another.
CLASS, LANES = 20_000, 16
#: Bits of an entry's check; sums of them are exact for 2**29 occurrences, beyond which an entry is compared by its bytes.
CHECK = 24


def least_within(h: np.ndarray, n: int) -> np.ndarray:
    """Index of the first least element of h[i : i + n] for each i."""
    at, best, k = np.arange(len(h)), h, 1
    while k < n:
        s = min(k, n - k)
        take = best[s:] < best[:-s]
        at = np.where(take, at[s:], at[:-s])
        best = np.where(take, best[s:], best[:-s])
        k += s
    return at


def stretches(offsets: np.ndarray, length: int, limit: int = STRETCH):
    """Cuts the texts into runs (first byte, last byte, local text ends) whose windows are the texts' windows, each once."""
    i, n = 0, len(offsets) - 1
    while i < n:
        if offsets[i + 1] - offsets[i] > limit:
            for a in range(offsets[i], offsets[i + 1], limit):
                b = min(a + limit + length - 1, offsets[i + 1])
                yield a, b, np.array([b - a])
                if b == offsets[i + 1]:
                    break
            i += 1
            continue
        j = i
        while j < n and offsets[j + 1] - offsets[i] <= limit:
            j += 1
        yield offsets[i], offsets[j], offsets[i + 1 : j + 1] - offsets[i]
        i = j


def entries(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Triggers that own windows: place, first and last owned start, key of the bytes that follow, key and check of the whole entry."""
    out = [[np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)] * 2 + [np.zeros(0, np.int32)]]
    for a, b, ends in stretches(offsets, length):
        part = data[a:b]
        if len(part) < length:
            continue
        spans, more = Spans(part), Spans(part, BYTE_CODE2, BASE2)
        at = np.arange(len(part) - TRIGGER + 1)
        h = spans(at, at + TRIGGER)
        end = np.repeat(ends, np.diff(np.append(0, ends)))
        start = np.flatnonzero(np.arange(len(part)) + length <= end)
        if not len(start):
            continue
        plain = np.flatnonzero(h % np.uint64(PERIOD) == 0)
        owner = np.append(plain, 1 << 60)[np.searchsorted(plain, start)]
        lone = owner > start + REACH
        owner[lone] = least_within(h, REACH + 1)[start[lone]]
        new = np.ones(len(start), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (start[1:] != start[:-1] + 1)
        first = np.flatnonzero(new)
        low, high, own = start[first], start[np.append(first[1:], len(start)) - 1], owner[first]
        covered = spans(low, high + length)
        whole = mix(more(low, high + length) ^ mix((own - low).astype(np.uint64)) ^ covered)
        check = (mix(covered ^ np.uint64(CHECK)) >> np.uint64(64 - CHECK)).astype(np.int32)
        out.append([own + a, low + a, high + a, spans(own, own + length - REACH), whole, check])
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def windows(data: np.ndarray, low: np.ndarray, high: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and fingerprints of the windows that start in [low, high]."""
    starts, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for k in range(0, len(low), 4096):
        lo, hi = low[k : k + 4096], high[k : k + 4096]
        n = hi - lo + 1
        start = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        # Only the bytes of these entries are hashed, laid end to end.
        room = n + length - 1
        base = np.cumsum(room) - room
        flat_at = np.repeat(lo - base, room) + np.arange(room.sum())
        part = data[flat_at]
        local = start - np.repeat(lo - base, n)
        starts.append(start)
        keys.append(mix(Spans(part)(local, local + length) ^ mix(Spans(part, BYTE_CODE2, BASE2)(local, local + length))))
    return np.concatenate(starts), np.concatenate(keys)


def ragged(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (size[0] of them), first[1], ..."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())


def suffix_ranks(text: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Ranks of text[s : s + length] for the starts, in the order of a suffix array built by prefix doubling: equal strings, equal ranks."""
    words = np.ndarray(max(0, len(text) - 7), ">u8", text.tobytes(), strides=(1,))
    rank, known = np.unique(words.astype(np.uint64), return_inverse=True)[1].astype(np.uint64), 8
    while 2 * known <= length:
        rank = np.unique(rank[:-known] << np.uint64(32) | rank[known:], return_inverse=True)[1].astype(np.uint64)
        known *= 2
    return np.unique(rank[starts] << np.uint64(32) | rank[starts + length - known], return_inverse=True)[1]


class Spelling:
    """The windows of a part's open dictionary entries, as pieces of text in the order of the ranges that settle them."""

    def __init__(self, data: np.ndarray, x: dict[str, np.ndarray], length: int, ranges: int):
        low, high = x["low"][x["chosen"]], x["high"][x["chosen"]]
        size = high - low + 1
        entry, start, share = np.repeat(np.arange(len(low)), size), ragged(low, size), np.zeros(size.sum(), np.uint64)
        hot = np.flatnonzero(x["split"] > 1)
        if len(hot):
            # Windows of a large class are dealt by content: equal ones to one share.
            at = ragged((np.cumsum(size) - size)[hot], size[hot])
            share[at] = windows(data, low[hot], high[hot], length)[1] % np.repeat(x["split"][hot], size[hot]).astype(np.uint64)
        deal = mix(x["key"][entry] ^ mix(share))
        goal, lane = (deal % np.uint64(ranges)).astype(np.int64), (deal // np.uint64(ranges) % np.uint64(LANES)).astype(np.int64)
        order = np.lexsort((start, share, entry, lane, goal))
        entry, share, goal, lane, self.start = entry[order], share[order], goal[order], lane[order], start[order]
        new = np.ones(len(order), bool)
        new[1:] = (entry[1:] != entry[:-1]) | (share[1:] != share[:-1])
        first = np.flatnonzero(new)
        self.count = np.diff(np.append(first, len(order)))
        self.data, self.begin = data, self.start[first]
        self.size = self.start[first + self.count - 1] + length - self.begin
        self.offset = (self.start - np.repeat(self.begin, self.count)).astype(np.uint8)
        self.lane, self.twice = lane[first].astype(np.uint8), x["twice"][x["chosen"]][entry[first]]
        # Where each range's pieces and windows begin, and their end.
        goal = goal[first]
        cut = np.append(np.flatnonzero(np.append(True, goal[1:] != goal[:-1])), len(goal)) if len(goal) else np.zeros(1, np.int64)
        self.ranges, self.pieces = goal[cut[:-1]], cut
        self.windows = np.append(first, len(order))[cut]

    def messages(self, part: int) -> pa.Table:
        blobs = []
        for p, q, a, b in zip(self.pieces[:-1], self.pieces[1:], self.windows[:-1], self.windows[1:], strict=True):
            text = self.data[ragged(self.begin[p:q], self.size[p:q])]
            blobs.append([squeeze(v) for v in (self.lane[p:q], self.twice[p:q], self.count[p:q].astype(np.uint8), self.offset[a:b], text)])
        return pa.table({"range": pa.array(self.ranges, pa.int32()), "part": pa.array([part] * len(blobs), pa.int32()), "pieces": pa.array(blobs, pa.list_(pa.binary()))})


MESSAGES, ANSWERS = "range int, part int, pieces array<binary>", "part int, range int, again binary"


def settled(table: pa.Table, length: int) -> pa.Table:
    """For each message of a range, which of its windows occur again: one bit a window, in the message's order."""
    table = table.sort_by("part")
    held = [[expand(b) for b in m] for m in table.column("pieces").to_pylist()]
    bounds = []
    for lane, _, count, offset, _ in held:
        last = np.cumsum(count, dtype=np.int64)
        size = offset[last - 1].astype(np.int64) + length
        at = np.searchsorted(lane, np.arange(LANES + 1))
        bounds.append((at, np.append(0, last)[at], np.append(0, np.cumsum(size))[at], size))
    again = [np.zeros(len(m[3]), bool) for m in held]
    for k in range(LANES):
        text, starts, weights, room = [], [], [], 0
        for (_, twice, count, offset, data), (at, ends, places, size) in zip(held, bounds, strict=True):
            own = slice(at[k], at[k + 1])
            n = count[own].astype(np.int64)
            begin = np.cumsum(size[own]) - size[own]
            text.append(data[places[k] : places[k + 1]])
            starts.append(room + np.repeat(begin, n) + offset[ends[k] : ends[k + 1]])
            weights.append(np.repeat(1 + twice[own], n))
            room += len(text[-1])
        starts = np.concatenate(starts)
        if not len(starts):
            continue
        rank = suffix_ranks(np.concatenate(text), starts, length)
        found, done = np.bincount(rank, np.concatenate(weights))[rank] > 1, 0
        for mark, (_, ends, *_) in zip(again, bounds, strict=True):
            n = ends[k + 1] - ends[k]
            mark[ends[k] : ends[k + 1]] = found[done : done + n]
            done += n
    return pa.table({"part": table.column("part"), "range": table.column("range"), "again": pa.array([np.packbits(a).tobytes() for a in again], pa.binary())})


COLUMNS = ("low", "high", "key", "whole", "check", "twice", "chosen", "split")
STATE = "part int, " + ", ".join(f"{c} binary" for c in COLUMNS)


def _state(part: int, low, high, **more) -> pa.Table:
    columns = {"low": np.diff(low, prepend=0).astype(np.int32), "high": (high - low).astype(np.int32)} | more
    return pa.table({"part": pa.array([part], pa.int32())} | {c: pa.array([squeeze(columns[c]) if c in columns else None], pa.binary()) for c in COLUMNS})


def _held(table: pa.Table) -> dict[str, np.ndarray]:
    out = {c: expand(table.column(c)[0].as_py()) for c in COLUMNS if table.column(c)[0].is_valid}
    out["low"] = np.cumsum(out["low"], dtype=np.int64)
    out["high"] = out["low"] + out["high"]
    return out


def _unique(x: np.ndarray):
    every, count = np.unique(x, return_counts=True)
    return every, [count]


def repeated_substrings(docs: DataFrame, length: int = 200) -> DataFrame:
    """Removes from each row of docs (doc_id, text) every byte in a ``length``-byte string that also starts elsewhere in the corpus.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and kept (the remaining bytes).
    """
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    parts = part_count(text_size(docs))
    dealt = parcels(own, parts)

    def number(table: pa.Table) -> int:
        return table.column("part")[0].as_py()

    # 1. Triggers whose following bytes occur again.
    def parse(table: pa.Table) -> pa.Table:
        _, low, high, key, whole, check = entries(*flat(unparcel(table).column("text")), length)
        return _state(number(table), low, high, key=key, whole=whole, check=check)

    def follow_use(table: pa.Table, totals):
        x = _held(table)
        again = totals[0][np.searchsorted(np.unique(x["key"]), x["key"])] > 1
        return _state(number(table), x["low"][again], x["high"][again], key=x["key"][again], whole=x["whole"][again], check=x["check"][again])

    parsed = materialise(dealt.groupBy("part").applyInArrow(parse, STATE), "parse")
    state = materialise(counted(parsed, lambda t: _unique(_held(t)["key"]), follow_use, STATE, parts), "repeated-parse")

    # 2. Entries that occur again; one occurrence of each is chosen.
    def whole_keys(table: pa.Table):
        x = _held(table)
        every, slot, count = np.unique(x["whole"], return_inverse=True, return_counts=True)
        return every, [count, np.bincount(slot, x["check"], len(every)).astype(np.int64)]

    def whole_use(table: pa.Table, totals):
        x = _held(table)
        every, first, slot = np.unique(x["whole"], return_index=True, return_inverse=True)
        count, checks, elected = totals
        # Entries of one key are equal if the sum of their checks is that of so many equal ones.
        same = checks == count * x["check"][first]
        chosen = ~same[slot]
        chosen[first] |= elected > 0
        return _state(number(table), x["low"], x["high"], key=x["key"], twice=(same & (count > 1))[slot], chosen=chosen)

    state = materialise(counted(state, whole_keys, whole_use, STATE, parts, told=2, elect=True), "dictionary")

    # 3. Chosen entries that are not alone under their following bytes need their windows compared.
    def chosen_keys(table: pa.Table):
        x = _held(table)
        return _unique(x["key"][x["chosen"]])

    def chosen_use(table: pa.Table, totals):
        x = _held(table)
        every = np.unique(x["key"][x["chosen"]])
        size = np.zeros(len(x["key"]), np.int64)
        size[x["chosen"]] = totals[0][np.searchsorted(every, x["key"][x["chosen"]])]
        open_ = size > 1
        keep = open_ | x["twice"]
        return _state(number(table), x["low"][keep], x["high"][keep], key=x["key"][open_], twice=x["twice"][keep], chosen=open_[keep], split=-(-size[open_] // CLASS))

    state = materialise(counted(state, chosen_keys, chosen_use, STATE, parts), "classes")

    # 4. Their windows in the order of suffix arrays; what a repeated entry covers counts as found twice.
    columns = [c for c in state.columns if c != "part"]
    empty = [F.lit(None).cast("binary").alias(c) for c in columns]
    both = dealt.select("part", "parcel", *empty).union(state.select("part", F.lit(None).cast("binary"), *columns))

    def texts_and_state(table: pa.Table):
        is_text = table.column("parcel").is_valid()
        rows = unparcel(table.filter(is_text))
        data, offsets = flat(rows.column("text"))
        x = _held(table.filter(pa.compute.invert(is_text)))
        return rows, data, offsets, x, Spelling(data, x, length, parts)

    def spell(table: pa.Table) -> pa.Table:
        return texts_and_state(table)[-1].messages(number(table))

    def remove(table: pa.Table, answer: pa.Table) -> pa.Table:
        rows, data, offsets, x, spelling = texts_and_state(table)
        again = answer.sort_by("range").column("again").to_pylist()
        sizes = np.diff(spelling.windows)
        bits = [np.unpackbits(np.frombuffer(b, np.uint8), count=n) for b, n in zip(again, sizes, strict=True)]
        hit = spelling.start[np.concatenate(bits).astype(bool)] if bits else np.zeros(0, np.int64)
        edge = np.zeros(len(data) + length + 1, np.int32)
        for low, high in ((x["low"][x["twice"]], x["high"][x["twice"]]), (hit, hit)):
            np.add.at(edge, low, 1)
            np.add.at(edge, high + length, -1)
        gone = np.cumsum(edge[: len(data)]) > 0
        removed, spans, digest, kept = [], [], [], []
        for i, j in zip(offsets[:-1], offsets[1:], strict=True):
            cut = gone[i:j]
            rest = data[i:j][~cut].tobytes()
            removed.append(int(cut.sum()))
            spans.append(int((cut[1:] & ~cut[:-1]).sum() + cut[:1].sum()))
            digest.append(hashlib.sha256(rest).hexdigest())
            kept.append(rest)
        return pa.table({"doc_id": rows.column("doc_id"), "n_bytes": pa.array(np.diff(offsets)), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(digest, pa.string()), "kept": pa.array(kept, pa.binary())})

    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"
    answers = both.groupBy("part").applyInArrow(spell, MESSAGES).groupBy("range").applyInArrow(lambda table: settled(table, length), ANSWERS)
    return both.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(remove, schema)
