"""Near-duplicate documents: exact Jaccard join of word n-gram sets.

Shingles are ordered rare first by their document frequency over the whole corpus,
so two sets that reach the threshold share a shingle among the first few of each
(prefix filter).  Documents of equal sets are one class; classes are joined on prefix
shingles, pairs pass length and positional bounds, and each pair is verified once,
after a suffix bound, by merging the ordered sets.

A family of thousands of near copies would make a pair of every two members.  Pairs
that are neighbours (by size, and by hash) under some prefix shingle are verified first,
then classes outside a shingle's largest component against a hub of it; classes that are
then connected need no further pair, so the full join only pairs classes of different
components, and under each shingle leaves out its largest component's own members.
Parity sketches of the sets bound what a pair can share (suffix filter), inside the join.
No link between different components is lost, so components are exact.

Links inside a component are not enumerated beyond what connects it.

Defined results: a null text is empty; texts without words have no set, size 0 and no
link; fewer words than n are one shingle; each row is a document of its own, also where
rows repeat or share a doc_id; a null doc_id links like any other and names a component
only where all its ids are null (the name is then null); an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Spans, chunks, counted, flat, materialise, mix, parcels, part_count, text_size, unparcel, words
from .components import components

CHAIN = np.uint64(0xA0761D6478BD642F)
#: Rounds in which classes are compared with one hub of each shingle's largest component before the full join.
ATTACH = 1
#: Words of 64 bits in a parity sketch, a power of two.
SKETCH = 8


def shingles(text: pa.Array, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's distinct n-word shingles, sorted, and where each text's begin."""
    data, offsets = flat(text)
    out, sizes = [], []
    for i, j in chunks(offsets):
        own = offsets[i : j + 1] - offsets[i]
        part = LOWER[data[offsets[i] : offsets[j]]]
        begin, stop, index = words(part, own)
        word = Spans(part)(begin, stop)
        count = np.diff(index)
        made = np.maximum(count - n + 1, (count > 0).astype(count.dtype))
        length = np.minimum(count, n)
        doc = np.repeat(np.arange(j - i), made)
        at = index[:-1][doc] + np.arange(len(doc)) - np.repeat(np.cumsum(made) - made, made)
        h = mix(length[doc].astype(np.uint64))
        for k in range(n):
            live = k < length[doc]
            h[live] = mix(h[live] * CHAIN + word[at[live] + k])
        order = np.lexsort((h, doc))
        doc, h = doc[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        out.append(h[new])
        sizes.append(np.bincount(doc[new], minlength=j - i))
    first = np.concatenate([[0], np.cumsum(np.concatenate(sizes) if sizes else np.zeros(0, np.int64))])
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), first


def sketches(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Parity of the number of shingles in each of 64 * SKETCH buckets: sketches of two sets differ in no more bits than the sets in shingles."""
    out = np.zeros(((len(first) - 1), SKETCH), np.uint64)
    if len(h):
        bits = np.uint64(64 - (SKETCH - 1).bit_length())
        word = np.repeat(np.arange(len(first) - 1), np.diff(first)) * SKETCH + (h >> bits).astype(np.int64)
        starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        out.ravel()[word[starts]] = np.bitwise_xor.reduceat(np.uint64(1) << ((h >> (bits - np.uint64(6))) & np.uint64(63)), starts)
    return out.view(np.int64)


SETS = "doc_id bigint, n bigint, key_a bigint, key_b bigint, tokens array<bigint>, places array<int>, sketch array<bigint>, ordered binary"


def ordered_sets(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """A row for each document with its set's size and 128-bit key; where a prefix shingle occurs elsewhere, those and the set, rare first."""

    def keys_of(table: pa.Table):
        every, count = np.unique(shingles(unparcel(table).column("text"), n)[0], return_counts=True)
        return every, [count]

    def use(table: pa.Table, totals):
        rows = unparcel(table)
        h, first = shingles(rows.column("text"), n)
        every = np.unique(h)
        df = totals[0][np.searchsorted(every, h)]
        sizes = np.diff(first)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        order = np.lexsort((h, df, doc))
        ranked, often = h[order], df[order]
        place = np.arange(len(h)) - np.repeat(first[:-1], sizes)
        prefix = sizes - (percent * sizes + 99) // 100 + 1
        use_it = (place < prefix[doc]) & (often > 1)
        full = sizes > 0
        sums = np.zeros((2, len(sizes)), np.uint64)
        for k, x in enumerate((h, mix(h ^ CHAIN))):
            if len(h):
                sums[k, full] = np.add.reduceat(mix(x), first[:-1][full])
        picked = np.searchsorted(np.flatnonzero(use_it), first)
        tokens, places = ranked[use_it].view(np.int64), place[use_it].astype(np.int32)
        has = np.diff(picked) > 0
        return pa.table(
            {
                "doc_id": rows.column("doc_id"),
                "n": pa.array(sizes.astype(np.int64)),
                "key_a": pa.array(sums[0].view(np.int64)),
                "key_b": pa.array(sums[1].view(np.int64)),
                "tokens": pa.ListArray.from_arrays(pa.array(picked.astype(np.int32)), pa.array(tokens)),
                "places": pa.ListArray.from_arrays(pa.array(picked.astype(np.int32)), pa.array(places)),
                "sketch": pa.array([list(map(int, s)) if has[i] else None for i, s in enumerate(sketches(h, first))], pa.list_(pa.int64())),
                # With each shingle its frequency's rank is implied by the order; the merge needs only membership and place.
                "ordered": pa.array([ranked[first[i] : first[i + 1]].tobytes() if has[i] else None for i in range(len(sizes))], pa.binary()),
            }
        )

    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    parts = part_count(text_size(docs))
    return counted(parcels(own, parts), keys_of, use, SETS, parts)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The distinct pairs (a, b) of set ids that reach the threshold."""
    left = sets.select(F.col("id").alias("a"), F.col("ordered").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("ordered").alias("y"))

    def check(batches):
        for batch in batches:
            keep = [jaccard_at_least(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep, pa.bool_())), batch.column("b").filter(pa.array(keep, pa.bool_()))], ["a", "b"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(check, "a bigint, b bigint")


def jaccard_at_least(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether percent of the union is shared.  Shingles split by value at a probe must be able to overlap enough in both halves."""
    needed = -(-percent * (len(x) + len(y)) // (100 + percent))
    probe = y[len(y) // 2]
    low_x, low_y = int((x < probe).sum()), int((y < probe).sum())
    if min(low_x, low_y) + min(len(x) - low_x, len(y) - low_y) < needed:
        return False
    return len(np.intersect1d(x, y, assume_unique=True)) >= needed


def neighbours(rows: DataFrame, order: list, reach: int, percent: int) -> DataFrame:
    """Pairs (a, b) of rows (token, id, n, place) of one token that stand up to ``reach`` apart in an order and may reach the threshold.

    The order is cut into ranges, a token's rows may lie in several; pairs across a cut are left to the full join.
    """

    def pair(batches):
        held = np.zeros((4, 0), np.int64)
        for batch in batches:
            held = np.concatenate([held, np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("token", "id", "n", "place")])], 1)
            found = []
            for k in range(1, reach + 1):
                x, y = held[:, :-k], held[:, k:]
                needed = -(-percent * (x[2] + y[2]) // (100 + percent))
                ok = (x[0] == y[0]) & (x[1] != y[1]) & (np.minimum(x[2] - x[3], y[2] - y[3]) >= needed)
                found.append(np.sort(np.stack([x[1][ok], y[1][ok]]), 0))
            both = np.concatenate(found, 1)
            held = held[:, -reach:]
            yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])

    ranged = rows.repartitionByRange("token", *order).sortWithinPartitions("token", *order)
    return ranged.select("token", "id", "n", "place").mapInArrow(pair, "a bigint, b bigint")


def may_reach(n: str, place: str, other_n: str, other_place: str, percent: int) -> Column:
    """Length and positional bounds on a pair that meets at these places of its ordered sets.

    At its first common shingle a pair has none before, so what is left after it must be enough: one such shingle suffices.
    """
    smaller, larger = F.least(n, other_n), F.greatest(n, other_n)
    needed = F.ceil((F.col(n) + F.col(other_n)) * percent / (100 + percent))
    return (smaller * 100 >= larger * percent) & (F.least(F.col(n) - F.col(place), F.col(other_n) - F.col(other_place)) >= needed)


def may_differ(a: str, b: str, percent: int) -> Column:
    """Suffix bound on a pair: the sketches, of what follows the prefix too, may not differ in more bits than the sets in shingles."""
    n = F.col(f"{a}.n") + F.col(f"{b}.n")
    apart = [F.bit_count(F.get(f"{a}.sketch", F.lit(i)).bitwiseXOR(F.get(f"{b}.sketch", F.lit(i)))) for i in range(SKETCH)]
    return sum(apart[1:], apart[0]) <= n - 2 * F.ceil(n * percent / (100 + percent))


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 75) -> DataFrame:
    """Components of the documents (doc_id, text) whose n-word shingle sets have a Jaccard similarity of ``percent`` or more.

    Returns doc_id, n_shingles and component_id (the least doc_id that links reach).
    """
    found = materialise(ordered_sets(docs, n, percent), "sets")
    classes = found.where("n > 0").groupBy("key_a", "key_b", "n").agg(F.min("doc_id").alias("least"))
    # A class goes by its least doc_id, or by a hash where that is null or names several classes.
    several = classes.where("least is not null").groupBy("least").agg(F.count("*").alias("k")).where("k > 1")
    own = F.when(F.col("k").isNull() & F.col("least").isNotNull(), F.col("least")).otherwise(F.xxhash64("key_a", "key_b", "n"))
    classes = materialise(classes.join(several, "least", "left").withColumn("id", own).drop("k"), "classes")
    sets = found.where("ordered is not null").join(classes, ["key_a", "key_b", "n"]).where(F.col("doc_id").eqNullSafe(F.col("least")))
    sets = sets.select("id", "n", "tokens", "places", "sketch", "ordered").dropDuplicates(["id"])
    sets = materialise(sets, "class-sets")
    rows = sets.select("id", "n", "sketch", F.explode(F.arrays_zip("tokens", "places")).alias("t")).select(F.col("t.tokens").alias("token"), "id", "n", F.col("t.places").alias("place"), "sketch")
    plain = rows.drop("sketch")
    # Under each prefix shingle, a few classes of similar size and a few at random.
    chain = neighbours(plain, ["n", "id"], 3, percent).union(neighbours(plain, [F.xxhash64("id"), "id"], 2, percent)).distinct()
    # What was verified once is not verified again.
    tried = materialise(chain, "tried")
    links = materialise(verified(tried, sets, percent), "links")
    for attempt in range(ATTACH + 1):
        joined = components(links).select("id", "component")
        # The rest: pairs of different components under a shingle; one side is not of the shingle's largest component.
        named = materialise(rows.join(joined, "id", "left").withColumn("component", F.coalesce("component", "id")), "named")
        # A component's hub has few shingles that are rarer than this one: it is little edited, so likeliest near to the others.
        rank = F.struct(F.floor(F.col("place") / (1 + 4 * attempt)), F.xxhash64(F.lit(attempt), "id"), "id", "n", "place")
        counts = named.groupBy("token", "component").agg(F.count("*").alias("c"), F.min(rank).alias("hub"))
        largest = counts.groupBy("token").agg(F.max(F.struct("c", "component", "hub")).alias("m"), F.count("*").alias("k")).where("k > 1")
        mixed = materialise(largest.select("token", F.col("m.component").alias("main"), F.col("m.hub.id").alias("hub"), F.col("m.hub.n").alias("hub_n"), F.col("m.hub.place").alias("hub_place")), "mixed")
        others = materialise(named.join(mixed, "token").where("component <> main").drop("main"), "others")
        if attempt < ATTACH:
            star = others.where(may_reach("n", "place", "hub_n", "hub_place", percent)).select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
            star = materialise(star.join(tried, ["a", "b"], "left_anti"), "tried")
            tried, links = tried.union(star), links.union(materialise(verified(star, sets, percent), "links"))
    # Sizes of linked sets differ by a bounded factor: a shingle's postings are dealt by bands of size as well.
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(1.01 * 100 / percent))
    a = others.withColumn("band", F.explode(F.array(band - 1, band, band + 1))).alias("a")
    b = named.withColumn("band", band).alias("b")
    pairs = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.band") == F.col("b.band")) & (F.col("a.component") != F.col("b.component")) & may_reach("a.n", "a.place", "b.n", "b.place", percent) & may_differ("a", "b", percent))
    pairs = pairs.select(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    more = materialise(verified(pairs, sets, percent), "links")
    whole = components(links.union(more))
    inside = classes.join(whole, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = inside.groupBy("component").agg(F.min("least").alias("component_id"))
    named_classes = materialise(inside.join(least, "component").select("key_a", "key_b", "n", "component_id"), "class-components")
    return found.select("doc_id", "n", "key_a", "key_b").join(named_classes, ["key_a", "key_b", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
