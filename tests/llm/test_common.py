"""The distributed count in one level and in two, against a plain count; packed keys; deletion of tables."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from neurofold.llm import common as C


@pytest.mark.parametrize("many", [None, 3])
def test_counted(spark, many):
    rng = np.random.default_rng(4)
    held = {p: rng.integers(0, 300, rng.integers(0, 200)) * 61_489_146_912_365 for p in range(23)}
    held[5] = np.zeros(0, np.int64)
    rows = spark.createDataFrame([(p, [int(x) for x in v]) for p, v in held.items()], "part int, x array<bigint>")

    def keys_of(table):
        every, n = np.unique(np.array(table.column("x")[0].as_py(), np.uint64), return_counts=True)
        return every, [n.astype(np.int64), np.full(len(every), 7, np.int64)]

    def use(table, totals):
        every = keys_of(table)[0].view(np.int64)
        return pa.table({"part": pa.array([table.column("part")[0].as_py()] * len(every), pa.int32()), "key": every, "n": totals[0], "sevens": totals[1], "elected": totals[2]})

    got = C.counted(rows, keys_of, use, "part int, key bigint, n bigint, sevens bigint, elected bigint", 17, 2, True, many).collect()
    total, parts = Counter(int(x) for v in held.values() for x in v), Counter(int(x) for v in held.values() for x in set(v.tolist()))
    assert {(r["part"], r["key"]) for r in got} == {(p, int(x)) for p, v in held.items() for x in v}
    assert all(r["n"] == total[r["key"]] and r["sevens"] == 7 * parts[r["key"]] for r in got)
    assert Counter(r["key"] for r in got if r["elected"]) == Counter(total.keys())


def test_packed_keys():
    for keys in ([], [0], [2**64 - 1], [1, 5, 2**40, 2**64 - 1]):
        assert C.unpack(C.pack(np.array(keys, np.uint64))).tolist() == keys


def test_discarded_tables_are_gone(spark):
    before = len(C.WRITTEN)
    kept, gone = C.materialise(spark.range(3), "kept"), C.materialise(spark.range(4), "gone")
    C.discard(spark, [C.WRITTEN[-1]])
    assert kept.count() == 3 and len(C.WRITTEN) == before + 1
    with pytest.raises(Exception):
        gone.collect()


def test_repeated_rows_are_dealt_to_many_parts(spark):
    """A third of all rows are equal, without an id: no part holds much more than its share, and reruns and other orders deal alike."""
    rows = [(None, "the same text")] * 20_000 + [(i, f"text {i}") for i in range(40_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).sortWithinPartitions("doc_id")
    plain = lambda x: sorted((p, -1 if d is None else d) for p, d in x)

    def _numbered(table):
        rows = C.unparcel(table)
        return pa.table({"doc_id": rows.column("doc_id"), "part": pa.array([table.column("part")[0].as_py()] * rows.num_rows, pa.int32())})

    found = plain([(r["part"], r["doc_id"]) for r in C.parcels(docs, 64).groupBy("part").applyInArrow(_numbered, "doc_id long, part int").collect()])
    sizes = Counter(p for p, _ in found)
    assert len(found) == 60_000 and len(sizes) == 64 and max(sizes.values()) < 2 * 60_000 / 64
    again = docs.sortWithinPartitions("text", ascending=False)
    assert plain([(r["part"], r["doc_id"]) for r in C.parcels(again, 64).groupBy("part").applyInArrow(_numbered, "doc_id long, part int").collect()]) == found


def test_occurrences_count_over_calls():
    seen = {}
    assert C.occurrences(np.array([5, 7, 5, 5]), seen).tolist() == [0, 0, 1, 2]
    assert C.occurrences(np.array([7, 5, 9]), seen).tolist() == [1, 3, 0]


def test_tables_of_one_thread_are_noted(spark):
    import threading

    with C.noted() as mine:
        C.materialise(spark.range(1), "a")
        other = threading.Thread(target=lambda: C.materialise(spark.range(1), "b"))
        other.start()
        other.join()
    assert len(mine) == 1 and "/a-" in mine[0]
