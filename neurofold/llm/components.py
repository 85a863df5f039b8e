"""Connected components of a link table, by random-mate contraction.

Each round every node joins the neighbour (or itself) of least random rank, edges
are redrawn between the survivors and duplicates fall away, so the graph shrinks by
a constant factor a round whatever its shape: long chains and big stars alike.
Tasks first replace their own edges by a spanning forest.  A remainder of at most
``LAST_EDGES`` edges is finished in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Edges that a single task finishes.
LAST_EDGES = 200_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the least node of their component, by hooking and pointer jumping."""
    nodes, slot = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = slot[: len(a)], slot[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        open_ = low < high
        if not open_.any():
            return nodes, nodes[root]
        np.minimum.at(root, high[open_], low[open_])
        while True:
            jumped = root[root]
            if (jumped == root).all():
                break
            root = jumped
        x, y = x[open_], y[open_]


def _spanning(batches):
    """Edges (node, root) of a spanning forest of the edges that this task has, in runs of bounded size."""
    held: list[np.ndarray] = []

    def emit():
        nodes, roots = forest(*np.concatenate(held, 1))
        keep = nodes != roots
        return nodes[keep], roots[keep]

    size = 0
    for batch in batches:
        held.append(np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()]))
        size += batch.num_rows
        if size > 4_000_000:
            held[:] = [np.stack(emit())]
            size = held[0].shape[1]
            if size > 2_000_000:  # a forest this large is passed on
                yield pa.RecordBatch.from_arrays([pa.array(held[0][0]), pa.array(held[0][1])], ["a", "b"])
                held, size = [], 0
    if size:
        nodes, roots = emit()
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], ["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """links (a, b) -> (id, component): each node that has a link, and the least node it reaches."""
    schema = "a bigint, b bigint"
    edges = materialise(links.select("a", "b").where("a <> b").mapInArrow(_spanning, schema), "edges")
    maps: list[DataFrame] = []
    while edges.count() > LAST_EDGES:
        rank = lambda c: F.xxhash64(F.lit(len(maps)), F.col(c))  # noqa: B023, E731
        both = edges.union(edges.select("b", "a"))
        choice = both.groupBy("a").agg(F.min(F.struct(rank("b").alias("r"), F.col("b").alias("to"))).alias("m"))
        own = F.struct(rank("a").alias("r"), F.col("a").alias("to"))
        step = materialise(choice.select(F.col("a").alias("id"), F.least(own, F.col("m"))["to"].alias("to")), "mates")
        maps.append(step)
        ends = edges.join(step.withColumnsRenamed({"id": "a", "to": "x"}), "a").join(step.withColumnsRenamed({"id": "b", "to": "y"}), "b")
        edges = materialise(ends.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).mapInArrow(_spanning, schema), "edges")
    last = edges.repartition(1).mapInArrow(_spanning, schema)
    roots = materialise(last.select(F.col("a").alias("id"), F.col("b").alias("root")), "roots")
    for step in reversed(maps):
        found = step.join(roots.withColumnRenamed("id", "to"), "to", "left").select("id", F.coalesce("root", "to").alias("root"))
        roots = materialise(found, "roots")
    # Roots stand for themselves; ids are named by the least one.
    every = roots.union(roots.select(F.col("root").alias("id"), "root")).distinct()
    least = every.groupBy("root").agg(F.min("id").alias("component"))
    return materialise(every.join(materialise(least, "least"), "root").select("id", "component"), "components")
