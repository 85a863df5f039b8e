"""Connected components of a table of links, by contraction with random ranks.

In a round every node points to the neighbour, or itself, of least random rank; links are redrawn between the nodes
pointed to, so their number falls by a constant factor a round for chains and stars alike.  Rounds are written tables.
Once at most ``FEW`` links are left, a task finishes them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import materialise

#: Links that one task finishes.
FEW = 500_000


def least_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links, and the least node that each reaches."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = place[: len(a)], place[len(a) :]
    least = np.arange(len(nodes))
    while True:
        low, high = np.minimum(least[i], least[j]), np.maximum(least[i], least[j])
        if (low == high).all():
            return nodes, nodes[least]
        np.minimum.at(least, high, low)
        while (least[least] != least).any():
            least = least[least]


def _finished(links: DataFrame) -> DataFrame:
    def run(batches):
        held = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches]
        if held:
            nodes, least = least_reached(*map(np.concatenate, zip(*held, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(least)], ["id", "to"])

    return links.coalesce(1).mapInArrow(run, "id bigint, to bigint")


def components(links: DataFrame, few: int = FEW) -> DataFrame:
    """(id, component): each node of links (a, b) with the least node that links reach.  A link to itself only names its node."""
    left = links = materialise(links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).distinct(), "links")
    pointers = []
    while (n := left.count()) > few:
        apart = left.where("a <> b")
        if apart.isEmpty():
            break
        both = apart.select("a", "b").union(apart.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(F.lit(len(pointers)), c), F.col(c))  # noqa: B023, E731
        least = both.groupBy("a").agg(F.min(rank("b")).alias("m"))
        point = materialise(least.select(F.col("a").alias("id"), F.when(rank("a") < F.col("m"), F.col("a")).otherwise(F.col("m.b")).alias("to")), "pointers")
        pointers.append(point)
        to = lambda side: point.select(F.col("id").alias(side), F.col("to").alias(f"to_{side}"))  # noqa: B023, E731
        left = materialise(apart.join(to("a"), "a").join(to("b"), "b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b")).distinct(), "links")
    if n <= few:
        pointers.append(_finished(left))
    if len(pointers) == 1 and n <= few:
        return pointers[0].select("id", F.col("to").alias("component"))
    root = links.select(F.col("a").alias("id")).union(links.select(F.col("b").alias("id"))).distinct().withColumn("root", F.col("id"))
    for point in pointers:
        root = root.join(point.select(F.col("id").alias("root"), "to"), "root", "left").select("id", F.coalesce("to", "root").alias("root"))
    root = materialise(root, "roots")
    return root.join(root.groupBy("root").agg(F.min("id").alias("component")), "root").select("id", "component")
