"""Cell traces from frames, and duplicate removal across planes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import materialise
from .components import components
from .stencil import label8
from .traces import pair_correlation


def roi_means(frames: DataFrame, cell_pixels: DataFrame) -> DataFrame:
    """(cell_id, t, f): mean of each cell's pixels (cell_id, z, ind) in every frame (z, t, ind, v), in single precision."""
    # Merged: sizes estimated from the files do not see that both sides are exploded, so either might be broadcast.
    return frames.join(cell_pixels.hint("merge"), ["z", "ind"]).groupBy("cell_id", "t").agg(F.avg("v").cast("float").alias("f"))


def cell_pixels(cells: DataFrame) -> DataFrame:
    return cells.select("cell_id", "z", F.explode("inds").alias("ind"))


def stamps(cells: DataFrame, height: int, width: int) -> DataFrame:
    """(z, ind, cell_id): 5 x 5 pixels around each centre; a later cell overwrites; the last pixel of a plane is out of bounds."""

    def run(cell: pa.Table) -> pa.Table:
        ind, who = _painted(cell, height, width)
        return pa.table({"z": pa.array(np.full(len(ind), cell.column("z")[0].as_py(), np.int64)), "ind": ind, "cell_id": who})

    return _centres(cells).groupBy("z").applyInArrow(run, "z bigint, ind bigint, cell_id bigint")


def _centres(cells: DataFrame) -> DataFrame:
    return cells.select(*(F.col(c).cast("long").alias(c) for c in ("cell_id", "z", "cy", "cx")))


def _painted(cell: pa.Table, height: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    ids, cy, cx = (cell.column(c).to_numpy() for c in ("cell_id", "cy", "cx"))
    return painted(ids, (cx - 1) * height + cy, height, width)


def painted(ids: np.ndarray, centre: np.ndarray, height: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Pixels of the stamps around a plane's centres (linear indices), in order, and the largest id at each."""
    at = (centre[:, None] + (np.arange(-2, 3)[None, :] * height + np.arange(-2, 3)[:, None]).ravel()).ravel()
    who = np.repeat(ids, 25)
    ok = (at > 0) & (at < height * width)
    at, who = at[ok], who[ok]
    by = np.lexsort((who, at))
    at, who = at[by], who[by]
    top = np.append(at[1:] != at[:-1], True)[: len(at)]
    return at[top], who[top]


def _shared(cells: DataFrame, height: int, width: int, make, schema: str) -> DataFrame:
    """make(z, ind, a, b) on the pixels that stamps of z and z + 1 share: two planes' centres meet, their pixels are no rows."""
    own = _centres(cells)
    # Columns of its own: a side that shares them with the other loses them where the result meets itself.
    below = own.select((F.col("z") - 1).alias("above"), *(F.col(c).alias(f"low_{c}") for c in ("cell_id", "cy", "cx")))
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(upper: pa.Table, lower: pa.Table) -> pa.Table:
        if not upper.num_rows or not lower.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in columns})
        lower = lower.rename_columns([c.removeprefix("low_") for c in lower.column_names])
        (i, a), (j, b) = _painted(upper, height, width), _painted(lower, height, width)
        ind, p, q = np.intersect1d(i, j, assume_unique=True, return_indices=True)
        return pa.table(dict(zip(columns, make(upper.column("z")[0].as_py(), ind, a[p], b[q]), strict=True)))

    return own.groupBy("z").cogroup(below.groupBy("above")).applyInArrow(run, schema)


def overlaps(cells: DataFrame, height: int, width: int) -> DataFrame:
    """(a, b): cells of plane z and z + 1 whose stamps share a pixel."""
    return _shared(cells, height, width, lambda z, ind, a, b: np.unique(np.stack([a, b]), axis=1), "a bigint, b bigint")


def _overlap_labels(cells: DataFrame, height: int, width: int) -> DataFrame:
    """(z, label, a, b): pixels that stamps of z and z + 1 share, by their component, no cell removed."""

    make = lambda z, ind, a, b: (np.full(len(ind), z, np.int64), _region(ind, height, width), a, b)
    return _shared(cells, height, width, make, "z bigint, label bigint, a bigint, b bigint")


def _region(ind: np.ndarray, height: int, width: int) -> np.ndarray:
    """The 8-connected component of each of a plane's pixels."""
    mask = np.zeros(height * width, bool)
    mask[ind - 1] = True
    return label8(mask.reshape(height, width, order="F")).ravel(order="F")[ind - 1]


def overlap_components(cells: DataFrame, height: int, width: int) -> DataFrame:
    """(z, label, above, below): components of overlapping stamps of z and z + 1 with their largest ids, no cell removed."""
    return _overlap_labels(cells, height, width).groupBy("z", "label").agg(F.max("a").alias("above"), F.max("b").alias("below"))


def duplicate_pairs(cells: DataFrame, points: DataFrame, height: int, width: int) -> DataFrame:
    """(a, b, r): correlations of all pairs that duplicate removal may ask for: cells of one no-removal component.

    Removals only shrink or split components, so these pairs are enough whatever is removed on the way.
    """

    def make(z: int, ind: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        label = _region(ind, height, width)
        sides = [np.unique(np.stack([label, c]), axis=1) for c in (a, b)]
        # Every a of a region with every b of it.
        first, last = (np.searchsorted(sides[1][0], sides[0][0], s) for s in ("left", "right"))
        n = last - first
        at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.unique(np.stack([np.repeat(sides[0][1], n), sides[1][1][at]]), axis=1)

    return pair_correlation(_shared(cells, height, width, make, "a bigint, b bigint"), points)


def interactions(cells: DataFrame, height: int, width: int) -> DataFrame:
    """(a, b): pairs of cells, of one plane or of neighbouring ones, whose stamps share or touch at a pixel, and each cell with itself.

    Whether a cell is removed depends on cells that such pairs reach, and on no others.
    """
    s = stamped(cells, height, width)
    y, x = F.pmod(F.col("ind") - 1, F.lit(height)), F.floor((F.col("ind") - 1) / height)
    around = F.explode(F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(dz).alias("dz")) for dz in (0, 1) for dy in (-1, 0, 1) for dx in (-1, 0, 1)))).alias("d")
    reached = s.select("z", "cell_id", "ind", y.alias("y"), x.alias("x"), around)
    inside = (F.col("y") + F.col("d.dy")).between(0, height - 1) & (F.col("x") + F.col("d.dx")).between(0, width - 1)
    reached = reached.where(inside).select((F.col("z") + F.col("d.dz")).alias("z"), (F.col("ind") + F.col("d.dx") * height + F.col("d.dy")).alias("ind"), F.col("cell_id").alias("a")).distinct()
    pairs = reached.join(s.withColumnRenamed("cell_id", "b"), ["z", "ind"]).select("a", "b").distinct()
    return pairs.union(cells.select(F.col("cell_id").alias("a"), F.col("cell_id").alias("b"))).distinct()


def stamped(cells: DataFrame, height: int, width: int) -> DataFrame:
    """(z, ind, cell_id): the pixels of every cell's 5 x 5 stamp, whoever else has them."""
    return stamp_inds(cells, height, width).select("z", F.explode("inds").alias("ind"), "cell_id")


def stamp_inds(cells: DataFrame, height: int, width: int) -> DataFrame:
    """(cell_id, z, inds): the same as an array for each cell."""
    offsets = F.array(*(F.lit(c * height + r) for c in range(-2, 3) for r in range(-2, 3)))
    centre = (F.col("cx") - 1) * height + F.col("cy")
    return cells.select("cell_id", "z", F.filter(F.transform(offsets, lambda o: centre + o), lambda i: (i > 0) & (i < height * width)).alias("inds"))


def touching_labels(ind: np.ndarray, height: int) -> np.ndarray:
    """For sorted distinct linear indices the least index of their 8-connected region, by the pixels alone."""
    label = np.arange(len(ind))
    y = (ind - 1) % height
    sides = []
    for step, ok in ((1, y < height - 1), (height - 1, y > 0), (height, y >= 0), (height + 1, y < height - 1)):
        at = np.minimum(np.searchsorted(ind, ind + step), len(ind) - 1)
        i = np.flatnonzero(ok & (ind[at] == ind + step))
        sides.append((i, at[i]))
    i, j = (np.concatenate([s[k] for s in sides]) for k in (0, 1))
    while True:
        low, high = np.minimum(label[i], label[j]), np.maximum(label[i], label[j])
        if (low == high).all():
            return label
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label = label[label]


#: Cells that are folded together.
FOLD = 20_000


def greedy_duplicates(cells: DataFrame, correlations: DataFrame, height: int, width: int, threshold: float, fold: int = FOLD) -> DataFrame:
    """cell_ids that duplicate removal drops, plane by plane: a dropped cell drops no other.

    Cells are grouped by the connected components of ``interactions`` over all planes: what happens in one has no bearing on
    another.  Components are dealt to groups of about ``fold`` cells (one group is at least one component); a group holds
    centres and the pairs above the threshold, never traces or images, and folds its planes in order.
    """
    cells = cells.select("cell_id", *(F.col(c).cast("long").alias(c) for c in ("z", "cy", "cx")))
    found = materialise(components(interactions(cells, height, width)), "cell-components")
    groups = max(1, -(-found.count() // fold))
    grouped = found.select(F.col("id").alias("cell_id"), F.pmod(F.xxhash64("component"), F.lit(groups)).alias("group"))
    own = cells.join(grouped, "cell_id").select("group", "cell_id", "z", "cy", "cx")
    high = correlations.where((F.col("r") > threshold) & ~F.isnan("r")).select(F.col("a").alias("cell_id"), F.col("b").alias("other"))
    high = high.join(grouped, "cell_id").select(F.col("group").alias("own_group"), "cell_id", "other")

    def run(cell: pa.Table, pair: pa.Table) -> pa.Table:
        ids, z, cy, cx = (cell.column(c).to_numpy() for c in ("cell_id", "z", "cy", "cx"))
        order = np.lexsort((ids, z))
        ids, z, centre = ids[order], z[order], ((cx - 1) * height + cy)[order]
        linked = set(zip(pair.column("cell_id").to_pylist(), pair.column("other").to_pylist(), strict=True))
        alive = np.ones(len(ids), bool)

        def plane(k: int) -> tuple[np.ndarray, np.ndarray]:
            """Pixels of the living stamps of a plane, and the largest id at each."""
            first, last = np.searchsorted(z, (k, k + 1))
            here = np.flatnonzero(alive[first:last]) + first
            return painted(ids[here], centre[here], height, width)

        for k in np.unique(z).tolist():
            (a, above), (b, below) = plane(k), plane(k + 1)
            shared, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
            if not len(shared):
                continue
            label = touching_labels(shared, height)
            tops = np.zeros((2, len(shared)), np.int64)
            for side, image in zip(tops, (above[i], below[j]), strict=True):
                np.maximum.at(side, label, image)
            first, last = np.searchsorted(z, (k + 1, k + 2))
            for pair_ in zip(*tops[:, np.unique(label)].tolist(), strict=True):
                if pair_ in linked:
                    alive[first + np.searchsorted(ids[first:last], pair_[1])] = False
        return pa.table({"cell_id": pa.array(ids[~alive], pa.int64())})

    return own.groupBy("group").cogroup(high.groupBy("own_group")).applyInArrow(run, "cell_id bigint")
