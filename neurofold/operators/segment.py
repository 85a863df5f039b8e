"""Cell segmentation: candidates, two rounds of rank-filtered seeds, labels and region properties."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import Params
from ..functions.semantics import mround
from ..sources.tiff import image_of, whole
from . import stencil as S


def radii(p: Params) -> dict[str, int]:
    """Disk radii of the stages, from the cell radius."""
    return {"rank": 2 * p.cell_radius, "average": mround(p.cell_radius / 2) + 1, "max": p.cell_radius + 2, "clean": 3}


def contrast_mask(image: np.ndarray, threshold: float, size: int = 32, there: np.ndarray | None = None) -> np.ndarray:
    """Pixels brighter than the mean of the grid minima around by more than the threshold, in array form."""
    h, w = image.shape
    gh, gw = h // size, -(-w // size)
    out = np.zeros(image.shape, bool)
    if not gh:
        return out
    high = np.iinfo(np.int64).max
    padded = np.full((gh * size, gw * size), high, image.dtype)
    padded[:, :w] = S.known(image, there, high)[: gh * size]
    minima = padded.reshape(gh, size, gw, size).min((1, 3)).ravel(order="F").astype(float)
    filled = minima < float(high)
    total, n = np.zeros(gh * gw), np.zeros(gh * gw)
    for d in (a + b * gh for a in (-1, 0, 1) for b in (-1, 0, 1)):
        at = np.arange(gh * gw) + d
        ok = (at >= 0) & (at < gh * gw)
        ok[ok] = filled[at[ok]]
        total[ok] += minima[at[ok]]
        n[ok] += 1
    mean = (total / np.maximum(n, 1)).reshape(gh, gw, order="F")
    wide = np.repeat(np.repeat(mean, size, 0), size, 1)[:, :w]
    out[: gh * size] = image[: gh * size] - wide > threshold
    return out


def seeds(image: np.ndarray, candidate: np.ndarray, max_radius: int, r: dict[str, int], strict: bool, there: np.ndarray | None = None):
    """Rank, averaged rank and the local maxima of it above 0.4."""
    rank = S.local_rank(image, candidate, r["rank"], there)
    average = S.local_average(rank, candidate, r["average"], strict)
    return rank, average, S.local_max(average.astype(float), candidate, max_radius, strict) & (average > 0.4)


def segment_plane(image: np.ndarray, p: Params, there: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """All stages on one plane; ``label`` numbers the cells.  Pixels that are not there are no neighbours, candidates or cell pixels."""
    r, strict = radii(p), p.edge_mode == "strict"
    contrast = S.opening(contrast_mask(image, p.cont_threshold, there=there).astype(np.int64), r["clean"], there) > 0
    candidate = S.known(contrast & (image > p.br_threshold), there, False)
    none = np.zeros(image.shape, bool)
    out = {"candidate": candidate, "seed1": none, "seed2": none, "remaining": none, "mask1": none, "mask2": none, "label": np.zeros(image.shape, np.int64)}
    if not candidate.any():
        return out
    *_, out["seed1"] = seeds(image, candidate, r["max"], r, strict, there)
    out["mask1"] = S.stamp(out["seed1"], r["average"], strict)
    wide = S.known(S.dilate(out["mask1"].astype(np.int64), r["max"], there), there, 1)
    free = S.opening(1 - wide, r["clean"], there) > 0
    out["remaining"] = candidate & free
    if out["remaining"].any():
        # The second round takes maxima over the averaging disk.
        *_, out["seed2"] = seeds(image, out["remaining"], r["average"], r, strict, there)
        out["mask2"] = S.stamp(out["seed2"], r["average"], strict)
    out["label"] = S.label8(S.known(out["mask1"] | out["mask2"], there, False))
    return out


def labels(pixels: DataFrame, p: Params, size: tuple[int, int] | None = None) -> DataFrame:
    """(z, y, x, ind, label) of all cell pixels; size: height and width of planes that may lack pixels."""
    return S.kernel(pixels, lambda image, there=None: segment_plane(image, p, there), {"label": "bigint"}, keep=lambda m: m["label"] > 0, size=size)


def labels_of_pages(pages: DataFrame, p: Params) -> DataFrame:
    """``labels`` from grey pages (page, h, w, bits, kind, px row-major), one page a group: only cell pixels become rows."""

    def run(table: pa.Table) -> pa.Table:
        z, *page = (table.column(c)[0].as_py() for c in ("page", "h", "w", "bits", "kind", "px"))
        image, (h, w) = whole(image_of(*page)), page[:2]
        label = segment_plane(image, p)["label"]
        y, x = np.nonzero(label)
        return pa.table({"z": pa.array(np.full(len(y), z, np.int64)), "y": pa.array(y + 1), "x": pa.array(x + 1), "ind": pa.array(x * h + y + 1), "label": pa.array(label[y, x])})

    return pages.select("page", "h", "w", "bits", "kind", "px").groupBy("page").applyInArrow(run, S.PIXEL + ", label bigint")


def region_properties(labelled: DataFrame) -> DataFrame:
    """One row a cell: (cell_id, z, label, cy, cx, area, inds, bounds); ids follow planes and labels, with no gaps.

    Planes without cells leave no placeholder.
    """
    cells = labelled.groupBy("z", "label").agg(
        F.round(F.avg("y")).cast("long").alias("cy"),
        F.round(F.avg("x")).cast("long").alias("cx"),
        F.count("*").alias("area"),
        F.sort_array(F.collect_list("ind")).alias("inds"),
        F.min("y").alias("y_min"),
        F.max("y").alias("y_max"),
        F.min("x").alias("x_min"),
        F.max("x").alias("x_max"),
    )
    # Ids: a running count over planes (few rows) plus the label, so no task orders all cells.
    before = W.orderBy("z").rowsBetween(W.unboundedPreceding, -1)
    planes = labelled.groupBy("z").agg(F.max("label").alias("n")).select("z", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return cells.join(F.broadcast(planes), "z").withColumn("cell_id", F.col("before") + F.col("label")).drop("before")


def components(mask: DataFrame, height: int, width: int) -> DataFrame:
    """(z, y, x, ind, label) of the 8-connected components of mask pixels (z, y, x) of planes of one size."""
    return S.kernel(mask.withColumn("v", F.lit(1).cast("long")), lambda image, there: {"label": S.label8(there)}, {"label": "bigint"}, keep=lambda m: m["label"] > 0, size=(height, width))


# The ten overlay colours, by label modulo 10.
COLOURS = [(122, 0, 0), (255, 0, 0), (209, 102, 0), (163, 204, 0), (82, 230, 51), (0, 255, 102), (0, 178, 178), (0, 102, 255), (0, 51, 255), (204, 0, 255)]


def palette(labelled: DataFrame) -> DataFrame:
    """(z, y, x, label, red, green, blue): overlay colours of the cell pixels, by label modulo 10."""
    pick = lambda k: F.element_at(F.array(*(F.lit(c[k]) for c in COLOURS)), (F.col("label") % 10 + 1).cast("int")).cast("long")
    return labelled.select("z", "y", "x", "label", pick(0).alias("red"), pick(1).alias("green"), pick(2).alias("blue"))


def normalised(pixels: DataFrame, threshold: float) -> DataFrame:
    """Pixels (z, y, x, v) with n: v from the plane's least value to the candidates' 5 % level as 0 to 1, cut at 1.

    Candidates are brighter than the threshold; up to 20 of them, or none, take the plane's largest value as the level.
    """
    counts = pixels.where(F.col("v") > threshold).groupBy("z", "v").agg(F.count("*").alias("k"))
    down = W.partitionBy("z").orderBy(F.desc("v"))
    # The value at rank round(n / 20) from the top, by running counts of distinct values.
    ranked = counts.withColumn("so_far", F.sum("k").over(down)).withColumn("n", F.sum("k").over(W.partitionBy("z")))
    level = ranked.groupBy("z").agg(F.max(F.when((F.col("n") > 20) & (F.col("so_far") >= F.round(F.col("n") / 20)), F.col("v"))).alias("level"))
    whole = pixels.groupBy("z").agg(F.min("v").alias("lo"), F.max("v").alias("top"))
    scale = whole.join(level, "z", "left").withColumn("hi", F.coalesce("level", "top"))
    share = F.coalesce(F.try_divide((F.col("v") - F.col("lo")).cast("double"), F.col("hi") - F.col("lo")), F.lit(0.0))
    return pixels.join(F.broadcast(scale), "z").select("z", "y", "x", F.least(share, F.lit(1.0)).alias("n"))


def overlay(pixels: DataFrame, labelled: DataFrame, width: int, normalised: str = "n") -> DataFrame:
    """(z, y, x, red, green, blue): two panels of each plane side by side with a white line between.

    pixels: (z, y, x, n) of planes of this width, with n in [0, 1].  The left panel is the image at full brightness, the right one at 150 of 255 with
    the cells in their colours.
    """
    grey = lambda top: F.round(F.col(normalised) * top).cast("long")
    same = lambda c: [c.alias(n) for n in ("red", "green", "blue")]
    left = pixels.select("z", "y", "x", *same(grey(255)))
    line = pixels.select("z", "y").distinct().select("z", "y", F.lit(width + 1).cast("long").alias("x"), *same(F.lit(255).cast("long")))
    colours = palette(labelled).drop("label")
    right = pixels.join(colours, ["z", "y", "x"], "left").select("z", "y", (F.col("x") + width + 1).alias("x"), *(F.coalesce(F.col(c), grey(150)).alias(c) for c in ("red", "green", "blue")))
    return left.union(line).union(right)
