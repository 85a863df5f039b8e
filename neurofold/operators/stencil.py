"""Image-neighbourhood operators.

Small stencils and everything relational are joins of pixels with an offset table; wide
stencils run as shifted-array kernels on one plane a group (``kernel``), which spares a
row per pixel and offset.  Both address pixels by the 1-based column-major index, and
those that the reference semantics wrap between columns do so here unless strict.

A plane need not have all its pixels: kernels take ``there``, which says what pixels it has
(None: all), and the others neither count as neighbours nor become rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIXEL = "z bigint, y bigint, x bigint, ind bigint"


def disk(radius: float) -> np.ndarray:
    """(dy, dx) of a flat disk, centre included."""
    r = int(radius)
    dy, dx = np.mgrid[-r : r + 1, -r : r + 1]
    keep = dy * dy + dx * dx <= radius * radius
    return np.stack([dy[keep], dx[keep]], 1)


def shifted(image: np.ndarray, dy: int, dx: int, fill) -> np.ndarray:
    """image[y + dy, x + dx], ``fill`` outside."""
    out = np.full_like(image, fill)
    h, w = image.shape
    y0, y1, x0, x1 = max(0, -dy), min(h, h - dy), max(0, -dx), min(w, w - dx)
    if y0 < y1 and x0 < x1:
        out[y0:y1, x0:x1] = image[y0 + dy : y1 + dy, x0 + dx : x1 + dx]
    return out


def wrapped(image: np.ndarray, dy: int, dx: int) -> np.ndarray:
    """Value at linear index (ind + dx * height + dy) modulo the plane."""
    h = image.shape[0]
    return np.roll(image.ravel(order="F"), -(dx * h + dy)).reshape(image.shape, order="F")


def known(image: np.ndarray, there: np.ndarray | None, fill) -> np.ndarray:
    """The image with ``fill`` where it has no pixel."""
    return image if there is None else np.where(there, image, fill)


def erode(image: np.ndarray, radius: int, there: np.ndarray | None = None) -> np.ndarray:
    high = np.iinfo(np.int64).max
    own = known(image, there, high)
    return np.minimum.reduce([shifted(own, dy, dx, high) for dy, dx in disk(radius)])


def dilate(image: np.ndarray, radius: int, there: np.ndarray | None = None) -> np.ndarray:
    low = np.iinfo(np.int64).min
    own = known(image, there, low)
    return np.maximum.reduce([shifted(own, dy, dx, low) for dy, dx in disk(radius)])


def opening(image: np.ndarray, radius: int, there: np.ndarray | None = None) -> np.ndarray:
    return dilate(erode(image, radius, there), radius, there)


def inside_count(shape: tuple[int, int], radius: int, there: np.ndarray | None = None) -> np.ndarray:
    """How many of the disk's offsets lie inside the image."""
    one = known(np.ones(shape, np.int64), there, 0)
    return sum(shifted(one, dy, dx, 0) for dy, dx in disk(radius))


def local_rank(image: np.ndarray, candidate: np.ndarray, radius: int, there: np.ndarray | None = None) -> np.ndarray:
    """Share of in-image neighbours (itself included) that are not brighter; 0 where not a candidate."""
    high = np.iinfo(np.int64).max
    own = known(image, there, high)
    below = sum((image >= shifted(own, dy, dx, high)).astype(np.int64) for dy, dx in disk(radius))
    return np.where(candidate, below / np.maximum(inside_count(image.shape, radius, there), 1), 0.0)


def local_average(values: np.ndarray, candidate: np.ndarray, radius: int, strict: bool = False) -> np.ndarray:
    """Mean over the disk of the values at candidates (0 elsewhere), in single precision."""
    own = np.where(candidate, values, 0.0)
    move = (lambda dy, dx: shifted(own, dy, dx, 0.0)) if strict else (lambda dy, dx: wrapped(own, dy, dx))
    offsets = disk(radius)
    total = sum(move(dy, dx) for dy, dx in offsets)
    return np.where(candidate, (total / len(offsets)).astype(np.float32), np.float32(0))


def local_max(values: np.ndarray, candidate: np.ndarray, radius: int, strict: bool = False) -> np.ndarray:
    """Candidates that no neighbour of the disk exceeds; plateaus all win."""
    move = (lambda dy, dx: shifted(values, dy, dx, -np.inf)) if strict else (lambda dy, dx: wrapped(values, dy, dx))
    top = np.maximum.reduce([move(dy, dx) for dy, dx in disk(radius)])
    return candidate & (values >= top)


def stamp(seed: np.ndarray, radius: int, strict: bool = False) -> np.ndarray:
    """Paints the disk at every seed by linear offsets; offsets beyond the plane are dropped, others may wrap columns."""
    if strict:
        return np.logical_or.reduce([shifted(seed, dy, dx, False) for dy, dx in disk(radius)])
    h, w = seed.shape
    at = np.flatnonzero(seed.ravel(order="F"))
    spots = (at[:, None] + (disk(radius) @ np.array([1, h]))[None, :]).ravel()
    out = np.zeros(h * w, bool)
    out[spots[(spots >= 0) & (spots < h * w)]] = True
    return out.reshape(seed.shape, order="F")


def label8(mask: np.ndarray) -> np.ndarray:
    """8-connected components, numbered by their first pixel in column-major order (0: background)."""
    h, w = mask.shape
    flat = mask.ravel(order="F")
    node = np.flatnonzero(flat)
    slot = np.full(h * w, -1)
    slot[node] = np.arange(len(node))
    grid = slot.reshape(mask.shape, order="F")
    a, b = [], []
    for dy, dx in ((1, 0), (0, 1), (1, 1), (-1, 1)):
        other = shifted(grid, dy, dx, -1)
        both = (grid >= 0) & (other >= 0)
        a.append(grid[both])
        b.append(other[both])
    root, a, b = np.arange(len(node)), np.concatenate(a), np.concatenate(b)
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        open_ = low < high
        a, b = a[open_], b[open_]
        np.minimum.at(root, high[open_], low[open_])
        while (root[root] != root).any():
            root = root[root]
    out = np.zeros(h * w, np.int64)
    if len(node):
        out[node] = np.unique(root, return_inverse=True)[1] + 1
    return out.reshape(mask.shape, order="F")


def kernel(pixels: DataFrame, make, columns: dict[str, str], value: str = "v", keep=None, size: tuple[int, int] | None = None) -> DataFrame:
    """Runs make(image) -> {name: array} on each plane z of pixels (z, y, x, value); rows of the pixels with the results.

    keep(results) may say which pixels become rows.  size: height and width of the planes, which only pixels that fill
    their planes may leave out; with it, make also gets which pixels the plane has, and without keep these become rows.
    """
    schema = PIXEL + "".join(f", {n} {t}" for n, t in columns.items())
    kinds = {"bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}

    def run(table: pa.Table) -> pa.Table:
        z, y, x, v = (table.column(c).to_numpy() for c in ("z", "y", "x", value))
        image = np.zeros(size or (int(y.max()), int(x.max())), np.int64 if np.issubdtype(v.dtype, np.integer) else np.float64)
        image[y - 1, x - 1] = v
        there = np.full(image.shape, size is None)
        there[y - 1, x - 1] = True
        made = make(image) if size is None else make(image, there)
        pick = there if keep is None else keep(made)
        ys, xs = np.nonzero(pick)
        out = {"z": pa.array(np.full(len(ys), z[0])), "y": pa.array(ys + 1), "x": pa.array(xs + 1), "ind": pa.array(xs * image.shape[0] + ys + 1)}
        return pa.table(out | {n: pa.array(made[n][ys, xs].astype({"bigint": np.int64, "double": np.float64, "boolean": bool}[t]), kinds[t]) for n, t in columns.items()})

    return pixels.select("z", "y", "x", value).groupBy("z").applyInArrow(run, schema)


def offset_counts(pixels: DataFrame, radii: list[int], height: int, width: int) -> DataFrame:
    """(z, radius, dy, dx, pixels): how many pixels of a plane have a place of the image at each offset of the disks."""
    offsets = np.concatenate([np.insert(disk(r), 0, r, 1) for r in radii])

    def run(table: pa.Table) -> pa.Table:
        z, y, x = (table.column(c).to_numpy() for c in ("z", "y", "x"))
        # Sums of all pixels above and left of a corner; four of them give a rectangle's.
        corner = np.zeros((height + 1, width + 1), np.int64)
        np.add.at(corner, (y, x), 1)
        corner = corner.cumsum(0).cumsum(1)
        r, dy, dx = offsets.T
        (y0, y1), (x0, x1) = ((np.clip(-d, 0, n), np.clip(n - d, 0, n)) for d, n in ((dy, height), (dx, width)))
        count = np.where((y0 < y1) & (x0 < x1), corner[y1, x1] - corner[y0, x1] - corner[y1, x0] + corner[y0, x0], 0)
        some = count > 0
        columns = {"radius": r, "dy": dy, "dx": dx, "pixels": count}
        return pa.table({"z": pa.array(np.full(some.sum(), z[0]))} | {n: pa.array(c[some], pa.int32() if n == "radius" else pa.int64()) for n, c in columns.items()})

    return pixels.select("z", "y", "x").groupBy("z").applyInArrow(run, "z bigint, radius int, dy bigint, dx bigint, pixels bigint")


def grid_minima(pixels: DataFrame, size: int = 32, height: int | None = None) -> DataFrame:
    """(z, gy, gx, m): least value of each grid cell; rows below the last full cell have none, a partial last column has.

    height: of all planes; without it a plane ends with its last pixel.
    """
    sized = pixels.withColumn("h", F.lit(height)) if height else pixels.join(F.broadcast(pixels.groupBy("z").agg(F.max("y").alias("h"))), "z")
    rows = sized.where(F.col("y") <= F.floor(F.col("h") / size) * size)
    return rows.groupBy("z", F.floor((F.col("y") - 1) / size).alias("gy"), F.floor((F.col("x") - 1) / size).alias("gx")).agg(F.min("v").alias("m"), F.floor(F.first("h") / size).alias("gh"))


def local_contrast(pixels: DataFrame, threshold: float = 5, size: int = 32, height: int | None = None) -> DataFrame:
    """Pixels (z, y, x, ind, v, m) brighter by more than ``threshold`` than the mean of the 3 x 3 grid minima around.

    The neighbours are taken at linear grid positions, so they wrap between grid columns; positions off the grid are left out.
    """
    minima = grid_minima(pixels, size, height).withColumn("g", F.col("gx") * F.col("gh") + F.col("gy"))
    around = F.explode(F.array(*(F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a in (-1, 0, 1) for b in (-1, 0, 1)))).alias("d")
    asked = minima.select("z", "gy", "gx", "gh", "g", around).select("z", "gy", "gx", (F.col("g") + F.col("d.dx") * F.col("gh") + F.col("d.dy")).alias("g"))
    mean = asked.join(minima.select("z", "g", "m"), ["z", "g"]).groupBy("z", "gy", "gx").agg(F.avg("m").alias("m"))
    keyed = pixels.withColumn("gy", F.floor((F.col("y") - 1) / size)).withColumn("gx", F.floor((F.col("x") - 1) / size))
    # Merged: sizes estimated from the files do not see that pixels are exploded from rows, so they might be broadcast.
    return keyed.join(mean.hint("merge"), ["z", "gy", "gx"]).where(F.col("v") - F.col("m") > threshold).select("z", "y", "x", "ind", "v", "m")


def offset_join(pixels: DataFrame, radius: int, height: int, width: int) -> DataFrame:
    """Each pixel with the values of its in-image disk neighbours: (z, y, x, ind, v, nv).  The declared form of the kernels.

    Always a merge join: sizes estimated from the files do not see the rows that pixels and offsets make, and would have
    the driver collect them for a broadcast.
    """
    offsets = F.explode(F.array(*(F.struct(F.lit(int(a)).alias("dy"), F.lit(int(b)).alias("dx")) for a, b in disk(radius)))).alias("d")
    asked = pixels.select("z", "y", "x", "ind", "v", offsets).select("z", "y", "x", "ind", "v", (F.col("y") + F.col("d.dy")).alias("ny"), (F.col("x") + F.col("d.dx")).alias("nx"))
    asked = asked.where(F.col("ny").between(1, height) & F.col("nx").between(1, width))
    return asked.join(pixels.select("z", F.col("y").alias("ny"), F.col("x").alias("nx"), F.col("v").alias("nv")).hint("merge"), ["z", "ny", "nx"])


def median3x3(points: DataFrame, rows: int) -> DataFrame:
    """(z, g, med): median of a value over the bright 3 x 3 neighbours on a grid of ``rows`` rows, at linear positions (wraps)."""
    steps = F.explode(F.array(*(F.lit(a + b * rows) for a in (-1, 0, 1) for b in (-1, 0, 1)))).alias("d")
    asked = points.select("z", "g", steps).select("z", F.col("g").alias("own"), (F.col("g") + F.col("d")).alias("g"))
    return asked.join(points, ["z", "g"]).groupBy("z", F.col("own").alias("g")).agg(F.median("v").alias("med"))
