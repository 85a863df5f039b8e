"""Tissue drift: block means, grid patches, cross-correlation shifts, tilts and their summaries."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.semantics import mean0, mround, std0
from ..sources.store import keep_planes, materialise, plane_rows

#: A mean image a row: little-endian doubles in the order of the linear index.
IMAGE = "z bigint, tp bigint, h int, w int, image binary"
#: Patches that are transformed at once.
PATCHES = 256
#: Planes whose images a worker keeps.
PLANES = 8


def block_images(blocks: DataFrame, cycle: int, limit: int | None = None) -> DataFrame:
    """(z, tp, h, w, image): ``block_means`` from frame blocks (z, t0, n, h, w, px), as images and without a row a pixel.

    Every block of frames is added up where it is read; the sums of a timepoint meet in one group.
    """
    last = 1 << 62 if limit is None else limit

    def add(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("z", "t0", "n", "h", "w", "px")}
                x = np.frombuffer(row["px"], "<u2").reshape(row["n"], -1)
                t = row["t0"] + np.arange(row["n"])
                tp = np.where(t <= last, (t - 1) // cycle + 1, 0)
                for k in np.unique(tp[tp > 0]):
                    total = x[tp == k].sum(0, dtype=np.int64).astype("<f8")
                    yield pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in ((row["z"], pa.int64()), (int(k), pa.int64()), (row["h"], pa.int32()), (row["w"], pa.int32()), (int((tp == k).sum()), pa.int64()), (total.tobytes(), pa.binary()))], ["z", "tp", "h", "w", "n", "image"])

    def join(table: pa.Table) -> pa.Table:
        whole = sum(table.column("n").to_pylist()) == cycle
        total = sum(np.frombuffer(b.as_py(), "<f8") for b in table.column("image")) / cycle
        return table.select(["z", "tp", "h", "w"])[: int(whole)].append_column("image", pa.array([total.tobytes()] * whole, pa.binary()))

    sums = blocks.select("z", "t0", "n", "h", "w", "px").mapInArrow(add, "z bigint, tp bigint, h int, w int, n bigint, image binary")
    return sums.groupBy("z", "tp").applyInArrow(join, IMAGE)


def mean_images(blocks: DataFrame, base: int = 0) -> DataFrame:
    """(z, h, w, image): mean image of all frames of each plane's stack, from frame blocks (z, t0, n, h, w, px).

    Blocks are added up where they are read and a task keeps one sum a plane, so a stack of any length sends a sum a task.
    base: as in ``planestack.blocks_of``; a pixel's mean is over the frames that have it, NaN if none has.
    """

    def add(batches):
        sums: dict[tuple[int, int, int], list] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                z, n, h, w = (batch.column(c)[i].as_py() for c in ("z", "n", "h", "w"))
                held = sums.setdefault((z, h, w), [np.zeros(h * w if base else 1, np.int64), np.zeros(h * w, np.int64)])
                x = np.frombuffer(batch.column("px")[i].as_buffer(), "<u2").reshape(n, -1)
                held[0] += (x > 0).sum(0) if base else n
                held[1] += x.sum(0, dtype=np.int64)
        for (z, h, w), (n, total) in sums.items():
            total -= base * n
            yield pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in ((z, pa.int64()), (h, pa.int32()), (w, pa.int32()), (n.tobytes(), pa.binary()), (total.tobytes(), pa.binary()))], ["z", "h", "w", "n", "image"])

    def join(table: pa.Table) -> pa.Table:
        n, total = (sum(np.frombuffer(b.as_buffer(), np.int64) for b in table.column(c)) for c in ("n", "image"))
        mean = np.where(n > 0, total / np.maximum(n, 1), np.nan)
        return table.select(["z", "h", "w"])[:1].append_column("image", pa.array([mean.astype("<f8").tobytes()], pa.binary()))

    sums = blocks.select("z", "n", "h", "w", "px").mapInArrow(add, "z bigint, h int, w int, n binary, image binary")
    return sums.groupBy("z").applyInArrow(join, "z bigint, h int, w int, image binary")


def page_images(pages: DataFrame) -> DataFrame:
    """(z, h, w, image) of grey pages (page, h, w, bits, kind, px row-major)."""

    def turn(batches):
        for batch in batches:
            for row in batch.to_pylist():
                image = np.frombuffer(row["px"], f"<{row['kind']}{row['bits'] // 8}").reshape(row["h"], row["w"])
                yield pa.RecordBatch.from_arrays([pa.array([row["page"]], pa.int64()), pa.array([row["h"]], pa.int32()), pa.array([row["w"]], pa.int32()), pa.array([image.astype("<f8").tobytes(order="F")], pa.binary())], ["z", "h", "w", "image"])

    return pages.select("page", "h", "w", "bits", "kind", "px").mapInArrow(turn, "z bigint, h int, w int, image binary")


def patch_index(ind: np.ndarray, height: int, radius: int) -> np.ndarray:
    """0-based linear indices of the patches of start indices, columns of a patch first; patches are centred one column left."""
    roi = 2 * radius + 1
    k = np.arange(roi * roi)
    return ind[:, None] - 1 + ((k // roi - radius - 1) * height + k % roi - radius)[None, :]


def patch_means_of_images(images: DataFrame, radius: int) -> DataFrame:
    """(z, grid_idx, ind, m) as ``patch_means`` over the whole grid, from images (z, h, w, image)."""
    roi = 2 * radius + 1

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                z, h, w = (batch.column(c)[i].as_py() for c in ("z", "h", "w"))
                image = np.frombuffer(batch.column("image")[i].as_py(), "<f8")
                ny, nx = max(0, (h - 2 * roi) // radius), max(0, (w - 2 * roi) // radius)
                gy, gx = np.tile(np.arange(ny), nx), np.repeat(np.arange(nx), ny)
                ind = (roi + gx * radius) * h + roi + gy * radius + 1
                m = [image[patch_index(ind[a : a + PATCHES], h, radius)].mean(1) for a in range(0, len(ind), PATCHES)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ind), z)), pa.array(np.arange(len(ind)) + 1), pa.array(ind), pa.array(np.concatenate(m) if m else np.zeros(0))], ["z", "grid_idx", "ind", "m"])

    return images.select("z", "h", "w", "image").mapInArrow(run, "z bigint, grid_idx bigint, ind bigint, m double")


def circular(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Plain cross-correlation of images (the last two axes) over all circular shifts.

    NaN stands for pixels that an image lacks: they add nothing, and a shift that brings no two pixels together never wins.
    """
    cross = lambda a, b: np.fft.ifft2(np.fft.fft2(a) * np.conj(np.fft.fft2(b)))
    there = [~np.isnan(x) for x in (source, target)]
    if all(x.all() for x in there):
        return cross(source, target)
    power = cross(np.nan_to_num(source), np.nan_to_num(target))
    return np.where(cross(*(x.astype(float) for x in there)).real > 0.5, power, np.nan)


def shifts_of_patches(source: np.ndarray, target: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(dy, dx) of the greatest plain cross-correlation, first in column-major order, of patches (one a row, columns of a patch first).

    The wrap of dy is taken over as it is: a shift of -radius comes out as radius + 1.  Pixels that are missing (NaN) add nothing.
    """
    roi = 2 * radius + 1
    power = np.abs(np.fft.fftshift(circular(source.reshape(-1, roi, roi), target.reshape(-1, roi, roi)), (1, 2)))
    # Sums of whole numbers that are equal stay equal.
    power = np.round(np.nan_to_num(power, nan=-1.0), 6)
    p = power.reshape(len(source), -1).argmax(1) + 1
    dy = -(p % roi - radius - 1)
    return np.where(dy == -radius - 1, radius, dy), -(-(-p // roi) - radius - 1)


@functools.lru_cache(maxsize=PLANES)
def plane_image(path: str, z: int) -> np.ndarray | None:
    """The image of a plane of a table that ``keep_planes`` has written, if it has one; a worker keeps the last planes."""
    rows = plane_rows(path, z)
    return np.frombuffer(rows.column("image")[0].as_py(), "<f8") if rows.num_rows else None


@functools.lru_cache(maxsize=PLANES)
def plane_points(path: str, z: int) -> tuple[np.ndarray, np.ndarray]:
    rows = plane_rows(path, z)
    points = rows.column("points")[0].values if rows.num_rows else None
    return tuple(points.field(c).to_numpy().astype(np.int64) for c in ("grid_idx", "ind")) if points is not None else (np.zeros(0, np.int64),) * 2


def displacements_of_images(images: DataFrame, references: DataFrame, points: DataFrame, radius: int, single_plane: bool = False) -> DataFrame:
    """``displacements`` from images: (z, tp, h, w, image), reference images (z, h, w, image) and bright points (z, grid_idx, ind).

    No image is shuffled: a task reads its plane's points, first image and references from written tables, and keeps them from
    row to row.  The images should therefore come in the order of their planes.  NaN stands for missing pixels: a patch that
    has none at all, here or in the first image, has no row, and only patches without missing pixels are searched in z.
    """
    asked = points.select(F.col("z").cast("long").alias("z"), F.struct(F.col("grid_idx").cast("long").alias("grid_idx"), F.col("ind").cast("long").alias("ind")).alias("p"))
    asked = keep_planes(asked.groupBy("z").agg(F.sort_array(F.collect_list("p")).alias("points")), "motion-points")
    whole = lambda df: df.select(F.col("z").cast("long").alias("z"), "image")
    firsts = keep_planes(whole(images.where("tp = 1")), "motion-firsts")
    sides = None if single_plane else keep_planes(whole(references), "motion-references")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                z, tp, h = (batch.column(c)[i].as_py() for c in ("z", "tp", "h"))
                grid, ind = plane_points(asked, z)
                first = plane_image(firsts, z) if len(ind) else None
                if first is None:
                    continue
                own = np.frombuffer(batch.column("image")[i].as_buffer(), "<f8")
                if np.isnan(own).any() or np.isnan(first).any():
                    some = np.concatenate([~(np.isnan(own[p]).all(1) | np.isnan(first[p]).all(1)) for p in (patch_index(ind[a : a + PATCHES], h, radius) for a in range(0, len(ind), PATCHES))])
                    grid, ind = grid[some], ind[some]
                    if not len(ind):
                        continue
                found = shifts_at(own, first, {d: plane_image(sides, z + d) for d in range(-2, 3)} if sides else {}, ind, h, radius)
                same = lambda v: pa.array(np.full(len(ind), v, np.int64))
                yield pa.RecordBatch.from_arrays([same(z), pa.array(grid), pa.array(ind), same(tp), *map(pa.array, found)], [c.split()[0] for c in SHIFTS.split(", ")])

    return images.select("z", "tp", "h", "image").mapInArrow(run, SHIFTS)


def shifts_at(own: np.ndarray, first: np.ndarray, sides: dict[int, np.ndarray | None], ind: np.ndarray, h: int, radius: int) -> list[np.ndarray]:
    """dy, dx and dz of the patches of an image at start indices, against the plane's first image and the planes around."""
    out = []
    for a in range(0, len(ind), PATCHES):
        place = patch_index(ind[a : a + PATCHES], h, radius)
        target = own[place]
        dy, dx = shifts_of_patches(first[place], target, radius)
        moved, best, dz = place - (dx * h + dy)[:, None], np.full(len(place), -np.inf), np.zeros(len(place))
        for d, side in sorted(sides.items()):
            if side is None:
                continue
            there = (moved.min(1) >= 0) & (moved.max(1) < len(side))
            r = np.full(len(place), np.nan)
            r[there] = correlations(target[there], side[moved[there]])
            better = r > best
            best, dz = np.where(better, r, best), np.where(better, d, dz)
        out.append([dy.astype(float), dx.astype(float), dz.astype(float)])
    return [np.concatenate(c) for c in zip(*out, strict=True)]


def images_of(pixels: DataFrame, height: int, width: int, time: str = "t") -> DataFrame:
    """(z, time, h, w, image) from pixels (z, time, y, x, v), one image a group; NaN where an image lacks a pixel."""

    def run(table: pa.Table) -> pa.Table:
        y, x, v = (table.column(c).to_numpy() for c in ("y", "x", "v"))
        image = np.full(height * width, np.nan)
        image[(x - 1) * height + y - 1] = v
        keys = {c: table.column(c)[:1].cast(pa.int64()) for c in ("z", time)}
        return pa.table(keys | {"h": pa.array([height], pa.int32()), "w": pa.array([width], pa.int32()), "image": pa.array([image.astype("<f8").tobytes()], pa.binary())})

    return pixels.select("z", time, "y", "x", F.col("v").cast("double").alias("v")).groupBy("z", time).applyInArrow(run, f"z bigint, {time} bigint, h int, w int, image binary")


def correlations(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``correlation`` of each row of a with the same one of b."""
    a, b = a - a.mean(1, keepdims=True), b - b.mean(1, keepdims=True)
    low = np.sqrt((a * a).sum(1) * (b * b).sum(1))
    return np.where(low > 0, (a * b).sum(1) / np.where(low > 0, low, 1.0), np.nan)


def block_means(frames: DataFrame, cycle: int, limit: int | None = None) -> DataFrame:
    """(z, tp, y, x, v): means of blocks of ``cycle`` frames; the incomplete tail is dropped, ``limit`` is clamped to the stack."""
    used = frames if limit is None else frames.where(F.col("t") <= limit)
    blocks = used.groupBy("z").agg(F.floor(F.max("t") / cycle).alias("blocks"))
    tp = F.floor((F.col("t") - 1) / cycle) + 1
    return used.join(F.broadcast(blocks), "z").withColumn("tp", tp).where("tp <= blocks").groupBy("z", "tp", "y", "x").agg(F.avg("v").alias("v"))


def frame_centres(n: int, cycle: int) -> list[int]:
    return [(tp - 1) * cycle + mround(cycle / 2) for tp in range(1, n + 1)]


def grid(spark, height: int, width: int, radius: int) -> DataFrame:
    """(grid_idx, gy, gx, ind): start indices of the patches, rows of the grid first."""
    roi = 2 * radius + 1
    ny, nx = max(0, (height - 2 * roi) // radius), max(0, (width - 2 * roi) // radius)
    ys = spark.range(1, ny + 1).select(F.col("id").alias("gy"))
    xs = spark.range(1, nx + 1).select(F.col("id").alias("gx"))
    ind = (roi + (F.col("gx") - 1) * radius) * height + roi + (F.col("gy") - 1) * radius + 1
    return ys.crossJoin(xs).select(((F.col("gx") - 1) * ny + F.col("gy")).alias("grid_idx"), "gy", "gx", ind.alias("ind"))


def patch_means(pixels: DataFrame, points: DataFrame, height: int, radius: int) -> DataFrame:
    """(z, grid_idx, ind, m): mean of each patch; patches are centred one column left of the start index."""
    offsets = F.explode(F.array(*(F.lit((c - 1) * height + r) for c in range(-radius, radius + 1) for r in range(-radius, radius + 1)))).alias("o")
    asked = points.select("grid_idx", F.col("ind").alias("start"), offsets).select("grid_idx", "start", (F.col("start") + F.col("o")).alias("ind"))
    return pixels.join(asked, "ind").groupBy("z", "grid_idx", F.col("start").alias("ind")).agg(F.avg("v").alias("m"))


def correlation(a: np.ndarray, b: np.ndarray) -> float:
    a, b = a - a.mean(), b - b.mean()
    low = np.sqrt((a * a).sum() * (b * b).sum())
    return float((a * b).sum() / low) if low > 0 else float("nan")


SHIFTED = "z bigint, grid_idx bigint, ind bigint, tp bigint, dy double, dx double, patch array<double>"
SHIFTS = "z bigint, grid_idx bigint, ind bigint, tp bigint, dy double, dx double, dz double"


def displacements(blocks: DataFrame, references: DataFrame, points: DataFrame, height: int, width: int, radius: int, single_plane: bool = False) -> DataFrame:
    """Shift of every bright grid point at every timepoint.

    blocks: (z, tp, y, x, v); references: (z, y, x, v) mean images; points: bright (z, grid_idx, ind).  A row is one patch
    at one timepoint with the first timepoint's, a group one with the reference patches that its shift asks for, so both are
    bounded by the patch and not by the plane or the recording.  Missing pixels: as in ``displacements_of_images``.
    """
    roi = 2 * radius + 1
    index = ((F.col("x") - 1) * height + F.col("y")).cast("long")
    # Pixel k of a patch, columns of the patch first; patches are centred one column left of the start index.
    place = lambda k: (F.floor(k / roi) - radius - 1) * height + k % roi - radius
    pixels = blocks.select("z", "tp", index.alias("pixel"), F.col("v").cast("double").alias("v"))
    asked = points.select("z", "grid_idx", "ind", F.explode(F.sequence(F.lit(0), F.lit(roi * roi - 1))).alias("k")).withColumn("pixel", F.col("ind") + place(F.col("k")))
    patch = lambda df, *keys: df.join(asked, ["z", "pixel"]).groupBy(*keys).agg(F.collect_list(F.struct("k", "v")).alias("patch"))
    first = patch(pixels.where("tp = 1"), "z", "grid_idx").withColumnRenamed("patch", "source")
    patches = patch(pixels, "z", "grid_idx", "ind", "tp").join(first, ["z", "grid_idx"])

    def filled(table: pa.Table, column: str) -> np.ndarray:
        out = np.full(roi * roi, np.nan)
        out[table.column("k").to_numpy()] = table.column(column).to_numpy(zero_copy_only=False)
        return out

    def spread(column: pa.Array) -> np.ndarray:
        """Patches (a row each) from lists of (k, v)."""
        out, n = np.full((len(column), roi * roi), np.nan), column.value_lengths().to_numpy()
        held = column.flatten()
        out[np.repeat(np.arange(len(column)), n), held.field("k").to_numpy()] = held.field("v").to_numpy()
        return out

    def shift(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            target = spread(batch.column("patch"))
            found = [pa.array(d.astype(float)) for d in shifts_of_patches(spread(batch.column("source")), target, radius)]
            keys = [batch.column(c).cast(pa.int64()) for c in ("z", "grid_idx", "ind", "tp")]
            yield pa.RecordBatch.from_arrays([*keys, *found, pa.array(list(target), pa.list_(pa.float64()))], [c.split()[0] for c in SHIFTED.split(", ")])

    shifted = patches.select("z", "grid_idx", "ind", "tp", "patch", "source").mapInArrow(shift, SHIFTED)
    if single_plane:
        return shifted.select("z", "grid_idx", "ind", "tp", "dy", "dx", F.lit(0.0).alias("dz"))

    moved = shifted.select("z", "grid_idx", "ind", "tp", "dy", "dx", F.posexplode("patch").alias("k", "v"))
    moved = moved.withColumn("pixel", (F.col("ind") + place(F.col("k")) - F.col("dx") * height - F.col("dy")).cast("long"))
    moved = moved.withColumn("s", F.explode(F.sequence(F.lit(-2), F.lit(2)))).withColumn("plane", F.col("z") + F.col("s"))
    sides = references.select(F.col("z").cast("long").alias("plane"), index.alias("pixel"), F.col("v").cast("double").alias("r"))

    def depth(table: pa.Table) -> pa.Table:
        best, dz = -np.inf, 0
        s, r = table.column("s").to_numpy(), table.column("r")
        there = r.is_valid().to_numpy()
        for step in range(-2, 3):
            side = table.filter(pa.array((s == step) & there))
            if side.num_rows == roi * roi:
                value = correlation(filled(side, "v"), filled(side, "r"))
                if value > best:
                    best, dz = value, step
        return pa.table({c: table.column(c)[:1] for c in ("z", "grid_idx", "ind", "tp", "dy", "dx")} | {"dz": pa.array([float(dz)])})

    return moved.join(sides.hint("merge"), ["plane", "pixel"], "left").groupBy("z", "grid_idx", "ind", "tp").applyInArrow(depth, SHIFTS)


def tilts(shifts: DataFrame) -> DataFrame:
    """(z, grid_idx, ind, tilt_y, tilt_x, tilt_z): fitted shift over the whole recording, 0 of a single timepoint.

    Shifts are whole numbers, whose sums are the same in any order; running means would leave the last bits to the order of rows.
    """
    t, n = F.col("tp").cast("double"), F.count("tp")

    def fit(c: str) -> Column:
        cov = n * F.sum(t * F.col(c)) - F.sum(t) * F.sum(c)
        return F.coalesce(F.try_divide(cov * (F.max("tp") - 1), n * F.sum(t * t) - F.sum(t) ** 2), F.lit(0.0))

    return shifts.groupBy("z", "grid_idx", "ind").agg(fit("dy").alias("tilt_y"), fit("dx").alias("tilt_x"), fit("dz").alias("tilt_z"))


def median_tilts(tilt: DataFrame, grid_rows: int) -> DataFrame:
    """Adds med_y, med_x, med_z: medians over the bright points of the 3 x 3 grid neighbourhood, at linear positions."""
    steps = F.explode(F.array(*(F.lit(a + b * grid_rows) for a in (-1, 0, 1) for b in (-1, 0, 1)))).alias("d")
    asked = tilt.select("z", F.col("grid_idx").alias("own"), steps).select("z", "own", (F.col("own") + F.col("d")).alias("grid_idx"))
    med = asked.join(tilt, ["z", "grid_idx"]).groupBy("z", F.col("own").alias("grid_idx")).agg(*(F.median(f"tilt_{c}").alias(f"med_{c}") for c in "yxz"))
    return tilt.join(med, ["z", "grid_idx"])


def summary(points: DataFrame, um_per_pixel: float, z_step: float) -> DataFrame:
    """(z, xymove_av, xymove_sd, zmove_av, zmove_sd) in micrometres."""
    xy, z = F.sqrt(F.col("med_y") ** 2 + F.col("med_x") ** 2) * um_per_pixel, F.abs("med_z") * z_step
    return points.groupBy("z").agg(mean0(xy).alias("xymove_av"), std0(xy).alias("xymove_sd"), mean0(z).alias("zmove_av"), std0(z).alias("zmove_sd"))


def timecourse(shifts: DataFrame, cycle: int) -> DataFrame:
    """(z, tp, frame_center, xy_av, xy_sd, z_av, z_sd) over the grid points."""
    xy = F.sqrt(F.col("dy") ** 2 + F.col("dx") ** 2)
    centre = (F.col("tp") - 1) * cycle + mround(cycle / 2)
    return shifts.groupBy("z", "tp").agg(mean0(xy).alias("xy_av"), std0(xy).alias("xy_sd"), mean0(F.col("dz")).alias("z_av"), std0(F.col("dz")).alias("z_sd")).withColumn("frame_center", centre)


#: Rings of buckets around a cell's own that are looked at first.
RINGS = 2
#: Cells and points that a task of a round deals with.
DEALT = 10_000


def nearest(cells: DataFrame, points: DataFrame, k: int = 5) -> DataFrame:
    """Each cell (cell_id, z, cy, cx) with its k nearest points (z, grid_idx, py, px, ...) of the plane; ties by grid_idx.

    A plane's points lie in square buckets of about one point each.  A cell meets the points of the rings around its bucket;
    it is done once its k-th point is nearer than any point outside them can be, or nothing is outside.  The others look
    twice as far.  Cells of planes without points have no rows.

    The rows of a round are dealt to a number of tasks that follows from the cells and points: by their size as shuffled,
    all of them might go to one.
    """
    # Both sides are met more than once: made once.
    points = materialise(points, "nearest-points")
    n_points = points.count()
    extent = [F.min("py").alias("y0"), F.min("px").alias("x0"), F.max("py").alias("y1"), F.max("px").alias("x1"), F.count("*").alias("n")]
    side = F.greatest(F.lit(1.0), F.ceil(F.sqrt((F.col("y1") - F.col("y0") + 1) * (F.col("x1") - F.col("x0") + 1) / F.col("n"))))
    planes = points.groupBy("z").agg(*extent).withColumn("side", side)
    bucket = lambda v, at: F.floor((F.col(v) - F.col(at)) / F.col("side"))
    inside = points.join(planes.select("z", "y0", "x0", "side"), "z").withColumns({"by": bucket("py", "y0"), "bx": bucket("px", "x0")}).drop("y0", "x0", "side")
    held = lambda v, top: F.least(F.greatest(v, F.lit(0)), top)
    placed = cells.join(planes.drop("n"), "z").withColumns({"ny": bucket("y1", "y0"), "nx": bucket("x1", "x0")})
    left = placed.withColumns({"oy": held(bucket("cy", "y0"), F.col("ny")), "ox": held(bucket("cx", "x0"), F.col("nx"))})
    left = materialise(left, "nearest-left")
    own, work = cells.columns, ["y0", "x0", "y1", "x1", "side", "ny", "nx", "oy", "ox"]
    found, rings = None, RINGS
    while True:
        parts = max(1, -(-(left.count() + n_points) // DEALT))
        deal = lambda df, *keys: df.repartition(parts, *keys) if parts > 1 else df  # noqa: B023, E731
        span = lambda o, n: F.sequence(F.greatest(F.col(o) - rings, F.lit(0)), F.least(F.col(o) + rings, F.col(n)))  # noqa: B023, E731
        asked = deal(left, "cell_id").withColumn("by", F.explode(span("oy", "ny"))).withColumn("bx", F.explode(span("ox", "nx")))
        met = deal(asked, "z", "by", "bx").join(deal(inside, "z", "by", "bx").hint("merge"), ["z", "by", "bx"]).drop("by", "bx")
        met = deal(met, "cell_id")
        d2 = ((F.col("cy") - F.col("py")) ** 2 + (F.col("cx") - F.col("px")) ** 2).cast("double")
        ranked = met.withColumn("d2", d2).withColumn("k", F.row_number().over(W.partitionBy("cell_id").orderBy("d2", "grid_idx"))).where(F.col("k") <= k)
        every = F.max("d2").over(W.partitionBy("cell_id")), F.count("*").over(W.partitionBy("cell_id"))
        ranked = materialise(ranked.withColumn("sure", (every[1] == k) & (every[0] < _beyond(rings)) | _beyond(rings).isNull()), "nearest")
        done = ranked.where("sure").drop("sure", *work)
        found = done if found is None else found.unionByName(done)
        left = left.join(ranked.where("sure").select("cell_id").distinct(), "cell_id", "left_anti")
        if left.isEmpty():
            return found.select(*own, *(c for c in found.columns if c not in own))
        left, rings = materialise(left, "nearest-left"), 2 * rings


def _beyond(rings: int) -> Column:
    """Squared distance that points outside the rings are at least away; null if there are none."""
    out = []
    for c, other in (("y", "x"), ("x", "y")):
        o, n, at, start = F.col(f"o{c}"), F.col(f"n{c}"), F.col(f"c{c}"), F.col(f"{c}0")
        # Along the other axis no point is nearer than the points' extent.
        aside = F.greatest(F.lit(0.0), F.col(f"{other}0") - F.col(f"c{other}"), F.col(f"c{other}") - F.col(f"{other}1"))
        below = F.when(o - rings > 0, at - (start + (o - rings) * F.col("side")))
        above = F.when(o + rings < n, start + (o + rings + 1) * F.col("side") - at)
        out += [F.when(g.isNotNull(), F.greatest(g, F.lit(0.0)) ** 2 + aside**2) for g in (below, above)]
    return F.least(*out)


def cell_motion(cells: DataFrame, points: DataFrame) -> DataFrame:
    """(cell_id, my, mx, mz): mean tilt of the five nearest grid points; null where the plane has none."""
    mean = nearest(cells, points).groupBy("cell_id").agg(F.avg("med_y").alias("my"), F.avg("med_x").alias("mx"), F.avg("med_z").alias("mz"))
    return cells.select("cell_id").join(mean, "cell_id", "left")


def motion_filter(cells: DataFrame, points: DataFrame, threshold: float) -> DataFrame:
    """Cells that moved at most ``threshold`` on every axis (cells without grid points stay)."""
    moved = cell_motion(cells, points).where((F.abs("my") > threshold) | (F.abs("mx") > threshold) | (F.abs("mz") > threshold))
    return cells.join(moved.select("cell_id"), "cell_id", "left_anti")


def frame_shift(target: np.ndarray, frame: np.ndarray) -> tuple[int, int]:
    """Whole-frame integer shift (dy, dx) that best aligns the frame to the target; missing pixels are NaN."""
    power = np.nan_to_num(circular(target, frame).real, nan=-np.inf)
    p = int(np.argmax(np.round(power, 6).ravel(order="F")))
    h, w = target.shape
    r, c = p % h + 1, p // h + 1
    return (r - h - 1 if r > h // 2 else r - 1), (c - w - 1 if c > w // 2 else c - 1)


def register(frames: DataFrame, reference_t: int, height: int, width: int) -> DataFrame:
    """(z, t, dy, dx): shift of each frame (z, t, y, x, v) against frame ``reference_t`` of its plane."""
    own = frames.select("z", "t", "y", "x", F.col("v").cast("double").alias("v"), F.lit(False).alias("is_target"))
    # The target frame goes with every frame, so that a group is one frame and its target.
    times = frames.select("z", "t").distinct()
    target = frames.where(F.col("t") == reference_t).select("z", "y", "x", F.col("v").cast("double").alias("v")).join(times, "z").select("z", "t", "y", "x", "v", F.lit(True).alias("is_target"))

    def run(table: pa.Table) -> pa.Table:
        y, x, v = (table.column(c).to_numpy() for c in ("y", "x", "v"))
        side = table.column("is_target").to_numpy()
        images = np.zeros((2, height, width))
        images[side.astype(int), y - 1, x - 1] = v
        dy, dx = frame_shift(images[1], images[0])
        return pa.table({"z": table.column("z")[:1], "t": table.column("t")[:1], "dy": pa.array([dy], pa.int64()), "dx": pa.array([dx], pa.int64())})

    return own.union(target).groupBy("z", "t").applyInArrow(run, "z bigint, t bigint, dy bigint, dx bigint")


def apply_shift(frames: DataFrame, shifts: DataFrame) -> DataFrame:
    """Frames moved by their shifts (z, t, dy, dx) where both differ from 0, as they are where one is 0.

    Pixels that nothing moves onto keep their value.
    """
    s = frames.join(shifts.where("dy <> 0 and dx <> 0"), ["z", "t"])
    moved = s.select("z", "t", (F.col("y") + F.col("dy")).alias("y"), (F.col("x") + F.col("dx")).alias("x"), F.col("v").alias("moved"))
    return frames.join(moved, ["z", "t", "y", "x"], "left").select("z", "t", "y", "x", F.coalesce("moved", "v").alias("v"))


def shifted(image: np.ndarray, dy: int, dx: int) -> np.ndarray:
    """``apply_shift`` of one image: moved where both shifts differ from 0; what nothing moves onto, and missing pixels (NaN), keep their value."""
    out, (h, w) = image.copy(), image.shape
    if dy and dx and abs(dy) < h and abs(dx) < w:
        out[max(dy, 0) : h + min(dy, 0), max(dx, 0) : w + min(dx, 0)] = image[max(-dy, 0) : h - max(dy, 0), max(-dx, 0) : w - max(dx, 0)]
        out = np.where(np.isnan(out) | np.isnan(image), image, out)
    return out


def register_images(images: DataFrame, reference_t: int, move: bool = False) -> DataFrame:
    """(z, t, dy, dx) of images (z, t, h, w, image) against image ``reference_t`` of their plane; with ``move`` the moved images too.

    The references are a written table; a task reads its plane's and keeps it from row to row, so no image is shuffled.
    """
    targets = keep_planes(images.where(F.col("t") == reference_t).select(F.col("z").cast("long").alias("z"), "image"), "register-targets")
    schema = "z bigint, t bigint, dy bigint, dx bigint" + (", h int, w int, image binary" if move else "")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                z, t, h, w = (batch.column(c)[i].as_py() for c in ("z", "t", "h", "w"))
                target = plane_image(targets, z)
                if target is None:
                    continue
                own = np.frombuffer(batch.column("image")[i].as_buffer(), "<f8").reshape(h, w, order="F")
                dy, dx = frame_shift(target.reshape(h, w, order="F"), own)
                cells = [pa.array([int(v)], pa.int64()) for v in (z, t, dy, dx)]
                if move:
                    moved = shifted(own, dy, dx).tobytes(order="F")
                    cells += [pa.array([h], pa.int32()), pa.array([w], pa.int32()), pa.array([moved], pa.binary())]
                yield pa.RecordBatch.from_arrays(cells, [c.split()[0] for c in schema.split(", ")])

    return images.select("z", "t", "h", "w", "image").mapInArrow(run, schema)


def pixels_of(images: DataFrame) -> DataFrame:
    """(z, t, y, x, v) of images (z, t, h, w, image), without the pixels that they lack (NaN)."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                z, t, h, w = (batch.column(c)[i].as_py() for c in ("z", "t", "h", "w"))
                v = np.frombuffer(batch.column("image")[i].as_buffer(), "<f8")
                k = np.flatnonzero(~np.isnan(v))
                same = lambda key: np.full(len(k), key, np.int64)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (same(z), same(t), k % h + 1, k // h + 1, v[k])], ["z", "t", "y", "x", "v"])

    return images.select("z", "t", "h", "w", "image").mapInArrow(run, "z bigint, t bigint, y bigint, x bigint, v double")
