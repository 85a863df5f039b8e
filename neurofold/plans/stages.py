"""The three stages over a dataset directory: cells, motion, traces; each a lazy plan and a Parquet table.

Planes stay images until cells, points or traces come of them: no stage makes a row a pixel of the raw stacks.
"""

from __future__ import annotations

import datetime
import functools
import logging
import os
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Params
from ..functions.semantics import exceeds, mround
from ..operators import extract, motion, segment, traces
from ..sources import planestack, sidecar, tiff
from .batch import run_batch


class Pipeline:
    """segment(), move() and trace() return DataFrames; run() writes them below ``directory``, named by the parameters."""

    def __init__(self, spark: SparkSession, directory: str, params: Params | None = None):
        self.spark, self.directory, self.params = spark, directory.rstrip("/"), params or Params()

    def path(self, table: str) -> str:
        """Output of a table; results of other parameters have other names."""
        return f"{self.directory}/results/{self.params.digest()}{self.params.suffix()}/{table}.parquet"

    def anatomy(self) -> DataFrame:
        return tiff.pixels(tiff.read(self.spark, f"{self.directory}/ave.tif"))

    @functools.cached_property
    def _acquired(self) -> dict:
        pages = tiff.read(self.spark, f"{self.directory}/ave.tif").count()
        return sidecar.acquisition(self.spark, self.directory, pages)

    def acquisition(self) -> dict:
        """The metadata of the directory, read once."""
        return self._acquired

    def segment(self) -> DataFrame:
        """Cells of the anatomy stack, each with its parameters."""
        p = self.params
        cells = segment.region_properties(self.labelled())
        return cells.withColumn("seg_params", F.struct(F.lit(p.br_threshold).alias("br_threshold"), F.lit(p.cont_threshold).alias("cont_threshold"), F.lit(p.cell_radius).alias("cell_radius")))

    def labelled(self) -> DataFrame:
        return segment.labels_of_pages(tiff.read(self.spark, f"{self.directory}/ave.tif"), self.params)

    def write_overlay(self) -> str:
        """The anatomy beside itself with the cells in colour, as one TIFF."""
        target, p = f"{self.path('cells').removesuffix('.parquet')}_mask.tif", self.anatomy()
        width = p.agg(F.max("x")).first()[0]
        segment_image = segment.overlay(segment.normalised(p, self.params.br_threshold), self.labelled(), width)
        tiff.write_colour(segment_image, target)
        return target

    def cells(self) -> DataFrame:
        return self.spark.read.parquet(self.path("cells"))

    def frames(self, info: dict, **options) -> DataFrame:
        return planestack.read(self.spark, self.directory, info["stack_height"], info["stack_width"], **options)

    def cycle(self, info: dict) -> int:
        return self.params.single_plane_cycle if info["is_single_plane"] else mround(info["frame_rate"] * 60)

    def limit(self, info: dict) -> int | None:
        """Frames of a test run, clamped to the recording."""
        if self.params.test_minutes is None:
            return None
        return min(mround(self.params.test_minutes * 60 * info["frame_rate"]), info["n_total_frames"])

    def move(self) -> tuple[DataFrame, DataFrame]:
        """Motion points with tilts, and the shifts of every timepoint."""
        info, p = self.acquisition(), self.params
        if p.use_gpu:
            logging.getLogger("neurofold").warning("%s: use_gpu is set, the motion stage runs on the executors' processors", self.directory)
        h, r = info["stack_height"], p.grid_radius
        # Means of frame blocks are written: the raw stacks are read once.
        self.write("block_means", motion.block_images(self.frames(info), self.cycle(info), self.limit(info)))
        images = self.spark.read.parquet(self.path("block_means"))
        bright = motion.patch_means_of_images(images.where("tp = 1"), r).where(exceeds(F.col("m"), p.brightness_threshold))
        references = motion.page_images(tiff.read(self.spark, f"{self.directory}/ave.tif"))
        shifts = motion.displacements_of_images(images, references, bright.select("z", "grid_idx", "ind"), r, info["is_single_plane"])
        rows = max(0, (h - 2 * (2 * r + 1)) // r)
        points = motion.median_tilts(motion.tilts(shifts), rows)
        return points, shifts

    def background(self) -> DataFrame:
        for name in ("Background_1.tif", "background_1.tif"):
            if sidecar._exists(self.spark, f"{self.directory}/{name}"):
                return traces.lowest_mean(tiff.pixels(tiff.read(self.spark, f"{self.directory}/{name}")), "v")
        raise sidecar.MissingFile(f"{self.directory}/Background_1.tif")

    def trace(self) -> DataFrame:
        """(cell_id, t, f0, dff) or, without detrending, (cell_id, t, f)."""
        info, p = self.acquisition(), self.params
        options = {} if self.limit(info) is None else {"t1": self.limit(info)}
        cells = planestack.by_plane(self.cells(), self.path("cells_by_plane"))
        raw = planestack.read_cells(self.spark, self.directory, info["stack_height"], info["stack_width"], cells, **options)
        points = traces.subtract(raw, self.background())
        if p.enable_photobleach_fit:
            length = int(-(-info["frame_rate"] * p.baseline_window_seconds // 1))
            points = traces.bleach_fit(points, length).select("cell_id", "t", "f")
        out = traces.rolling_dff(points, p.detrend_window_frames, p.detrend_percentile, p.detrend_offset) if p.enable_detrending else points
        # All cells' traces are written once: the raw stacks are not read again for the pairs of duplicates.
        self.write("all_traces", out)
        out = self.spark.read.parquet(self.path("all_traces"))
        keep = self.cells()
        h, w = info["stack_height"], info["stack_width"]
        if p.enable_remove_duplicates and not info["is_single_plane"]:
            value = "dff" if p.enable_detrending else "f"
            length = max(1, int(-(-info["frame_rate"] * p.baseline_window_seconds // 1)))
            flat = traces.epoch_demean(out.select("cell_id", "t", F.col(value).cast("double").alias("f")), length)
            gone = extract.greedy_duplicates(keep, extract.duplicate_pairs(keep, flat, h, w), h, w, p.dedup_corr_threshold)
            keep = keep.join(gone, "cell_id", "left_anti")
        if p.enable_motion_filter and not sidecar._exists(self.spark, self.path("motion_points")):
            warnings.warn(f"{self.directory}: no motion points, cells are not filtered by motion", sidecar.NoMotionWarning, stacklevel=2)
        elif p.enable_motion_filter:
            place = self.spark.read.parquet(self.path("motion_points"))
            placed = place.select("z", "grid_idx", (F.pmod(F.col("ind") - 1, F.lit(h)) + 1).alias("py"), (F.floor((F.col("ind") - 1) / h) + 1).alias("px"), "med_y", "med_x", "med_z")
            keep = motion.motion_filter(keep, placed, p.motion_threshold_pixels)
        return out.join(keep.select("cell_id"), "cell_id", "left_semi")

    def write(self, table: str, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(self.path(table))

    def run_segmentation(self) -> int:
        self.write("cells", self.segment())
        return self.cells().count()

    def run_motion(self) -> None:
        info = self.acquisition()
        _, shifts = self.move()
        self.write("motion_shifts", shifts)
        points = motion.median_tilts(motion.tilts(self.spark.read.parquet(self.path("motion_shifts"))), max(0, (info["stack_height"] - 2 * (2 * self.params.grid_radius + 1)) // self.params.grid_radius))
        self.write("motion_points", points)
        step = 0.0 if info["is_single_plane"] else info["z_step_um"]
        self.write("motion_summary", motion.summary(self.spark.read.parquet(self.path("motion_points")), self.params.um_per_pixel, step))
        self.write("motion_tcourse", motion.timecourse(self.spark.read.parquet(self.path("motion_shifts")), self.cycle(info)))

    def baseline_manifest(self) -> DataFrame:
        """How the baseline was made: one row beside the traces."""
        p = self.params
        level = self.background().select(F.first(F.col(self.background().columns[0])).cast("double").alias("background_baseline"))
        return level.select(
            F.lit("rolling_percentile").alias("method"),
            F.lit(p.detrend_window_frames).cast("long").alias("window_frames"),
            F.lit(p.detrend_percentile).alias("percentile"),
            F.lit(p.detrend_offset).alias("offset"),
            "background_baseline",
            F.lit(p.enable_photobleach_fit).alias("photobleach_fit_first"),
            F.lit(datetime.datetime.now(datetime.timezone.utc).isoformat(timespec="seconds")).alias("created"),
        )

    def run_timecourse(self) -> None:
        if self.params.enable_detrending:
            self.write("rolling_baseline", self.baseline_manifest())
        self.write("traces", self.trace())


TABLES = {"segmentation": "cells", "motion": "motion_summary", "timecourse": "traces"}


def crop(pixels: DataFrame, top: float, left: float, height: float, width: float, stack_height: int, stack_width: int, margin: int = 30) -> DataFrame:
    """Pixels (y, x, ...) of a rectangle with a margin around, cut at the stack's borders."""
    y, x = (mround(top - margin), mround(top + height + margin)), (mround(left - margin), mround(left + width + margin))
    return pixels.where(F.col("y").between(max(y[0], 1), min(y[1], stack_height)) & F.col("x").between(max(x[0], 1), min(x[1], stack_width)))


def run_list(spark: SparkSession, list_file: str, params: Params | None = None, abort=lambda: False, **options) -> DataFrame:
    """run_all over the directories of a batch file; those that are not there are dropped with a warning."""
    named = [r["directory"] for r in sidecar.batch_list(spark, list_file).collect()]
    there = [d for d in named if sidecar._exists(spark, d)]
    for d in named:
        if d not in there:
            warnings.warn(f"{d}: no such directory, it is left out", sidecar.MissingDirectoryWarning, stacklevel=2)
    return run_all(spark, there, params, abort, **options)


def run_all(spark: SparkSession, directories: list[str], params: Params | None = None, abort=lambda: False, **options) -> DataFrame:
    """run_status of all stages over all directories; finished ones are skipped unless forced.  Options: workers and notify of ``run_batch``."""
    p = params or Params()
    pipe = {d: Pipeline(spark, d, p) for d in directories}
    stages = {"segmentation": lambda d: pipe[d].run_segmentation(), "motion": lambda d: pipe[d].run_motion(), "timecourse": lambda d: pipe[d].run_timecourse()}
    done = lambda s, d: sidecar._exists(spark, os.path.join(pipe[d].path(TABLES[s]), "_SUCCESS"))
    skip = ("segmentation",) * p.skip_segmentation + ("motion",) * p.skip_motion
    return run_batch(spark, directories, stages, done, skip, p.force_rerun, abort, **options)
