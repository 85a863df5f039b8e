"""Raw stacks: headerless little-endian uint16 frames or float32 matrices, column-major.

Readers seek to frame ranges, one input partition a block of frames, so a stack is never
loaded whole; filters on ``z`` and ``t0`` leave out whole blocks, whose bounds stay those
of the unfiltered table, and Spark applies them to the rest.  Local and mounted paths are
read with seeks, others through the file system that pyarrow finds for them.

Cells are read by their pixels: a partition is a plane's run of frames, its task loads the
plane's cells and turns their pixels into merged byte ranges, so no frame is shuffled and
what is read grows with the pixels asked for.

Writers place every block of frames at its offset of one file (``store.Placed``), by as many
tasks as there are blocks; appends go on behind a file's end.  Files appear when the job commits.
"""

from __future__ import annotations

import functools
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.dataset
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from . import store
from .store import Committed, Placed, Written

FRAMES = "z int, t0 int, n int, h int, w int, px binary"
TRACES = "cell_id bigint, trace array<float>"


def local(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


def open_file(path: str):
    if "://" in path and not path.startswith("file:"):
        fs, at = pa.fs.FileSystem.from_uri(path)
        return fs.open_input_file(at)
    return open(local(path), "rb")


def size_of(path: str) -> int:
    """Bytes of a file, without those of an append that is not committed."""
    return store.size_of(path)


def listing(path: str) -> list[tuple[str, str]]:
    """(name, path) of a file, or of the files of a directory in name order, on any store; nothing if it is not there."""
    if "://" in path and not path.startswith("file:"):
        fs, at = pa.fs.FileSystem.from_uri(path)
        found = fs.get_file_info(at)
        if found.type == pa.fs.FileType.NotFound:
            return []
        if found.type == pa.fs.FileType.Directory:
            return sorted((f.base_name, f"{path.rstrip('/')}/{f.base_name}") for f in fs.get_file_info(pa.fs.FileSelector(at)) if f.is_file)
    else:
        where = local(path)
        if not os.path.exists(where):
            return []
        if os.path.isdir(where):
            return sorted((n, os.path.join(where, n)) for n in os.listdir(where) if os.path.isfile(os.path.join(where, n)))
    return [(path.rstrip("/").rsplit("/", 1)[-1], path)]


def stacks(path: str) -> list[tuple[int, str]]:
    """(z, file) of a stack file, or of all PlaneNN.stack of a directory, by name."""
    found = listing(path)
    if len(found) == 1 and found[0][1] == path:
        return [(int((re.search(r"(\d+)\.stack$", path) or [0, 1])[1]), path)]
    return [(int(re.search(r"\d+", name)[0]), file) for name, file in found if re.fullmatch(r"Plane\d+\.stack", name)]


def frame_count(path: str, h: int, w: int) -> int:
    """Whole frames in a stack file."""
    return size_of(path) // (2 * h * w)


class Block(InputPartition):
    def __init__(self, path: str, z: int, first: int, last: int):
        self.path, self.z, self.first, self.last = path, z, first, last


class StackReader(DataSourceReader):
    """Options: path (one PlaneNN.stack or a directory of them), h, w, block (frames), t0 and t1 (1-based, inclusive)."""

    def __init__(self, options):
        self.path, self.h, self.w = options["path"], int(options["h"]), int(options["w"])
        self.block = int(options.get("block", 32))
        self.t0, self.t1 = int(options.get("t0", 1)), int(options.get("t1", 1 << 60))
        self.kept = []

    def pushFilters(self, filters):
        """Remembers comparisons of z and t0, by which whole blocks are left out; Spark keeps all filters."""
        tests = {EqualTo: int.__eq__, GreaterThan: int.__gt__, GreaterThanOrEqual: int.__ge__, LessThan: int.__lt__, LessThanOrEqual: int.__le__}
        for f in filters:
            if type(f) in tests and f.attribute in (("z",), ("t0",)) and isinstance(f.value, int):
                self.kept.append((f.attribute[0], tests[type(f)], f.value))
            yield f

    def partitions(self):
        out = []
        for z, path in stacks(self.path):
            last = min(self.t1, frame_count(path, self.h, self.w))
            for t in range(max(self.t0, 1), last + 1, self.block):
                if all(test(z if column == "z" else t, value) for column, test, value in self.kept):
                    out.append(Block(path, z, t, min(t + self.block, last + 1)))
        return out

    def read(self, part):
        if part is None:  # Spark's stand-in where there are no partitions
            return
        size = 2 * self.h * self.w
        with open_file(part.path) as f:
            f.seek((part.first - 1) * size)
            px = f.read((part.last - part.first) * size)
        cols = [pa.array([x], pa.int32()) for x in (part.z, part.first, part.last - part.first, self.h, self.w)]
        yield pa.RecordBatch.from_arrays([*cols, pa.array([px], pa.binary())], ["z", "t0", "n", "h", "w", "px"])


class PlaneStack(DataSource):
    @classmethod
    def name(cls):
        return "planestack"

    def schema(self):
        return FRAMES

    def reader(self, schema):
        return StackReader(self.options)


class FloatReader(DataSourceReader):
    """Options: path, n_cells; the matrix is cells x times, cells fastest; a partition is a run of times."""

    def __init__(self, options):
        self.path, self.n, self.block = options["path"], int(options["n_cells"]), int(options.get("block", 256))

    def partitions(self):
        """Runs of times of a matrix file, or of the part files of a folder one after another (z: times before the file)."""
        where = local(self.path)
        folder = "://" not in where and os.path.isdir(where)
        paths = [os.path.join(where, n) for n in sorted(os.listdir(where)) if re.fullmatch(r"part-\d+\.stackf", n)] if folder else [self.path]
        out, before = [], 0
        for path in paths:
            times = size_of(path) // (4 * self.n)
            out += [Block(path, before, t, min(t + self.block, times)) for t in range(0, times, self.block)]
            before += times
        return out

    def read(self, part):
        if part is None:
            return
        with open_file(part.path) as f:
            f.seek(4 * self.n * part.first)
            x = np.frombuffer(f.read(4 * self.n * (part.last - part.first)), "<f4").reshape(-1, self.n)
        ids = np.tile(np.arange(1, self.n + 1), len(x))
        t = np.repeat(part.z + np.arange(part.first, part.last) + 1, self.n)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(t), pa.array(x.ravel())], ["cell_id", "t", "f"])


class StackF(DataSource):
    @classmethod
    def name(cls):
        return "stackf"

    def schema(self):
        return "cell_id bigint, t bigint, f float"

    def reader(self, schema):
        return FloatReader(self.options)

    def writer(self, schema, overwrite):
        return FloatWriter(self.options, overwrite)


def _source(spark: SparkSession, source: type[DataSource]):
    """A reader of a source that prunes blocks: Spark refuses such sources unless its filter pushdown to Python is on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(source)
    return spark.read.format(source.name())


def read(spark: SparkSession, path: str, h: int, w: int, **options) -> DataFrame:
    """Frame blocks (z, t0, n, h, w, px).  Switches on Spark's filter pushdown to Python sources."""
    return _source(spark, PlaneStack).options(h=h, w=w, **options).load(path)


def read_frame(spark: SparkSession, path: str, h: int, w: int, t: int) -> DataFrame:
    """One frame; the index is clamped to the stack."""
    t = min(max(t, 1), frame_count(path, h, w))
    return read(spark, path, h, w, t0=t, t1=t)


def voxels(blocks: DataFrame) -> DataFrame:
    """(z, t, y, x, ind, v) of frame blocks.  For small stacks and checks: bulk work stays on blocks."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                h, w = row["h"], row["w"]
                v = np.frombuffer(row["px"], "<u2").astype(np.int64)
                ind = np.tile(np.arange(h * w), row["n"])
                t = row["t0"] + np.repeat(np.arange(row["n"]), h * w)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), row["z"], np.int64)), pa.array(t.astype(np.int64)), pa.array(ind % h + 1), pa.array(ind // h + 1), pa.array(ind + 1), pa.array(v)], ["z", "t", "y", "x", "ind", "v"])

    return blocks.mapInArrow(run, "z bigint, t bigint, y bigint, x bigint, ind bigint, v bigint")


#: Bytes between two pixels that are read through rather than skipped, and of a row group of cells.
GAP, GROUP = 32 << 10, 4 << 20


def byte_ranges(inds: np.ndarray, gap: int = GAP) -> np.ndarray:
    """(first, last) pixels, 0-based and exclusive, of the ranges that cover sorted distinct linear indices, gaps of up to ``gap`` bytes included."""
    at = inds - 1
    new = np.flatnonzero(np.diff(at) > 1 + gap // 2) + 1
    return np.stack([at[np.append(0, new)], at[np.append(new, len(at)) - 1] + 1], 1)


def read_pixels(f, inds: np.ndarray, frames: range, size: int, gap: int = GAP) -> np.ndarray:
    """Values (frames x inds) of sorted distinct pixels, by a seek and a read for each range of each frame.

    Where ranges cover most of a frame, whole frames are read in runs.
    """
    ranges = byte_ranges(inds, gap)
    out = np.empty((len(frames), len(inds)), "<u2")
    if 2 * (ranges[:, 1] - ranges[:, 0]).sum() > size:
        f.seek(2 * size * (frames.start - 1))
        for k in range(len(frames)):
            out[k] = np.frombuffer(f.read(2 * size), "<u2")[inds - 1]
        return out
    cuts = np.searchsorted(inds - 1, ranges[:, 0])
    cuts = np.append(cuts, len(inds))
    for k, t in enumerate(frames):
        for (a, b), i, j in zip(ranges.tolist(), cuts[:-1], cuts[1:], strict=True):
            f.seek(2 * (size * (t - 1) + a))
            out[k, i:j] = np.frombuffer(f.read(2 * (b - a)), "<u2")[inds[i:j] - 1 - a]
    return out


@functools.lru_cache(maxsize=8)
def plane_cells(cells: str, z: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cell ids, where each one's pixels begin, pixels) of one plane of a table written by plane; a worker keeps the last planes."""
    fs, at = store.store_of(cells)
    rows = pa.dataset.dataset(at, filesystem=fs, format="parquet")
    table = rows.to_table(columns=["cell_id", "inds"], filter=pa.dataset.field("z") == z).sort_by("cell_id").combine_chunks()
    inds = table.column("inds").chunk(0) if table.num_rows else pa.array([], pa.list_(pa.int32()))
    return table.column("cell_id").to_numpy(), np.append(0, np.cumsum(inds.value_lengths().to_numpy(zero_copy_only=False))).astype(np.int64), inds.flatten().to_numpy().astype(np.int64)


class CellReader(StackReader):
    """Options of ``StackReader`` and cells (a table that ``by_plane`` has written): partitions are its blocks, rows are means of cells."""

    def __init__(self, options):
        super().__init__(options)
        self.cells, self.gap, self.base = options["cells"], int(options.get("gap", GAP)), int(options.get("base", 0))

    def read(self, part):
        if part is None:
            return
        ids, begin, inds = plane_cells(self.cells, part.z)
        filled = np.diff(begin) > 0
        ids, starts = ids[filled], begin[:-1][filled]
        if not len(ids):
            return
        every, place = np.unique(inds, return_inverse=True)
        frames = range(part.first, part.last)
        with open_file(part.path) as f:
            x = read_pixels(f, every, frames, self.h * self.w, self.gap)
        n, some = np.diff(begin)[filled], np.ones(len(ids), bool)
        for k, t in enumerate(frames):
            v = x[k][place].astype(np.int64)
            if self.base:
                n = np.add.reduceat((v > 0).astype(np.int64), starts)
                v, some = np.where(v > 0, v - self.base, 0), n > 0
            f_ = (np.add.reduceat(v, starts)[some] / n[some]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(np.full(some.sum(), t, np.int64)), pa.array(f_)], ["cell_id", "t", "f"])


class CellMeans(DataSource):
    @classmethod
    def name(cls):
        return "cellmeans"

    def schema(self):
        return "cell_id bigint, t bigint, f float"

    def reader(self, schema):
        return CellReader(self.options)


def by_plane(cells: DataFrame, path: str) -> str:
    """Writes cells (cell_id, z, inds) in the order of their planes: a task of ``read_cells`` loads its plane's row groups alone."""
    rows = cells.select(F.col("cell_id").cast("long").alias("cell_id"), F.col("inds").cast("array<int>").alias("inds"), F.col("z").cast("int").alias("z"))
    ordered = rows.repartitionByRange("z", "cell_id").sortWithinPartitions("z", "cell_id")
    ordered.write.mode("overwrite").option("parquet.block.size", GROUP).parquet(path)
    return path


def read_cells(spark: SparkSession, path: str, h: int, w: int, cells: str, **options) -> DataFrame:
    """(cell_id, t, f): mean of each cell's pixels in every frame of the stacks below path, without moving frames.

    cells: the path of a table written by ``by_plane``.  base: as in ``blocks_of``; a cell has no row for frames that have
    none of its pixels.  Switches on Spark's filter pushdown to Python sources.
    """
    return _source(spark, CellMeans).options(h=h, w=w, cells=cells, **options).load(path)


def cell_means(blocks: DataFrame, cells: DataFrame) -> DataFrame:
    """``read_cells`` from blocks of frames that are no stack files: cells are joined to the blocks of their plane."""
    by_plane = cells.groupBy("z").agg(F.collect_list(F.struct(F.col("cell_id").cast("long").alias("cell_id"), F.col("inds").cast("array<int>").alias("inds"))).alias("cells"))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("t0", "n", "h", "w", "px")}
                own = batch.column("cells")[i].values
                ids, inds = own.field("cell_id").to_numpy(), own.field("inds")
                x = np.frombuffer(row["px"], "<u2").reshape(row["n"], row["h"] * row["w"])
                f = np.stack([x[:, inds[k].values.to_numpy() - 1].mean(1) for k in range(len(ids))], 1).astype(np.float32)
                t = row["t0"] + np.repeat(np.arange(row["n"]), len(ids))
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(ids, row["n"]).astype(np.int64)), pa.array(t.astype(np.int64)), pa.array(f.ravel())], ["cell_id", "t", "f"])

    return blocks.join(by_plane, "z").mapInArrow(run, "cell_id bigint, t bigint, f float")


def read_float(spark: SparkSession, path: str, n_cells: int) -> DataFrame:
    spark.dataSource.register(StackF)
    return spark.read.format("stackf").options(n_cells=n_cells).load(path)


def blocks_of(images: DataFrame, base: int = 0) -> DataFrame:
    """Frame blocks of one frame each from images (z, t, h, w, image) of whole numbers, held in the range of 16 bits.

    With a base, what is stored are values plus base, and 0 for pixels that an image lacks (NaN); values that do not fit
    are an error.
    """

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                z, t, h, w = (batch.column(c)[i].as_py() for c in ("z", "t", "h", "w"))
                v = np.floor(np.frombuffer(batch.column("image")[i].as_buffer(), "<f8") + 0.5) + base
                if base and ((v < 1) | (v > 65535)).any():
                    raise ValueError(f"plane {z}, frame {t}: values do not fit in 16 bits around {base}")
                px = np.clip(np.nan_to_num(v), 0, 65535).astype("<u2").tobytes()
                yield pa.RecordBatch.from_arrays([*(pa.array([v], pa.int32()) for v in (z, t, 1, h, w)), pa.array([px], pa.binary())], ["z", "t0", "n", "h", "w", "px"])

    return images.select("z", "t", "h", "w", "image").mapInArrow(run, FRAMES)


def write(blocks: DataFrame, path: str, append: bool = False, stream: bool = False) -> None:
    """Frame blocks (z, t0, n, h, w, px) to raw stacks PlaneNN.stack below path, each block where it stands.

    A plane's blocks must follow one another without a gap; the least frame comes first, or after the frames that a file
    has when appending.  One light pass over the blocks' numbers checks that before anything is written; nothing is shuffled.
    ``stream`` treats a local folder as a store that takes whole files only.
    """
    size = F.lit(2).cast("long") * F.col("h") * F.col("w")
    ends = F.col("t0") + F.col("n")
    planes = blocks.groupBy("z").agg(F.min("t0").alias("first"), F.max(ends).alias("end"), F.sum("n").alias("n"), F.min(size).alias("size"), F.max(size).alias("most"), F.sum(F.octet_length("px")).alias("bytes")).collect()
    for p in planes:
        if p["end"] - p["first"] != p["n"] or p["size"] != p["most"] or p["bytes"] != p["size"] * p["n"]:
            raise ValueError(f"plane {p['z']}: blocks overlap, leave gaps, or are not of one size")
    targets, begins = {}, {p["z"]: p["first"] for p in planes}
    try:
        for p in planes:
            targets[p["z"]] = Placed(f"{path.rstrip('/')}/Plane{p['z']:02d}.stack", append, stream)

        def put(batches):
            for batch in batches:
                for k in range(batch.num_rows):
                    z, t0, h, w = (batch.column(c)[k].as_py() for c in ("z", "t0", "h", "w"))
                    at = 2 * h * w * (t0 - begins[z])
                    done = targets[z].put(at, batch.column("px")[k].as_buffer())
                    yield done.append_column("z", pa.array([z], pa.int32())).to_batches()[0]

        written = blocks.select("z", "t0", "h", "w", "px").mapInArrow(put, f"{Placed.ROWS}, z int")
        if all(t.random for t in targets.values()):
            written.count()
        else:

            def join(table: pa.Table) -> pa.Table:
                z = table.column("z")[0].as_py()
                targets[z].stream(table.sort_by("at").column("file").to_pylist())
                return pa.table({"z": pa.array([z], pa.int32())})

            written.groupBy("z").applyInArrow(join, "z int").count()
        for target in targets.values():
            target.finish()
    except BaseException:
        for target in targets.values():
            target.abort()
        raise


class FloatWriter(Committed):
    """Writes (cell_id, t, f) as files of a run of times each, cells fastest; a task's rows must be in order (see ``write_float``)."""

    def write(self, batches):
        fs, file = self.fresh()
        first = None
        with fs.open_output_stream(file) as f:
            for batch in batches:
                if batch.num_rows:
                    first = batch.column("t")[0].as_py() if first is None else first
                    f.write(batch.column("f").to_numpy(zero_copy_only=False).astype("<f4").tobytes())
        return Written([] if first is None else [(file, f"part-{first:012d}.stackf")])

    def place(self, files):
        fs, at = store.store_of(self.path)
        for old in fs.get_file_info(pa.fs.FileSelector(at)) if self.overwrite else []:
            if re.fullmatch(r"part-\d+\.stackf", old.base_name):
                fs.delete_file(old.path)
        super().place(files)


def write_float_file(points: DataFrame, path: str, n_cells: int) -> None:
    """(cell_id, t, f) with ids from 1 to n_cells as one float32 matrix, cells fastest; values that are missing are NaN.

    Ranges of times are written side by side, each at its place.
    """
    target = Placed(path)
    dealt = points.select("cell_id", F.col("t").cast("long").alias("t"), F.col("f").cast("float").alias("f")).repartitionByRange("t").sortWithinPartitions("t")

    def put(batches):
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            # The last time of a batch may go on in the next one.
            t = rows.column("t").to_numpy()
            cut = int(np.searchsorted(t, t[-1])) if len(t) else 0
            if cut:
                yield from matrix(rows.slice(0, cut))
            held = rows.slice(cut)
        if held is not None and held.num_rows:
            yield from matrix(held)

    def matrix(rows: pa.Table):
        t, cell, f = (rows.column(c).to_numpy() for c in ("t", "cell_id", "f"))
        runs = np.append(np.flatnonzero(np.append(True, np.diff(t) > 1)), len(t))
        for a, b in zip(runs[:-1], runs[1:], strict=True):
            out = np.full((t[b - 1] - t[a] + 1, n_cells), np.nan, "<f4")
            out[t[a:b] - t[a], cell[a:b] - 1] = f[a:b]
            yield from target.put(4 * n_cells * int(t[a] - 1), out.tobytes()).to_batches()

    try:
        target.commit(dealt.mapInArrow(put, Placed.ROWS))
    except BaseException:
        target.abort()
        raise


def write_float(points: DataFrame, path: str) -> None:
    """(cell_id, t, f) as float32 files of a run of times each, cells fastest; names sort in time order."""
    points.sparkSession.dataSource.register(StackF)
    dealt = points.select("cell_id", F.col("t").cast("long").alias("t"), F.col("f").cast("float").alias("f")).repartitionByRange("t").sortWithinPartitions("t", "cell_id")
    dealt.write.format("stackf").mode("overwrite").save(path)


def read_float_parts(spark: SparkSession, path: str, n_cells: int) -> DataFrame:
    """(cell_id, t, f) of a folder that ``write_float`` has written."""
    spark.dataSource.register(StackF)
    return spark.read.format("stackf").options(n_cells=n_cells).load(path)
