"""Files on any store that pyarrow reaches (local and mounted folders, hdfs, s3, gs), and writers that commit in two phases."""

from __future__ import annotations

import functools
import os
import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import pyarrow.dataset
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage

#: Files that the driver puts into place at once; each is one rename, whatever its size.
RENAMES = 32


def store_of(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a path or URI and the path on it.  A store that pyarrow does not know is an error that names it."""
    if "://" not in path and not path.startswith("file:"):
        return pa.fs.LocalFileSystem(), path
    try:
        return pa.fs.FileSystem.from_uri("file://" + path.removeprefix("file:") if path.startswith("file:") and not path.startswith("file://") else path)
    except (pa.ArrowInvalid, ValueError) as e:
        raise ValueError(f"no file system known for {path}") from e


class Written(WriterCommitMessage):
    """Files that a task has written, each with where it belongs."""

    def __init__(self, files: list[tuple]):
        self.files = files


class Committed(DataSourceArrowWriter):
    """Tasks write files below a folder of this job; the driver renames those of successful tasks into place and drops the rest."""

    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.staging = f"{self.path}/_job-{uuid.uuid4().hex}"
        fs, at = store_of(self.staging)
        fs.create_dir(at, recursive=True)

    def target(self, name: str) -> str:
        """A committed file's path on its store."""
        return f"{store_of(self.path)[1]}/{name}"

    def fresh(self) -> tuple[pa.fs.FileSystem, str]:
        """A new file of this job, which no other attempt writes."""
        fs, at = store_of(self.staging)
        return fs, f"{at}/{uuid.uuid4().hex}"

    def place(self, files: list[tuple]) -> None:
        """Renames (file, name) pairs into place."""
        fs, _ = store_of(self.path)
        with ThreadPoolExecutor(RENAMES) as pool:
            list(pool.map(lambda f: fs.move(f[0], self.target(f[1])), files))

    def clear(self) -> None:
        fs, at = store_of(self.staging)
        if fs.get_file_info(at).type != pa.fs.FileType.NotFound:
            fs.delete_dir(at)

    def commit(self, messages):
        self.place([f for m in messages if m is not None for f in m.files])
        self.clear()

    def abort(self, messages):
        self.clear()


def size_of(path: str) -> int:
    """Bytes of a file; while an append is under way, or was broken off, those it had before."""
    fs, at = store_of(path)
    note = fs.get_file_info(f"{at}.appending")
    if note.type != pa.fs.FileType.NotFound:
        with fs.open_input_stream(f"{at}.appending") as f:
            return int(f.read())
    return fs.get_file_info(at).size


class Placed:
    """One file that many tasks write, each at its own places.

    On a local or mounted folder they write into one file beside the target, at any offset, and the driver renames it.
    Other stores take a file only as one stream: tasks write pieces, and one task, not the driver, streams them in order.
    An append goes on behind the target's end in place, under a note of its old size (``size_of``); it is undone by
    cutting the file there.  Tasks that run twice write the same bytes at the same places.
    """

    ROWS = "at bigint, length bigint, file string"

    def __init__(self, path: str, append: bool = False, stream: bool = False):
        self.path, self.job = path, uuid.uuid4().hex
        fs, self.target = store_of(path)
        self.random = isinstance(fs, pa.fs.LocalFileSystem) and not stream
        folder = self.target.rpartition("/")[0]
        self.staging = f"{folder or '.'}/_job-{self.job}"
        fs.create_dir(self.staging, recursive=True)
        there = fs.get_file_info(self.target).type != pa.fs.FileType.NotFound
        self.before = size_of(path) if append and there else 0
        self.joined = self.target if self.before and self.random else f"{self.staging}/joined"
        if self.before and self.random:
            self._cut()
            with fs.open_output_stream(f"{self.target}.appending") as f:
                f.write(str(self.before).encode())

    def _cut(self) -> None:
        if os.path.getsize(self.target) > self.before:
            os.truncate(self.target, self.before)

    def write(self, at: int, data: bytes) -> str | None:
        """Writes bytes at a place (from the old end on, when appending); the piece that holds them, if they are not yet in place."""
        if not self.random:
            return self.stage(data)
        fd = os.open(self.joined, os.O_CREAT | os.O_WRONLY, 0o644)
        try:
            view, at = memoryview(data), at + self.before
            while view:
                n = os.pwrite(fd, view, at)
                view, at = view[n:], at + n
        finally:
            os.close(fd)
        return None

    def put(self, at: int, data: bytes) -> pa.Table:
        """``write`` as a row of ``ROWS``."""
        return pa.table({"at": pa.array([at], pa.int64()), "length": pa.array([len(data)], pa.int64()), "file": pa.array([self.write(at, data)], pa.string())})

    def stage(self, data: bytes) -> str:
        """Bytes in a file of this job alone."""
        fs, _ = store_of(self.path)
        file = f"{self.staging}/{uuid.uuid4().hex}"
        with fs.open_output_stream(file) as f:
            f.write(data)
        return file

    def staged(self, file: str) -> bytes:
        with store_of(self.path)[0].open_input_stream(file) as f:
            return f.read()

    def stream(self, pieces: list[str], head: bytes = b"") -> None:
        """One task's part on stores without places: the old file when appending, then the pieces in order."""
        fs, _ = store_of(self.path)
        with fs.open_output_stream(self.joined) as out:
            out.write(head)
            for file in ([self.target] if self.before else []) + pieces:
                with fs.open_input_stream(file) as f:
                    while chunk := f.read(16 << 20):
                        out.write(chunk)

    def commit(self, written: DataFrame, head=lambda rows: b"") -> int:
        """Runs the tasks of ``written`` (rows of ``ROWS``), writes head(rows) at the begin and puts the file in its place; how many rows there were."""
        if self.random:
            n = written.count()
            first = head(n)
            if first or not n:
                self.write(0, first or b"")
        else:

            def join(batches):
                rows = sorted((r["at"], r["file"]) for batch in batches for r in batch.to_pylist())
                self.stream([f for _, f in rows], head(len(rows)))
                yield pa.RecordBatch.from_arrays([pa.array([len(rows)], pa.int64())], ["n"])

            n = written.repartition(1).mapInArrow(join, "n bigint").agg({"n": "sum"}).first()[0]
        self.finish()
        return n or 0

    def finish(self) -> None:
        """The file takes its place."""
        fs, _ = store_of(self.path)
        if self.joined != self.target:
            if fs.get_file_info(self.joined).type == pa.fs.FileType.NotFound:
                with fs.open_output_stream(self.joined):
                    pass
            fs.move(self.joined, self.target)
        else:
            fs.delete_file(f"{self.target}.appending")
        fs.delete_dir(self.staging)

    def abort(self) -> None:
        fs, _ = store_of(self.path)
        if self.before and self.random and fs.get_file_info(f"{self.target}.appending").type != pa.fs.FileType.NotFound:
            self._cut()
            fs.delete_file(f"{self.target}.appending")
        if fs.get_file_info(self.staging).type != pa.fs.FileType.NotFound:
            fs.delete_dir(self.staging)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local session without one takes a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def keep_planes(df: DataFrame, name: str) -> str:
    """Writes rows with a plane ``z`` in its order, a row group a row, for tasks that load a plane by ``plane_rows``; the table's path."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    ordered = df.repartitionByRange("z").sortWithinPartitions("z")
    ordered.write.option("parquet.block.row.count.limit", 1).parquet(path)
    return path


@functools.lru_cache(maxsize=16)
def _planes(path: str) -> pa.dataset.Dataset:
    fs, at = store_of(path)
    return pa.dataset.dataset(at, filesystem=fs, format="parquet")


def plane_rows(path: str, z: int) -> pa.Table:
    """The rows of a plane, by the row groups whose bounds hold it."""
    return _planes(path).to_table(filter=pa.dataset.field("z") == z)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes rows below the shared folder and reads them back: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
