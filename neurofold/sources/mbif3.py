"""Frames with 32-byte headers: height, width, then four scan values at byte 16 and uint16 pixels."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

HEADER = 32
SCHEMA = "path string, t int, h int, w int, px binary, scan_v array<float>"


def fix_error(v: Column) -> Column:
    """Undoes the recorder's overflow: values above 63000 wrapped; all are offset by 2535."""
    return F.when(v > 63000, v - 60465).otherwise(v + 2535)


class Frames(InputPartition):
    def __init__(self, path: str, first: int, last: int, h: int, w: int, scan: list[float]):
        self.path, self.first, self.last, self.h, self.w, self.scan = path, first, last, h, w, scan


class Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.block = options["path"], int(options.get("block", 64))

    def partitions(self):
        from .planestack import open_file, size_of

        with open_file(self.path) as f:
            head = f.read(HEADER)
        h, w = np.frombuffer(head, "<u4", 2).tolist()
        scan = np.frombuffer(head, "<f4", 4, 16).tolist()
        n = size_of(self.path) // (HEADER + 2 * h * w)
        return [Frames(self.path, i, min(i + self.block, n), h, w, scan) for i in range(0, n, self.block)]

    def read(self, part):
        from .planestack import open_file

        size = HEADER + 2 * part.h * part.w
        with open_file(part.path) as f:
            f.seek(part.first * size)
            for t in range(part.first, part.last):
                px = f.read(size)[HEADER:]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.path]), pa.array([t + 1], pa.int32()), pa.array([part.h], pa.int32()), pa.array([part.w], pa.int32()), pa.array([px], pa.binary()), pa.array([part.scan], pa.list_(pa.float32()))],
                    ["path", "t", "h", "w", "px", "scan_v"],
                )


class Mbif3(DataSource):
    """``spark.read.format("mbif3").load(path)``: one row a frame, headers stripped."""

    @classmethod
    def name(cls):
        return "mbif3"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return Reader(self.options)


def read(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(Mbif3)
    return spark.read.format("mbif3").load(path)
