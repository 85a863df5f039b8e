"""Helpers shared by the training-data operators.

Texts reach Python as Arrow buffers and are handled as one flat byte array per
batch, so tokenising and hashing are a few numpy passes and no per-word Python.

``counted`` is the distributed key count: documents are dealt into parts of
bounded text, each part sends every distinct key once to the key's range, ranges
add the counts up, and the totals go back to the parts that asked.  A key that
occurs in a third of all rows costs one entry a part, so no task is hot.  Where parts
are so many that their messages would hold few keys, runs of parts are added up first.
"""

from __future__ import annotations

import contextlib
import contextvars
import math
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one part of a document table holds, and the least number of parts.
PART_BYTES = 8 << 20
LEAST_PARTS = 64
#: Ranges up to which parts send their keys to them at once; beyond, in two levels.
MANY = 4096
#: Text bytes handled at once inside a task; bounds the numpy temporaries.
CHUNK = 2 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.default_rng(20240917)
BYTE_CODE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64) | np.uint64(1)
BYTE_CODE2 = _rng.integers(0, 1 << 64, 256, dtype=np.uint64) | np.uint64(1)
BASE = 0x9E3779B97F4A7C15
BASE2 = 0xC2B2AE3D27D4EB4F
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.  Only a local session, whose tasks run on this machine, may go without one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Tables that ``materialise`` has written in this process and nobody has discarded.
WRITTEN: list[str] = []
_NOTED: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("noted", default=None)


@contextlib.contextmanager
def noted():
    """The tables that ``materialise`` writes inside, in this thread alone: what may be discarded once nothing reads them."""
    paths: list[str] = []
    token = _NOTED.set(paths)
    try:
        yield paths
    finally:
        _NOTED.reset(token)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back: cuts lineage, survives lost executors.

    The table stays until ``discard``, as results are lazy and may still read it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    WRITTEN.append(path)
    if (paths := _NOTED.get()) is not None:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables that ``materialise`` has written.  What reads them can no longer run."""
    for path in paths:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        WRITTEN.remove(path)


def text_size(docs: DataFrame, text: str = "text") -> int:
    """All bytes of a text column."""
    return docs.agg(F.sum(F.octet_length(text))).first()[0] or 0


def part_count(size: int, part_bytes: int = PART_BYTES, least: int = LEAST_PARTS) -> int:
    return max(least, math.ceil(size / part_bytes))


def powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i <= n, kept between calls."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) <= n:
        size = 1 << max(16, int(n + 1).bit_length())
        have = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            have.append(np.multiply.accumulate(p))
        _POWERS[base] = have = tuple(have)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit integers."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Spans:
    """Hashes of any [start, end) of one byte array, each in constant time."""

    def __init__(self, data: np.ndarray, code: np.ndarray = BYTE_CODE, base: int = BASE):
        up, self.down = powers(len(data), base)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(code[data] * up[: len(data)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its offsets (nulls count as empty texts)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK):
    """Runs [i, j) of texts with about ``limit`` bytes together; a longer text is a run of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(data: np.ndarray, offsets: np.ndarray, outside: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each text the index of its first word (one more entry at the end)."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~outside[data]
    begin, stop = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    begin[edges] = inside[1:-1][edges]
    stop[edges - 1] = inside[1:-1][edges - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(starts, offsets, "left")


def pack(keys: np.ndarray) -> bytes:
    """Sorted distinct 64-bit keys as differences of the fewest bytes that hold them all."""
    if not len(keys):
        return b""
    steps = np.diff(keys)
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    return bytes([width]) + keys[:1].astype("<u8").tobytes() + np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, np.uint64)
    width = blob[0]
    steps = np.frombuffer(blob, np.uint8, offset=9).reshape(-1, width)
    out = np.zeros((len(steps) + 1, 8), np.uint8)
    out[1:, :width] = steps
    out = out.view("<u8").ravel()
    out[0] = np.frombuffer(blob, "<u8", 1, 1)[0]
    return np.cumsum(out, dtype=np.uint64)


def pack_counts(n: np.ndarray) -> bytes:
    """Counts as compressed byte planes: the high bytes of small numbers cost next to nothing."""
    planes = np.ascontiguousarray(n.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    width = int(max((int(n.max()) if len(n) else 0).bit_length() + 7, 8)) // 8
    return bytes([width]) + len(n).to_bytes(8, "little") + pa.compress(planes[:width].tobytes(), codec="zstd", asbytes=True)


def unpack_counts(blob: bytes) -> np.ndarray:
    width, size = blob[0], int.from_bytes(blob[1:9], "little")
    out = np.zeros((size, 8), np.uint8)
    if size:
        out[:, :width] = np.frombuffer(pa.decompress(blob[9:], width * size, codec="zstd", asbytes=True), np.uint8).reshape(width, size).T
    return out.view("<i8").ravel()


def squeeze(x: np.ndarray) -> bytes:
    return x.dtype.str.lstrip("|").encode() + b"|" + len(x).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(x).tobytes(), codec="zstd", asbytes=True)


def expand(blob: bytes) -> np.ndarray:
    kind, rest = blob.split(b"|", 1)
    kind, size = np.dtype(kind.decode()), int.from_bytes(rest[:8], "little")
    if not size:
        return np.zeros(0, kind)
    return np.frombuffer(pa.decompress(rest[8:], size * kind.itemsize, codec="zstd", asbytes=True), kind)


ASK = "range int, part int, keys binary, counts array<binary>"
TOLD = "part int, range int, counts array<binary>"


def ask(part: int, keys: np.ndarray, counts: list[np.ndarray], ranges: int) -> pa.Table:
    """Rows that send a part's sorted distinct keys with counts (of one or several kinds) to their ranges."""
    # Ranges are equal shares of the 64-bit keys; only those that are met cost anything.
    width = np.uint64(((1 << 64) - 1) // ranges)
    owner = np.minimum(keys // width, np.uint64(ranges - 1)).astype(np.int64)
    at = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(keys) else np.zeros(0, np.int64)
    cuts = np.append(at, len(keys))
    runs = list(zip(cuts[:-1], cuts[1:], strict=True))
    return pa.table(
        {
            "range": pa.array(owner[at], pa.int32()),
            "part": pa.array([part] * len(at), pa.int32()),
            "keys": pa.array([pack(keys[i:j]) for i, j in runs], pa.binary()),
            "counts": pa.array([[pack_counts(c[i:j]) for c in counts] for i, j in runs], pa.list_(pa.binary())),
        }
    )


class Messages:
    """What several parts ask of one range: their keys, and the counts of each kind added up by key."""

    def __init__(self, table: pa.Table):
        self.table = table.sort_by("part")
        keys = [unpack(b) for b in self.table.column("keys").to_pylist()]
        self.ends = np.cumsum([0, *map(len, keys)])
        every = np.concatenate(keys)
        self.distinct, self.place, self.slot = np.unique(every, return_index=True, return_inverse=True)
        kinds = zip(*self.table.column("counts").to_pylist(), strict=True)
        self.sums = [np.bincount(self.slot, np.concatenate([unpack_counts(b) for b in kind]), len(self.distinct)).astype(np.int64) for kind in kinds]

    def answers(self, totals: list[np.ndarray], elected: np.ndarray | None) -> pa.Table:
        """For each part the totals of its keys in order; where keys are elected, 1 more for the least part that asked."""
        columns = [t[self.slot] for t in totals]
        if elected is not None:
            first = np.zeros(len(self.slot), np.int64)
            first[self.place] = elected
            columns.append(first)
        blobs = [[pack_counts(c[i:j]) for c in columns] for i, j in zip(self.ends[:-1], self.ends[1:], strict=True)]
        return pa.table({"part": self.table.column("part"), "range": self.table.column("range"), "counts": pa.array(blobs, pa.list_(pa.binary()))})


def told_total(table: pa.Table, told: int, elect: bool) -> pa.Table:
    """Adds up one range: for each part that asked, the totals of its keys (of the first ``told`` kinds)."""
    m = Messages(table)
    return m.answers(m.sums[:told], np.ones(len(m.distinct), np.int64) if elect else None)


def totals_of(answer: pa.Table, told: int) -> list[np.ndarray]:
    """What came back to a part, as arrays in the order of its sorted keys."""
    if not answer.num_rows:
        return [np.zeros(0, np.int64)] * told
    answer = answer.sort_by("range")
    counts = answer.column("counts").to_pylist()
    return [np.concatenate([unpack_counts(c[k]) for c in counts]) for k in range(told)]


def counted(dealt: DataFrame, keys_of, use, schema: str, ranges: int, told: int = 1, elect: bool = False, many: int | None = None) -> DataFrame:
    """Counts keys over all parts of ``dealt`` (which has an int column ``part``) and hands each part its totals.

    keys_of(table) -> (sorted distinct uint64 keys, [counts of each kind]); use(table, totals) -> Arrow table of ``schema``.
    Totals come back for the first ``told`` kinds;
    elect adds a 0/1 column that is 1 for one part of those that have the key.
    Both see the whole part, which holds a bounded amount of text.  Up to ``many`` ranges (MANY) are asked directly.
    """

    def send(table: pa.Table) -> pa.Table:
        keys, counts = keys_of(table)
        return ask(table.column("part")[0].as_py(), keys, counts, ranges)

    def receive(table: pa.Table, answer: pa.Table) -> pa.Table:
        return use(table, totals_of(answer, told + elect))

    if ranges <= (many or MANY):
        asked = dealt.groupBy("part").applyInArrow(send, ASK)
        answers = asked.groupBy("range").applyInArrow(lambda table: told_total(table, told, elect), TOLD)
    else:
        # Two levels: runs of parts first add up what they ask of a coarse range, and each such sum is a part of the count by fine ranges.
        coarse, run = math.isqrt(ranges), math.isqrt(ranges)

        def send_coarse(table: pa.Table) -> pa.Table:
            keys, counts = keys_of(table)
            return ask(table.column("part")[0].as_py(), keys, counts, coarse)

        def merged(table: pa.Table):
            m = Messages(table.select(["range", "asker", "keys", "counts"]).rename_columns(["range", "part", "keys", "counts"]))
            return m.distinct, m.sums

        def spread(table: pa.Table, totals) -> pa.Table:
            m = Messages(table.select(["range", "asker", "keys", "counts"]).rename_columns(["range", "part", "keys", "counts"]))
            return m.answers(totals[:told], totals[told] if elect else None)

        asked = dealt.groupBy("part").applyInArrow(send_coarse, ASK).withColumnRenamed("part", "asker")
        asked = asked.withColumn("part", (F.floor(F.col("asker") / run) * coarse + F.col("range")).cast("int"))
        answers = counted(asked, merged, spread, TOLD, ranges, told, elect, ranges)
    return dealt.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(receive, schema)


PARCEL = "part int, parcel binary"
#: Equal rows of one task that are dealt together.
REPEATS = 16


def occurrences(keys: np.ndarray, seen: dict[int, int]) -> np.ndarray:
    """For each key how often it came before, here or in earlier calls with the same ``seen``."""
    order = np.argsort(keys, kind="stable")
    first = np.flatnonzero(np.append(True, keys[order][1:] != keys[order][:-1]))
    size = np.diff(np.append(first, len(keys)))
    distinct = keys[order][first].tolist()
    before = np.array([seen.get(k, 0) for k in distinct], np.int64)
    seen.update(zip(distinct, (before + size).tolist(), strict=True))
    out = np.empty(len(keys), np.int64)
    out[order] = np.arange(len(keys)) - np.repeat(first, size) + np.repeat(before, size)
    return out


def parcels(docs: DataFrame, parts: int) -> DataFrame:
    """Deals rows into parts by a hash of doc_id and text, as compressed Arrow batches, so that a text crosses the network once and small.

    Rows that repeat would all go to one part: what a task has met before is dealt by the task's number and how often it was
    met as well, so that of equal rows, however many, at most one a task goes to the common part.  Rows of a task are dealt
    alike whatever their order, so a task that is run again deals the same rows to the same parts.
    """
    columns = docs.columns

    def deal(batches):
        options, seen = pa.ipc.IpcWriteOptions(compression="zstd"), {}
        task = np.uint64(TaskContext.get().partitionId() + 1)
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(len(columns)).to_numpy(zero_copy_only=False)
            part, again = (key % parts).astype(np.int32), occurrences(key, seen).astype(np.uint64)
            salted = mix(mix(key.view(np.uint64) ^ mix(task << np.uint64(32))) ^ (again // np.uint64(REPEATS)))
            part = np.where(again > 0, salted % np.uint64(parts), part).astype(np.int32)
            order = np.argsort(part, kind="stable")
            first = np.flatnonzero(np.append(True, np.diff(part[order]) != 0))
            table = pa.Table.from_batches([batch.select(columns)]).take(pa.array(order))
            blobs = []
            for i, j in zip(first, [*first[1:], len(order)], strict=True):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, table.schema, options=options) as writer:
                    writer.write_table(table.slice(i, j - i))
                blobs.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(part[order][first], pa.int32()), pa.array(blobs, pa.binary())], ["part", "parcel"])

    # Rows of one doc_id, or of none, are told apart by their texts.
    return docs.withColumn("__part", F.xxhash64("doc_id", "text")).mapInArrow(deal, PARCEL)


def unparcel(table: pa.Table) -> pa.Table:
    """A part's rows, ordered by doc_id and text so that reruns agree."""
    rows = pa.concat_tables([pa.ipc.open_stream(b).read_all() for b in table.column("parcel").to_pylist()]).combine_chunks()
    return rows.sort_by([(c, "ascending") for c in ("doc_id", "text") if c in rows.column_names])


def crc_fold(column: Column, folds: int) -> Column:
    """crc32 of a value as text, modulo ``folds`` (null counts as an empty text)."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % folds
